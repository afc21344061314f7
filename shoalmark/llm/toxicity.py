"""Toxicity by the nearest labelled examples.

Similarity is the exact cosine of TF-IDF vectors.  Terms are words and their
four- and five-letter beginnings; the vocabulary is the terms that tell the
labels of the examples apart, document frequencies are counted over all
documents.  The examples lie in an inverted index by term, cut into blocks of
neighbouring examples with the largest weight per term and block: the bounds of
the blocks give the order of the search and its end, so the neighbours are exact
without scoring every example.

The examples are a bounded sample (``Settings.examples``); the index is as
large as they are and goes to every task.  Documents are scored where they are
scanned, nothing of them is shuffled.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import importable, land

WORD = re.compile(r"\w+")
BEGINNINGS = (4, 5)
#: Distinct words, and distinct vectors, a task remembers.
REMEMBERED = 200_000
#: Blocks that are looked into together.
AT_ONCE = 16


@dataclass(frozen=True)
class Settings:
    """``examples`` labelled rows of each label at most are learnt from, those of smallest hash; every term of theirs
    whose labels differ by ``least_chi2`` is in the vocabulary, however many there are."""

    examples: int = 5000
    least_chi2: float = 25.0
    neighbours: int = 15
    block: int = 64
    evidence: int = 3


def terms_of(word: str) -> list[str]:
    """A word and its beginnings, marked by a star."""
    return [word, *(word[:n] + "*" for n in BEGINNINGS if len(word) >= n)]


class Vocabulary(dict):
    """Word to the numbers of its terms."""

    def __init__(self, terms: list[str]):
        self.terms = {t: i for i, t in enumerate(terms)}
        #: A word has a term only if one begins like it; most words are passed over here.
        self.heads = {t.rstrip("*")[: BEGINNINGS[0]] for t in terms}

    def __missing__(self, word: str) -> tuple:
        if len(self) >= REMEMBERED:
            self.clear()
        ids = self[word] = tuple(self.terms[t] for t in terms_of(word) if t in self.terms)
        return ids

    def counts(self, text: str | None) -> tuple[tuple[int, int], ...]:
        """``(term, count)`` in order of terms."""
        heads, short = self.heads, BEGINNINGS[0]
        likely = [w for w in WORD.findall((text or "").lower()) if w[:short] in heads]
        found = Counter(i for ids in map(self.__getitem__, likely) for i in ids)
        return tuple(sorted(found.items()))


def vector(counts: tuple[tuple[int, int], ...], idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Terms and weights of unit length."""
    ids = np.array([i for i, _ in counts], np.int64)
    w = np.array([1.0 + math.log(c) for _, c in counts]) * idf[ids] if counts else np.empty(0)
    return ids, w / math.sqrt(float(w @ w)) if len(w) else w


class Index:
    """Block-max inverted index of the examples' vectors."""

    def __init__(self, vectors: list[tuple[np.ndarray, np.ndarray]], terms: int, block: int):
        self.size, self.block = len(vectors), block
        self.blocks = -(-self.size // block)
        owner = np.repeat(np.arange(self.size), [len(v[0]) for v in vectors])
        term = np.concatenate([v[0] for v in vectors]) if vectors else np.empty(0, np.int64)
        weight = np.concatenate([v[1] for v in vectors]) if vectors else np.empty(0)
        order = np.lexsort((owner, term))
        self.owner, self.weight = owner[order], weight[order]
        # Where the postings of a term and block start.
        slot = term[order] * self.blocks + self.owner // block
        self.start = np.searchsorted(slot, np.arange(terms * self.blocks + 1))
        self.most = np.zeros(terms * self.blocks)
        np.maximum.at(self.most, slot, self.weight)
        self.most = self.most.reshape(terms, self.blocks) if self.blocks else self.most.reshape(terms, 0)

    def nearest(self, ids: np.ndarray, weights: np.ndarray, k: int, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """The ``k`` most similar examples that share a term, and their similarities; earlier blocks win ties."""
        if not len(ids) or not self.blocks:
            return np.empty(0, np.int64), np.empty(0)
        who, score = np.empty(0, np.int64), np.empty(0)
        bound = weights @ self.most[ids]
        order = np.argsort(-bound, kind="stable")
        order = order[bound[order] > 0]
        # The first blocks tell what the others have to beat; those that may are looked into together.
        some, order = order[:AT_ONCE], order[AT_ONCE:]
        while len(some):
            found, value = self._similarities(ids, weights, some)
            stay = found != without
            if len(score) == k:
                stay &= value > score[-1]
            who, score = np.concatenate((who, found[stay])), np.concatenate((score, value[stay]))
            best = np.argsort(-score, kind="stable")[:k]
            who, score = who[best], score[best]
            some, order = (order if len(score) < k else order[bound[order] > score[-1]]), order[:0]
        return who, score

    def _similarities(self, ids: np.ndarray, weights: np.ndarray, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Examples of some blocks that share a term, blocks in their order, and their similarities."""
        # All postings of the query's terms in these blocks, one after the other.
        slot = (ids[:, None] * self.blocks + some).ravel()
        lo, n = self.start[slot], self.start[slot + 1] - self.start[slot]
        at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        shift = np.tile((np.arange(len(some)) - some) * self.block, len(ids))
        value = np.bincount(
            self.owner[at] + np.repeat(shift, n), self.weight[at] * np.repeat(np.repeat(weights, len(some)), n), len(some) * self.block
        )
        place = np.nonzero(value)[0]
        return some[place // self.block] * self.block + place % self.block, value[place]


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return math.log(p / (1 - p))


def fit_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic curve, with targets kept off 0 and 1 and a slight pull towards slope 1."""
    up, down = float(weight[y > 0].sum()), float(weight[y <= 0].sum())
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    theta, prior = np.array([1.0, 0.0]), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(theta[0] * x + theta[1], -40, 40)))
        g = np.array([(weight * (p - target) * x).sum(), (weight * (p - target)).sum()]) + 1e-2 * (theta - prior)
        v = weight * p * (1 - p)
        h = np.array([[(v * x * x).sum(), (v * x).sum()], [(v * x).sum(), v.sum()]]) + 1e-2 * np.eye(2)
        step = np.linalg.solve(h, g)
        theta = theta - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-9:
            break
    return float(theta[0]), float(theta[1])


class Model:
    """Votes of the neighbours, weighted by squared similarity and by how many labelled rows an example stands for."""

    def __init__(self, settings: Settings, terms: list[str], idf: np.ndarray, ids: list, labels: np.ndarray, stands: np.ndarray, counts: list):
        self.settings, self.vocabulary, self.idf = settings, Vocabulary(terms), idf
        order = sorted(range(len(ids)), key=lambda i: (counts[i], i))  # alike examples share blocks
        self.ids, self.labels, self.stands = [ids[i] for i in order], labels[order], stands[order]
        vectors = [vector(counts[i], idf) for i in order]
        self.index = Index(vectors, len(terms), settings.block)
        blank = np.array([not len(v[0]) for v in vectors], bool)
        share = lambda mask: float((self.stands * self.labels)[mask].sum() / self.stands[mask].sum()) if mask.any() else None
        everywhere = share(np.ones(len(blank), bool)) or 0.0
        self.blank = share(blank) if blank.any() else everywhere
        self.curve, self.known = (1.0, 0.0), {}
        if len(ids):
            raw = np.array([_logit(self.vote(*self.index.nearest(*v, settings.neighbours, without=i))) for i, v in enumerate(vectors)])
            self.curve = fit_logistic(raw, self.labels, self.stands)

    def vote(self, who: np.ndarray, similarity: np.ndarray) -> float:
        if not len(who):
            return self.blank
        w = similarity**2 * self.stands[who]
        # As much of the answer as the nearest example is unlike stays with texts that have no telling term.
        near = float(similarity[0])
        return near * float((w * self.labels[who]).sum() / w.sum()) + (1 - near) * self.blank

    def score(self, text: str | None) -> tuple[float, list]:
        counts = self.vocabulary.counts(text)
        if counts not in self.known:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            who, similarity = self.index.nearest(*vector(counts, self.idf), self.settings.neighbours)
            p = 1 / (1 + math.exp(-max(-40.0, min(40.0, self.curve[0] * _logit(self.vote(who, similarity)) + self.curve[1]))))
            shown = zip(who[: self.settings.evidence].tolist(), similarity.tolist())
            self.known[counts] = p if len(self.ids) else 0.0, [(self.ids[i], s, int(self.labels[i])) for i, s in shown]
        return self.known[counts]


def held_out(key: Column) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % 5 == 0


def _example_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen = (Counter(), Counter())
        for label, text in zip(batch.column("toxic").to_pylist(), batch.column("text")):
            words = set(WORD.findall((text.as_py() or "").lower()))
            seen[label].update({t for w in words for t in terms_of(w)})
        terms = list(seen[0] | seen[1])
        cols = [pa.array(terms, pa.string()), *(pa.array([c[t] for t in terms], pa.int64()) for c in seen)]
        yield pa.RecordBatch.from_arrays(cols, ["term", "clean", "toxic"])


def _frequencies(terms: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary, df, n = Vocabulary(terms), Counter(), 0
        for batch in batches:
            for text in batch.column(0):
                n += 1
                df.update(i for i, _ in vocabulary.counts(text.as_py()))
        df[-1] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(df), pa.int64()), pa.array(list(df.values()), pa.int64())], ["term", "df"])

    return run


def _counted(terms: list[str]):
    """``_id, toxic`` of examples with the terms of their texts and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary(terms)
        for batch in batches:
            found = [vocabulary.counts(t.as_py()) for t in batch.column("text")]
            lists = [pa.array([[c[i] for c in f] for f in found], pa.list_(pa.int64())) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("_id"), batch.column("toxic"), *lists], ["_id", "toxic", "terms", "times"])

    return run


def _scorer(model: Model, key_type: pa.DataType):
    evidence = pa.list_(pa.struct([("example", key_type), ("similarity", pa.float64()), ("toxic", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [model.score(t.as_py()) for t in batch.column("_text")]
            why = [[dict(zip(("example", "similarity", "toxic"), e)) for e in f[1]] for f in found]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([f[0] for f in found], pa.float64()), pa.array(why, evidence)],
                [*batch.schema.names[:-1], "score", "evidence"],
            )

    return run


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", settings: Settings = Settings()) -> Model:
    """Learn from rows of ``labels`` (``key, toxic``) whose key is not held out; document frequencies come from all ``docs``.

    A key labelled more than once is toxic if any label says so; missing keys and labels, and labels without a
    document, teach nothing; of rows that repeat a key the greatest text counts.
    """
    importable(docs.sparkSession)
    k = F.col(f"`{key}`")
    taught = labels.where(k.isNotNull() & F.col("toxic").isNotNull() & ~held_out(k)).groupBy(k.alias("_id")).agg(F.max("toxic").alias("toxic"))
    texts = docs.select(k.alias("_k"), F.col(f"`{text}`").alias("text"))
    with_text = taught.join(texts.select("_k").distinct(), F.col("_id") == F.col("_k"), "left_semi")
    sizes = {r["toxic"]: r["n"] for r in with_text.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).where("toxic in (0, 1)").collect()}
    chosen = None
    for label in (0, 1):
        some = with_text.where(F.col("toxic") == label).orderBy(F.xxhash64("_id"), "_id").limit(settings.examples)
        chosen = some if chosen is None else chosen.unionByName(some)
    # As many rows as the settings allow, so the broadcast has a bound.
    sample = texts.join(F.broadcast(land(chosen)), F.col("_k") == F.col("_id")).groupBy("_id").agg(F.max("toxic").alias("toxic"), F.max("text").alias("text"))
    sample = land(sample)
    used = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n0, n1 = used.get(0, 0), used.get(1, 0)
    per_term = sample.select("toxic", "text").mapInArrow(_example_terms, "term string, clean long, toxic long").groupBy("term")
    per_term = per_term.agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b"))
    p = (F.col("a") + F.col("b")) / max(n0 + n1, 1)
    spread = p * (1 - p) * (1 / max(n0, 1) + 1 / max(n1, 1))
    chi2 = F.when(spread > 0, F.pow(F.col("b") / max(n1, 1) - F.col("a") / max(n0, 1), 2) / spread).otherwise(0.0)
    best = per_term.withColumn("chi2", chi2).where(F.col("chi2") >= settings.least_chi2).orderBy(F.desc("chi2"), "term")
    terms = [r["term"] for r in best.collect()]
    df = {r["term"]: r["n"] for r in texts.select("text").mapInArrow(_frequencies(terms), "term long, df long").groupBy("term").agg(F.sum("df").alias("n")).collect()}
    idf = np.array([math.log((1 + df.get(-1, 0)) / (1 + df.get(i, 0))) + 1 for i in range(len(terms))])
    kinds = {f.name: f.dataType.simpleString() for f in sample.schema.fields}
    counted = sample.select("_id", "toxic", "text").mapInArrow(
        _counted(terms), f"_id {kinds['_id']}, toxic {kinds['toxic']}, terms array<long>, times array<long>"
    )
    # As many rows as the settings allow, each with the terms of the vocabulary it holds.
    rows = [(r["_id"], r["toxic"], tuple(zip(r["terms"], r["times"]))) for r in counted.orderBy(F.xxhash64("_id"), "_id").collect()]
    stands = {label: sizes.get(label, 0) / max(used.get(label, 0), 1) for label in (0, 1)}
    labels_ = np.array([r[1] for r in rows], float)
    return Model(settings, terms, idf, [r[0] for r in rows], labels_, np.array([stands[r[1]] for r in rows]), [r[2] for r in rows])


def score(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, held_out, score, predicted, evidence``, one row per input row.

    ``score`` (0 to 1) depends on the text alone; missing and empty texts get the score of texts without a telling
    term, and 0 without any examples.  ``evidence`` lists the nearest examples.  A missing key is not held out.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    kind = docs.schema[key].dataType
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    schema = f"_key {kind.simpleString()}, score double, evidence array<struct<example: {kind.simpleString()}, similarity: double, toxic: int>>"
    found = rows.mapInArrow(_scorer(model, to_arrow_type(kind)), schema)
    k = F.col("_key")
    return found.select(
        k.alias(key), F.coalesce(held_out(k), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence"
    )


def clean(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without the rows whose text scores 0.5 or more; columns as they are."""
    importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([model.score(t.as_py())[0] < 0.5 for t in batch.column(text)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
