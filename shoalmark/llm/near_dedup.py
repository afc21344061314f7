"""Near-duplicates of documents by SetSketch registers.

1. Each text becomes its set of word shingles, a digest of its words and a
   sketch of registers: per register the smallest of exponential values of the
   shingles, kept as a truncated power of a base, so sketches of parts merge by
   maximum.  Texts with the same words are one class from here on.
2. Four registers fill 64 bits: a sketch is a list of band values.  Classes
   that share a band value meet in its bucket, and each is paired with the
   bucket's pivot - the member with most company over all its buckets - not
   with every other member.
3. Pairs are estimated jointly from both sketches by likelihood; those clearly
   below the threshold go, the others are verified on their full shingle sets.
4. Where a bucket is still in several components, the members outside its
   largest one are compared with the rest in blocks, first for their best
   partners, then for all that are left, so a link missed by the pivots is
   found.  Parities of the shingle sets bound the similarity of a pair from
   above, so members that are nearly similar enough, of which a large group
   has very many pairs, are told apart without becoming rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shingles as sh
from .common import importable, in_proportion, land
from .graph import components

#: Registers of a sketch, registers of a band, and what the values are spaced by.
REGISTERS, BAND = 128, 4
BASE, RATE, LARGEST = 1.001, 20.0, 65_535
#: Shingles, and texts, that are sketched together.
CHUNK, CHUNK_TEXTS = 400_000, 2_000
#: A pair whose likeliest similarity is this much below the threshold is not verified: more than three and a half
#: standard deviations of the estimate at the threshold.
MARGIN = 0.14
#: Members of a block in the comparison of what the pivots left.
BLOCK = 1024
#: Bucket members of a task.
MEMBERS = 100_000
#: Pairs of registers, and words of parity, that are compared at once.
PAIRS_AT_ONCE, WORDS_AT_ONCE = 50_000, 2_000_000
#: Bits of parity: four a shingle, rounded up to a power of two, within these bounds.
LEAST_BITS, MOST_BITS = 64, 1 << 15
SKETCH = "_row binary, node binary, n long, bands array<long>, parity binary"


def sketch(sets: list[np.ndarray]) -> np.ndarray:
    """Registers (one row per set) of sets of 64-bit hashes; larger register: smaller value.

    An element's values come in ascending order, each for another register, so elements drop out as soon as their
    next value is above all of their set's registers.
    """
    m = REGISTERS
    least = np.full((len(sets), m), np.inf)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    h = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    stride, at = (h >> np.uint64(7)) | np.uint64(1), h
    x = np.zeros(len(h))
    flat = least.ravel()
    for j in range(m):
        x = x - np.log(sh.unit(sh.mix(h + sh.salt(j + 1)))) / (RATE * (m - j))
        if j:
            go = x < least.max(axis=1)[owner]
            h, x, owner, at, stride = h[go], x[go], owner[go], at[go], stride[go]
            if not len(h):
                break
        np.minimum.at(flat, owner * m + (at & np.uint64(m - 1)).astype(np.int64), x)
        at = at + stride
    with np.errstate(divide="ignore"):
        k = np.floor(1.0 - np.log(least) / np.log(BASE))
    return np.clip(np.nan_to_num(k, neginf=0.0), 0, LARGEST).astype(np.uint16)


def likeliest(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Similarity of most likelihood for rows of registers ``a``, ``b`` of sets with ``n_a``, ``n_b`` elements."""
    up, down = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - up - down
    u = n_a / (n_a + n_b)
    v = 1.0 - u
    step = (BASE - 1.0) / BASE
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1.0) * step) / np.log(BASE)

    def log_likelihood(j: np.ndarray) -> np.ndarray:
        more, less = p(u - v * j), p(v - u * j)
        return up * np.log(more) + down * np.log(less) + same * np.log(np.maximum(1.0 - more - less, 1e-12))

    low, high = np.zeros(len(u)), np.minimum(u / v, v / u)
    for _ in range(40):  # the logarithm is concave in the similarity
        third = (high - low) / 3
        left, right = low + third, high - third
        better = log_likelihood(left) < log_likelihood(right)
        low, high = np.where(better, left, low), np.where(better, high, right)
    return (low + high) / 2


def parity(hashes: np.ndarray) -> np.ndarray:
    """Bits, packed in 64-bit words: whether an odd number of a set's elements falls on a place.

    Places where two sets differ are at most as many as the elements that only one of them has.
    """
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (4 * len(hashes) - 1).bit_length()))
    odd = np.bincount((sh.mix(hashes) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")


def folded(words: np.ndarray, size: int) -> np.ndarray:
    """Parity as it would be with ``size`` words only."""
    while len(words) > size:
        words = words[: len(words) // 2] ^ words[len(words) // 2 :]
    return words


def differing(parities: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """A lower bound of the elements that only one set of each pair ``x, y`` has."""
    size = np.array([len(p) for p in parities])
    common = np.minimum(size[x], size[y])
    least = np.zeros(len(x), np.int64)
    for words in np.unique(common):
        at = np.nonzero(common == words)[0]
        used, place = np.unique(np.concatenate((x[at], y[at])), return_inverse=True)
        table = np.stack([folded(parities[i], int(words)) for i in used])
        step = max(1, WORDS_AT_ONCE // int(words))
        for lo in range(0, len(at), step):
            hi = min(lo + step, len(at))
            left, right = table[place[lo:hi]], table[place[len(at) + lo : len(at) + hi]]
            least[at[lo:hi]] = np.bitwise_count(left ^ right).sum(1)
    return least


def _sketches(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sh.WordHashes()
        empty = pa.array([], pa.int64())

        def flush(rows, nodes, sets):
            filled = [i for i, s in enumerate(sets) if len(s)]
            bands = sketch([sets[i] for i in filled]).astype("<u2").view("<i8").reshape(len(filled), REGISTERS // BAND)
            values = np.full((len(sets), bands.shape[1] if filled else 0), 0, np.int64)
            if filled:
                values[filled] = bands
            sizes = [values.shape[1] if len(s) else 0 for s in sets]
            flat = values[[i for i in filled]].ravel() if filled else np.empty(0, np.int64)
            offsets = pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32())
            lists = pa.ListArray.from_arrays(offsets, pa.array(flat, pa.int64()) if len(flat) else empty)
            odd = pa.array([parity(s).tobytes() if len(s) else None for s in sets], pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(rows, pa.binary()), pa.array(nodes, pa.binary()), pa.array([len(s) for s in sets], pa.int64()), lists, odd],
                ["_row", "node", "n", "bands", "parity"],
            )

        for batch in batches:
            rows, nodes, sets, held = [], [], [], 0
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
                tokens = sh.words(text.as_py())
                s = sh.distinct(sh.shingle_hashes(tokens, known, width))
                rows.append(row)
                nodes.append(hashlib.blake2b(b" ".join(tokens), digest_size=16).digest() if tokens else None)
                sets.append(s)
                held += len(s)
                if held >= CHUNK or len(rows) >= CHUNK_TEXTS:
                    yield flush(rows, nodes, sets)
                    rows, nodes, sets, held = [], [], [], 0
            if rows:
                yield flush(rows, nodes, sets)

    return run


def _registers(bands: pa.Array, rows: int) -> np.ndarray:
    flat = np.asarray(bands.flatten())
    return flat.astype("<i8").view("<u2").reshape(rows, -1)


def _estimated(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ra, rb = (_registers(batch.column(c), batch.num_rows) for c in ("bands_a", "bands_b"))
            j = likeliest(ra, rb, np.asarray(batch.column("n_a"), float), np.asarray(batch.column("n_b"), float))
            yield batch.select(["a", "b"]).filter(pa.array(j >= threshold - MARGIN))

    return run


def _verified(percent: int, width: int):
    """Pairs whose full sets are similar enough; rows come ordered by ``b``, whose set is kept from row to row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, last, last_set = sh.WordHashes(), None, None
        for batch in batches:
            good = []
            b_ids = batch.column("b").to_pylist()
            text_a, text_b = batch.column("text_a").cast(pa.binary()), batch.column("text_b").cast(pa.binary())
            for i, b in enumerate(b_ids):
                if b != last:
                    last, last_set = b, sh.distinct(sh.shingle_hashes(sh.words(text_b[i].as_py()), known, width))
                s = sh.distinct(sh.shingle_hashes(sh.words(text_a[i].as_py()), known, width))
                both = sh.overlap(s, last_set)
                good.append(100 * both >= percent * (len(s) + len(last_set) - both))
            yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def _best_of(stray: np.ndarray, score: np.ndarray, best: int) -> np.ndarray:
    """Indices of the ``best`` highest scores of each stray; all of them if ``best`` is 0."""
    order = np.lexsort((-score, stray))
    if not best or not len(order):
        return order
    sorted_ = stray[order]
    starts = np.nonzero(np.concatenate(([True], sorted_[1:] != sorted_[:-1])))[0]
    rank = np.arange(len(order)) - np.repeat(starts, np.diff(np.concatenate((starts, [len(order)]))))
    return order[rank < best]


def _strays(percent: int, best: int):
    """Likely pairs of a stray and a member of another component; with ``best``, that many for each stray of a group.

    Rows come ordered by group: a block of strays and a block of members of one bucket.  A pair that meets in several
    buckets is made in that of its first band.
    """
    group = ["band", "value", "i", "j"]
    threshold = percent / 100

    def pairs_of(rows: pa.Table) -> pa.RecordBatch:
        n = rows.num_rows
        keys = np.stack([np.asarray(rows[c]) for c in group])
        starts = np.concatenate(([0], np.nonzero((keys[:, 1:] != keys[:, :-1]).any(0))[0] + 1, [n]))
        registers = _registers(rows["bands"].combine_chunks(), n)
        bands = registers.view("<i8")
        parities = [np.frombuffer(p, "<u8") for p in rows["parity"].to_pylist()]
        root = np.asarray(rows["root"].combine_chunks().dictionary_encode().indices)
        size, stray = np.asarray(rows["n"], float), np.asarray(rows["stray"])
        found = [[], []]
        for lo, hi in zip(starts[:-1], starts[1:]):
            inside = np.arange(lo, hi)
            s, t = inside[stray[lo:hi]], inside[~stray[lo:hi]]
            for part in np.array_split(s, max(1, -(-len(s) * len(t) // PAIRS_AT_ONCE))):
                x, y = np.repeat(part, len(t)), np.tile(t, len(part))
                ok = (root[x] != root[y]) & (np.minimum(size[x], size[y]) >= threshold * np.maximum(size[x], size[y]))
                x, y = x[ok], y[ok]
                # Equal registers are at least as frequent as shared shingles.
                ok = (registers[x] == registers[y]).sum(1) >= (threshold - 2 * MARGIN) * REGISTERS
                x, y = x[ok], y[ok]
                ok = (bands[x] == bands[y]).argmax(1) == keys[0, lo]
                x, y = x[ok], y[ok]
                # What both have and what only one has add up to both sizes.
                ok = (100 - percent) * (size[x] + size[y]) >= (100 + percent) * differing(parities, x, y)
                found[0].append(x[ok])
                found[1].append(y[ok])
        x, y = (np.concatenate(f) if f else np.empty(0, np.int64) for f in found)
        j = likeliest(registers[x], registers[y], size[x], size[y])
        ok = j >= threshold - MARGIN
        x, y, j = x[ok], y[ok], j[ok]
        keep = _best_of(x, j, best)
        node = rows["node"].combine_chunks()
        a, b = node.take(pa.array(x[keep])).to_pylist(), node.take(pa.array(y[keep])).to_pylist()
        ends = [sorted(p) for p in zip(a, b)]
        return pa.RecordBatch.from_arrays([pa.array([e[k] for e in ends], pa.binary()) for k in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = rows if rest is None else pa.concat_tables([rest, rows]).combine_chunks()
            keys = np.stack([np.asarray(rows[c]) for c in group])
            changes = np.nonzero((keys[:, 1:] != keys[:, :-1]).any(0))[0]
            cut = int(changes[-1]) + 1 if len(changes) else 0
            if cut:
                yield pairs_of(rows.slice(0, cut))
            rest = rows.slice(cut)
        if rest is not None and rest.num_rows:
            yield pairs_of(rest)

    return run


def _row(text: str) -> Column:
    """128-bit name of a text; a missing one is an empty one."""
    return F.unhex(F.md5(F.coalesce(F.col(f"`{text}`"), F.lit("")).cast("binary")))


class _Corpus:
    """Classes of equal texts with their sketches, and access to their texts."""

    def __init__(self, docs: DataFrame, text: str, percent: int, width: int):
        self.percent, self.width, self.threshold = percent, width, percent / 100
        self.rows = docs.select(_row(text).alias("_row"), F.col(f"`{text}`").alias("_text"))
        found = land(self.rows.mapInArrow(_sketches(width), SKETCH))
        self.sketches = found
        classes = found.where("n > 0").groupBy("node").agg(F.min("_row").alias("_row"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("parity").alias("parity"))
        self.classes = land(classes)

    def hold(self, nodes: DataFrame) -> None:
        """Land sketch and one text of each class in ``nodes``; pairs are made of these only.

        The texts of all rows are shuffled here, once, and not again for each set of pairs.
        """
        wanted = self.classes.join(nodes.select("node").distinct(), "node", "left_semi").withColumnRenamed("_row", "_r")
        # Copies are put together before anything else, so a text that a third of the rows share travels once per task.
        once = self.rows.groupBy("_row").agg(F.first("_text").alias("text"))
        self.held = land(once.join(wanted, F.col("_row") == F.col("_r")).select("node", "n", "bands", "parity", "text"))

    def likely(self, pairs: DataFrame) -> DataFrame:
        side = lambda x: self.held.select(F.col("node").alias(x), F.col("n").alias("n_" + x), F.col("bands").alias("bands_" + x))
        return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(_estimated(self.threshold), "a binary, b binary")

    def links(self, pairs: DataFrame) -> DataFrame:
        """The pairs that hold on full sets."""
        left = pairs.join(self.held.select(F.col("node").alias("a"), F.col("text").alias("text_a")), "a")
        both = left.join(self.held.select(F.col("node").alias("b"), F.col("text").alias("text_b")), "b")
        return land(both.select("a", "b", "text_a", "text_b").mapInArrow(_verified(self.percent, self.width), "a binary, b binary"))


def _crowded(corpus: _Corpus) -> DataFrame:
    """``band, value, node, n`` of buckets with two members at least."""
    members = corpus.classes.select("node", "n", F.posexplode("bands").alias("band", "value"))
    sizes = members.groupBy("band", "value").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    return in_proportion(land(members.join(sizes, ["band", "value"])), MEMBERS)


def _with_pivots(crowded: DataFrame, percent: int) -> DataFrame:
    company = crowded.groupBy("node").agg(F.sum("size").alias("company"))
    ranked = crowded.join(company, "node")
    pivots = ranked.groupBy("band", "value").agg(F.max(F.struct("company", "node", "n")).alias("p"))
    near = F.lit(100) * F.least("n", "p.n") >= F.lit(percent) * F.greatest("n", "p.n")
    pairs = crowded.join(pivots, ["band", "value"]).where((F.col("node") != F.col("p.node")) & near)
    return pairs.select(F.least("node", "p.node").alias("a"), F.greatest("node", "p.node").alias("b")).distinct()


def _left_over(corpus: _Corpus, crowded: DataFrame, roots: DataFrame, best: int) -> DataFrame:
    """Likely pairs across the components of a bucket."""
    rooted = crowded.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    per_root = rooted.groupBy("band", "value", "root").agg(F.count(F.lit(1)).alias("c"))
    split = per_root.groupBy("band", "value").agg(
        F.count(F.lit(1)).alias("k"), F.max(F.struct("c", "root")).alias("main"), F.sum("c").alias("size")
    )
    # Two members are the pivot and its pair, which has been looked at.
    split = split.where("k > 1 and size > 2").select(
        "band",
        "value",
        F.col("main.root").alias("main"),
        F.ceil((F.col("size") - F.col("main.c")) / BLOCK).cast("int").alias("sb"),
        F.ceil(F.col("size") / BLOCK).cast("int").alias("mb"),
    )
    open_ = rooted.drop("size").join(split, ["band", "value"])
    place = lambda blocks: F.pmod(F.xxhash64("node"), blocks).cast("int")
    up_to = lambda blocks: F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))
    strays = open_.where("root <> main").withColumn("i", place(F.col("sb"))).withColumn("j", up_to("mb")).withColumn("stray", F.lit(True))
    members = open_.withColumn("j", place(F.col("mb"))).withColumn("i", up_to("sb")).withColumn("stray", F.lit(False))
    both = strays.unionByName(members).join(corpus.held.select("node", "bands", "parity"), "node")
    work = both.select("band", "value", "i", "j", "node", "n", "root", "bands", "parity", "stray").repartition("band", "value", "i", "j")
    ordered = work.sortWithinPartitions("band", "value", "i", "j")
    return ordered.mapInArrow(_strays(corpus.percent, best), "a binary, b binary").distinct()


def link(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = 75, width: int = sh.WIDTH) -> DataFrame:
    """``key, n_shingles, component_id, kept``, one row per row of ``docs``.

    Two texts are linked if ``100 * shared >= percent * all`` of their distinct shingles; ``component_id`` is the
    smallest key that links lead to, and a row is kept if that is its own.  Texts without words, and missing ones, are
    linked with nothing.  Rows without a key belong to a component but cannot name it; if no row of a component has a
    key, it has no id and its rows are kept.  Rows that repeat the smallest key are all kept.
    """
    importable(docs.sparkSession)
    corpus = _Corpus(docs, text, percent, width)
    crowded = _crowded(corpus)
    corpus.hold(crowded)
    tried = land(corpus.likely(_with_pivots(crowded, percent)))
    links = corpus.links(tried)
    roots = components(links)
    for best in (4, 0):
        more = land(_left_over(corpus, crowded, roots, best).join(tried, ["a", "b"], "left_anti"))
        if not more.isEmpty():
            new = corpus.links(more)
            tried = tried.unionByName(more)
            if not new.isEmpty():
                links = links.unionByName(new)
                roots = components(links)
    # The same text has the same words, so its hash leads to its class.
    nodes = corpus.sketches.select("_row", "node", "n").dropDuplicates(["_row"])
    classes = nodes.join(roots, "node", "left").select("_row", F.coalesce("root", "node").alias("root"), "n")
    rows = docs.select(F.col(f"`{key}`").alias("_key"), _row(text).alias("_r")).join(classes, F.col("_r") == F.col("_row"))
    rows = rows.select("_key", "root", F.col("n").alias("n_shingles"))
    smallest = rows.where("root is not null").groupBy(F.col("root").alias("_root")).agg(F.min("_key").alias("_least"))
    linked = rows.join(smallest, F.col("root") == F.col("_root"), "left")
    component = F.when(F.col("root").isNull(), F.col("_key")).otherwise(F.col("_least"))
    return linked.select(
        F.col("_key").alias(key),
        "n_shingles",
        component.alias("component_id"),
        F.coalesce(component == F.col("_key"), component.isNull()).alias("kept"),
    )
