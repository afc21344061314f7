"""Test items inside documents: size-partitioned MinHash containment search.

Items are partitioned by the number of their shingles, in powers of two.  For a
partition of up to L shingles a document is seen as windows of two adjacent
blocks of L positions, so whatever an item left in it, up to L positions long,
lies within one window that is at most four times the item's size, for items of
one shingle as for long ones.  Item and window then resemble each other
enough for plain MinHash: a window that shares one of the item's minima, in the
same permutation, makes the document a candidate.  Candidates are verified on
the exact shingles of the whole document, wherever they stand.

Items are the query set and are taken in blocks of bounded size; each block
passes over the documents once, in the tasks that scan them.  Documents are not
shuffled; items are, to put repeated rows together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles as sh
from .common import importable

#: Permutations.  An item three quarters of which stand together shares at least about a fifth of a window's union, and
#: is then missed with a chance below one in a million.
PERMUTATIONS = 64
#: UTF-8 bytes of the items of a block, and shingles of documents that are searched together.
ITEM_BYTES, CHUNK = 4_000_000, 400_000
_U = np.uint64


def _permuted(h: np.ndarray, p: int) -> np.ndarray:
    x = (h ^ sh.salt(2 * p + 1)) * (sh.mix(np.array([p + 1], np.uint64))[0] | _U(1))
    return x ^ (x >> _U(32))


class Index:
    """Minima of a block of items by partition and permutation."""

    def __init__(self, items: list[tuple], percent: int, width: int):
        known, self.percent, self.width = sh.WordHashes(), percent, width
        self.ids, self.sets, by_level = [], [], {}
        for item, text in items:
            tokens = sh.words(text.encode() if isinstance(text, str) else text)
            h = sh.distinct(sh.shingle_hashes(tokens, known, width))
            if len(h):
                level = 1 << (len(h) - 1).bit_length()
                by_level.setdefault(level, []).append((len(self.ids), h))
                self.ids.append(item)
                self.sets.append(exact(tokens, width))
        self.levels = {}
        for level, members in sorted(by_level.items()):
            owner = np.array([i for i, _ in members])
            tables = []
            for p in range(PERMUTATIONS):
                least = np.array([_permuted(h, p).min() for _, h in members], np.uint64)
                order = np.argsort(least, kind="stable")
                hint = np.zeros(1 << 16, bool)
                hint[(least & _U(0xFFFF)).astype(np.int64)] = True
                tables.append((hint, least[order], owner[order]))
            self.levels[level] = tables

    def candidates(self, hashes: list[np.ndarray]) -> dict[int, set[int]]:
        """Items that each of some documents may hold."""
        out: dict[int, set[int]] = {}
        lengths = np.array([len(h) for h in hashes])
        ends = np.cumsum(lengths)
        all_ = np.concatenate(hashes)
        blocks = {}
        for level in self.levels:
            per = -(-lengths // level)
            doc = np.repeat(np.arange(len(hashes)), per)
            number = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
            blocks[level] = (ends - lengths)[doc] + number * level, doc, doc[1:] == doc[:-1]
        for p in range(PERMUTATIONS):
            values = _permuted(all_, p)
            for level, tables in self.levels.items():
                starts, doc, together = blocks[level]
                if not len(starts):
                    continue
                least = np.minimum.reduceat(values, starts)
                window = least.copy()
                np.minimum(least[:-1], least[1:], out=window[:-1], where=together)
                hint, sorted_, owner = tables[p]
                seen = np.nonzero(hint[(window & _U(0xFFFF)).astype(np.int64)])[0]
                lo, hi = np.searchsorted(sorted_, window[seen], "left"), np.searchsorted(sorted_, window[seen], "right")
                for k in np.nonzero(hi > lo)[0]:
                    out.setdefault(int(doc[seen[k]]), set()).update(owner[lo[k] : hi[k]].tolist())
        return out

    def verified(self, tokens: list[bytes], items: set[int]) -> list[tuple]:
        """``(item, n_item, n_found)`` of the items whose shingles the document really holds."""
        have = exact(tokens, self.width)
        found = ((self.ids[i], len(self.sets[i]), len(self.sets[i] & have)) for i in sorted(items))
        return [f for f in found if 100 * f[2] >= self.percent * f[1]]

    def hits(self, texts: Iterator[bytes | None]) -> Iterator[list[tuple]]:
        """For every text in turn, its verified items."""
        known, tokens, hashes, held = sh.WordHashes(), [], [], 0

        def flush():
            maybe = self.candidates(hashes) if self.levels and held else {}
            for i, t in enumerate(tokens):
                yield self.verified(t, maybe[i]) if i in maybe else []

        for text in texts:
            tokens.append(sh.words(text))
            hashes.append(sh.shingle_hashes(tokens[-1], known, self.width))
            held += len(hashes[-1])
            if held >= CHUNK:
                yield from flush()
                tokens, hashes, held = [], [], 0
        yield from flush()


def exact(tokens: list[bytes], width: int) -> set[tuple]:
    """Shingles as they are; a shorter text is one shingle."""
    w = min(width, len(tokens))
    return {tuple(tokens[i : i + w]) for i in range(len(tokens) - w + 1)} if w else set()


def _item_blocks(items: DataFrame, key: str, text: str) -> Iterator[list[tuple]]:
    """Blocks of ``((item, times), text)``: repeated rows are one, and items that share a text fall into many blocks."""
    rows = items.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).where("t is not null")
    rows = rows.groupBy("k", "t").agg(F.count(F.lit(1)).alias("times"))
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    n = max(1, -(-total // ITEM_BYTES))
    for b in range(n):  # one bounded block on the driver at a time
        yield [((r["k"], r["times"]), r["t"]) for r in rows.where(F.pmod(F.xxhash64("k", "t"), F.lit(n)) == b).collect()]


def _texts(batch: pa.RecordBatch, name: str) -> Iterator[bytes | None]:
    return (t.as_py() for t in batch.column(name).cast(pa.binary()))


def _finder(index: Index, item_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, found = [], []
            for i, hits in enumerate(index.hits(_texts(batch, "_text"))):
                for (item, times), n, k in hits:
                    at += [i] * times
                    found += [(item, n, k)] * times
            item, n, k = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column("_key").take(pa.array(at, pa.int64())), pa.array(item, item_type), pa.array(n, pa.int64()), pa.array(k, pa.int64())],
                ["_key", "_item", "n_item", "n_found"],
            )

    return run


def _cleaner(index: Index, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([not hits for hits in index.hits(_texts(batch, text))], pa.bool_()))

    return run


def search(
    docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", text: str = "text", percent: int = 75, width: int = sh.WIDTH
) -> DataFrame:
    """``key, item, n_item, n_found, containment`` of every document and item with ``100 * n_found >= percent * n_item``.

    ``n_item`` counts the item's distinct shingles, ``n_found`` those the document holds.  Words are lower-cased (A-Z)
    runs between ASCII white space.  An item of fewer words than a shingle is found in documents of the same words
    only.  Missing and empty texts, on either side, match nothing; repeated rows, on either side, are repeated in the
    result; a missing key or item id is returned as it is.
    """
    importable(docs.sparkSession)
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = docs.schema[key].dataType.simpleString(), items.schema[item].dataType
    schema = f"_key {kinds[0]}, _item {kinds[1].simpleString()}, n_item long, n_found long"
    rows = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    out = None
    for block in _item_blocks(items, item, text):
        found = rows.mapInArrow(_finder(Index(block, percent, width), to_arrow_type(kinds[1])), schema)
        out = found if out is None else out.unionByName(found)
    names = F.col("_key").alias(key), F.col("_item").alias(item)
    return out.select(*names, "n_item", "n_found", (F.col("n_found") / F.col("n_item")).alias("containment"))


def clean(docs: DataFrame, items: DataFrame, item: str = "item_id", text: str = "text", percent: int = 75, width: int = sh.WIDTH) -> DataFrame:
    """``docs`` without the rows in which ``search`` would find an item; columns and other rows as they are."""
    importable(docs.sparkSession)
    for block in _item_blocks(items, item, text):
        docs = docs.mapInArrow(_cleaner(Index(block, percent, width), text), docs.schema)
    return docs
