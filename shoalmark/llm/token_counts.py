"""Token counts with a digest cache.

The cache is a Parquet table of ``(tokenizer, content, n_bytes, n_tokens)``:
digests of the tokenizer's version and of the normalised content.  Counting
joins the digests of all rows to it, encodes each distinct missing content
once, appends the new counts and joins again.  The texts of misses travel once,
after copies have been put together; the join of counts carries digests only,
and a content that a third of all rows share is split by the skew handling of
adaptive execution.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, importable, shared_dir

SCHEMA = "tokenizer string, content binary, n_bytes long, n_tokens long"
#: Where a text may be cut without changing its tokens, see ``Counter``.
CUT = re.compile(r" (?=\S)")
#: Units a worker remembers before it starts afresh.
REMEMBERED = 1_000_000
_COUNTERS: dict[str, Counter] = {}


class Counter(dict):
    """Token counts of units of text, for byte-level tokenizers that split words before merging.

    The splitting pattern ends a match before any space that is followed by
    something else than white space, whatever stands before it: letters, digits
    and signs never include a following space, and a run of white space leaves
    its last space to the word behind it.  So a text can be cut there, the
    units counted apart by the library, and the counts summed; the library
    sees each distinct unit once.
    """

    def __init__(self, serialised: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(serialised)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()

    def __missing__(self, unit: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        n = self[unit] = self.whole(" " + unit)
        return n

    def whole(self, text: str) -> int:
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def count(self, text: str) -> int:
        first, *rest = CUT.split(text)
        return (self.whole(first) if first else 0) + sum(map(self.__getitem__, rest))


def cuttable(serialised: str) -> bool:
    """Whether units may be counted apart: plain byte-level splitting, no normaliser, specials that stay in a unit."""
    import json

    spec = json.loads(serialised)
    pre = spec.get("pre_tokenizer") or {}
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    odd = any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", []))
    return bool(plain) and not spec.get("normalizer") and not odd


def version(serialised: str) -> str:
    """Digest of a tokenizer: its definition and the library's version."""
    import tokenizers

    return hashlib.sha256(f"tokenizers {tokenizers.__version__}\n{serialised}".encode()).hexdigest()


def normalised(text: Column) -> Column:
    """What the tokenizer is given: a missing text is an empty one, all else stays as it is."""
    return F.coalesce(text, F.lit(""))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(normalised(text).cast("binary"), 256))


def empty_cache(spark: SparkSession) -> str:
    """Path of a new cache in the shared folder."""
    path = shared_dir(spark)
    spark.createDataFrame([], SCHEMA).write.parquet(path)
    return path


def _counter(key: str, serialised: str) -> Counter:
    """The worker's counter, which outlives a task."""
    if key not in _COUNTERS:
        _COUNTERS[key] = Counter(serialised)
    return _COUNTERS[key]


def _encoder(key: str, serialised: str):
    apart = cuttable(serialised)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(key, serialised)
        count = counter.count if apart else counter.whole
        for batch in batches:
            texts = batch.column("_text")
            yield pa.RecordBatch.from_arrays(
                [batch.column("content"), batch.column("n_bytes"), pa.array([count(t.as_py()) for t in texts], pa.int64())],
                ["content", "n_bytes", "n_tokens"],
            )

    return run


def count(docs: DataFrame, cache: str, tokenizer: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """``docs`` with ``n_bytes`` (UTF-8), ``n_tokens`` and ``over_limit`` (more than ``limit``), one row per input row.

    ``tokenizer`` is a tokenizer definition as the library serialises it, ``cache`` the path of a cache table, which
    is extended by this call.  No begin, end or added special tokens; special strings inside a text are read as the
    library does by default.  A missing text counts as an empty one (0 tokens).  Input columns of the three names are
    replaced; the text column is not returned.  Repeated rows stay.
    """
    spark, key = docs.sparkSession, version(tokenizer)
    importable(spark)

    own, hit = fresh(docs, "_content", "_hit")

    def known() -> DataFrame:
        rows = spark.read.schema(SCHEMA).parquet(cache).where(F.col("tokenizer") == key)
        # Two writers may have counted the same content.
        return rows.groupBy(F.col("content").alias(hit)).agg(F.max("n_tokens").alias("n_tokens"))

    body = normalised(F.col(f"`{text}`"))
    missing = (
        docs.select(digest(F.col(f"`{text}`")).alias("content"), F.octet_length(body).cast("long").alias("n_bytes"), body.alias("_text"))
        .groupBy("content")
        .agg(F.first("n_bytes").alias("n_bytes"), F.first("_text").alias("_text"))
        .join(known(), F.col("content") == F.col(hit), "left_anti")
    )
    new = missing.mapInArrow(_encoder(key, tokenizer), "content binary, n_bytes long, n_tokens long")
    new.select(F.lit(key).alias("tokenizer"), "content", "n_bytes", "n_tokens").write.mode("append").parquet(cache)
    added = ["n_bytes", "n_tokens", "over_limit"]
    rows = docs.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in [*added, text]],
        digest(F.col(f"`{text}`")).alias(own),
        F.octet_length(body).cast("long").alias("n_bytes"),
    )
    return (
        rows.join(known(), F.col(own) == F.col(hit), "left")
        .drop(own, hit)
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
