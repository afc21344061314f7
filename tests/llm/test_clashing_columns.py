"""Every operator keeps its results when the caller's table has columns named as its own."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shoalmark.llm import centroids, decontaminate, license_scan, line_dedup, near_dedup, piece_sampling, quality_rules, queries, sharding, token_alignment, token_counts
from shoalmark.llm import toxicity as tx

NAMES = (
    "_a _b _bands _content _f _found _gone _h _hit _id _k _key _known _least _new _r _root _row _s _stay _text _v a b band block bands content "
    "count degree embedding_ first id j k kept label labels last level line line_no node n n_tokens n_words pieces place r root row s score "
    "shard size slot stray tokens toxic units value vec x y"
).split()
TEXTS = ["Licensed under the MIT License. One two three four five six seven.", "a b c d e f g h.\nMenu\na b c d e f g h.", None, "", "x y z " * 40]


def definition():
    with open(queries.tokenizer_file("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


def labels(spark):
    return spark.createDataFrame([(i, i % 2) for i in range(5)], "doc_id long, toxic int")


OPERATORS = {
    "op1": lambda spark, d: token_counts.count(d, token_counts.empty_cache(spark), definition()),
    "op2": lambda spark, d: line_dedup.clean(d),
    "op2_classes": lambda spark, d: line_dedup.classes(d),
    "op4": lambda spark, d: sharding.assign(d, shards=3),
    "op5": lambda spark, d: piece_sampling.encode(d, queries.piece_model(), k=2, seed=1),
    "op6": lambda spark, d: near_dedup.link(d),
    "op7": lambda spark, d: quality_rules.clean(d),
    "op9": lambda spark, d: tx.score(d, tx.fit(d, labels(spark))),
    "op9_clean": lambda spark, d: tx.clean(d, tx.fit(d, labels(spark))),
    "op10": lambda spark, d: decontaminate.clean(d, spark.createDataFrame([(1, TEXTS[0])], "item_id long, text string"), percent=75),
    "op11": lambda spark, d: centroids.cluster(d.withColumn("vec_id", F.col("doc_id")).withColumn("embedding", F.array(F.lit(1.0), F.lit(2.0))), k=2, dims=2),
    "op12": lambda spark, d: token_alignment.align(d, definition(), queries.piece_model()),
    "op13": lambda spark, d: license_scan.scan(d),
    "near copies": lambda spark, d: corpus_pipeline.drop_near_copies(spark, d, ""),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_clashing_columns(spark, name):
    plain = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    crowded = plain.select("*", *[F.lit(f"mine {n}").alias(n) for n in NAMES])
    want = OPERATORS[name](spark, plain)
    got = OPERATORS[name](spark, crowded)
    assert len(set(got.columns)) == len(got.columns) and set(want.columns) <= set(got.columns)
    assert sorted(map(str, got.select(*want.columns).collect())) == sorted(map(str, want.collect()))
    for r in got.select(*[c for c in got.columns if c not in want.columns]).collect():
        assert all(v == f"mine {c}" for c, v in r.asDict().items())
