"""Sampled segmentations, the pipeline, the registered queries."""

import collections
import math
import os
import tracemalloc

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from conftest import DATA
from shoalmark.llm import decontaminate, line_dedup, near_dedup, piece_sampling, queries, toxicity
from shoalmark.llm.common import table


@pytest.fixture(scope="module")
def pieces():
    return piece_sampling.Pieces(queries.piece_model())


def segmentations(text, pieces):
    """Every path of a short text with its log-probability."""
    norm, out = pieces.normalised(text), {}
    ids = {pieces.sp.id_to_piece(i): i for i in range(pieces.sp.vocab_size()) if pieces.bytes[i] and not pieces.sp.is_byte(i)}

    def walk(at, path, log_p):
        if at == len(norm):
            out[path] = log_p
        for n in range(1, pieces.longest + 1):
            i = ids.get(norm[at : at + n]) if at + n <= len(norm) else None
            if i is not None:
                walk(at + n, (*path, i), log_p + pieces.log_p[i])

    walk(0, (), 0.0)
    whole = np.logaddexp.reduce(list(out.values()))
    return {k: v - whole for k, v in out.items()}


def test_samples_follow_the_distribution_without_replacement(pieces):
    true, n = segmentations("the cat", pieces), 6000
    first, second, mass, by = collections.Counter(), collections.Counter(), 0.0, collections.defaultdict(list)
    for s in piece_sampling.sample_texts(list(range(n)), ["the cat"] * n, pieces, 3, 0):
        by[s[0]].append(s)
    for v in by.values():
        paths = [tuple(s[2].tolist()) for s in v]
        assert len(set(paths)) == 3 and v[0][4] >= v[1][4] >= v[2][4]
        assert all(abs(true[p] - s[3]) < 1e-9 for p, s in zip(paths, v))
        first[paths[0]] += 1
        second[paths[1]] += 1
        mass += sum(math.exp(s[3] - s[5]) for s in v) / n
    p = {k: math.exp(x) for k, x in true.items()}
    for path in sorted(p, key=p.get)[-4:]:
        follows = sum(p[a] * p[path] / (1 - p[a]) for a in p if a != path)
        assert abs(first[path] / n - p[path]) < 0.03 and abs(second[path] / n - follows) < 0.03
    assert abs(mass - 1) < 0.02


def test_units_are_what_the_pattern_finds():
    for text in ("", "▁a▁b", "a▁b", "▁a▁▁b", "▁▁a", "▁a▁", "▁", "▁▁", "a", "▁a\n▁b\t", "▁a▁\n"):
        assert piece_sampling.units_of(text) == piece_sampling.UNIT.findall(text), text


def test_round_trip_and_odd_rows(spark):
    texts = ["", None, "a", "  two  spaces\n\ttab ", "héllo wörld 漢字 \U0001f600 \x00", "word " * 3000, "y" * 5000, "the cat"]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(7, "the cat", 1), (None, "the cat", 1)], "doc_id long, text string, ids int")
    made = piece_sampling.decode(piece_sampling.encode(docs, queries.piece_model(), k=3, digest=True), queries.piece_model())
    rows = collections.defaultdict(list)
    for r in made.collect():
        rows[r.doc_id].append(r)
    assert [len(rows[i]) for i in range(4)] == [1, 1, 2, 3] and len(rows[7]) == 6 and len(rows[None]) == 3
    assert all(r.text == (texts[i] or "") for i, v in rows.items() if i is not None for r in v)
    assert rows[0][0].log_inclusion == 0 and {r.log_inclusion for r in rows[2]} == {0.0}
    assert sorted(map(str, rows[7][:3])) == sorted(map(str, rows[7][3:])) or len({tuple(r.ids) for r in rows[7]}) == 3
    assert piece_sampling.encode(docs.where("false"), queries.piece_model()).count() == 0


def test_results_do_not_depend_on_partitions(spark):
    docs = table(spark, DATA, "documents").select("doc_id", "text").limit(40)
    one, many = (
        sorted((r.doc_id, r.sample, tuple(r.ids)) for r in piece_sampling.encode(docs.repartition(n), queries.piece_model()).collect()) for n in (1, 7)
    )
    assert one == many


def odd_documents(spark):
    docs = table(spark, DATA, "documents")
    none = docs.limit(1).selectExpr("CAST(NULL AS BIGINT) AS doc_id", "CAST(NULL AS STRING) AS text", "lang", "source", "n_chars")
    return docs.unionByName(none).unionByName(docs.limit(3))


def test_pipeline_stages_do_what_their_operators_find(spark):
    docs = odd_documents(spark)
    model = toxicity.fit(docs, table(spark, DATA, "labels"))
    expected = [
        lambda d: toxicity.clean(d, model).count(),
        lambda d: line_dedup.clean(d).count(),
        lambda d: near_dedup.link(d).where("kept").count(),
        lambda d: d.count() - decontaminate.search(d.where("doc_id is not null"), table(spark, DATA, "benchmark")).select("doc_id").distinct().count(),
    ]
    for (_, stage), count in zip(corpus_pipeline.STAGES, expected):
        out = stage(spark, docs, DATA)
        assert out.columns == docs.columns and out.count() == count(docs)
        docs = out
    assert corpus_pipeline.STAGES[-1][1](spark, docs, DATA).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()


def test_rows_that_share_an_id_keep_their_own_lines(spark):
    said = ["a line that many rows repeat", *(f"words of row {k} alone, number {k}{k}{k}" for k in "pqrstuv")]
    rows = [(i, f"{said[0]}\n{said[1 + n]}") for n, i in enumerate([1, 2, 2, 2, None, None])] + [(3, said[0]), (3, said[7]), (None, None)]
    cleaned = line_dedup.clean(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    # Rows without an id come first: one of them keeps the line; all keep what they alone say.
    assert sum(said[0] in (r.text or "") for r in cleaned) == 1
    lone = collections.Counter((r.doc_id, (r.text or "").split("\n")[-1]) for r in cleaned)
    ids = [1, 2, 2, 2, None, None, 3]
    assert lone == collections.Counter([*zip(ids, said[1:]), (None, "")])
    marked = line_dedup.classes(spark.createDataFrame(rows, "doc_id long, text string"))
    assert marked.columns == ["doc_id", "line_no", "class_key", "class_line_no", "n_links", "kept"] and marked.where("kept").count() == 8


def test_rows_that_share_an_id_are_near_copies_one_by_one(spark):
    texts = [" ".join(f"{c}{i}" for i in range(60)) for c in "abcd"]
    near = [t + " end" for t in texts]
    rows = [(1, texts[0]), (2, near[0]), (2, texts[1]), (None, near[1]), (None, texts[2]), (None, near[2]), (None, texts[3]), (None, texts[3]), (5, texts[3] + " x")]
    rows += [(None, None), (None, None), (None, " "), (6, near[0]), (6, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    out = corpus_pipeline.drop_near_copies(spark, docs, DATA)
    got = collections.Counter((r.doc_id, r.text) for r in out.collect())
    alone = [(i, t) for i, t in got.elements() if i is None and t in (texts[2], near[2])]
    assert len(alone) == 1 and out.columns == docs.columns
    assert got - collections.Counter(alone) == collections.Counter([(1, texts[0]), (2, texts[1]), (5, texts[3] + " x"), (None, None), (None, None), (None, " "), (6, None)])


def test_pipeline_takes_an_empty_table(spark):
    docs = table(spark, DATA, "documents").where("false")
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DATA)
    assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_registered_query(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    rows = [tuple(r) for r in df.collect()]
    assert rows
    if name not in queries.ORACLE:
        return
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{os.path.join(DATA, t)}.parquet'")
    cur = con.execute(queries.ORACLE[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    order = [df.columns.index(c) for c in cols]
    assert sorted((tuple(r[i] for i in order) for r in rows), key=str) == sorted(cur.fetchall(), key=str)


def test_sampling_holds_a_bounded_part_of_a_batch(pieces):
    """Executors of the pipeline keep what a task has taken; texts of a batch are worked on a part at a time."""
    rnd = np.random.default_rng(5)
    texts = [" ".join(format(i, "x") for i in rnd.integers(0, 1 << 24, 300).tolist()) for _ in range(600)]
    tracemalloc.start()
    try:
        n = sum(1 for _ in piece_sampling.sample_texts(list(range(len(texts))), texts, pieces, 2, 7))
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert n == 2 * len(texts)
    assert peak < 120e6, peak
