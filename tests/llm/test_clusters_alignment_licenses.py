"""Centroid clustering, token alignment and license scans against brute force, with odd rows."""

import collections
import hashlib
import itertools
import math
import random
import re
from re import _parser as sre

import numpy as np
import pytest

from shoalmark.llm import centroids, license_scan, queries, token_alignment
from shoalmark.llm import license_rules as lr

# ---- centroid clustering ----


def brute_clusters(rows, k, rounds, dims, scale=256, seed=2):
    kept = [
        (key, [math.floor(scale * x) for x in v])
        for key, v in rows
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v)
    ]
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    cs = [v for _, v in first[:k]]
    far = lambda v, c: sum((x - y) ** 2 for x, y in zip(v, c, strict=True))
    for step in range(rounds + 1):
        at = [min(range(len(cs)), key=lambda c: (far(v, cs[c]), c)) for _, v in kept]
        if step < rounds:
            groups = collections.defaultdict(list)
            for c, (_, v) in zip(at, kept, strict=True):
                groups[c].append(v)
            cs = [[sum(x) // len(groups[c]) for x in zip(*groups[c], strict=True)] if groups[c] else old for c, old in enumerate(cs)]
    ds = [far(v, cs[c]) for c, (_, v) in zip(at, kept, strict=True)]
    per = collections.Counter()
    for c, d in zip(at, ds, strict=True):
        per[c] += d
    return sorted(
        ((key, c, d, per[c], sum(ds), tuple(cs[c])) for (key, _), c, d in zip(kept, at, ds, strict=True)),
        key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]),
    )


def clusters(spark, rows, **given):
    df = spark.createDataFrame([(k, v, 1, "x") for k, v in rows], "vec_id long, embedding array<float>, cluster int, _key string")
    out = centroids.cluster(df, **given)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"]
    return sorted(
        ((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, tuple(r.centroid)) for r in out.collect()),
        key=lambda r: (r[0] is not None, r[0] or 0, *r[1:]),
    )


def f32(x):
    import struct

    return struct.unpack("f", struct.pack("f", x))[0]


@pytest.mark.parametrize(("n", "k"), [(300, 7), (3, 7), (1, 1)])
def test_clusters_against_brute_force(spark, n, k):
    rnd = random.Random(n)
    rows = [(i, [f32(rnd.gauss(i % 3, 0.2)) for _ in range(4)]) for i in range(n)]
    rows += [(None, rows[0][1]), rows[0], (900, None), (901, []), (902, [1.0] * 3), (903, [1.0, None, 1.0, 1.0])]
    rows += [(904, [float("nan"), 0.0, 0.0, 0.0]), (905, [0.0, float("-inf"), 0.0, 0.0]), (906, [0.5] * 4), (907, [0.5] * 4)]
    assert clusters(spark, rows, k=k, rounds=3, dims=4) == brute_clusters(rows, k, 3, 4)


def test_many_values_of_a_dimension_and_wide_ones(spark):
    rnd = random.Random(1)
    rows = [(i, [f32(rnd.uniform(-4000, 4000)), f32(i / 1000)]) for i in range(700)]
    assert clusters(spark, rows, k=5, rounds=2, dims=2) == brute_clusters(rows, 5, 2, 2)


def test_clusters_of_nothing_and_of_components_out_of_reach(spark):
    assert clusters(spark, [], k=3, dims=2) == [] and clusters(spark, [(1, None)], k=3, dims=2) == []
    with pytest.raises(Exception, match="after scaling"):
        clusters(spark, [(1, [1e30, 0.0])], k=3, dims=2)


# ---- token alignment ----


@pytest.fixture(scope="module")
def tokenizers():
    with open(queries.tokenizer_file("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    return definition, queries.piece_model()


def brute_alignment(text, a, b):
    """Groups of one text: both encoded whole, cut where both end."""
    sides = []
    for encode, entries in (a, b):
        ids = encode([text or ""])[0]
        sides.append((ids, [entries[i] for i in ids]))
    if not text or any(b"".join(raw) != b" " + text.encode() for _, raw in sides):
        return []
    ends = [list(itertools.accumulate(map(len, raw))) for _, raw in sides]
    groups, at = [], [0, 0]
    for cut in sorted(set(ends[0]) & set(ends[1])):
        group = []
        for s in (0, 1):
            to = ends[s].index(cut) + 1
            group.append(sides[s][0][at[s] : to])
            at[s] = to
        groups.append(group)
    return groups


ALIGNED = [
    None, "", " ", "  ", " a", "x  y", "x ", "a\n b\n\n  c", "▁x y", "plain ▁ mark", "y" * 3000, "\x1c \x1d e", "é 漢字 \U0001f600 z", "漢字" * 40,
    "<|endoftext|> a <s> b", "a\x00b c", "ſ K ½ ﬁ", "a 　b", "'s it's", "a \tb", "\ta  \n b", "a​b ​c ﻿d", "the cat sat on the mat",
    "the cat sat on the mat", "Internationalization of tokenizers, 12345.678", "x=1;y=2 // z", "=" * 500,
]


def test_alignment_against_brute_force(spark, tokenizers):
    speller = token_alignment.Speller(*tokenizers)
    texts = ALIGNED + [" ".join(random.Random(i).choice(["the", "tokenizer", "Zürich", "x-ray", "..."]) for _ in range(50)) for i in range(20)]
    rows = [(i, t, "clash", 7) for i, t in enumerate(texts)] + [(None, "no key", None, None), (3, "  ", "clash", 7)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, block string, n_a int").repartition(3)
    out = token_alignment.align(docs, *tokenizers, with_groups=True).collect()
    groups = [brute_alignment(t, *speller.sides) for _, t, _, _ in rows]
    pairs = [collections.Counter((x, y) for g in gs for x in g[0] for y in g[1]) for gs in groups]
    held = collections.Counter(p for c in pairs for p in c)
    best = collections.defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    want = []
    for (key, *_), gs, c in zip(rows, groups, pairs, strict=True):
        form = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in gs)
        n_best = sum(n for p, n in c.items() if held[p] == best[p[0]])
        figures = (sum(len(x) for x, _ in gs), sum(len(y) for _, y in gs), len(gs), sum(c.values()), n_best, sum(n * held[p] for p, n in c.items()))
        want.append((key, *figures, hashlib.sha256(form.encode()).hexdigest() if form else "", form))
    got = [(r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.groups) for r in out]
    order = lambda r: (r[0] is not None, r[0] or 0, r[-1])
    assert sorted(got, key=order) == sorted(want, key=order)


def test_alignment_of_nothing(spark, tokenizers):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert token_alignment.align(none, *tokenizers).count() == 0
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert {tuple(r) for r in token_alignment.align(empty, *tokenizers).collect()} == {(k, 0, 0, 0, 0, 0, 0, "") for k in (1, 2)}


def test_groups_of_intervals():
    import numpy as np

    starts, ends = np.array([0, 2, 4, 0, 3, 4]), np.array([2, 4, 6, 3, 4, 6])
    assert token_alignment.coalesce(starts, ends).tolist() == [0, 0, 1, 0, 0, 1]


# ---- license scans ----


def brute_scan(text, rules):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    placed = " " + " ".join(f"{w}#{i}" for i, w in enumerate(words))
    phrases = {label: p.split() for p, label in lr.BASE.items()}
    base = [(i, label) for i in range(len(words)) for label, p in phrases.items() if words[i : i + len(p)] == p]
    hits = []
    for r in rules:
        for m in re.finditer(r.pattern, placed, re.ASCII):
            places = [int(x) for x in re.findall(r"#(\d+)", m[0])]
            hits.append((places[0], places[-1], r.priority, r.number, r.label))
    inside = lambda h, o: o[0] <= h[0] and h[1] <= o[1] and (o[2] < h[2] or o[2] == h[2] and (o[:2] != h[:2] or o[3] < h[3]))
    kept = sorted(h for h in hits if not any(inside(h, o) for o in hits))
    labels = sorted({label for _, label in base} | {h[4] for h in kept})
    score = max([0.0, *[lr.WEIGHT[h[2]] for h in kept], *[lr.BASE_WEIGHT for _ in base]])
    return (
        len(words), len(base), min((i for i, _ in base), default=None), max((i for i, _ in base), default=None),
        ",".join(sorted({label for _, label in base})), ",".join(labels), score, sorted((h[4], h[0], h[1], h[2]) for h in kept),
    )


def scanned(spark, texts, rules=None):
    df = spark.createDataFrame([(i, t, "clash", 1) for i, t in enumerate(texts)], "doc_id long, text string, labels string, _found int")
    out = license_scan.scan(df, rules=rules)
    assert out.columns.count("labels") == 1 and "_found" in out.columns
    found = {}
    for r in out.collect():
        spans = sorted((d.label, d["first"], d["last"], d.priority) for d in r.detections)
        found[r.doc_id] = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score, spans)
    return [found[i] for i in range(len(texts))]


def samples(signature, rnd):
    """Strings that a signature matches, each choice taken at random."""

    def one(tree):
        out = ""
        for op, arg in tree:
            name = str(op)
            if name == "LITERAL":
                out += chr(arg)
            elif name == "IN":
                pick = arg[0] if str(arg[0][0]) != "NEGATE" else ("LITERAL", ord("w"))
                out += chr(pick[1] if str(pick[0]) == "LITERAL" else rnd.randint(*pick[1]))
            elif name == "BRANCH":
                out += one(rnd.choice(arg[1]))
            elif name == "SUBPATTERN":
                out += one(arg[3])
            elif name == "MAX_REPEAT":
                lo, hi, body = arg
                out += "".join(one(body) for _ in range(rnd.randint(lo, min(int(hi), lo + 2))))
            else:
                raise AssertionError(name)
        return out

    tree = sre.parse(signature)
    return {one(tree) for _ in range(12)}


def test_texts_are_cut_where_the_pattern_cuts(tokenizers):
    speller = token_alignment.Speller(*tokenizers)
    assert speller.cuttable
    odd = ["a b", " a b", "a b ", "a  b c", "a \n b c", "a\n b", "a \tb c", "a \u3000b c", "a\u3000 b", "a \u200bb c", "a \ufeffb", " ", "a", "a \xa0b c"]
    for text in odd:
        assert speller.units(text) == token_alignment.CUT.split(text), text


def test_distinct_keys_are_sorted_once():
    for keys in ([], [0], [5, 0, 5, 2**62, 0, 7, 7]):
        got = token_alignment._distinct(np.array(keys, np.int64))
        assert got.tolist() == sorted(set(keys))


def test_every_signature_is_found_through_its_keywords(spark):
    rnd, rules = random.Random(5), lr.rules()
    assert len(rules) >= 300 and len({r.signature for r in rules}) == len(rules)
    made = [(r, s) for r in rules for s in samples(r.signature, rnd)]
    missed = [(r.label, s) for r, s in made if not set(s.split()) & set(r.keywords)]
    assert not missed, missed[:5]
    picked = rnd.sample(made, 250)
    signs = [", ", " - ", ".\n", "  "]
    texts = [f"Intro {rnd.choice(signs).join(s.upper().split())}; {t[1]} end" for (_, s), t in zip(picked, rnd.sample(made, 250), strict=True)]
    assert scanned(spark, texts) == [brute_scan(t, rules) for t in texts]


def test_scans_of_odd_texts(spark):
    texts = [
        None, "", " .,\n", "cc by", "CC-BY", "cc\x7fby", "ccéby", "éclair cc by", "cc by cc  by\ncc", "all rights reserved", "all RIGHTS\n\treserved.",
        "general public license general public license", "\U0001f600 cc by \U0001f600", "İcc by Kcc by", "y" * 100_000, "all rights reserved " * 1500,
        "Licensed under the MIT License. " * 700, "the MIT License v2 " * 40 + "SPDX-License-Identifier: GPL-2.0-only", "mit license 2 apache license v2.0",
        "licensed under the terms of the gnu lesser general public license version 2.1 or later", "in no event shall we be liable " * 60,
    ]
    assert scanned(spark, texts) == [brute_scan(t, lr.rules()) for t in texts]


def test_stronger_detections_stay_inside_weaker_ones(spark):
    rules = [lr.Rule(0, 2, "long", ("b",), "a b c d"), lr.Rule(1, 0, "strong", ("b",), "b c"), lr.Rule(2, 2, "same", ("c",), "b c d"), lr.Rule(3, 2, "tie", ("a",), "a b c d")]
    (row,) = scanned(spark, ["a b c d"], rules)
    assert row[5] == "long,strong" and row == brute_scan("a b c d", rules)


def test_scan_of_nothing(spark):
    assert license_scan.scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0
