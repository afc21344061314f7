"""Pairs, leaks, neighbours, archives: against brute force, with odd rows."""

import collections
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shoalmark.llm import decontaminate, graph, line_dedup, near_dedup, toxicity, warc
from shoalmark.llm import shingles as sh


def groups(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    least = {}
    for n in nodes:
        least[find(n)] = min(least.get(find(n), n), n)
    return {n: least[find(n)] for n in nodes}


def test_components(spark):
    rnd = random.Random(1)
    edges = [(rnd.randrange(400), rnd.randrange(400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(40)] + [(7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = groups({n for e in edges for n in e}, edges)
    assert all(got.get(n, n) == want[n] for n in want)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def copies(seed, n):
    """Texts with groups of copies that share more or less of their words."""
    rnd = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    out = []
    for _ in range(n):
        base = rnd.choices(vocabulary, k=rnd.randint(3, 120))
        for _ in range(rnd.choice([1, 1, 2, 6])):
            words = list(base)
            for _ in range(rnd.randint(0, 3)):
                words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
            out.append(" ".join(words))
    return out


def test_near_copies_against_all_pairs(spark):
    texts = copies(3, 60) + [None, "", "  ", "one two", "ONE two", "one two three"]
    docs = spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)] + [(4, texts[4], 0)], "doc_id long, text string, node int")
    got = collections.defaultdict(list)
    for r in near_dedup.link(docs).collect():
        got[r.doc_id].append((r.n_shingles, r.component_id, r.kept))
    sets = [decontaminate.exact(sh.words((t or "").encode()), 5) for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = groups(range(len(texts)), links)
    assert len(got[4]) == 2
    assert {i: v[0] for i, v in got.items()} == {i: (len(sets[i]), want[i], want[i] == i) for i in want}


def test_near_copies_without_keys_or_rows(spark):
    docs = spark.createDataFrame([(None, "a b c d e f"), (3, "a b c d e f"), (None, "x y"), (5, "")], "doc_id long, text string")
    got = sorted(near_dedup.link(docs).collect(), key=str)
    assert [(r.component_id, r.kept) for r in got if r.n_shingles == 2] in ([(3, True), (3, False)], [(3, False), (3, True)])
    assert [(r.component_id, r.kept) for r in got if r.n_shingles != 2 and r.doc_id is None] == [(None, True)]
    assert near_dedup.link(docs.where("false")).count() == 0


def test_sketches_merge_and_estimate():
    rnd = np.random.default_rng(2)
    pool = rnd.integers(0, 2**63, 3000).astype(np.uint64)
    a, b = np.sort(pool[:2000]), np.sort(pool[500:2500])
    ra, rb, both = near_dedup.sketch([a, b, np.unique(np.concatenate((a, b)))])
    assert (np.maximum(ra, rb) == both).all()
    j = near_dedup.likeliest(ra[None], rb[None], np.array([2000.0]), np.array([2000.0]))[0]
    assert abs(j - 0.6) < 0.15


def test_parity_bounds_what_two_sets_share():
    rnd = np.random.default_rng(5)
    sets, pairs = [], []
    for n in (1, 3, 40, 300, 5000, 40_000):
        for changed in (0, 1, n // 12, n // 6, n):
            base = rnd.integers(0, 2**63, n).astype(np.uint64)
            other = np.concatenate((base[: max(0, n - changed)], rnd.integers(0, 2**63, changed + n // 5).astype(np.uint64)))
            pairs.append((len(sets), len(sets) + 1))
            sets += [base, other]
    parities = [near_dedup.parity(s) for s in sets]
    x, y = np.array(pairs).T
    got = near_dedup.differing(parities, x, y)
    real = np.array([len(np.setxor1d(sets[i], sets[j])) for i, j in pairs])
    assert (got <= real).all() and (got[real == 0] == 0).all()
    # As near to it as the threshold needs: similar sizes, and not so many shingles that every place is taken.
    near = np.array([20 < len(sets[i]) <= 5000 for i in x]) & (real < 0.25 * np.array([len(sets[i]) + len(sets[j]) for i, j in pairs]))
    assert near.sum() >= 6 and (got[near] >= 0.85 * real[near]).all()


def test_group_of_nearly_similar_texts(spark):
    """Many texts just below the threshold to a group of copies, a few just above it."""
    rnd = random.Random(8)
    base, texts = [f"w{i}" for i in range(200)], []
    for k in range(240):
        words = list(base)
        for at in rnd.sample(range(0, 200, 5), rnd.choice([0, 1, 2, 3, 5, 6, 7, 8, 9])):
            words[at] = f"x{k}y{at}"
        texts.append(" ".join(words))
    got = {r.doc_id: r.component_id for r in near_dedup.link(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    sets = [decontaminate.exact(sh.words(t.encode()), 5) for t in texts]
    links = [(i, j) for i in range(240) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    want = groups(range(240), links)
    assert 1 < len(set(want.values())) and got == want


def test_texts_are_shuffled_once(spark, monkeypatch, tmp_path):
    """However many sets of pairs are verified, the texts of all rows are read to be sketched, and to be held."""
    spark.createDataFrame(list(enumerate(copies(5, 80))), "doc_id long, text string").write.parquet(str(tmp_path / "docs"))
    read, calls, land, links = [], [], near_dedup.land, near_dedup._Corpus.links

    def counted(df):
        read.append(any("/docs/" in f for f in df.inputFiles()))
        return land(df)

    monkeypatch.setattr(near_dedup, "land", counted)
    monkeypatch.setattr(near_dedup._Corpus, "links", lambda self, pairs: calls.append(1) or links(self, pairs))
    monkeypatch.setattr(near_dedup, "_left_over", lambda corpus, crowded, roots, best: near_dedup._with_pivots(crowded, 75))
    monkeypatch.setattr(near_dedup._Corpus, "likely", lambda self, pairs: pairs.limit(2))
    near_dedup.link(spark.read.parquet(str(tmp_path / "docs")))
    assert len(calls) == 2 and sum(read) == 2


def test_leaks_against_all_shingles(spark):
    rnd = random.Random(4)
    vocabulary = [f"v{i}" for i in range(2000)]
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.choice([5, 9, 20, 45, 130])))) for i in range(40)]
    items += [(90, None), (91, ""), (92, "two words"), (7, items[7][1]), (None, items[3][1])]
    docs = [(100, None), (101, ""), (102, "Two WORDS"), (103, "two words more")]
    for i in range(60):
        words = rnd.choices(vocabulary, k=rnd.randint(0, 2000))
        part = items[rnd.randrange(40)][1].split()
        at, cut = rnd.randint(0, len(words)), rnd.choice([len(part), max(5, len(part) * 8 // 10), len(part) // 2])
        docs.append((i, " ".join(words[:at] + part[:cut] + words[at:]).upper()))
    d = spark.createDataFrame([(*x, "c") for x in docs], "doc_id long, text string, n_item string")
    t = spark.createDataFrame(items, "item_id long, text string")
    want = collections.Counter()
    for i, x in docs:
        have = decontaminate.exact(sh.words((x or "").encode()), 5)
        for k, y in items:
            need = decontaminate.exact(sh.words((y or "").encode()), 5)
            if need and 100 * len(need & have) >= 75 * len(need):
                want[i, k, len(need), len(need & have)] += 1
    assert collections.Counter(tuple(r)[:4] for r in decontaminate.search(d, t).collect()) == want and len(want) > 30
    kept = decontaminate.clean(d, t)
    assert kept.columns == d.columns and {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {w[0] for w in want}
    assert decontaminate.search(d, t.where("false")).count() == 0 and decontaminate.search(d.where("false"), t).count() == 0


def test_short_items_are_not_missed(spark, monkeypatch):
    """Items of few shingles inside long documents, most of them under one text, in many blocks."""
    rnd = random.Random(21)
    vocabulary = [f"v{i}" for i in range(4000)]
    shared = " ".join(rnd.choices(vocabulary, k=6))
    items = [(i, " ".join(rnd.choices(vocabulary, k=rnd.choice([5, 6, 7, 8])))) for i in range(300)]
    items += [(1000 + i, shared) for i in range(200)] + [(1000, shared), (None, shared)]
    docs = [(-1, " ".join(rnd.choices(vocabulary, k=50) + shared.split()))]
    for i, part in items[:300]:
        words = rnd.choices(vocabulary, k=300)
        docs.append((i, " ".join(words[:140] + part.split() + words[140:])))
    monkeypatch.setattr(decontaminate, "ITEM_BYTES", 4000)
    d, t = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    blocks = list(decontaminate._item_blocks(t, "item_id", "text"))
    assert len(blocks) > 3 and all(sum(len(x) for _, x in b) < 3 * 4000 for b in blocks)
    got = collections.Counter((r.doc_id, r.item_id) for r in decontaminate.search(d, t).collect())
    want = collections.Counter({(i, i): 1 for i in range(300)})
    want.update((-1, i) for i, x in items if x == shared)
    assert got == want and want[-1, 1000] == 2
    assert decontaminate.clean(d, t).isEmpty()


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rnd, x, n):
    for _ in range(n):
        i, kind = rnd.randrange(len(x) + 1), rnd.randrange(3)
        x = x[:i] + (rnd.choice("abé") if kind < 2 else "") + x[i + (kind > 0) :]
    return x


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_band_distance(spark, edits):
    rnd = random.Random(edits)
    rows = []
    for _ in range(400):
        a = "".join(rnd.choice("abé") for _ in range(rnd.randint(edits + 1, 24)))
        rows.append((a, edited(rnd, a, rnd.randint(0, 6))))
    df = spark.createDataFrame(rows, "x string, y string")
    for x, y, d in df.select("x", "y", line_dedup.band_distance(df.x, df.y, edits)).collect():
        true = edit_distance(x, y)
        assert d == true if true <= edits else d > edits


def test_lines_against_all_pairs(spark):
    rnd = random.Random(6)
    base = ["".join(rnd.choice("abcdefgh ") for _ in range(rnd.randint(12, 40))) for _ in range(30)]
    lines = base + [edited(rnd, rnd.choice(base), rnd.randint(1, 3)) for _ in range(90)] + ["Of.", "On."]
    rows = [(i, "\n".join(rnd.sample(lines, 4) + ["", "Of."]), i) for i in range(60)] + [(70, None, 0), (71, "", 0), (72, " \n", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, root long")
    got = {(r.doc_id, r.line_no): (r.class_key, r.class_line_no, r.n_links, r.kept) for r in line_dedup.classes(docs, min_chars=10).collect()}
    at = [(d, i, x) for d, t, _ in rows for i, x in enumerate((t or "").split("\n")) if x.strip()]
    different = sorted({x for _, _, x in at})
    links = [(a, b) for i, a in enumerate(different) for b in different[i + 1 :] if min(len(a), len(b)) >= 10 and edit_distance(a, b) <= 2]
    degree = collections.Counter(x for link in links for x in link)
    group, first = groups(different, links), {}
    for d, i, x in at:
        first[group[x]] = min(first.get(group[x], (d, i)), (d, i))
    assert got == {(d, i): (*first[group[x]], degree[x], (d, i) == first[group[x]]) for d, i, x in at}
    cleaned = {r.doc_id: r for r in line_dedup.clean(docs, min_chars=10).collect()}
    for d, t, _ in rows:
        gone = {i for k, i in got if k == d and not got[k, i][3]}
        left = "\n".join(x for i, x in enumerate((t or "").split("\n")) if i not in gone)
        if gone and not left.strip():
            assert d not in cleaned
        else:
            assert cleaned[d].text == (t if not gone else left) and cleaned[d].root == dict((x[0], x[2]) for x in rows)[d]
    assert line_dedup.clean(docs.where("false")).count() == 0


def test_long_lines_against_all_pairs(spark):
    """With the parameters of the query: lines that differ by some words, on both sides of what is allowed."""
    rnd = random.Random(11)

    def reworded(x, n):
        words = x.split(" ")
        for _ in range(n):
            i, kind = rnd.randrange(len(words)), rnd.randrange(3)
            words[i : i + (kind > 0)] = ["".join(rnd.choices("klmno", k=7))] if kind < 2 else []
        return " ".join(words)

    def allowed(n):
        return max((e for least, e in line_dedup.WORD_EDITS if n >= least), default=-1)

    lines = []
    for n in (15, 16, 20, 24, 30, 47, 48, 50, 79, 80, 100, 128, 140, 256, 270, 512):
        for _ in range(2):
            x = " ".join("".join(rnd.choices("abcdefgh", k=rnd.randint(2, 8))) for _ in range(n))
            e = max(allowed(n), 1)
            lines += [x, reworded(x, 1), reworded(x, e - 1), reworded(x, e), reworded(x, e), reworded(x, e + 2), edited(rnd, x, 2)]
    assert line_dedup.WORD_EDITS[-1] == (512, 15)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id: (r.class_key, r.n_links, r.kept) for r in line_dedup.classes(docs, edits=2, min_chars=24).collect()}
    links = set()
    for i, x in enumerate(lines):
        # Lines of different origin have no word order in common.
        for j in range(i + 1, len(lines)):
            a, b = x.split(), lines[j].split()
            e = allowed(min(len(a), len(b)))
            if x == lines[j] or i // 7 != j // 7:
                continue
            if edit_distance(a, b) <= e or abs(len(x) - len(lines[j])) <= 2 and edit_distance(x, lines[j]) <= 2:
                links.add((x, lines[j]))
    different = sorted(set(lines))
    degree = collections.Counter(x for link in {tuple(sorted(k)) for k in links} for x in link)
    group, first = groups(different, links), {}
    for i, x in enumerate(lines):
        first.setdefault(group[x], i)
    assert got == {i: (first[group[x]], degree[x], first[group[x]] == i) for i, x in enumerate(lines)}
    assert sum(kept for _, _, kept in got.values()) < len(lines) / 2


def test_block_max_search_is_exact():
    rnd = np.random.default_rng(3)
    vectors = []
    for _ in range(700):
        ids = np.sort(rnd.choice(40, rnd.integers(0, 6), replace=False))
        w = rnd.random(len(ids)) + 0.1
        vectors.append((ids, w / np.linalg.norm(w) if len(w) else w))
    index = toxicity.Index(vectors, 40, 32)
    dense = np.zeros((700, 40))
    for i, (ids, w) in enumerate(vectors):
        dense[i, ids] = w
    for ids, w in vectors[:80]:
        q = np.zeros(40)
        q[ids] = w
        best = np.sort(dense @ q)[::-1][:9]
        _, score = index.nearest(ids, w, 9)
        assert np.allclose(score, best[best > 0][: len(score)]) and len(score) == (best > 0).sum()


def labelled(spark, n=600):
    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choices([f"w{k}" for k in range(400)], k=40) + (["awful", "vilething"] if i % 6 == 0 else []))) for i in range(n)]
    odd = [(9000, None), (9001, ""), (None, "awful vilething"), (3, rows[3][1])]
    docs = spark.createDataFrame([(*r, 0.5) for r in rows + odd], "doc_id long, text string, score double")
    labels = spark.createDataFrame([(i, int(i % 6 == 0)) for i, _ in rows] + [(None, 1), (5, None), (77777, 1)], "doc_id long, toxic int")
    return docs, labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels, settings=toxicity.Settings(examples=300))
    rows = toxicity.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id < 9000]
    assert len(held) > 60 and all(r.predicted == int(r.doc_id % 6 == 0) for r in held)
    assert [r.predicted for r in rows if r.doc_id is None] == [1] and [r.predicted for r in rows if r.doc_id in (9000, 9001)] == [0, 0]
    kept = toxicity.clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == sum(not r.predicted for r in rows)


def test_every_telling_term_is_learnt(spark):
    rnd = random.Random(9)
    telling = [f"{a}{b}x" for a in "abcdefghij" for b in "klmnopqrstuvwyz"]
    rows = [(i, " ".join(rnd.choices("the and of to in".split(), k=9) + (rnd.sample(telling, 12) if i % 2 else []))) for i in range(2400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    assert len(telling) == 150 and set(telling) == set(model.vocabulary.terms)
    lone = spark.createDataFrame(list(enumerate(telling)), "doc_id long, text string")
    assert {r.predicted for r in toxicity.score(lone, model).collect()} == {1}


def test_toxicity_without_labels(spark):
    docs, labels = labelled(spark, 10)
    rows = toxicity.score(docs, toxicity.fit(docs, labels.where("false"))).collect()
    assert {(r.score, r.predicted) for r in rows} == {(0.0, 0)}
    assert toxicity.score(docs.where("false"), toxicity.fit(docs.where("false"), labels)).count() == 0


PAGES = [
    (1, "http://b.a.org/x?q=1", "same"), (2, "https://B.a.org/x", "same"), (9, None, "same"), (4, "http://a.org", None), (5, "http://a.org", ""),
    (6, "not a url", "é漢\r\n\r\nWARC/1.1\r\n"), (6, "not a url", "é漢\r\n\r\nWARC/1.1\r\n"), (None, "http://n.org/", "none"), (8, "http://[bad", "z" * 300_000),
]


def test_archives_give_back_every_payload(spark):
    pages = spark.createDataFrame([(*p, "x") for p in PAGES], "page_id long, url string, html string, digest string")
    rows = warc.read(warc.write(pages, parts=3), pages, payload=True).collect()
    assert len(rows) == len(PAGES)
    largest = {}
    for i, _, html in PAGES:
        largest[html or ""] = max((x for x in (largest.get(html or ""), i) if x is not None), default=None)
    by_id = {i: (html or "") for i, _, html in PAGES}
    for r in rows:
        body = by_id[r.page_id].encode()
        assert bytes(r.payload) == body and r.payload_bytes == len(body) and r.payload_digest == warc.payload_digest(body)
        holder = largest[by_id[r.page_id]]
        assert (r.record_type, r.refers_to) == (("response", None) if r.page_id == holder else ("revisit", holder))
    with pytest.raises(Exception, match="not in the index"):
        warc.read(warc.write(pages), spark.createDataFrame([(3, "http://gone.org")], "page_id long, url string")).collect()


def test_archive_of_nothing_and_many_blocks(spark):
    none = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read(warc.write(none), none).count() == 0
    many = spark.range(1500).selectExpr("id AS page_id", "concat('http://h', id % 3, '.org/', id % 7) AS url", "cast(id % 50 AS string) AS html")
    # Parts follow the captures, so none holds much more than its share, whatever the number asked for.
    archive = warc.write(many, parts=4, captures_per_part=100)
    assert 12 <= spark.read.parquet(archive.parts).count() <= 15 and spark.read.parquet(warc.write(many, parts=4).parts).count() == 4
    rows = warc.read(archive, many).collect()
    assert sorted(r.page_id for r in rows) == list(range(1500)) and sum(r.record_type == "response" for r in rows) == 50


def test_lines_meet_by_words_with_few_keys(spark):
    """A key for each of the first runs, shuffled once for both sides, and no pair of near lines is left out."""
    rnd = random.Random(21)
    common = [f"c{i}" for i in range(40)]
    lines = []
    for n in (16, 23, 24, 47, 48, 79, 80, 127, 128, 255, 256, 512):
        e = max(e for least, e in line_dedup.WORD_EDITS if n >= least)
        for words in ([rnd.choice("abcdefgh") for _ in range(n)], ["a", "b"] * (n // 2), (common * n)[:n]):
            changed = list(words)
            for at in rnd.sample(range(n), e):
                changed[at] = rnd.choice(["x", "y y", "", changed[at] + " z"]) if e == 1 else f"x{at}"
            lines += [" ".join(words), " ".join(changed)]
    lines = sorted({" ".join(line.split()) for line in lines})
    df = spark.createDataFrame(list(enumerate(lines)), "node long, line string")
    met = line_dedup.meet_by_words(df, line_dedup.WORD_EDITS)
    got = {(r.s, r.r) for r in met.collect()}
    rows = [line.split() for line in lines]
    for i, a in enumerate(rows):
        for j in range(i + 1, len(rows)):
            b = rows[j]
            e = max((e for least, e in line_dedup.WORD_EDITS if min(len(a), len(b)) >= least), default=-1)
            if abs(len(a) - len(b)) <= e and edit_distance(a, b) <= e:
                assert (i, j) in got, (len(a), len(b), e)
    conf = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        plan = met.select("r", "s").where("true")._jdf.queryExecution().executedPlan().toString()
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert plan.count("ReusedExchange") == 1
    run = line_dedup.run_length(line_dedup.WORD_EDITS)
    assert run == 4 and line_dedup.run_length(((16, 1), (20, 9))) == 2
    with pytest.raises(ValueError):
        line_dedup.run_length(((3, 3),))


def test_dense_groups_meet_once_and_give_links_only(spark):
    """Lines of one passage: each near pair is one row, pairs that are apart are none, and rows to compare grow with the lines."""
    rnd = random.Random(31)
    passage = [f"w{i}" for i in range(60)]
    lines = set()
    while len(lines) < 70:
        words = list(passage)
        for at in rnd.sample(range(60), rnd.randint(0, 4)):
            words[at] = rnd.choice([f"x{rnd.randrange(10**6)}", "", f"{words[at]} y{rnd.randrange(10**6)}"])
        lines.add(" ".join(" ".join(words).split()))
    lines = sorted(lines)
    df = spark.createDataFrame(list(enumerate(lines)), "node long, line string")
    met = [(r.s, r.r, r.sure) for r in line_dedup.meet_by_words(df, line_dedup.WORD_EDITS).collect()]
    words = [line.split() for line in lines]
    near = {(i, j) for i in range(70) for j in range(i + 1, 70) if edit_distance(words[i], words[j]) <= 3}
    assert 0 < len(near) < 70 * 69 // 2
    assert sorted(met) == sorted((i, j, True) for i, j in near)


def test_words_of_one_letter_are_told_apart(spark, monkeypatch):
    """Where words share a letter, pairs are measured by the words themselves."""
    monkeypatch.setattr(line_dedup, "code", lambda w: F.xxhash64(w).bitwiseAND(F.lit(7)).bitwiseOR(F.lit(0xF0000000)))
    rnd = random.Random(32)
    lines = set()
    for n in (16, 30, 60, 100):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(n)]
        for changes in range(10):
            words = list(base)
            for at in rnd.sample(range(n), changes):
                words[at] = f"x{rnd.randrange(10**6)}"
            lines.add(" ".join(words))
    lines = sorted(lines)
    docs = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    got = {r.doc_id: r.n_links for r in line_dedup.classes(docs).collect()}
    words = [line.split() for line in lines]
    want = collections.Counter()
    for i, a in enumerate(words):
        for j in range(i + 1, len(lines)):
            e = max(e for least, e in line_dedup.WORD_EDITS if min(len(a), len(words[j])) >= least)
            if len(a) == len(words[j]) and edit_distance(a, words[j]) <= e:
                want.update((i, j))
    assert got == {i: want[i] for i in range(len(lines))}
    assert any(want.values()) and line_dedup.meet_by_words(docs.toDF("node", "line"), line_dedup.WORD_EDITS).where("not sure").count()


@pytest.mark.parametrize("quick", [0, 4000])
def test_letters_near(spark, monkeypatch, quick):
    """Lines of any length, by either way, with letters of several bytes."""
    monkeypatch.setattr(line_dedup, "QUICK", quick)
    rnd = random.Random(33)
    rows = []
    for _ in range(200):
        x = "".join(rnd.choice("abcdé€😀 ") for _ in range(rnd.randint(3, 40)))
        rows.append((x, edited(rnd, x, rnd.randint(0, 4))))
    df = spark.createDataFrame(rows, "x string, y string")
    for x, y, near in df.select("x", "y", line_dedup.letters_near(df.x, df.y, 2)).collect():
        assert near == (edit_distance(x, y) <= 2)
