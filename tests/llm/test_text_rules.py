"""Line cleaning, chat windows, shards, token counts: odd rows, brute force, round trips."""

import collections
import hashlib
import re
import zlib

import pytest
from pyspark.sql import functions as F

from shoalmark.llm import chat_format, quality_rules, queries, sharding, token_counts
from shoalmark.llm.common import tokens

TEXTS = [
    None, "", " \n\t ", "one", "a b c a b c", "The cat sat.\nThe cat sat.\nMenu\nhome | news | sport | more",
    "word " * 70 + ".", "x\n" * 5000, "é ü 漢字 \U0001f600 end.", "##!! ##!! ##!!", "y" * 200_000,
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "clash", 1) for i, t in enumerate(TEXTS)] + [(3, "one", "clash", 1), (None, "no key.", None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, n_tokens int")


def windows_twice(words):
    seen = collections.Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    return len({i + k for i in range(len(words) - 2) if seen[tuple(words[i : i + 3])] > 1 for k in range(3)})


def test_quality_figures_by_hand(spark, odd):
    out = quality_rules.clean(odd)
    rows = out.collect()
    assert len(rows) == len(TEXTS) + 2 and out.columns.count("kept") == 1
    for r in rows:
        if r.doc_id is None:
            continue
        text = TEXTS[r.doc_id] or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars) == (len(words), sum(map(len, words)))
        assert r.n_symbols == len(re.findall(r"[#*$%&|<>]", text))
        assert (r.n_dup_lines, r.n_repeat_words) == (len(lines) - len(set(lines)), windows_twice(words))
        assert r.base_failed == (len(words) < 50 or 100 * r.n_repeat_words > 50 * len(words))
        assert not (r.kept and r.base_failed)


def test_lines_are_judged_by_themselves(spark):
    prose = " ".join(f"w{i}" for i in range(60)) + "."
    text = "\n".join([prose, "Log in", "a | b | c | d", "no end", "All rights reserved.", "hey!! you!! there!!", 'He said "no."'])
    row = quality_rules.clean(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert row.clean_text.split("\n") == [prose, 'He said "no."'] and row.n_lines_removed == 5 and row.kept


def test_words_are_split_at_ascii_white_space_only(spark):
    row = spark.createDataFrame([("a b\x0bc\x1fd  e",)], "t string").select(tokens(F.col("t"))).first()
    assert row[0] == ["a b", "c\x1fd", "e"]


@pytest.mark.parametrize("name", ["quality", "chat", "shards", "tokens"])
def test_empty_tables(spark, name):
    docs = spark.createDataFrame([], "doc_id long, text string")
    if name == "quality":
        assert quality_rules.clean(docs).count() == 0
    elif name == "chat":
        none = spark.createDataFrame([], "conv_id long, turn int, role string, text string")
        assert chat_format.read_back(chat_format.windows(none)).count() == 0
    elif name == "shards":
        assert sharding.assign(docs).count() == 0
    else:
        assert token_counts.count(docs, token_counts.empty_cache(spark), definition()).count() == 0


def definition():
    with open(queries.tokenizer_file("byte_bpe_50k.json"), encoding="utf-8") as f:
        return f.read()


CHATS = [
    (1, 0, "system", "be <|kind|> \\ \\\\"), (1, 1, "user", "hi </s>"), (1, 2, "assistant", "[INST] <<SYS>> ok [/INST]"),
    (1, 3, "user", "u " * 300), (1, 4, "assistant", "long " * 400), (1, 5, "assistant", ""), (2, 0, "user", None), (2, 0, "user", None),
    (3, 0, "system", "alone"), (4, None, None, "x"), (4, 7, "assistant", "é漢\U0001f600"), (None, 0, "user", "q"), (None, 1, "assistant", "a"),
    (5, 0, "assistant", "z" * 20_000), *[(6, i, ("user", "assistant")[i % 2], f"turn {i} " * (i % 9)) for i in range(1200)],
]


def test_chat_reads_back_what_went_in(spark):
    chats = spark.createDataFrame([(*c, "extra") for c in CHATS], "conv_id long, turn int, role string, text string, loss string")
    formatted = chat_format.windows(chats, budget=200, history=40)
    for r in chat_format.read_back(formatted).collect():
        mine = [(t is not None, t or 0, role or "", text or "") for c, t, role, text in CHATS if c == r.conv_id]
        turns = [(role, text) for _, _, role, text in sorted(mine)]
        learned = "".join(text for role, text in turns if role == "assistant")
        assert r.n_turns == len(turns)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        assert (r.loss_chars, r.loss_sha256) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())


def test_chat_windows_keep_the_budget_the_system_turn_and_some_history(spark):
    rows = [(1, 0, "system", "s" * 40)] + [(1, i, ("assistant", "user")[i % 2], "t" * (10 + i % 50)) for i in range(1, 200)]
    made = chat_format.windows(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), budget=120, history=30)
    made = made.orderBy("window").collect()
    assert len(made) > 20 and all(w.n_tokens <= 120 for w in made)
    assert all(w.text.startswith("<|turn|>system") for w in made)
    assert made[0].n_repeated == 0 and all(w.n_repeated >= 1 for w in made[1:]) and any(w.n_repeated > 1 for w in made[1:])


def test_escape_is_reversible(spark):
    texts = ["<|", "<\\|", "\\", "</s><s>", "<<SYS>>x<</SYS>>", "[[INST]", "\\<|\\", "a\nb"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, e, u in df.select("t", chat_format.escape(F.col("t")).alias("e"), chat_format.unescape(chat_format.escape(F.col("t"))).alias("u")).collect():
        assert u == t and not re.search(r"<\||</?s>|\[/?INST\]|<<", e.replace("<\\<", ""))


def clockwise(keys, shards, nodes, most):
    """One key after the other within a round: arcs in order, keys of an arc by place."""
    ring = sharding.ring(shards, nodes)
    arcs = collections.defaultdict(list)
    for k in keys:
        place = int(hashlib.md5(str(k).encode()).hexdigest()[:15], 16)
        arcs[sum(p < place for p, _ in ring) % len(ring)].append((place, k))
    left = {a: [k for _, k in sorted(v)] for a, v in arcs.items()}
    out, used = {}, [0] * shards
    for step in range(shards):
        for arc in sorted(left):
            shard = list(dict.fromkeys(ring[(arc + i) % len(ring)][1] for i in range(len(ring))))[step]
            while left[arc] and used[shard] < most[shard]:
                out[left[arc].pop(0)] = (shard, used[shard])
                used[shard] += 1
    return out


@pytest.mark.parametrize("slack", [0.0, 0.25])
def test_ring_against_keys_one_by_one(spark, slack):
    docs = spark.createDataFrame([(i * 37, f"t{i}") for i in range(500)], "doc_id long, text string")
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.assign(docs, shards=7, nodes=16, slack=slack).collect()}
    assert got == clockwise([i * 37 for i in range(500)], 7, 16, sharding.bounds(500, 7, slack))


def test_shards_with_missing_and_repeated_rows(spark, odd):
    more = odd.unionByName(spark.range(20_000).selectExpr("5L AS doc_id", "'same' AS text", "'' AS kept", "0 AS n_tokens"))
    rows = sharding.assign(more, shards=24).collect()
    per = collections.defaultdict(list)
    for r in rows:
        per[r.shard].append(r.slot)
    assert len(rows) == more.count() and max(map(len, per.values())) - min(map(len, per.values())) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in per.values())
    sizes = {(r.doc_id, r.size, r.text_crc32) for r in rows}
    assert (0, 8, 0) in sizes and (8, 8 + len(TEXTS[8].encode()), zlib.crc32(TEXTS[8].encode())) in sizes


def test_with_slack_a_new_shard_moves_few_rows(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "'' AS text")
    before, after = ({r.doc_id: r.shard for r in sharding.assign(docs, shards=n, slack=0.5).collect()} for n in (10, 11))
    assert sum(before[k] != after[k] for k in before) < 0.3 * len(before)


def test_token_counts_are_the_librarys_and_misses_are_encoded_once(spark, odd):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_str(definition())
    extra = ["<|endoftext|>", "a <|endoftext|> b", "a   b\n\n c\t d", " x", "x ", "it's  I'll", "a b   c", "\x1c \x1d e", "  \n  z"]
    docs = odd.unionByName(spark.createDataFrame([(100 + i, t, "", 0) for i, t in enumerate(extra)], odd.schema))
    cache = token_counts.empty_cache(spark)
    rows = token_counts.count(docs, cache, definition(), limit=3).collect()
    texts = dict(enumerate(TEXTS)) | {100 + i: t for i, t in enumerate(extra)} | {None: "no key."}
    assert len(rows) == docs.count()
    for r in rows:
        text = texts[r.doc_id] or ""
        assert r.n_tokens == len(whole.encode(text, add_special_tokens=False).ids), text[:40]
        assert r.n_bytes == len(text.encode()) and r.over_limit == (r.n_tokens > 3)
    stored = spark.read.parquet(cache)
    assert stored.count() == stored.select("content").distinct().count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    token_counts.count(docs, cache, definition()).collect()
    assert spark.read.parquet(cache).count() == stored.count()
