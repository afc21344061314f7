"""Registered queries of the operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, chat_format, decontaminate, license_scan, line_dedup, near_dedup, piece_sampling, quality_rules, sharding
from . import license_rules as lr
from . import token_alignment, token_counts, toxicity, warc
from .common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


def tokenizer_file(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(tokenizer_file("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count(docs, token_counts.empty_cache(spark), definition, limit=1024)


QUALITY_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d),
g AS (
  SELECT doc_id, unnest(range(1, len(words) - 1)) AS i, words FROM w WHERE len(words) >= 3
),
win AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS t FROM g),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, t) AS c FROM win) WHERE c > 1),
pos AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
l0 AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM d),
l AS (
  SELECT doc_id, line, length(line) AS n, greatest(len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')), 1) AS nw
  FROM l0 WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
),
f AS (
  SELECT doc_id, line, n,
    len(list_filter(regexp_extract_all(line, '[^\x20\x09-\x0D]+'), lambda x: regexp_matches(x, '(!!|\?\?|[#*$%&|<>]{2})$'))) > 0.3 * nw
    OR len(regexp_extract_all(line, '[|\x{00bb}\x{203a}\x{2022}\x{00b7}]')) >= 3
    OR regexp_matches(line, '(?i)^[^0-9A-Za-z_]*(home|menu|log ?in|log ?out|sign ?(in|up)|next|previous|back to top|share|tweet|contact( us)?|about( us)?|site ?map|search|read more|skip to content)[^0-9A-Za-z_]*$')
    OR regexp_matches(line, '(?i)(all rights reserved|privacy policy|terms of (use|service)|cookie policy|uses? cookies|enable javascript|lorem ipsum|click here to|subscribe to our|licensed under the|copyright (\(c\)|\x{00a9}))')
    OR NOT regexp_matches(line, '[.!?:;\x{2026}\x{3002}\x{ff01}\x{ff1f}]["''\x{201d}\x{2019}\x{00bb})\]]*[\x20\x09-\x0D]*$') AS bad
  FROM l
),
s AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS dup, sum(n) AS total,
    coalesce(sum(n) FILTER (bad), 0) AS lost FROM f GROUP BY doc_id
),
r AS (
  SELECT w.doc_id, CAST(len(words) AS BIGINT) AS n_words,
    CAST(coalesce(list_sum(list_transform(words, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(w.text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
    CAST(coalesce(dup, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(pos.n, 0) AS BIGINT) AS n_repeat_words,
    coalesce(lost, 0) <= 0.5 * coalesce(total, 0) AS enough
  FROM w LEFT JOIN s USING (doc_id) LEFT JOIN pos USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND enough AS kept
FROM r
"""


@query("op7_quality_rules", QUALITY_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept".split()
    return quality_rules.clean(table(spark, sf_dir, "documents").select("doc_id", "text")).select(*names)


@query("op4_sharding")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    placed = sharding.assign(docs, shards=24, nodes=64, slack=0.0)
    return placed.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))


CHAT_SQL = r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
),
t AS (
  SELECT *, CAST(ceil(strlen(text) / 4.0) AS BIGINT) + 4 AS tok,
    23 + length(regexp_replace(replace(role, '\', '\\'), '([<\[])(\||/?s>|/?INST\]|<?/?SYS>>)', '\1\\\2', 'g'))
      + length(regexp_replace(replace(text, '\', '\\'), '([<\[])(\||/?s>|/?INST\]|<?/?SYS>>)', '\1\\\2', 'g')) AS len,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS ord FROM c
),
p AS (
  SELECT *, coalesce(sum(tok) OVER (PARTITION BY conv_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    max(CASE WHEN ord = 0 AND role = 'system' THEN tok ELSE 0 END) OVER (PARTITION BY conv_id) AS sys,
    max(CASE WHEN ord = 0 AND role = 'system' THEN len ELSE 0 END) OVER (PARTITION BY conv_id) AS syslen FROM t
),
b AS (
  SELECT *, before - sys AS pos, greatest(1024 - 256 - sys, 1) AS room FROM p WHERE NOT (ord = 0 AND role = 'system')
),
w AS (
  SELECT *, 2 * CAST(floor(pos / room) AS BIGINT) + CASE WHEN floor((pos + tok - 1) / room) > floor(pos / room) THEN 1 ELSE 0 END AS win FROM b
),
s AS (SELECT conv_id, win, min(pos) AS start, max(syslen) AS syslen FROM w GROUP BY ALL),
h AS (
  SELECT s.conv_id, sum(w.len) AS n FROM s JOIN w ON s.conv_id = w.conv_id AND w.pos >= s.start - 256 AND w.pos + w.tok <= s.start GROUP BY 1
),
f AS (
  SELECT conv_id, sum(n) AS n FROM (
    SELECT conv_id, n FROM h UNION ALL SELECT conv_id, len FROM w UNION ALL SELECT conv_id, syslen FROM s
    UNION ALL SELECT conv_id, len FROM p WHERE ord = 0 AND role = 'system' AND conv_id NOT IN (SELECT conv_id FROM w)
  ) GROUP BY 1
),
d AS (
  SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY ord)) AS turns_sha256,
    coalesce(string_agg(text, '' ORDER BY ord) FILTER (role = 'assistant'), '') AS learned FROM p GROUP BY 1
)
SELECT conv_id, n_turns, turns_sha256, CAST(length(learned) AS BIGINT) AS loss_chars, sha256(learned) AS loss_sha256,
  CAST(f.n AS BIGINT) AS formatted_chars
FROM d JOIN f USING (conv_id)
"""


@query("op8_chat_format", CHAT_SQL)
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    chats = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.sql(f"SELECT * FROM VALUES (-1L, 0, 'user', '{probe}'), (-1L, 1, 'assistant', '{probe}') AS t(conv_id, turn, role, text)")
    return chat_format.read_back(chat_format.windows(chats.unionByName(extra), budget=1024, history=256))


#: The 32 letters of a base32 SHA-1, each five bits of the hexadecimal digest ``h``.
_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', "
    f"1 + ((CAST('0x' || substr(h, {5 * i // 4 + 1}, 2) AS INT) >> {3 - 5 * i % 4}) & 31), 1)"
    for i in range(32)
)
WARC_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS holder FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN page_id = holder THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = holder THEN NULL ELSE holder END AS refers_to
FROM m
"""


@query("op3_warc", WARC_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return warc.read(warc.write(pages), pages)


#: Words of a text, A-Z lower-cased, and its set of five-word shingles.
def shingle_ctes(name: str, source: str, key: str) -> str:
    return rf"""
{name}_w AS (
  SELECT {key}, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS words FROM {source}
),
{name}_s AS (
  SELECT DISTINCT {key}, array_to_string(words[i : i + 4], ' ') AS s
  FROM (SELECT {key}, words, unnest(range(1, greatest(len(words) - 4, 1) + 1)) AS i FROM {name}_w WHERE len(words) > 0)
),
{name}_n AS (SELECT {key}, count(*) AS n FROM {name}_s GROUP BY 1)"""


NEAR_SQL = f"""
WITH RECURSIVE {shingle_ctes("d", "documents", "doc_id")},
pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM d_s x JOIN d_s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN d_n p ON p.doc_id = a JOIN d_n q ON q.doc_id = b WHERE 100 * c >= 75 * (p.n + q.n - c)
),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT l.a, reach.r FROM reach JOIN links l ON l.b = reach.doc_id),
least AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept FROM least LEFT JOIN d_n USING (doc_id)
"""


@query("op6_near_dedup", NEAR_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.link(table(spark, sf_dir, "documents").select("doc_id", "text"), percent=75)


LEAK_SQL = f"""
WITH {shingle_ctes("d", "documents", "doc_id")}, {shingle_ctes("i", "benchmark", "item_id")},
found AS (SELECT doc_id, item_id, count(*) AS n_found FROM d_s JOIN i_s USING (s) GROUP BY 1, 2)
SELECT doc_id, item_id, n AS n_item, n_found, n_found / n AS containment FROM found JOIN i_n USING (item_id) WHERE 100 * n_found >= 75 * n
"""


@query("op10_decontaminate", LEAK_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate.search(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"), percent=75)


@query("op2_line_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.classes(table(spark, sf_dir, "documents").select("doc_id", "text"), edits=2, min_chars=24)


@query("op9_toxicity")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic")))


def piece_model() -> bytes:
    with open(tokenizer_file("piece_bpe_32k.model"), "rb") as f:
        return f.read()


@query("op5_piece_sampling")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), piece_model(), k=2, seed=7, digest=True)


def centroid_sql(k: int = 40, rounds: int = 5) -> str:
    """Rounds written out; a vector's nearest centroid is the smallest of (distance, number)."""
    steps = [
        """
WITH v AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS c, v
  FROM (SELECT sha256('2:' || coalesce(CAST(vec_id AS VARCHAR), '')) AS h, v FROM v ORDER BY h, v LIMIT %d)
)"""
        % k
    ]
    for i in range(rounds + 1):
        steps.append(
            f"""
a{i} AS MATERIALIZED (
  SELECT r, vec_id, v, m %% 1000 AS c, m // 1000 AS d FROM (
    SELECT r, any_value(vec_id) AS vec_id, any_value(v.v) AS v, min(c +
      1000 * list_sum(list_transform(range(1, 65), lambda j: (v.v[j] - c{i}.v[j]) * (v.v[j] - c{i}.v[j])))) AS m
    FROM v, c{i} GROUP BY r)
)""".replace("%%", "%")
        )
        if i < rounds:
            steps.append(
                f"""
c{i + 1} AS MATERIALIZED (
  SELECT c, coalesce(m.v, c{i}.v) AS v FROM c{i} LEFT JOIN (
    SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS v
    FROM (SELECT c, j, sum(v[j]) AS s, count(*) AS n FROM a{i}, range(1, 65) AS t(j) GROUP BY c, j) GROUP BY c) AS m USING (c)
)"""
            )
    return (
        ",".join(steps)
        + f"""
SELECT vec_id, CAST(c AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c{rounds}.v, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} USING (c)
"""
    )


@query("op11_centroids", centroid_sql())
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    found = centroids.cluster(vectors, k=40, rounds=5, dims=64, scale=256, seed=2)
    return found.withColumn("centroid_sha256", F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)).drop("centroid")


@query("op12_token_alignment")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    with open(tokenizer_file("byte_bpe_50k.json"), encoding="utf-8") as f:
        definition = f.read()
    return token_alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"), definition, piece_model())


def license_sql() -> str:
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({r.number}, {r.priority}, {quoted(r.label)}, {quoted(r.pattern)}, {lr.WEIGHT[r.priority]})" for r in lr.rules())
    base = ", ".join(f"({quoted(label)}, {quoted(lr.over_words(p))})" for p, label in lr.BASE.items())
    reach = ", ".join(
        f"max(last) FILTER (p <= {p}) OVER (PARTITION BY doc_id ORDER BY first, last DESC, p, n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r{p}"
        for p in sorted(lr.WEIGHT)
    )
    inside = " ".join(f"WHEN {p} THEN coalesce(r{p}, -1)" for p in sorted(lr.WEIGHT))
    return rf"""
WITH rules(n, p, label, pattern, worth) AS (VALUES {rows}), base(label, pattern) AS (VALUES {base}),
w AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
),
t AS MATERIALIZED (
  SELECT doc_id, len(words) AS n_words, ' ' || array_to_string(list_transform(words, lambda x, i: x || '#' || (i - 1)), ' ') AS placed FROM w
),
b AS (
  SELECT doc_id, label, CAST(regexp_extract(m, '#(\d+)', 1) AS BIGINT) AS first
  FROM (SELECT doc_id, label, unnest(regexp_extract_all(placed, pattern)) AS m FROM t, base)
),
h AS (
  SELECT doc_id, n, p, label, worth, CAST(regexp_extract(m, '#(\d+)', 1) AS BIGINT) AS first, CAST(regexp_extract(m, '(\d+)$', 1) AS BIGINT) AS last
  FROM (SELECT doc_id, n, p, label, worth, unnest(regexp_extract_all(placed, pattern)) AS m FROM t, rules)
),
k AS (SELECT doc_id, label, worth FROM (SELECT *, {reach} FROM h) WHERE last > CASE p {inside} END),
bs AS (SELECT doc_id, count(*) AS n_base, min(first) AS first_word, max(first) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM b GROUP BY 1),
ls AS (
  SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(worth) AS score
  FROM (SELECT * FROM k UNION ALL SELECT doc_id, label, {lr.BASE_WEIGHT} FROM b) GROUP BY 1
)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, first_word, last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM t LEFT JOIN bs USING (doc_id) LEFT JOIN ls USING (doc_id)
"""


@query("op13_license_scan", license_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text", "detections")
