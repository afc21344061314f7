"""License scans: ordered signature rules over whole texts.

One search for keywords decides whether a text is looked at; of such a text
each word is written with its place, so that a signature's match tells where it
stands, and only rules one of whose keywords the text holds are tried.  A
detection inside another of the same or a stronger priority is suppressed.  One
projection over the scan: no shuffle, no Python.  Work is linear in the text,
and m detections of a text take about m ** 1.5 steps.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import license_rules as lr
from .common import let

#: What is between words.
BETWEEN = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
HIT = "struct<start:int,fore:int,priority:int,rule:int,label:string>"
ADDED = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"]


def keywords_in(words: Column, rules: list[lr.Rule]) -> Column:
    """The keywords of ``rules`` and base phrases among the words of a text, each once."""
    known = sorted({k for r in rules for k in r.keywords} | set(lr.BASE_KEYWORDS))
    return F.array_intersect(words, F.array(*[F.lit(k) for k in known]))


def number_of(words: Column) -> Column:
    """Words of a split text: it has an empty part in front and behind where it starts or ends with something else."""
    behind = (F.size(words) > 1) & (F.element_at(words, -1) == "")
    return F.size(words).cast("long") - (F.get(words, 0) == "").cast("long") - behind.cast("long")


def with_places(text: Column) -> Column:
    """All words of a text, lower-cased, as `` word#place`` items."""
    words = F.filter(F.split(F.translate(text, UPPER, LOWER), BETWEEN), lambda w: w != "")
    return F.concat(F.lit(" "), F.array_join(F.transform(words, lambda w, i: F.concat(w, F.lit("#"), i.cast("string"))), " "))


def _first(match: Column) -> Column:
    return F.regexp_extract(match, r"#(\d+)", 1).cast("int")


def _last(match: Column) -> Column:
    return F.regexp_extract(match, r"(\d+)$", 1).cast("int")


def hits(placed: Column, found: Column, rules: list[lr.Rule]) -> Column:
    """Matches of all rules with a keyword among ``found``; ``fore`` is the negative last place."""
    spec = json.dumps([{"n": r.number, "p": r.priority, "l": r.label, "k": r.keywords, "s": r.pattern} for r in rules])
    table = F.from_json(F.lit(spec), "array<struct<n:int,p:int,l:string,k:array<string>,s:string>>")
    tried = F.filter(table, lambda r: F.arrays_overlap(r["k"], found))

    def of(r: Column) -> Column:
        places = lambda m: F.struct(
            _first(m).alias("start"), (-_last(m)).alias("fore"), r["p"].alias("priority"), r["n"].alias("rule"), r["l"].alias("label")
        )
        return F.transform(F.regexp_extract_all(placed, r["s"], F.lit(0)), places)

    return F.flatten(F.transform(tried, of))


def unsuppressed(found: Column) -> Column:
    """Hits that lie in no other hit of the same or a stronger priority; of equal places the earlier rule stays.

    In order of start, then of descending end, whatever contains a hit comes before it, so the largest end so far of
    each priority or a stronger one decides.  Hits are gone through in parts of about the root of their number, as an
    array is copied whenever it grows.
    """
    levels = len(lr.WEIGHT)
    none = F.array().cast(f"array<{HIT}>")
    fresh = F.array(*[F.lit(-1)] * levels)

    def one(state: Column, hit: Column) -> Column:
        end = -hit["fore"]
        stays = F.get(state["reach"], hit["priority"]) < end
        reach = F.transform(state["reach"], lambda m, p: F.when(p >= hit["priority"], F.greatest(m, end)).otherwise(m))
        return F.struct(reach.alias("reach"), F.when(stays, F.concat(state["kept"], F.array(hit))).otherwise(state["kept"]).alias("kept"))

    def part(state: Column, hits_: Column) -> Column:
        inner = F.aggregate(hits_, F.struct(state["reach"].alias("reach"), none.alias("kept")), one)
        return let(inner, lambda s: F.struct(s["reach"].alias("reach"), F.concat(state["kept"], F.array(s["kept"])).alias("kept")))

    def whole(ordered: Column) -> Column:
        width = F.ceil(F.sqrt(F.size(ordered))).cast("int")
        parts = F.transform(F.sequence(F.lit(1), F.size(ordered), width), lambda i: F.slice(ordered, i, width))
        state = F.struct(fresh.alias("reach"), F.array().cast(f"array<array<{HIT}>>").alias("kept"))
        return F.when(F.size(ordered) == 0, none).otherwise(F.flatten(F.aggregate(parts, state, part)["kept"]))

    return let(F.array_sort(found), whole)


def scan(docs: DataFrame, text: str = "text", rules: list[lr.Rule] | None = None) -> DataFrame:
    """``docs`` with what their whole texts say about rights, one row per input row, in no order.

    Words are runs of ASCII letters, digits and characters beyond ASCII, A-Z lower-cased.  Adds ``n_words``; of the
    base phrases' places ``n_base``, ``first_word`` and ``last_word`` (smallest and largest start, null if none) and
    ``base_labels``; ``labels`` (those and the labels of detections that are not suppressed, sorted, joined by commas);
    ``score`` (the worth of the best of them, 0 for none); ``detections`` (label, first and last word, priority).
    Input columns of these names are replaced.  A missing text counts as empty: no words, '' for labels, score 0.
    Repeated rows are scanned each by itself; an empty table gives an empty one.
    """
    rules = lr.rules() if rules is None else rules
    raw = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    base_pattern = "|".join(lr.over_words(p) for p in lr.BASE)
    base_label = F.create_map(*[F.lit(x) for p, label in lr.BASE.items() for x in (p, label)])
    worth = F.array(*[F.lit(lr.WEIGHT[p]) for p in sorted(lr.WEIGHT)])

    def of_hits(n_words: Column, base: Column, kept: Column) -> Column:
        names = F.array_distinct(F.transform(base, lambda m: F.element_at(base_label, F.trim(F.regexp_replace(m, r"#\d+", "")))))
        every = F.array_distinct(F.concat(names, F.transform(kept, lambda h: h["label"])))
        best = F.array_max(F.transform(kept, lambda h: F.get(worth, h["priority"])))
        return F.struct(
            n_words.alias("n_words"),
            F.size(base).cast("long").alias("n_base"),
            F.array_min(F.transform(base, _first)).cast("long").alias("first_word"),
            F.array_max(F.transform(base, _first)).cast("long").alias("last_word"),
            F.array_join(F.array_sort(names), ",").alias("base_labels"),
            F.array_join(F.array_sort(every), ",").alias("labels"),
            F.greatest(F.coalesce(best, F.lit(0.0)), F.when(F.size(base) > 0, lr.BASE_WEIGHT).otherwise(0.0)).alias("score"),
            F.transform(
                kept, lambda h: F.struct(h["label"].alias("label"), h["start"].alias("first"), (-h["fore"]).alias("last"), h["priority"].alias("priority"))
            ).alias("detections"),
        )

    def of_words(words: Column) -> Column:
        return let(F.struct(number_of(words).alias("n"), keywords_in(words, rules).alias("k")), lambda x: of_text(x["n"], x["k"]))

    def of_text(n_words: Column, found: Column) -> Column:
        placed = F.when(F.size(found) > 0, with_places(raw)).otherwise(F.lit(""))
        return let(
            placed,
            lambda p: let(
                F.regexp_extract_all(p, F.lit(base_pattern), F.lit(0)),
                lambda base: let(unsuppressed(hits(p, found, rules)), lambda kept: of_hits(n_words, base, kept)),
            ),
        )

    # One value of a text's findings, evaluated once; its name is new to the caller's columns.
    name = "_found"
    while name in docs.columns:
        name += "_"
    # Lower-casing beyond A-Z moves no character in or out of a word; it only lets a few more texts be looked at.
    looked = docs.withColumn(name, let(F.split(F.lower(raw), BETWEEN), of_words))
    return looked.select(*[F.col(f"`{c}`") for c in docs.columns if c not in ADDED], *[F.col(f"`{name}`.{c}").alias(c) for c in ADDED])
