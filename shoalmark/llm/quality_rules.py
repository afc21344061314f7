"""Line-first cleaning.

Every line of a document is judged by itself - punctuation, navigation and
boilerplate rules - and failing lines are removed.  A document that loses too
much of its text is rejected.  One projection over the scan: no shuffle, no
Python.  All work on a text is linear in its length, but for sorting its
three-word windows where some window repeats.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, fresh, let, long_sum, tokens

SYMBOL = r"[#*$%&|<>]"
#: What a line of prose ends with, and the quotes and brackets that may follow.
ENDS = ".!?:;…。！？"
CLOSING = "\"'”’»)]"
#: A word that shouts or is dressed up: several marks or symbols at its end.
DRESSED = r"(?:!{2,}|\?{2,}|[#*$%&|<>]{2,})(?=[\x20\x09-\x0D]|$)"
#: Separators of link lists.
SEPARATOR = r"[|»›•·]"
NAVIGATION = (
    r"(?i)^\W*(home|menu|log ?in|log ?out|sign ?(in|up)|next|previous|back to top|share|tweet|contact( us)?|about( us)?"
    r"|site ?map|search|read more|skip to content)\W*$"
)
BOILERPLATE = (
    r"(?i)(all rights reserved|privacy policy|terms of (use|service)|cookie policy|uses? cookies|enable javascript"
    r"|lorem ipsum|click here to|subscribe to our|licensed under the|copyright (\(c\)|©))"
)


#: What a text must contain, lower-cased, for the slower pattern to be tried on its lines.
BOILERPLATE_HINTS = (
    "rights reserved,privacy policy,terms of,cookie,javascript,lorem ipsum,click here,subscribe,licensed under,copyright"
).split(",")


def hints(text: Column) -> Column:
    """Which patterns can match anywhere in a text: a cheap look that spares most texts the patterns."""
    low = F.lower(text)
    any_of = lambda t, parts: reduce(lambda a, b: a | b, [t.contains(p) for p in parts])
    symbols = F.regexp_count(text, F.lit(SYMBOL)).cast("long")
    return F.struct(
        symbols.alias("symbols"),
        ((symbols > 0) | any_of(text, ["!!", "??"])).alias("dressed"),
        any_of(text, SEPARATOR[1:-1]).alias("separators"),
        any_of(low, BOILERPLATE_HINTS).alias("boilerplate"),
    )


def line_fails(line: Column, hint: Column, max_dressed: float = 0.3, max_separators: int = 3) -> Column:
    """Name of the first rule a line breaks, null for a good line."""
    words = F.greatest(F.regexp_count(line, F.lit(WORD)), F.lit(1))
    end = F.right(F.rtrim(F.rtrim(line, F.lit(" \t\r\x0b\x0c")), F.lit(CLOSING)), F.lit(1))
    return (
        F.when(hint["dressed"] & (F.regexp_count(line, F.lit(DRESSED)) > max_dressed * words), "punctuation")
        .when(hint["separators"] & (F.regexp_count(line, F.lit(SEPARATOR)) >= max_separators), "navigation")
        .when(line.rlike(NAVIGATION), "navigation")
        .when(hint["boilerplate"] & line.rlike(BOILERPLATE), "boilerplate")
        .when(~end.isin(list(ENDS)), "punctuation")
    )


def repeated_words(words: Column) -> Column:
    """Number of words inside a three-word window that the text holds twice or more.

    Windows are compared by 64-bit hash within one text, where a clash is out of practical reach.
    """

    def covered(places: Column) -> Column:
        step = lambda p, i: F.least(F.lit(3), F.coalesce(F.get(places, i + 1) - p, F.lit(3)))
        return long_sum(F.transform(places, step))

    def places(ordered: Column) -> Column:
        twin = lambda x, i: (x["w"] == F.get(ordered, i - 1)["w"]) | (x["w"] == F.get(ordered, i + 1)["w"])
        return F.sort_array(F.transform(F.filter(ordered, twin), lambda x: x["i"]))

    def of_windows(w: Column) -> Column:
        with_place = F.transform(w, lambda x, i: F.struct(x.alias("w"), i.alias("i")))
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(
            let(F.sort_array(with_place), lambda s: let(places(s), covered))
        )

    def of_words(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.size(w) - 3)
        window = F.transform(starts, lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        return F.when(F.size(w) < 3, F.lit(0).cast("long")).otherwise(let(window, of_windows))

    return let(words, of_words)


def clean(
    docs: DataFrame,
    text: str = "text",
    max_lost: float = 0.5,
    min_words: int = 50,
    max_repeat_percent: int = 50,
) -> DataFrame:
    """``docs`` with figures, the cleaned text and a verdict; one row per input row, in no order.

    Adds ``n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, n_lines_removed, lost_chars,
    clean_text, kept``; input columns of these names are replaced.  A missing text counts as empty: no words, rejected,
    ``clean_text`` empty.  Blank lines are neither judged nor counted.  Repeated rows are judged each by itself.
    """
    raw = F.coalesce(F.col(text), F.lit(""))
    figures = let(
        tokens(F.col(text)),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            long_sum(F.transform(w, lambda x: F.length(x))).alias("word_chars"),
            repeated_words(w).alias("n_repeat_words"),
        ),
    )

    def of_lines(hint: Column) -> Column:
        lines = F.filter(F.split(raw, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
        judged = lambda full: F.transform(full, lambda x: F.struct(x.alias("line"), line_fails(x, hint).alias("fails")))
        return let(
            lines,
            lambda full: let(
                judged(full),
                lambda v: F.struct(
                    hint["symbols"].alias("symbols"),
                    (F.size(full) - F.size(F.array_distinct(full))).cast("long").alias("dup"),
                    long_sum(F.transform(v, lambda x: F.length(x["line"]))).alias("all"),
                    long_sum(F.transform(v, lambda x: F.when(x["fails"].isNull(), 0).otherwise(F.length(x["line"])))).alias("lost"),
                    F.size(F.filter(v, lambda x: x["fails"].isNotNull())).cast("long").alias("removed"),
                    F.concat_ws("\n", F.transform(F.filter(v, lambda x: x["fails"].isNull()), lambda x: x["line"])).alias("rest"),
                ),
            ),
        )

    verdict = let(hints(raw), of_lines)
    names = (
        "n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed n_lines_removed lost_chars clean_text kept"
    ).split()
    f, v = fresh(docs, "_f", "_v")
    n_words, n_repeat = F.col(f"{f}.n_words"), F.col(f"{f}.n_repeat_words")
    failed = (n_words < min_words) | (100 * n_repeat > max_repeat_percent * n_words)
    return (
        docs.withColumn(f, figures)
        .withColumn(v, verdict)
        .select(
            *[F.col(f"`{c}`") for c in docs.columns if c not in names],
            n_words.alias("n_words"),
            F.col(f"{f}.word_chars").alias("word_chars"),
            F.col(f"{v}.symbols").alias("n_symbols"),
            F.col(f"{v}.dup").alias("n_dup_lines"),
            n_repeat.alias("n_repeat_words"),
            failed.alias("base_failed"),
            F.col(f"{v}.removed").alias("n_lines_removed"),
            F.col(f"{v}.lost").alias("lost_chars"),
            F.col(f"{v}.rest").alias("clean_text"),
            (~failed & (F.col(f"{v}.lost") <= max_lost * F.col(f"{v}.all"))).alias("kept"),
        )
    )
