"""Conversations as training text in budgeted windows.

Prefix sums of turn tokens place every turn on the token axis of its
conversation, and a grid on that axis cuts it into spans of whole turns.  Each
window repeats the system turn and a limited history of turns before its span;
repeated turns carry no loss.  DataFrame operations throughout: a window is one
row, bounded by the budget, and no operator but the optional read-back gathers
a conversation.

Template, per turn: ``<|turn|>role<|text|>text<|end|>``.  Control strings in
roles and texts get a backslash after their first character and backslashes are
doubled, so nothing inside a turn can look like a mark and reading back is exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import let, long_sum

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
#: Control strings of common chat templates, our own marks among them.
CONTROL = r"([<\[])(\||/?s>|/?INST\]|<?/?SYS>>)"
#: Tokens the marks of a turn cost.
MARK_TOKENS = 4
#: Turns that are summed together before conversations are.
RUN = 512


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def turn_tokens(text: Column) -> Column:
    """A quarter of the UTF-8 bytes, rounded up, plus the marks."""
    return (F.ceil(F.octet_length(text) / 4) + MARK_TOKENS).cast("long")


def _on_axis(turns: DataFrame) -> DataFrame:
    """Add ``_ord`` (position) and ``_from`` (tokens before) of each turn in its conversation.

    Two levels: sums within runs of turns, then over the runs, so that a conversation of any length is summed by many
    tasks.
    """
    order = ["turn", "role", "text"]
    run = turns.withColumn("_run", F.floor(F.col("turn") / RUN))
    inside = Window.partitionBy("_k", "_run").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    number = Window.partitionBy("_k", "_run").orderBy(*order)
    run = run.withColumn("_t0", F.coalesce(F.sum("_tok").over(inside), F.lit(0))).withColumn("_o0", F.row_number().over(number) - 1)
    earlier = Window.partitionBy("_k").orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    sums = turns.groupBy("_k", F.struct(F.floor(F.col("turn") / RUN).alias("r")).alias("_r")).agg(
        F.sum("_tok").alias("_st"), F.count(F.lit(1)).alias("_so")
    )
    sums = sums.withColumn("_run", F.col("_r.r"))
    before = sums.select(
        F.col("_k").alias("_k2"),
        "_r",
        F.coalesce(F.sum("_st").over(earlier), F.lit(0)).alias("_t1"),
        F.coalesce(F.sum("_so").over(earlier), F.lit(0)).alias("_o1"),
    )
    # Structs as keys: a missing value in them equals a missing value.
    on = (F.col("_k") == F.col("_k2")) & (F.struct(F.col("_run").alias("r")) == F.col("_r"))
    return (
        run.join(before, on)
        .withColumn("_ord", F.col("_o0") + F.col("_o1"))
        .withColumn("_from", F.col("_t0") + F.col("_t1"))
        .drop("_run", "_t0", "_o0", "_t1", "_o1", "_k2", "_r")
    )


def windows(chats: DataFrame, budget: int = 1024, history: int = 256) -> DataFrame:
    """``conv_id, window, text, loss, n_repeated, n_turns, n_tokens``: one row per window.

    ``chats`` has ``conv_id, turn, role, text``; other columns are ignored.  ``loss`` lists ``(start, length)`` in
    characters of ``text``: the texts of assistant turns that the window shows for the first time.  The first
    ``n_repeated`` turns of a window were in an earlier one.  A window holds ``budget`` tokens at most, unless a
    single turn, or the system turn, is longer: turns are never cut or dropped.  Missing roles and texts count as
    empty, a missing ``turn`` comes first, turns with equal numbers are ordered by role and text, rows without a
    ``conv_id`` are one conversation, repeated rows are repeated turns.
    """
    empty = F.lit("")
    turns = chats.select(
        F.struct(F.col("conv_id").alias("c")).alias("_k"),
        "turn",
        F.coalesce("role", empty).alias("role"),
        F.coalesce("text", empty).alias("text"),
    ).withColumn("_tok", turn_tokens(F.col("text")))
    placed = _on_axis(turns)
    head = (F.col("_ord") == 0) & (F.col("role") == "system")
    system = F.max(F.when(head, F.struct("_tok", "role", "text")))
    heads = placed.groupBy("_k").agg(system.alias("_sys")).withColumnRenamed("_k", "_hk")
    body = (
        placed.join(heads, F.col("_k") == F.col("_hk"))
        .withColumn("_s", F.coalesce("_sys._tok", F.lit(0)))
        .withColumn("_room", F.greatest(F.lit(budget - history) - F.col("_s"), F.lit(1)))
        .withColumn("_at", F.col("_from") - F.col("_s"))
        .withColumn("_own_sys", head)
    )
    cell = F.floor(F.col("_at") / F.col("_room"))
    # A turn that runs over the end of its cell has a window of its own, so no other window outgrows the cell.
    crosses = F.floor((F.col("_at") + F.col("_tok") - 1) / F.col("_room")) > cell
    body = body.withColumn("_w", F.when(F.col("_own_sys"), F.lit(-1)).otherwise(2 * cell + crosses.cast("long")))
    spans = body.where("_w >= 0").groupBy("_k", "_w").agg(F.min("_at").alias("_start"), F.first("_sys").alias("_sys"))
    numbered = Window.partitionBy("_k").orderBy("_w")
    spans = spans.withColumn("_first", F.row_number().over(numbered) == 1)
    turn = F.struct(F.col("_ord").cast("long").alias("ord"), "role", "text")
    piece = lambda kind, fresh: F.struct(F.lit(kind).alias("kind"), turn.alias("turn"), fresh.alias("fresh"))
    own = body.where("_w >= 0").select("_k", "_w", "_tok", piece(2, F.lit(True)).alias("_p"))
    shown_system = spans.where("_sys is not null").select(
        "_k",
        "_w",
        F.col("_sys._tok").alias("_tok"),
        F.struct(
            F.lit(0).alias("kind"),
            F.struct(F.lit(0).cast("long").alias("ord"), F.col("_sys.role"), F.col("_sys.text")).alias("turn"),
            F.col("_first").alias("fresh"),
        ).alias("_p"),
    )
    alone = (
        body.where("_own_sys")
        .join(spans.select(F.col("_k").alias("_k3")).distinct(), F.col("_k") == F.col("_k3"), "left_anti")
        .select("_k", F.lit(0).cast("long").alias("_w"), "_tok", piece(0, F.lit(True)).alias("_p"))
    )
    parts = own.unionByName(shown_system).unionByName(alone)
    if history > 0:
        # Turn and window meet in a cell of the history's length; a window reaches back over two of them.
        reach = spans.where("_start > 0").select(
            F.col("_k").alias("_wk"),
            F.col("_w").alias("_ww"),
            "_start",
            F.explode(
                F.sequence(
                    F.floor(F.greatest(F.col("_start") - history, F.lit(0)) / history), F.floor((F.col("_start") - 1) / history)
                )
            ).alias("_hc"),
        )
        past = body.where("_w >= 0").withColumn("_hc2", F.floor(F.col("_at") / history))
        near = (F.col("_at") >= F.col("_start") - history) & (F.col("_at") + F.col("_tok") <= F.col("_start"))
        repeated = past.join(reach, (F.col("_k") == F.col("_wk")) & (F.col("_hc") == F.col("_hc2")) & near)
        parts = parts.unionByName(repeated.select("_k", F.col("_ww").alias("_w"), "_tok", piece(1, F.lit(False)).alias("_p")))
    gathered = parts.groupBy("_k", "_w").agg(F.sort_array(F.collect_list("_p")).alias("_ps"), F.sum("_tok").alias("n_tokens"))
    return gathered.select(
        F.col("_k.c").alias("conv_id"),
        F.col("_w").alias("window"),
        let(F.transform("_ps", _written), _joined).alias("_o"),
        F.size(F.filter("_ps", lambda p: ~p["fresh"])).alias("n_repeated"),
        F.size("_ps").alias("n_turns"),
        "n_tokens",
    ).select("conv_id", "window", "_o.text", "_o.loss", "n_repeated", "n_turns", "n_tokens")


def _written(p: Column) -> Column:
    start = F.concat(F.lit(TURN), escape(p["turn"]["role"]), F.lit(TEXT))
    text = escape(p["turn"]["text"])
    return F.struct(
        F.concat(start, text, F.lit(END)).alias("all"),
        F.length(start).alias("lead"),
        F.length(text).alias("n"),
        (p["fresh"] & (p["turn"]["role"] == "assistant")).alias("learn"),
    )


def _joined(written: Column) -> Column:
    none = F.expr("CAST(array() AS array<struct<start: int, length: int>>)")
    zero = F.struct(F.lit(0).alias("at"), none.alias("loss"))

    def step(acc: Column, w: Column) -> Column:
        span = F.array(F.struct((acc["at"] + w["lead"]).alias("start"), w["n"].alias("length")))
        loss = F.when(w["learn"], F.concat(acc["loss"], span)).otherwise(acc["loss"])
        return F.struct((acc["at"] + F.length(w["all"])).alias("at"), loss.alias("loss"))

    return F.struct(
        F.array_join(F.transform(written, lambda w: w["all"]), "").alias("text"),
        F.aggregate(written, zero, step)["loss"].alias("loss"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars`` of windows, from their text and mask alone.

    Turns shown before are passed over.  A digest needs a conversation's texts in order, so this gathers each
    conversation; the operator itself does not.
    """

    def turn(t: Column) -> Column:
        sides = F.split(t, r"<\|text\|>")
        return F.concat(unescape(F.substr(F.get(sides, F.lit(0)), F.lit(len(TURN) + 1))), F.lit("\n"), unescape(F.get(sides, F.lit(1))), F.lit("\n"))

    marked = F.filter(F.split("text", r"<\|end\|>"), lambda t: t != "")
    fresh = F.filter(marked, lambda t, i: i >= F.col("n_repeated"))
    learned = F.transform("loss", lambda s: unescape(F.substr(F.col("text"), s["start"] + 1, s["length"])))
    each = formatted.select(
        F.struct(F.col("conv_id").alias("c")).alias("_k"),
        F.struct(
            "window",
            F.size(fresh).cast("long").alias("n"),
            F.array_join(F.transform(fresh, turn), "").alias("turns"),
            F.array_join(learned, "").alias("learned"),
            F.length("text").cast("long").alias("chars"),
        ).alias("_w"),
    )
    together = each.groupBy("_k").agg(F.sort_array(F.collect_list("_w")).alias("_ws"))
    field = lambda name: F.transform("_ws", lambda w: w[name])
    return together.select(
        F.col("_k.c").alias("conv_id"),
        long_sum(field("n")).alias("n_turns"),
        F.sha2(F.array_join(field("turns"), "").cast("binary"), 256).alias("turns_sha256"),
        F.length(F.array_join(field("learned"), "")).cast("long").alias("loss_chars"),
        F.sha2(F.array_join(field("learned"), "").cast("binary"), 256).alias("loss_sha256"),
        long_sum(field("chars")).alias("formatted_chars"),
    )
