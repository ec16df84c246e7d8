"""Chat formatting from event logs, in DataFrame operations only.

A log has one row per event: conversation, sequence number, turn, kind, role and text.

* ``delta`` appends its text to the message of its turn;
* ``edit`` replaces what the turn held so far by its text;
* ``regenerate`` empties its turn, to be streamed anew, and withdraws all later turns logged before.

Conversations are partitioned, their events sorted by sequence number and folded to one message per
turn, and the messages rendered:

    <|im_start|>ROLE
    TEXT<|im_end|>

Inside roles and texts the characters that control strings of the usual templates begin with are
written ``~1`` for ``<`` and ``~2`` for ``[``, and ``~`` itself ``~0``; in a role a line break is ``~3``.
So no text can hold a control string, and reading back is exact. The loss mask is the list of
(start, length) of assistant texts in the formatted string, in code points.

Events are folded per message before messages meet in a conversation, so an editing war is not
gathered in one place; what is gathered is the conversation's final text, which is one value of the
result anyway.

Defined results: null text is empty, null role is the empty role, null kind is ``delta``; events of a
turn with equal sequence numbers apply in the order regenerate, edit, delta, then by text; a turn
whose events were all withdrawn gives no message; conversations without messages give no row; a
null conversation id is a conversation of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
LEARNED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("~"), F.lit("~0")), F.lit("<"), F.lit("~1")), F.lit("["), F.lit("~2"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("~2"), F.lit("[")), F.lit("~1"), F.lit("<")), F.lit("~0"), F.lit("~"))


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("~3"))


def _unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("~3"), F.lit("\n")))


def fold_events(events: DataFrame) -> DataFrame:
    """Events (conv_id, seq, turn, kind, role, text) as final messages (conv_id, turn, role, text)."""
    kind = F.coalesce(F.lower("kind"), F.lit("delta"))
    log = events.select(
        "conv_id", "turn", "seq", kind.alias("kind"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.when(kind == "regenerate", 0).when(kind == "edit", 1).otherwise(2).alias("step"),
    ).withColumn("at", F.struct("seq", "step"))
    resets = log.groupBy("conv_id", "turn").agg(
        F.max(F.when(F.col("step") < 2, F.col("at"))).alias("reset"),
        F.max(F.when(F.col("step") == 0, F.col("at"))).alias("redo"),
    )
    earlier = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    bounds = resets.withColumn("withdrawn", F.max("redo").over(earlier)).select(
        F.col("conv_id").alias("_c"), F.col("turn").alias("_t"), F.greatest("reset", "withdrawn").alias("since")
    )
    live = log.join(bounds, F.col("conv_id").eqNullSafe(F.col("_c")) & F.col("turn").eqNullSafe(F.col("_t"))).where(
        "since is null or at >= since"
    )
    return (
        live.groupBy("conv_id", "turn")
        .agg(
            F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seq", "step", "text"))), lambda e: e["text"]), "").alias("text"),
            F.max(F.struct("at", "role"))["role"].alias("role"),
        )
        .select("conv_id", "turn", "role", "text")
    )


def render(messages: DataFrame) -> DataFrame:
    """Messages as ``formatted`` and ``loss_spans``, one row per conversation."""
    head = F.concat(F.lit(OPEN), _escape_role(F.col("role")), F.lit("\n"))
    parts = messages.select(
        "conv_id", "turn", head.alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == LEARNED_ROLE).alias("learned")
    ).withColumn("own", F.length("body").cast("long"))
    before = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumn(
        "start",
        F.coalesce(F.sum(F.length("head") + F.col("own") + len(CLOSE)).over(before), F.lit(0)) + F.length("head"),
    )
    span = F.when(F.col("learned"), F.struct("start", F.col("own").alias("length")))
    whole = placed.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", F.concat("head", "body", F.lit(CLOSE)).alias("piece")))).alias("parts"),
        F.sort_array(F.collect_list(span)).alias("loss_spans"),
    )
    return whole.select("conv_id", F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("formatted"), "loss_spans")


def read_back(formatted: DataFrame) -> DataFrame:
    """The turns recovered from ``formatted`` and ``loss_spans`` alone: (conv_id, k, role, text, learned_text).

    ``learned_text`` is what the mask covers of the turn, null where it covers nothing. A span that
    starts anywhere but at the beginning of a turn's text would be lost, which the digests reveal.
    """
    pieces = formatted.select(
        "conv_id", F.posexplode(F.split("formatted", F.lit("<\\|im_end\\|>\n"), -1)).alias("k", "piece")
    ).where("piece != ''")
    before = Window.partitionBy("conv_id").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    cut = F.instr("piece", "\n")
    placed = pieces.withColumn("cut", cut).withColumn(
        "start", F.coalesce(F.sum(F.length("piece") + len(CLOSE)).over(before), F.lit(0)) + F.col("cut")
    )
    spans = formatted.select(F.col("conv_id").alias("_c"), F.explode("loss_spans").alias("s")).select("_c", "s.start", "s.length")
    met = placed.join(
        spans.withColumnRenamed("start", "_start"), F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("start") == F.col("_start")), "left"
    )
    return met.select(
        "conv_id",
        "k",
        _unescape_role(F.expr(f"substring(piece, {len(OPEN) + 1}, cut - {len(OPEN) + 1})")).alias("role"),
        unescape(F.expr("substring(piece, cut + 1)")).alias("text"),
        unescape(F.expr("substring(piece, cut + 1, cast(length as int))")).alias("learned_text"),
    )


def format_chats(events: DataFrame) -> DataFrame:
    """Event log to one formatted string and loss mask per conversation."""
    return render(fold_events(events))
