"""Preference records from chosen and rejected conversations, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN = ("<|", "|>\n", "<|end|>\n")  # a rendered turn: <|role|>, text, <|end|>


def render(role: Column, text: Column) -> Column:
    none = F.lit("")
    return F.concat(
        F.lit(TURN[0]), F.coalesce(role, none), F.lit(TURN[1]), F.coalesce(text, none), F.lit(TURN[2])
    )


def segments(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """(pair_id, part, turn, role, text, rendered, learned): every turn once, ``part`` being
    prompt, chosen or rejected. Nothing is gathered beyond the turns at one place of a pair."""
    cell = F.struct("role", "text")
    sides = [
        F.sort_array(F.collect_list(F.when(F.col("side") == s, cell))).alias(s)
        for s in ("chosen", "rejected")
    ]
    at = turns.filter(F.col("pair_id").isNotNull()).groupBy("pair_id", "turn").agg(*sides)
    split = at.filter(F.col("chosen") != F.col("rejected"))
    # NULL turns come last; a pair whose sides are equal is all prompt
    first = split.groupBy("pair_id").agg(
        F.min(F.coalesce(F.col("turn").cast("bigint"), F.lit((1 << 63) - 1))).alias("fork")
    )
    marked = at.join(first, "pair_id", "left").withColumn(
        "shared",
        F.col("fork").isNull()
        | (F.coalesce(F.col("turn").cast("bigint"), F.lit((1 << 63) - 1)) < F.col("fork")),
    )
    parts = F.when(
        F.col("shared"), F.array(F.struct(F.lit("prompt").alias("part"), F.col("chosen").alias("t")))
    ).otherwise(F.array(*(
        F.struct(F.lit(s).alias("part"), F.col(s).alias("t")) for s in ("chosen", "rejected")
    )))
    rows = marked.select("pair_id", "turn", F.explode(parts).alias("p")).select(
        "pair_id", "turn", "p.part", F.posexplode("p.t").alias("tie", "cell")
    )
    learned = (F.col("part") != "prompt") & (F.coalesce(F.col("cell.role"), F.lit("")) == learn)
    return rows.select(
        "pair_id", "part", "turn", "tie", "cell.role", "cell.text",
        render(F.col("cell.role"), F.col("cell.text")).alias("rendered"), learned.alias("learned"),
    )


def _text(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda s: s["rendered"]), "")


def _spans(turns: Column) -> Column:
    """Character ranges whose tokens count in the loss: text and end mark of learned turns."""
    head = lambda s: F.length(s["rendered"]) - F.length(F.coalesce(s["text"], F.lit(""))) - len(TURN[2])
    start = F.struct(
        F.lit(0).alias("at"), F.array().cast("array<struct<start:int,stop:int>>").alias("spans")
    )

    def step(acc: Column, s: Column) -> Column:
        stop = acc["at"] + F.length(s["rendered"])
        span = F.array(F.struct((acc["at"] + head(s)).alias("start"), stop.alias("stop")))
        return F.struct(
            stop.alias("at"),
            F.when(s["learned"], F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    return F.aggregate(turns, start, step, lambda acc: acc["spans"])


def preference_records(turns: DataFrame, learn: str = "assistant") -> DataFrame:
    """One row per pair: ``pair_id``, ``prompt``, ``n_prompt_turns``, ``chosen``, ``rejected``,
    ``chosen_spans``, ``rejected_spans``, ``usable``.

    ``turns`` holds (pair_id, side, turn, role, text) with side 'chosen' or 'rejected'. The
    prompt is the longest common run of leading turns, rendered once; each side's other turns
    are its completion. Spans are the character ranges of a completion to learn from, the turns
    of role ``learn``; everything else, the prompt included, is masked. ``usable``: both sides
    have something to learn from.

    Turns compare by role and text; NULL equals NULL and renders as nothing. Turns of one number
    are compared as a set with repeats, in the order of role and text. NULL turn numbers come
    last, NULL pair ids are dropped, a side that is missing or ends early has an empty
    completion, equal sides are all prompt. Other columns are not looked at, whatever their
    names. An empty table gives an empty result. Sides are compared turn by turn with partial
    aggregation; only a finished record is gathered. ``segments`` gives the same without
    gathering records.
    """
    seg = segments(turns, learn)
    order = F.struct(
        F.coalesce(F.col("turn").cast("bigint"), F.lit((1 << 63) - 1)).alias("turn"), "tie",
        "rendered", "text", "learned",
    )
    parts = seg.groupBy("pair_id").agg(*(
        F.sort_array(F.collect_list(F.when(F.col("part") == p, order))).alias(p)
        for p in ("prompt", "chosen", "rejected")
    ))
    return parts.select(
        "pair_id", _text(F.col("prompt")).alias("prompt"),
        F.size("prompt").cast("bigint").alias("n_prompt_turns"),
        _text(F.col("chosen")).alias("chosen"), _text(F.col("rejected")).alias("rejected"),
        _spans(F.col("chosen")).alias("chosen_spans"),
        _spans(F.col("rejected")).alias("rejected_spans"),
        (F.exists("chosen", lambda s: s["learned"]) & F.exists("rejected", lambda s: s["learned"]))
        .alias("usable"),
    )


def swapped_replies(conversations: DataFrame, learn: str = "assistant") -> DataFrame:
    """Preference turns from plain conversations: chosen is a conversation as it is, rejected
    the same with its last reply exchanged for the last reply of its neighbour (ids 2k and
    2k + 1). Conversations without a reply, or whose neighbour has none, give no pair."""
    turns = conversations.filter("conv_id IS NOT NULL")
    last = turns.filter(F.col("role") == learn).groupBy("conv_id").agg(
        F.max(F.struct("turn", "text")).alias("m")
    ).select("conv_id", F.col("m.turn").alias("reply_at"), F.col("m.text").alias("reply"))
    other = last.select((F.col("conv_id").bitwiseXOR(F.lit(1))).alias("conv_id"), F.col("reply").alias("other"))
    pairs = last.select("conv_id", "reply_at").join(other, "conv_id")
    rows = turns.select("conv_id", "turn", "role", "text").join(pairs, "conv_id")
    swapped = F.when(
        F.col("turn").eqNullSafe(F.col("reply_at")) & (F.col("role") == learn), F.col("other")
    ).otherwise(F.col("text"))
    sides = F.array(
        F.struct(F.lit("chosen").alias("side"), F.col("text").alias("t")),
        F.struct(F.lit("rejected").alias("side"), swapped.alias("t")),
    )
    return rows.select(
        F.col("conv_id").alias("pair_id"), "turn", "role", F.explode(sides).alias("s")
    ).select("pair_id", "s.side", "turn", "role", F.col("s.t").alias("text"))
