"""Operator 5: preference pairs with a shared prompt and masked completions, in DataFrame functions.

The longest common prefix of turns (role and text) of the chosen and the rejected conversation is
rendered once as the prompt; what follows in each is rendered as its completion. A mask lists the
code points of a completion that count for training: the texts of the assistant's turns.

Turns are in order of turn, then role and text. Null role and text count as empty. Rows with a
null conversation id take no part, and so do pairs of which a side has no turns. Repeated rows are
repeated turns. Empty tables give no rows; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TRAINED_ROLE = "assistant"


def adjacent_pairs(turns: DataFrame) -> DataFrame:
    """pair_id and side of each turn, where conversation 2k is chosen and 2k + 1 rejected."""
    conv = F.col("conv_id").cast("long")
    return turns.where(conv.isNotNull()).select(
        F.floor(conv / 2).cast("long").alias("pair_id"),
        F.when(F.pmod(conv, F.lit(2)) == 0, "chosen").otherwise("rejected").alias("side"),
        conv.alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )


def _rendered(turns: Column) -> Column:
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("<|"), t["role"], F.lit("|>\n"), t["text"], F.lit("\n"))), "")


def _mask(turns: Column) -> Column:
    """start:end of the trained texts within the rendered turns, comma-joined."""

    def add(done: Column, t: Column) -> Column:
        start = done["at"] + F.length(t["role"]) + 5
        end = start + F.length(t["text"])
        span = F.concat_ws(":", start.cast("string"), end.cast("string"))
        return F.struct((end + 1).alias("at"), F.when(t["role"] == TRAINED_ROLE, F.concat(done["spans"], F.array(span))).otherwise(done["spans"]).alias("spans"))

    begin = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("spans"))
    return F.array_join(F.aggregate(turns, begin, add, lambda done: done["spans"]), ",")


def preference_pairs(sided: DataFrame) -> DataFrame:
    """One row a pair from turns with pair_id, side, conv_id, turn, role and text."""
    turn = F.struct("turn", "role", "text")
    both = sided.groupBy("pair_id").agg(
        *[F.min(F.when(F.col("side") == s, F.col("conv_id"))).alias(f"{s}_id") for s in ("chosen", "rejected")],
        *[F.array_sort(F.collect_list(F.when(F.col("side") == s, turn))).alias(f"{s}_turns") for s in ("chosen", "rejected")],
    )
    both = both.where((F.size("chosen_turns") > 0) & (F.size("rejected_turns") > 0))
    least = F.least(F.size("chosen_turns"), F.size("rejected_turns"))
    same = lambda a, b: (a["role"] == b["role"]) & (a["text"] == b["text"])
    agree = F.zip_with(F.slice("chosen_turns", F.lit(1), least), F.slice("rejected_turns", F.lit(1), least), same)
    first_gap = F.array_position(agree, False)
    with_prefix = both.withColumn("n_common", F.when(first_gap > 0, first_gap - 1).otherwise(least).cast("long"))

    def rest(side: str) -> Column:
        turns = F.col(f"{side}_turns")
        return F.slice(turns, F.col("n_common").cast("int") + 1, F.size(turns))

    prompt = F.slice("chosen_turns", F.lit(1), F.col("n_common").cast("int"))
    return with_prefix.select(
        "pair_id",
        "chosen_id",
        "rejected_id",
        "n_common",
        _rendered(prompt).alias("prompt"),
        _rendered(rest("chosen")).alias("chosen"),
        _rendered(rest("rejected")).alias("rejected"),
        _mask(rest("chosen")).alias("chosen_mask"),
        _mask(rest("rejected")).alias("rejected_mask"),
    )
