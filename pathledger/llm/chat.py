"""Preference formatting of chosen and rejected conversations; DataFrame functions only.

Turns are compared by their place in each conversation. The longest common prefix (same role
and text) is rendered once, as the prompt; what follows on each side is its completion. The
result has a row for each rendered turn with its character offsets inside its part, and the span
that is trained on: what assistants say in completions, with the end mark. Conversations of
any length stay spread over rows: places and offsets come from sums over blocks of turns.

A turn without a pair (null pair_id or conv_id) belongs to no conversation and gives no row. Null text and role count as ''. Null turns come first. Exact repeats of a turn (same
number, role and text) count once; other ties go by role, then text. A side without turns
gives no completion. Very long texts stay whole; columns other than those named aren't read. No turns: no rows. Marks of the template inside texts are broken up, so texts can't forge turns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut

#: Turns in a block: the most that one window sorts, but for ties of a turn number.
BLOCK = 1024
OPEN, CLOSE, END = "<|", "|>\n", "<|end|>\n"


def _places(df: DataFrame, keys: list[str], block: Column, order: list[str], size: Column, name: str) -> DataFrame:
    """df with ``name``: the sum of size over the rows before, in the order, within the keys.

    Blocks are summed alone and then among themselves, so no window holds more than a block's rows.
    """
    df = df.withColumn("_b", block).withColumn("_n", size)
    sums = df.groupBy(*keys, "_b").agg(F.sum("_n").alias("_held"))
    run = F.sum("_held").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.select(*keys, "_b", (run - F.col("_held")).alias("_before"))
    own = F.sum("_n").over(Window.partitionBy(*keys, "_b").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")
    return df.withColumn("_own", own).join(sums, [*keys, "_b"]).withColumn(name, F.col("_before") + F.col("_own")).drop("_b", "_n", "_own", "_before")


def format_preferences(turns: DataFrame) -> DataFrame:
    """turns: pair_id, side (chosen or rejected), turn, role, text.

    Returns pair_id, part (prompt, chosen or rejected), seq (from 0 in the part), role, rendered,
    char_start, char_end (in the part), mask_start and mask_end (null where nothing is trained).
    """
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    first = F.lit(-(2**62)).cast("long")
    rows = turns.filter("pair_id is not null").select("pair_id", "side", F.coalesce(F.col("turn").cast("long"), first).alias("turn"), blank("role"), blank("text")).distinct()
    rows = _places(rows, ["pair_id", "side"], F.floor(F.col("turn") / BLOCK), ["turn", "role", "text"], F.lit(1).cast("long"), "place")
    rows = cut(rows)  # read by the comparison and by the split
    turn = F.struct("role", "text")
    met = rows.groupBy("pair_id", "place").agg(F.count(F.lit(1)).alias("sides"), (F.min(turn) == F.max(turn)).alias("same"))
    split = met.groupBy("pair_id").agg(F.min(F.when((F.col("sides") < 2) | ~F.col("same"), F.col("place"))).alias("split"))
    rows = rows.join(split, "pair_id")
    shared = F.col("split").isNull() | (F.col("place") < F.col("split"))
    rows = rows.filter(~shared | (F.col("side") == "chosen")).withColumn("part", F.when(shared, "prompt").otherwise(F.col("side")))
    rows = rows.withColumn("seq", F.when(shared, F.col("place")).otherwise(F.col("place") - F.col("split")))
    plain = lambda c: F.replace(F.col(c), F.lit("<|"), F.lit("< |"))
    head = F.concat(F.lit(OPEN), plain("role"), F.lit(CLOSE))
    rows = rows.withColumn("head", F.length(head).cast("long")).withColumn("rendered", F.concat(head, plain("text"), F.lit(END)))
    rows = cut(rows.select("pair_id", "part", "seq", "role", "head", "rendered"))  # read for the sums of blocks and for the rows
    rows = _places(rows, ["pair_id", "part"], F.floor(F.col("seq") / BLOCK), ["seq"], F.length("rendered").cast("long"), "char_start")
    trained = (F.col("part") != "prompt") & (F.col("role") == "assistant")
    end = F.col("char_start") + F.length("rendered")
    return rows.select(
        "pair_id", "part", "seq", "role", "rendered", "char_start", end.alias("char_end"), F.when(trained, F.col("char_start") + F.col("head")).alias("mask_start"), F.when(trained, end).alias("mask_end")
    )


def neighbour_preferences(conversations: DataFrame) -> DataFrame:
    """Preference pairs from plain conversations: each is chosen over itself with the last
    assistant turn of its neighbour (ids 2k and 2k+1) in place of its own; without one, the turn goes.
    """
    rows = conversations.filter("conv_id is not null").select("conv_id", "turn", "role", "text")
    lasts = rows.filter("role = 'assistant'").groupBy("conv_id").agg(F.max(F.struct(F.coalesce(F.col("turn"), F.lit(-(2**62))).alias("turn"), F.coalesce("text", F.lit("")).alias("text"))).alias("last"))
    other = lasts.select(F.col("conv_id").bitwiseXOR(F.lit(1).cast("long")).alias("conv_id"), F.col("last.text").alias("said"))
    own = lasts.select("conv_id", F.col("last.turn").alias("last_turn")).join(other, "conv_id", "left")
    rows = rows.join(own, "conv_id", "left")
    swap = F.coalesce((F.col("role") == "assistant") & (F.coalesce(F.col("turn"), F.lit(-(2**62))) == F.col("last_turn")), F.lit(False))
    sides = F.array(
        F.struct(F.lit("chosen").alias("side"), F.col("text").alias("text"), F.lit(True).alias("there")),
        F.struct(F.lit("rejected").alias("side"), F.when(swap, F.col("said")).otherwise(F.col("text")).alias("text"), (~swap | F.col("said").isNotNull()).alias("there")),
    )
    got = rows.select(F.col("conv_id").alias("pair_id"), "turn", "role", F.explode(sides).alias("s")).filter("s.there")
    return got.select("pair_id", "s.side", "turn", "role", "s.text")
