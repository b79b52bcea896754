"""Chat formatting: collapse cumulative snapshots of conversations, then render."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def turn_prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, role, text, n, p1, p2): p1 and p2 together are a 128-bit hash of the first pos turns.

    Each turn is hashed with its position, and a running xor rolls the hash along the conversation, so
    nothing is collected and a long conversation is streamed.
    """
    by = Window.partitionBy("conv_id")
    pos = by.orderBy("turn", "role", "text")
    turns = turns.withColumn("pos", F.row_number().over(pos))
    # null and '' differ, so nulls are marked beside the value
    parts = [F.col("pos"), F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit(""))]
    turns = turns.withColumn("x1", F.xxhash64(F.lit(1), *parts)).withColumn("x2", F.xxhash64(F.lit(2), *parts))
    run = by.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    return turns.select("conv_id", "pos", "role", "text", F.count(F.lit(1)).over(by).alias("n"), F.bit_xor("x1").over(run).alias("p1"), F.bit_xor("x2").over(run).alias("p2"))


def maximal_conversations(prefixes: DataFrame) -> DataFrame:
    """(conv_id) of conversations that no longer one starts with; of equal ones the smallest conv_id."""
    # both sides have a row for each prefix when they meet, however many conversations share it
    ends = prefixes.where("pos = n").groupBy("pos", "p1", "p2").agg(F.min("conv_id").alias("conv_id"))
    inner = prefixes.where("pos < n").select("pos", "p1", "p2").distinct()
    return ends.join(inner, ["pos", "p1", "p2"], "left_anti").select("conv_id")


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, rendered) of the maximal conversations of (conv_id, turn, role, text).

    Turns go by turn number, then role, then text (nulls first), so ties and repeated rows have one
    order; a repeated row is a turn of its own. A logged conversation whose turns are the first turns
    of a longer one is dropped, of equal ones all but the smallest conv_id. A turn renders as
    <|role|>\\ntext<|end|>\\n; a null role renders as unknown, a null text as the empty one (but they
    equal only nulls when compared). Rows without conv_id belong to no conversation and are left out.
    Other columns are ignored. The empty table gives no rows.
    """
    turns = conversations.select("conv_id", "turn", "role", "text").where("conv_id is not null")
    prefixes = turn_prefixes(turns)
    kept = prefixes.join(maximal_conversations(prefixes), "conv_id", "left_semi")
    line = F.concat(F.lit("<|"), F.coalesce("role", F.lit("unknown")), F.lit("|>\n"), F.coalesce("text", F.lit("")), F.lit("<|end|>\n"))
    rows = kept.select("conv_id", "n", F.struct("pos", line.alias("line")).alias("x")).groupBy("conv_id").agg(F.max("n").cast("long").alias("n_turns"), F.sort_array(F.collect_list("x")).alias("xs"))
    return rows.select("conv_id", "n_turns", F.array_join(F.col("xs")["line"], "").alias("rendered"))
