"""Mixing sources to target weights by nested hash thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumigraph.llm.common import materialize

HASH_BITS, LEVEL_BITS = 60, 10


def word_count(text: Column) -> Column:
    """Number of [^\\x20\\x09-\\x0D]+ in the text; null has none."""
    bare = F.btrim(text, F.lit(" \t\n\u000b\f\r"))
    return F.when(F.coalesce(F.length(bare), F.lit(0)) == 0, 0).otherwise(F.size(F.split(bare, r"[\x20\x09-\x0D]+"))).cast("long")


def source_targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3) -> DataFrame:
    """Adds sid (1, 2, ... by code point, null last) and target to sources (source, source_size).

    All of the size is shared by weight; what exceeds max_repeat times a source's size is shared again
    among the rest. The shares are settled in order of size over weight: a source is full if, with all
    before it full, its share would reach its limit. One row per source, whatever the corpus holds.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    by_limit = Window.orderBy(F.col("limit") / F.col("weight"), "sid")
    before, all_rows = by_limit.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("sid") - 1) % len(weights) + 1).cast("int"))
    out = sources.withColumn("sid", F.row_number().over(order)).withColumn("weight", weight.cast("long")).withColumn("limit", F.col("source_size") * max_repeat)
    out = out.withColumn("left", F.sum("source_size").over(all_rows) - F.coalesce(F.sum("limit").over(before), F.lit(0)))
    out = out.withColumn("open", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0)))
    out = out.withColumn("full", F.col("limit") * F.col("open") <= F.col("left") * F.col("weight"))
    share = F.sum("source_size").over(all_rows) - F.coalesce(F.sum(F.when(F.col("full"), F.col("limit"))).over(all_rows), F.lit(0))
    of = F.sum(F.when(~F.col("full"), F.col("weight"))).over(all_rows)
    out = out.withColumn("level", share.cast("double") / of.cast("double"))
    return out.select("sid", "source", "source_size", F.when(F.col("full"), F.col("limit").cast("double")).otherwise(F.col("weight") * F.col("level")).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_repeat: int = 3, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(id, size, source_size, target, copies, taken), a row for each row of docs.

    Every document is taken floor(target / source_size) times, and once more if its hash is below its
    source's threshold. Thresholds come from histograms of size by source and the top bits of the hash;
    only the bucket that the budget ends in is refined by the next bits, until it holds one document or
    documents of one hash; that last bucket is taken if this brings the source nearer to its target. So
    a source misses its target by half its last document at most. Nothing is sorted and nothing sampled.

    The hash is of the id, so reruns agree, and rows that repeat an id share their fate. A null id hashes
    as the empty text. A null source is a source of its own, the last. A null or empty text has size 0,
    and takes 0. Other columns are ignored; the empty table gives no rows.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"))
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col("id").cast("string"), F.lit("")).cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")
    docs = materialize(docs.withColumn("h", hashed), "sizes")
    targets = materialize(source_targets(docs.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeat), "targets")
    named = targets.select("sid", F.col("source").alias("of"))
    docs = materialize(docs.join(named, docs["source"].eqNullSafe(named["of"])).select("id", "sid", "size", "h"), "sizes", docs.count())
    n_sources = targets.count()
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    # at: the hash's top bits of the bucket that the budget ends in; rest: what is left of the budget there
    state = targets.select("sid", whole.alias("whole"), F.lit(0).cast("long").alias("at")).join(targets, "sid")
    state = state.select("sid", "at", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size")).alias("rest"), F.lit(True).alias("several"), F.lit(0).cast("long").alias("inside"))
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        inside = docs.where("size > 0").join(state.select("sid", "at", "rest"), "sid").where(F.shiftright("h", shift + LEVEL_BITS) == F.col("at"))
        buckets = inside.groupBy("sid", "rest", F.shiftright("h", shift).alias("b")).agg(F.sum("size").alias("inside"), (F.min("h") < F.max("h")).alias("several"))
        upto = F.sum("inside").over(Window.partitionBy("sid").orderBy("b").rowsBetween(Window.unboundedPreceding, 0))
        buckets = buckets.withColumn("upto", upto).where("rest < upto and rest >= upto - inside")
        found = buckets.select("sid", F.col("b").alias("at"), (F.col("rest") - F.col("upto") + F.col("inside")).alias("rest"), "several", "inside")
        state = materialize(found, "thresholds", n_sources)
        if not state.agg(F.max("several")).first()[0]:
            break
    nearer = F.abs(F.col("rest") - F.col("inside")) < F.col("rest")
    below = state.select("sid", F.shiftleft(F.col("at") + nearer.cast("long"), shift).alias("below"))
    per_source = targets.join(below, "sid", "left").select("sid", "source_size", "target", whole.alias("whole"), F.coalesce("below", F.lit(0)).alias("below"))
    copies = (F.col("whole") + (F.col("h") < F.col("below")).cast("long")).cast("long")
    out = docs.join(per_source, "sid").select(F.col("id").alias(id_col), "size", "source_size", "target", copies.alias("copies"))
    return out.withColumn("taken", F.col("size") * F.col("copies"))
