"""Orders and pages of results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ASCENDING = ("file_path", "line", "col")
# Names that callers may use for the orders of references.
ORDERS = {"score_desc": "score_desc", "line_asc": "line_asc", "line_desc": "line_desc", "asc": "line_asc", "desc": "line_desc"}


def reference_order(order: str) -> list:
    if order not in ORDERS:
        raise ValueError(f"order must be one of {', '.join(ORDERS)}, not {order!r}")
    order = ORDERS[order]
    if order == "line_desc":
        return [F.col(c).desc() for c in _ASCENDING]
    return [F.col("score").desc()] * (order == "score_desc") + [F.col(c).asc() for c in _ASCENDING]


def page(rows: DataFrame, order: list, limit: int, offset: int = 0) -> DataFrame:
    """rows in order, limit (1 at least) of them after offset. Spark keeps offset + limit rows a task, no more."""
    return rows.orderBy(*order).offset(offset).limit(max(1, limit))


def pagination(rows: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """One row: total, offset (no more than total), limit (1 at least), returned, has_more, next_offset."""
    limit = max(1, limit)
    out = rows.agg(F.count(F.lit(1)).alias("total")).withColumn("offset", F.least(F.lit(offset).cast("bigint"), F.col("total")))
    out = out.withColumn("limit", F.lit(limit).cast("bigint")).withColumn("returned", F.least(F.lit(limit).cast("bigint"), F.col("total") - F.col("offset")))
    more = F.col("offset") + F.col("returned") < F.col("total")
    return out.withColumn("has_more", more).withColumn("next_offset", F.when(more, F.col("offset") + F.col("returned")))
