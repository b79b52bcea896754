"""Line dedup: lines found in several documents stay in one of them alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumigraph.llm.common import ASCII_SPACE, ascii_lower, materialize


def line_key(line: Column) -> Column:
    return F.btrim(ascii_lower(line), F.lit(ASCII_SPACE))


#: So many common lines, of 24 bytes each, are sent to every task; more are met by a shuffle.
MOST_SENT = 100_000
_DOCS_A_FILE = 2_000


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_lines, n_dropped, kept_text), a row for each row of docs.

    Lines are what \\n separates. Their key is the line without ASCII white space at its ends, A-Z
    lower-cased. A key of min_chars code points or more that min_docs documents hold stays only in the
    document with the largest id among them, there as often as it stood; other lines stay as they are.

    A null or empty text is one empty line. Rows that repeat an id count as one document and keep or lose
    lines alike. A row without id takes no part in the count and keeps all its lines. Other columns are
    ignored. The empty table gives no rows.

    Plan: lines are exploded with their positions; their keys' 128-bit hashes are grouped by the number of
    distinct ids, in two steps, so a line that a third of all documents hold meets in one task as a number
    from each of the others. The few that are over the threshold are written and, by their measured
    number, broadcast to the lines or joined by a shuffle whose hot partitions AQE splits. The positions
    that each row loses then meet its lines, which are shuffled once; what lies between lost positions is
    cut out by slices, so a row's cost is in proportion to its lines.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    docs = docs.select("id", F.xxhash64("t").alias("th"), F.split("t", "\n").alias("lines"))
    found = docs.where("id is not null").select("id", "th", F.posexplode("lines").alias("pos", "line"))
    keyed = found.select("id", "th", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= min_chars)
    keyed = keyed.select("id", "th", "pos", F.xxhash64("key").alias("h"), F.xxhash64(F.lit(7), "key").alias("h2"))
    common = keyed.groupBy("h", "h2").agg(F.countDistinct("id").alias("n"), F.max("id").alias("home")).where(F.col("n") >= min_docs)
    common = materialize(common.select("h", "h2", "home"), "common-lines", docs.count(), _DOCS_A_FILE)
    of = F.broadcast(common) if common.count() <= MOST_SENT else common
    lost = keyed.join(of, ["h", "h2"]).where("id < home").groupBy("id", "th").agg(F.sort_array(F.collect_set("pos")).alias("lost"))
    out = docs.join(lost.hint("shuffle_hash"), ["id", "th"], "left").select("id", "lines", F.coalesce("lost", F.array().cast("array<int>")).alias("lost"))
    n_lines, n_dropped = F.size("lines").cast("long"), F.size("lost").cast("long")
    # what lies between one lost position and the next
    after = lambda k: F.when(k == 0, F.lit(0)).otherwise(F.get("lost", k - 1) + 1)
    until = lambda k: F.coalesce(F.get("lost", k), F.size("lines"))
    pieces = F.transform(F.sequence(F.lit(0), F.size("lost")), lambda k: F.slice("lines", after(k) + 1, until(k) - after(k)))
    kept = F.when(n_dropped == 0, F.array_join("lines", "\n")).otherwise(F.array_join(F.flatten(pieces), "\n"))
    return out.select(F.col("id").alias(id_col), n_lines.alias("n_lines"), n_dropped.alias("n_dropped"), kept.alias("kept_text"))
