"""Helpers that the text operators share: tables, the shared folder, connected components."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ASCII_SPACE = " \t\n\u000b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Upper-case or title-case code points beyond ASCII: what lower() would change and we must not. The regex engine's
# Unicode is older than that of lower(), so code points that it doesn't know are counted among them.
_OTHER_UPPER = r"[\p{IsUppercase}\p{Lt}\p{Cn}&&[^\x00-\x7F]]"


try:
    _TRIM = ctypes.CDLL(None).malloc_trim
except (AttributeError, OSError):  # a C library without it
    _TRIM = None
_HELD: dict = {}


def held(key, make):
    """What a worker process keeps from task to task, of one operator at a time: what another one kept is let go first."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make()
    return _HELD[key]


def relieve() -> None:
    """Gives memory that a worker process no longer uses back to the system, which allocators put off."""
    pa.default_memory_pool().release_unused()
    if _TRIM:
        _TRIM(0)


def byte_slices(sizes: list[int], most: int) -> list[range]:
    """Ranges of rows of about most bytes together; a row alone may be larger."""
    out, lo, size = [], 0, 0
    for i, n in enumerate(sizes):
        size += n
        if size >= most:
            out.append(range(lo, i + 1))
            lo, size = i + 1, 0
    return out + ([range(lo, len(sizes))] if lo < len(sizes) else [])


def slices(batches: Iterator[pa.RecordBatch], most: int, *at: int) -> Iterator[tuple[pa.RecordBatch, list[list]]]:
    """(slice, its values in the columns at) of batches, in order, with about most bytes of texts each."""
    for batch in batches:
        sizes = sum(np.asarray(pc.fill_null(pc.binary_length(batch.column(k)), 0)).astype(np.int64) for k in at)
        for r in byte_slices(sizes.tolist(), most):
            own = batch.slice(r.start, len(r))
            yield own, [own.column(k).to_pylist() for k in at]
        relieve()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z alone. translate() is slow, so it serves only where lower() would do more."""
    return F.when(text.rlike(_OTHER_UPPER), F.translate(text, _UPPER, _LOWER)).otherwise(F.lower(text))


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share. Only a local session that names none gets a temporary one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        folder = found.get() if found.isDefined() else None
    if folder is None:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="lumigraph-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, rows: int | None = None, per_file: int = 20_000) -> DataFrame:
    """Writes df as Parquet in the shared folder and reads it back: lineage ends there and lost executors cost nothing.

    Where it is known that df has and is made of no more than so many rows, they are dealt to tasks of per_file
    rows on average at least, so a small table isn't dealt over as many tasks and files as a large one."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    (df if rows is None else df.coalesce(-(-rows // per_file) or 1)).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.lumigraph_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a table that materialize() wrote, once nothing reads it any more."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df.lumigraph_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def connected_components(edges: DataFrame, most_edges: int | None = None, most_rounds: int = 60) -> DataFrame:
    """(node, component): component is the smallest node reachable, for every node of edges (src, dst), of which there are most_edges at most.

    Alternating large-star and small-star rounds over a written edge table. Each round is one
    partially aggregated minimum and one join, so a node with very many edges is spread by the
    map-side combine and by AQE's skew join. Ends when a round leaves the edges as they were.
    """
    def star(e: DataFrame, small: bool) -> DataFrame:
        both = e if small else e.unionByName(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        least = both.groupBy("src").agg(F.min("dst").alias("m")).select("src", F.least("src", "m").alias("m"))
        joined = both.join(least, "src")
        if small:
            moved = joined.select(F.col("dst").alias("src"), F.col("m").alias("dst"))
            return moved.unionByName(least.select("src", F.col("m").alias("dst"))).where("src <> dst").distinct()
        return joined.where("dst > src").select(F.col("dst").alias("src"), F.col("m").alias("dst")).where("src <> dst").distinct()

    def mark(e: DataFrame):
        return e.agg(F.count("*"), F.sum(F.xxhash64("src", "dst").cast("decimal(38,0)"))).first()

    now = materialize(edges.select(F.greatest("src", "dst").alias("src"), F.least("src", "dst").alias("dst")).where("src <> dst").distinct(), "edges", most_edges)
    before = mark(now)
    for _ in range(most_rounds if before[0] else 0):
        after = materialize(star(star(now, False), True), "edges", before[0])  # a round leaves no more edges than there were
        seen = mark(after)
        discard(now)
        now = after
        if seen == before:
            break
        before = seen
    else:
        if before[0]:
            raise RuntimeError(f"components not settled after {most_rounds} rounds")
    return now.select(F.col("src").alias("node"), F.col("dst").alias("component")).unionByName(now.select(F.col("dst").alias("node"), F.col("dst").alias("component")).distinct())
