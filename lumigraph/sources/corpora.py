"""Graphs and text corpora over plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigraph.schema import Graph

LANGS = ("rust", "python", "go", "java", "c")
EPOCH = "2024-01-01 00:00:00"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _minutes_after_epoch(n: Column) -> Column:
    return F.timestamp_seconds(F.unix_timestamp(F.lit(EPOCH)) + n * 60)


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files with content: <source>/<lang>/doc_<doc_id>.txt."""
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.concat("source", F.lit("/"), "lang", F.lit("/doc_"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"), "lang", F.sha2(F.col("text").cast("binary"), 256).alias("content_hash"), F.octet_length("text").cast("bigint").alias("size_bytes"), _minutes_after_epoch(F.col("doc_id")).alias("indexed_at"), F.col("text").alias("content"))


def supply_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Suppliers as files, parts as symbols, shipped items as calls and references, nations as modules.

    A part is defined in the file of the lowest supplier that ships it; an item shipped and returned (R) is a
    call, any other a reference. A nation's module resolves to the lowest supplier of the nation after it.
    """
    supplier, nation = table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    path = F.concat(F.lit("nation"), F.col("s_nationkey").cast("string"), F.lit("/supplier"), F.col("s_suppkey").cast("string"), F.lit(".src"))
    lang = F.element_at(F.array(*map(F.lit, LANGS)), (F.col("s_nationkey") % len(LANGS) + 1).cast("int"))
    own = supplier.select("s_suppkey", "s_nationkey", path.alias("path"), lang.alias("lang"), F.sha2(F.col("s_name").cast("binary"), 256).alias("content_hash"), (F.col("s_suppkey") * 100 + 1).alias("size_bytes"), _minutes_after_epoch(F.col("s_suppkey")).alias("indexed_at"))
    files = own.select("path", "lang", "content_hash", "size_bytes", "indexed_at")
    items = table(spark, sf_dir, "lineitem")
    part = table(spark, sf_dir, "part")
    home = items.groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.min("l_suppkey").alias("s_suppkey"))
    symbols = part.join(home, "p_partkey").join(own, "s_suppkey")
    qualname = F.concat("p_brand", F.lit("::"), "p_name")
    symbol_key = F.concat(F.lit("symbol:"), "path", F.lit(":"), qualname, F.lit(":"), "p_type", F.lit(":"), F.col("p_partkey").cast("string"), F.lit(":1"))
    symbols = symbols.select("path", "lang", F.col("p_name").alias("name"), symbol_key.alias("key"), F.col("p_partkey").alias("line"), (F.col("p_partkey") + F.col("p_size")).alias("end_line"), F.col("p_type").alias("kind"), qualname.alias("qualname"))
    uses = items.join(part.select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("name")), "l_partkey").join(own.select(F.col("s_suppkey").alias("l_suppkey"), "path", "lang"), "l_suppkey")
    uses = uses.select("path", "lang", "name", F.when(F.col("l_returnflag") == "R", "calls").otherwise("references").alias("edge_type"), F.col("l_orderkey").alias("line"), F.col("l_linenumber").cast("bigint").alias("col"))
    name_key = F.concat(F.lit("symbol_name:"), "lang", F.lit(":"), "name")
    file_key = F.concat(F.lit("file:"), F.col("path"))
    names = symbols.select("lang", "name").unionByName(uses.select("lang", "name")).distinct()
    imports = own.join(nation, own["s_nationkey"] == nation["n_nationkey"]).select("path", "lang", "s_nationkey", F.col("n_name").alias("name"), F.concat(F.lit("module:"), "lang", F.lit(":"), "n_name").alias("module_key"))
    first = own.groupBy(F.col("s_nationkey").alias("next")).agg(F.min(F.struct("s_suppkey", "path"))["path"].alias("to_path"))
    modules = imports.select("lang", "name", "module_key", "s_nationkey").distinct()
    count = nation.agg(F.count(F.lit(1)).cast("int").alias("nations"))
    resolved = modules.join(F.broadcast(count)).withColumn("next", (F.col("s_nationkey") + 1) % F.col("nations")).join(first, "next").select("module_key", "to_path")
    none = {c: F.lit(None).cast(t) for c, t in (("lang", "string"), ("file_path", "string"), ("line", "bigint"), ("col", "bigint"), ("end_line", "bigint"), ("end_col", "bigint"), ("kind", "string"), ("qualname", "string"))}

    def entity(rows: DataFrame, type_: str, key: Column, name: Column, **known: Column) -> DataFrame:
        return rows.select(F.lit(type_).alias("entity_type"), key.alias("key"), name.alias("name"), *[known.get(c, v).alias(c) for c, v in none.items()])

    entities = entity(own, "file", file_key, F.col("path"), lang=F.col("lang"), file_path=F.col("path"))
    entities = entities.unionByName(entity(symbols, "symbol", F.col("key"), F.col("name"), lang=F.col("lang"), file_path=F.col("path"), line=F.col("line"), col=F.lit(1).cast("bigint"), end_line=F.col("end_line"), end_col=F.lit(2).cast("bigint"), kind=F.col("kind"), qualname=F.col("qualname")))
    entities = entities.unionByName(entity(names, "symbol_name", name_key, F.col("name"), lang=F.col("lang"))).unionByName(entity(modules, "module", F.col("module_key"), F.col("name"), lang=F.col("lang")))

    def edge(rows: DataFrame, kind: Column, src: Column, dst: Column, path: Column, line: Column, col: Column) -> DataFrame:
        at = [path.cast("string").alias("file_path"), line.cast("bigint").alias("line"), col.cast("bigint").alias("col")]
        return rows.select(src.alias("src_key"), dst.alias("dst_key"), kind.alias("edge_type"), *at, F.lit(None).cast("bigint").alias("end_line"), F.lit(None).cast("bigint").alias("end_col"))

    path, line, one, null = F.col("path"), F.col("line"), F.lit(1), F.lit(None)
    edges = edge(symbols, F.lit("defines"), file_key, F.col("key"), path, line, one).unionByName(edge(symbols, F.lit("names"), F.col("key"), name_key, path, line, one))
    edges = edges.unionByName(edge(uses, F.col("edge_type"), file_key, name_key, path, line, F.col("col"))).unionByName(edge(imports, F.lit("imports"), file_key, F.col("module_key"), path, one, one))
    to_key = F.concat(F.lit("file:"), F.col("to_path"))
    edges = edges.unionByName(edge(resolved, F.lit("resolves_to"), F.col("module_key"), to_key, null, null, null))
    edges = edges.unionByName(edge(imports.join(resolved, "module_key"), F.lit("depends_on"), file_key, to_key, path, one, one))
    return Graph(files, entities, edges)
