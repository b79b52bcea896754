"""Index maintenance: from scanned files to graph tables, in snapshots."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigraph import schema
from lumigraph.operators.clones import fingerprint_files
from lumigraph.operators.imports import resolve_imports
from lumigraph.schema import Graph
from lumigraph.sources.extract import extract
from lumigraph.sources.repo import scan, special_type

TABLES = {"files": schema.FILES, "entities": schema.ENTITIES, "edges": schema.EDGES, "fingerprints": schema.FINGERPRINTS}


def diff_files(new: DataFrame, old: DataFrame, full: bool = False) -> DataFrame:
    """(path, change): added, changed, unchanged or removed, of two listings (path, content_hash).

    With full every file that is there counts as changed or added.
    """
    both = new.select("path", F.col("content_hash").alias("now")).join(old.select("path", F.col("content_hash").alias("before")), "path", "full_outer")
    change = F.when(F.col("now").isNull(), "removed").when(F.col("before").isNull(), "added")
    change = change.otherwise("changed") if full else change.when(F.col("now") == F.col("before"), "unchanged").otherwise("changed")
    return both.select("path", change.alias("change"))


def upsert_entities(old: DataFrame, new: DataFrame) -> DataFrame:
    """Entities by key: type and name of the new row where there is one, other columns the new value or else the old."""
    rest = [c for c in old.columns if c not in ("key", "entity_type", "name")]
    a, b = old.alias("a"), new.dropDuplicates(["key"]).alias("b")
    pick = lambda c: F.coalesce(F.col(f"b.{c}"), F.col(f"a.{c}")).alias(c)
    return a.join(b, F.col("a.key") == F.col("b.key"), "full_outer").select(pick("entity_type"), pick("key"), pick("name"), *[pick(c) for c in rest])


def remove_files(graph: Graph, gone: DataFrame) -> Graph:
    """The graph without some files (path), their entities and edges, and without edges of others into them."""
    paths = gone.select(F.col("path").alias("file_path")).distinct()
    keys = paths.select(F.concat(F.lit("file:"), "file_path").alias("key"))
    entities = graph.entities.join(paths, "file_path", "left_anti").join(keys, "key", "left_anti").select(graph.entities.columns)
    edges = graph.edges.join(paths, "file_path", "left_anti").select(graph.edges.columns)
    lost = graph.entities.join(paths, "file_path", "left_semi").select("key").unionByName(keys).distinct()
    for end in ("src_key", "dst_key"):
        edges = edges.join(lost.select(F.col("key").alias(end)), end, "left_anti").select(graph.edges.columns)
    fingerprints = graph.fingerprints.join(paths, "file_path", "left_anti").select(graph.fingerprints.columns) if graph.fingerprints is not None else None
    return Graph(graph.files.join(gone.select("path"), "path", "left_anti"), entities, edges, fingerprints)


def drop_orphans(entities: DataFrame, edges: DataFrame) -> DataFrame:
    """Entities without those names and modules that no edge touches."""
    used = edges.select(F.explode(F.array("src_key", "dst_key")).alias("key")).distinct()
    # one join marks what is used; every other type stays whether it is or not
    marked = entities.join(used.withColumn("used", F.lit(True)), "key", "left")
    return marked.where(F.col("used") | ~F.col("entity_type").isin("symbol_name", "module")).select(entities.columns)


def build_graph(files: DataFrame, listing: DataFrame) -> Graph:
    """The graph of files (path, lang, content_hash, size_bytes, indexed_at, content); imports resolve within listing (path)."""
    from lumigraph.plans.storage import checkpointed

    parsed = checkpointed(extract(files.select("path", "lang", "content")))
    file_key = F.concat(F.lit("file:"), F.col("path"))
    null, long = F.lit(None), "bigint"

    def entity(rows: DataFrame, type_, key, name, **known) -> DataFrame:
        types = {"lang": "string", "file_path": "string", "line": long, "col": long, "end_line": long, "end_col": long, "kind": "string", "qualname": "string"}
        return rows.select(type_.alias("entity_type"), key.alias("key"), name.alias("name"), *[known.get(c, null).cast(t).alias(c) for c, t in types.items()])

    def edge(rows: DataFrame, kind, src, dst, **at) -> DataFrame:
        types = {"file_path": "string", "line": long, "col": long, "end_line": long, "end_col": long}
        return rows.select(src.alias("src_key"), dst.alias("dst_key"), kind.alias("edge_type"), *[at.get(c, null).cast(t).alias(c) for c, t in types.items()])

    place = {c: F.col(c) for c in ("line", "col", "end_line", "end_col")}
    definitions = parsed.select("path", "lang", F.inline("definitions"))
    references = parsed.select("path", "lang", F.inline("references"))
    imports = parsed.select("path", "lang", F.inline("imports"))
    symbol_key = F.concat_ws(":", F.lit("symbol"), "path", "qualname", "kind", F.col("line").cast("string"), F.col("col").cast("string"))
    name_key = F.concat_ws(":", F.lit("symbol_name"), "lang", "name")
    module_key = F.concat_ws(":", F.lit("module"), "lang", "module")
    names = definitions.select("lang", "name").unionByName(references.select("lang", "name")).distinct()
    special = files.select("path", "lang", special_type(F.col("path")).alias("special")).where("special is not null")
    special_key = F.concat_ws(":", "special", "path")
    resolved = resolve_imports(imports, listing)
    target = F.concat(F.lit("file:"), F.col("resolved"))
    entities = entity(files, F.lit("file"), file_key, F.col("path"), lang=F.col("lang"), file_path=F.col("path"))
    entities = entities.unionByName(entity(definitions, F.lit("symbol"), symbol_key, F.col("name"), lang=F.col("lang"), file_path=F.col("path"), kind=F.col("kind"), qualname=F.col("qualname"), **place))
    entities = entities.unionByName(entity(names, F.lit("symbol_name"), name_key, F.col("name"), lang=F.col("lang")))
    entities = entities.unionByName(entity(imports.select("lang", "module").distinct(), F.lit("module"), module_key, F.col("module"), lang=F.col("lang")))
    entities = entities.unionByName(entity(special, F.col("special"), special_key, F.col("path"), lang=F.col("lang"), file_path=F.col("path")))
    own = {"file_path": F.col("path")}
    edges = edge(definitions, F.lit("defines"), file_key, symbol_key, **own, **place).unionByName(edge(definitions, F.lit("names"), symbol_key, name_key, **own, **place))
    edges = edges.unionByName(edge(references, F.col("edge_type"), file_key, name_key, **own, **place))
    edges = edges.unionByName(edge(imports, F.lit("imports"), file_key, module_key, line=F.col("line"), col=F.col("col"), **own))
    edges = edges.unionByName(edge(resolved, F.lit("resolves_to"), module_key, target, **own)).unionByName(edge(resolved, F.lit("depends_on"), file_key, target, **own))
    edges = edges.unionByName(edge(special, F.lit("contains"), file_key, special_key, **own))
    return Graph(files.drop("content"), entities, edges, fingerprint_files(files), parsed.where("error is not null").select("path", "error"))


class Snapshots:
    """Graph tables under a folder: a directory for each snapshot, and a file that names the one in force.

    A snapshot is written in full before it is named, so readers see the old one or the new one.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self._path = lambda p: jvm.org.apache.hadoop.fs.Path(p)
        self._fs = self._path(self.folder).getFileSystem(spark._jsc.hadoopConfiguration())

    def current(self) -> int:
        """The number of the snapshot in force; 0 before the first."""
        root = self._path(f"{self.folder}/manifest")
        if not self._fs.exists(root):
            return 0
        return max((int(s.getPath().getName()) for s in self._fs.listStatus(root)), default=0)

    def read(self) -> Graph:
        n = self.current()
        if not n:
            return Graph(*[self.spark.createDataFrame([], s) for s in TABLES.values()])
        return Graph(*[self.spark.read.schema(s).parquet(f"{self.folder}/{n}/{t}") for t, s in TABLES.items()])

    def write(self, graph: Graph) -> int:
        n = self.current() + 1
        self._fs.delete(self._path(f"{self.folder}/{n}"), True)
        for t in TABLES:
            part = {"entities": ["entity_type"], "edges": ["edge_type"]}.get(t, [])
            getattr(graph, t).write.partitionBy(*part).parquet(f"{self.folder}/{n}/{t}")
        if not self._fs.createNewFile(self._path(f"{self.folder}/manifest/{n}")):
            raise RuntimeError(f"snapshot {n} was written by another index run")
        return n


def update(graph: Graph, files: DataFrame, full: bool = False) -> tuple[Graph, DataFrame]:
    """(new graph, changes): only files whose content hash differs are parsed again; those that are gone go.

    Edges into a file are made anew from every importing file's modules when the file returns.
    """
    from lumigraph.plans.storage import checkpointed

    changes = checkpointed(diff_files(files, graph.files, full))
    stale = changes.where("change in ('changed', 'removed')").select("path")
    kept = remove_files(graph, stale)
    todo = files.join(changes.where("change in ('changed', 'added')").select("path"), "path", "left_semi")
    new = build_graph(todo, files.select("path"))
    # others' imports of files that have been replaced: the same edges, as the target's key is the same
    back = graph.edges.where("edge_type in ('depends_on', 'resolves_to')").join(files.select(F.concat(F.lit("file:"), "path").alias("dst_key")), "dst_key", "left_semi")
    back = back.join(stale.select(F.col("path").alias("file_path")), "file_path", "left_anti").select(graph.edges.columns)
    edges = kept.edges.where("edge_type not in ('depends_on', 'resolves_to')").unionByName(back).unionByName(new.edges)
    entities = drop_orphans(upsert_entities(kept.entities, new.entities), edges)
    columns = graph.files.columns
    return Graph(kept.files.select(columns).unionByName(new.files.select(columns)), entities, edges, kept.fingerprints.unionByName(new.fingerprints), new.errors), changes


def index_repository(spark: SparkSession, root: str, folder: str, full: bool = False, most_errors: int = 1000) -> dict:
    """Brings the snapshots in folder up to date with a repository; returns the report, which counts all failures and names the first most_errors."""
    store = Snapshots(spark, folder)
    files, errors = scan(spark, root)
    graph, changes = update(store.read(), files, full)
    store.write(graph)
    n = {r.change: r["count"] for r in changes.groupBy("change").count().collect()}
    errors = errors.unionByName(graph.errors)
    failed = [f"{r.path}: {r.error}" for r in errors.orderBy("path").limit(most_errors).collect()]
    return {"indexed_files": n.get("added", 0) + n.get("changed", 0), "skipped_files": n.get("unchanged", 0), "removed_files": n.get("removed", 0), "parse_failures": errors.count(), "errors": failed, "finished_at": datetime.datetime.now(datetime.UTC).isoformat(timespec="seconds")}
