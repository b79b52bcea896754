"""Graph queries: definitions, references, paths, slices, freshness."""

from __future__ import annotations

import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumigraph.functions.scores import edge_score, reference_score, reference_why
from lumigraph.functions.text import path_glob
from lumigraph.plans.paging import page, reference_order
from lumigraph.plans.selectors import resolve_selector
from lumigraph.schema import SCHEMA_VERSION, Graph


def _named(graph: Graph, name: str) -> DataFrame:
    """Keys of the names in all languages: as many rows as languages at most."""
    return graph.entities.where((F.col("entity_type") == "symbol_name") & (F.col("name") == name)).select(F.col("key").alias("name_key"))


def _definitions(graph: Graph, name: str) -> DataFrame:
    links = graph.edges.where("edge_type = 'names'").select("src_key", "dst_key")
    keys = links.join(F.broadcast(_named(graph, name)), links["dst_key"] == F.col("name_key"), "left_semi").select(F.col("src_key").alias("key"))
    return graph.entities.where("entity_type = 'symbol'").join(keys, "key", "left_semi")


def symbol_definitions(graph: Graph, name: str) -> DataFrame:
    """Where a name is defined, in every language, by file and line."""
    found = _definitions(graph, name)
    columns = [F.lit(name).alias("symbol_name"), "file_path", "line", "col", "end_line", "end_col", F.coalesce("kind", F.lit("unknown")).alias("kind"), F.coalesce("qualname", F.lit(name)).alias("qualname")]
    return found.select(*columns).orderBy("file_path", "line", "col")


def references(graph: Graph, name: str, edge_type: str | None = None, file_glob: str | None = None, language: str | None = None, max_age_hours: int | None = None, now: datetime.datetime | None = None, dedup: bool = True) -> DataFrame:
    """All references to a name, scored, unordered. now is the clock that max_age_hours counts back from."""
    kinds = [edge_type] if edge_type else ["references", "calls"]
    edges = graph.edges.where(F.col("edge_type").isin(*kinds))
    if file_glob is not None:
        edges = edges.where(path_glob(F.col("file_path"), file_glob))
    found = edges.join(F.broadcast(_named(graph, name)), edges["dst_key"] == F.col("name_key"), "left_semi").select("file_path", "line", "col", "edge_type")
    if language is not None or max_age_hours is not None:
        files = graph.files
        if language is not None:
            files = files.where(F.col("lang") == language)
        if max_age_hours is not None:
            since = (now or datetime.datetime.now(datetime.UTC).replace(tzinfo=None)) - datetime.timedelta(hours=max_age_hours)
            files = files.where(F.col("indexed_at") >= F.lit(since.strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp"))
        found = found.join(files.select(F.col("path").alias("file_path")), "file_path", "left_semi")
    if dedup:
        found = found.dropDuplicates(["file_path", "line", "col", "edge_type"])
    homes = _definitions(graph, name).select("file_path").distinct().withColumn("home", F.lit(True))
    found = found.join(homes, "file_path", "left")
    home = F.col("home").isNotNull()
    return found.select(F.lit(name).alias("symbol_name"), "file_path", "line", "col", "edge_type", reference_score(F.col("edge_type"), home).alias("score"), reference_why(F.col("edge_type"), home).alias("why"))


def symbol_references(graph: Graph, name: str, order: str = "score_desc", limit: int = 200, offset: int = 0, **options) -> DataFrame:
    """A page of references; see references() for the options."""
    return page(references(graph, name, **options), [*reference_order(order), F.col("edge_type")], limit, offset)


def symbol_callers(graph: Graph, name: str, **options) -> DataFrame:
    return symbol_references(graph, name, edge_type="calls", **options)


def top_reference_files(rows: DataFrame, limit: int = 10) -> DataFrame:
    """Files by their number of the given rows; of a page when the rows are one."""
    return rows.groupBy("file_path").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "file_path").limit(limit)


def _checkpointed(df: DataFrame) -> DataFrame:
    """Cuts the lineage between levels; in the shared folder where the session names one."""
    from lumigraph.plans.storage import checkpointed

    return checkpointed(df)


def reachable(graph: Graph, start: DataFrame, max_depth: int, until: str | None = None) -> DataFrame:
    """(key, depth, path) of what the outgoing edges reach from start (key) in max_depth steps, by the fewest; path is the least of keys among those.

    A level is one join of the new keys with the edges and one anti-join with those seen, so a level costs
    what its edges cost, which are written once; nothing returns to the driver but whether a level is empty or holds until.
    """
    edges = _checkpointed(graph.edges.select("src_key", "dst_key").distinct())
    seen = new = _checkpointed(start.select("key", F.lit(0).alias("depth"), F.array("key").alias("path")))
    for depth in range(1, max_depth + 1):
        if until is not None and not new.where(F.col("key") == until).isEmpty():
            break
        step = new.join(edges, new["key"] == edges["src_key"]).select(F.col("dst_key").alias("key"), "path")
        step = step.join(seen.select("key"), "key", "left_anti").groupBy("key").agg(F.min("path").alias("before"))
        new = _checkpointed(step.select("key", F.lit(depth).alias("depth"), F.concat("before", F.array("key")).alias("path")))
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    return seen


def dependency_path(graph: Graph, source: str, target: str, max_depth: int = 8) -> DataFrame:
    """The hops (hop, entity_key, entity_name, entity_type) of a shortest path between two selectors, both ends
    included; no rows where there is none in max_depth steps or an end is unknown. Of several the least by keys."""
    a, b = (resolve_selector(graph, s).select("key") for s in (source, target))
    end = b.first()
    empty = graph.entities.where("false").select(F.lit(0).alias("hop"), F.col("key").alias("entity_key"), F.col("name").alias("entity_name"), F.col("entity_type"))
    if end is None:
        return empty
    path = reachable(graph, a, max_depth, until=end[0]).where(F.col("key") == end[0]).select(F.posexplode("path").alias("hop", "entity_key"))
    names = graph.entities.select(F.col("key").alias("entity_key"), F.col("name").alias("entity_name"), "entity_type")
    return names.join(F.broadcast(path), "entity_key").select("hop", "entity_key", "entity_name", "entity_type").orderBy("hop")


def anchor(graph: Graph, file_path: str, line: int | None = None) -> DataFrame:
    """The innermost symbol around a line, else the file itself."""
    own = graph.entities.where(F.col("file_path") == file_path)
    file = own.where("entity_type = 'file'").withColumn("span", F.lit(None).cast("bigint")).withColumn("kind_of_anchor", F.lit(1))
    if line is None:
        return file.drop("span", "kind_of_anchor").limit(1)
    around = own.where((F.col("entity_type") == "symbol") & F.lit(line).between(F.col("line"), F.col("end_line"))).withColumn("span", F.col("end_line") - F.col("line")).withColumn("kind_of_anchor", F.lit(0))
    return around.unionByName(file).orderBy("kind_of_anchor", "span", "key").limit(1).drop("span", "kind_of_anchor")


def neighbors(graph: Graph, start: DataFrame, depth: int = 2, max_neighbors: int = 40, dedup: bool = True, prefer_project: bool = True) -> DataFrame:
    """Edges on either side of start (key) and of what they lead to, level by level, scored, before any cut.

    A level that brings the number to max_neighbors is the last. The start may come back as a neighbour.
    """
    edges = _checkpointed(graph.edges.select("src_key", "dst_key", "edge_type"))
    both = edges.select(F.col("src_key").alias("at"), F.col("dst_key").alias("key"), "edge_type", F.lit("outgoing").alias("direction"))
    both = both.unionByName(edges.select(F.col("dst_key").alias("at"), F.col("src_key").alias("key"), "edge_type", F.lit("incoming").alias("direction")))
    seen = new = _checkpointed(start.select("key"))
    out = None
    for level in range(1, depth + 1):
        step = both.join(new.select(F.col("key").alias("at")), "at").select("key", "edge_type", "direction", F.lit(level).alias("depth"))
        if dedup:
            step = step.dropDuplicates(["direction", "edge_type", "key"])
            if out is not None:
                step = step.join(out.select("direction", "edge_type", "key"), ["direction", "edge_type", "key"], "left_anti")
        step = _checkpointed(step)
        out = step if out is None else out.unionByName(step)
        if level == depth or (max_neighbors and out.limit(max_neighbors).count() >= max_neighbors):
            break
        new = _checkpointed(step.select("key").distinct().join(seen, "key", "left_anti"))
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
    named = graph.entities.select("key", "entity_type", "name", "file_path", "line").join(out, "key")
    score = edge_score(F.col("edge_type"), F.col("direction"), F.col("depth"), F.col("entity_type"), F.col("name"), prefer_project)
    why = F.concat(F.lit("edge_type="), "edge_type", F.lit(",direction="), "direction", F.lit(",depth="), F.col("depth").cast("string"))
    return named.withColumn("score", score).withColumn("why", why)


def slice_order() -> list[Column]:
    return [F.col("score").desc(), F.col("edge_type"), F.col("direction"), F.col("key")]


def minimal_slice(graph: Graph, file_path: str, line: int | None = None, depth: int = 2, max_neighbors: int = 40, dedup: bool = True, suppress_repeats: bool = True, name_cap: int = 1, prefer_project: bool = True) -> DataFrame:
    """The neighbourhood of a place: neighbours in order of score, max_neighbors of them (0: all), and of those at
    most name_cap names of one spelling."""
    found = neighbors(graph, anchor(graph, file_path, line), depth, max_neighbors, dedup, prefer_project)
    if max_neighbors:
        found = found.orderBy(*slice_order()).limit(max_neighbors)
    if suppress_repeats:
        rank = F.row_number().over(Window.partitionBy("entity_type", "name").orderBy(*slice_order()))
        found = found.withColumn("rank", rank).where((F.col("entity_type") != "symbol_name") | (F.col("rank") <= max(1, name_cap))).drop("rank")
    return found.orderBy(*slice_order())


def freshness_info(files: DataFrame, now: datetime.datetime, stale_after_hours: int = 24) -> DataFrame:
    """One row: file_count, latest_indexed_at, schema_version, stale_after_hours, is_stale. An empty index is stale."""
    since = F.lit((now - datetime.timedelta(hours=stale_after_hours)).strftime("%Y-%m-%d %H:%M:%S")).cast("timestamp")
    out = files.agg(F.count(F.lit(1)).alias("file_count"), F.max("indexed_at").alias("latest"))
    return out.select("file_count", F.date_format("latest", "yyyy-MM-dd HH:mm:ss").alias("latest_indexed_at"), F.lit(SCHEMA_VERSION).alias("schema_version"), F.lit(stale_after_hours).cast("bigint").alias("stale_after_hours"), F.coalesce(F.col("latest") < since, F.lit(True)).alias("is_stale"))


def index_warning(files: DataFrame, now: datetime.datetime, stale_after_hours: int = 24) -> DataFrame:
    """One row: warning, null if all is well."""
    info = freshness_info(files, now, stale_after_hours)
    text = F.when(F.col("file_count") == 0, "index is empty; index the repository before querying").when(F.col("latest_indexed_at").isNull(), "index timestamp unavailable; results may be partial")
    return info.select(text.when(F.col("is_stale"), F.concat(F.lit("index appears stale (latest indexed_at="), "latest_indexed_at", F.lit("); consider re-indexing"))).alias("warning"))
