"""Queries over the driver tables, each with the SQL that says the same."""

from __future__ import annotations

import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigraph.functions.scores import low_signal, project_local
from lumigraph.functions.text import code_tokens, file_glob, hash64, lines_of, parent_dir, path_glob, subsequence_ratio
from lumigraph.operators import clones, discover, files, graph, imports, index
from lumigraph.plans import paging, selectors
from lumigraph.schema import Graph
from lumigraph.sources import repo
from lumigraph.sources.corpora import document_files, supply_graph, table
from lumigraph.sources.extract import extract
from lumigraph.streaming import watch

NOW = datetime.datetime(2024, 1, 2, 0, 30)

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


# The supply graph in SQL.
_OWN = """own as (select s_suppkey, s_nationkey, 'nation' || s_nationkey || '/supplier' || s_suppkey || '.src' as path, ['rust','python','go','java','c'][s_nationkey % 5 + 1] as lang,
  sha256(s_name) as content_hash, s_suppkey * 100 + 1 as size_bytes, timestamp '2024-01-01' + to_minutes(s_suppkey) as indexed_at from supplier)"""
_GRAPH = f"""{_OWN},
home as (select l_partkey as p_partkey, min(l_suppkey) as s_suppkey from lineitem group by 1),
symbols as (select path, lang, p_name as name, 'symbol:' || path || ':' || p_brand || '::' || p_name || ':' || p_type || ':' || p_partkey || ':1' as key, p_partkey as line, p_partkey + p_size as end_line, p_type as kind, p_brand || '::' || p_name as qualname
  from part join home using (p_partkey) join own using (s_suppkey)),
uses as (select path, lang, p_name as name, case when l_returnflag = 'R' then 'calls' else 'references' end as edge_type, l_orderkey as line, l_linenumber::bigint as col from lineitem join part on p_partkey = l_partkey join own on s_suppkey = l_suppkey),
modules as (select distinct lang, n_name as name, 'module:' || lang || ':' || n_name as key, n_nationkey from own join nation on s_nationkey = n_nationkey),
firsts as (select s_nationkey as nation, arg_min(path, s_suppkey) as to_path from own group by 1),
resolved as (select key, to_path from modules join firsts on nation = (n_nationkey + 1) % (select count(*) from nation)),
entities as (select 'file' as entity_type, 'file:' || path as key, path as name, path as file_path, null::bigint as line, null::bigint as end_line from own
  union all select 'symbol', key, name, path, line, end_line from symbols
  union all select distinct 'symbol_name', 'symbol_name:' || lang || ':' || name, name, null, null::bigint, null::bigint from (select lang, name from symbols union all select lang, name from uses)
  union all select 'module', key, name, null, null::bigint, null::bigint from modules),
imported as (select path, key from own join nation on s_nationkey = n_nationkey join modules using (n_nationkey, lang)),
edges as (select 'file:' || path as src_key, key as dst_key, 'defines' as edge_type, path as file_path from symbols
  union all select key, 'symbol_name:' || lang || ':' || name, 'names', path from symbols
  union all select 'file:' || path, 'symbol_name:' || lang || ':' || name, edge_type, path from uses
  union all select 'file:' || path, key, 'imports', path from imported
  union all select key, 'file:' || to_path, 'resolves_to', null from resolved
  union all select 'file:' || path, 'file:' || to_path, 'depends_on', path from imported join resolved using (key))"""
NAME = "part_5"


def _pick(spark: SparkSession, sf_dir: str) -> str:
    """The least of the parts' names: there at every size."""
    return table(spark, sf_dir, "part").agg(F.min("p_name")).first()[0]


_NAME = "(select min(p_name) from part)"


def _references(where: str = "", order: str = "score desc, file_path, line, col, edge_type", limit: str = "limit 200", distinct: str = "distinct") -> str:
    return f"""with {_GRAPH}, defs as (select distinct path from symbols where name = {_NAME}),
found as (select {distinct} u.name as symbol_name, u.path as file_path, u.line, u.col, u.edge_type from uses u join own using (path) where u.name = {_NAME} {where})
select symbol_name, file_path, line, col, edge_type, case when edge_type = 'calls' then 2.0::double else 1.0::double end + case when file_path in (select path from defs) then 0.35::double else 0.0::double end as score,
  'edge_type=' || edge_type || case when file_path in (select path from defs) then ',same_file_as_definition' else '' end as why from found order by {order} {limit}"""


@query(f"with {_GRAPH} select name as symbol_name, path as file_path, line, 1::bigint as col, end_line, 2::bigint as end_col, kind, qualname from symbols where name = {_NAME}")
def symbol_definitions(spark, sf_dir):
    return graph.symbol_definitions(supply_graph(spark, sf_dir), _pick(spark, sf_dir))


@query(_references())
def symbol_references(spark, sf_dir):
    return graph.symbol_references(supply_graph(spark, sf_dir), _pick(spark, sf_dir))


@query(_references(order="file_path, line, col, edge_type", limit="limit 50 offset 10"))
def symbol_references_line_asc(spark, sf_dir):
    return graph.symbol_references(supply_graph(spark, sf_dir), _pick(spark, sf_dir), order="asc", limit=50, offset=10)


@query(_references(order="file_path desc, line desc, col desc, edge_type", limit="limit 50"))
def symbol_references_line_desc(spark, sf_dir):
    return graph.symbol_references(supply_graph(spark, sf_dir), _pick(spark, sf_dir), order="line_desc", limit=50)


@query(_references("and u.path glob 'nation1*/supplier?*.src'"))
def symbol_references_glob(spark, sf_dir):
    return graph.symbol_references(supply_graph(spark, sf_dir), _pick(spark, sf_dir), file_glob="nation1*\\supplier?*.src")


@query(_references("and own.lang = 'python'"))
def symbol_references_language(spark, sf_dir):
    return graph.symbol_references(supply_graph(spark, sf_dir), _pick(spark, sf_dir), language="python")


@query(_references("and own.indexed_at >= timestamp '2024-01-01 00:30:00'"))
def symbol_references_max_age(spark, sf_dir):
    return graph.symbol_references(supply_graph(spark, sf_dir), _pick(spark, sf_dir), max_age_hours=24, now=NOW)


@query(_references(distinct=""))
def symbol_references_all_rows(spark, sf_dir):
    return graph.symbol_references(supply_graph(spark, sf_dir), _pick(spark, sf_dir), dedup=False)


@query(_references("and u.edge_type = 'calls'"))
def symbol_callers(spark, sf_dir):
    return graph.symbol_callers(supply_graph(spark, sf_dir), _pick(spark, sf_dir))


@query(f"with page as ({_references()}) select file_path, count(*) as count from page group by 1 order by count desc, file_path limit 10")
def top_reference_files(spark, sf_dir):
    return graph.top_reference_files(graph.symbol_references(supply_graph(spark, sf_dir), _pick(spark, sf_dir)))


@query(f"with rows as ({_references(limit='')}), n as (select count(*) as total from rows), p as (select total, least(10, total) as \"offset\", 50::bigint as \"limit\", least(50, total - least(10, total)) as returned from n) select *, \"offset\" + returned < total as has_more, case when \"offset\" + returned < total then \"offset\" + returned end as next_offset from p")
def references_page(spark, sf_dir):
    return paging.pagination(graph.references(supply_graph(spark, sf_dir), _pick(spark, sf_dir)), limit=50, offset=10)


# Paths and slices.
_START = "(select arg_min(path, s_suppkey) from own)"


def _first_file(spark: SparkSession, sf_dir: str) -> str:
    row = table(spark, sf_dir, "supplier").agg(F.min(F.struct("s_suppkey", "s_nationkey")).alias("s")).first().s
    return f"nation{row.s_nationkey}/supplier{row.s_suppkey}.src"


@query(f"""with recursive {_GRAPH}, reach(key, depth) as (select 'file:' || {_START}, 0 union select dst_key, depth + 1 from reach join (select distinct src_key, dst_key from edges where edge_type in ('imports', 'resolves_to', 'depends_on')) on src_key = key where depth < 4)
select key, min(depth)::int as depth from reach group by key""")
def reachable_within(spark, sf_dir):
    g = supply_graph(spark, sf_dir)
    g = Graph(g.files, g.entities, g.edges.where("edge_type in ('imports', 'resolves_to', 'depends_on')"))
    start = spark.createDataFrame([(f"file:{_first_file(spark, sf_dir)}",)], "key string")
    return graph.reachable(g, start, 4).select("key", "depth")


@query(f"""with recursive {_GRAPH}, steps as (select distinct src_key, dst_key from edges where src_key like 'file:%' or src_key like 'module:%'),
target as (select max(file_path) as path from edges where edge_type = 'depends_on'), reach(key, depth) as (select 'file:' || {_START}, 0 union select dst_key, depth + 1 from reach join steps on src_key = key where depth < 8 and dst_key not like 'symbol%'),
hit as (select min(depth) as hops from reach, target where key = (select 'module:' || lang || ':' || name from modules order by n_nationkey limit 1))
select coalesce((select hops from hit), -1)::bigint as hops""")
def dependency_path_hops(spark, sf_dir):
    g = supply_graph(spark, sf_dir)
    row = table(spark, sf_dir, "supplier").agg(F.min("s_nationkey").alias("k")).first()
    module = g.entities.where("entity_type = 'module'").join(table(spark, sf_dir, "nation").where(F.col("n_nationkey") == row.k).select(F.col("n_name").alias("name")), "name", "left_semi").first()
    hops = graph.dependency_path(g, f"file:{_first_file(spark, sf_dir)}", f"key:{module.key}")
    return hops.agg((F.count(F.lit(1)) - 1).alias("hops"))


_WEIGHT = "case edge_type when 'calls' then 2.5 when 'depends_on' then 2.2 when 'imports' then 2.0 when 'defines' then 1.8 when 'references' then 1.2 when 'names' then 0.8 when 'contains' then 0.6 else 1.0 end::double"
_LOW = "('Ok','Err','Some','None','Result','Option','String','Vec','Box','Self','self')"
_STANDARD = "('string','str','vec','box','result','option','path','pathbuf','hashmap','hashset','usize','u64','i64','bool')"
_SCORE = f"greatest(0.0::double, {_WEIGHT} + case when direction = 'outgoing' then 0.2::double else 0.0::double end - (depth - 1)::double * 0.25::double + case when entity_type <> 'symbol_name' then 0.0::double when name in {_LOW} then -1.3::double when strlen(name) > 2 and lower(name) not in {_STANDARD} then 0.35::double else 0.0::double end)"


def _slice(anchor: str, cut: bool = True) -> str:
    inner = f"""with {_GRAPH}, anchor as ({anchor}),
sides as (select src_key as base, dst_key as key, edge_type, 'outgoing' as direction from edges union all select dst_key, src_key, edge_type, 'incoming' from edges),
one as (select distinct key, edge_type, direction from sides where base in (select key from anchor)),
enough as (select count(*) >= 40 as yes from one),
two as (select distinct key, edge_type, direction from sides where base in (select key from one) and base not in (select key from anchor)),
found as (select key, edge_type, direction, 1 as depth from one union all select key, edge_type, direction, 2 from two where not (select yes from enough) and (key, edge_type, direction) not in (select (key, edge_type, direction) from one)),
scored as (select f.*, e.entity_type, e.name, e.file_path, e.line, {_SCORE} as score, 'edge_type=' || edge_type || ',direction=' || direction || ',depth=' || depth as why from found f join entities e using (key)),
cut as (select * from scored order by score desc, edge_type, direction, key limit 40)
"""
    return inner + ("select key, entity_type, name, file_path, line, edge_type, direction, depth, score, why from (select *, row_number() over (partition by entity_type, name order by score desc, edge_type, direction, key) as rank from cut) where entity_type <> 'symbol_name' or rank <= 1" if cut else "select edge_type, direction, count(*) as n, min(score) as least, max(score) as most from scored group by all")


@query(_slice(f"select 'file:' || {_START} as key"))
def minimal_slice_file(spark, sf_dir):
    return graph.minimal_slice(supply_graph(spark, sf_dir), _first_file(spark, sf_dir))


_ANCHOR = f"select key from (select key, 0 as k, end_line - line as span from symbols where path = {_START} and (select min(line) + 1 from symbols where path = {_START}) between line and end_line union all select 'file:' || {_START}, 1, null) order by k, span, key limit 1"


def _line(spark: SparkSession, g: Graph, path: str) -> int:
    return g.entities.where((F.col("entity_type") == "symbol") & (F.col("file_path") == path)).agg(F.min("line")).first()[0] + 1


@query(_slice(_ANCHOR))
def minimal_slice_line(spark, sf_dir):
    g, path = supply_graph(spark, sf_dir), _first_file(spark, sf_dir)
    return graph.minimal_slice(g, path, line=_line(spark, g, path))


@query(_slice(f"select 'file:' || {_START} as key", cut=False))
def slice_scores(spark, sf_dir):
    g = supply_graph(spark, sf_dir)
    found = graph.neighbors(g, graph.anchor(g, _first_file(spark, sf_dir)), depth=2, max_neighbors=40)
    return found.groupBy("edge_type", "direction").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least"), F.max("score").alias("most"))


@query(f"with {_GRAPH} {_ANCHOR}")
def anchor_symbol_for_line(spark, sf_dir):
    g, path = supply_graph(spark, sf_dir), _first_file(spark, sf_dir)
    return graph.anchor(g, path, _line(spark, g, path)).select("key")


# Clones.
_PRINTS = """tokens as (select path, regexp_extract_all(lower_ascii, '[a-z0-9_]+') as ts from (select source || '/' || lang || '/doc_' || doc_id || '.txt' as path, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as lower_ascii from documents)),
grams as (select path, i, array_to_string(ts[i + 1:i + 5], ' ') as g, len(ts) - 4 as n from (select path, ts, unnest(range(0, greatest(0, len(ts) - 4))) as i from tokens)),
hashed as (select path, i, n, case when u >= 9223372036854775808::hugeint then u - 18446744073709551616::hugeint else u end::bigint as h from (select path, i, n, ('0x' || substr(sha256(g), 1, 16))::ubigint::hugeint as u from grams)),
picked as (select path, i, n, h, min({'hh': h, 'ii': i}) over (partition by path order by i rows between current row and 3 following) as low from hashed),
prints as (select distinct path as file_path, low.hh as fp_hash, low.ii as span_start, low.ii + 5 as span_end from picked where n > 4 and i <= n - 4 union all select path, h, i, i + 5 from hashed where n <= 4)"""
_BASE = "(select source || '/' || lang || '/doc_' || doc_id || '.txt' from documents order by doc_id limit 1)"
_CLONES = f"""{_PRINTS}, sets as (select distinct file_path, fp_hash from prints), own as (select fp_hash from sets where file_path = {_BASE}), totals as (select file_path, count(*) as total from sets group by 1),
candidates as (select s.file_path as other_file, count(*) as shared_fingerprints, count(*)::double / greatest((select count(*) from own), any_value(total)) as similarity from sets s join own using (fp_hash) join totals t on t.file_path = s.file_path where s.file_path <> {_BASE} group by 1)"""


def _base(spark: SparkSession, sf_dir: str) -> str:
    row = table(spark, sf_dir, "documents").agg(F.min(F.struct("doc_id", "source", "lang")).alias("d")).first().d
    return f"{row.source}/{row.lang}/doc_{row.doc_id}.txt"


def _prints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clones.fingerprint_files(document_files(spark, sf_dir))


@query(f"with {_PRINTS} select file_path, fp_hash, span_start::bigint as span_start, span_end::bigint as span_end from prints")
def fingerprints_winnowed(spark, sf_dir):
    return _prints(spark, sf_dir)


@query(f"with {_CLONES} select other_file, shared_fingerprints, similarity from candidates where similarity >= 0.02 order by similarity desc, shared_fingerprints desc, other_file limit 50")
def clone_matches(spark, sf_dir):
    return clones.clone_matches(_prints(spark, sf_dir), _base(spark, sf_dir))


@query(f"""with {_CLONES} select (select count(*) from own) as self_fingerprint_count, count(*) as candidate_files, count(*) filter (where similarity >= 0.02) as surviving_candidates, max(similarity) as max_candidate_similarity,
  count(*) - count(*) filter (where similarity >= 0.02) as filtered_by_threshold, greatest(max(similarity) * 0.9, 0.0) as suggested_min_similarity,
  case when count(*) filter (where similarity >= 0.02) > 0 then null when count(*) = 0 then 'no overlapping fingerprints with other files' else 'all clone candidates were filtered by min_similarity=0.020; try lowering the threshold' end as empty_reason from candidates""")
def clone_analysis(spark, sf_dir):
    return clones.clone_analysis(_prints(spark, sf_dir), _base(spark, sf_dir))


@query(f"with {_CLONES} select regexp_extract(other_file, '^(.*)/[^/]*$', 1) as directory, count(*) as files, avg(similarity) as avg_similarity, max(similarity) as max_similarity from candidates where similarity >= 0.02 group by 1 order by avg_similarity desc, files desc, directory limit 50")
def clone_hotspots(spark, sf_dir):
    return clones.clone_hotspots(_prints(spark, sf_dir), _base(spark, sf_dir))


@query(f"""with {_PRINTS}, sets as (select file_path, list_sort(list(distinct fp_hash)) as hs from prints group by 1), reps as (select hs, min(file_path) as file from sets group by 1), each as (select file, len(hs) as n, unnest(hs) as h from reps)
select a.file as file_a, b.file as file_b, count(*) as shared, count(*)::double / greatest(a.n, b.n) as similarity from each a join each b on a.h = b.h and a.file < b.file group by a.file, b.file, a.n, b.n having count(*)::double / greatest(a.n, b.n) >= 0.5""")
def clone_all_pairs(spark, sf_dir):
    return clones.clone_pairs(_prints(spark, sf_dir), 0.5)


@query(f"""with {_PRINTS}, sets as (select file_path, list_sort(list(distinct fp_hash)) as hs from prints group by 1)
select file_path, min(file_path) over (partition by hs) as representative, count(*) over (partition by hs) as members from sets""")
def clone_members(spark, sf_dir):
    return clones.clone_members(_prints(spark, sf_dir))


# Discovery and selectors.
def _rank(order: tuple[str, ...], other: int) -> str:
    return "case entity_type " + " ".join(f"when '{t}' then {i}" for i, t in enumerate(order)) + f" else {other} end"


_FETCH, _RESULT = _rank(("file", "symbol_name", "symbol", "module"), 9), _rank(("symbol", "symbol_name", "file", "module"), 9)
_RATIO = "(select 0)"


def _ratio(q: str, c: str) -> str:
    """The greedy subsequence share in SQL: fold the text's letters, keeping how many of the query's have been met."""
    bare = f"regexp_replace(lower(coalesce({c}, '')), '[^a-z0-9]', '', 'g')"
    fold = f"list_reduce(list_prepend(0, list_transform(string_split({bare}, ''), lambda ch: unicode(ch))), lambda n, u: case when n < {len(q)} and u = unicode(substr('{q}', n::bigint + 1, 1)) then n + 1 else n end)"
    return f"case when {bare} = '' then 0.0 when contains({bare}, '{q}') then 1.0 else {fold}::double / {len(q)} end"


def _discover(q: str, tokens: list[str], fuzzy: bool, limit: int = 20, where: str = "true") -> str:
    path = "lower(replace(coalesce(file_path, ''), '\\', '/'))"
    if q:
        worth = [("lower(name) = '{q}'", 120), ("lower(key) = '{q}'", 120), ("starts_with(lower(name), '{q}')", 70), ("starts_with(lower(key), '{q}')", 60), ("contains(lower(name), '{q}')", 50), ("contains(lower(key), '{q}')", 40), (f"contains({path}, '{{q}}')", 32)]
        terms = [f"case when {t.format(q=q)} then {v}.0::double else 0.0::double end" for t, v in worth]
        terms += [f"case when contains({c}, '{t}') then {v}.0::double else 0.0::double end" for t in tokens for c, v in (("lower(name)", 10), ("lower(key)", 8), (path, 6))]
        bare = "".join(c for c in q if c.isalnum())
        if fuzzy:
            terms.append(f"greatest({_ratio(bare, 'name')}, {_ratio(bare, 'key')}, {_ratio(bare, 'file_path')}) * 25.0::double")
        score = " + ".join(["0.0::double", *terms, f"greatest(10 - ({_RESULT}), 0)::double * 0.2::double"])
    else:
        score = f"(10 - ({_RESULT}))::double"
    test = " or ".join(f"lower({c}) like '%{t}%'" for t in tokens for c in ("key", "name", "coalesce(file_path, '')")) if fuzzy and q else "true"
    return f"""with {_GRAPH}, fetched as (select * from entities where ({where}) and ({test}) order by {_FETCH}, key limit {8 * limit})
select entity_type, key, name, file_path, line, {score} as score from fetched order by score desc, {_RESULT}, key limit {limit}"""


@query(_discover("supplier1", ["supplier1"], True))
def selector_discover_fuzzy(spark, sf_dir):
    return discover.discover_selectors(supply_graph(spark, sf_dir).entities, "Supplier1")


@query(_discover("", [], True))
def selector_discover_noquery(spark, sf_dir):
    return discover.discover_selectors(supply_graph(spark, sf_dir).entities)


@query(_discover("rust supplier", ["rust", "supplier"], False, where="entity_type = 'symbol_name'"))
def selector_discover_typed(spark, sf_dir):
    return discover.discover_selectors(supply_graph(spark, sf_dir).entities, "rust supplier", entity_type="symbol_name", fuzzy=False)


@query(_discover("nation", ["nation"], True, where="file_path is null or file_path glob 'nation1*'"))
def selector_discover_glob(spark, sf_dir):
    return discover.discover_selectors(supply_graph(spark, sf_dir).entities, "nation", file_glob="nation1*")


@query(f"with {_GRAPH}, byname as (select * from entities where name = {_NAME} order by {_rank(('symbol', 'symbol_name', 'file'), 3)}, file_path nulls first, line nulls first, key limit 32) select entity_type, key, name from byname order by {_RESULT}, key limit 1")
def selector_resolve_auto(spark, sf_dir):
    return selectors.resolve_selector(supply_graph(spark, sf_dir), _pick(spark, sf_dir)).select("entity_type", "key", "name")


@query(f"with {_GRAPH} select 'file:' || {_START} as selector, 'file' as parsed_as, true as matched, 'file:' || {_START} as selected_key")
def selector_describe(spark, sf_dir):
    return selectors.describe_selector(supply_graph(spark, sf_dir), f"file:{_first_file(spark, sf_dir)}")


# Freshness.
_AT = "timestamp '2024-01-01' + to_minutes(doc_id)"


@query(f"select count(*) as file_count, strftime(max({_AT}), '%Y-%m-%d %H:%M:%S') as latest_indexed_at, '1' as schema_version, 24::bigint as stale_after_hours, max({_AT}) < timestamp '2024-01-01 00:30:00' as is_stale from documents")
def freshness_info(spark, sf_dir):
    return graph.freshness_info(document_files(spark, sf_dir), NOW)


@query(f"select 'index appears stale (latest indexed_at=' || strftime(max({_AT}), '%Y-%m-%d %H:%M:%S') || '); consider re-indexing' as warning from documents")
def index_warning(spark, sf_dir):
    return graph.index_warning(document_files(spark, sf_dir), datetime.datetime(2030, 1, 1))


# Files.
_DOCS = "docs as (select doc_id, source, lang, source || '/' || lang || '/doc_' || doc_id || '.txt' as path, text, case when text = '' then [] else string_split(regexp_replace(text, '\\n$', ''), chr(10)) end as lines from documents)"


@query(f"with {_DOCS} select path, lang as language, array_to_string(lines[2:4], chr(10)) as content, len(lines)::bigint as total_lines, least(2, len(lines))::bigint as start_line, least(4, len(lines))::bigint as end_line, (least(4, len(lines)) - least(2, len(lines)) + 1)::bigint as returned_lines, false as truncated from docs where path = (select path from docs where len(lines) >= 4 order by doc_id limit 1)")
def read_file_range(spark, sf_dir):
    docs = document_files(spark, sf_dir)
    long = docs.where(F.size(lines_of(F.col("content"))) >= 4).agg(F.min_by("path", "indexed_at")).first()[0]
    return files.read_file(docs, long, 2, 4)


@query(f"with {_DOCS} select path, len(lines)::bigint as total_lines, least(len(lines), 3)::bigint as returned_lines, len(lines) > 3 as truncated, array_to_string(lines[1:3], chr(10)) as content from docs")
def read_all_heads(spark, sf_dir):
    docs = document_files(spark, sf_dir)
    ranges = docs.select("path", F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"))
    return files.read_ranges(docs, ranges, F.lit(3)).select("path", "total_lines", "returned_lines", "truncated", "content")


@query()
def multi_read_budget(spark, sf_dir):
    docs = document_files(spark, sf_dir)
    paths = [r.path for r in docs.orderBy(F.desc("size_bytes"), "path").select("path").limit(3).collect()]
    return files.multi_read(docs, [(p, 1, None) for p in paths], max_total_lines=20)


@query()
def symbol_source(spark, sf_dir):
    page = table(spark, sf_dir, "pages").select(F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.lit("html").alias("lang"), F.sha2(F.col("html").cast("binary"), 256).alias("content_hash"), F.octet_length("html").cast("bigint").alias("size_bytes"), F.lit(NOW).alias("indexed_at"), F.col("html").alias("content"))
    return files.symbol_source(index.build_graph(page, page.select("path")), page, "title", max_definitions=5, max_total_lines=40)


def _search(test: str, limit: int = 50) -> str:
    return f"""with {_DOCS}, each as (select path, lines, unnest(generate_series(1, len(lines))) as i from docs), hits as (select path, lines, i, lines[i] as line from each where {test.format(c='lines[i]')} order by path, i limit {limit})
select path as file, i as line, line as content, lines[greatest(i - 2, 1):i - 1] as context_before, lines[i + 1:i + 2] as context_after from hits"""


@query(_search("contains({c}, 'license') or contains({c}, 'the and')").replace("contains(lines[i], 'license') or ", ""))
def search_literal(spark, sf_dir):
    return files.search_files(document_files(spark, sf_dir), "the and")


@query(_search("regexp_matches({c}, 'token = .[0-9a-f]+')"))
def search_regex(spark, sf_dir):
    return files.search_files(document_files(spark, sf_dir), "token = .[0-9a-f]+", is_regex=True)


@query(_search("path like 'src1/%' and contains({c}, 'er')", 100000000))
def search_glob_all(spark, sf_dir):
    return files.search_files(document_files(spark, sf_dir), "er", glob="src1/*", max_results=100_000_000)


@query(f"with {_DOCS}, parts as (select source, lang, path, strlen(text) as size_bytes from docs) select distinct source as path, 'directory' as type, null::bigint as size_bytes from parts union all select distinct source || '/' || lang, 'directory', null from parts union all select path, 'file', size_bytes from parts")
def list_directory_recursive(spark, sf_dir):
    return files.list_directory(document_files(spark, sf_dir), recursive=True)


@query(f"with {_DOCS} select distinct source || '/' || lang as path, 'directory' as type, null::bigint as size_bytes from docs where source = 'src1'")
def list_directory(spark, sf_dir):
    return files.list_directory(document_files(spark, sf_dir), "src1", glob="*.md")


_OLD = "'the and'"


def _edit(all_of_them: bool) -> str:
    error = f"case when n = 0 then 'old_text not found in file' {'' if all_of_them else chr(10) + chr(32) + 'when n > 1 then ' + chr(39) + 'old_text matches ' + chr(39) + ' || n || ' + chr(39) + ' times; must match exactly once' + chr(39)} end"
    return f"with {_DOCS}, counted as (select path, text, ((length(text) - length(replace(text, {_OLD}, ''))) / 7)::bigint as n from docs), tested as (select *, {error} as error from counted) select path, n as occurrences_found, case when error is null then n else 0 end as replacements_applied, case when error is null then replace(text, {_OLD}, 'THE AND') else text end as content, error from tested"


@query(_edit(False))
def edit_replace_one(spark, sf_dir):
    return files.edit_texts(document_files(spark, sf_dir), "the and", "THE AND")


@query(_edit(True))
def edit_replace_all(spark, sf_dir):
    return files.edit_texts(document_files(spark, sf_dir), "the and", "THE AND", replace_all=True)


# Outlines, over the supply graph.
@query(f"with {_GRAPH} select path as file_path, name, qualname, kind, line, end_line from symbols where len(string_split(qualname, '::')) - 1 <= 1 and path = {_START}")
def file_outline(spark, sf_dir):
    return files.outline(supply_graph(spark, sf_dir).entities, [_first_file(spark, sf_dir)], max_depth=1)


@query(f"with {_GRAPH} select path as file_path, count(s.key) as entries, null::varchar as note from own left join symbols s using (path) where path = {_START} group by path")
def multi_outline(spark, sf_dir):
    g = supply_graph(spark, sf_dir)
    return files.multi_outline(g.files, g.entities, [_first_file(spark, sf_dir)])


# Index maintenance: the documents as they were and as they are.
_OLD_DOCS = "olds as (select source || '/' || lang || '/doc_' || doc_id || '.txt' as path, sha256(case when doc_id % 7 = 0 then text || 'x' else text end) as h from documents where doc_id % 5 <> 0), news as (select source || '/' || lang || '/doc_' || doc_id || '.txt' as path, sha256(text) as h from documents where doc_id % 11 <> 0)"


def _before(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = document_files(spark, sf_dir).withColumn("id", F.regexp_extract("path", r"doc_(\d+)", 1).cast("long"))
    old = docs.where("id % 5 <> 0").withColumn("content_hash", F.when(F.col("id") % 7 == 0, F.sha2(F.concat("content", F.lit("x")).cast("binary"), 256)).otherwise(F.col("content_hash")))
    return old, docs.where("id % 11 <> 0")


@query(f"with {_OLD_DOCS} select path, case when n.h is null then 'removed' when o.h is null then 'added' when n.h = o.h then 'unchanged' else 'changed' end as change from news n full join olds o using (path)")
def index_incremental_diff(spark, sf_dir):
    old, new = _before(spark, sf_dir)
    return index.diff_files(new, old)


@query(f"with {_OLD_DOCS}, diff as (select case when n.h is null then 'removed' when o.h is null then 'added' else 'changed' end as change from news n full join olds o using (path)) select change, count(*) as n from diff group by 1")
def index_full_rebuild(spark, sf_dir):
    old, new = _before(spark, sf_dir)
    return index.diff_files(new, old, full=True).groupBy("change").agg(F.count(F.lit(1)).alias("n"))


_GONE = "gone as (select path from own where s_suppkey % 3 = 0)"
_KEPT = f"""{_GONE}, kept as (select * from entities where file_path is null or file_path not in (select path from gone)),
kept_edges as (select * from edges where (file_path is null or file_path not in (select path from gone)) and src_key in (select key from kept) and dst_key in (select key from kept))"""


def _removed(spark: SparkSession, sf_dir: str) -> Graph:
    g = supply_graph(spark, sf_dir)
    gone = g.files.where(F.regexp_extract("path", r"supplier(\d+)", 1).cast("long") % 3 == 0).select("path")
    return index.remove_files(g, gone)


@query(f"with {_GRAPH}, {_KEPT} select edge_type, count(*) as edges, count(distinct src_key) as sources, count(distinct dst_key) as targets from kept_edges group by 1")
def index_remove_cascade(spark, sf_dir):
    return _removed(spark, sf_dir).edges.groupBy("edge_type").agg(F.count(F.lit(1)).alias("edges"), F.countDistinct("src_key").alias("sources"), F.countDistinct("dst_key").alias("targets"))


@query(f"with {_GRAPH}, {_KEPT} select entity_type, key from kept where entity_type not in ('symbol_name', 'module') or key in (select src_key from kept_edges union select dst_key from kept_edges)")
def orphan_cleanup(spark, sf_dir):
    g = _removed(spark, sf_dir)
    return index.drop_orphans(g.entities, g.edges).select("entity_type", "key")


@query("""with old as (select 'c' || c_custkey as key, 'file' as entity_type, c_name as name, c_mktsegment as lang, null::varchar as kind from customer where c_custkey % 3 <> 0),
new as (select 'c' || c_custkey as key, 'symbol' as entity_type, c_name || '!' as name, null::varchar as lang, 'k' as kind from customer where c_custkey % 4 <> 0)
select coalesce(n.entity_type, o.entity_type) as entity_type, key, coalesce(n.name, o.name) as name, coalesce(n.lang, o.lang) as lang, coalesce(n.kind, o.kind) as kind from old o full join new n using (key)""")
def entity_upsert(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("key", F.concat(F.lit("c"), F.col("c_custkey").cast("string")))
    old = c.where("c_custkey % 3 <> 0").select(F.lit("file").alias("entity_type"), "key", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("lang"), F.lit(None).cast("string").alias("kind"))
    new = c.where("c_custkey % 4 <> 0").select(F.lit("symbol").alias("entity_type"), "key", F.concat("c_name", F.lit("!")).alias("name"), F.lit(None).cast("string").alias("lang"), F.lit("k").alias("kind"))
    return index.upsert_entities(old, new)


@query("select * from (values ('python', 'a.b', 'x/y.py', ['a/b.py', 'a/b/__init__.py']), ('rust', 'crate::m::f', 'src/x.rs', ['src/m/f.rs', 'src/m/f/mod.rs', 'src/m.rs', 'src/m/mod.rs', 'src/f.rs']), ('rust', 'crate::s::{A, B}', 'y.rs', ['src/s.rs', 'src/s/mod.rs', '{A, B.rs']), ('rust', 'self::q as z', 'src/y.rs', ['src/q.rs', 'src/q/mod.rs', 'src/q as z.rs']), ('go', 'fmt', 'm.go', []::varchar[])) t(lang, module, path, candidates)")
def import_candidates(spark, sf_dir):
    rows = [("python", "a.b", "x/y.py"), ("rust", "crate::m::f", "src/x.rs"), ("rust", "crate::s::{A, B}", "y.rs"), ("rust", "self::q as z", "src/y.rs"), ("go", "fmt", "m.go")]
    return spark.createDataFrame(rows, "lang string, module string, path string").select("lang", "module", "path", imports.import_candidates(F.col("lang"), F.col("module"), F.col("path")).alias("candidates"))


@query(f"with {_DOCS} select 'module' || doc_id || '.' || lang as module, path as resolved from docs")
def import_resolution(spark, sf_dir):
    docs = document_files(spark, sf_dir)
    found = docs.select(F.lit("main.py").alias("path"), F.lit("python").alias("lang"), F.concat(F.lit("module"), F.regexp_extract("path", r"doc_(\d+)", 1), F.lit("."), "lang").alias("module"), F.col("path").alias("target"))
    listing = found.select(F.concat(F.replace("module", F.lit("."), F.lit("/")), F.lit("/__init__.py")).alias("path"), "target")
    out = imports.resolve_imports(found, listing)
    return out.join(listing.select(F.col("path").alias("resolved"), "target"), "resolved").select("module", F.col("target").alias("resolved"))


_PATHS = ["Cargo.toml", "xcargo.toml", "src/main.rs", "a/src/main.rs", "a\\src\\lib.rs", "p/__main__.py", "random.rs", "a/B.PY", "x/Gemfile", "s.pyi", "go.mod", "README", "k.kts", "m.MJS", "renv.lock"]
_TYPED = {"Cargo.toml": ("config", "rust"), "xcargo.toml": ("config", "toml"), "src/main.rs": (None, "rust"), "a/src/main.rs": ("entrypoint", "rust"), "a\\src\\lib.rs": ("entrypoint", "rust"), "p/__main__.py": ("entrypoint", "python"), "random.rs": (None, "rust"), "a/B.PY": (None, "python"), "x/Gemfile": (None, "ruby"), "s.pyi": (None, "python"), "go.mod": (None, "go"), "README": (None, None), "k.kts": (None, "kotlin"), "m.MJS": (None, "javascript"), "renv.lock": (None, "json")}
_LITERAL = lambda v: "null" if v is None else f"'{v}'"


@query("select * from (values " + ", ".join(f"('{p}', {_LITERAL(a)}, {_LITERAL(b)})" for p, (a, b) in _TYPED.items()) + ") t(path, special, lang)")
def special_file_classify(spark, sf_dir):
    paths = spark.createDataFrame([(p,) for p in _PATHS], "path string")
    return paths.select("path", repo.special_type(F.col("path")).alias("special"), repo.file_language(F.col("path")).alias("lang"))


# Functions over whole columns.
@query(f"with {_DOCS} select path, path glob 'src1?/e*' as by_glob, path like 'src1_/e%' as by_file_glob, regexp_extract(path, '^(.*)/[^/]*$', 1) as directory, len(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9_]+')) as tokens, case when u >= 9223372036854775808::hugeint then u - 18446744073709551616::hugeint else u end::bigint as hash from (select *, ('0x' || substr(sha256(path), 1, 16))::ubigint::hugeint as u from docs)")
def path_functions(spark, sf_dir):
    docs = document_files(spark, sf_dir)
    return docs.select("path", path_glob(F.col("path"), "src1?\\e*").alias("by_glob"), file_glob(F.col("path"), "src1?/e*").alias("by_file_glob"), parent_dir(F.col("path")).alias("directory"), F.size(code_tokens(F.col("content"))).cast("bigint").alias("tokens"), hash64(F.col("path")).alias("hash"))


@query(f"select p_partkey, {_ratio('goldx9', 'p_name')}::double as ratio, strlen(p_name) > 2 and p_name not in {_LOW} and lower(p_name) not in {_STANDARD} as local, p_name in {_LOW} as low from part")
def name_functions(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return part.select("p_partkey", subsequence_ratio("Gold-x9", F.col("p_name")).alias("ratio"), project_local(F.col("p_name")).alias("local"), low_signal(F.col("p_name")).alias("low"))


# Extraction.
def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(F.concat(F.lit("page_"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.lit("html").alias("lang"), F.col("html").alias("content"))


@query()
def extract_pages(spark, sf_dir):
    return extract(_pages(spark, sf_dir)).select("path", F.inline("definitions"))


@query("select 'event_' || event_id || '.json' as path, 'k' as name, 'k' as qualname, 'pair' as kind from events")
def extract_json(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select(F.concat(F.lit("event_"), F.col("event_id").cast("string"), F.lit(".json")).alias("path"), F.lit("json").alias("lang"), F.col("props").alias("content"))
    return extract(rows).select("path", F.inline("definitions")).select("path", "name", "qualname", "kind")


# Changes.
@query("""with recursive rows as (select user_id as key, epoch_us(ts) as t, count(*) as n from events group by 1, 2), ranked as (select *, row_number() over (partition by key order by t) as i from rows),
fold(key, i, a, n, done) as (select key, i, t, n, false from ranked where i = 1 union all select r.key, r.i, case when r.t < f.a + 3600000000 then f.a else r.t end, r.n, false from fold f join ranked r on r.key = f.key and r.i = f.i + 1)
select key, make_timestamp(a) as first_ts, make_timestamp(a + 3600000000) as flush_ts, sum(n)::bigint as n_events from fold group by key, a""")
def change_debounce(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    return watch.flushes(events, debounce_ms=3_600_000)


@query("select event_id, event_type || '/' || user_id as path from events where event_type not in ('.git', 'target')")
def change_relevance(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.concat("event_type", F.lit("/"), F.col("user_id").cast("string")).alias("path"))
    noise = events.select("event_id", F.concat(F.lit("target/"), "path").alias("path"))
    return watch.relevant(events.unionByName(noise))
