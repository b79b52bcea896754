import datetime
import random

import pytest

from lumigraph import schema
from lumigraph.operators import clones, graph
from lumigraph.operators.discover import discover_selectors
from lumigraph.operators.index import drop_orphans, remove_files
from lumigraph.plans.paging import pagination
from lumigraph.plans.selectors import Selector, describe_selector, parse_selector, resolve_selector
from lumigraph.schema import Graph

NOW = datetime.datetime(2024, 1, 2)


@pytest.fixture(scope="module")
def small(spark):
    path, null = "src/main.rs", None
    files = spark.createDataFrame([(path, "rust", "abc123", 100, NOW)], schema.FILES)
    foo, bar = "symbol:src/main.rs:foo:function_item:1:1", "symbol:src/main.rs:Bar:struct_item:5:1"
    entities = spark.createDataFrame([
        ("file", f"file:{path}", path, "rust", path, null, null, null, null, null, null),
        ("symbol", foo, "foo", "rust", path, 1, 1, 3, 1, "function_item", "foo"),
        ("symbol", bar, "Bar", "rust", path, 5, 1, 7, 1, "struct_item", "Bar"),
        *[("symbol_name", f"symbol_name:rust:{n}", n, "rust", *[null] * 7) for n in ("foo", "Bar", "baz")],
        ("module", "module:rust:std", "std", "rust", *[null] * 7),
    ], schema.ENTITIES)
    f = f"file:{path}"
    edges = spark.createDataFrame([(f, foo, "defines", path, 1, 1, 3, 1), (f, bar, "defines", path, 5, 1, 7, 1), (foo, "symbol_name:rust:foo", "names", path, 1, 1, 3, 1), (bar, "symbol_name:rust:Bar", "names", path, 5, 1, 7, 1), (f, "symbol_name:rust:Bar", "references", path, 2, 5, 2, 8), (f, "symbol_name:rust:Bar", "references", path, 2, 5, 2, 8), (f, "symbol_name:rust:baz", "calls", path, 2, 10, 2, 13), (f, "module:rust:std", "imports", path, 1, 1, null, null)], schema.EDGES)
    prints = spark.createDataFrame([("src/a.rs", 100, 0, 10), ("src/a.rs", 200, 10, 20), ("src/b.rs", 100, 0, 10), ("src/b.rs", 300, 10, 20)], schema.FINGERPRINTS)
    return Graph(files, entities, edges, prints)


def test_definitions_and_references(small):
    assert [(r.line, r.kind) for r in graph.symbol_definitions(small, "Bar").collect()] == [(5, "struct_item")]
    assert [(r.line, r.col, r.score, r.why) for r in graph.symbol_references(small, "Bar").collect()] == [(2, 5, 1.35, "edge_type=references,same_file_as_definition")]
    assert graph.symbol_references(small, "Bar", dedup=False).count() == 2
    assert [(r.col, r.score) for r in graph.symbol_callers(small, "baz").collect()] == [(10, 2.0)]
    assert graph.symbol_callers(small, "Bar").isEmpty() and graph.symbol_references(small, "none").isEmpty()
    assert graph.symbol_references(small, "Bar", language="go").isEmpty() and graph.symbol_references(small, "Bar", file_glob="src/*.py").isEmpty()
    assert graph.symbol_references(small, "Bar", max_age_hours=1, now=NOW).count() == 1 and graph.symbol_references(small, "Bar", max_age_hours=1, now=NOW + datetime.timedelta(hours=2)).isEmpty()
    with pytest.raises(ValueError, match="order"):
        graph.symbol_references(small, "Bar", order="up")


@pytest.mark.parametrize(("total", "offset", "limit", "want"), [(10, 0, 5, (10, 0, 5, 5, True, 5)), (5, 0, 10, (5, 0, 10, 5, False, None)), (5, 100, 10, (5, 5, 10, 0, False, None)), (3, 0, 0, (3, 0, 1, 1, True, 1)), (0, 0, 5, (0, 0, 5, 0, False, None))])
def test_pagination(spark, total, offset, limit, want):
    assert tuple(pagination(spark.range(total), limit, offset).first()) == want


def test_clones(small):
    prints = small.fingerprints
    row = clones.clone_matches(prints, "src/a.rs").first()
    assert (row.other_file, row.shared_fingerprints, row.similarity) == ("src/b.rs", 1, 0.5)
    assert clones.clone_analysis(prints, "src/a.rs").first().suggested_min_similarity == pytest.approx(0.45)
    assert tuple(clones.clone_hotspots(prints, "src/a.rs").first()) == ("src", 1, 0.5, 0.5)
    high = clones.clone_analysis(prints, "src/a.rs", 0.9).first()
    assert (high.candidate_files, high.surviving_candidates, high.filtered_by_threshold) == (1, 0, 1) and "0.900" in high.empty_reason
    assert clones.clone_analysis(prints, "none").first().empty_reason == "no overlapping fingerprints with other files"


def test_clone_pairs_against_brute_force(spark):
    rng = random.Random(5)
    sets = {f"f{i}": {rng.randint(0, 25) for _ in range(rng.randint(1, 14))} for i in range(40)}
    rows = spark.createDataFrame([(f, h, 0, 5) for f, hs in sets.items() for h in hs], schema.FINGERPRINTS)
    for least in (0.02, 0.3, 0.5, 0.8):
        reps = {}
        for f in sorted(sets):
            reps.setdefault(frozenset(sets[f]), f)
        names = sorted(reps.values())
        want = {(a, b): len(sets[a] & sets[b]) for a in names for b in names if a < b and sets[a] & sets[b] and len(sets[a] & sets[b]) / max(len(sets[a]), len(sets[b])) >= least}
        assert {(r.file_a, r.file_b): r.shared for r in clones.clone_pairs(rows, least).collect()} == want


def test_pairs_and_members_hold_every_clone(spark):
    rng = random.Random(6)
    kinds = [{rng.randint(0, 25) for _ in range(rng.randint(1, 14))} for _ in range(12)] + [{100, 101}]  # the last is near nothing else
    sets = {f"f{i}": kinds[i % len(kinds)] for i in range(40)}
    rows = spark.createDataFrame([(f, h, k, k + 5) for f, hs in sets.items() for h in hs for k in (0, 9)], schema.FINGERPRINTS)
    of: dict[str, list[str]] = {}
    for r in clones.clone_members(rows).collect():
        of.setdefault(r.representative, []).append(r.file_path)
        assert r.members == sum(hs == sets[r.file_path] for hs in sets.values())
    got = {(a, b): 1.0 for fs in of.values() for a in fs for b in fs if a < b}
    for r in clones.clone_pairs(rows, 0.5).collect():
        got.update({(min(a, b), max(a, b)): r.similarity for a in of[r.file_a] for b in of[r.file_b]})
    alike = {(a, b): len(sets[a] & sets[b]) / max(len(sets[a]), len(sets[b])) for a in sets for b in sets if a < b}
    assert got == {k: v for k, v in alike.items() if v >= 0.5}


def test_selectors(small):
    assert parse_selector("file:a\\b") == Selector("file", "a/b") and parse_selector("symbol_name:rust:foo") == Selector("symbol_name", "foo", "rust")
    assert parse_selector("symbol:main") == Selector("name", "main") and parse_selector("module:rust:x") == Selector("key", "module:rust:x") and parse_selector(" bare ") == Selector("auto", "bare")
    for bad in ("", "  ", "file:", "symbol_name:rust", "symbol_name::x", "key: "):
        with pytest.raises(ValueError, match="selector|needs"):
            parse_selector(bad)
    assert resolve_selector(small, "foo").first().entity_type == "symbol"
    assert resolve_selector(small, "src/main.rs").first().key == "file:src/main.rs"
    assert resolve_selector(small, "symbol_name:rust:baz").first().key == "symbol_name:rust:baz"
    assert tuple(describe_selector(small, "symbol:zzz").first()) == ("symbol:zzz", "symbol", False, None)


def test_slice(small):
    rows = graph.minimal_slice(small, "src/main.rs", depth=1).collect()
    assert [(r.edge_type, r.direction) for r in rows] == [("calls", "outgoing"), ("imports", "outgoing"), ("defines", "outgoing"), ("defines", "outgoing"), ("references", "outgoing")]
    assert rows[0].score == pytest.approx(2.5 + 0.2 + 0.35)
    assert graph.anchor(small, "src/main.rs", 2).first().name == "foo" and graph.anchor(small, "src/main.rs", 4).first().entity_type == "file"
    assert graph.minimal_slice(small, "nowhere").isEmpty()


def test_discovery(small):
    rows = discover_selectors(small.entities, "foo").collect()
    assert rows[0].key.startswith("symbol:") and rows[0].score == pytest.approx(120 + 70 + 50 + 40 + 10 + 8 + 25 + 2.0)
    assert discover_selectors(small.entities, "zq", fuzzy=False, limit=3).count() == 3
    assert discover_selectors(small.entities, "xbarx").count() == 7
    assert [r.score for r in discover_selectors(small.entities, limit=1).collect()] == [10.0]


def test_freshness(small):
    fresh = graph.freshness_info(small.files, NOW).first()
    assert (fresh.file_count, fresh.latest_indexed_at, fresh.is_stale) == (1, "2024-01-02 00:00:00", False)
    assert graph.index_warning(small.files, NOW).first().warning is None
    assert "stale" in graph.index_warning(small.files, NOW + datetime.timedelta(days=3)).first().warning
    empty = small.files.where("false")
    assert graph.freshness_info(empty, NOW).first().is_stale and "empty" in graph.index_warning(empty, NOW).first().warning


def test_paths_on_random_graphs(spark):
    rng = random.Random(1)
    n = 30
    pairs = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(45)})
    entities = spark.createDataFrame([("file", f"file:{i:02}", f"{i:02}", None, f"{i:02}", *[None] * 6) for i in range(n)], schema.ENTITIES)
    edges = spark.createDataFrame([(f"file:{a:02}", f"file:{b:02}", "depends_on", f"{a:02}", 1, 1, None, None) for a, b in pairs], schema.EDGES)
    g = Graph(None, entities, edges)
    for a, b, most in ((0, 7, 8), (3, 3, 8), (5, 20, 2), (1, 9, 8)):
        level, path = {a: (a,)}, None
        seen = {a}
        for _ in range(most + 1):
            if b in level:
                path = level[b]
                break
            new = {}
            for k in sorted(level, key=lambda k: level[k]):
                for x, y in pairs:
                    if x == k and y not in seen:
                        new[y] = min(new.get(y, (n,)), (*level[k], y))
            seen |= set(new)
            level = new
        got = [int(r.entity_name) for r in graph.dependency_path(g, f"file:{a:02}", f"file:{b:02}", most).collect()]
        assert got == list(path or [])
    assert graph.dependency_path(g, "file:00", "file:zz").isEmpty()


def test_removal_and_orphans(small):
    left = remove_files(small, small.files.select("path"))
    assert left.files.isEmpty() and left.edges.isEmpty() and {r.entity_type for r in left.entities.collect()} == {"symbol_name", "module"}
    assert drop_orphans(left.entities, left.edges).isEmpty() and drop_orphans(small.entities, small.edges).count() == 7
