import pytest

import __spark_entry__ as entry
from lumigraph.plans import catalog

SF = "/root/testdata/sf0.001"


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(catalog.QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", ["symbol_references", "symbol_callers", "references_page", "reachable_within", "minimal_slice_file", "fingerprints_winnowed", "clone_matches", "clone_all_pairs", "selector_discover_fuzzy", "search_literal", "list_directory_recursive", "edit_replace_one", "index_incremental_diff", "orphan_cleanup", "entity_upsert", "import_candidates", "special_file_classify", "change_debounce"])
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.sql("set timezone = 'UTC'")
    for t in ("supplier", "nation", "part", "lineitem", "documents", "events", "customer", "pages"):
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(entry.oracle_sql()[name])
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    rows = sorted(repr([plain(r[want.columns.index(c)]) for c in sorted(want.columns)]) for r in want.fetchall())
    found = entry.queries()[name](spark, SF)
    assert sorted(found.columns) == sorted(want.columns)
    assert sorted(repr([plain(r[c]) for c in sorted(found.columns)]) for r in found.collect()) == rows


def test_clone_members_against_sql(spark):
    test_against_sql(spark, "clone_members")
