"""Every registered code-graph query against its SQL in DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from loomgraph.jobs import catalog, fixtures

SF = "/root/testdata/sf0.001"
#: Queries whose SQL takes long, or that are covered by others over the same operator.
SAMPLE = [
    "nodes_by_name_or_qname", "classes_in_package", "class_call_pairs", "call_exists", "graph_stats", "first_wins", "latency_summary", "tokenize", "bm25_search", "query_tool", "query_cli",
    "sort_names", "explode_calls", "regex_methods", "type_names", "import_edges", "index_nodes", "index_edges", "index_merged_edges", "graph_tables_edges", "graph_json_edges", "graph_document_nodes", "read_change_log", "upsert_repository", "stream_refresh_edges", "resolve_calls",
    "fluent_structural_calls", "fluent_regex_calls", "fluent_fields", "fluent_call_edges", "read_sources", "read_requested", "changed_sets_of_log", "stream_changed_sets", "bm25_indexed", "merge_stored_edges", "graph_ranges_nodes",
    "impact_upstream", "impact_downstream", "inheritance_chain", "symbol_context", "context_tool", "resolve_inheritance", "changed_file_sets", "merge_incremental_edges", "import_scope",
]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in (*fixtures.TABLES,):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def _norm(rows):
    return sorted(tuple("" if v is None else repr(round(v, 4)) if isinstance(v, float) else str(v) for v in r) for r in rows)


@pytest.mark.skipif(not Path(SF).exists(), reason="needs the tables")
@pytest.mark.parametrize("name", SAMPLE)
def test_query(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    want = duck.sql(catalog.ORACLES[name])
    assert sorted(want.columns) == names
    at = [list(want.columns).index(c) for c in names]
    assert _norm(tuple(r) for r in got.select(*[f"`{c}`" for c in names]).collect()) == _norm(tuple(r[i] for i in at) for r in want.fetchall())


def test_every_query_has_sql():
    assert not [n for n in catalog.QUERIES if n not in catalog.ORACLES]
