"""The driver's contract: names match, SQL agrees on the smallest tables for a cross-section of the queries."""

import os

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
SOME = ["p2_found", "p3_found", "p4_found", "p6_found", "src_workspace_deps", "flt_view_filter", "rec_lca_path", "agg_meta_edges", "agg_rollup_service", "win_next_sibling", "con_evaluate_design", "join_manifest_diff", "fn_to_kebab_case", "con_evaluate", "agg_flow_edges", "agg_aggregated_edges", "con_score", "snk_web_sequence"]


def test_names():
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 190
    assert {f"p{n}_found" for n in (2, 3, 4, 6)} <= set(q)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_entry_gives_rows(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
@pytest.mark.parametrize("name", SOME)
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"create view {f.split('.')[0]} as select * from '{SF}/{f}'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted(map(str, (tuple(r) for r in df.select(*[f"`{x}`" for x in columns]).collect())))
    r = c.sql(entry.oracle_sql()[name])
    assert sorted(r.columns) == columns
    order = [r.columns.index(x) for x in columns]
    assert got == sorted(str(tuple(x[i] for i in order)) for x in r.fetchall())
