"""The registry: every query runs on the smallest tables, and SQL agrees where there is some."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

ROOT = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(ROOT), reason="no test tables here")


def test_registry():
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and len(queries) >= 60


def test_flagship(spark):
    assert entry.entry(spark).count() >= 0


@pytest.mark.parametrize("name", ["ranked_search_all", "neighbors_k2", "hub_nodes", "top_classes", "repo_counts", "file_summary", "why_introduced", "layer_confidence", "import_extract", "dedupe_keep_first", "p6_node_ends", "p6_found"])
def test_sql_agrees(spark, name):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for file in os.listdir(ROOT):
        con.execute(f"CREATE VIEW {file.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{ROOT}/{file}')")
    df = entry.queries()[name](spark, ROOT)
    columns = sorted(df.columns)
    text = lambda v: f"{v:.6f}" if isinstance(v, float) else str(v).replace("+00:00", "")
    ours = sorted(tuple(map(text, r)) for r in df.select(*columns).collect())
    theirs = sorted(tuple(map(text, r)) for r in con.execute(f"SELECT {', '.join(columns)} FROM ({entry.oracle_sql()[name]})").fetchall())
    assert ours == theirs
