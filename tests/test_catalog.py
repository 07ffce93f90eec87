"""Every catalogue query against its DuckDB equivalent, on the smallest tables."""

import os

import duckdb
import pytest

from docaudit.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in sorted(os.listdir(SF)):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return c


def norm(v):
    return "[" + ",".join(map(norm, v)) + "]" if isinstance(v, (list, tuple)) else repr(v)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    rows = df.collect()
    if name not in catalog.oracle_sql():
        assert len(rows) > 0 or name == "intra_row_conflicts_ratio"
        return
    want = duck.sql(catalog.oracle_sql()[name])
    assert sorted(want.columns) == sorted(df.columns)
    columns = sorted(df.columns)
    at = [want.columns.index(c) for c in columns]
    got = sorted(tuple(norm(r[c]) for c in columns) for r in rows)
    assert got == sorted(tuple(norm(r[i]) for i in at) for r in want.fetchall())


def test_entry_imports_without_session():
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; assert e.queries() and e.oracle_sql()"
    assert subprocess.run([sys.executable, "-B", "-c", code], cwd=root).returncode == 0


def test_history_summary_odd_rows(spark, tmp_path):
    """Metrics without points, points without ordinal and the null metric: as the SQL has them."""
    rows = [(1, "a", 2.0), (2, "a", 1.0), (3, "a", 1.5), (None, "a", 0.5), (5, "none", 3.0), (6, None, 7.0), (7, None, 6.0), (9, "null", None), (None, "x", 1.0), (None, "y", 1.0), (24, "y", 1.0), (8, "n", float("nan"))]
    spark.createDataFrame(rows, "event_id bigint, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    c = duckdb.connect()
    c.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = c.sql(catalog.oracle_sql()["history_summary"])
    df = catalog.queries()["history_summary"](spark, str(tmp_path)).select(want.columns)
    assert sorted(map(norm, map(tuple, df.collect()))) == sorted(map(norm, want.fetchall()))
