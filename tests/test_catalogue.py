"""Every registered query against DuckDB running its SQL."""

import math

import duckdb
import pytest

from sessionlens import catalogue, source_catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for table in ("events", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    return con


def plain(value):
    if value is None or str(value) in ("<NA>", "nan", "NaT"):
        return "null"
    if isinstance(value, bool) or hasattr(value, "dtype") and value.dtype.kind == "b":
        return str(bool(value))
    if isinstance(value, int | float) or hasattr(value, "dtype"):
        return "null" if math.isnan(float(value)) else f"{float(value):.6f}"
    return str(value)


QUERIES, SQL = catalogue.QUERIES | source_catalogue.QUERIES, catalogue.ORACLE_SQL | source_catalogue.ORACLE_SQL


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    got = QUERIES[name](spark, SF).toPandas()
    want = duck.sql(SQL[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    rows = [sorted(tuple(map(plain, r)) for r in df[columns].itertuples(index=False)) for df in (got, want)]
    assert rows[0] == rows[1]


def test_filters_reach_the_scan(spark):
    plan = catalogue.QUERIES["tools_totals"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(event_type,click)" in plan and "CartesianProduct" not in plan
