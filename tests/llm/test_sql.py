"""Queries that SQL can express, against DuckDB."""

import duckdb
import pytest

from palisade.llm import lines, neardup, registry

TABLES = ("documents", "benchmark")


@pytest.mark.parametrize("name", list(registry.oracle_sql()))
def test_query(spark, sf, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df = registry.queries()[name](spark, sf)
    columns = sorted(df.columns)
    expected = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()[name]})").fetchall()
    assert sorted(tuple(map(str, r)) for r in df.select(columns).collect()) == sorted(tuple(map(str, r)) for r in expected)


def test_all_operators_and_the_pipeline_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 14)) and "pipeline" in names


def test_line_dedup_runs_no_python(spark, sf):
    plan = lines.query(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "InPandas" not in plan
    assert neardup.WORDS == 5 and neardup.NUMERATOR / neardup.DENOMINATOR == 0.75
