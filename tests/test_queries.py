"""Every mesh query against its SQL in DuckDB."""

import duckdb
import pytest

from meshloom.plans import mesh_queries


def value(v):
    return round(v, 9) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(mesh_queries.ORACLES))
def test_query(spark, sf_dir, name):
    made = mesh_queries.QUERIES[name](spark, sf_dir)
    con = duckdb.connect()
    for table in ("part", "orders", "events", "lineitem"):
        con.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    want = con.sql(mesh_queries.ORACLES[name])
    columns = sorted(made.columns)
    assert sorted(want.columns) == columns
    at = [want.columns.index(c) for c in columns]
    assert sorted((tuple(value(r[c]) for c in columns) for r in made.collect()), key=repr) == sorted((tuple(value(r[i]) for i in at) for r in want.fetchall()), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 750
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
