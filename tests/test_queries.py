"""The registered queries agree with DuckDB, and their rules find something."""

import os

import duckdb
import pytest

from weftline import plan_queries, queries

SF = "/root/testdata/sf0.001"
#: Queries that have nothing to show on the smallest tables.
MAY_BE_EMPTY = ("repair_verified",)


def sql_rows(sql):
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.sql(f"CREATE VIEW {name.partition('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    cols = [d[0] for d in c.sql(sql).description]
    return sorted(repr([dict(zip(cols, r, strict=True))[k] for k in sorted(cols)]) for r in c.sql(sql).fetchall())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query_equals_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    got = sorted(repr([r[k] for k in sorted(df.columns)]) for r in df.collect())
    assert got == sql_rows(queries.ORACLE_SQL[name]) and (got or name in MAY_BE_EMPTY)


def test_every_oracle_has_its_query():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and set(queries.QUERIES) == set(queries.ORACLE_SQL)
    assert hasattr(plan_queries, "repair_output") and len(queries.QUERIES) >= 80


def test_flagship_fires_on_every_reason(spark):
    import __spark_entry__ as e

    assert {r.reason for r in e.entry(spark).collect()} == {"kept", "empty_source_or_target", "numeric_only_side", "link_only_side"}
