"""Every registered query runs over a whole table; those with SQL agree with DuckDB."""

import os

import duckdb
import pytest

from weftline.llm import registry

SF = "/root/testdata/sf0.001"


def shown(rows, columns):
    return sorted(repr([dict(zip(columns, r, strict=True))[k] for k in sorted(columns)]) for r in rows)


def sql_rows(sql):
    c = duckdb.connect()
    for name in os.listdir(SF):
        c.sql(f"CREATE VIEW {name.partition('.')[0]} AS SELECT * FROM '{SF}/{name}'")
    return shown(c.sql(sql).fetchall(), [d[0] for d in c.sql(sql).description])


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    df = registry.QUERIES[name](spark, SF)
    got = shown(df.collect(), df.columns)
    assert got == sql_rows(registry.ORACLE_SQL[name]) and got


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL)))
def test_query_covers_its_table(spark, name):
    got = registry.QUERIES[name](spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    ids = sorted(r.doc_id for r in docs.select("doc_id").collect())
    if name == "op8_decontaminate":
        assert len(got) and set(got.doc_id) <= set(ids)
    elif name == "op9_packing":
        assert sorted(got[got.start == 0].doc_id) == ids and set(got.groupby("sequence_id").length.sum()) <= {1 << k for k in range(13)}
    else:
        assert sorted(got.doc_id) == ids
