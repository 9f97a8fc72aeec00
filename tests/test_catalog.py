import math
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tessera.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.sql("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        c.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.9g}"
    return "[" + ",".join(map(plain, v)) + "]" if isinstance(v, (list, tuple)) else repr(v)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE))
def test_query_agrees_with_sql(spark, con, name):
    df, sql = catalog.queries()[name](spark, SF), con.sql(catalog.ORACLE[name])
    assert sorted(df.columns) == sorted(sql.columns)
    names = sorted(df.columns)
    at = [sql.columns.index(n) for n in names]
    got = sorted(tuple(plain(r[n]) for n in names) for r in df.collect())
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in sql.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.NAMES) - set(catalog.ORACLE)))
def test_query_runs(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", ["bm25_multi_query", "hybrid_search", "retrieve_cascade", "vector_knn"])
def test_order_of_input_does_not_matter(spark, tmp_path, name):
    for t in ("documents", "embeddings", "benchmark"):
        rows = spark.read.parquet(f"{SF}/{t}.parquet")
        rows.repartition(5, rows.columns[0]).sortWithinPartitions(F.desc(rows.columns[0])).write.parquet(f"{tmp_path}/{t}.parquet")
    assert sorted(catalog.queries()[name](spark, str(tmp_path)).collect()) == sorted(catalog.queries()[name](spark, SF).collect())
