import duckdb
import pytest

import __spark_entry__ as entry
from tests.llm.conftest import SF


def test_one_query_for_each_operator():
    names = [n for n in entry.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14)) and "pipeline" in entry.queries()


@pytest.mark.parametrize("name", ["op2_chat", "op3_warc", "op4_substring", "op6_mixing", "op8_minhash", "op9_ann", "op11_sources", "pii_base"])
def test_queries_agree_with_sql(spark, name):
    con = duckdb.connect()
    for t in ("conversations", "pages", "documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = entry.queries()[name](spark, SF)
    sql = con.sql(entry.oracle_sql()[name])
    order = [sql.columns.index(c) for c in df.columns]
    key = lambda row: tuple(str(round(x, 6)) if isinstance(x, float) else str(x) for x in row)
    assert sorted(map(key, df.collect())) == sorted(key([row[i] for i in order]) for row in sql.fetchall())
