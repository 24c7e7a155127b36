import duckdb
import pytest

from marketlens.llm.queries import ORACLES, QUERIES


@pytest.fixture(scope="module")
def oracle(data):
    con = duckdb.connect()
    for t in ("documents", "embeddings", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_the_oracle(spark, data, oracle, name):
    df = QUERIES[name](spark, data)
    order = sorted(df.columns)
    got = sorted(tuple(r[c] for c in order) for r in df.collect())
    cursor = oracle.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == order and got
    assert got == sorted(tuple(r[names.index(c)] for c in order) for r in cursor.fetchall())
