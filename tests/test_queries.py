import datetime as dt
import math

import duckdb
import pytest

from marketlens.plans.catalog import ORACLES, QUERIES
from marketlens.sources.tables import TABLES


@pytest.fixture(scope="module")
def oracle(data):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return con


def plain(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value.replace(tzinfo=None) if isinstance(value, dt.datetime) else value


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows_as_the_oracle(spark, data, oracle, name):
    df = QUERIES[name](spark, data)
    order = sorted(df.columns)
    got = sorted((repr(tuple(plain(r[c]) for c in order)) for r in df.collect()))
    cursor = oracle.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == order
    want = sorted(repr(tuple(plain(r[names.index(c)]) for c in order)) for r in cursor.fetchall())
    assert got == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - {"label_model_quality"}))
def test_models_give_a_row_a_session(spark, data, name):
    rows = QUERIES[name](spark, data).collect()
    assert rows and len({(r.symbol, r.session) for r in rows}) == len(rows)


def test_a_model_is_judged_on_what_it_has_not_seen(spark, data):
    rows = {r.held_out: r for r in QUERIES["label_model_quality"](spark, data).collect()}
    assert set(rows) == {False, True} and all(r.n > 0 and 0 <= r.accuracy <= 1 and 0 <= r.brier <= 1 and r.log_loss > 0 for r in rows.values())


def test_constant_features_correlate_as_in_the_oracle(spark, tmp_path):
    """Larger tables of the same days have their point of control in the lowest bin always."""
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    con.execute(f"""COPY (SELECT k AS event_id, TIMESTAMP '2024-01-01' + to_minutes(20 * k) AS ts, k AS user_id, 'view' AS event_type, CAST(k * k % 7 + (k % 3) * (k // 72 * 5 % 13) AS DOUBLE) AS value, '{{"k": 9}}' AS props
        FROM range(1440) r(k)) TO '{tmp_path}/events.parquet' (FORMAT parquet)""")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = dict(con.execute(ORACLES["feature_corr"]).fetchall())
    assert any(map(math.isnan, want.values())) and not all(map(math.isnan, want.values()))
    assert repr(sorted(map(tuple, QUERIES["feature_corr"](spark, str(tmp_path)).collect()))) == repr(sorted(want.items()))
