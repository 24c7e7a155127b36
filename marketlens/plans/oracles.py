"""The same queries in DuckDB SQL: a WITH list of stages, of which each query takes those it needs."""

from __future__ import annotations

import re

from marketlens.operators.features import FEATURES
from marketlens.sources.tables import TABLES

STAGES = {
    "ticks": "SELECT event_type AS symbol, ts, event_id AS seq, value AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) AS volume FROM events",
    "hourly": """SELECT symbol, date_trunc('hour', ts) AS bucket, arg_min(price, (ts, seq)) AS open, max(price) AS high, min(price) AS low,
        arg_max(price, (ts, seq)) AS close, CAST(sum(volume) AS BIGINT) AS volume, count(*) AS trades FROM ticks GROUP BY ALL""",
    "daily": """SELECT symbol, CAST(date_trunc('day', bucket) AS TIMESTAMP) AS bucket, arg_min(open, bucket) AS open, max(high) AS high, min(low) AS low,
        arg_max(close, bucket) AS close, CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(trades) AS BIGINT) AS trades FROM hourly GROUP BY symbol, date_trunc('day', bucket)""",
    "spread": "SELECT symbol, CAST(bucket AS DATE) AS session, CAST(floor(low / 5.0) AS BIGINT) AS lo, CAST(floor(high / 5.0) AS BIGINT) AS hi, volume FROM hourly",
    "parts": "SELECT symbol, session, lo, hi - lo + 1 AS n, volume, unnest(range(hi - lo + 1)) AS i FROM spread",
    "profile": "SELECT symbol, session, lo + i AS bin, CAST(sum(volume // n + CASE WHEN i < volume % n THEN 1 ELSE 0 END) AS BIGINT) AS volume FROM parts GROUP BY ALL",
    "spans": "SELECT symbol, session, min(bin) AS lo, max(bin) AS hi, CAST(sum(volume) AS BIGINT) AS total FROM profile GROUP BY ALL",
    "bins": "SELECT symbol, session, total, hi - lo + 1 AS nbins, unnest(range(lo, hi + 1)) AS bin FROM spans",
    "dense": "SELECT b.symbol, b.session, b.bin, b.total, b.nbins, coalesce(p.volume, 0) AS volume FROM bins b LEFT JOIN profile p USING (symbol, session, bin)",
    "poc": "SELECT symbol, session, bin AS poc, volume AS poc_volume FROM profile QUALIFY row_number() OVER (PARTITION BY symbol, session ORDER BY volume DESC, bin) = 1",
    "grow": """SELECT symbol, session, poc AS a, poc AS b, poc_volume AS cum, total, lo, hi FROM poc JOIN spans USING (symbol, session)
        UNION ALL SELECT g.symbol, g.session,
          CASE WHEN u.bin IS NOT NULL AND (d.bin IS NULL OR u.volume >= d.volume) THEN g.a ELSE g.a - 1 END,
          CASE WHEN u.bin IS NOT NULL AND (d.bin IS NULL OR u.volume >= d.volume) THEN g.b + 1 ELSE g.b END,
          g.cum + CASE WHEN u.bin IS NOT NULL AND (d.bin IS NULL OR u.volume >= d.volume) THEN u.volume ELSE d.volume END, g.total, g.lo, g.hi
        FROM grow g LEFT JOIN dense u ON u.symbol = g.symbol AND u.session = g.session AND u.bin = g.b + 1
          LEFT JOIN dense d ON d.symbol = g.symbol AND d.session = g.session AND d.bin = g.a - 1
        WHERE 10 * g.cum < 7 * g.total AND (g.a > g.lo OR g.b < g.hi)""",
    "area": "SELECT symbol, session, poc, min(a) AS val, max(b) AS vah, CAST(max(cum) AS BIGINT) AS va_volume, max(total) AS total FROM grow JOIN poc USING (symbol, session) GROUP BY symbol, session, poc",
    "nodes": """SELECT symbol, session, bin, volume, CASE WHEN volume > below AND volume > above THEN 'HVN' WHEN volume < below AND volume < above THEN 'LVN' END AS kind
        FROM (SELECT *, lag(volume, 1, -1) OVER w AS below, lead(volume, 1, -1) OVER w AS above FROM dense WINDOW w AS (PARTITION BY symbol, session ORDER BY bin))""",
    "kinds": "SELECT *, CASE WHEN volume * nbins > total THEN 'HIGH' WHEN 2 * volume * nbins < total THEN 'LOW' END AS kind FROM dense",
    "sessions": """SELECT symbol, CAST(bucket AS DATE) AS session, arg_min(open, bucket) AS open, arg_max(close, bucket) AS close, max(high) AS high, min(low) AS low,
        max(high) FILTER (k <= 2) AS ib_high, min(low) FILTER (k <= 2) AS ib_low
        FROM (SELECT *, row_number() OVER (PARTITION BY symbol, CAST(bucket AS DATE) ORDER BY bucket) AS k FROM hourly) GROUP BY symbol, CAST(bucket AS DATE)""",
    "prior": "SELECT symbol, session, poc, val, vah, lag(poc) OVER w AS ppoc, lag(val) OVER w AS pval, lag(vah) OVER w AS pvah FROM area WINDOW w AS (PARTITION BY symbol ORDER BY session)",
    "located": """SELECT symbol, session, CAST(floor(open / 5.0) AS BIGINT) AS ob, CAST(floor(close / 5.0) AS BIGINT) AS cb, pval, pvah, ib_high, ib_low,
        high > ib_high AS ext_up, low < ib_low AS ext_down FROM sessions JOIN prior USING (symbol, session)""",
    "structure": """SELECT symbol, session, CASE WHEN pval IS NULL THEN NULL WHEN ob > pvah THEN 'ABOVE' WHEN ob < pval THEN 'BELOW' ELSE 'INSIDE' END AS open_loc,
        CASE WHEN pval IS NULL THEN NULL WHEN cb > pvah THEN 'ABOVE' WHEN cb < pval THEN 'BELOW' ELSE 'INSIDE' END AS close_loc, ib_high, ib_low, ext_up, ext_down FROM located""",
    "held": "SELECT symbol, bin, kind, session, datediff('day', DATE '1970-01-01', session) - row_number() OVER (PARTITION BY symbol, bin, kind ORDER BY session) AS island FROM nodes WHERE kind IS NOT NULL",
    "persistent": "SELECT symbol, bin, kind, min(session) AS first_session, max(session) AS last_session, count(*) AS n_sessions FROM held GROUP BY symbol, bin, kind, island",
    "states": """SELECT symbol, session, CASE WHEN pval IS NULL THEN NULL WHEN val > pvah OR (poc > ppoc AND vah > pvah AND val >= pval) THEN 'UP'
        WHEN vah < pval OR (poc < ppoc AND val < pval AND vah <= pvah) THEN 'DOWN' ELSE 'BALANCE' END AS state FROM prior""",
    "pairs": "SELECT state, lead(state) OVER (PARTITION BY symbol ORDER BY session) AS next_state FROM states WHERE state IS NOT NULL",
    "labels_": "SELECT symbol, session, CAST(sign(lead(close) OVER (PARTITION BY symbol ORDER BY session) - close) AS INTEGER) AS label FROM sessions",
    "features": """SELECT a.symbol, a.session, a.poc, vah - val + 1 AS va_width, coalesce(n_hvn, 0) AS n_hvn, coalesce(n_lvn, 0) AS n_lvn, hi - lo + 1 AS range_bins, state
        FROM area a JOIN spans USING (symbol, session) JOIN states USING (symbol, session)
        LEFT JOIN (SELECT symbol, session, count(*) FILTER (kind = 'HVN') AS n_hvn, count(*) FILTER (kind = 'LVN') AS n_lvn FROM nodes GROUP BY ALL) USING (symbol, session)""",
    "learned": "SELECT f.*, label FROM features f JOIN labels_ USING (symbol, session) WHERE state IS NOT NULL AND label IS NOT NULL",
    "cents": "SELECT symbol, session, CAST(round(close * 100) AS BIGINT) AS c, lead(CAST(round(close * 100) AS BIGINT)) OVER (PARTITION BY symbol ORDER BY session) AS next FROM sessions",
    "trades": "SELECT symbol, session, CASE state WHEN 'UP' THEN 1 WHEN 'DOWN' THEN -1 ELSE 0 END AS position, c, next FROM states JOIN cents USING (symbol, session) WHERE state IS NOT NULL AND next IS NOT NULL",
    "fours": """SELECT symbol, date_trunc('day', bucket) + to_hours(hour(bucket) // 4 * 4) AS bucket, arg_min(open, bucket) AS open, max(high) AS high, min(low) AS low,
        arg_max(close, bucket) AS close, CAST(sum(volume) AS BIGINT) AS volume, CAST(sum(trades) AS BIGINT) AS trades FROM hourly GROUP BY symbol, date_trunc('day', bucket) + to_hours(hour(bucket) // 4 * 4)""",
    "sized": "SELECT '1h' AS interval, * FROM hourly UNION ALL SELECT '4h', * FROM fours UNION ALL SELECT '1d', * FROM daily",
    "ranges": "SELECT interval, symbol, CAST(sum(CAST(round(high * 100) AS BIGINT) - CAST(round(low * 100) AS BIGINT)) AS BIGINT) AS r, count(*) AS n FROM sized GROUP BY ALL",
    "triples": """SELECT symbol, session, state AS s2, lag(state, 1) OVER w AS s1, lag(state, 2) OVER w AS s0 FROM states WHERE state IS NOT NULL WINDOW w AS (PARTITION BY symbol ORDER BY session)""",
    "cells": "SELECT s0, s1, s2, count(*) AS n FROM triples WHERE s0 IS NOT NULL GROUP BY ALL",
    "until": "SELECT session AS until FROM (SELECT session, row_number() OVER (ORDER BY session) AS k, count(*) OVER () AS days FROM (SELECT DISTINCT session FROM states)) WHERE k = floor(0.8 * days)",
    "known": "SELECT t.* FROM triples t, until WHERE s0 IS NOT NULL AND session <= until",
    "later": "SELECT t.* FROM triples t, until WHERE s0 IS NOT NULL AND session > until",
    "split": "SELECT l.*, CASE WHEN label > 0 THEN 1.0 ELSE 0.0 END AS up, session > until AS held_out FROM learned l, until",
    "rates": "SELECT 'base' AS model, 'any' AS by_, (sum(up) + 1) / (count(*) + 2) AS p FROM split WHERE NOT held_out UNION ALL SELECT 'state', state, (sum(up) + 1) / (count(*) + 2) FROM split WHERE NOT held_out GROUP BY state",
    "told": """SELECT m.model, up, CAST(coalesce(p, 0.5) AS DOUBLE) AS p FROM (SELECT 'base' AS model, 'any' AS by_, up FROM split WHERE held_out UNION ALL SELECT 'state', state, up FROM split WHERE held_out) m LEFT JOIN rates r ON r.model = m.model AND r.by_ = m.by_""",
    "hours": "SELECT symbol, unnest(generate_series(min(bucket), max(bucket), INTERVAL 1 HOUR)) AS bucket FROM hourly GROUP BY symbol",
}

# The tables' columns by kind: n numbers, t times, s texts, a arrays.
COLUMNS = {
    "region": "r_regionkey:n r_name:s",
    "nation": "n_nationkey:n n_name:s n_regionkey:n",
    "customer": "c_custkey:n c_name:s c_nationkey:n c_acctbal:n c_mktsegment:s",
    "supplier": "s_suppkey:n s_name:s s_nationkey:n s_acctbal:n",
    "part": "p_partkey:n p_name:s p_brand:s p_type:s p_size:n p_retailprice:n",
    "orders": "o_orderkey:n o_custkey:n o_orderstatus:s o_totalprice:n o_orderdate:t o_orderpriority:s",
    "lineitem": "l_orderkey:n l_partkey:n l_suppkey:n l_linenumber:n l_quantity:n l_extendedprice:n l_discount:n l_tax:n l_returnflag:s l_linestatus:s l_shipdate:t",
    "events": "event_id:n ts:t user_id:n event_type:s value:n props:s",
    "documents": "doc_id:n text:s lang:s source:s n_chars:n",
    "embeddings": "vec_id:n embedding:a label:n",
    "pages": "page_id:n url:s html:s",
    "benchmark": "item_id:n text:s",
    "labels": "doc_id:n quality:n toxic:n",
    "conversations": "conv_id:n turn:n role:s text:s",
}


def _quality(table: str, column: str, kind: str) -> str:
    number = {"n": f"CAST({{}}({column}) AS DOUBLE)", "t": f"CAST(epoch_us({{}}({column})) AS DOUBLE)"}.get(kind, "CAST(NULL AS DOUBLE)")
    text = f"{{}}({column})" if kind == "s" else "CAST(NULL AS VARCHAR)"
    ends = ", ".join(f"{x.format(f)} AS {f}_{name}" for name, x in (("number", number), ("text", text)) for f in ("min", "max"))
    return f"SELECT '{table}' AS name, '{column}' AS \"column\", count(*) - count({column}) AS n_null, count(DISTINCT {column}) AS n_distinct, {ends} FROM {table}"


FINAL = {
    "table_inventory": " UNION ALL ".join(f"SELECT 'public' AS schema, '{t}' AS name, count(*) AS row_count FROM {t}" for t in TABLES),
    "column_quality": " UNION ALL ".join(_quality(t, *c.split(":")) for t, columns in COLUMNS.items() for c in columns.split()),
    "ohlcv_hourly": "SELECT * FROM hourly",
    "ohlcv_resample_daily": "SELECT * FROM daily",
    "vwap_daily": "SELECT symbol, CAST(ts AS DATE) AS session, CAST(sum(CAST(round(price * 100) AS BIGINT) * volume) AS BIGINT) AS cents_volume, CAST(sum(volume) AS BIGINT) AS volume FROM ticks GROUP BY ALL",
    "gap_filled_hourly": "SELECT symbol, bucket, last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY bucket) AS close, coalesce(volume, 0) AS volume FROM hours LEFT JOIN hourly USING (symbol, bucket)",
    "rolling_range": """SELECT symbol, bucket, CAST(sum(volume) OVER (PARTITION BY symbol ORDER BY bucket RANGE BETWEEN INTERVAL 5 HOURS PRECEDING AND CURRENT ROW) AS BIGINT) AS vol_6h,
        max(high) OVER (PARTITION BY symbol ORDER BY bucket ROWS BETWEEN 5 PRECEDING AND CURRENT ROW) AS high_6 FROM hourly""",
    "aggregation_sensitivity": """SELECT interval, symbol, CAST(sum(CAST(round(high * 100) AS BIGINT) - CAST(round(low * 100) AS BIGINT)) AS BIGINT) AS range_cents, count(*) AS n_bars
        FROM sized GROUP BY GROUPING SETS ((interval, symbol), (interval))""",
    "volume_profile": "SELECT * FROM profile",
    "volume_profile_ticks": "SELECT symbol, CAST(ts AS DATE) AS session, CAST(floor(price / 5.0) AS BIGINT) AS bin, CAST(sum(volume) AS BIGINT) AS volume FROM ticks GROUP BY ALL",
    "point_of_control": "SELECT * FROM poc",
    "value_area": "SELECT * FROM area",
    "value_area_ranked": """SELECT symbol, session, min(bin) FILTER (rank = 1) AS poc, min(bin) AS val, max(bin) AS vah FROM (
        SELECT *, sum(volume) OVER w AS cum, sum(volume) OVER (PARTITION BY symbol, session) AS total, row_number() OVER w AS rank FROM profile
        WINDOW w AS (PARTITION BY symbol, session ORDER BY volume DESC, bin ROWS UNBOUNDED PRECEDING)) WHERE 10 * (cum - volume) < 7 * total OR rank = 1 GROUP BY symbol, session""",
    "volume_nodes": "SELECT * FROM nodes WHERE kind IS NOT NULL",
    "node_zones": """SELECT symbol, session, kind, min(bin) AS bin_lo, max(bin) AS bin_hi, CAST(sum(volume) AS BIGINT) AS volume FROM (
        SELECT *, bin - row_number() OVER (PARTITION BY symbol, session, kind ORDER BY bin) AS island FROM kinds WHERE kind IS NOT NULL) GROUP BY symbol, session, kind, island""",
    "auction_structure": "SELECT * FROM structure",
    "persistent_nodes": "SELECT * FROM persistent",
    "node_streaks": "SELECT kind, n_sessions, count(*) AS n_nodes FROM persistent GROUP BY ALL",
    "va_overlap": """SELECT symbol, session, greatest(0, least(vah, pvah) - greatest(val, pval) + 1) AS overlap_bins,
        vah - val + 1 + pvah - pval + 1 - greatest(0, least(vah, pvah) - greatest(val, pval) + 1) AS union_bins FROM prior WHERE pval IS NOT NULL""",
    "market_state": "SELECT * FROM states",
    "state_transitions": """SELECT state, next_state, n, round(n / CAST(sum(n) OVER (PARTITION BY state) AS DOUBLE), 6) AS p FROM (
        SELECT state, next_state, count(*) AS n FROM pairs WHERE next_state IS NOT NULL GROUP BY ALL)""",
    "markov_order2": """SELECT s0, s1, s2, count(*) AS n FROM (SELECT state AS s0, lead(state, 1) OVER w AS s1, lead(state, 2) OVER w AS s2 FROM states WHERE state IS NOT NULL
        WINDOW w AS (PARTITION BY symbol ORDER BY session)) WHERE s2 IS NOT NULL GROUP BY ALL""",
    "universe_sensitivity": """SELECT interval, symbol AS without, round((t - r) / CAST(m - n AS DOUBLE), 6) AS mean_range, round((t - r) / CAST(m - n AS DOUBLE) - t / CAST(m AS DOUBLE), 6) AS change
        FROM (SELECT *, sum(r) OVER (PARTITION BY interval) AS t, sum(n) OVER (PARTITION BY interval) AS m FROM ranges) WHERE m > n""",
    "markov_chi_square": """SELECT s1, CAST(t AS BIGINT) AS n, round(sum((coalesce(c.n, 0) - a * b / CAST(t AS DOUBLE)) ** 2 / (a * b / CAST(t AS DOUBLE))), 6) AS chi2, CAST(dof AS BIGINT) AS dof
        FROM (SELECT s1, s0, sum(n) AS a FROM cells GROUP BY ALL) JOIN (SELECT s1, s2, sum(n) AS b FROM cells GROUP BY ALL) USING (s1)
        JOIN (SELECT s1, sum(n) AS t, (count(DISTINCT s0) - 1) * (count(DISTINCT s2) - 1) AS dof FROM cells GROUP BY s1) USING (s1) LEFT JOIN cells c USING (s0, s1, s2) GROUP BY s1, t, dof""",
    "order_likelihood": " UNION ALL ".join(
        f"""SELECT 'order {k}' AS model, count(*) AS n, round(avg(ln((coalesce(b, 0) + 1) / CAST(coalesce(a, 0) + 3 AS DOUBLE))), 6) AS log_likelihood FROM later l
        LEFT JOIN (SELECT {c} s2, count(*) AS b FROM known GROUP BY ALL) x ON x.s2 = l.s2 {on.format('x')} LEFT JOIN (SELECT {c} count(*) AS a FROM known {'GROUP BY ALL' if k else ''}) y ON true {on.format('y')}"""
        for k, (c, on) in enumerate((("", ""), ("s1,", "AND {0}.s1 = l.s1"), ("s0, s1,", "AND {0}.s1 = l.s1 AND {0}.s0 = l.s0")))
    ),
    "state_prediction": "SELECT model, count(*) AS n, round(avg(CASE WHEN (p >= 0.5) = (up = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(avg((p - up) ** 2), 6) AS brier FROM told GROUP BY model",
    "session_features": "SELECT * FROM features",
    "next_session_label": "SELECT * FROM labels_",
    "state_up_rate": "SELECT state, count(*) AS n, count(*) FILTER (label > 0) AS n_up, round(count(*) FILTER (label > 0) / count(*), 6) AS p_up FROM learned GROUP BY state",
    "acceptance_outcome": "SELECT close_loc, label, count(*) AS n FROM structure JOIN labels_ USING (symbol, session) WHERE close_loc IS NOT NULL AND label IS NOT NULL GROUP BY ALL",
    "feature_corr": " UNION ALL ".join(f"SELECT '{c}' AS feature, round(corr(CAST({c} AS DOUBLE), CAST(label AS DOUBLE)), 6) AS corr FROM learned" for c in FEATURES),
    "strategy_equity": """SELECT symbol, session, position, position * (next - c) AS pnl_cents,
        CAST(sum(position * (next - c)) OVER (PARTITION BY symbol ORDER BY session) AS BIGINT) AS equity_cents FROM trades""",
}

#: Columns that leave in another type, as in the catalog: dates as text, whole numbers with nulls as doubles.
EXPORTED = dict.fromkeys(
    ("vwap_daily", "volume_profile", "volume_profile_ticks", "point_of_control", "value_area", "value_area_ranked", "volume_nodes", "node_zones", "auction_structure", "va_overlap", "market_state", "session_features", "strategy_equity"),
    {"session": "VARCHAR"},
) | {"persistent_nodes": {"first_session": "VARCHAR", "last_session": "VARCHAR"}, "next_session_label": {"session": "VARCHAR", "label": "DOUBLE"}, "acceptance_outcome": {"label": "DOUBLE"}}


def needed(sql: str) -> list[str]:
    """The stages that a statement reads, and those that they read, in order."""
    want: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name, body in STAGES.items():
            if name not in want and re.search(rf"\b(FROM|JOIN|,)\s+{name}\b", text):
                want.add(name)
                todo.append(body)
    return [name for name in STAGES if name in want]


def statement(name: str) -> str:
    final = FINAL[name]
    stages = [f"{s} AS ({STAGES[s]})" for s in needed(final)]
    kinds = EXPORTED.get(name, {})
    if not stages or not kinds:
        return f"WITH RECURSIVE {', '.join(stages)}\n{final}" if stages else final
    shown = ", ".join(f"CAST({c} AS {kind}) AS {c}" for c, kind in kinds.items())
    return f"WITH RECURSIVE {', '.join(stages)},\nfinal AS ({final})\nSELECT * REPLACE ({shown}) FROM final"


ORACLES = {name: statement(name) for name in FINAL}
