"""The queries of this package in SQL for DuckDB, from common table expressions that mirror the definitions."""

from __future__ import annotations

HOUR, DAY = 3_600_000, 86_400_000
TYPES = ("click", "error", "purchase", "signup", "view")


def ticks(table: str = "events", key: str = "event_type", ask: str | None = None) -> str:
    if table == "events":
        return f"SELECT CAST({key} AS VARCHAR) AS key, epoch_us(ts) // 1000 AS time, {ask or 'value'} AS ask, {ask or 'value'} AS bid, event_id AS id FROM events"
    if table == "orders":
        return "SELECT o_orderpriority AS key, epoch_us(o_orderdate) // 1000 AS time, o_totalprice AS ask, o_totalprice AS bid, o_orderkey AS id FROM orders"
    return "SELECT l_returnflag AS key, epoch_us(l_shipdate) // 1000 AS time, l_extendedprice AS ask, l_extendedprice * (1 - l_discount) AS bid, l_orderkey * 100 + l_linenumber AS id FROM lineitem"


def partials(source: str, size: int, keys: tuple[str, ...], by_ask: bool = False) -> str:
    """WITH list: ticks t with start, partial candles p, seen keys, silent keys."""
    bid = "ask" if by_ask else "bid"
    grid = ", ".join(f"'{k}'" for k in keys)
    return f"""WITH t AS (SELECT *, time - time % {size} AS start FROM ({source})),
r AS (SELECT *,
  row_number() OVER (PARTITION BY key, start ORDER BY time DESC, id) AS c,
  row_number() OVER (PARTITION BY key, start ORDER BY {bid}, time, id) AS lb,
  row_number() OVER (PARTITION BY key, start ORDER BY {bid} DESC, time, id) AS hb FROM t),
p AS (SELECT key, start,
  max(CASE WHEN c = 1 THEN time END) AS close_state_time, max(CASE WHEN c = 1 THEN ask END) AS close_ask, max(CASE WHEN c = 1 THEN bid END) AS close_bid,
  min(ask) AS min_ask_price, max(ask) AS max_ask_price, max(CASE WHEN lb = 1 THEN bid END) AS min_bid_price, max(CASE WHEN hb = 1 THEN bid END) AS max_bid_price
  FROM r GROUP BY key, start),
seen AS (SELECT DISTINCT key, start FROM t),
silent AS (SELECT w.start, k.key FROM (SELECT DISTINCT start FROM t) w, (SELECT unnest([{grid}]) AS key) k
  WHERE NOT EXISTS (SELECT 1 FROM seen s WHERE s.start = w.start AND s.key = k.key))"""


def candles(source: str, size: int, keys: tuple[str, ...], skip: bool = False) -> str:
    """Adds g (candles and gaps), f (closes filled), c (complete candles)."""
    return partials(source, size, keys) + f""",
g AS (SELECT key, start, close_state_time AS t0, close_ask AS a0, close_bid AS b0, min_ask_price AS na, max_ask_price AS xa, min_bid_price AS nb, max_bid_price AS xb FROM p
  UNION ALL SELECT key, start, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM silent),
f AS (SELECT key, start, coalesce(t0, start + {size - 1}) AS close_state_time,
  coalesce(last_value(a0 IGNORE NULLS) OVER w, 0.0) AS close_ask, coalesce(last_value(b0 IGNORE NULLS) OVER w, 0.0) AS close_bid,
  last_value(t0 IGNORE NULLS) OVER w IS NOT NULL AS close_is_live, na, xa, nb, xb
  FROM g WINDOW w AS (PARTITION BY key ORDER BY start ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
l AS (SELECT * FROM f{' WHERE close_is_live' if skip else ''}),
c AS (SELECT key, start + {size - 1} AS close_time,
  coalesce(lag(close_state_time) OVER w, close_state_time) AS open_state_time, close_state_time,
  coalesce(lag(close_ask) OVER w, close_ask) AS open_ask, close_ask, close_is_live,
  coalesce(na, close_ask) AS min_ask_price, coalesce(xa, close_ask) AS max_ask_price, coalesce(nb, close_bid) AS min_bid_price, coalesce(xb, close_bid) AS max_bid_price
  FROM l WINDOW w AS (PARTITION BY key ORDER BY start))"""


FLAT = "SELECT key, close_time, open_state_time, close_state_time, open_ask, close_ask, close_is_live, min_ask_price, max_ask_price, min_bid_price, max_bid_price FROM c"
PARTIAL = "SELECT key, start, close_state_time, close_ask, close_bid, min_ask_price, max_ask_price, min_bid_price, max_bid_price FROM p"


def returns(source: str, size: int, keys: tuple[str, ...]) -> str:
    return candles(source, size, keys) + """,
x AS (SELECT key, close_time, close_state_time AS time, CASE
  WHEN open_ask = 0 AND close_ask > 0 THEN CAST('inf' AS DOUBLE) WHEN open_ask = 0 THEN CAST('nan' AS DOUBLE)
  WHEN close_ask = 0 THEN CAST('-inf' AS DOUBLE) WHEN close_ask / open_ask < 0 THEN CAST('nan' AS DOUBLE)
  ELSE ln(close_ask / open_ask) END AS value FROM c)"""


def sliding(base: str, size: int, slide: int) -> str:
    """Adds s: points with each sliding window's start."""
    n = -(-size // slide)
    return base + f""",
s AS (SELECT x.*, x.close_time - x.close_time % {slide} - i * {slide} AS w_start FROM x, (SELECT unnest(range({n})) AS i) WHERE x.close_time - x.close_time % {slide} - i * {slide} + {size} > x.close_time)"""


def label(size: int) -> str:
    instant = lambda e: f"strftime(epoch_ms(CAST({e} AS BIGINT)), '%Y-%m-%dT%H:%M:%S.%g') || 'Z'"
    return f"'[' || {instant('w_start')} || '..' || {instant(f'w_start + {size}')} || ')'"


def rounded(value: str) -> str:
    return f"CASE WHEN isnan({value}) OR isinf({value}) THEN {value} ELSE round({value}, 9) + 0.0 END"


def correlated(base: str, size: int, slide: int, keep: str, where: str = "TRUE") -> str:
    return sliding(base, size, slide) + f""",
q AS (SELECT a.w_start, a.key AS key1, b.key AS key2, count(*) AS n,
  CASE WHEN bool_or(isnan(a.value) OR isinf(a.value) OR isnan(b.value) OR isinf(b.value)) OR stddev_pop(CASE WHEN isnan(a.value) OR isinf(a.value) THEN 0 ELSE a.value END) * stddev_pop(CASE WHEN isnan(b.value) OR isinf(b.value) THEN 0 ELSE b.value END) = 0
    THEN CAST('nan' AS DOUBLE)
    ELSE covar_pop(CASE WHEN isnan(a.value) OR isinf(a.value) THEN 0 ELSE a.value END, CASE WHEN isnan(b.value) OR isinf(b.value) THEN 0 ELSE b.value END)
      / (stddev_pop(CASE WHEN isnan(a.value) OR isinf(a.value) THEN 0 ELSE a.value END) * stddev_pop(CASE WHEN isnan(b.value) OR isinf(b.value) THEN 0 ELSE b.value END)) END AS r
  FROM s a JOIN s b ON a.w_start = b.w_start AND a.close_time = b.close_time AND a.key < b.key WHERE {where} GROUP BY ALL)
SELECT w_start + {size - 1} AS time, key1 || ' :: ' || key2 AS key, CASE WHEN isnan(r) THEN 1.0 ELSE round(r, 9) + 0.0 END AS value,
  CAST(n AS INTEGER) AS x_count, CAST(n AS INTEGER) AS y_count, isnan(r) AS is_nan, {label(size)} AS "window" FROM q WHERE n >= 2 AND ({keep})"""


def partition(key: str, n: int = 20) -> str:
    return f"CAST(CAST('0x' || substr(md5({key}), 1, 13) AS BIGINT) % {n} AS INTEGER)"


EVENTS = ticks()
QUARTER = (*TYPES, "absent")
USERS = tuple(str(i) for i in range(1, 21))
LINES = ("A", "N", "R")
PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
HOURLY = returns(EVENTS, HOUR, TYPES)
MIXED = returns(ticks(ask="CASE WHEN event_type = 'error' THEN 5.0 ELSE value END"), HOUR, TYPES)
ALL_PAIRS = correlated(HOURLY, DAY, DAY // 4, "TRUE")
#: Gaps are filled for the keys of the table in place of a list of keys.
EVERY_USER = returns(ticks(key="user_id"), 6 * HOUR, ("*",)).replace("(SELECT unnest(['*']) AS key) k", "(SELECT DISTINCT key FROM t WHERE key IS NOT NULL) k")
USER_PAIRS = " AND ".join(f"{side}.key IN ({', '.join(repr(u) for u in USERS)})" for side in ("a", "b"))

DEMO = """SELECT 'TS-' || s AS key, 1451577600000 + m * 60000 AS time, CAST(CASE WHEN s <= 2 THEN 1 + o ELSE 10 - o END AS DOUBLE) AS ask,
  CAST(CASE WHEN s <= 2 THEN 1 + o ELSE 10 - o END AS DOUBLE) AS bid, m AS id
  FROM (SELECT unnest(range(1, 5)) AS s), (SELECT m, CASE WHEN m < 5 THEN m ELSE 9 - m END AS o FROM (SELECT unnest(range(10)) AS m)) WHERE s <= 2 OR m NOT IN (2, 3, 7, 8)"""

ORACLES: dict[str, str] = {
    "ticks_assign_time": f"SELECT key, time, time AS ts_ms, ask, bid, id, TRUE AS is_live FROM ({EVENTS})",
    "ticks_printed": f"SELECT key || ':' || ask || ':' || bid || ':' || time AS line, key FROM ({EVENTS})",
    "candles_json": candles(EVENTS, HOUR, TYPES) + " SELECT key, close_time, open_ask, close_ask, max_bid_price AS max_bid_bid FROM c",
    "ticks_in_time": candles(EVENTS, HOUR, TYPES) + " " + FLAT,
    "dates_parsed": f"SELECT o_orderkey, epoch_ms(date_trunc('second', o_orderdate)) - {8 * HOUR} AS ms FROM orders",
    "random_series": "SELECT 'R-' || k AS key, 1451577600000 + i * 60000 AS time, TRUE AS sound FROM (SELECT unnest(range(5)) AS k), (SELECT unnest(range(200)) AS i)",
    "ticks_total": "SELECT count(*) AS n FROM events",
    "tumbling_count": partials(EVENTS, HOUR, TYPES) + " SELECT start, count(*) AS n_ticks FROM t GROUP BY start",
    "distinct_keys_per_window": partials(EVENTS, HOUR, TYPES) + " SELECT start, count(*) AS n_keys FROM seen GROUP BY start",
    "missing_keys_per_window": partials(EVENTS, HOUR // 4, QUARTER) + " SELECT start, key FROM silent",
    "generated_ticks": partials(EVENTS, HOUR // 4, QUARTER) + f" SELECT key, start + {HOUR // 4 - 1} AS time, 0.0::DOUBLE AS ask, 0.0::DOUBLE AS bid, FALSE AS is_live FROM silent",
    "complete_ticks_union": partials(EVENTS, HOUR // 4, QUARTER) + f" SELECT key, time, ask, bid, TRUE AS is_live FROM t UNION ALL SELECT key, start + {HOUR // 4 - 1}, 0.0::DOUBLE, 0.0::DOUBLE, FALSE FROM silent",
    "partial_candles": partials(EVENTS, HOUR, TYPES) + " " + PARTIAL,
    "partial_candles_bid_ask": partials(ticks("lineitem"), 7 * DAY, LINES) + " " + PARTIAL,
    "partial_candles_bid_by_ask": partials(ticks("lineitem"), 7 * DAY, LINES, by_ask=True) + " " + PARTIAL,
    "window_end_stamp": partials(EVENTS, HOUR, TYPES) + f" SELECT key, start + {HOUR - 1} AS close_time FROM seen",
    "complete_candles": candles(EVENTS, HOUR // 4, QUARTER) + " " + FLAT,
    "sparse_candles": candles(ticks(key="user_id"), 6 * HOUR, USERS) + " " + FLAT,
    "candles_without_leading_gaps": candles(EVENTS, HOUR // 4, QUARTER, skip=True) + " " + FLAT,
    "lineitem_candles": candles(ticks("lineitem"), 7 * DAY, LINES) + " " + FLAT,
    "orders_priority_candles": candles(ticks("orders"), 7 * DAY, PRIORITIES) + " " + FLAT,
    "stream_candles": candles(EVENTS, HOUR, TYPES) + " " + FLAT,
    "end_of_time_filter": candles(EVENTS, HOUR, TYPES) + " " + FLAT,
    "log_returns": HOURLY + f" SELECT key, close_time, time, {rounded('value')} AS value FROM x",
    "sliding_points": sliding(HOURLY, DAY, DAY // 4) + " SELECT w_start, key, count(*) AS n_points, min(time) AS first_time, max(time) AS last_time FROM s GROUP BY ALL",
    "work_packets": sliding(HOURLY, DAY, DAY // 4) + " SELECT w_start, key, row_number() OVER (PARTITION BY w_start, key ORDER BY time, value) - 1 AS position, time FROM s",
    "pair_keys_configured": f"SELECT key1, key2, pair, {partition('pair')} AS part FROM (SELECT a.n_name AS key1, b.n_name AS key2, a.n_name || ' :: ' || b.n_name AS pair FROM nation a JOIN nation b ON a.n_name < b.n_name)",
    "pairs_by_partition": f"SELECT part, count(DISTINCT key) AS n_pairs, count(*) AS n_rows, CAST(1 AS BIGINT) AS n_tasks FROM (SELECT key, {partition('key')} AS part FROM ({ALL_PAIRS})) GROUP BY part",
    "pearson_matrix_in_blocks": correlated(HOURLY, DAY, DAY // 4, "NOT isnan(r) AND abs(r) >= 0.3"),
    "pearson_mismatch_error": ALL_PAIRS,
    "stream_correlations": ALL_PAIRS,
    "pair_points_observed": sliding(HOURLY, DAY, DAY // 4) + " SELECT a.w_start, a.key AS key1, b.key AS key2, count(*) AS n_points, max(a.time) AS last1, max(b.time) AS last2 FROM s a JOIN s b ON a.w_start = b.w_start AND a.close_time = b.close_time AND a.key < b.key GROUP BY ALL",
    "pearson_all_pairs": ALL_PAIRS,
    "pearson_thresholded": correlated(HOURLY, DAY, DAY // 4, "NOT isnan(r) AND abs(r) >= 0.3"),
    "pearson_nan_policy": correlated(MIXED, DAY, DAY // 4, "isnan(r) OR abs(r) >= 0.2"),
    "pearson_nan_dropped": correlated(MIXED, DAY, DAY // 4, "NOT isnan(r)"),
    "pearson_partitioned": correlated(HOURLY, DAY, DAY // 4, "TRUE", "a.key IN ('click', 'view', 'purchase') AND b.key IN ('click', 'view', 'purchase')"),
    "pearson_by_position": ALL_PAIRS,
    "pearson_matrix": ALL_PAIRS,
    "pearson_underlying": sliding(HOURLY, DAY, DAY // 4) + f" SELECT a.w_start + {DAY - 1} AS time, a.key || ' :: ' || b.key AS key, a.time AS x_time, b.time AS y_time, round(a.value, 9) AS x, round(b.value, 9) AS y FROM s a JOIN s b ON a.w_start = b.w_start AND a.close_time = b.close_time AND a.key < b.key QUALIFY count(*) OVER (PARTITION BY a.w_start, a.key, b.key) >= 2",
    "candles_by_key_sorted": candles(EVENTS, HOUR, TYPES) + " SELECT key, row_number() OVER (PARTITION BY key ORDER BY close_time) - 1 AS position, close_time, open_ask AS open, close_ask AS close FROM c",
    "corr_by_time": f"SELECT time, count(*) AS n, min(key) AS first_key FROM ({ALL_PAIRS}) GROUP BY time",
    "sparse_user_correlations": correlated(returns(ticks(key="user_id"), 6 * HOUR, USERS), 4 * DAY, 2 * DAY, "TRUE", USER_PAIRS),
    "all_user_correlations": correlated(EVERY_USER, 4 * DAY, 2 * DAY, "TRUE"),
    "demo_correlations": correlated(returns(DEMO, 120_000, ("TS-1", "TS-2", "TS-3", "TS-4")), 600_000, 300_000, "TRUE"),
}
