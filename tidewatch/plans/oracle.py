"""DuckDB SQL for each catalog query (the correctness oracle).

Tables ``events``, ``lineitem``, ``part`` ... are views over the same
parquet files. Column names match the Spark queries one to one.
"""

from __future__ import annotations

W = 1000
EV_ORDER = "ts, event_id"
TR_ORDER = "ts, l_orderkey, l_linenumber, l_partkey"
EV_ORDER_DESC = "ts DESC, event_id DESC"
TR_ORDER_DESC = "ts DESC, l_orderkey DESC, l_linenumber DESC, l_partkey DESC"

EVENTS_LONG = "events_l AS (SELECT event_id, ts, event_type, 'value' AS feature, value FROM events WHERE value IS NOT NULL)"

TRADES = """trades AS (
  SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey) AS event_id, l_shipdate AS ts,
    l_orderkey, l_linenumber, l_partkey, l_suppkey, p_brand,
    l_extendedprice AS declared_value, l_quantity AS quantity, l_quantity * p_size AS weight_kg,
    CASE WHEN l_extendedprice IS NOT NULL AND l_quantity > 0 THEN l_extendedprice / l_quantity END AS unit_price
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey
)"""

TRADES_LINE7 = """trades7 AS (
  SELECT * REPLACE (CASE WHEN l_linenumber <> 7 THEN weight_kg END AS weight_kg) FROM trades
)"""


def trades_long(src: str = "trades", name: str = "trades_long") -> str:
    return f"""{name} AS (
  SELECT event_id, ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, p_brand, feature, value
  FROM (UNPIVOT (SELECT event_id, ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, p_brand,
                        declared_value, quantity, weight_kg, unit_price FROM {src})
        ON declared_value, quantity, weight_kg, unit_price INTO NAME feature VALUE value)
  WHERE value IS NOT NULL
)"""


def stats(src: str, name: str, order: str, part: str = "feature", window: int = W) -> str:
    p = f"PARTITION BY {part} " if part else ""
    return f"""{name}_raw AS (
  SELECT *, count(value) OVER w AS win_count, avg(value) OVER w AS _m, stddev_samp(value) OVER w AS _sd,
    min(value) OVER w AS _mn, max(value) OVER w AS _mx,
    quantile_cont(value, 0.25) OVER w AS _q1, quantile_cont(value, 0.5) OVER w AS _q2,
    quantile_cont(value, 0.75) OVER w AS _q3
  FROM {src}
  WINDOW w AS ({p}ORDER BY {order} ROWS BETWEEN {window - 1} PRECEDING AND CURRENT ROW)
), {name} AS (
  SELECT * EXCLUDE (_m, _sd, _mn, _mx, _q1, _q2, _q3),
    CASE WHEN win_count >= 2 THEN _m END AS win_mean,
    CASE WHEN win_count >= 2 THEN CASE WHEN _mn = _mx THEN 0.0 ELSE _sd END END AS win_std,
    CASE WHEN win_count >= 2 THEN _mn END AS win_min,
    CASE WHEN win_count >= 2 THEN _mx END AS win_max,
    CASE WHEN win_count >= 2 THEN _q1 END AS win_p25,
    CASE WHEN win_count >= 2 THEN _q2 END AS win_median,
    CASE WHEN win_count >= 2 THEN _q3 END AS win_p75,
    CASE WHEN win_count >= 2 THEN _q3 - _q1 END AS win_iqr,
    CASE WHEN win_count >= 2 THEN CASE WHEN _mn < _mx AND _sd > 0 THEN (value - _m) / _sd ELSE 0.0 END END AS zscore
  FROM {name}_raw
)"""


def verdict(src: str, name: str, z: float = 3.0, k: float = 1.5, least: int = 30) -> str:
    return f"""{name}_g AS (
  SELECT *, (coalesce(win_count < {least}, true) OR win_std IS NULL) AS _gate FROM {src}
), {name}_f AS (
  SELECT *,
    (NOT _gate AND coalesce(abs(zscore) > {z}, false)) AS z_flag,
    (NOT _gate AND coalesce(win_iqr <> 0 AND (value < win_p25 - {k} * win_iqr OR value > win_p75 + {k} * win_iqr), false)) AS iqr_flag,
    win_p25 - {k} * win_iqr AS lower_fence, win_p75 + {k} * win_iqr AS upper_fence,
    CASE WHEN _gate THEN 0.0 ELSE abs(zscore) END AS score,
    CASE WHEN _gate THEN 'insufficient_samples' END AS reason
  FROM {name}_g
), {name} AS (
  SELECT *, z_flag OR iqr_flag AS is_anomaly,
    CASE WHEN z_flag THEN 'zscore' WHEN iqr_flag THEN 'iqr' END AS anomaly_type
  FROM {name}_f
)"""


SEVERITY = ("CASE WHEN score >= 5.0 THEN 'CRITICAL' WHEN score >= 4.0 THEN 'HIGH' "
            "WHEN score >= 3.0 THEN 'MEDIUM' WHEN score >= 2.0 THEN 'LOW' ELSE 'LOW' END")

EV_CHAIN = ",\n".join([EVENTS_LONG, stats("events_l", "ev_stats", EV_ORDER), verdict("ev_stats", "ev_v")])
EV_ANOM = EV_CHAIN + f""",
ev_anom AS (SELECT *, {SEVERITY} AS severity FROM ev_v WHERE is_anomaly)"""

STATS_OUT = ("win_count, round(win_mean, 6) AS win_mean, round(win_std, 6) AS win_std, round(win_min, 6) AS win_min, "
             "round(win_max, 6) AS win_max, round(win_p25, 6) AS win_p25, round(win_median, 6) AS win_median, "
             "round(win_p75, 6) AS win_p75, round(win_iqr, 6) AS win_iqr, round(zscore, 6) AS zscore")


def chain(src: str, name: str, keys: list[str], gap_us: int, order: str = "event_id") -> str:
    """Chain windows by recursion over next-pointers: the next opening after
    an opening at t is the first row of the key with time >= t + gap."""
    k = ", ".join(keys)
    kc = k + ", " if keys else ""
    pk = f"PARTITION BY {k} " if keys else ""
    eq = lambda l, r: " AND ".join([f"{l}.{c} = {r}.{c}" for c in keys] + [""])
    return f"""{name}_a AS (
  SELECT *, epoch_us(ts) AS _t FROM {src}
), {name}_n AS (
  SELECT DISTINCT {kc}_t FROM {name}_a
), {name}_u AS (
  SELECT {kc}_t + {gap_us} AS _x, 0 AS _kind, _t AS _src FROM {name}_n
  UNION ALL
  SELECT {kc}_t AS _x, 1 AS _kind, NULL AS _src FROM {name}_n
), {name}_nx AS MATERIALIZED (
  SELECT {kc}_src AS _t, _next FROM (
    SELECT *, min(CASE WHEN _kind = 1 THEN _x END) OVER ({pk}ORDER BY _x, _kind
      ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS _next FROM {name}_u
  ) WHERE _kind = 0
), {name}_opens AS (
  WITH RECURSIVE o AS (
    SELECT {kc}min(_t) AS _t FROM {name}_n {"GROUP BY " + k if keys else ""}
    UNION ALL
    SELECT {", ".join([f"x.{c}" for c in keys] + ["x._next"])} FROM o JOIN {name}_nx x ON {eq("x", "o")}x._t = o._t
    WHERE x._next IS NOT NULL
  ) SELECT {kc}_t AS _ot FROM o
), {name}_m AS (
  SELECT a.*, o._ot FROM {name}_a a LEFT JOIN {name}_opens o ON {eq("a", "o")}a._t = o._ot
), {name}_w AS (
  SELECT * EXCLUDE (_ot), last_value(_ot IGNORE NULLS) OVER ({pk}ORDER BY _t, {order}
    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _wstart FROM {name}_m
), {name} AS (
  SELECT *, row_number() OVER (PARTITION BY {kc}_wstart ORDER BY _t, {order}) AS _rank FROM {name}_w
)"""


ORACLE: dict[str, str] = {}

ORACLE["scan_trade_events"] = """
SELECT event_id AS offset, CAST(event_id AS VARCHAR) AS event_id, event_type AS commodity_code,
  round(value, 6) AS declared_value, round(CAST(json_extract(props, '$.k') AS DOUBLE), 6) AS quantity
FROM events WHERE event_type IS DISTINCT FROM 'error'
"""

ORACLE["dead_letter_events"] = "SELECT event_id AS offset, 'malformed' AS reason FROM events WHERE event_type = 'error'"

ORACLE["derive_unit_price"] = f"WITH {TRADES} SELECT event_id, round(unit_price, 6) AS unit_price FROM trades"

ORACLE["cast_features"] = """
SELECT event_id, round(TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE), 6) AS quantity FROM events"""

ORACLE["unpivot_features"] = f"WITH {TRADES}, {trades_long()} SELECT event_id, feature, round(value, 6) AS value FROM trades_long"

ORACLE["rolling_stats"] = f"WITH {EVENTS_LONG}, {stats('events_l', 'ev_stats', EV_ORDER)} SELECT event_id, {STATS_OUT} FROM ev_stats"
_GAPS = """events_g AS (SELECT event_id, ts, 'value' AS feature, CASE WHEN event_id % 7 = 0 THEN NULL
  WHEN event_id % 11 = 0 THEN CAST('nan' AS DOUBLE) ELSE value END AS value FROM events)"""
ORACLE["rolling_stats_nulls"] = (
    f"WITH {_GAPS}, ev_k AS (SELECT * FROM events_g WHERE value IS NOT NULL AND NOT isnan(value)), "
    f"{stats('ev_k', 'ev_stats', EV_ORDER)} SELECT event_id, {STATS_OUT} FROM ev_stats")

ORACLE["rolling_stats_multi"] = (
    f"WITH {TRADES}, {trades_long()}, {stats('trades_long', 'tr_stats', TR_ORDER)} "
    f"SELECT event_id, feature, {STATS_OUT} FROM tr_stats")

ORACLE["rolling_stats_scoped"] = (
    f"WITH {TRADES}, {trades_long()}, {stats('trades_long', 'tr_stats', TR_ORDER, part='l_suppkey, feature', window=100)} "
    f"SELECT event_id, feature, {STATS_OUT} FROM tr_stats")

ORACLE["rolling_stats_frame"] = (
    f"WITH {TRADES}, {trades_long()}, {stats('trades_long', 'tr_stats', TR_ORDER, part='l_suppkey, feature', window=20)} "
    f"SELECT event_id, feature, {STATS_OUT} FROM tr_stats")

ORACLE["rolling_stats_reset"] = f"""
WITH ev_r AS (
  SELECT event_id, ts, 'value' AS feature, value,
    sum(CASE WHEN event_type = 'signup' THEN 1 ELSE 0 END) OVER (ORDER BY {EV_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _epoch
  FROM events WHERE value IS NOT NULL
), {stats('ev_r', 'ev_stats', EV_ORDER, part='feature, _epoch')}
SELECT event_id, {STATS_OUT} FROM ev_stats"""

ORACLE["rolling_stats_reset_gaps"] = f"""
WITH {_GAPS}, ev_e AS (
  SELECT g.*, sum(CASE WHEN event_type = 'signup' AND g.event_id % 5 < 2 THEN 1 ELSE 0 END)
    OVER (ORDER BY g.ts, g.event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS _epoch
  FROM events_g g JOIN events e USING (event_id)
), ev_k AS (SELECT * FROM ev_e WHERE value IS NOT NULL AND NOT isnan(value)),
{stats('ev_k', 'ev_stats', EV_ORDER, part='feature, _epoch')}
SELECT event_id, {STATS_OUT} FROM ev_stats"""

ORACLE["zscore_vs_snapshot"] = f"""
WITH snap AS (SELECT value FROM events WHERE value IS NOT NULL ORDER BY {EV_ORDER_DESC} LIMIT {W}),
st AS (SELECT count(value) AS n, avg(value) AS m, stddev_samp(value) AS sd FROM snap)
SELECT e.event_id, round(CASE WHEN st.n >= 2 THEN CASE WHEN st.sd > 0 THEN (e.value - st.m) / st.sd ELSE 0.0 END END, 6) AS zscore
FROM events e CROSS JOIN st"""

ORACLE["window_snapshot"] = f"""
WITH {TRADES}, {trades_long()},
r AS (SELECT feature, value, row_number() OVER (PARTITION BY feature ORDER BY {TR_ORDER_DESC}) AS rn,
             count(*) OVER (PARTITION BY feature) AS cnt FROM trades_long)
SELECT feature, CAST(least(cnt, {W}) - rn + 1 AS INTEGER) AS pos, round(value, 6) AS value FROM r WHERE rn <= {W}"""

ORACLE["window_snapshot_2000"] = ORACLE["window_snapshot"].replace(f"least(cnt, {W})", "least(cnt, 2000)").replace(
    f"rn <= {W}", "rn <= 2000")

_ZC = ["declared_value", "quantity", "weight_kg", "unit_price"]
VECTORS = f"""{TRADES}, {TRADES_LINE7}, {trades_long('trades7')}, {stats('trades_long', 'tr_stats', TR_ORDER)},
z AS (
  SELECT event_id, ts, l_orderkey, l_linenumber, l_partkey, feature, zscore FROM tr_stats
  UNION ALL
  SELECT event_id, ts, l_orderkey, l_linenumber, l_partkey, NULL, NULL FROM trades7
), wide AS (
  SELECT event_id, ts, l_orderkey, l_linenumber, l_partkey,
    {", ".join(f"max(CASE WHEN feature = '{f}' THEN zscore END) AS z_{f}" for f in _ZC)}
  FROM z GROUP BY event_id, ts, l_orderkey, l_linenumber, l_partkey
), filled AS (
  SELECT event_id, ts, l_orderkey, l_linenumber, l_partkey,
    {", ".join(f"last_value(z_{f} IGNORE NULLS) OVER w AS z_{f}" for f in _ZC)}
  FROM wide WINDOW w AS (ORDER BY {TR_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), vec AS (
  SELECT *, ({" AND ".join(f"z_{f} IS NOT NULL" for f in _ZC)}) AS vector_ready FROM filled
)"""

ORACLE["feature_vectors"] = f"""
WITH {VECTORS}
SELECT event_id, {", ".join(f"round(z_{f}, 6) AS z_{f}" for f in _ZC)}, vector_ready FROM vec"""

# isolation-forest schedule: interval 5000, buffer 1000, first training at n0 = 5000
_I, _B, _N0 = 5000, 1000, 5000
EPOCHS = f"""{VECTORS},
seq AS (SELECT event_id, row_number() OVER (ORDER BY {TR_ORDER}) AS n FROM vec WHERE vector_ready),
ep AS (SELECT event_id, n, CAST(CASE WHEN n < {_N0} THEN 0 ELSE 1 + (n - {_N0}) // {_I} END AS BIGINT) AS model FROM seq),
tot AS (SELECT coalesce(max(n), 0) AS nmax, coalesce(max(model), 0) AS mmax FROM ep)"""

ORACLE["forest_epochs"] = f"WITH {EPOCHS} SELECT event_id, n, model FROM ep"

_TR_SC = "trades_s AS (SELECT * REPLACE (CASE WHEN l_partkey % 7 <> 0 THEN weight_kg END AS weight_kg) FROM trades)"
ORACLE["forest_epochs_scoped"] = f"""
WITH {TRADES}, {_TR_SC}, {trades_long('trades_s')}, {stats('trades_long', 'tr_stats', TR_ORDER, part='l_linenumber, feature', window=200)},
z AS (
  SELECT event_id, ts, l_orderkey, l_linenumber, l_partkey, feature, zscore FROM tr_stats
  UNION ALL SELECT event_id, ts, l_orderkey, l_linenumber, l_partkey, NULL, NULL FROM trades_s
), wide AS (
  SELECT event_id, ts, l_orderkey, l_linenumber, l_partkey,
    {", ".join(f"max(CASE WHEN feature = '{f}' THEN zscore END) AS z_{f}" for f in _ZC)}
  FROM z GROUP BY event_id, ts, l_orderkey, l_linenumber, l_partkey
), filled AS (
  SELECT event_id, ts, l_orderkey, l_linenumber, l_partkey,
    {", ".join(f"last_value(z_{f} IGNORE NULLS) OVER w AS z_{f}" for f in _ZC)}
  FROM wide WINDOW w AS (PARTITION BY l_linenumber ORDER BY {TR_ORDER} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
), seq AS (
  SELECT *, row_number() OVER (PARTITION BY l_linenumber ORDER BY {TR_ORDER}) AS n FROM filled
  WHERE {" AND ".join(f"z_{f} IS NOT NULL" for f in _ZC)}
)
SELECT event_id, l_linenumber, n, CAST(CASE WHEN n < 500 THEN 0 ELSE 1 + (n - 500) // 500 END AS BIGINT) AS model,
  {", ".join(f"round(z_{f}, 6) AS z_{f}" for f in _ZC)} FROM seq"""

ORACLE["forest_training_slices"] = f"""
WITH {EPOCHS},
models AS (SELECT range AS model, {_N0} + (range - 1) * {_I} AS nm FROM tot, range(1, tot.mmax + 1))
SELECT m.model, min(s.n) AS first_n, max(s.n) AS last_n, count(*) AS train_rows
FROM models m JOIN seq s ON s.n > m.nm - {_B} AND s.n <= m.nm GROUP BY m.model"""

_STATUS = f"""SELECT mmax > 0 AS is_trained, CAST(nmax AS BIGINT) AS total_seen, CAST(least(nmax, {_B}) AS BIGINT) AS buffer_count,
  CAST(mmax AS BIGINT) AS retrains,
  CAST(CASE WHEN mmax > 0 THEN least({_N0} + (mmax - 1) * {_I}, {_B}) ELSE 0 END AS BIGINT) AS training_samples FROM tot"""
ORACLE["forest_status"] = f"WITH {EPOCHS} {_STATUS}"
ORACLE["metric_forest"] = f"WITH {EPOCHS}, st AS ({_STATUS}) SELECT retrains AS retrains_total, training_samples FROM st"

ORACLE["metric_window_size"] = f"""
WITH {TRADES}, {trades_long()}
SELECT feature, CAST(least(count(*), {W}) AS BIGINT) AS window_size FROM trades_long GROUP BY feature"""

ORACLE["detect_combined"] = f"""
WITH {EV_CHAIN}
SELECT event_id, z_flag, iqr_flag, is_anomaly, anomaly_type, round(score, 6) AS score,
  round(lower_fence, 6) AS lower_fence, round(upper_fence, 6) AS upper_fence, reason FROM ev_v"""

ORACLE["detect_details"] = f"""
WITH {EV_CHAIN}
SELECT event_id, round(zscore, 6) AS zscore, CAST(3.0 AS DOUBLE) AS zscore_threshold, z_flag AS zscore_flag,
  round(win_iqr, 6) AS iqr, round(lower_fence, 6) AS lower_fence, round(upper_fence, 6) AS upper_fence, iqr_flag,
  round(win_mean, 6) AS window_mean, round(win_std, 6) AS window_std, win_count AS window_count, reason
FROM ev_v WHERE is_anomaly"""

ORACLE["detect_details_custom"] = f"""
WITH {EVENTS_LONG}, {stats("events_l", "ev_stats", EV_ORDER)}, {verdict("ev_stats", "ev_v", 2.0, 3.0, 100)}
SELECT event_id, anomaly_type, {SEVERITY} AS severity, round(zscore, 6) AS zscore, CAST(2.0 AS DOUBLE) AS zscore_threshold,
  z_flag AS zscore_flag, round(win_iqr, 6) AS iqr, round(lower_fence, 6) AS lower_fence, round(upper_fence, 6) AS upper_fence,
  iqr_flag, round(win_mean, 6) AS window_mean, round(win_std, 6) AS window_std, win_count AS window_count, reason
FROM ev_v WHERE is_anomaly"""

ORACLE["detect_nan"] = f"""
WITH {_GAPS}, b AS (SELECT avg(value) AS m, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi FROM events),
f AS (SELECT event_id, value, lo + 0.25 * (hi - lo) AS q1, lo + 0.3 * (hi - lo) AS q3,
        CASE WHEN sd > 0 THEN (value - m) / sd ELSE 0.0 END AS z FROM events_g CROSS JOIN b),
g AS (SELECT *, coalesce(NOT isnan(z) AND abs(z) > 3.0, false) AS z_flag,
        coalesce(NOT isnan(value) AND q3 <> q1 AND (value < q1 - 1.5 * (q3 - q1) OR value > q3 + 1.5 * (q3 - q1)), false) AS iqr_flag FROM f)
SELECT event_id, z_flag, iqr_flag, z_flag OR iqr_flag AS is_anomaly,
  CASE WHEN z_flag THEN 'zscore' WHEN iqr_flag THEN 'iqr' END AS anomaly_type,
  round(CASE WHEN isnan(z) THEN 0.0 ELSE abs(z) END, 6) AS score FROM g"""

ORACLE["detect_multi_feature"] = f"""
WITH {TRADES}, {trades_long()}, {stats('trades_long', 'tr_stats', TR_ORDER)}, {verdict('tr_stats', 'tr_v')}
SELECT event_id, feature, is_anomaly, anomaly_type, round(score, 6) AS score FROM tr_v"""

ORACLE["detect_vs_baseline"] = f"""
WITH {TRADES},
base AS (
  SELECT p_brand, count(declared_value) AS win_count, avg(declared_value) AS win_mean,
    stddev_samp(declared_value) AS win_std,
    quantile_cont(declared_value, 0.25) AS win_p25, quantile_cont(declared_value, 0.75) AS win_p75
  FROM trades GROUP BY p_brand
), sc AS (
  SELECT t.event_id, t.p_brand, t.declared_value AS value, b.win_count, b.win_std, b.win_p25, b.win_p75,
    b.win_p75 - b.win_p25 AS win_iqr,
    CASE WHEN b.win_count >= 2 THEN CASE WHEN b.win_std > 0 THEN (t.declared_value - b.win_mean) / b.win_std ELSE 0.0 END END AS zscore
  FROM trades t JOIN base b ON t.p_brand = b.p_brand
), {verdict('sc', 'bv')}
SELECT event_id, p_brand, is_anomaly, anomaly_type, round(score, 6) AS score FROM bv"""

ORACLE["classify_severity"] = f"WITH {EV_ANOM} SELECT event_id, round(score, 6) AS score, severity FROM ev_anom"

ORACLE["severity_counts"] = f"WITH {EV_ANOM} SELECT severity, count(*) AS anomalies FROM ev_anom GROUP BY severity"

ALERT_ID = "substr(sha256(concat_ws(':', CAST(event_id AS VARCHAR), feature, CAST(epoch_us(ts) AS VARCHAR))), 1, 16)"

ORACLE["alert_ids"] = f"WITH {EV_ANOM} SELECT event_id, feature, {ALERT_ID} AS alert_id FROM ev_anom"

_GAP_DEDUP = 300_000_000
ORACLE["dedup_alerts"] = f"""
WITH {EV_ANOM}, {chain('ev_anom', 'dd', ['feature', 'anomaly_type'], _GAP_DEDUP)}
SELECT event_id, feature, anomaly_type, CASE WHEN _rank = 1 THEN 'emitted' ELSE 'duplicate' END AS status FROM dd"""

ORACLE["dedup_events_by_type"] = f"""
WITH src AS (SELECT event_id, ts, event_type AS feature, 'event' AS anomaly_type FROM events),
{chain('src', 'dd', ['feature', 'anomaly_type'], _GAP_DEDUP)}
SELECT event_id, feature, CASE WHEN _rank = 1 THEN 'emitted' ELSE 'duplicate' END AS status FROM dd"""

ORACLE["dedup_positions"] = ORACLE["dedup_events_by_type"]

ORACLE["rate_limit_alerts"] = f"""
WITH src AS (SELECT event_id, ts FROM events), {chain('src', 'rl', [], 60_000_000)}
SELECT event_id, _rank AS rate_rank, _rank > 100 AS rate_limited FROM rl"""

ORACLE["rate_limit_positions"] = ORACLE["rate_limit_alerts"]

ORACLE["rate_limit_hourly"] = f"""
WITH src AS (SELECT event_id, ts, event_type FROM events), {chain('src', 'rl', ['event_type'], 3_600_000_000)}
SELECT event_id, _rank AS rate_rank, _rank > 5 AS rate_limited FROM rl"""

_KEPT = f"""{EV_ANOM}, {chain('ev_anom', 'dd', ['feature', 'anomaly_type'], _GAP_DEDUP)},
em AS (SELECT * EXCLUDE (_t, _wstart, _rank) FROM dd WHERE _rank = 1),
{chain('em', 'rl', [], 60_000_000)},
kept AS (SELECT * FROM rl WHERE _rank <= 100)"""

ORACLE["build_alerts"] = f"""
WITH {_KEPT}
SELECT {ALERT_ID} AS alert_id, ts AS timestamp, CAST(event_id AS VARCHAR) AS event_id, feature,
  round(value, 6) AS value, round(score, 6) AS score, severity, anomaly_type, round(zscore, 6) AS details_zscore,
  win_count AS details_window_count, iqr_flag AS details_iqr_flag FROM kept"""

def machine(src: str, gap_d: int = 7_200_000_000, gap_r: int = 21_600_000_000, limit: int = 1) -> str:
    """The alert machine step by step over ``src(event_id, ts, anomaly_type)``,
    one dedup key per anomaly type; by default two hours of dedup, one alert
    per six."""
    dup = (f"CASE WHEN r.anomaly_type = 'zscore' THEN coalesce(r.t - s.last_z < {gap_d}, false) "
           f"ELSE coalesce(r.t - s.last_i < {gap_d}, false) END")
    new = f"coalesce(r.t - s.w >= {gap_r}, true)"
    emit = f"(NOT {dup} AND ({new} OR s.c < {limit}))"
    return f"""rows AS MATERIALIZED (
  SELECT event_id, feature, anomaly_type, epoch_us(ts) AS t, row_number() OVER (ORDER BY ts, event_id) AS rn FROM {src}
), steps AS (
  WITH RECURSIVE s AS (
    SELECT CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS last_z, CAST(NULL AS BIGINT) AS last_i, CAST(NULL AS BIGINT) AS w,
      CAST(0 AS BIGINT) AS c, CAST(NULL AS VARCHAR) AS status
    UNION ALL
    SELECT r.rn,
      CASE WHEN r.anomaly_type = 'zscore' AND {emit} THEN r.t ELSE s.last_z END,
      CASE WHEN r.anomaly_type <> 'zscore' AND {emit} THEN r.t ELSE s.last_i END,
      CASE WHEN NOT {dup} AND {new} THEN r.t ELSE s.w END,
      CASE WHEN {dup} THEN s.c WHEN {new} THEN CAST(1 AS BIGINT) WHEN s.c < {limit} THEN s.c + 1 ELSE s.c END,
      CASE WHEN {dup} THEN 'duplicate' WHEN {emit} THEN 'emitted' ELSE 'rate_limited' END
    FROM s JOIN rows r ON r.rn = s.rn + 1
  ) SELECT rn, status FROM s WHERE rn > 0
)"""


ORACLE["alert_policy_coupled"] = f"""
WITH {EV_ANOM}, {machine('ev_anom')}
SELECT event_id, feature, anomaly_type, status FROM rows JOIN steps USING (rn)"""

ORACLE["alert_policy_sliced"] = f"""
WITH src AS (SELECT event_id, ts, 'value' AS feature, CASE WHEN event_id % 2 = 0 THEN 'zscore' ELSE 'iqr' END AS anomaly_type FROM events),
{machine('src')}
SELECT anomaly_type, status, count(*) AS rows, CAST(sum(event_id) AS BIGINT) AS id_sum FROM rows JOIN steps USING (rn) GROUP BY 1, 2"""

ORACLE["alert_policy_parallel"] = f"""
WITH src AS (SELECT event_id, ts, 'value' AS feature, CASE WHEN event_id % 3 = 0 THEN 'zscore' ELSE 'iqr' END AS anomaly_type FROM events),
{machine('src', 1_800_000_000, 3_600_000_000, 2)}
SELECT event_id, anomaly_type, status FROM rows JOIN steps USING (rn)"""

ORACLE["metric_suppressed_binding"] = f"""
WITH {EV_ANOM}, {machine('ev_anom')}
SELECT count(*) FILTER (status = 'duplicate') AS deduplicated, count(*) FILTER (status = 'rate_limited') AS rate_limited,
  count(*) FILTER (status = 'emitted') AS published FROM steps"""

ORACLE["alert_messages"] = f"""
WITH {_KEPT}
SELECT {ALERT_ID} AS key, {ALERT_ID} AS alert_id, CAST(event_id AS VARCHAR) AS event_id, feature, severity,
  anomaly_type, round(score, 6) AS score, round(zscore, 6) AS details_zscore, CAST(3.0 AS DOUBLE) AS details_threshold,
  win_count AS details_window_count FROM kept"""

ORACLE["expired_dedup_keys"] = f"""
WITH {EV_ANOM}, {chain('ev_anom', 'dd', ['feature', 'anomaly_type'], _GAP_DEDUP)},
last AS (SELECT feature, anomaly_type, max(ts) AS last_emitted FROM dd WHERE _rank = 1 GROUP BY 1, 2),
now AS (SELECT max(ts) AS now FROM events)
SELECT feature, anomaly_type, last_emitted FROM last, now
WHERE epoch_us(now.now) - epoch_us(last_emitted) > {_GAP_DEDUP}"""

ORACLE["metric_events_by_source"] = """
SELECT 'events' AS topic, count(*) AS consumed, count(*) FILTER (WHERE event_type IS DISTINCT FROM 'error') AS processed FROM events"""

ORACLE["metric_anomalies"] = f"WITH {EV_ANOM} SELECT severity, anomaly_type AS detector, count(*) AS anomalies FROM ev_anom GROUP BY 1, 2"

ORACLE["metric_alerts"] = f"WITH {_KEPT} SELECT severity, count(*) AS alerts FROM kept GROUP BY severity"

ORACLE["metric_suppressed"] = f"""
WITH {EV_ANOM}, {chain('ev_anom', 'dd', ['feature', 'anomaly_type'], _GAP_DEDUP)}
SELECT CAST(sum(CASE WHEN _rank > 1 THEN 1 ELSE 0 END) AS BIGINT) AS deduplicated FROM dd"""

ORACLE["metric_errors"] = "SELECT 'malformed' AS error_type, count(*) AS errors FROM events WHERE event_type = 'error' GROUP BY 1"

_BAD = """CASE WHEN event_type = 'error' THEN 'malformed' WHEN event_id % 13 = 0 THEN 'bad_number'
  WHEN event_id % 17 = 0 THEN 'non_finite' END"""
ORACLE["dead_letter_reasons"] = f"SELECT event_id AS offset, {_BAD} AS reason FROM events WHERE {_BAD} IS NOT NULL"
ORACLE["metric_error_reasons"] = f"SELECT {_BAD} AS error_type, count(*) AS errors FROM events WHERE {_BAD} IS NOT NULL GROUP BY 1"

_POS = "CASE feature WHEN 'declared_value' THEN 0 WHEN 'quantity' THEN 1 WHEN 'weight_kg' THEN 2 ELSE 3 END"
_TR7 = f"{TRADES}, {TRADES_LINE7}, {trades_long('trades7')}, {stats('trades_long', 'tr_stats', TR_ORDER)}, {verdict('tr_stats', 'tr_v')}"
ORACLE["union_results_statistical"] = f"""
WITH {_TR7}
SELECT event_id, feature, round(value, 6) AS value, round(score, 6) AS score, anomaly_type, CAST({_POS} AS INTEGER) AS result_pos
FROM tr_v WHERE is_anomaly"""

_TR_ORD = f"l_orderkey, l_linenumber, l_partkey, {_POS}"
ORACLE["trade_alerts_statistical"] = f"""
WITH {TRADES}, {trades_long()}, {stats('trades_long', 'tr_stats', TR_ORDER)}, {verdict('tr_stats', 'tr_v')},
tr_anom AS (SELECT *, {SEVERITY} AS severity FROM tr_v WHERE is_anomaly),
{chain('tr_anom', 'dd', ['feature', 'anomaly_type'], _GAP_DEDUP, _TR_ORD)},
em AS (SELECT * EXCLUDE (_t, _wstart, _rank) FROM dd WHERE _rank = 1),
{chain('em', 'rl', [], 60_000_000, _TR_ORD)}
SELECT {ALERT_ID} AS alert_id, ts AS timestamp, event_id, feature, round(value, 6) AS value, round(score, 6) AS score,
  severity, anomaly_type, round(zscore, 6) AS details_zscore, win_count AS details_window_count FROM rl WHERE _rank <= 100"""

# 5 per cent of a full training slice of 1,000 rows lie below the threshold
ORACLE["forest_flag_rate"] = f"""
WITH {EPOCHS},
models AS (SELECT range AS model, {_N0} + (range - 1) * {_I} AS nm FROM tot, range(1, tot.mmax + 1))
SELECT m.model, count(*) AS train_rows, CAST(count(*) * 0.05 AS BIGINT) AS flagged
FROM models m JOIN seq s ON s.n > m.nm - {_B} AND s.n <= m.nm GROUP BY m.model"""

_HB = (1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0)
ORACLE["metric_histogram"] = (
    "WITH h AS (SELECT " + ", ".join(f"CAST(sum(CASE WHEN value <= {b} THEN 1 ELSE 0 END) AS BIGINT) AS b{i}" for i, b in enumerate(_HB))
    + ", count(value) AS binf, round(sum(value), 6) AS s, count(value) AS c FROM events) "
    + " UNION ALL ".join(f"SELECT '{b!r}' AS le, b{i} AS cumulative, s AS sum, c AS count FROM h" for i, b in enumerate(_HB))
    + " UNION ALL SELECT '+Inf' AS le, binf AS cumulative, s AS sum, c AS count FROM h")


def _r6_rewrite(sql: str) -> str:
    """``round(x, 6)`` -> half-up rounding of the decimal value via 10 places,
    matching the Spark side (see ``catalog.r6``)."""
    out, i, key = [], 0, "round("
    while True:
        j = sql.find(key, i)
        if j < 0:
            out.append(sql[i:])
            return "".join(out)
        if j > 0 and (sql[j - 1].isalnum() or sql[j - 1] == "_"):
            out.append(sql[i : j + len(key)])
            i = j + len(key)
            continue
        depth, m = 1, j + len(key)
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[m], 0)
            m += 1
        inner = sql[j + len(key) : m - 1]
        arg, _, places = inner.rpartition(",")
        if places.strip() != "6":
            out.append(sql[i:m])
        else:
            out.append(sql[i:j] + f"CAST(round(round(CAST(CAST(({_r6_rewrite(arg)}) AS VARCHAR) AS DECIMAL(38,18)), 10), 6) AS DOUBLE)")
        i = m


ORACLE = {k: _r6_rewrite(v) for k, v in ORACLE.items()}
