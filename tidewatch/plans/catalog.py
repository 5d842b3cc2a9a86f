"""Named queries over the benchmark tables, one per operator family.

Every query reads whole tables (or data Spark derives from them); doubles
are rounded to 6 places so results compare across engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.alerting import alert_id, severity
from tidewatch.functions.detect import detect
from tidewatch.operators.alerts import (alert_policy, coupled_alert_policy, dedup_alerts, expired_dedup_keys,
                                       rate_limit)
from tidewatch.operators.metrics import bucket_histogram
from tidewatch.operators.wide import WideWindows, wide_windows
from tidewatch.operators.windows import rolling_stats, score_against, stat_fields, window_snapshot
from tidewatch.operators.forest import (
    fit_and_score, fit_models, fit_on_demand, forest_anomalies, forest_status, score_vectors, score_with_model,
    training_slices, vector_sequence, with_epochs,
)
from tidewatch.params import AlertParams, DetectorParams, ForestParams
from tidewatch.plans.detection import RESULT_POS, VERDICT_STATS, build_alerts, with_severity
from tidewatch.sources.events import (
    cast_features, dead_letter_reason, parse_messages, split_dead_letters, unpivot_features,
)
from tidewatch.sources.tables import (
    EVENT_ORDER, TRADE_ORDER, events_as_messages, events_long, lineitem_trades, read_table, trade_event_id,
)



def eid() -> F.Column:
    """Trades carry numeric keys through heavy stages; the text id is built at the output."""
    return trade_event_id().alias("event_id")

P = DetectorParams()
A = AlertParams()
FP = ForestParams()
STATS = ["win_count", "win_mean", "win_std", "win_min", "win_max", "win_p25", "win_median", "win_p75", "win_iqr", "zscore"]
FEATURES = list(P.features)


def r6(c: str | F.Column, name: str | None = None) -> F.Column:
    """Round to 6 places via 10 (half-up on the decimal value both times), so an
    exact tie that two engines reach with different last-bit noise rounds the
    same way on both."""
    col = F.col(c) if isinstance(c, str) else c
    # decimal rounding is slow and only decides near a tie: elsewhere the nearest
    # whole number of millionths is the same double
    scaled = col.cast("double") * F.lit(1e6)
    clear = (F.abs(scaled) < F.lit(1e15)) & (F.abs(scaled - F.floor(scaled) - F.lit(0.5)) > F.lit(0.01))
    rounded = F.when(clear, F.rint(scaled) / F.lit(1e6) + F.lit(0.0)).otherwise(F.round(F.round(col, 10), 6))
    return rounded.alias(name or (c if isinstance(c, str) else None))


def _stats_cols() -> list[F.Column]:
    return [F.col("win_count")] + [r6(s) for s in STATS[1:]]


# ---------------------------------------------------------------- building blocks

def event_stats(spark: SparkSession, sf: str) -> DataFrame:
    """events: one global window over ``value``, W=1000, order (ts, event_id)."""
    return rolling_stats(events_long(spark, sf), order_cols=EVENT_ORDER, key_cols=["feature"], window=P.window_size)


def event_verdicts(spark: SparkSession, sf: str) -> DataFrame:
    return detect(event_stats(spark, sf), P)


def trade_long(spark: SparkSession, sf: str, drop_weight_on_line7: bool = False, extra=()) -> DataFrame:
    t = trades_with_gaps(spark, sf) if drop_weight_on_line7 else lineitem_trades(spark, sf)
    return unpivot_features(t, [*TRADE_ORDER, *extra], FEATURES)


def trades_with_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Trades whose weight is undeclared on 7th lines."""
    return lineitem_trades(spark, sf).withColumn("weight_kg", F.when(F.col("l_linenumber") != 7, F.col("weight_kg")))


def trade_stats(spark: SparkSession, sf: str, drop_weight_on_line7: bool = False, stats=None) -> DataFrame:
    t = trades_with_gaps(spark, sf) if drop_weight_on_line7 else lineitem_trades(spark, sf)
    return rolling_stats(t, order_cols=TRADE_ORDER, key_cols=["feature"], window=P.window_size,
                         passthrough=[*TRADE_ORDER, "feature", "value"], stats=stats, features=FEATURES)


def event_anomalies(spark: SparkSession, sf: str) -> DataFrame:
    return with_severity(event_verdicts(spark, sf), A)


# ---------------------------------------------------------------- A: sources

def q_scan_trade_events(spark, sf):
    msgs = events_as_messages(spark, sf)
    parsed = parse_messages(msgs, keep=["offset"])
    valid, _ = split_dead_letters(parsed, FEATURES)
    return valid.select("offset", F.coalesce("event_id", F.lit("unknown")).alias("event_id"),
                        "commodity_code", r6("declared_value"), r6("quantity"))


def q_dead_letter_events(spark, sf):
    parsed = parse_messages(events_as_messages(spark, sf), keep=["offset"])
    _, dead = split_dead_letters(parsed, FEATURES)
    return dead.select("offset", "reason")


# ---------------------------------------------------------------- B: projections

def q_derive_unit_price(spark, sf):
    t = lineitem_trades(spark, sf)
    return t.select("event_id", r6("unit_price"))


def q_cast_features(spark, sf):
    """Numeric coercion of a text-typed feature (``props.k`` read as text)."""
    ev = read_table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").alias("quantity"))
    return cast_features(ev, ["quantity"]).select("event_id", r6("quantity"))


def q_unpivot_features(spark, sf):
    return trade_long(spark, sf).select(eid(), "feature", r6("value"))


# ---------------------------------------------------------------- C: windows

def q_rolling_stats(spark, sf):
    return event_stats(spark, sf).select("event_id", *_stats_cols())


def q_rolling_stats_frame(spark, sf):
    """The plain SQL frame, made for many small keys and small windows."""
    s = rolling_stats(lineitem_trades(spark, sf), order_cols=TRADE_ORDER, key_cols=["l_suppkey", "feature"], window=20,
                      strategy="frame", passthrough=[*TRADE_ORDER, "l_suppkey", "feature", "value"], features=FEATURES)
    return s.select(eid(), "feature", *_stats_cols())


def events_with_gaps(spark, sf):
    """Events with values missing on every 7th and NaN on every 11th id."""
    v = F.when(F.col("event_id") % 7 == 0, F.lit(None)).when(F.col("event_id") % 11 == 0, F.lit(float("nan"))).otherwise(F.col("value"))
    return read_table(spark, sf, "events").select("event_id", "ts", F.lit("value").alias("feature"), v.cast("double").alias("value"))


def q_rolling_stats_nulls(spark, sf):
    """Missing and NaN values enter no window."""
    s = rolling_stats(events_with_gaps(spark, sf), order_cols=EVENT_ORDER, key_cols=["feature"], window=P.window_size)
    return s.select("event_id", *_stats_cols())


def q_rolling_stats_multi(spark, sf):
    return trade_stats(spark, sf).select(eid(), "feature", *_stats_cols())


def q_rolling_stats_scoped(spark, sf):
    s = rolling_stats(lineitem_trades(spark, sf), order_cols=TRADE_ORDER, key_cols=["l_suppkey", "feature"], window=100,
                      passthrough=[*TRADE_ORDER, "l_suppkey", "feature", "value"], features=FEATURES)
    return s.select(eid(), "feature", *_stats_cols())


def q_rolling_stats_reset(spark, sf):
    ev = read_table(spark, sf, "events").select(
        "event_id", "ts", F.lit("value").alias("feature"), "value", (F.col("event_type") == "signup").alias("reset"))
    s = rolling_stats(ev, order_cols=EVENT_ORDER, key_cols=["feature"], window=P.window_size, reset_col="reset")
    return s.select("event_id", *_stats_cols())


def q_rolling_stats_reset_gaps(spark, sf):
    """Resets on rows that may have no value: they clear the window all the same."""
    ev = events_with_gaps(spark, sf).join(read_table(spark, sf, "events").select("event_id", "event_type"), "event_id")
    ev = ev.withColumn("reset", (F.col("event_type") == "signup") & (F.col("event_id") % 5 < 2))
    s = rolling_stats(ev, order_cols=EVENT_ORDER, key_cols=["feature"], window=P.window_size, reset_col="reset")
    return s.select("event_id", *_stats_cols())


def q_zscore_vs_snapshot(spark, sf):
    snap = window_snapshot(events_long(spark, sf), order_cols=EVENT_ORDER, key_cols=["feature"], window=P.window_size)
    stats = snap.select(
        "feature", "win_count",
        F.aggregate("values", F.lit(0.0), lambda a, x: a + x).alias("_sum"), "values",
    )
    stats = stats.select(
        "feature", "win_count", (F.col("_sum") / F.col("win_count")).alias("win_mean"),
        F.sqrt(F.aggregate("values", F.lit(0.0), lambda a, x: a + (x - F.col("_sum") / F.col("win_count")) ** 2)
               / (F.col("win_count") - 1)).alias("win_std"),
        F.array_min("values").alias("win_min"), F.array_max("values").alias("win_max"),
        F.lit(None).cast("double").alias("win_p25"), F.lit(None).cast("double").alias("win_median"),
        F.lit(None).cast("double").alias("win_p75"), F.lit(None).cast("double").alias("win_iqr"),
    )
    vals = read_table(spark, sf, "events").select("event_id", F.lit("value").alias("feature"), "value")
    return score_against(stats, vals, ["feature"]).select("event_id", r6("zscore"))


def q_window_snapshot_2000(spark, sf):
    snap = window_snapshot(trade_long(spark, sf), order_cols=TRADE_ORDER, key_cols=["feature"], window=2000)
    return snap.select("feature", F.posexplode("values").alias("pos", "value")).select(
        "feature", (F.col("pos") + 1).alias("pos"), r6("value"))


def q_window_snapshot(spark, sf):
    snap = window_snapshot(trade_long(spark, sf), order_cols=TRADE_ORDER, key_cols=["feature"], window=P.window_size)
    return snap.select("feature", F.posexplode("values").alias("pos", "value")).select(
        "feature", (F.col("pos") + 1).alias("pos"), r6("value"))


def q_feature_vectors(spark, sf):
    v = trade_vectors(spark, sf)
    return v.select(eid(), *[r6(f"z_{f}") for f in FEATURES], F.col("vector").isNotNull().alias("vector_ready"))


def q_metric_window_size(spark, sf):
    long = trade_long(spark, sf)
    return long.groupBy("feature").agg(F.least(F.count(F.lit(1)), F.lit(P.window_size)).cast("long").alias("window_size"))


# ---------------------------------------------------------------- D: detection

def q_detect_combined(spark, sf):
    v = event_verdicts(spark, sf)
    return v.select("event_id", "z_flag", "iqr_flag", "is_anomaly", "anomaly_type", r6("score"),
                    r6("lower_fence"), r6("upper_fence"), "reason")


def q_detect_details(spark, sf):
    """The evidence record of every anomaly."""
    from tidewatch.functions.detect import details

    v = event_verdicts(spark, sf).filter("is_anomaly").select("event_id", details(P).alias("d"))
    return v.select("event_id", *_evidence("d"))


def _evidence(d: str) -> list[F.Column]:
    return [r6(f"{d}.zscore", "zscore"), F.col(f"{d}.zscore_threshold"), F.col(f"{d}.zscore_flag"), r6(f"{d}.iqr", "iqr"),
            r6(f"{d}.lower_fence", "lower_fence"), r6(f"{d}.upper_fence", "upper_fence"), F.col(f"{d}.iqr_flag"),
            r6(f"{d}.window_mean", "window_mean"), r6(f"{d}.window_std", "window_std"), F.col(f"{d}.window_count"),
            F.col(f"{d}.reason")]


#: stricter gate and fences, looser z test than the defaults
CUSTOM = DetectorParams(zscore_threshold=2.0, iqr_multiplier=3.0, min_samples=100)


def q_detect_details_custom(spark, sf):
    """Evidence, score and severity of alerts made with other parameters."""
    v = detect(event_stats(spark, sf), CUSTOM)
    a = with_severity(v, A, CUSTOM)
    return a.select("event_id", "anomaly_type", "severity", *_evidence("details"))


def q_detect_nan(spark, sf):
    """Values against one baseline of the whole table: NaN and missing values
    never flag."""
    base = read_table(spark, sf, "events").agg(
        F.count("value").alias("win_count"), F.avg("value").alias("win_mean"), F.stddev_samp("value").alias("win_std"),
        F.min("value").alias("win_min"), F.max("value").alias("win_max")).withColumn("feature", F.lit("value"))
    # fences at fixed quantiles of the known range keep this to one aggregate
    base = base.withColumn("win_p25", F.col("win_min") + 0.25 * (F.col("win_max") - F.col("win_min"))).withColumn(
        "win_p75", F.col("win_min") + 0.3 * (F.col("win_max") - F.col("win_min"))).withColumn(
        "win_median", F.col("win_mean")).withColumn("win_iqr", F.col("win_p75") - F.col("win_p25"))
    v = detect(score_against(base, events_with_gaps(spark, sf), ["feature"]), P)
    return v.select("event_id", "z_flag", "iqr_flag", "is_anomaly", "anomaly_type", r6("score"))


def q_detect_multi_feature(spark, sf):
    v = detect(trade_stats(spark, sf), P)
    return v.select(eid(), "feature", "is_anomaly", "anomaly_type", r6("score"))


def q_detect_vs_baseline(spark, sf):
    """Score trades against a per-brand baseline (exact quartiles computed
    without buffering a brand in one task, then joined on brand)."""
    from tidewatch.operators.quantiles import exact_quantiles

    from tidewatch.session import materialize

    t = materialize(lineitem_trades(spark, sf).select("event_id", "p_brand", "declared_value"), "trades")
    moments = t.groupBy("p_brand").agg(
        F.count("declared_value").alias("win_count"), F.avg("declared_value").alias("win_mean"),
        F.stddev_samp("declared_value").alias("win_std"),
        F.min("declared_value").alias("win_min"), F.max("declared_value").alias("win_max"))
    quarts = exact_quantiles(t, ["p_brand"], "declared_value", (0.25, 0.5, 0.75),
                             ["win_p25", "win_median", "win_p75"]).drop("_n")
    base = moments.join(quarts, "p_brand").withColumn("win_iqr", F.col("win_p75") - F.col("win_p25"))
    vals = t.select("event_id", "p_brand", F.col("declared_value").alias("value"))
    scored = score_against(base, vals, ["p_brand"])
    v = detect(scored, P)
    return v.select("event_id", "p_brand", "is_anomaly", "anomaly_type", r6("score"))


# ---------------------------------------------------------------- F: alerting

def q_classify_severity(spark, sf):
    return event_anomalies(spark, sf).select("event_id", r6("score"), "severity")


def q_severity_counts(spark, sf):
    return event_anomalies(spark, sf).groupBy("severity").agg(F.count(F.lit(1)).alias("anomalies"))


def q_alert_ids(spark, sf):
    a = event_anomalies(spark, sf)
    return a.select("event_id", "feature", alert_id("event_id", "feature", "ts").alias("alert_id"))


def q_dedup_alerts(spark, sf):
    d = dedup_alerts(event_anomalies(spark, sf), ts_col="ts", order_cols=["event_id"], params=A)
    return d.select("event_id", "feature", "anomaly_type", "status")


def q_dedup_events_by_type(spark, sf):
    ev = read_table(spark, sf, "events").select("event_id", "ts", F.col("event_type").alias("feature"),
                                                F.lit("event").alias("anomaly_type"))
    d = dedup_alerts(ev, ts_col="ts", order_cols=["event_id"], params=A)
    return d.select("event_id", "feature", "status")


def q_dedup_positions(spark, sf):
    """Dedup of all events through the plan for keys of any size: global
    positions, packed sessions, slices with carried openings for long sessions."""
    from tidewatch.operators.chain import chain_windows

    ev = read_table(spark, sf, "events").select("event_id", "ts", F.col("event_type").alias("feature"))
    d = chain_windows(ev, ["feature"], "ts", A.dedup_window_seconds, ["event_id"], fold_rows=512, force_positions=True)
    return d.select("event_id", "feature", F.when(F.col("opens"), F.lit("emitted")).otherwise(F.lit("duplicate")).alias("status"))


def q_rate_limit_positions(spark, sf):
    """The unscoped rate limit through the same plan: no task holds the stream."""
    from tidewatch.operators.chain import chain_windows

    ev = read_table(spark, sf, "events").select("event_id", "ts")
    r = chain_windows(ev, [], "ts", A.rate_window_seconds, ["event_id"], fold_rows=512, force_positions=True)
    return r.select("event_id", F.col("rank").alias("rate_rank"), (F.col("rank") > A.max_alerts_per_minute).alias("rate_limited"))


def q_rate_limit_alerts(spark, sf):
    ev = read_table(spark, sf, "events").select("event_id", "ts")
    r = rate_limit(ev, ts_col="ts", order_cols=["event_id"], params=A)
    return r.select("event_id", "rate_rank", "rate_limited")


def q_rate_limit_hourly(spark, sf):
    hourly = AlertParams(max_alerts_per_minute=5, rate_window_seconds=3600.0)
    ev = read_table(spark, sf, "events").select("event_id", "ts", "event_type")
    r = rate_limit(ev, ts_col="ts", order_cols=["event_id"], scope_cols=["event_type"], params=hourly)
    return r.select("event_id", "rate_rank", "rate_limited")


def q_build_alerts(spark, sf):
    kept = alert_policy(event_anomalies(spark, sf), ts_col="ts", order_cols=["event_id"], params=A)
    return kept.select(
        alert_id("event_id", "feature", "ts").alias("alert_id"), F.col("ts").alias("timestamp"),
        F.col("event_id").cast("string").alias("event_id"), "feature", r6("value"), r6("score"), "severity",
        "anomaly_type", r6("details.zscore", "details_zscore"), F.col("details.window_count").alias("details_window_count"),
        F.col("details.iqr_flag").alias("details_iqr_flag"))


#: a budget that binds: one alert per six hours, dedup over two hours
BINDING = AlertParams(max_alerts_per_minute=1, rate_window_seconds=21600.0, dedup_window_seconds=7200.0)


def q_alert_policy_coupled(spark, sf):
    """Dedup and rate limit as one state machine (rate-limited alerts stay out
    of the dedup state) under a budget that binds; status per anomaly."""
    p = coupled_alert_policy(event_anomalies(spark, sf), ts_col="ts", order_cols=["event_id"], params=BINDING)
    return p.select("event_id", "feature", "anomaly_type", "status")


def q_alert_policy_sliced(spark, sf):
    """The same machine over all events by type, in small slices with carried
    state, as it runs on segments of any length."""
    ev = read_table(spark, sf, "events").select("event_id", "ts", F.lit("value").alias("feature"),
                                                F.when(F.col("event_id") % 2 == 0, F.lit("zscore")).otherwise(F.lit("iqr")).alias("anomaly_type"))
    p = coupled_alert_policy(ev, ts_col="ts", order_cols=["event_id"], params=BINDING, fold_rows=4096)
    return p.groupBy("anomaly_type", "status").agg(F.count(F.lit(1)).alias("rows"), F.sum("event_id").alias("id_sum"))


#: a budget that binds all the time in a stream that never pauses
TIGHT = AlertParams(max_alerts_per_minute=2, rate_window_seconds=3600.0, dedup_window_seconds=1800.0)


def q_alert_policy_parallel(spark, sf):
    """The machine over all events, an unbroken stream, in many slices that are
    folded side by side and joined by their entry and exit states."""
    ev = read_table(spark, sf, "events").select("event_id", "ts", F.lit("value").alias("feature"),
                                                F.when(F.col("event_id") % 3 == 0, F.lit("zscore")).otherwise(F.lit("iqr")).alias("anomaly_type"))
    p = coupled_alert_policy(ev, ts_col="ts", order_cols=["event_id"], params=TIGHT, fold_rows=1024)
    return p.select("event_id", "anomaly_type", "status")


def q_alert_messages(spark, sf):
    """Alert sink payloads: key = alert id, value = the alert as JSON, read back."""
    from tidewatch.sources.sinks import alert_messages

    kept = alert_policy(event_anomalies(spark, sf), ts_col="ts", order_cols=["event_id"], params=A)
    msgs = alert_messages(build_alerts(kept))
    j = F.col("value")
    return msgs.select(
        "key",
        F.get_json_object(j, "$.alert_id").alias("alert_id"),
        F.get_json_object(j, "$.event_id").alias("event_id"),
        F.get_json_object(j, "$.feature").alias("feature"),
        F.get_json_object(j, "$.severity").alias("severity"),
        F.get_json_object(j, "$.anomaly_type").alias("anomaly_type"),
        r6(F.get_json_object(j, "$.score").cast("double"), "score"),
        r6(F.get_json_object(j, "$.details.zscore").cast("double"), "details_zscore"),
        F.get_json_object(j, "$.details.zscore_threshold").cast("double").alias("details_threshold"),
        F.get_json_object(j, "$.details.window_count").cast("long").alias("details_window_count"),
    )


def q_expired_dedup_keys(spark, sf):
    d = dedup_alerts(event_anomalies(spark, sf), ts_col="ts", order_cols=["event_id"], params=A)
    emitted = d.filter(F.col("status") == "emitted")
    now = read_table(spark, sf, "events").agg(F.max("ts").alias("now"))
    return expired_dedup_keys(emitted, now, params=A).select("feature", "anomaly_type", "last_emitted")


# ---------------------------------------------------------------- G: metrics

def q_metric_events_by_source(spark, sf):
    msgs = events_as_messages(spark, sf).withColumn("topic", F.lit("events"))
    parsed = parse_messages(msgs, keep=["topic", "offset"])
    return parsed.groupBy("topic").agg(
        F.count(F.lit(1)).alias("consumed"), F.count_if(dead_letter_reason(parsed, FEATURES).isNull()).alias("processed"))


def q_metric_anomalies(spark, sf):
    a = event_anomalies(spark, sf)
    return a.groupBy("severity", F.col("anomaly_type").alias("detector")).agg(F.count(F.lit(1)).alias("anomalies"))


def q_metric_alerts(spark, sf):
    kept = alert_policy(event_anomalies(spark, sf), ts_col="ts", order_cols=["event_id"], params=A)
    return kept.groupBy("severity").agg(F.count(F.lit(1)).alias("alerts"))


def q_metric_suppressed(spark, sf):
    """Alerts the machine held back as duplicates."""
    d = coupled_alert_policy(event_anomalies(spark, sf), ts_col="ts", order_cols=["event_id"], params=A)
    return d.agg(F.count_if(F.col("status") == "duplicate").alias("deduplicated"))


def q_metric_suppressed_binding(spark, sf):
    """The same under a budget that binds, where limited alerts open no dedup window."""
    d = coupled_alert_policy(event_anomalies(spark, sf), ts_col="ts", order_cols=["event_id"], params=BINDING)
    return d.agg(*[F.count_if(F.col("status") == x).alias(n) for x, n in
                   (("duplicate", "deduplicated"), ("rate_limited", "rate_limited"), ("emitted", "published"))])


def trade_results(spark: SparkSession, sf: str) -> DataFrame:
    """Graded anomalies of the trades, the forest's included."""
    from tidewatch.plans.detection import trade_anomalies

    return trade_anomalies(None, lineitem_trades(spark, sf), [], list(TRADE_ORDER), P, FP, A)


def q_metric_anomalies_forest(spark, sf):
    """Anomalies by severity, type and the detector that found them, before
    dedup: the forest's count under type ``zscore``, as its alerts are typed."""
    source = F.coalesce("details.detector", F.lit("statistical"))
    return trade_results(spark, sf).groupBy("severity", F.col("anomaly_type").alias("detector"), source.alias("source")).agg(
        F.count(F.lit(1)).alias("anomalies"))


def q_metric_errors(spark, sf):
    parsed = parse_messages(events_as_messages(spark, sf), keep=["offset"])
    _, dead = split_dead_letters(parsed, FEATURES)
    return dead.groupBy(F.col("reason").alias("error_type")).agg(F.count(F.lit(1)).alias("errors"))


def bad_number_events(spark, sf):
    """Events with text for every 13th quantity and NaN for every 17th."""
    k = F.get_json_object("props", "$.k")
    text = F.when(F.col("event_id") % 13 == 0, F.lit("n/a")).when(F.col("event_id") % 17 == 0, F.lit("NaN")).otherwise(k)
    raw = F.when(F.col("event_type") == "error", F.lit("{"))
    ev = read_table(spark, sf, "events").select(F.col("event_id").alias("offset"), raw.alias("_corrupt_record"), text.alias("quantity"))
    return cast_features(ev, ["quantity"])


def q_dead_letter_reasons(spark, sf):
    """All reasons: undecodable messages, text for numbers, NaN."""
    _, dead = split_dead_letters(bad_number_events(spark, sf), ["quantity"])
    return dead.select("offset", "reason")


def q_metric_error_reasons(spark, sf):
    _, dead = split_dead_letters(bad_number_events(spark, sf), ["quantity"])
    return dead.groupBy(F.col("reason").alias("error_type")).agg(F.count(F.lit(1)).alias("errors"))


def q_metric_histogram(spark, sf):
    ev = read_table(spark, sf, "events")
    return bucket_histogram(ev, "value", (1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0))


# ---------------------------------------------------------------- E: isolation forest

def trade_vectors(spark: SparkSession, sf: str, wide: WideWindows | None = None) -> DataFrame:
    """Feature vectors of lineitem trades (weight undeclared on 7th lines);
    ``wide`` are the trades' windows, where others read them too."""
    from tidewatch.operators.vectors import feature_vectors

    events = trades_with_gaps(spark, sf)
    own = wide_windows(events, TRADE_ORDER, FEATURES, window=P.window_size) if wide is None else wide
    vectors = feature_vectors(events, own, [], TRADE_ORDER, FEATURES, keep_place=True)
    if wide is None:
        own.drop()
    return vectors


def trade_epochs(spark: SparkSession, sf: str) -> DataFrame:
    return with_epochs(vector_sequence(trade_vectors(spark, sf), TRADE_ORDER, placed=True), FP)


def trade_forest_scores(spark: SparkSession, sf: str, wide: WideWindows | None = None) -> DataFrame:
    ep = with_epochs(vector_sequence(trade_vectors(spark, sf, wide), TRADE_ORDER, placed=True), FP)
    return fit_and_score(ep, list(TRADE_ORDER), FP)


def q_forest_batch_fit(spark, sf):
    """Train on demand: one model on the last buffer_size vectors, then score
    every vector with it (the reference's force_train + predict)."""
    seq = vector_sequence(trade_vectors(spark, sf), TRADE_ORDER)  # a written table, less a small join
    scored = score_with_model(seq, fit_on_demand(seq, FP), [*TRADE_ORDER, "n"])
    return scored.select(eid(), "n", r6("raw_score"), "is_anomaly")


def q_forest_flag_rate(spark, sf):
    """Rows of each training slice that its own model flags: the contamination
    share, as the threshold is that quantile of the training scores."""
    ep = trade_epochs(spark, sf)
    slices = training_slices(ep.drop("model"), FP)
    from tidewatch.session import materialize

    slices = materialize(slices.select("model", "n", "vector"), "slices")
    scored = score_vectors(slices, fit_models(slices, FP), [])
    return scored.groupBy("model").agg(F.count(F.lit(1)).alias("train_rows"), F.count_if("is_anomaly").alias("flagged"))


def q_forest_epochs(spark, sf):
    return trade_epochs(spark, sf).select(eid(), "n", "model")


def q_forest_training_slices(spark, sf):
    sl = training_slices(trade_epochs(spark, sf).drop("model"), FP)
    return sl.groupBy("model").agg(F.min("n").alias("first_n"), F.max("n").alias("last_n"),
                                   F.count(F.lit(1)).alias("train_rows"))


def q_forest_status(spark, sf):
    return forest_status(trade_epochs(spark, sf), FP)


def q_metric_forest(spark, sf):
    return forest_status(trade_epochs(spark, sf), FP).select(
        F.col("retrains").alias("retrains_total"), F.col("training_samples").alias("training_samples"))


def q_forest_trees(spark, sf):
    ep = trade_epochs(spark, sf)
    from tidewatch.operators.forest import model_nodes

    return model_nodes(fit_models(training_slices(ep, FP), FP)).select(
        "model", "tree", "node", "feature", r6("threshold"), r6("leaf_value"), r6("offset"))


def q_forest_scores(spark, sf):
    return trade_forest_scores(spark, sf).select(eid(), "n", "model", r6("raw_score"), r6("score"),
                                                 "is_anomaly", "reason")


#: one forest per scope: small slices, early retraining
FP_SCOPED = ForestParams(n_estimators=20, buffer_size=400, retrain_interval=500)


def scoped_epochs(spark: SparkSession, sf: str) -> DataFrame:
    """Vectors numbered and carried forward per line number (7 scopes, uneven)."""
    from tidewatch.operators.vectors import feature_vectors

    t = lineitem_trades(spark, sf)
    t = t.withColumn("weight_kg", F.when(F.col("l_partkey") % 7 != 0, F.col("weight_kg")))
    scope = ["l_linenumber"]
    wide = wide_windows(t, TRADE_ORDER, FEATURES, scope, window=200)
    vec = feature_vectors(t, wide, [], TRADE_ORDER, FEATURES, scope, keep_place=True)
    wide.drop()
    return with_epochs(vector_sequence(vec, TRADE_ORDER, scope_cols=scope, placed=True), FP_SCOPED)


def q_forest_epochs_scoped(spark, sf):
    """Vector numbers and models per scope, and the vector they belong to."""
    ep = scoped_epochs(spark, sf)
    return ep.select(eid(), "l_linenumber", "n", "model", *[r6(f"z_{f}") for f in FEATURES])


def q_forest_scores_scoped(spark, sf):
    """A forest per scope, retrained at each scope's own vector numbers."""
    scored = fit_and_score(scoped_epochs(spark, sf), list(TRADE_ORDER), FP_SCOPED, scope_cols=["l_linenumber"])
    return scored.select(eid(), "l_linenumber", "n", "model", r6("raw_score"), r6("score"), "is_anomaly", "reason")


def q_forest_anomalies(spark, sf):
    fa = forest_anomalies(trade_forest_scores(spark, sf), A.score_scale_forest)
    return fa.select(eid(), "feature", r6("value"), r6("score"), "anomaly_type", "detector")


def q_trade_alerts(spark, sf):
    """The whole detector on lineitem trades: statistical + forest anomalies,
    severity, dedup and rate limit (the batch form of the live pipeline)."""
    anoms = trade_results(spark, sf)
    kept = alert_policy(anoms, ts_col="ts", order_cols=["l_orderkey", "l_linenumber", "l_partkey", RESULT_POS], params=A)
    return kept.select(*_trade_alert(), F.col("details.detector").alias("details_detector"),
                       r6("details.raw_score", "details_raw_score"),
                       F.col("details.total_samples_seen").alias("details_total_samples_seen"))


def _trade_alert() -> list[F.Column]:
    return [alert_id(trade_event_id(), "feature", "ts").alias("alert_id"), F.col("ts").alias("timestamp"),
            eid(), F.col("feature"), r6("value"), r6("score"), F.col("severity"), F.col("anomaly_type"),
            r6("details.zscore", "details_zscore"), F.col("details.window_count").alias("details_window_count")]


def q_trade_alerts_statistical(spark, sf):
    """The statistical half of :func:`q_trade_alerts`."""
    from tidewatch.plans.detection import trade_anomalies

    anoms = trade_anomalies(None, lineitem_trades(spark, sf), [], list(TRADE_ORDER), P, None, A)
    kept = alert_policy(anoms, ts_col="ts", order_cols=["l_orderkey", "l_linenumber", "l_partkey", RESULT_POS], params=A)
    return kept.select(*_trade_alert())


def q_union_results_statistical(spark, sf):
    """The statistical half of :func:`q_union_results`."""
    return _statistical_results(trade_stats(spark, sf, drop_weight_on_line7=True))


def _statistical_results(stats: DataFrame) -> DataFrame:
    return detect(stats, P).filter("is_anomaly").select(
        eid(), "feature", r6("value"), r6("score"), "anomaly_type",
        (F.array_position(F.array(*[F.lit(f) for f in FEATURES]), F.col("feature")) - 1).cast("int").alias("result_pos"))


def q_union_results(spark, sf):
    """Statistical anomalies of the trades, then the forest's, per event."""
    # a written table that both detectors read
    wide = wide_windows(trades_with_gaps(spark, sf), TRADE_ORDER, FEATURES, window=P.window_size)
    stat = _statistical_results(wide.statistics(stat_fields(VERDICT_STATS), [*TRADE_ORDER, "feature", "value"]))
    fa = forest_anomalies(trade_forest_scores(spark, sf, wide), A.score_scale_forest).select(
        eid(), "feature", r6("value"), r6("score"), "anomaly_type", F.lit(len(FEATURES)).alias("result_pos"))
    return stat.unionByName(fa)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "scan_trade_events": q_scan_trade_events,
    "dead_letter_events": q_dead_letter_events,
    "derive_unit_price": q_derive_unit_price,
    "cast_features": q_cast_features,
    "unpivot_features": q_unpivot_features,
    "rolling_stats": q_rolling_stats,
    "rolling_stats_frame": q_rolling_stats_frame,
    "rolling_stats_nulls": q_rolling_stats_nulls,
    "rolling_stats_multi": q_rolling_stats_multi,
    "rolling_stats_scoped": q_rolling_stats_scoped,
    "rolling_stats_reset": q_rolling_stats_reset,
    "rolling_stats_reset_gaps": q_rolling_stats_reset_gaps,
    "zscore_vs_snapshot": q_zscore_vs_snapshot,
    "window_snapshot": q_window_snapshot,
    "window_snapshot_2000": q_window_snapshot_2000,
    "feature_vectors": q_feature_vectors,
    "detect_combined": q_detect_combined,
    "detect_details": q_detect_details,
    "detect_details_custom": q_detect_details_custom,
    "detect_nan": q_detect_nan,
    "detect_multi_feature": q_detect_multi_feature,
    "detect_vs_baseline": q_detect_vs_baseline,
    "classify_severity": q_classify_severity,
    "severity_counts": q_severity_counts,
    "alert_ids": q_alert_ids,
    "dedup_alerts": q_dedup_alerts,
    "dedup_events_by_type": q_dedup_events_by_type,
    "rate_limit_alerts": q_rate_limit_alerts,
    "rate_limit_hourly": q_rate_limit_hourly,
    "dedup_positions": q_dedup_positions,
    "rate_limit_positions": q_rate_limit_positions,
    "build_alerts": q_build_alerts,
    "expired_dedup_keys": q_expired_dedup_keys,
    "alert_messages": q_alert_messages,
    "alert_policy_coupled": q_alert_policy_coupled,
    "alert_policy_sliced": q_alert_policy_sliced,
    "alert_policy_parallel": q_alert_policy_parallel,
    "metric_events_by_source": q_metric_events_by_source,
    "metric_anomalies": q_metric_anomalies,
    "metric_alerts": q_metric_alerts,
    "metric_suppressed": q_metric_suppressed,
    "metric_suppressed_binding": q_metric_suppressed_binding,
    "metric_anomalies_forest": q_metric_anomalies_forest,
    "metric_errors": q_metric_errors,
    "dead_letter_reasons": q_dead_letter_reasons,
    "metric_error_reasons": q_metric_error_reasons,
    "metric_histogram": q_metric_histogram,
    "metric_window_size": q_metric_window_size,
    "forest_epochs": q_forest_epochs,
    "forest_batch_fit": q_forest_batch_fit,
    "forest_training_slices": q_forest_training_slices,
    "forest_status": q_forest_status,
    "forest_flag_rate": q_forest_flag_rate,
    "metric_forest": q_metric_forest,
    "forest_trees": q_forest_trees,
    "forest_scores": q_forest_scores,
    "forest_epochs_scoped": q_forest_epochs_scoped,
    "forest_scores_scoped": q_forest_scores_scoped,
    "forest_anomalies": q_forest_anomalies,
    "union_results": q_union_results,
    "union_results_statistical": q_union_results_statistical,
    "trade_alerts_statistical": q_trade_alerts_statistical,
    "trade_alerts": q_trade_alerts,
}
