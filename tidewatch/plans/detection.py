"""Batch detection: long feature rows -> window statistics -> verdicts -> alerts.

The same functions are reused per micro-batch by the streaming job
(:mod:`tidewatch.streaming.micro_batch`).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.functions.alerting import alert_id, is_ntz, severity
from tidewatch.functions.detect import detect, details
from tidewatch.operators.wide import wide_windows
from tidewatch.operators.windows import rolling_stats, stat_fields
from tidewatch.params import AlertParams, DetectorParams

#: place of a verdict among one event's: features in their order, then the forest
RESULT_POS = "result_pos"
#: the statistics that verdicts and their evidence read
VERDICT_STATS = ("win_count", "win_mean", "win_std", "win_p25", "win_p75", "win_iqr", "zscore")


def score_features(
    long_df: DataFrame,
    order_cols: Sequence[str],
    params: DetectorParams = DetectorParams(),
    scope_cols: Sequence[str] = (),
    strategy: str = "auto",
    passthrough: Sequence[str] | None = None,
    reset_col: str | None = None,
) -> DataFrame:
    """Window statistics + z/IQR verdict for every (event, feature) row."""
    stats = rolling_stats(
        long_df,
        order_cols=order_cols,
        key_cols=[*scope_cols, "feature"],
        value_col="value",
        window=params.window_size,
        strategy=strategy,
        passthrough=passthrough,
        reset_col=reset_col,
    )
    return detect(stats, params)


def with_severity(
    verdicts: DataFrame, alert: AlertParams = AlertParams(), params: DetectorParams = DetectorParams()
) -> DataFrame:
    """Anomalous rows only, graded by severity, with their evidence; ``params``
    are those the verdicts were made with."""
    found = verdicts.filter("is_anomaly")
    if {"zscore", "win_mean", "lower_fence"} <= set(found.columns):
        found = found.withColumn("details", details(params))
    return found.withColumn("severity", severity("score", alert.severity_thresholds))


def build_alerts(graded: DataFrame, ts_col: str = "ts", event_col: str = "event_id") -> DataFrame:
    """Alert records: id, time, event, feature, value, score, severity, type and,
    where the rows carry them, ``details`` (the evidence of the verdict)."""
    evidence = ["details"] if "details" in graded.columns else []
    return graded.select(
        alert_id(event_col, "feature", ts_col, is_ntz(graded, ts_col)).alias("alert_id"),
        F.col(ts_col).alias("timestamp"),
        F.col(event_col).cast("string").alias("event_id"),
        "feature",
        "value",
        "score",
        "severity",
        F.coalesce(F.col("anomaly_type"), F.lit("unknown")).alias("anomaly_type"),
        *evidence,
    )


def trade_anomalies(
    long_df: DataFrame | None,
    events: DataFrame,
    id_cols: Sequence[str],
    order_cols: Sequence[str],
    params: DetectorParams = DetectorParams(),
    forest=None,
    alert: AlertParams = AlertParams(),
) -> DataFrame:
    """Statistical anomalies of every (event, feature) plus the isolation
    forest's ``multi_feature`` anomalies, graded by severity: the full
    detector before the alert policy. Without ``long_df`` (the unpivoted rows
    of ``events``) the features are those columns of ``events``, which then
    meet their windows before they are unpivoted."""
    from tidewatch.operators.forest import fit_and_score, forest_anomalies, vector_sequence, with_epochs
    from tidewatch.operators.vectors import feature_vectors

    keys = list(dict.fromkeys([*id_cols, *order_cols]))
    own = [*keys, "feature", "value"]
    if long_df is None:  # a written table that both detectors read
        windows = wide_windows(events, order_cols, params.features, window=params.window_size, keep=keys)
        stats = windows.statistics(stat_fields(VERDICT_STATS), own)
    else:
        windows = stats = rolling_stats(long_df, order_cols=order_cols, key_cols=["feature"], window=params.window_size,
                                        passthrough=own, stats=VERDICT_STATS)
    position = F.lit(len(params.features))
    for i, f in enumerate(params.features):
        position = F.when(F.col("feature") == f, F.lit(i)).otherwise(position)
    verdicts = detect(stats, params).filter("is_anomaly")
    stat = verdicts.select(*keys, "feature", "value", "score", "anomaly_type", details(params).alias("details"))
    out = stat.withColumn(RESULT_POS, position)
    if forest is not None:
        vec = feature_vectors(events.select(*keys), windows, list(id_cols), list(order_cols), params.features, keep_place=True)
        ep = with_epochs(vector_sequence(vec, list(order_cols), placed=True), forest)
        fa = forest_anomalies(fit_and_score(ep, keys, forest), alert.score_scale_forest)
        fa = fa.select(*keys, "feature", "value", "score", "anomaly_type", "details")
        out = out.unionByName(fa.withColumn(RESULT_POS, F.lit(len(params.features))))
    return out.withColumn("severity", severity("score", alert.severity_thresholds))
