"""Metric tables: cumulative histogram buckets and dedup-state expiry."""

import datetime as dt

from tidewatch.operators.alerts import expired_dedup_keys
from tidewatch.operators.metrics import PROCESSING_BOUNDS, bucket_histogram


def test_histogram_cumulative_per_group(spark):
    rows = [("a", 0.0005), ("a", 0.02), ("a", 3.0), ("b", 0.001)]
    df = spark.createDataFrame(rows, "g string, latency double")
    h = {(r.g, r.le): (r.cumulative, r["count"]) for r in bucket_histogram(df, "latency", PROCESSING_BOUNDS, ["g"]).collect()}
    assert h[("a", "0.001")] == (1, 3)
    assert h[("a", "0.025")] == (2, 3)
    assert h[("a", "2.5")] == (2, 3)
    assert h[("a", "+Inf")] == (3, 3)
    assert h[("b", "0.001")] == (1, 1)  # bounds are inclusive (le)
    assert len([k for k in h if k[0] == "a"]) == len(PROCESSING_BOUNDS) + 1


def test_expired_keys_strictly_older_than_window(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("f", "zscore", t0), ("g", "iqr", t0 + dt.timedelta(seconds=100))]
    alerts = spark.createDataFrame(rows, "feature string, anomaly_type string, ts timestamp_ntz")
    now = spark.createDataFrame([(t0 + dt.timedelta(seconds=400),)], "now timestamp_ntz")
    got = {(r.feature, r.anomaly_type) for r in expired_dedup_keys(alerts, now).collect()}
    assert got == {("f", "zscore")}  # 400 s > 300 s; 300 s exactly is not expired
    now300 = spark.createDataFrame([(t0 + dt.timedelta(seconds=300),)], "now timestamp_ntz")
    assert expired_dedup_keys(alerts, now300).count() == 0
