"""Count-window cases (the reference's window suite restated on DataFrames)
plus halo == frame equality around block edges."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators.windows import rolling_stats, window_snapshot


def _df(spark, values, feature="x", reset=None):
    rows = [(i, feature, float(v), (reset is not None and i in reset)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "seq long, feature string, value double, reset boolean")


def _last(spark, values, window, strategy="halo", **kw):
    out = rolling_stats(_df(spark, values), order_cols=["seq"], window=window, strategy=strategy, **kw)
    return out.orderBy(F.col("seq").desc()).first()


@pytest.mark.parametrize("strategy", ["halo", "frame"])
def test_capacity_and_eviction(spark, strategy):
    r = _last(spark, range(7), 5, strategy)
    assert r.win_count == 5
    r = _last(spark, [1, 2, 3, 4, 5], 3, strategy)
    assert (r.win_min, r.win_max, r.win_mean) == (3.0, 5.0, 4.0)


@pytest.mark.parametrize("strategy", ["halo", "frame"])
def test_readiness(spark, strategy):
    out = rolling_stats(_df(spark, [0, 1, 2]), order_cols=["seq"], window=10, strategy=strategy).orderBy("seq").collect()
    assert [r.win_mean is not None for r in out] == [False, True, True]
    assert out[0].win_count == 1 and out[0].zscore is None


@pytest.mark.parametrize("strategy", ["halo", "frame"])
def test_basic_stats(spark, strategy):
    r = _last(spark, [10, 20, 30, 40, 50], 100, strategy)
    assert (r.win_mean, r.win_min, r.win_max, r.win_median, r.win_count) == (30.0, 10.0, 50.0, 30.0, 5)


@pytest.mark.parametrize("strategy", ["halo", "frame"])
def test_sample_std(spark, strategy):
    vals = [2, 4, 4, 4, 5, 5, 7, 9]
    r = _last(spark, vals, 100, strategy)
    assert r.win_std == pytest.approx(np.std(vals, ddof=1))


@pytest.mark.parametrize("strategy", ["halo", "frame"])
def test_percentiles_linear(spark, strategy):
    r = _last(spark, range(1, 101), 1000, strategy)
    assert r.win_p25 == pytest.approx(25.75)
    assert r.win_p75 == pytest.approx(75.25)
    assert r.win_iqr == pytest.approx(49.5)


@pytest.mark.parametrize("strategy", ["halo", "frame"])
def test_zscore_default_and_zero_std(spark, strategy):
    r = _last(spark, [10, 10, 10, 10, 50], 100, strategy)
    assert r.zscore > 0
    r = _last(spark, [42] * 10, 100, strategy)
    assert r.win_std == 0.0 and r.zscore == 0.0
    r = _last(spark, [0.1] * 30, 100, strategy)  # NumPy leaves ~1e-17 here; must be exactly 0
    assert r.win_std == 0.0 and r.zscore == 0.0


@pytest.mark.parametrize("strategy", ["halo", "frame"])
def test_reset_clears_window(spark, strategy):
    out = rolling_stats(_df(spark, [1, 2, 3, 100, 101], reset={3}), order_cols=["seq"], window=10,
                        strategy=strategy, reset_col="reset").orderBy("seq").collect()
    assert out[3].win_count == 1 and out[3].win_mean is None
    assert out[4].win_count == 2 and out[4].win_mean == 100.5


def test_per_feature_windows_are_separate(spark):
    rows = [(i, "a" if i % 2 else "b", float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "seq long, feature string, value double")
    out = {r.feature: r for r in rolling_stats(df, order_cols=["seq"], window=3).filter("seq >= 18").collect()}
    assert out["b"].win_mean == 16.0  # 14, 16, 18
    assert out["a"].win_mean == 17.0  # 15, 17, 19


@pytest.mark.parametrize("window,block", [(5, 4), (5, 5), (5, 6), (7, 64), (1, 8), (2, 8)])
def test_halo_equals_frame_across_block_edges(spark, window, block):
    rng = np.random.default_rng(window * 100 + block)
    rows = []
    for k, n in [("a", 53), ("b", 7), ("c", 1), ("d", 40)]:
        for i in range(n):
            rows.append((k, i, round(float(rng.normal(10, 3)), 2), bool(rng.random() < 0.05)))
    df = spark.createDataFrame(rows, "feature string, seq long, value double, reset boolean")
    cols = ["feature", "seq", "win_count", "win_mean", "win_std", "win_min", "win_max",
            "win_p25", "win_median", "win_p75", "win_iqr", "zscore"]
    for reset in (None, "reset"):
        h = rolling_stats(df, order_cols=["seq"], window=window, strategy="halo", block_size=block, reset_col=reset,
                          num_partitions=3).select(*cols).toPandas().sort_values(["feature", "seq"]).reset_index(drop=True)
        f = rolling_stats(df, order_cols=["seq"], window=window, strategy="frame", reset_col=reset
                          ).select(*cols).toPandas().sort_values(["feature", "seq"]).reset_index(drop=True)
        assert len(h) == len(f) == len(rows)
        np.testing.assert_allclose(h.drop(columns=["feature"]).to_numpy(dtype=float),
                                   f.drop(columns=["feature"]).to_numpy(dtype=float), rtol=1e-9, atol=1e-9)


def test_snapshot_oldest_first(spark):
    snap = window_snapshot(_df(spark, [1, 2, 3, 4, 5]), order_cols=["seq"], window=3).first()
    assert snap["values"] == [3.0, 4.0, 5.0] and snap.win_count == 3


def test_exact_quantiles_match_numpy(spark):
    from tidewatch.operators.quantiles import exact_quantiles

    rng = np.random.default_rng(9)
    rows = [(k, float(round(rng.normal(0, 5), 1))) for k in ("a", "b", "c") for _ in range({"a": 301, "b": 2, "c": 1}[k])]
    rows.append(("a", None))
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r._n, r.q0, r.q1, r.q2) for r in exact_quantiles(df, ["k"], "v").collect()}
    for k in ("a", "b", "c"):
        vals = [v for kk, v in rows if kk == k and v is not None]
        want = np.percentile(vals, [25, 50, 75])
        assert got[k][0] == len(vals)
        np.testing.assert_allclose(got[k][1:], want, rtol=1e-12)


def test_missing_values_enter_no_window(spark):
    from tidewatch.operators.windows import rolling_stats

    rows = [(i, "f", v) for i, v in enumerate([1.0, None, 3.0, float("nan"), 5.0, None, 7.0])]
    df = spark.createDataFrame(rows, "ts long, feature string, value double")
    got = {}
    for strategy in ("halo", "frame"):
        out = rolling_stats(df, ["ts"], window=3, strategy=strategy).orderBy("ts").collect()
        got[strategy] = [(r.ts, r.win_count, r.win_mean) for r in out]
    assert got["halo"] == got["frame"] == [(0, 1, None), (2, 2, 2.0), (4, 3, 3.0), (6, 3, 5.0)]


def test_snapshot_of_a_large_window(spark):
    from tidewatch.operators.windows import window_snapshot

    df = spark.range(5000).selectExpr("id AS ts", "if(id % 5 = 0, 'a', 'b') AS feature", "cast(id AS double) AS value")
    got = {r.feature: list(r["values"]) for r in window_snapshot(df, ["ts"], window=1500).collect()}
    assert got == {"a": [float(x) for x in range(0, 5000, 5)], "b": [float(x) for x in range(5000) if x % 5][-1500:]}


@pytest.mark.parametrize("strategy", ["halo", "frame"])
def test_reset_on_rows_without_a_value(spark, strategy):
    """A reset on an absent row clears the window for the rows after it."""
    import math
    import statistics

    from pyspark.sql import functions as F

    rows, want, window = [], {}, []
    for i in range(200):
        value = None if i % 4 == 1 else float("nan") if i % 10 == 3 else float((i * 37) % 11)
        reset = i % 13 == 5 or i % 21 in (1, 2)
        rows.append((i, "a" if i < 150 else "b", value, None if i % 8 == 0 and not reset else reset))
        if i == 150 or reset:
            window = []
        if value is not None and not math.isnan(value):
            window = [*window, value][-7:]
            want[i] = (len(window), round(statistics.mean(window), 9) if len(window) > 1 else None, min(window) if len(window) > 1 else None)
    df = spark.createDataFrame(rows, "i long, feature string, value double, reset boolean")
    kw = {"block_size": 8} if strategy == "halo" else {}
    out = rolling_stats(df, ["i"], window=7, reset_col="reset", strategy=strategy, **kw).select(
        "i", "win_count", F.round("win_mean", 9).alias("m"), "win_min")
    assert {r.i: (r.win_count, r.m, r.win_min) for r in out.collect()} == want


def test_only_the_statistics_asked_for_are_written(spark):
    from pyspark.sql import functions as F
    from tidewatch.operators.windows import rolling_stats

    df = spark.range(500).select(F.col("id"), F.lit("f").alias("feature"), (F.col("id") * 37 % 101).cast("double").alias("value"))
    want = {r.id: r.zscore for r in rolling_stats(df, ["id"], window=20, num_partitions=3).collect()}
    few = rolling_stats(df, ["id"], window=20, num_partitions=3, passthrough=["id"], stats=["zscore"])
    assert few.columns == ["id", "zscore"] and {r.id: r.zscore for r in few.collect()} == want
    written = spark.read.parquet(few.inputFiles()[0].rsplit("/", 1)[0])
    assert "zscore" in written.columns and "win_p25" not in written.columns


def test_rounding_equals_decimal_rounding(spark):
    import numpy as np
    from pyspark.sql import functions as F
    from tidewatch.plans.catalog import r6

    rng = np.random.default_rng(3)
    x = [*(rng.normal(size=300) * 10.0 ** rng.integers(-9, 12, 300)).tolist(), 0.0, -0.0, -1e-9, 0.5e-6, 1.5e-6, -2.5e-6,
         0.1234565, 1e300, float("inf"), float("-inf"), float("nan"), None]
    df = spark.createDataFrame([(float(v) if v is not None else None,) for v in x], "x double")
    for r in df.select(r6("x", "fast"), F.round(F.round("x", 10), 6).alias("slow")).collect():
        assert repr(r.fast) == repr(r.slow), r


@pytest.mark.parametrize("window", [2, 7, 100])
def test_moments_from_running_sums(window):
    """Mean, deviation and z-score alone, without sorting a window: exact also
    where levels jump, values are large or constant, or segments are short."""
    import numpy as np
    from tidewatch.functions.window_kernel import window_stats

    rng = np.random.default_rng(2)
    v = np.concatenate([rng.random(300) * 1e-3, 1e6 + rng.random(300) * 1e-3, np.full(150, 7.5),
                        np.where(rng.random(300) < 0.02, 1e9, rng.random(300))])
    cut = np.isin(np.arange(len(v)), [0, 5, 6, 8, 400, 430])
    start = np.maximum.accumulate(np.where(cut, np.arange(len(v)), 0))
    got = window_stats(v, start, window, np.arange(len(v)), names=["zscore", "win_mean", "win_std"])
    assert np.isnan(got["win_median"]).all()
    for i in range(len(v)):
        x = v[max(start[i], i - window + 1) : i + 1].astype(np.longdouble)
        if len(x) < 2:
            assert np.isnan(got["zscore"][i])
            continue
        std = 0.0 if x.min() == x.max() else float(x.std(ddof=1))
        z = (v[i] - float(x.mean())) / std if std else 0.0
        np.testing.assert_allclose([got["win_mean"][i], got["win_std"][i], got["zscore"][i]], [float(x.mean()), std, z], rtol=1e-9, atol=1e-12)


def test_python_sees_keys_and_values_alone(spark):
    """The rows' other columns do not go through Python."""
    from pyspark.sql import functions as F
    from tidewatch.operators import windows

    df = spark.range(200).select(F.col("id"), F.lit("f").alias("feature"), F.col("id").cast("double").alias("value"),
                                 F.lit("x").alias("note"))
    seen, write = [], windows.materialize
    try:
        windows.materialize = lambda d, label="table": (seen.append(d._jdf.queryExecution().executedPlan().toString()), write(d, label))[1]
        out = windows.rolling_stats(df, ["id"], window=20, num_partitions=3)
    finally:
        windows.materialize = write
    assert "ArrowEvalPython" in seen[0] and "MapInArrow" not in seen[0]
    assert {r.id: r.note for r in out.collect()} == dict.fromkeys(range(200), "x")


def test_frame_quartiles_equal_percentile(spark):
    """The sorted frame gives what ``percentile`` over the frame gives, and
    small inputs still use all partitions."""
    from pyspark.sql import Window
    from pyspark.sql import functions as F
    from tidewatch.operators import windows

    df = spark.range(300).select(F.col("id"), (F.col("id") % 4).alias("feature"), ((F.col("id") * 37) % 50 / 3).alias("value"))
    w = Window.partitionBy("feature").orderBy("id").rowsBetween(-8, 0)
    q = F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(w)
    want = {r.id: tuple(r.q) for r in df.select("id", q.alias("q")).collect()}
    out = windows.rolling_stats(df, ["id"], window=9, strategy="frame")
    for r in out.collect():
        got = (r.win_p25, r.win_median, r.win_p75)
        assert got == (want[r.id] if r.win_count > 1 else (None,) * 3)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "percentile(" not in plan and "REPARTITION_BY_NUM" in plan
