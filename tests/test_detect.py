"""Statistical detector cases (FIXTURES section 3): stats rows -> verdicts."""

import pytest

from tidewatch.functions.detect import detect
from tidewatch.params import DetectorParams

BASE = dict(win_mean=100.0, win_std=10.0, win_min=70.0, win_max=130.0, win_median=100.0,
            win_p25=93.0, win_p75=107.0, win_iqr=14.0, zscore=0.0, win_count=100)
SCHEMA = ("feature string, value double, win_mean double, win_std double, win_min double, win_max double, "
          "win_median double, win_p25 double, win_p75 double, win_iqr double, zscore double, win_count long")


def _check(spark, value, params=DetectorParams(), feature="declared_value", **over):
    s = {**BASE, **over}
    row = (feature, float(value), s["win_mean"], s["win_std"], s["win_min"], s["win_max"], s["win_median"],
           s["win_p25"], s["win_p75"], s["win_iqr"], s["zscore"], s["win_count"])
    return detect(spark.createDataFrame([row], SCHEMA), params).first()


@pytest.mark.parametrize("z,value,anom,typ", [
    (1.5, 115, False, None), (4.2, 142, True, "zscore"), (-3.5, 65, True, "zscore"),
    (1.0, 110, False, None), (3.5, 135, True, "zscore"), (-3.5, 60, True, "zscore"),
])
def test_zscore_and_iqr(spark, z, value, anom, typ):
    r = _check(spark, value, zscore=z)
    assert r.is_anomaly == anom and r.anomaly_type == typ
    assert r.score == pytest.approx(abs(z))


def test_boundary_z_not_flagged_but_iqr_is(spark):
    r = _check(spark, 130, zscore=3.0)
    assert r.z_flag is False and r.iqr_flag is True and r.anomaly_type == "iqr"
    assert (r.lower_fence, r.upper_fence) == (72.0, 128.0)


def test_zero_iqr_never_flags(spark):
    r = _check(spark, 100.5, win_p25=100.0, win_p75=100.0, win_iqr=0.0, zscore=0.5)
    assert r.iqr_flag is False and r.is_anomaly is False


def test_min_samples_gate(spark):
    r = _check(spark, 200, zscore=10.0, win_count=10)
    assert r.is_anomaly is False and r.reason == "insufficient_samples" and r.score == 0.0
    r = _check(spark, 140, zscore=4.0, win_count=30)
    assert r.is_anomaly is True and r.reason is None


def test_custom_thresholds(spark):
    r = _check(spark, 125, DetectorParams(zscore_threshold=2.0, min_samples=5), zscore=2.5, win_count=50)
    assert r.is_anomaly is True
    r = _check(spark, 135, DetectorParams(zscore_threshold=10.0, iqr_multiplier=3.0, min_samples=5), zscore=2.0, win_count=50)
    assert r.is_anomaly is False  # fences 51 and 149


def test_nan_never_flags(spark):
    from tidewatch.functions.detect import detect

    nan = float("nan")
    rows = [(nan, nan), (None, None), (100.0, 50.0), (1.0, 0.1)]
    df = spark.createDataFrame([(v, 100, 0.0, 1.0, 0.0, 2.0, 0.5, 1.0, 1.5, 1.0, z) for v, z in rows],
                               "value double, win_count long, win_mean double, win_std double, win_min double, win_max double, "
                               "win_p25 double, win_median double, win_p75 double, win_iqr double, zscore double")
    got = [(r.z_flag, r.iqr_flag, r.score) for r in detect(df).collect()]
    assert got == [(False, False, 0.0), (False, False, None), (True, True, 50.0), (False, False, 0.1)]
