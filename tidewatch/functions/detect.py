"""Statistical tests as pure Column expressions (batch or streaming).

Inputs are a value column and the window statistics produced by
:func:`tidewatch.operators.windows.rolling_stats` (or any table with the
same column names, e.g. a baseline joined on).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.params import DetectorParams


def _c(name: str | Column) -> Column:
    return F.col(name) if isinstance(name, str) else name


def insufficient(min_samples: int, count: str = "win_count") -> Column:
    """Window smaller than ``min_samples`` (or not ready): no verdict."""
    return F.coalesce(_c(count) < F.lit(min_samples), F.lit(True)) | _c("win_std").isNull()


def zscore_flag(threshold: float, zscore: str = "zscore") -> Column:
    """``|z| > threshold`` (strict); a NaN never flags (Spark orders it above
    every number)."""
    z = _c(zscore)
    return F.coalesce(~F.isnan(z) & (F.abs(z) > F.lit(threshold)), F.lit(False))


def fences(k: float) -> tuple[Column, Column]:
    """Tukey fences ``p25 - k*iqr`` and ``p75 + k*iqr``."""
    return (_c("win_p25") - F.lit(k) * _c("win_iqr"), _c("win_p75") + F.lit(k) * _c("win_iqr"))


def iqr_flag(k: float, value: str = "value") -> Column:
    """Outside the Tukey fences (strict); a zero IQR or a NaN never flags."""
    lo, hi = fences(k)
    v = _c(value)
    return F.coalesce(~F.isnan(v) & (_c("win_iqr") != 0) & ((v < lo) | (v > hi)), F.lit(False))


def detect(df: DataFrame, params: DetectorParams = DetectorParams(), value_col: str = "value") -> DataFrame:
    """Add the verdict columns of the z-score and IQR tests.

    ``z_flag``, ``iqr_flag``, ``is_anomaly`` (either), ``anomaly_type``
    (``zscore`` wins over ``iqr``), ``score`` = |z| (0 when gated or NaN),
    ``lower_fence``/``upper_fence`` and ``reason`` (``insufficient_samples``
    below ``min_samples``).
    """
    gate = insufficient(params.min_samples)
    nan = F.coalesce(F.isnan("zscore"), F.lit(False))
    zf = ~gate & zscore_flag(params.zscore_threshold)
    qf = ~gate & iqr_flag(params.iqr_multiplier, value_col)
    lo, hi = fences(params.iqr_multiplier)
    return df.select(
        "*",
        zf.alias("z_flag"),
        qf.alias("iqr_flag"),
        (zf | qf).alias("is_anomaly"),
        F.when(zf, F.lit("zscore")).when(qf, F.lit("iqr")).alias("anomaly_type"),
        F.when(gate | nan, F.lit(0.0)).otherwise(F.abs(F.col("zscore"))).alias("score"),
        lo.alias("lower_fence"),
        hi.alias("upper_fence"),
        F.when(gate, F.lit("insufficient_samples")).alias("reason"),
    )


#: the evidence record of an alert, whichever detector found it
DETAILS_FIELDS = (
    ("zscore", "double"), ("zscore_threshold", "double"), ("zscore_flag", "boolean"), ("iqr", "double"),
    ("lower_fence", "double"), ("upper_fence", "double"), ("iqr_flag", "boolean"), ("window_mean", "double"),
    ("window_std", "double"), ("window_count", "bigint"), ("reason", "string"),
    ("detector", "string"), ("raw_score", "double"), ("prediction", "int"), ("total_samples_seen", "bigint"),
)
DETAILS_TYPE = "struct<" + ",".join(f"{n}:{t}" for n, t in DETAILS_FIELDS) + ">"


def _record(**known: Column) -> Column:
    return F.struct(*[known.get(n, F.lit(None)).cast(t).alias(n) for n, t in DETAILS_FIELDS])


def details(params: DetectorParams = DetectorParams()) -> Column:
    """Evidence record of one statistical verdict, made with the parameters of
    :func:`detect`, as a STRUCT (absent keys are NULL)."""
    return _record(
        zscore=F.col("zscore"), zscore_threshold=F.lit(params.zscore_threshold), zscore_flag=F.col("z_flag"),
        iqr=F.col("win_iqr"), lower_fence=F.col("lower_fence"), upper_fence=F.col("upper_fence"),
        iqr_flag=F.col("iqr_flag"), window_mean=F.col("win_mean"), window_std=F.col("win_std"),
        window_count=F.col("win_count"), reason=F.col("reason"),
    )


def forest_details() -> Column:
    """Evidence record of one forest verdict: its raw score, the prediction
    (-1 anomalous, 1 not) and the number of vectors seen up to it."""
    return _record(
        detector=F.lit("isolation_forest"), raw_score=F.col("raw_score"),
        prediction=F.when(F.col("is_anomaly"), F.lit(-1)).otherwise(F.lit(1)), total_samples_seen=F.col("n"),
        reason=F.col("reason"),
    )
