"""Operational metrics as grouped aggregates over pipeline output."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Fixed bucket bounds (seconds) of the reference's latency histograms.
PROCESSING_BOUNDS = (0.001, 0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5)


def bound_label(b: float) -> str:
    return repr(float(b))


def bucket_histogram(df: DataFrame, col: str, bounds: Sequence[float], group_cols: Sequence[str] = ()) -> DataFrame:
    """Cumulative histogram of ``col``: one row per bucket ``le`` (plus ``+Inf``)
    with the count of values ``<= le``, and the overall ``sum`` and ``count``.

    One aggregation pass (partial aggregation map-side) whatever the size.
    """
    c = F.col(col)
    aggs = [F.sum(F.when(c <= F.lit(float(b)), 1).otherwise(0)).cast("long").alias(f"_b{i}") for i, b in enumerate(bounds)]
    aggs += [F.count(c).alias("_bInf"), F.sum(c).alias("sum"), F.count(c).alias("count")]
    one = df.groupBy(*group_cols).agg(*aggs)
    labels = [bound_label(b) for b in bounds] + ["+Inf"]
    names = [f"_b{i}" for i in range(len(bounds))] + ["_bInf"]
    stack = F.explode(F.array(*[F.struct(F.lit(lbl).alias("le"), F.col(n).alias("cumulative")) for lbl, n in zip(labels, names)]))
    return one.select(*group_cols, stack.alias("_h"), F.round("sum", 6).alias("sum"), "count").select(
        *group_cols, "_h.le", "_h.cumulative", "sum", "count")
