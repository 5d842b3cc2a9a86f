"""Exact grouped quantiles without holding a group in one task.

``percentile`` as a grouped aggregate buffers every value of a group in one
task. Here rows get global positions in ``(keys, value)`` order (a
distributed sort), each key's first position and count come from one
aggregate, and the ranks a quantile needs (floor and ceil of (n-1) q) are
fetched with an equi-join on position -- then linearly interpolated, which
equals ``percentile`` / ``quantile_cont``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.positions import GPOS, PID, with_global_position


def exact_quantiles(
    df: DataFrame,
    key_cols: Sequence[str],
    value_col: str,
    quantiles: Sequence[float] = (0.25, 0.5, 0.75),
    names: Sequence[str] | None = None,
) -> DataFrame:
    """One row per key: ``names`` (default ``q<i>``) hold the linear
    quantiles of ``value_col``; ``_n`` the count of non-null values."""
    keys = list(key_cols)
    names = list(names or [f"q{i}" for i in range(len(quantiles))])
    v = df.select(*keys, F.col(value_col).alias("_v")).filter(F.col("_v").isNotNull())
    pos = with_global_position(v, [*keys, "_v"]).drop(PID)
    starts = pos.groupBy(*keys).agg(F.min(GPOS).alias("_start"), F.count(F.lit(1)).alias("_n"))
    want = []
    for i, q in enumerate(quantiles):
        lo = F.floor((F.col("_n") - 1) * F.lit(float(q))).cast("long")
        want.append(F.struct(F.lit(i).alias("qi"), F.lit(0).alias("side"), (F.col("_start") + lo).alias("p")))
        want.append(F.struct(F.lit(i).alias("qi"), F.lit(1).alias("side"),
                             (F.col("_start") + F.least(lo + 1, F.col("_n") - 1)).alias("p")))
    targets = starts.select(*keys, "_n", F.explode(F.array(*want)).alias("_w")).select(*keys, "_n", "_w.*")
    got = targets.join(pos.select(F.col(GPOS).alias("p"), "_v"), "p")
    per_key = got.groupBy(*keys, "_n").agg(
        *[F.max(F.when((F.col("qi") == i) & (F.col("side") == s), F.col("_v"))).alias(f"_q{i}_{s}")
          for i in range(len(quantiles)) for s in (0, 1)]
    )
    out = []
    for i, q in enumerate(quantiles):
        pos_q = (F.col("_n") - 1) * F.lit(float(q))
        frac = pos_q - F.floor(pos_q)
        a, b = F.col(f"_q{i}_0"), F.col(f"_q{i}_1")
        out.append((a + (b - a) * frac).alias(names[i]))
    return per_key.select(*keys, "_n", *out)
