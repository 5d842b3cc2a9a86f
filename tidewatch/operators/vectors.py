"""Feature vectors: per event, the z-scores of all tracked features.

A feature absent from an event keeps its previous z-score (its window did
not change); the vector is NULL until every feature's window is ready.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.operators.carry import carry_forward
from tidewatch.operators.positions import PID
from tidewatch.operators.wide import WideWindows
from tidewatch.session import materialize


def feature_vectors(
    events: DataFrame,
    stats: DataFrame | WideWindows,
    id_cols: Sequence[str],
    order_cols: Sequence[str],
    features: Sequence[str],
    scope_cols: Sequence[str] = (),
    keep_place: bool = False,
) -> DataFrame:
    """One row per event: ``z_<feature>`` columns (carried forward) and
    ``vector ARRAY<DOUBLE>`` in feature order (NULL until all are ready).

    ``stats`` are long rows with ``feature`` and ``zscore`` keyed by
    ``id_cols``. The pivot is a ``groupBy`` on the event id (no streaming
    ``pivot``); events without any present feature still get a row. With
    ``scope_cols`` each scope carries its own values. With ``keep_place`` rows
    keep their place in ``(scope_cols, order_cols)`` order (``_pid``, ``_loc``).

    Where ``stats`` are the :class:`~tidewatch.operators.wide.WideWindows` of
    the events, in the same scopes and order, the z-scores as of each event are
    written where the events lie: no long rows, no second sort (unless events
    come more than once).
    """
    keys = list(dict.fromkeys([*id_cols, *scope_cols, *order_cols]))
    zcols = [f"z_{f}" for f in features]
    if isinstance(stats, WideWindows):
        if stats.distinct:
            place = [PID, "_loc"] if keep_place else []
            filled = materialize(stats.zscores(keys).select(*keys, *zcols, *place), "vectors", lean=True)
        else:  # rows of one event give one vector
            wide = stats.zscores(keys, carry=False).groupBy(*keys).agg(*[F.max(c).alias(c) for c in zcols])
            filled = carry_forward(wide, order_cols, zcols, key_cols=scope_cols, keep_place=keep_place)
        return filled.withColumn("vector", _vector(zcols))
    zrows = stats.select(*keys, "feature", "zscore")
    blanks = events.select(*keys, F.lit(None).cast("string").alias("feature"), F.lit(None).cast("double").alias("zscore"))
    wide = zrows.unionByName(blanks).groupBy(*keys).agg(
        *[F.max(F.when(F.col("feature") == F.lit(f), F.col("zscore"))).alias(f"z_{f}") for f in features]
    )
    filled = carry_forward(wide, order_cols, zcols, key_cols=scope_cols, keep_place=keep_place)
    return filled.withColumn("vector", _vector(zcols))


def _vector(zcols: Sequence[str]) -> Column:
    ready = F.lit(True)
    for c in zcols:
        ready = ready & F.col(c).isNotNull()
    return F.when(ready, F.array(*[F.col(c) for c in zcols]))
