"""Severity grading and alert ids as Column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewatch.params import DEFAULT_SEVERITY


def severity(score: str | Column = "score", thresholds: Sequence[tuple[str, float]] = DEFAULT_SEVERITY) -> Column:
    """Highest level whose threshold ``<= score``; below all of them: LOW."""
    s = F.col(score) if isinstance(score, str) else score
    ordered = sorted(thresholds, key=lambda kv: kv[1], reverse=True)
    expr = None
    for name, th in ordered:
        cond = s >= F.lit(float(th))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit("LOW")) if expr is not None else F.lit("LOW")


def ts_micros(ts: str | Column, ntz: bool = True) -> Column:
    """Microseconds since the epoch, independent of the session time zone.

    Event time is TIMESTAMP_NTZ in this library (wall time taken as UTC);
    ``ntz=False`` handles instant (TIMESTAMP) columns.
    """
    t = F.col(ts) if isinstance(ts, str) else ts
    if ntz:
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), t)
    return F.unix_micros(t)


def is_ntz(df, ts_col: str) -> bool:
    from pyspark.sql import types as T

    return isinstance(df.schema[ts_col].dataType, T.TimestampNTZType)


def alert_id(event_id: str | Column, feature: str | Column, ts: str | Column, ntz: bool = True) -> Column:
    """First 16 hex digits of SHA-256 over ``event_id:feature:epoch_micros``.

    Event time replaces the wall clock, so replays give the same ids and
    consumers of an at-least-once sink can drop repeats.
    """
    e = F.col(event_id) if isinstance(event_id, str) else event_id
    f = F.col(feature) if isinstance(feature, str) else feature
    t = F.col(ts) if isinstance(ts, str) else ts
    micros = ts_micros(t, ntz).cast("string")
    return F.substring(F.sha2(F.concat_ws(":", e.cast("string"), f, micros), 256), 1, 16)
