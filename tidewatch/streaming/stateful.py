"""Single-operator stateful twins (lower latency, one stage only).

``dedup_stream`` runs chain-window deduplication as one
``applyInPandasWithState``: the state of a key is the event time of its
last emitted alert. Within a micro-batch a key's rows are bounded by the
trigger size (e.g. ``maxOffsetsPerTrigger``), and the fold jumps from window
to window with a binary search. Structured Streaming allows one such
operator per query, so the full detector uses
:class:`tidewatch.streaming.micro_batch.DetectionStream` instead.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from tidewatch.functions.alerting import is_ntz, ts_micros
from tidewatch.params import AlertParams


def dedup_stream(
    anomalies: DataFrame,
    ts_col: str = "ts",
    key_cols: Sequence[str] = ("feature", "anomaly_type"),
    order_cols: Sequence[str] = ("event_id",),
    params: AlertParams = AlertParams(),
    watermark: str | None = None,
) -> DataFrame:
    """Streaming deduplication: adds ``status`` (``emitted``/``duplicate``).

    With ``watermark`` (e.g. ``"10 minutes"``; needs a TIMESTAMP column) a
    key's state is dropped once the watermark passes its last emission plus
    the dedup window -- the streaming form of dedup-state expiry.
    """
    gap_us = int(round(params.dedup_window_seconds * 1_000_000))
    staged = anomalies.withColumn("_t_us", ts_micros(ts_col, is_ntz(anomalies, ts_col)))
    if watermark:
        staged = staged.withWatermark(ts_col, watermark)
    out_schema = T.StructType(list(staged.schema.fields) + [T.StructField("status", T.StringType())])
    state_schema = T.StructType([T.StructField("last_open", T.LongType())])
    sort_cols = ["_t_us", *order_cols]

    def fold(key, pdfs, state):
        if state.hasTimedOut:
            state.remove()
            return
        pdf = pd.concat(list(pdfs), ignore_index=True)
        if pdf.empty:
            return
        pdf = pdf.sort_values(sort_cols, kind="stable").reset_index(drop=True)
        ts = pdf["_t_us"].to_numpy(dtype=np.int64)
        emitted = np.zeros(len(ts), dtype=bool)
        last = state.get[0] if state.exists else None
        i = 0 if last is None else int(np.searchsorted(ts, last + gap_us, side="left"))
        while i < len(ts):
            emitted[i] = True
            last = int(ts[i])
            i = max(int(np.searchsorted(ts, ts[i] + gap_us, side="left")), i + 1)
        state.update((last,))
        if watermark:
            state.setTimeoutTimestamp((last + gap_us) // 1000)
        pdf["status"] = np.where(emitted, "emitted", "duplicate")
        yield pdf

    timeout = GroupStateTimeout.EventTimeTimeout if watermark else GroupStateTimeout.NoTimeout
    out = staged.groupBy(*key_cols).applyInPandasWithState(fold, out_schema, state_schema, "append", timeout)
    return out.drop("_t_us")


def rolling_stats_stream(
    rows: DataFrame,
    order_cols: Sequence[str],
    key_cols: Sequence[str] = ("feature",),
    value_col: str = "value",
    window: int = 1000,
) -> DataFrame:
    """Count-window statistics as one ``applyInPandasWithState``.

    State per key: the last ``window - 1`` values (``ARRAY<DOUBLE>``, bounded
    by the window). Each micro-batch prepends them to the key's new rows
    (ordered by ``order_cols``) and runs the same NumPy kernel as the batch
    operator, so the numbers equal :func:`rolling_stats`. Rows of one key in
    one micro-batch are bounded by the trigger size.
    """
    from tidewatch.functions.window_kernel import STAT_NAMES, window_stats
    from tidewatch.operators.windows import STAT_FIELDS

    out_schema = T.StructType(list(rows.schema.fields) + STAT_FIELDS)
    state_schema = T.StructType([T.StructField("tail", T.ArrayType(T.DoubleType()))])
    keep = max(window - 1, 0)

    def step(key, pdfs, state):
        pdf = pd.concat(list(pdfs), ignore_index=True)
        if pdf.empty:
            return
        pdf = pdf.sort_values(list(order_cols), kind="stable").reset_index(drop=True)
        tail = np.asarray(state.get[0] if state.exists and state.get[0] is not None else [], dtype=np.float64)
        v = np.concatenate([tail, pdf[value_col].to_numpy(dtype=np.float64)])
        rows_idx = np.arange(len(tail), len(v))
        st = window_stats(v, np.zeros(len(v), dtype=np.int64), window, rows_idx)
        for name in STAT_NAMES:
            pdf[name] = st[name]
        state.update(([float(x) for x in v[len(v) - keep:]] if keep else [],))
        yield pdf

    return rows.groupBy(*key_cols).applyInPandasWithState(step, out_schema, state_schema, "append",
                                                           GroupStateTimeout.NoTimeout)
