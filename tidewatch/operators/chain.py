"""Chain windows: the shared primitive behind deduplication and rate limits.

A window opens at a key's first row; the next window opens at the first row
with ``ts >= open + gap``. Rows in between belong to the open window. This
is neither a tumbling nor a session window: windows are anchored on data,
and suppressed rows never extend them.

Plan (no task ever holds a whole key):

1. rows get global positions in ``(key, ts, order)`` order (distributed
   sort, :mod:`tidewatch.operators.positions`);
2. a row that follows the previous row of its key by ``>= gap`` must open a
   window (the last opening is no later than that previous row), so such
   silences cut a key into independent sessions. The previous row comes from
   a self-join on position, session ids from a parallel carry-forward;
3. sessions up to ``fold_rows`` rows are packed into groups of about
   ``group_rows`` rows and folded in order by ``applyInPandas`` (a binary
   search jumps from window to window, so the loop runs once per window).
   Folding several sessions in one pass stays exact: a later session's
   first row is always at least ``gap`` after the last opening;
4. longer sessions (a dense hot key) are cut into slices of ``group_rows``
   rows. What a slice does depends on one number, the time from which a row
   may open a window; its last opening is a step function of it. Slices
   tabulate that function side by side, with as many steps as the chains
   that start within the slice's first gap still differ at its end; a
   session's functions are read through in order, which gives each slice its
   entry; then the slices are folded side by side. Three passes, whatever the
   session's length.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.positions import GPOS, PID, last_of_each, with_global_position
from tidewatch.session import materialize

TS_US = "_ts_us"
#: a missing time inside a fold: before all others
NO_TIME = int(np.iinfo(np.int64).min)


def epoch_micros(df: DataFrame, ts_col: str) -> F.Column:
    """Event time as microseconds since the epoch, whatever the session zone."""
    from tidewatch.functions.alerting import is_ntz, ts_micros

    return ts_micros(ts_col, is_ntz(df, ts_col))


def _fold_groups(rows: DataFrame, key_cols: Sequence[str], gap_us: int, order_cols: Sequence[str],
                 group_rows: int, by_key: bool = False) -> DataFrame:
    """Sequential fold of whole sessions packed into bounded groups."""
    schema = T.StructType(list(rows.schema.fields) + [
        T.StructField("_opens", T.BooleanType()),
        T.StructField("_wstart_us", T.LongType()),
        T.StructField("_rank", T.LongType()),
    ])
    sort_cols = [TS_US, *order_cols]

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([*key_cols, *sort_cols], kind="stable").reset_index(drop=True)
        ts = pdf[TS_US].to_numpy(dtype=np.int64)
        n = len(ts)
        opens = np.zeros(n, dtype=bool)
        start = np.zeros(n, dtype=np.int64)
        rank = np.zeros(n, dtype=np.int64)
        # a group may hold several keys and sessions: fold each run separately
        change = np.zeros(max(n - 1, 0), dtype=bool)
        for c in [*key_cols, "_sess"]:
            codes, _ = pd.factorize(pdf[c], use_na_sentinel=True)
            change |= codes[1:] != codes[:-1]
        seg = np.r_[0, np.flatnonzero(change) + 1, n].astype(np.int64)
        for a, b in zip(seg[:-1].tolist(), seg[1:].tolist()):
            # next opening of every row at once, then follow the pointers
            own = ts[a:b]
            nxt = np.maximum(np.searchsorted(own, own + gap_us, side="left"), np.arange(1, b - a + 1)).tolist()
            i = 0
            while i < b - a:
                opens[a + i] = True
                i = nxt[i]
        if n:
            first = np.maximum.accumulate(np.where(opens, np.arange(n), 0))
            start, rank = ts[first], np.arange(n) - first + 1
        pdf["_opens"] = opens
        pdf["_wstart_us"] = start
        pdf["_rank"] = rank
        return pdf

    pack = F.expr(f"_sess div {int(group_rows)}").alias("_pack")
    groups = [*key_cols, pack] if by_key else [pack]
    return rows.groupBy(*groups).applyInPandas(fold, schema)


def _next_openings(ts: np.ndarray, gap_us: int) -> np.ndarray:
    """For a window that opens at a row: the row that opens the next one
    (``len(ts)``: none)."""
    n = len(ts)
    return np.maximum(np.searchsorted(ts, ts + gap_us, side="left"), np.arange(1, n + 1))


def _exits(ts: np.ndarray, gap_us: int) -> tuple[np.ndarray, np.ndarray]:
    """The step function of a slice: rows ``c`` and the last opening of the
    slice where its first is row ``c`` or a row between the step before and
    ``c``. No window before the slice reaches further than a gap into it."""
    nxt = _next_openings(ts, gap_us)
    last = np.arange(len(ts) + 1)
    step = np.append(nxt, len(ts))
    while True:  # follow all chains to their ends, twice as far each time
        inside = step < len(ts)
        if not inside.any():
            break
        last = np.where(inside, last[step], last)
        step = step[step]
    cand = np.arange(min(len(ts), int(np.searchsorted(ts, ts[0] + gap_us, side="left")) + 1))
    cand = cand[np.append(True, ts[cand][1:] != ts[cand][:-1])]  # of rows of one time the first may open
    ends = last[cand]
    steps = np.flatnonzero(np.append(ends[1:] != ends[:-1], True))
    return cand[steps], ends[steps]


def _fold_long(rows: DataFrame, gap_us: int, slice_rows: int) -> DataFrame:
    """Exact chain windows of long sessions, slice by slice (see the module's head).

    ``rows`` carry ``_sess`` (position of the session's first row), ``_gpos``
    (contiguous inside a session, in (ts, order) order) and ``_ts_us``.
    """
    cut = rows.withColumn("_slice", F.expr(f"({GPOS} - _sess) div {int(slice_rows)}"))
    at = ["_sess", "_slice"]

    def times(group: pa.Table) -> tuple[pa.Table, np.ndarray]:
        group = group.sort_by(GPOS)
        return group, group.column(TS_US).fill_null(NO_TIME).to_numpy()

    def tabulate(group: pa.Table) -> pa.Table:
        group, ts = times(group)
        upto, last = _exits(ts, gap_us)
        head = [pa.array(np.full(len(upto), group.column(c)[0].as_py(), np.int64)) for c in at]
        pos = group.column(GPOS).to_numpy()
        return pa.Table.from_arrays([*head, pa.array(ts[upto]), pa.array(pos[last]), pa.array(ts[last])],
                                    [*at, "_upto", "_open", "_open_us"])

    def follow(batches):
        """Each slice's entry: the last opening before it."""
        sess, slice_, entry, left = None, None, None, None
        for b in batches:
            out = []
            for s, k, upto, pos, us in zip(*(b.column(i).to_pylist() for i in range(5))):
                if (s, k) != (sess, slice_):
                    entry = left if s == sess else None
                    sess, slice_, left, found = s, k, entry, False
                    out.append((s, k, *(entry or (None, None))))
                if not found and (entry is None or entry[1] + gap_us <= upto):
                    left, found = (pos, us), True
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*out) if out else ([],) * 4)],
                                             [*at, "_open", "_open_us"])

    table = cut.select(*at, GPOS, TS_US).groupBy(*at).applyInArrow(
        tabulate, "_sess long, _slice long, _upto long, _open long, _open_us long")
    ordered = table.repartition("_sess").sortWithinPartitions(*at, "_upto")
    entries = materialize(ordered.mapInArrow(follow, "_sess long, _slice long, _open long, _open_us long"), "chain-entries")
    own_names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField("_opens", T.BooleanType()),
                           T.StructField("_wstart_us", T.LongType()), T.StructField("_rank", T.LongType())])

    def fold(group: pa.Table) -> pa.Table:
        group, ts = times(group)
        pos, n = group.column(GPOS).to_numpy(), len(ts)
        open_, open_us = group.column("_open")[0].as_py(), group.column("_open_us")[0].as_py()
        nxt, opens = _next_openings(ts, gap_us).tolist(), np.zeros(n, dtype=bool)
        i = 0 if open_ is None else int(np.searchsorted(ts, open_us + gap_us, side="left"))
        while i < n:
            opens[i] = True
            i = nxt[i]
        first = np.maximum.accumulate(np.where(opens, np.arange(n), -1))
        inside = first >= 0
        start = np.where(inside, ts[first], open_us or 0)
        rank = pos - np.where(inside, pos[first], open_ or 0) + 1
        own = group.select(own_names)
        return pa.Table.from_arrays([*own.columns, pa.array(opens), pa.array(start, mask=start == NO_TIME), pa.array(rank)], schema.names)

    # one entry per slice, rows / slice_rows in all
    return cut.join(F.broadcast(entries), at).groupBy(*at).applyInArrow(fold, schema)


def _session_ids_by_key(staged: DataFrame, keys: Sequence[str], gap_us: int, order_cols: Sequence[str]) -> DataFrame:
    """``_sess`` = row number (within the key) of the session's first row,
    offset so that sessions of different keys never share an id; used when
    every key is known to be at most ``fold_rows`` rows."""
    w = Window.partitionBy(*keys).orderBy(TS_US, *order_cols)
    prev = F.lag(TS_US).over(w)
    rn = F.row_number().over(w)
    first = F.when(prev.isNull() | ((F.col(TS_US) - prev) >= gap_us), rn)
    staged = staged.withColumn("_cut_rn", first)
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    return staged.withColumn("_sess", F.max("_cut_rn").over(upto)).drop("_cut_rn")


def _session_ids(pos: DataFrame, keys: Sequence[str], gap_us: int) -> DataFrame:
    """``_sess`` = position of the first row of each row's session.

    ``pos`` is range-partitioned with stored partition ids and contiguous
    positions. The previous row and the running session start come from a
    window over each range partition (bounded groups), seeded by a table of
    at most P rows describing the partitions before it.
    """
    kstruct = F.struct(*[F.col(k) for k in keys]) if keys else F.lit(0)
    tail = last_of_each(pos, GPOS).select(PID, F.struct(kstruct.alias("k"), F.col(TS_US).alias("t")).alias("_last"))
    by_pid = Window.orderBy(PID)
    seed = tail.select(PID, F.lag("_last").over(by_pid).alias("_prev"))
    w = Window.partitionBy(PID).orderBy(GPOS)
    j = pos.join(F.broadcast(seed), PID, "left")
    pk = F.coalesce(F.lag(kstruct).over(w), F.col("_prev.k"))
    pt = F.coalesce(F.lag(TS_US).over(w), F.col("_prev.t"))
    cut = pk.isNull() | ~kstruct.eqNullSafe(pk) | ((F.col(TS_US) - pt) >= gap_us)
    flagged = j.withColumn("_cut", F.when(cut, F.col(GPOS)))
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    local = flagged.withColumn("_sloc", F.max("_cut").over(upto))
    last_cut = local.groupBy(PID).agg(F.max("_cut").alias("_lc"))
    carry = last_cut.select(PID, F.max("_lc").over(by_pid.rowsBetween(Window.unboundedPreceding, -1)).alias("_cin"))
    out = local.join(F.broadcast(carry), PID, "left")
    return out.withColumn("_sess", F.coalesce(F.col("_sloc"), F.col("_cin"))).drop("_cut", "_sloc", "_cin", "_prev", PID)


def chain_windows(
    df: DataFrame,
    key_cols: Sequence[str],
    ts_col: str,
    gap_seconds: float,
    order_cols: Sequence[str] = (),
    prefix: str = "",
    group_rows: int = 1 << 16,
    fold_rows: int = 1 << 20,
    force_positions: bool = False,
) -> DataFrame:
    """Assign chain windows per key.

    Adds ``{prefix}opens`` (row opens a window), ``{prefix}window_start``
    (event time of the opening row) and ``{prefix}rank`` (1-based position
    of the row in its window, in ``(ts, *order_cols)`` order).
    ``order_cols`` must make ``(key, ts, order)`` a total order.
    """
    gap_us = int(round(gap_seconds * 1_000_000))
    keys = list(key_cols)
    # the size check below is an action: read the input once, not per action
    staged = materialize(df.withColumn(TS_US, epoch_micros(df, ts_col)), "chain-in")
    # Checked fast path: when no key exceeds ``fold_rows`` rows, a per-key
    # window (one bounded task per key) finds the sessions. Beyond that bound
    # the positions path spreads every key over all tasks.
    largest = staged.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if largest <= fold_rows and not force_positions:
        sess = _session_ids_by_key(staged, keys, gap_us, order_cols)
        small = _fold_groups(sess, keys, gap_us, order_cols, group_rows, by_key=True)
        return _finish(small, df, ts_col, prefix)
    pos = with_global_position(staged, [*keys, TS_US, *order_cols])
    sess = _session_ids(pos, keys, gap_us)
    # the list of long sessions has at most rows / fold_rows entries
    sess = materialize(sess, "chain-sessions")
    long = materialize(sess.groupBy("_sess").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > fold_rows).select("_sess"),
                       "chain-long")
    if not long.limit(1).count():
        return _finish(_fold_groups(sess, keys, gap_us, order_cols, group_rows), df, ts_col, prefix)
    small = _fold_groups(sess.join(long, "_sess", "left_anti"), keys, gap_us, order_cols, group_rows)
    big = _fold_long(sess.join(long, "_sess", "left_semi"), gap_us, group_rows)
    return _finish(small.unionByName(big), df, ts_col, prefix)


def _finish(out: DataFrame, df: DataFrame, ts_col: str, prefix: str) -> DataFrame:
    from tidewatch.functions.alerting import is_ntz

    if is_ntz(df, ts_col):  # back to wall time without the session zone
        start_ts = F.timestamp_add("MICROSECOND", F.col("_wstart_us"), F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))
    else:
        start_ts = F.timestamp_micros("_wstart_us")
    return out.select(
        *df.columns, TS_US,
        F.col("_opens").alias(f"{prefix}opens"),
        start_ts.alias(f"{prefix}window_start"),
        F.col("_rank").alias(f"{prefix}rank"),
    )
