"""Alert policy: deduplication, rate limiting, dedup-state expiry.

Event time replaces the wall clock, so results are reproducible and replays
are idempotent.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.operators.chain import TS_US, chain_windows
from tidewatch.params import AlertParams


def dedup_alerts(
    anomalies: DataFrame,
    ts_col: str = "ts",
    order_cols: Sequence[str] = (),
    scope_cols: Sequence[str] = (),
    params: AlertParams = AlertParams(),
) -> DataFrame:
    """Mark each anomaly ``emitted`` or ``duplicate``.

    Key = (scope, feature, anomaly_type). A row is a duplicate while less
    than ``dedup_window_seconds`` have passed since the key's last emitted
    alert; duplicates do not extend the window.
    """
    keys = [*scope_cols, "feature", "anomaly_type"]
    chained = chain_windows(anomalies, keys, ts_col, params.dedup_window_seconds, order_cols, prefix="dedup_")
    return chained.withColumn("status", F.when(F.col("dedup_opens"), F.lit("emitted")).otherwise(F.lit("duplicate")))


def rate_limit(
    candidates: DataFrame,
    ts_col: str = "ts",
    order_cols: Sequence[str] = (),
    scope_cols: Sequence[str] = (),
    params: AlertParams = AlertParams(),
) -> DataFrame:
    """Allow at most ``max_alerts_per_minute`` per budget window.

    The budget window opens at the first candidate and restarts at the first
    candidate at least ``rate_window_seconds`` after the window's start (not
    clock-aligned). Adds ``rate_window_start``, ``rate_rank`` and
    ``rate_limited``.
    """
    chained = chain_windows(candidates, list(scope_cols), ts_col, params.rate_window_seconds, order_cols, prefix="rate_")
    return chained.withColumn("rate_limited", F.col("rate_rank") > F.lit(params.max_alerts_per_minute)).drop("rate_opens")


def alert_policy(
    anomalies: DataFrame,
    ts_col: str = "ts",
    order_cols: Sequence[str] = (),
    scope_cols: Sequence[str] = (),
    params: AlertParams = AlertParams(),
) -> DataFrame:
    """The anomalies that go out as alerts: emitted by
    :func:`coupled_alert_policy`, so exact also when the budget binds."""
    done = coupled_alert_policy(anomalies, ts_col, order_cols, scope_cols, params)
    return done.filter(F.col("status") == "emitted").drop("status")


def expired_dedup_keys(
    alerts: DataFrame,
    now,
    ts_col: str = "ts",
    key_cols: Sequence[str] = ("feature", "anomaly_type"),
    params: AlertParams = AlertParams(),
) -> DataFrame:
    """Dedup keys whose last emission is more than the window before ``now``.

    The reference's periodic cache cleanup as a query over emitted alerts.
    ``now`` is a timestamp literal or a one-row DataFrame with column
    ``now`` (e.g. the batch's max event time); the latter is joined as a
    single broadcast row.
    """
    last = alerts.groupBy(*key_cols).agg(F.max(ts_col).alias("last_emitted"))
    if isinstance(now, DataFrame):
        last = last.crossJoin(F.broadcast(now.select("now").limit(1)))
        now_col = F.col("now")
    else:
        now_col = F.lit(now)
    from tidewatch.functions.alerting import is_ntz, ts_micros

    ntz = is_ntz(last, "last_emitted")
    age = ts_micros(now_col, ntz) - ts_micros("last_emitted", ntz)
    return last.filter(age > F.lit(int(params.dedup_window_seconds * 1_000_000)))


def _gaps(params: AlertParams) -> tuple[int, int, int]:
    micros = (int(round(x * 1_000_000)) for x in (params.dedup_window_seconds, params.rate_window_seconds))
    return (*micros, int(params.max_alerts_per_minute))


def policy_step(
    rows: DataFrame,
    state: DataFrame | None,
    group_cols: Sequence[str],
    order_cols: Sequence[str],
    params: AlertParams = AlertParams(),
) -> DataFrame:
    """Run the alert machine over each group's rows, from its carried state.

    ``rows`` have ``_ts_us`` (event time), ``feature`` and ``anomaly_type`` and
    are taken in ``order_cols`` order. ``state(_g, _state)`` holds the machine's
    state by group. Adds ``status`` (see :mod:`tidewatch.functions.alert_machine`)
    and, on a group's last row, ``_state`` and ``_until``, the time from which
    that state no longer matters; the group's name is in ``_g``. The state has
    one entry per dedup key. A task sorts its groups and reads them through a
    batch at a time (Spark's sort spills), so it holds a batch and a state,
    whatever a group's size.
    """
    import pyarrow as pa
    from pyspark.sql import types as T

    from tidewatch.functions.alert_machine import STATUS, MachineState, run_machine
    from tidewatch.operators.positions import key_changes

    gap_d, gap_r, limit = _gaps(params)
    named = rows.withColumn("_g", _group_name(group_cols))
    more = [("status", T.StringType()), ("_state", T.StringType()), ("_until", T.LongType())]
    schema = T.StructType([*named.schema.fields, *(T.StructField(n, t) for n, t in more)])
    names = [f.name for f in schema.fields]
    # a group's state comes to its task as a row before the group's own
    marked = named.withColumn("_mark", F.lit(1)).withColumn("_state", F.lit(None).cast("string"))
    if state is not None:
        held = state.select("_g", "_state").withColumn("_mark", F.lit(0))
        marked = marked.unionByName(held, allowMissingColumns=True)

    def fold(batches):
        group, machine, last = None, MachineState(), None  # last: the open group's last row, with its status
        for b in batches:
            if not b.num_rows:
                continue
            first = b.column("_g")[0].as_py()
            if last is not None:
                yield closed(last, machine) if first != group else last
                last = None
            starts = np.flatnonzero(key_changes(b, ["_g"])).tolist()
            own = b.column("_mark").to_numpy() == 1
            ts = b.column(TS_US).fill_null(np.iinfo(np.int64).min).to_numpy()
            keys = list(zip(b.column("feature").to_pylist(), b.column("anomaly_type").to_pylist()))
            codes = np.zeros(b.num_rows, np.int8)
            texts, untils = [None] * b.num_rows, [None] * b.num_rows
            for lo, hi in zip(starts, [*starts[1:], b.num_rows]):
                name = first if lo == 0 else b.column("_g")[lo].as_py()
                if name != group:
                    group, machine = name, MachineState()
                if not own[lo]:
                    machine = MachineState(b.column("_state")[lo].as_py())
                    lo += int(np.count_nonzero(~own[lo:hi]))
                if lo < hi:
                    codes[lo:hi] = run_machine(ts[lo:hi], keys[lo:hi], machine, gap_d, gap_r, limit)
                    if hi < b.num_rows:
                        texts[hi - 1], untils[hi - 1] = machine.text(), machine.until(gap_d, gap_r)
            made = [pa.array(STATUS[codes], pa.string()), pa.array(texts, pa.string()), pa.array(untils, pa.int64())]
            out = pa.RecordBatch.from_arrays([*(b.column(c) for c in names[:-3]), *made], names)
            if own[-1]:
                last, out, own = out.slice(b.num_rows - 1), out.slice(0, b.num_rows - 1), own[:-1]
            yield out if own.all() else out.filter(pa.array(own))
        if last is not None:
            yield closed(last, machine)

    def closed(row: pa.RecordBatch, machine: MachineState) -> pa.RecordBatch:
        ends = [pa.array([machine.text()], pa.string()), pa.array([machine.until(gap_d, gap_r)], pa.int64())]
        return pa.RecordBatch.from_arrays([*row.columns[:-2], *ends], names)

    together = marked.repartition("_g").sortWithinPartitions("_g", "_mark", *order_cols)
    return together.mapInArrow(fold, schema)


def _group_name(group_cols: Sequence[str]):
    return F.to_json(F.struct(F.lit(0).alias("all"), *[F.col(c) for c in group_cols]))


#: times a lot is folded again from another entry state
GUESSES = 0


def _entry_states(lean: DataFrame, state: DataFrame | None, params: AlertParams) -> DataFrame:
    """``(_run, _lot, _state)``: the machine's state before each lot of each run.

    What the machine does to a lot depends on every key's last emission and on
    the open rate window, so lots have no short table of exits by entry as
    chain windows have. But only times and keys matter and the machine jumps,
    so a run's rows are packed (times as differences, keys as codes,
    compressed) side by side, and one task per run reads its packs in order,
    one at a time, and notes the state at each lot.
    """
    import json

    import pyarrow as pa

    from tidewatch.functions.alert_machine import MachineState, run_coded
    from tidewatch.operators.positions import GPOS, key_changes

    gap_d, gap_r, limit = _gaps(params)

    def pack(batches):
        for b in batches:
            if not b.num_rows:
                continue
            ts = b.column(TS_US).fill_null(np.iinfo(np.int64).min).to_numpy()
            f, a = (b.column(c).dictionary_encode() for c in ("feature", "anomaly_type"))
            fi, ai = (x.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64) for x in (f, a))
            fs, types = ([*x.dictionary.to_pylist(), None] for x in (f, a))
            both, code = np.unique(fi * len(types) + ai % len(types), return_inverse=True)
            names = [(fs[v // len(types)], types[v % len(types)]) for v in both.tolist()]
            starts = np.flatnonzero(key_changes(b, ["_run", "_lot"])).tolist()
            out = []
            for lo, hi in zip(starts, [*starts[1:], b.num_rows]):
                with np.errstate(over="ignore"):
                    steps = np.diff(ts[lo:hi], prepend=np.int64(0))
                body = steps.astype("<i8").tobytes() + code[lo:hi].astype("<i4").tobytes()
                out.append((b.column("_run")[lo].as_py(), b.column("_lot")[lo].as_py(), b.column(GPOS)[lo].as_py(), hi - lo,
                            json.dumps(names), pa.compress(body, codec="zstd", asbytes=True), None))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types_)], list(fields))

    fields = {"_run": "string", "_lot": "long", "_at": "long", "_n": "long", "_keys": "string", "_rows": "binary", "_state": "string"}
    types_ = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t] for t in fields.values()]

    def follow(batches):
        run, lot, machine = None, None, MachineState()
        for b in batches:
            out = []
            for i in range(b.num_rows):
                r, l, _, n, keys, rows, text = (b.column(c)[i].as_py() for c in range(len(fields)))
                if r != run:
                    run, lot, machine = r, None, MachineState(text)
                if rows is None:  # the state that the run is entered with
                    continue
                if l != lot:
                    lot = l
                    out.append((run, lot, machine.text()))
                body = pa.decompress(rows, decompressed_size=12 * n, codec="zstd", asbytes=True)
                ts = np.cumsum(np.frombuffer(body, "<i8", n))
                code = np.frombuffer(body, "<i4", n, 8 * n).astype(np.int64)
                run_coded(ts, code, [tuple(k) for k in json.loads(keys)], machine, gap_d, gap_r, limit, status=False)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else ([],) * 3, (pa.string(), pa.int64(), pa.string()))],
                                             ["_run", "_lot", "_state"])

    near = lean.repartition("_run", "_lot").sortWithinPartitions("_run", "_lot", GPOS)
    packs = near.mapInArrow(pack, ", ".join(f"{c} {t}" for c, t in fields.items()))
    if state is not None:
        held = state.select("_run", F.lit(-1).cast("long").alias("_lot"), F.lit(-1).cast("long").alias("_at"), "_state")
        packs = packs.unionByName(held, allowMissingColumns=True)
    ordered = packs.repartition("_run").sortWithinPartitions("_run", "_lot", "_at")
    return ordered.mapInArrow(follow, "_run string, _lot long, _state string")


def _fold_slices(cut: DataFrame, state: DataFrame | None, params: AlertParams) -> tuple[DataFrame, DataFrame]:
    """Runs of rows ``(_run, _slice, _gpos, ...)`` through the machine, their slices
    side by side: (rows with ``status``, (_run, _state, _until) after each run).

    Slices that follow each other make a lot, so that the longest run has no
    more lots than there are shuffle partitions. The state before each lot
    comes from a pass over packed times and keys (:func:`_entry_states`); then
    all lots are folded side by side, each once: two passes, whatever the
    run's length and however long the machine remembers. Entry states leave
    out what can no longer matter to their lot.

    Only positions, times and dedup keys are folded; the rows' other columns
    meet their status once, at the end.
    """
    from tidewatch.functions.alert_machine import MachineState
    from tidewatch.operators.positions import GPOS, default_partitions
    from tidewatch.session import materialize

    gap_d, gap_r, _ = _gaps(params)
    at = ["_run", "_lot"]
    lean = cut.select("_run", "_slice", GPOS, TS_US, "feature", "anomaly_type")
    lean = materialize(lean.sortWithinPartitions(GPOS), "policy-lean")
    most = lean.agg(F.max("_slice")).first()[0] or 0
    together = most // default_partitions(cut) + 1
    lean = lean.withColumn("_lot", F.expr(f"_slice div {together}"))
    starts = lean.groupBy(*at).agg(F.min(TS_US).alias("_from"))
    later = Window.partitionBy("_run").orderBy("_lot").rowsBetween(0, Window.unboundedFollowing)
    lots = starts.withColumn("_from", F.min("_from").over(later))

    def forget(batches):
        """The states as they matter to their lots."""
        for pdf in batches:
            for i, (text, start) in enumerate(zip(pdf["_state"], pdf["_from"])):
                if start == start:  # a lot may have no time at all
                    pdf.loc[i, "_state"] = MachineState(text).forget(int(start), gap_d, gap_r).text()
            yield pdf[[*at, "_state"]]

    if most >= together:
        known = _entry_states(lean, state, params)
    else:  # one lot a run
        known = None if state is None else state.select("_run", F.lit(0).cast("long").alias("_lot"), "_state")
    if known is not None:
        met = known.join(lots, at).select(*at, "_state", "_from")
        met = materialize(met.mapInPandas(forget, met.drop("_from").schema), "policy-entries")
        known = met.select(_group_name(at).alias("_g"), "_state")
    done = policy_step(lean, known, at, [GPOS], params)
    every = materialize(done.select(*at, GPOS, "status", "_state", "_until"), "policy-fold")
    out = cut.join(every.select(GPOS, "status"), GPOS).select(*cut.columns, "status")
    tail = Window.partitionBy("_run").orderBy(F.desc("_lot"))
    ends = every.filter("_state is not null").withColumn("_n", F.row_number().over(tail))
    return out, ends.filter("_n = 1").select("_run", "_state", "_until")


def sliced_policy_step(
    rows: DataFrame,
    state: DataFrame | None,
    group_cols: Sequence[str],
    order_cols: Sequence[str],
    params: AlertParams = AlertParams(),
    fold_rows: int = 1 << 20,
) -> tuple[DataFrame, DataFrame]:
    """:func:`policy_step` over groups of any size: (rows with ``status``, the
    state ``(_g, _state, _until)`` after them of every group).

    A group is cut into slices of ``fold_rows`` rows in ``order_cols`` order;
    lots of slices are folded side by side (:func:`_fold_slices`).
    """
    from tidewatch.operators.positions import GPOS, PID, with_global_position
    from tidewatch.session import materialize

    named = rows.withColumn("_run", _group_name(group_cols))
    placed = materialize(with_global_position(named, ["_run", *order_cols]).drop(PID), "policy-rows")
    first = placed.groupBy("_run").agg(F.min(GPOS).alias("_first"))
    cut = placed.join(first, "_run").withColumn("_slice", F.expr(f"({GPOS} - _first) div {int(fold_rows)}")).drop("_first")
    held = None if state is None else state.select(F.col("_g").alias("_run"), "_state")
    out, last = _fold_slices(cut, held, params)
    new = last.select(F.col("_run").alias("_g"), "_state", "_until")
    if state is not None:
        new = new.unionByName(state.join(new.select("_g"), "_g", "left_anti").select("_g", "_state", "_until"))
    return out.drop(GPOS, "_run", "_slice"), new


def budget_cannot_bind(anomalies: DataFrame, scope_cols: Sequence[str], params: AlertParams) -> bool:
    """Whether no rate window can run out of budget: it is no longer than the
    dedup window, so each dedup key comes once at most, and no scope has more
    keys than the budget allows."""
    if params.rate_window_seconds > params.dedup_window_seconds:
        return False
    keys = anomalies.select(*scope_cols, "feature", "anomaly_type").distinct()
    most = keys.groupBy(*scope_cols).agg(F.count(F.lit(1)).alias("_n")).agg(F.max("_n")).first()[0]
    return (most or 0) <= params.max_alerts_per_minute


def coupled_alert_policy(
    anomalies: DataFrame,
    ts_col: str = "ts",
    order_cols: Sequence[str] = (),
    scope_cols: Sequence[str] = (),
    params: AlertParams = AlertParams(),
    fold_rows: int = 1 << 20,
) -> DataFrame:
    """Dedup and rate limit as one state machine, in event order: adds
    ``status`` = emitted / duplicate / rate_limited (see :func:`policy_step`).

    What the distributed operators settle by themselves never meets the
    machine:

    * where no rate window can run out (:func:`budget_cannot_bind`), dedup
      alone decides;
    * a silence of at least max(dedup window, rate window) resets all state,
      so a scope's stream splits into independent segments at such silences.
      Segments up to ``fold_rows`` rows are packed into groups and folded side
      by side;
    * over longer segments the uncoupled dedup and rate windows run first. A
      segment in which no window is exceeded is final as they leave it;
    * longer segments whose budget binds are cut into slices that are folded
      side by side and joined by their entry and exit states
      (:func:`_fold_slices`).

    ``order_cols`` must order rows of equal time.
    """
    from tidewatch.operators.chain import _session_ids, epoch_micros
    from tidewatch.operators.positions import GPOS, with_global_position
    from tidewatch.session import materialize

    scope = list(scope_cols)
    gap = max(_gaps(params)[:2])
    timed = materialize(anomalies.withColumn(TS_US, epoch_micros(anomalies, ts_col)), "policy-in")
    if budget_cannot_bind(timed, scope, params):
        done = dedup_alerts(timed.drop(TS_US), ts_col, order_cols, scope, params)
        return done.select(*anomalies.columns, "status")
    seg = materialize(_session_ids(with_global_position(timed, [*scope, TS_US, *order_cols]), scope, gap), "policy-segments")
    sizes = seg.groupBy("_sess").agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > fold_rows)
    long = materialize(sizes, "policy-long")  # at most rows / fold_rows entries
    if not long.limit(1).count():
        return _fold_packed(seg, scope, params, fold_rows).select(*anomalies.columns, "status")
    short = seg.join(long.select("_sess"), "_sess", "left_anti")
    out = _fold_packed(short, scope, params, fold_rows).select(*anomalies.columns, "status")
    rows = materialize(seg.join(long.select("_sess"), "_sess", "left_semi"), "policy-long-rows")
    free, bound = _speculate(rows, ts_col, order_cols, scope, params)
    out = out.unionByName(free.select(*anomalies.columns, "status"))
    if bound is None:
        return out
    cut = rows.join(bound, "_sess", "left_semi").withColumn("_slice", F.expr(f"({GPOS} - _sess) div {int(fold_rows)}"))
    done, _ = _fold_slices(cut.withColumn("_run", F.col("_sess").cast("string")), None, params)
    return out.unionByName(done.select(*anomalies.columns, "status"))


def _fold_packed(seg: DataFrame, scope: Sequence[str], params: AlertParams, fold_rows: int) -> DataFrame:
    """Whole segments, packed into groups of about ``fold_rows`` rows."""
    from tidewatch.operators.positions import GPOS

    packed = seg.withColumn("_pack", F.expr(f"_sess div {int(fold_rows)}"))
    return policy_step(packed, None, [*scope, "_pack"], [GPOS], params)


def _speculate(
    rows: DataFrame, ts_col: str, order_cols: Sequence[str], scope: Sequence[str], params: AlertParams
) -> tuple[DataFrame, DataFrame | None]:
    """Segments by the uncoupled rules: (rows with ``status`` of the segments
    whose budget holds, the ids of the others or None)."""
    from tidewatch.session import materialize

    plain = rows.drop(TS_US).withColumnRenamed("_sess", "_segment")  # chain windows have sessions of their own
    deduped = materialize(dedup_alerts(plain, ts_col, order_cols, ["_segment"], params).select(*plain.columns, "status"), "policy-dedup")
    wanted = deduped.filter("status = 'emitted'").drop("status")
    ranked = rate_limit(wanted, ts_col, order_cols, ["_segment"], params)
    over = materialize(ranked.filter("rate_limited").select("_segment").distinct(), "policy-over")
    if not over.limit(1).count():
        return deduped, None
    return deduped.join(over, "_segment", "left_anti"), over.withColumnRenamed("_segment", "_sess")
