"""Severity, dedup, rate limit, alert ids (boundaries from the reference code)."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewatch.functions.alerting import alert_id, severity
from tidewatch.operators.alerts import dedup_alerts, rate_limit
from tidewatch.params import AlertParams

T0 = dt.datetime(2024, 1, 1)


def _ts(sec):
    return T0 + dt.timedelta(microseconds=round(sec * 1e6))


@pytest.mark.parametrize("score,level", [(1.99, "LOW"), (2.0, "LOW"), (3.0, "MEDIUM"), (3.99, "MEDIUM"),
                                         (4.0, "HIGH"), (5.0, "CRITICAL"), (0.0, "LOW")])
def test_severity_boundaries(spark, score, level):
    r = spark.createDataFrame([(float(score),)], "score double").select(severity("score").alias("s")).first()
    assert r.s == level


def _anoms(spark, secs, feature="f", typ="zscore"):
    rows = [(i, _ts(s), feature, typ) for i, s in enumerate(secs)]
    return spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, feature string, anomaly_type string")


def _status(spark, secs, **kw):
    d = dedup_alerts(_anoms(spark, secs), order_cols=["event_id"], **kw)
    return [r.status for r in d.orderBy("event_id").collect()]


def test_dedup_window_edges(spark):
    assert _status(spark, [0, 299.999, 300]) == ["emitted", "duplicate", "emitted"]


def test_suppressed_rows_do_not_extend_window(spark):
    # burst every 100 s: opens at 0, 300, 600 only
    assert _status(spark, [0, 100, 200, 300, 400, 500, 600]) == [
        "emitted", "duplicate", "duplicate", "emitted", "duplicate", "duplicate", "emitted"]


def test_equal_timestamps(spark):
    assert _status(spark, [5, 5, 5]) == ["emitted", "duplicate", "duplicate"]


def test_keys_independent(spark):
    a = _anoms(spark, [0, 10]).unionByName(
        _anoms(spark, [1, 11], feature="g").withColumn("event_id", F.col("event_id") + 10))
    d = dedup_alerts(a, order_cols=["event_id"]).orderBy("event_id").collect()
    assert [r.status for r in d] == ["emitted", "duplicate", "emitted", "duplicate"]


def test_rate_limit_budget_and_restart(spark):
    p = AlertParams(max_alerts_per_minute=100)
    secs = [i * 0.1 for i in range(101)]  # 101 alerts in 10 s
    r = rate_limit(_anoms(spark, secs), order_cols=["event_id"], params=p).orderBy("event_id").collect()
    assert sum(x.rate_limited for x in r) == 1 and r[-1].rate_limited
    secs = [0.0, 59.999, 60.0]
    r = rate_limit(_anoms(spark, secs), order_cols=["event_id"], params=AlertParams(max_alerts_per_minute=1)).orderBy("event_id").collect()
    assert [x.rate_limited for x in r] == [False, True, False]


def test_alert_id_deterministic(spark):
    df = spark.createDataFrame([("txn-001", "declared_value", T0)], "event_id string, feature string, ts timestamp_ntz")
    a = df.select(alert_id("event_id", "feature", "ts").alias("a")).first().a
    import hashlib
    micros = int((T0 - dt.datetime(1970, 1, 1)).total_seconds() * 1_000_000)
    assert a == hashlib.sha256(f"txn-001:declared_value:{micros}".encode()).hexdigest()[:16]


def test_chain_paths_agree_with_sequential_fold(spark):
    """Per-key window path, positions path, and pointer doubling (forced by a
    tiny fold bound) all equal a plain sequential fold."""
    import numpy as np
    from tidewatch.operators.chain import chain_windows

    rng = np.random.default_rng(11)
    rows, t = [], {}
    for i in range(300):
        k = ["a", "a", "a", "b", "c"][int(rng.integers(0, 5))]
        t[k] = t.get(k, 0.0) + float(rng.exponential(20 if k == "a" else 90))
        rows.append((i, k, _ts(round(t[k], 3))))
    df = spark.createDataFrame(rows, "event_id long, feature string, ts timestamp_ntz")
    want, last = {}, {}
    for r in sorted(rows, key=lambda r: (r[1], r[2], r[0])):
        op = last.get(r[1])
        if op is None or (r[2] - op[0]).total_seconds() >= 60:
            last[r[1]] = op = (r[2], 0)
        last[r[1]] = (op[0], op[1] + 1)
        want[r[0]] = (op[1] == 0, op[0], op[1] + 1)
    for kw in ({}, {"force_positions": True}, {"force_positions": True, "fold_rows": 5}):
        got = {r.event_id: (r.opens, r.window_start, r.rank)
               for r in chain_windows(df, ["feature"], "ts", 60, ["event_id"], **kw).collect()}
        assert got == want, kw


def _machine(rows, gap_d, gap_r, limit):
    """Step-by-step reference machine (dedup, then rate check; limited alerts
    are not recorded for dedup)."""
    last, w, c, out = {}, None, 0, {}
    for i, t, k in sorted(rows, key=lambda r: (r[1], r[0])):
        s = (t - T0).total_seconds()
        if k in last and s - last[k] < gap_d:
            out[i] = "duplicate"
            continue
        if w is None or s - w >= gap_r:
            w, c = s, 0
        if c < limit:
            c += 1
            last[k] = s
            out[i] = "emitted"
        else:
            out[i] = "rate_limited"
    return out


def test_coupled_policy_matches_machine(spark):
    import numpy as np
    from tidewatch.operators.alerts import coupled_alert_policy

    rng = np.random.default_rng(4)
    rows, t = [], 0.0
    for i in range(400):
        t += float(rng.exponential(2.0)) if i % 100 < 80 else 400.0  # bursts, then silences
        rows.append((i, _ts(round(t, 3)), ["f", "g", "h", "k"][int(rng.integers(0, 4))]))
    df = spark.createDataFrame([(i, ts, k, "zscore") for i, ts, k in rows],
                               "event_id long, ts timestamp_ntz, feature string, anomaly_type string")
    p = AlertParams(max_alerts_per_minute=3, dedup_window_seconds=30.0)
    want = _machine([(i, ts, (k, "zscore")) for i, ts, k in rows], 30.0, 60.0, 3)
    for kw in ({}, {"fold_rows": 10}):  # slices with carried state
        got = {r.event_id: r.status for r in coupled_alert_policy(df, order_cols=["event_id"], params=p, **kw).collect()}
        assert got == want, kw
    assert "rate_limited" in want.values()


def test_alert_policy_when_the_budget_binds(spark):
    from tidewatch.operators.alerts import alert_policy

    rows = [(0, _ts(0), "f", "a"), (1, _ts(1), "f", "b"), (2, _ts(70), "f", "b")]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz, feature string, anomaly_type string")
    kept = alert_policy(df, order_cols=["event_id"], params=AlertParams(max_alerts_per_minute=1))
    assert sorted(r.event_id for r in kept.collect()) == [0, 2]
    assert kept.columns == df.columns


def test_machine_jumps_equal_step_by_step():
    """The jumping machine against the row loop: random keys, ties, budgets,
    carried state, and rows out of time order."""
    import copy

    import numpy as np
    from tidewatch.functions.alert_machine import MachineState, _by_row, run_machine

    rng = np.random.default_rng(2)
    for case in range(300):
        n, gap_d, gap_r, limit = int(rng.integers(0, 60)), int(rng.integers(0, 30)), int(rng.integers(0, 30)), int(rng.integers(0, 4))
        ts = np.cumsum(rng.integers(0, int(rng.integers(1, 12)) + 1, n)).astype(np.int64)
        if case % 5 == 0:
            rng.shuffle(ts)
        keys = [("f", str(k)) for k in rng.integers(0, int(rng.integers(1, 5)), n)]
        state = MachineState()
        _by_row(np.sort(rng.integers(-40, 0, 6)), [("f", "0"), ("f", "1"), ("g", None)] * 2, state, gap_d, gap_r, limit)
        other = copy.deepcopy(state)
        got = run_machine(ts, keys, state, gap_d, gap_r, limit)
        want = _by_row(ts, keys, other, gap_d, gap_r, limit)
        assert got.tolist() == want.tolist() and state.text() == other.text(), case


def _stream_without_silence(spark, n=3000, mean=20.0, seed=5):
    import numpy as np

    rng = np.random.default_rng(seed)
    t = np.round(np.cumsum(rng.exponential(mean, n)), 3)
    rows = [(i, _ts(float(x)), ["f", "g", "h"][int(rng.integers(0, 3))]) for i, x in enumerate(t)]
    df = spark.createDataFrame([(i, ts, k, "zscore") for i, ts, k in rows],
                               "event_id long, ts timestamp_ntz, feature string, anomaly_type string")
    return rows, df


def test_slices_are_joined_by_their_states(spark, monkeypatch):
    """An unbroken stream under a binding budget: all slices are folded in one
    job, then only those whose entry state was another; far fewer jobs than slices."""
    from tidewatch.operators import alerts

    rows, df = _stream_without_silence(spark)
    p = AlertParams(max_alerts_per_minute=2, rate_window_seconds=300.0, dedup_window_seconds=120.0)
    want = _machine([(i, ts, (k, "zscore")) for i, ts, k in rows], 120.0, 300.0, 2)
    jobs, step = [], alerts.policy_step

    def counted(rows, *more):
        jobs.append(rows.select("_slice").distinct().count() if "_slice" in rows.columns else 0)
        return step(rows, *more)

    monkeypatch.setattr(alerts, "policy_step", counted)
    got = {r.event_id: r.status for r in alerts.coupled_alert_policy(df, order_cols=["event_id"], params=p, fold_rows=500).collect()}
    assert got == want and "rate_limited" in want.values()
    sliced = [j for j in jobs if j]
    assert sliced[0] == 6 and len(sliced) < 6 and sum(sliced) < 18, jobs


def test_budgets_that_hold_never_meet_the_machine(spark, monkeypatch):
    """Defaults cannot bind with few keys; a long segment whose windows are not
    exceeded is final as the distributed operators leave it."""
    from tidewatch.operators import alerts

    rows, df = _stream_without_silence(spark, n=900, mean=3.0)
    step = alerts.policy_step

    def small_only(rows, *more):
        assert rows.count() == 0
        return step(rows, *more)

    monkeypatch.setattr(alerts, "policy_step", small_only)
    for gap, limit in ((300.0, 100), (30.0, 12)):
        p = AlertParams(max_alerts_per_minute=limit, dedup_window_seconds=gap)
        want = _machine([(i, ts, (k, "zscore")) for i, ts, k in rows], gap, 60.0, limit)
        assert alerts.budget_cannot_bind(df, [], p) == (gap == 300.0)
        got = {r.event_id: r.status for r in alerts.coupled_alert_policy(df, order_cols=["event_id"], params=p, fold_rows=100).collect()}
        assert got == want and "rate_limited" not in want.values()


def test_rounds_do_not_grow_with_the_slices(spark, monkeypatch):
    """A dense stream that never forgets, in 100 slices: no more jobs than the
    shuffle partitions allow, and no lot is folded more than a few times."""
    from tidewatch.operators import alerts

    rows, df = _stream_without_silence(spark, n=600, mean=3.0)
    p = AlertParams(max_alerts_per_minute=2, rate_window_seconds=300.0, dedup_window_seconds=120.0)
    want = _machine([(i, ts, (k, "zscore")) for i, ts, k in rows], 120.0, 300.0, 2)
    jobs, step = [], alerts.policy_step

    def counted(rows, *more):
        jobs.append(rows.count() if "_slice" in rows.columns else 0)
        return step(rows, *more)

    monkeypatch.setattr(alerts, "policy_step", counted)
    got = {r.event_id: r.status for r in alerts.coupled_alert_policy(df, order_cols=["event_id"], params=p, fold_rows=6).collect()}
    assert got == want
    lots = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sliced = [j for j in jobs if j]
    assert len(sliced) <= lots + 1 and sum(sliced) <= (alerts.GUESSES + 1) * len(rows), jobs


def test_a_task_reads_its_groups_through(spark):
    """Groups of any size, in batches of a few rows, with and without carried state."""
    from tidewatch.operators.alerts import policy_step
    from pyspark.sql import functions as F

    rows, df = _stream_without_silence(spark, n=200, mean=5.0)
    timed = df.withColumn("_ts_us", F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), "ts"))
    p = AlertParams(max_alerts_per_minute=2, rate_window_seconds=90.0, dedup_window_seconds=30.0)
    timed = timed.withColumn("scope", (F.col("event_id") % 100 >= 40).cast("int"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        first = policy_step(timed.filter("event_id < 100"), None, ["scope"], ["event_id"], p).collect()
        state = spark.createDataFrame([(r._g, r._state) for r in first if r._state], "_g string, _state string")
        then = policy_step(timed.filter("event_id >= 100"), state, ["scope"], ["event_id"], p).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert state.count() == 2 and sum(r._state is not None for r in then) == 2 and len(first) == len(then) == 100
    want = {}
    for scope in (0, 1):
        want |= _machine([(i, ts, (k, "zscore")) for i, ts, k in rows if (i % 100 >= 40) == scope], 30.0, 90.0, 2)
    assert {r.event_id: r.status for r in [*first, *then]} == want


def test_long_sessions_take_a_fixed_number_of_passes(spark, monkeypatch):
    """A session of many slices, equal times and slices without an opening
    among them, equals a sequential fold and writes no table per doubling."""
    import numpy as np
    from tidewatch.operators import chain

    rng = np.random.default_rng(5)
    written, write = [], chain.materialize
    monkeypatch.setattr(chain, "materialize", lambda df, label="table": (written.append(label), write(df, label))[1])
    t = np.cumsum(rng.integers(0, 25, 700)) * 1.0
    t[300:340] = t[300]  # more rows at one time than a slice holds
    rows = [(i, _ts(float(x))) for i, x in enumerate(t)]
    df = spark.createDataFrame(rows, "event_id long, ts timestamp_ntz")
    want, first = {}, 0
    for i, x in enumerate(t):
        first = i if x - t[first] >= 60 else first
        want[i] = (i == first, rows[first][1], i - first + 1)
    for size in (7, 64):
        written.clear()
        out = chain.chain_windows(df, [], "ts", 60, ["event_id"], fold_rows=5, group_rows=size, force_positions=True)
        assert {r.event_id: (r.opens, r.window_start, r.rank) for r in out.collect()} == want
        assert len(written) <= 4, written


def test_entry_states_come_from_one_pass(spark, monkeypatch):
    """A stream that never forgets, in more lots than a few rounds settle, with
    missing keys and a carried state: every row is folded once, in one job."""
    from pyspark.sql import functions as F
    from tidewatch.operators import alerts

    rows, df = _stream_without_silence(spark, n=500, mean=3.0)
    df = df.withColumn("feature", F.when(F.col("feature") != "h", F.col("feature")))
    p = AlertParams(max_alerts_per_minute=2, rate_window_seconds=300.0, dedup_window_seconds=120.0)
    want = _machine([(i, ts, (None if k == "h" else k, "zscore")) for i, ts, k in rows], 120.0, 300.0, 2)
    folded, step = [], alerts.policy_step

    def counted(rows, *more):
        folded.append(rows.count() if "_slice" in rows.columns else 0)
        return step(rows, *more)

    monkeypatch.setattr(alerts, "policy_step", counted)
    got = {r.event_id: r.status for r in alerts.coupled_alert_policy(df, order_cols=["event_id"], params=p, fold_rows=20).collect()}
    assert got == want and [n for n in folded if n] == [500]
    # the same stream in two parts, the state of the first carried into the second
    timed = df.withColumn("_ts_us", F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), "ts"))
    first, state = alerts.sliced_policy_step(timed.filter("event_id < 130"), None, [], ["event_id"], p, fold_rows=20)
    then, state = alerts.sliced_policy_step(timed.filter("event_id >= 130"), state, [], ["event_id"], p, fold_rows=20)
    assert {r.event_id: r.status for r in [*first.collect(), *then.collect()]} == want and state.count() == 1
