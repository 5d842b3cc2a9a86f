"""Streaming = batch: the micro-batch detector with carried state gives the
same alerts as the batch job, however the input is split into files."""

import os

import pytest
from pyspark.sql import functions as F

from tidewatch.operators.alerts import alert_policy
from tidewatch.plans.detection import score_features, with_severity
from tidewatch.sources.tables import events_long
from tidewatch.streaming.micro_batch import DetectionStream

from conftest import SF01


def _batch_alerts(spark):
    long = events_long(spark, SF01)
    g = with_severity(score_features(long, ["ts", "event_id"]))
    kept = alert_policy(g, ts_col="ts", order_cols=["event_id"])
    return {(r.event_id, r.feature, r.severity) for r in kept.select("event_id", "feature", "severity").collect()}


@pytest.mark.parametrize("n_files", [3])
def test_stream_equals_batch(spark, tmpdir_fresh, n_files):
    long = events_long(spark, SF01)
    src = os.path.join(tmpdir_fresh, "in")
    # split by time into consecutive files, written in arrival order
    q = long.withColumn("_part", F.ntile(n_files).over(__import__("pyspark.sql", fromlist=["Window"]).Window.orderBy("ts", "event_id")))
    for i in range(1, n_files + 1):
        q.filter(F.col("_part") == i).drop("_part").coalesce(1).write.parquet(os.path.join(src, f"f{i:03d}"))
    paths = sorted(os.path.join(src, d) for d in os.listdir(src))
    flat = os.path.join(tmpdir_fresh, "flat")
    os.makedirs(flat)
    for i, d in enumerate(paths):
        part = [f for f in os.listdir(d) if f.endswith(".parquet")][0]
        os.link(os.path.join(d, part), os.path.join(flat, f"part-{i:03d}.parquet"))
    stream = spark.readStream.schema(long.schema).option("maxFilesPerTrigger", 1).parquet(flat)
    det = DetectionStream(spark, output_dir=os.path.join(tmpdir_fresh, "alerts"),
                          state_dir=os.path.join(tmpdir_fresh, "state"))
    query = det.start(stream, os.path.join(tmpdir_fresh, "ckpt"), trigger={"availableNow": True})
    query.awaitTermination(600)
    got = {(int(r.event_id), r.feature, r.severity) for r in det.alerts().select("event_id", "feature", "severity").collect()}
    assert got == _batch_alerts(spark)
    assert len(got) > 0


def test_dedup_stream_twin_equals_batch(spark, tmpdir_fresh):
    """applyInPandasWithState dedup over three files == batch chain dedup."""
    from pyspark.sql import Window

    from tidewatch.operators.alerts import dedup_alerts
    from tidewatch.sources.tables import read_table
    from tidewatch.streaming.stateful import dedup_stream

    ev = read_table(spark, SF01, "events").select(
        "event_id", "ts", F.col("event_type").alias("feature"), F.lit("event").alias("anomaly_type"))
    flat = os.path.join(tmpdir_fresh, "flat")
    part = ev.withColumn("_p", F.ntile(3).over(Window.orderBy("ts", "event_id")))
    for i in (1, 2, 3):
        d = os.path.join(tmpdir_fresh, f"p{i}")
        part.filter(F.col("_p") == i).drop("_p").coalesce(1).write.parquet(d)
        os.makedirs(flat, exist_ok=True)
        f = [x for x in os.listdir(d) if x.endswith(".parquet")][0]
        os.link(os.path.join(d, f), os.path.join(flat, f"part-{i:03d}.parquet"))
    stream = spark.readStream.schema(ev.schema).option("maxFilesPerTrigger", 1).parquet(flat)
    q = (dedup_stream(stream).writeStream.format("memory").queryName("dedup_twin").outputMode("append")
         .option("checkpointLocation", os.path.join(tmpdir_fresh, "ck")).trigger(availableNow=True).start())
    q.awaitTermination(600)
    got = {(r.event_id, r.status) for r in spark.sql("SELECT event_id, status FROM dedup_twin").collect()}
    want = {(r.event_id, r.status) for r in dedup_alerts(ev, order_cols=["event_id"]).select("event_id", "status").collect()}
    assert got == want
    assert sum(1 for _, s in got if s == "emitted") == 8167  # FIXTURES: chain dedup of all events at sf0.01


def test_stream_with_forest_equals_batch(spark, tmpdir_fresh):
    """Trades with the isolation forest: streaming (carried vectors, buffer,
    model) gives the same alerts as the batch pipeline."""
    from pyspark.sql import Window

    from tidewatch.params import ForestParams
    from tidewatch.plans.detection import trade_anomalies
    from tidewatch.sources.events import unpivot_features
    from tidewatch.sources.tables import TRADE_ORDER, lineitem_trades

    sf = "/root/testdata/sf0.001"
    fp = ForestParams(retrain_interval=1500, buffer_size=500, n_estimators=20)
    trades = lineitem_trades(spark, sf)
    ids = ["event_id", *TRADE_ORDER]
    long = unpivot_features(trades, ids, ["declared_value", "quantity", "weight_kg", "unit_price"])
    batch = trade_anomalies(long, trades, ["event_id"], list(TRADE_ORDER), forest=fp)
    kept = alert_policy(batch, ts_col="ts", order_cols=["l_orderkey", "l_linenumber", "l_partkey"])
    want = {(r.event_id, r.feature) for r in kept.collect()}
    assert any(f == "multi_feature" for _, f in want)

    flat = os.path.join(tmpdir_fresh, "flat")
    os.makedirs(flat)
    ranked = trades.select(*ids).withColumn("_p", F.ntile(3).over(Window.orderBy(*TRADE_ORDER)))
    lp = long.join(ranked, ids)
    for i in (1, 2, 3):
        d = os.path.join(tmpdir_fresh, f"p{i}")
        lp.filter(F.col("_p") == i).drop("_p").coalesce(1).write.parquet(d)
        f = [x for x in os.listdir(d) if x.endswith(".parquet")][0]
        os.link(os.path.join(d, f), os.path.join(flat, f"part-{i:03d}.parquet"))
    stream = spark.readStream.schema(long.schema).option("maxFilesPerTrigger", 1).parquet(flat)
    det = DetectionStream(spark, output_dir=os.path.join(tmpdir_fresh, "alerts"),
                          state_dir=os.path.join(tmpdir_fresh, "state"), order_cols=list(TRADE_ORDER), forest=fp)
    q = det.start(stream, os.path.join(tmpdir_fresh, "ckpt"), trigger={"availableNow": True})
    q.awaitTermination(900)
    got = {(r.event_id, r.feature) for r in det.alerts().collect()}
    assert got == want


def test_late_rows_routed_aside(spark, tmpdir_fresh):
    """With a lateness bound, rows far behind the event-time maximum of
    earlier batches are written to the late sink instead of being scored."""
    import datetime as dt

    base = dt.datetime(2024, 1, 1)
    b1 = spark.createDataFrame([(i, base + dt.timedelta(minutes=i), "value", float(i % 7)) for i in range(50)],
                               "event_id long, ts timestamp_ntz, feature string, value double")
    b2 = spark.createDataFrame([(100, base + dt.timedelta(minutes=5), "value", 1.0),
                                (101, base + dt.timedelta(minutes=60), "value", 2.0)],
                               "event_id long, ts timestamp_ntz, feature string, value double")
    out = os.path.join(tmpdir_fresh, "run", "alerts")
    det = DetectionStream(spark, output_dir=out, state_dir=os.path.join(tmpdir_fresh, "state"),
                          late_delay_seconds=600)
    det.process(b1, 0)
    det.process(b2, 1)
    late = spark.read.parquet(os.path.join(tmpdir_fresh, "run", "late"))
    assert [r.event_id for r in late.collect()] == [100]
    tail = spark.read.parquet(os.path.join(tmpdir_fresh, "state", "tail", "1"))
    assert 101 in {r.event_id for r in tail.collect()} and 100 not in {r.event_id for r in tail.collect()}


def test_rolling_stats_stream_twin_equals_batch(spark, tmpdir_fresh):
    """applyInPandasWithState count windows (state = last N-1 values) over
    three files give the batch window statistics."""
    import numpy as np
    from pyspark.sql import Window

    from tidewatch.operators.windows import rolling_stats
    from tidewatch.streaming.stateful import rolling_stats_stream

    long = events_long(spark, SF01)
    flat = os.path.join(tmpdir_fresh, "flat")
    os.makedirs(flat)
    part = long.withColumn("_p", F.ntile(3).over(Window.orderBy("ts", "event_id")))
    for i in (1, 2, 3):
        d = os.path.join(tmpdir_fresh, f"p{i}")
        part.filter(F.col("_p") == i).drop("_p").coalesce(1).write.parquet(d)
        f = [x for x in os.listdir(d) if x.endswith(".parquet")][0]
        os.link(os.path.join(d, f), os.path.join(flat, f"part-{i:03d}.parquet"))
    stream = spark.readStream.schema(long.schema).option("maxFilesPerTrigger", 1).parquet(flat)
    q = (rolling_stats_stream(stream, ["ts", "event_id"], window=1000).writeStream.format("memory")
         .queryName("win_twin").outputMode("append").option("checkpointLocation", os.path.join(tmpdir_fresh, "ck"))
         .trigger(availableNow=True).start())
    q.awaitTermination(600)
    cols = ["win_count", "win_mean", "win_std", "win_p25", "win_median", "win_p75", "zscore"]
    got = spark.sql("SELECT * FROM win_twin").toPandas().sort_values("event_id")
    want = rolling_stats(long, order_cols=["ts", "event_id"]).toPandas().sort_values("event_id")
    assert len(got) == len(want) == 10000
    np.testing.assert_allclose(got[cols].to_numpy(dtype=float), want[cols].to_numpy(dtype=float), rtol=1e-9, atol=1e-9)


def _rows(spark, rows):
    import datetime as dt

    base = dt.datetime(2024, 1, 1)
    return spark.createDataFrame([(i, base + dt.timedelta(seconds=s), "value", float(v)) for i, s, v in rows],
                                 "event_id long, ts timestamp_ntz, feature string, value double")


def _detector(spark, folder, **kw):
    from tidewatch.params import AlertParams, DetectorParams

    return DetectionStream(spark, output_dir=os.path.join(folder, "alerts"), state_dir=os.path.join(folder, "state"),
                           params=DetectorParams(min_samples=5), alert_params=kw.pop("alert_params", AlertParams()), **kw)


def test_late_alert_is_judged_by_carried_state(spark, tmpdir_fresh):
    base = [(i, i, i % 3) for i in range(40)]
    _detector(spark, tmpdir_fresh).process(_rows(spark, [*base, (100, 1000, 500)]), 0)
    # a new object goes on from the stored state, as after a restart
    det = _detector(spark, tmpdir_fresh)
    det.process(_rows(spark, [(101, 900, 600), (102, 1301, 5000)]), 1)
    assert sorted(int(r.event_id) for r in det.alerts().collect()) == [100, 102]


def test_limited_alerts_leave_no_dedup_state(spark, tmpdir_fresh):
    from tidewatch.params import AlertParams

    p = AlertParams(max_alerts_per_minute=1)
    rows = [(i, i, i % 3) for i in range(40)]
    both = _rows(spark, [*rows, (100, 1000, 500)]).unionByName(
        _rows(spark, [(200 + i, i, i % 3) for i in range(40)] + [(300, 1001, 500)]).withColumn("feature", F.lit("other")))
    sent = []
    det = _detector(spark, tmpdir_fresh, alert_params=p, sink=lambda msgs, batch: sent.extend(r.key for r in msgs.collect()))
    det.process(both, 0)
    det.process(_rows(spark, [(301, 1070, 9000)]).withColumn("feature", F.lit("other")), 1)
    assert sorted(int(r.event_id) for r in det.alerts().collect()) == [100, 301]
    assert len(sent) == 2


def test_missing_state_stops_the_query(spark, tmpdir_fresh):
    from pyspark.errors import AnalysisException

    with pytest.raises(AnalysisException):
        _detector(spark, tmpdir_fresh).process(_rows(spark, [(1, 1, 1)]), 5)
    with pytest.raises(TypeError):
        DetectionStream(spark, output_dir=tmpdir_fresh)


def test_raw_messages_to_long_rows(spark, tmpdir_fresh):
    from tidewatch.streaming.micro_batch import raw_message_stream

    src = os.path.join(tmpdir_fresh, "in")
    lines = ['{"event_id": "a", "timestamp": "2025-01-01T00:00:00Z", "declared_value": 10, "quantity": 4}', '{"broken": ']
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(src)
    stream = spark.readStream.format("text").load(src)
    long, letters = raw_message_stream(stream, os.path.join(tmpdir_fresh, "dead"), os.path.join(tmpdir_fresh, "ck1"),
                                       ["declared_value", "quantity", "unit_price"], trigger={"availableNow": True})
    q = (long.writeStream.format("memory").queryName("raw_long").option("checkpointLocation", os.path.join(tmpdir_fresh, "ck2"))
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    letters.awaitTermination(300)
    assert {(r.feature, r.value) for r in spark.table("raw_long").collect()} == {("declared_value", 10.0), ("quantity", 4.0), ("unit_price", 2.5)}
    assert [r.reason for r in spark.read.parquet(os.path.join(tmpdir_fresh, "dead")).collect()] == ["malformed"]


def test_bad_messages_after_the_start_are_kept(spark, tmpdir_fresh):
    import time

    from tidewatch.streaming.micro_batch import raw_message_stream

    src, dead = os.path.join(tmpdir_fresh, "in"), os.path.join(tmpdir_fresh, "dead")
    put = lambda *lines: spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(src)
    put('{"broken": 1')
    stream = spark.readStream.format("text").load(src)
    _, letters = raw_message_stream(stream, dead, os.path.join(tmpdir_fresh, "ck1"), ["declared_value"])
    try:
        letters.processAllAvailable()
        put('{"broken": 2')
        until = time.time() + 60
        raws = []
        while len(raws) < 2 and letters.isActive and time.time() < until:
            letters.processAllAvailable()
            raws = [r._raw for r in spark.read.parquet(dead).collect()]
        assert letters.isActive and sorted(raws) == ['{"broken": 1', '{"broken": 2']
    finally:
        letters.stop()


def test_alert_machine_is_folded_in_slices(spark, tmpdir_fresh, monkeypatch):
    """No task gets more than ``fold_rows`` anomalies; results are those of one fold."""
    from tidewatch.operators import alerts
    from tidewatch.params import AlertParams

    sizes = []
    step = alerts.policy_step

    def counted(rows, state, group_cols, *more):
        sizes.append(max([r["count"] for r in rows.groupBy(*group_cols).count().collect()], default=0))
        return step(rows, state, group_cols, *more)

    monkeypatch.setattr(alerts, "policy_step", counted)
    base = [(i, i, i % 3) for i in range(40)]
    bursts = [(100 + i, 1000 + 25 * i, 500 * 4**i) for i in range(12)]
    got = {}
    for rows in (3, 1 << 20):
        folder = os.path.join(tmpdir_fresh, str(rows))
        det = _detector(spark, folder, alert_params=AlertParams(max_alerts_per_minute=1, dedup_window_seconds=30), fold_rows=rows)
        sizes.clear()
        det.process(_rows(spark, base + bursts[:9]), 0)
        det.process(_rows(spark, bursts[9:]), 1)
        assert max(sizes) <= rows and (rows > 3 or len(sizes) > 1)
        got[rows] = sorted(int(r.event_id) for r in det.alerts().collect())
    assert got[3] == got[1 << 20] and len(got[3]) > 2


def _late_detector(spark, folder, **kw):
    return _detector(spark, folder, late_delay_seconds=600, late_dir=os.path.join(folder, "late"), **kw)


@pytest.mark.parametrize("reorder", [False, True])
def test_no_row_is_lost_after_an_empty_batch(spark, tmpdir_fresh, reorder):
    """An empty first batch sets no bound; rows without a time are kept."""
    det = _late_detector(spark, tmpdir_fresh, reorder=reorder)
    rows = [(i, i, i % 3) for i in range(200)]
    det.process(_rows(spark, rows).limit(0), 0)
    det.process(_rows(spark, rows), 1)
    no_time = _rows(spark, [(900, 0, 1), (901, 0, 2)]).withColumn("ts", F.lit(None).cast("timestamp_ntz"))
    det.process(_rows(spark, [(200 + i, 200 + i, i % 3) for i in range(199)] + [(500, 500, 500)]).unionByName(no_time), 2)
    det.drain(3)
    last = 3 if reorder else 2
    tail = spark.read.parquet(os.path.join(tmpdir_fresh, "state", "tail", str(last))).collect()
    assert sorted(r.event_id for r in tail) == sorted([*range(399), 500, 900, 901])
    assert [int(r.event_id) for r in det.alerts().collect()] == [500]
    late = [os.path.join(d, f) for d, _, fs in os.walk(os.path.join(tmpdir_fresh, "late")) for f in fs if f.endswith(".parquet")]
    assert not late or spark.read.parquet(os.path.join(tmpdir_fresh, "late")).count() == 0


def test_only_bad_messages_first(spark, tmpdir_fresh):
    """A first file of bad messages alone gives an empty batch, and then all
    later rows are scored."""
    import json

    from tidewatch.streaming.micro_batch import raw_message_stream

    src = os.path.join(tmpdir_fresh, "in")
    put = lambda lines: spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.mode("append").text(src)
    ck = lambda n: os.path.join(tmpdir_fresh, n)

    def run(det):
        stream = spark.readStream.format("text").load(src)
        long, letters = raw_message_stream(stream, ck("dead"), ck("ck1"), ["declared_value"], trigger={"availableNow": True})
        q = det.start(long, ck("ck2"), trigger={"availableNow": True})
        assert q.awaitTermination(300) and letters.awaitTermination(300)

    put(['{"broken', '{"declared_value": "x", "event_id": "b"}'])
    run(_late_detector(spark, tmpdir_fresh))
    put([json.dumps({"event_id": f"e{i:03d}", "timestamp": f"2025-01-01T00:{i // 60:02d}:{i % 60:02d}Z",
                     "declared_value": 900 if i == 150 else i % 3}) for i in range(200)])
    det = _late_detector(spark, tmpdir_fresh)  # new objects go on from checkpoint and state
    run(det)
    assert [r.event_id for r in det.alerts().collect()] == ["e150"]
    assert spark.read.parquet(ck("dead")).count() == 2


def test_shuffled_arrivals_within_the_delay_give_the_batch_result(spark, tmpdir_fresh):
    """The reorder buffer: whatever the order of arrival, alerts and their
    evidence are those of the batch job; later rows go to the late folder."""
    import numpy as np

    from tidewatch.params import AlertParams, DetectorParams
    from tidewatch.plans.detection import build_alerts

    rng = np.random.default_rng(7)
    n = 1500
    rows = [(i, 2 * i + i % 2, float(rng.normal()) + (40 if i % 97 == 96 else 0)) for i in range(n)]
    params, alert = DetectorParams(min_samples=5, window_size=200), AlertParams(dedup_window_seconds=60)
    all_rows = _rows(spark, rows)
    g = with_severity(score_features(all_rows, ["ts", "event_id"], params), alert, params)
    batch = build_alerts(alert_policy(g, order_cols=["event_id"], params=alert))
    seen = lambda df: sorted((r.event_id, r.severity, round(r.details.zscore, 9), r.details.window_count, r.details.zscore_threshold)
                             for r in df.collect())
    arrival = sorted(range(n), key=lambda i: rows[i][1] + rng.uniform(0, 590))
    cuts = [0, 40, 40, 900, n]
    at = lambda name: os.path.join(tmpdir_fresh, name)

    def detector():
        return DetectionStream(spark, output_dir=at("alerts"), state_dir=at("state"), params=params, alert_params=alert,
                               late_delay_seconds=600, late_dir=at("late"), reorder=True)

    det = detector()
    for b, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
        det.process(_rows(spark, [rows[i] for i in arrival[lo:hi]] or rows[:1]).limit(hi - lo), b)
    assert len(seen(det.alerts())) < len(seen(batch))  # the last rows still wait
    det.drain(len(cuts) - 1)
    assert seen(det.alerts()) == seen(batch) and len(seen(batch)) > 10
    # the stream goes on after all: the drained output is replaced
    det = detector()
    det.process(_rows(spark, [(5000, 2 * n, 0.0), (5001, 10, 99.0)]), len(cuts) - 1)
    det.drain(len(cuts))
    assert seen(det.alerts()) == seen(batch)
    assert [r.event_id for r in spark.read.parquet(at("late")).collect()] == [5001]


def test_state_of_silent_scopes_is_dropped(spark, tmpdir_fresh):
    """With a bound on lateness the alert machine keeps only scopes that can
    still matter."""
    from tidewatch.params import AlertParams

    def batch(scope, start):
        rows = [(i, start + i, 900 if i == 30 else i % 3) for i in range(31)]
        return _rows(spark, rows).withColumn("scope", F.lit(scope))

    det = _late_detector(spark, tmpdir_fresh, scope_cols=["scope"], alert_params=AlertParams())
    sizes = []
    for b in range(4):
        det.process(batch(f"s{b}a", 700 * b).unionByName(batch(f"s{b}b", 700 * b)), b)
        sizes.append(spark.read.parquet(os.path.join(tmpdir_fresh, "state", "policy", str(b))).count())
    assert det.alerts().count() == 8
    assert sizes[0] == 2 and max(sizes) <= 4


def test_restart_with_new_objects(spark, tmpdir_fresh):
    """Offsets live in the checkpoint, windows and alert state in the state
    folder: a new query object reads only new files and goes on exactly."""
    from pyspark.sql import Window

    long = events_long(spark, SF01)
    part = long.withColumn("_p", F.ntile(3).over(Window.orderBy("ts", "event_id")))
    flat = os.path.join(tmpdir_fresh, "flat")
    os.makedirs(flat)

    def put(i):
        d = os.path.join(tmpdir_fresh, f"p{i}")
        part.filter(F.col("_p") == i).drop("_p").coalesce(1).write.parquet(d)
        os.link(os.path.join(d, [x for x in os.listdir(d) if x.endswith(".parquet")][0]), os.path.join(flat, f"part-{i}.parquet"))

    batches = []
    for files in ((1, 2), (3,)):
        for i in files:
            put(i)
        det = DetectionStream(spark, output_dir=os.path.join(tmpdir_fresh, "alerts"), state_dir=os.path.join(tmpdir_fresh, "state"),
                              sink=lambda msgs, batch: batches.append((batch, msgs.count())))
        stream = spark.readStream.schema(long.schema).option("maxFilesPerTrigger", 1).parquet(flat)
        q = det.start(stream, os.path.join(tmpdir_fresh, "ckpt"), trigger={"availableNow": True})
        assert q.awaitTermination(600)
    assert [b for b, _ in batches] == [0, 1, 2]
    got = {(int(r.event_id), r.feature, r.severity) for r in det.alerts().collect()}
    assert got == _batch_alerts(spark)


def _totals(det, batch):
    return {(r.metric, r.label): r.value for r in det.metrics.totals(batch).collect() if r.value}


def test_live_metrics_equal_counts_of_the_results(spark, tmpdir_fresh):
    """Observed totals over several batches (one of them run twice) equal the
    counts a batch job makes, with a budget that binds."""
    from collections import Counter

    from tidewatch.operators.alerts import coupled_alert_policy
    from tidewatch.params import AlertParams, DetectorParams

    alert = AlertParams(max_alerts_per_minute=1, rate_window_seconds=90, dedup_window_seconds=30)
    rows = [(i, i, 100 * (i % 50) + 300 if i % 7 == 6 and i > 40 else i % 3) for i in range(400)]
    det = _detector(spark, tmpdir_fresh, alert_params=alert)
    for b, (lo, hi) in enumerate(((0, 150), (150, 150), (150, 400))):
        for _ in range(2 if b == 2 else 1):
            det.process(_rows(spark, rows[lo:hi] or rows[:1]).limit(hi - lo), b)
    g = with_severity(score_features(_rows(spark, rows), ["ts", "event_id"], DetectorParams(min_samples=5)), alert)
    done = coupled_alert_policy(g, order_cols=["event_id"], params=alert).collect()
    want = Counter(("anomalies", f"{r.severity}/{r.anomaly_type}") for r in done)
    want += Counter(("alerts", r.severity) for r in done if r.status == "emitted")
    want["alerts_deduplicated", ""] = sum(r.status == "duplicate" for r in done)
    want["alerts_rate_limited", ""] = sum(r.status == "rate_limited" for r in done)
    assert _totals(det, 2) == {k: v for k, v in want.items() if v} and want["alerts_rate_limited", ""] > 0


def test_messages_in_one_query(spark, tmpdir_fresh):
    """Raw messages from the message log to alerts in one query: dead letters,
    counts, vectors of events without a feature, alerts written once."""
    import json

    from tidewatch.params import DetectorParams, ForestParams
    from tidewatch.sources.message_log import FORMAT, MessageLog, append_once

    spark.dataSource.register(MessageLog)
    topic, out = os.path.join(tmpdir_fresh, "topic"), os.path.join(tmpdir_fresh, "out")

    def event(i):
        if i % 50 == 20:
            return '{"broken'
        body = {"event_id": f"e{i:04d}", "timestamp": f"2025-01-01T{i // 3600:02d}:{i // 60 % 60:02d}:{i % 60:02d}Z"}
        if i % 50 == 30:
            return json.dumps(body)  # none of the features
        return json.dumps(body | {"declared_value": 9000 + i if i % 100 == 77 else i % 7, "quantity": 1 + i % 3})

    def put(lo, hi):
        rows = [(str(i), event(i)) for i in range(lo, hi)]
        append_once(spark.createDataFrame(rows, "key string, value string").repartition(3), topic, f"put-{lo}")

    def run():
        det = DetectionStream(
            spark, output_dir=os.path.join(tmpdir_fresh, "alerts"), state_dir=os.path.join(tmpdir_fresh, "state"),
            params=DetectorParams(min_samples=5, window_size=100, features=("declared_value", "quantity")),
            forest=ForestParams(retrain_interval=100, buffer_size=100, n_estimators=10),
            sink=lambda msgs, batch: append_once(msgs, out, f"alerts-{batch}"))
        q = det.start_messages(spark.readStream.format(FORMAT).load(topic), os.path.join(tmpdir_fresh, "ck"),
                               os.path.join(tmpdir_fresh, "dead"), trigger={"availableNow": True})
        assert q.awaitTermination(600)
        return det

    put(0, 150)
    put(0, 150)  # a producer that tries again adds nothing
    run()
    put(150, 400)
    det = run()  # new objects go on
    assert spark.read.parquet(os.path.join(tmpdir_fresh, "dead")).count() == 8
    last = max(int(d) for d in os.listdir(os.path.join(tmpdir_fresh, "state", "forest_n")))
    assert spark.read.parquet(os.path.join(tmpdir_fresh, "state", "forest_n", str(last))).first().n == 400 - 8 - 1  # all but the unready first
    seen = _totals(det, last)
    assert seen["events_consumed", ""] == 400 and seen["events_processed", ""] == 392 and seen["processing_errors", "malformed"] == 8
    alerts = det.alerts().collect()
    messages = spark.read.format(FORMAT).load(out).collect()
    assert sorted(m.key for m in messages) == sorted(a.alert_id for a in alerts)
    assert sum(v for (m, _), v in seen.items() if m == "alerts") == len(alerts) >= 3
    evidence = [json.loads(m.value)["details"] for m in messages]
    assert any(e.get("detector") == "isolation_forest" and e["raw_score"] < 0 for e in evidence)
    assert any(e.get("zscore_threshold") == 3.0 for e in evidence)
