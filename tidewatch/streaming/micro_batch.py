"""Streaming detection with ``foreachBatch`` and carried state.

Structured Streaming rejects ROWS frames and stacked
``applyInPandasWithState`` operators, so the detector runs the *batch*
operators on each micro-batch plus a small carried state, written under a
state folder on shared storage:

* ``tail``    -- the last N-1 values of every window key (exact windows for
  the next batch's rows);
* ``policy``  -- the alert machine's state by scope: the event time of each
  dedup key's last emitted alert, the open rate window and its count. With
  ``late_delay_seconds`` a scope whose state can no longer matter is dropped;
* ``maxts``   -- the largest event time seen (with ``late_delay_seconds``);
* ``waiting`` -- rows not yet released (with ``reorder``);
* ``metrics`` -- running totals (:mod:`tidewatch.streaming.live_metrics`);
* ``lastz``, ``forest_n``, ``forest_buf``, ``forest_nodes`` -- the last z-score
  of each feature, the number of vectors, the last ``buffer_size`` of them and
  the latest model (with ``forest``).

Batch ``id`` reads the state of ``id - 1`` and writes its own, and alerts go
to ``alerts/batch_id=<id>`` with overwrite: a replayed batch reads the same
state and rewrites the same files, so results are idempotent. State older than the batch before
is dropped; ``state_dir`` must outlive the application, so that a restarted
query goes on from it. Within a batch
rows are ordered by event time; across batches arrival order rules (the
batch id is the leading order column), as in the live detector.

With ``reorder`` event time rules across batches as well: a row waits until
the largest event time seen is more than ``late_delay_seconds`` past it, and
rows are released in event-time order, equal times together. Arrivals shuffled
within the delay so give the results of the batch job over sorted rows.
:meth:`DetectionStream.drain` releases what still waits when a stream has
ended. Rows without an event time cannot be placed: they are taken as they
arrive, before the batch's others.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.functions.alerting import alert_id, is_ntz, severity
from tidewatch.functions.detect import DETAILS_TYPE, detect, details
from tidewatch.operators.alerts import sliced_policy_step
from tidewatch.operators.chain import TS_US, epoch_micros
from tidewatch.operators.model_store import ModelStore, scheduled_from
from tidewatch.operators.windows import last_rows, rolling_stats
from tidewatch.params import AlertParams, DetectorParams, ForestParams
from tidewatch.plans.detection import RESULT_POS
from tidewatch.session import ensure_checkpoint_dir, materialize
from tidewatch.sources.events import (
    dead_letter_reason, default_event_id, derive_unit_price, parse_messages, split_dead_letters, unpivot_features,
)
from tidewatch.sources.sinks import alert_messages
from tidewatch.streaming.live_metrics import LiveMetrics, message_counts, result_counts

BATCH = "_batch"
FRESH = "_fresh"


class DetectionStream:
    """Long feature rows in, alerts out, one ``foreachBatch`` query.

    ``id_cols`` identify an event (the first is the event id used in alert
    ids), ``ts_col`` is event time, ``order_cols`` order rows within a batch.
    ``sink`` gets each batch's alert messages (key, value) and the batch id,
    e.g. to write them to Kafka; a task folds at most ``fold_rows`` anomalies
    of a scope at a time through the alert machine; :func:`raw_message_stream`
    makes long rows of raw messages. Rows more than ``late_delay_seconds``
    behind the largest event time of earlier batches go to ``late_dir``;
    ``reorder`` holds the others back for as long and releases them in
    event-time order. A row without a feature stands for its event alone:
    it enters no window, but the forest's vectors count the event.
    """

    def __init__(
        self,
        spark: SparkSession,
        output_dir: str,
        state_dir: str,
        id_cols: Sequence[str] = ("event_id",),
        ts_col: str = "ts",
        order_cols: Sequence[str] = ("ts", "event_id"),
        scope_cols: Sequence[str] = (),
        params: DetectorParams = DetectorParams(),
        alert_params: AlertParams = AlertParams(),
        forest: ForestParams | None = None,
        late_delay_seconds: float | None = None,
        late_dir: str | None = None,
        reorder: bool = False,
        sink: Callable[[DataFrame, int], None] | None = None,
        fold_rows: int = 1 << 20,
    ):
        self.spark = spark
        if forest is not None and scope_cols:
            raise ValueError("the forest's vectors carry values over events of all scopes: use one stream per scope")
        if reorder and late_delay_seconds is None:
            raise ValueError("reorder needs late_delay_seconds, the time a row may wait")
        ensure_checkpoint_dir(spark)
        self.reorder = reorder
        self.state_dir = state_dir.rstrip("/")
        self.models = ModelStore(spark, f"{self.state_dir}/models")  # every model stays, for rescoring
        self.metrics = LiveMetrics(spark, f"{self.state_dir}/metrics")
        self.output_dir = output_dir.rstrip("/")
        self.id_cols = list(id_cols)
        self.ts_col = ts_col
        self.order_cols = list(order_cols)
        self.scope_cols = list(scope_cols)
        self.params = params
        self.alert_params = alert_params
        self.forest = forest
        self.late_delay_seconds = late_delay_seconds
        self.sink = sink
        self.fold_rows = fold_rows
        self.late_dir = (late_dir or self.output_dir.rsplit("/", 1)[0] + "/late").rstrip("/")

    # ------------------------------------------------------------------ state io
    def _read(self, kind: str, batch_id: int) -> DataFrame | None:
        """State after a batch; None before the first. State that should be
        there and is not stops the query."""
        if batch_id < 0:
            return None
        return self.spark.read.parquet(f"{self.state_dir}/{kind}/{batch_id}")

    def _write(self, df: DataFrame, kind: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.state_dir}/{kind}/{batch_id}")

    def _prune(self, batch_id: int) -> None:
        """Drop state that no replay can ask for: a batch reads the one before."""
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for kind in ("tail", "policy", "maxts", "waiting", "metrics", "lastz", "forest_n", "forest_buf", "forest_nodes"):
            path = jvm.org.apache.hadoop.fs.Path(f"{self.state_dir}/{kind}/{batch_id - 2}")
            path.getFileSystem(conf).delete(path, True)

    # ------------------------------------------------------------------ one batch
    def process(self, batch: DataFrame, batch_id: int) -> None:
        self._process(batch, batch_id, draining=False)

    def drain(self, batch_id: int) -> None:
        """Release all waiting rows of a stream that has ended, as batch
        ``batch_id`` (one after its last). If the stream goes on after all,
        its next batch reads the state before this and rewrites its output."""
        waiting = self._read("waiting", batch_id - 1) if self.reorder else None
        if waiting is not None:
            self._process(waiting.limit(0), batch_id, draining=True)

    def _process(self, batch: DataFrame, batch_id: int, draining: bool) -> None:
        p, ap = self.params, self.alert_params
        keys = [*self.scope_cols, "feature"]
        cols = list(dict.fromkeys([*self.id_cols, self.ts_col, *self.order_cols, *self.scope_cols, "feature", "value"]))
        fresh = batch.select(*cols).withColumn(BATCH, F.lit(batch_id).cast("long")).withColumn(FRESH, F.lit(True))
        fresh, bound = materialize(fresh, "stream-batch"), None  # the source is read once
        if self.late_delay_seconds is not None:
            fresh, bound = self._route_late(fresh, batch_id, draining)
        events = fresh.filter(F.col("feature").isNull())
        fresh = fresh.filter(F.col("feature").isNotNull())
        tail = self._read("tail", batch_id - 1)
        rows = fresh if tail is None else fresh.unionByName(tail.withColumn(FRESH, F.lit(False)))
        order = [BATCH, *self.order_cols]

        stats = rolling_stats(rows, order_cols=order, key_cols=keys, window=p.window_size)
        verdicts = detect(stats, p).filter(F.col(FRESH))
        place = F.lit(len(p.features))
        for i, f in enumerate(p.features):
            place = F.when(F.col("feature") == f, F.lit(i)).otherwise(place)
        anoms = verdicts.filter("is_anomaly").select(*cols, BATCH, "score", "anomaly_type", details(p).alias("details"))
        if self.forest is not None:
            anoms = anoms.unionByName(self._forest_step(stats, events, batch_id, order), allowMissingColumns=True)
        anoms = anoms.withColumn("severity", severity("score", ap.severity_thresholds)).withColumn(RESULT_POS, place)
        anoms = anoms.withColumn(TS_US, epoch_micros(anoms, self.ts_col))

        # one machine per scope, in arrival order, from the state of the batch before
        prev = self._read("policy", batch_id - 1)
        done, state = sliced_policy_step(anoms, prev, self.scope_cols, [*self.order_cols, RESULT_POS], ap, self.fold_rows)
        levels = list(dict.fromkeys([*(name for name, _ in ap.severity_thresholds), "LOW"]))
        watched = self.metrics.watch(done, result_counts(levels, ("zscore", "iqr", "unknown")))
        kept = watched.filter(F.col("status") == "emitted")
        alerts = kept.select(
            alert_id(self.id_cols[0], "feature", self.ts_col, is_ntz(kept, self.ts_col)).alias("alert_id"),
            F.col(self.ts_col).alias("timestamp"),
            F.col(self.id_cols[0]).cast("string").alias("event_id"),
            *self.scope_cols, "feature", "value", "score", "severity",
            F.coalesce("anomaly_type", F.lit("unknown")).alias("anomaly_type"),
            "details",
        )
        alerts.write.mode("overwrite").parquet(f"{self.output_dir}/batch_id={batch_id}")
        if self.sink is not None:
            written = self.spark.read.schema(alerts.schema).parquet(f"{self.output_dir}/batch_id={batch_id}")
            self.sink(alert_messages(written), batch_id)

        # ---- next state
        tail_rows = last_rows(rows.drop(FRESH), keys, order, max(p.window_size - 1, 0)).drop("_back")
        self._write(tail_rows, "tail", batch_id)
        if bound is not None:  # no row below the bound is judged any more
            state = state.filter(F.col("_until") > F.lit(bound))
        self._write(state, "policy", batch_id)
        self.metrics.close(batch_id)
        self._prune(batch_id)

    # ------------------------------------------------------------------ late data
    def _route_late(self, fresh: DataFrame, batch_id: int, draining: bool) -> tuple[DataFrame, int | None]:
        """(rows of this batch to score, the bound in epoch microseconds below
        which no later row is scored).

        ``maxts/<id>`` carries the running maximum of event times; the bound
        after a batch is that minus the delay. Rows below the bound of the
        batch before go to ``late_dir/batch_id=<id>``. While no event time is
        known there is no bound and no row is late; a row without an event
        time is never late."""
        delay = int(self.late_delay_seconds * 1_000_000)
        before = self._read("maxts", batch_id - 1)
        was = before.first()["max_us"] if before is not None else None
        us = epoch_micros(fresh, self.ts_col)
        if was is not None:
            late = fresh.filter(us < F.lit(was - delay)).drop(FRESH)
            late.write.mode("overwrite").parquet(f"{self.late_dir}/batch_id={batch_id}")
            fresh = fresh.filter(us.isNull() | (us >= F.lit(was - delay)))
        fresh = materialize(fresh, "stream-accepted")
        seen = fresh.agg(F.max(us)).first()[0]
        now = max((x for x in (was, seen) if x is not None), default=None)
        kept = self.spark.range(1).select(F.lit(now).cast("long").alias("max_us"))
        self._write(kept, "maxts", batch_id)
        bound = None if now is None else now - delay
        if not self.reorder:
            return fresh, bound
        held = self._read("waiting", batch_id - 1)
        if held is not None:
            again = held.withColumn(BATCH, F.lit(batch_id).cast("long")).withColumn(FRESH, F.lit(True))
            fresh = fresh.unionByName(again)
        free = us.isNull() | (F.lit(True) if draining else F.lit(False) if bound is None else us < F.lit(bound))
        self._write(fresh.filter(~free).drop(BATCH, FRESH), "waiting", batch_id)
        return materialize(fresh.filter(free), "stream-released"), bound

    # ------------------------------------------------------------------ forest
    def _forest_step(self, stats: DataFrame, events: DataFrame, batch_id: int, order: list[str]) -> DataFrame:
        """Feature vectors, retraining and scoring for this batch; ``events``
        may hold none of the features.

        Carried state: ``forest_n`` (vectors so far), ``forest_buf`` (last
        buffer_size vectors), ``forest_nodes`` (latest model), ``lastz``
        (last z-score per feature). Models whose triggering vector falls in
        this batch train on carried buffer + batch vectors.
        """
        from tidewatch.operators.carry import carry_forward
        from tidewatch.operators.forest import (fit_models, first_train, forest_anomalies, score_vectors,
                                                training_slices, with_epochs)
        from tidewatch.operators.positions import GPOS, PID, with_global_position

        fp, feats = self.forest, list(self.params.features)
        ekeys = list(dict.fromkeys([*self.id_cols, self.ts_col, *self.order_cols, *self.scope_cols, BATCH]))
        zcols = [f"z_{f}" for f in feats]
        blank = events.select(*ekeys, F.lit(None).cast("string").alias("feature"), F.lit(None).cast("double").alias("zscore"))
        present = stats.filter(F.col(FRESH)).select(*ekeys, "feature", "zscore")
        wide = present.unionByName(blank).groupBy(*ekeys).agg(
            *[F.max(F.when(F.col("feature") == F.lit(f), F.col("zscore"))).alias(z) for f, z in zip(feats, zcols)])
        prev_z = self._read("lastz", batch_id - 1)
        if prev_z is not None:
            seed = prev_z.select(*zcols).withColumn(BATCH, F.lit(-1).cast("long"))
            wide = wide.unionByName(seed, allowMissingColumns=True)
        filled = carry_forward(wide, order, zcols)
        ready = F.lit(True)
        for z in zcols:
            ready = ready & F.col(z).isNotNull()
        last_z = filled.orderBy(*[F.col(c).desc_nulls_last() for c in order]).limit(1).select(*zcols)
        self._write(last_z, "lastz", batch_id)
        vec = filled.filter((F.col(BATCH) >= 0) & ready).withColumn("vector", F.array(*[F.col(z) for z in zcols]))
        prev_n_df = self._read("forest_n", batch_id - 1)
        prev_n = int(prev_n_df.first()[0]) if prev_n_df is not None else 0
        seq = with_global_position(vec, order).withColumn("n", F.col(GPOS) + 1 + F.lit(prev_n)).drop(GPOS, PID)
        seq = materialize(seq, "stream-vectors")
        ep = with_epochs(seq, fp)
        new_n = prev_n + seq.count()
        self._write(self.spark.range(1).select(F.lit(new_n).cast("long").alias("n")), "forest_n", batch_id)
        buf = self._read("forest_buf", batch_id - 1)
        allv = seq.select("n", "vector") if buf is None else seq.select("n", "vector").unionByName(buf)
        self._write(allv.filter(F.col("n") > F.lit(new_n - fp.buffer_size)), "forest_buf", batch_id)
        n0 = first_train(fp)
        nodes = self._read("forest_nodes", batch_id - 1) if n0 is not None and prev_n >= n0 else None
        if n0 is not None and new_n >= n0:
            # models whose triggering vector n_m = n0 + (m-1) * interval is in this batch
            first_new = 1 if prev_n < n0 else (prev_n - n0) // fp.retrain_interval + 2
            slices = training_slices(allv, fp).filter(F.col("model") >= first_new)
            trained = materialize(fit_models(slices, fp), "stream-nodes")
            self.models.save(trained, scheduled_from(fp), f"{batch_id:012d}")
            nodes = trained if nodes is None else nodes.unionByName(trained)
        if nodes is None:  # nothing trained yet: every vector is model 0
            return ep.filter(F.lit(False)).select(*ekeys, F.lit("multi_feature").alias("feature"),
                                                  F.lit(0.0).alias("value"), F.lit(0.0).alias("score"),
                                                  F.lit("zscore").alias("anomaly_type"), self._no_details())
        top = nodes.agg(F.max("model")).first()[0]
        self._write(nodes.filter(F.col("model") == top), "forest_nodes", batch_id)
        scored = score_vectors(ep, nodes, ekeys)
        fa = forest_anomalies(scored, self.alert_params.score_scale_forest)
        return fa.select(*ekeys, "feature", "value", "score", "anomaly_type", "details")

    def _no_details(self):
        """An absent evidence record."""
        return F.lit(None).cast(DETAILS_TYPE).alias("details")

    # ------------------------------------------------------------------ wiring
    def start(self, stream: DataFrame, checkpoint_location: str, trigger: dict | None = None):
        """Start the streaming query; ``checkpoint_location`` tracks offsets."""
        w = stream.writeStream.foreachBatch(self.process).option("checkpointLocation", checkpoint_location)
        if trigger:
            w = w.trigger(**trigger)
        return w.start()

    def start_messages(
        self, messages: DataFrame, checkpoint_location: str, dead_dir: str, time_col: str = "timestamp", trigger: dict | None = None
    ):
        """Start the detector on raw messages (``value``: JSON), one query that
        reads the source once: messages are parsed, bad ones written to
        ``dead_dir/batch_id=<id>`` with their reason, ``unit_price`` derived and
        features unpivoted. Events without any tracked feature still count
        for the forest's vectors."""
        features = list(self.params.features)

        def each(batch: DataFrame, batch_id: int) -> None:
            parsed = parse_messages(batch)
            tagged = parsed.withColumn("reason", dead_letter_reason(parsed, features))
            watched = self.metrics.watch(tagged, message_counts(("malformed", "bad_number", "non_finite")))
            table = materialize(watched, "stream-messages")
            dead = table.filter(F.col("reason").isNotNull()).select("_raw", "reason")
            dead.write.mode("overwrite").parquet(f"{dead_dir.rstrip('/')}/batch_id={batch_id}")
            valid = default_event_id(table.filter(F.col("reason").isNull())).withColumnRenamed(time_col, self.ts_col)
            ids = list(dict.fromkeys([*self.id_cols, self.ts_col, *self.order_cols, *self.scope_cols]))
            long = unpivot_features(derive_unit_price(valid), ids, features)
            marks = valid.select(*ids, F.lit(None).cast("string").alias("feature"), F.lit(None).cast("double").alias("value"))
            self.process(long.unionByName(marks), batch_id)

        w = messages.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint_location)
        return (w.trigger(**trigger) if trigger else w).start()

    def alerts(self) -> DataFrame:
        return self.spark.read.parquet(self.output_dir)


def raw_message_stream(messages: DataFrame, dead_dir: str, checkpoint_location: str, features: Sequence[str],
                       ts_col: str = "timestamp", trigger: dict | None = None):
    """Raw messages -> (long rows for :class:`DetectionStream`, the running
    dead-letter query). Messages are parsed, bad ones written to ``dead_dir``
    with their reason, ``unit_price`` derived and features unpivoted.

    ``trigger`` is that of :meth:`DetectionStream.start`; by default the
    dead-letter query runs on until it is stopped, like the detector's."""
    valid, dead = split_dead_letters(parse_messages(messages), features)
    w = (dead.select("_raw", "reason").writeStream.format("parquet").option("path", dead_dir)
         .option("checkpointLocation", checkpoint_location))
    if trigger:
        w = w.trigger(**trigger)
    letters = w.start()
    events = derive_unit_price(default_event_id(valid))
    long = unpivot_features(events.withColumnRenamed(ts_col, "ts"), ["event_id", "ts"], features)
    return long, letters
