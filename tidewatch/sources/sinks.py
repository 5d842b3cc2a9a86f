"""Alert sink and trade-event stream source (Kafka, with file twins).

The Kafka connector jar is not bundled; the option builders are plain
dictionaries so they can be unit-tested, and the file twins (JSON/parquet
directories) carry the same records for local runs and tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def kafka_source_options(bootstrap: str, topic: str, starting_offsets: str = "latest",
                         max_offsets_per_trigger: int | None = None, group_id: str | None = None) -> dict[str, str]:
    """Options for ``spark.readStream.format("kafka")``: one topic, start at
    ``latest``; ``max_offsets_per_trigger`` bounds a micro-batch if given.
    Offsets that expired before they were read stop the query (Spark's
    default), since their records would be missing from the windows."""
    opts = {"kafka.bootstrap.servers": bootstrap, "subscribe": topic, "startingOffsets": starting_offsets}
    if max_offsets_per_trigger:
        opts["maxOffsetsPerTrigger"] = str(max_offsets_per_trigger)
    if group_id:
        opts["kafka.group.id"] = group_id
    return opts


def kafka_sink_options(bootstrap: str, topic: str) -> dict[str, str]:
    """Producer settings of the alert sink: acks=all, 3 retries, linger 10 ms."""
    return {"kafka.bootstrap.servers": bootstrap, "topic": topic, "kafka.acks": "all",
            "kafka.retries": "3", "kafka.linger.ms": "10"}


def read_trade_stream(spark: SparkSession, fmt: str = "kafka", path: str | None = None, bootstrap: str | None = None,
                      topic: str | None = None, starting_offsets: str = "latest",
                      max_offsets_per_trigger: int | None = None, group_id: str | None = None, **options) -> DataFrame:
    """Raw trade-event stream with a ``value`` payload column.

    ``fmt="kafka"`` reads ``topic`` with :func:`kafka_source_options`;
    ``fmt="text"`` reads JSON lines from files (one message per line) as a
    local twin. ``options`` go to the reader and win over the defaults.
    """
    if fmt == "kafka":
        if not bootstrap or not topic:
            raise ValueError("a Kafka stream needs bootstrap and topic")
        options = {**kafka_source_options(bootstrap, topic, starting_offsets, max_offsets_per_trigger, group_id), **options}
    reader = spark.readStream.format(fmt).options(**options)
    return reader.load(path) if path else reader.load()


def alert_messages(alerts: DataFrame, key_col: str | None = "alert_id") -> DataFrame:
    """``(key, value)`` pairs: key = alert id (or ``key_col``), value = the
    alert as JSON. Feed to ``write.format("kafka")`` or any text sink."""
    key = F.col(key_col).cast("string") if key_col else F.lit(None).cast("string")
    return alerts.select(key.alias("key"), F.to_json(F.struct(*[F.col(c) for c in alerts.columns])).alias("value"))


def write_alerts(alerts: DataFrame, fmt: str = "parquet", path: str | None = None, options: dict | None = None) -> None:
    """Batch write of alerts (Kafka via :func:`alert_messages`, else a table)."""
    if fmt == "kafka":
        alert_messages(alerts).write.format("kafka").options(**(options or {})).save()
    else:
        alerts.write.mode("append").format(fmt).save(path)

