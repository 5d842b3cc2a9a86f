"""Operational metrics gathered while the stream runs, in the passes it makes
anyway (``DataFrame.observe``), without a scan of their own.

A metric is a row ``(metric, label, value)``. A micro-batch's observed counts
are added to the totals of the batch before and written under its batch id, so
a batch that is run again rewrites the same totals.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

SCHEMA = "metric string, label string, value long"
_SEP = "|"


def count_where(metric: str, label: str, condition: Column) -> Column:
    """An observed count; metric and label are read back from its name."""
    return F.count_if(condition).alias(f"{metric}{_SEP}{label}")


def result_counts(levels: Sequence[str], types: Sequence[str]) -> list[Column]:
    """Of rows with ``severity``, ``anomaly_type`` and ``status``: anomalies by
    severity and type (before deduplication), alerts published by severity,
    and alerts held back."""
    kind = F.coalesce("anomaly_type", F.lit("unknown"))
    status = F.col("status")
    out = [count_where("anomalies", f"{s}/{t}", (F.col("severity") == s) & (kind == t)) for s in levels for t in types]
    out += [count_where("alerts", s, (F.col("severity") == s) & (status == "emitted")) for s in levels]
    out.append(count_where("alerts_deduplicated", "", status == "duplicate"))
    out.append(count_where("alerts_rate_limited", "", status == "rate_limited"))
    return out


def message_counts(reasons: Sequence[str]) -> list[Column]:
    """Of parsed messages with a ``reason`` (null if good): consumed,
    processed, and errors by reason."""
    why = F.col("reason")
    out = [count_where("events_consumed", "", F.lit(True)), count_where("events_processed", "", why.isNull())]
    return out + [count_where("processing_errors", r, why == r) for r in reasons]


class LiveMetrics:
    """Totals per micro-batch in ``folder``."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._open: list[Observation] = []

    def watch(self, df: DataFrame, counts: Sequence[Column]) -> DataFrame:
        """``df``, observed when it is next computed. It must be computed once,
        by an action of its own (a table that is read and written)."""
        seen = Observation()
        self._open.append(seen)
        return df.observe(seen, *counts)

    def close(self, batch_id: int) -> None:
        """Add what was observed to the totals before, under this batch."""
        now = [(*name.split(_SEP, 1), int(n or 0)) for seen in self._open for name, n in seen.get.items()]
        self._open = []
        rows = self.spark.createDataFrame(now, SCHEMA)
        if batch_id > 0:
            rows = rows.unionByName(self.totals(batch_id - 1))
        sums = rows.groupBy("metric", "label").agg(F.sum("value").alias("value"))
        sums.coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/{batch_id}")

    def totals(self, batch_id: int) -> DataFrame:
        """(metric, label, value) after a batch."""
        return self.spark.read.schema(SCHEMA).parquet(f"{self.folder}/{batch_id}")
