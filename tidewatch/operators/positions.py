"""Global row positions in a sort order, without a single-partition window.

``row_number()`` over an un-partitioned (or hot-key) window moves every
row into one task. Instead:

1. ``repartitionByRange(P, *sort)`` + ``sortWithinPartitions`` -- a
   distributed sort; a hot key is spread over many range partitions;
2. ``monotonically_increasing_id`` = (partition << 33) + row index;
3. per-partition counts (a table of at most P rows, so its broadcast is
   bounded by the partition count, not by the data) -> cumulative offsets;
4. position = offset(partition) + row index.

The range-sorted rows (with their partition id and index) are written once
as a table in the cluster's ``spark.checkpoint.dir`` before the counts are
taken: Spark's range sampler is seeded per RDD, so two independently planned
copies of the same range exchange may cut different bounds. Reading one
written copy makes the count table and the rows agree, cuts the lineage,
and survives executor loss without recomputation drift.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.session import materialize

PID = "_pid"
GPOS = "_gpos"
_LOW_BITS = (1 << 33) - 1


def default_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def _as_cols(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def key_changes(batch: pa.RecordBatch, key_cols: Sequence[str]) -> np.ndarray:
    """True where a row's keys differ from those of the row before (row 0: True)."""
    new = np.zeros(batch.num_rows, dtype=bool)
    new[:1] = True
    for k in key_cols:
        codes = batch.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    return new


def range_sorted(df: DataFrame, sort_cols: Sequence[str | Column], num_partitions: int | None = None) -> DataFrame:
    """Range-partition and sort; adds ``_pid`` and the in-partition index ``_loc``."""
    p = num_partitions or default_partitions(df)
    cols = _as_cols(sort_cols)
    mid = F.monotonically_increasing_id()
    return (
        df.repartitionByRange(p, *cols)
        .sortWithinPartitions(*cols)
        .withColumn("_mid", mid)
        .withColumn(PID, F.shiftright("_mid", 33).cast("int"))
        .withColumn("_loc", F.col("_mid").bitwiseAND(F.lit(_LOW_BITS)))
        .drop("_mid")
    )


def partition_offsets(ranged: DataFrame) -> DataFrame:
    """``(_pid, _off)``: rows in all earlier range partitions (<= P rows)."""
    counts = ranged.groupBy(PID).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy(PID).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(PID, F.coalesce(F.sum("_n").over(before), F.lit(0)).cast("long").alias("_off"))


def last_of_each(ranged: DataFrame, at: str = "_loc") -> DataFrame:
    """The row of the largest ``at`` of each range partition (a ``max_by`` of
    whole rows would sort the table)."""
    last = ranged.groupBy(PID).agg(F.max(at).alias(at))
    return ranged.join(F.broadcast(last), [PID, at])


def with_global_position(
    df: DataFrame,
    sort_cols: Sequence[str | Column],
    num_partitions: int | None = None,
    pos_col: str = GPOS,
) -> DataFrame:
    """Add ``pos_col`` = 0-based position of the row in ``sort_cols`` order.

    ``sort_cols`` must be a total order for the numbering to be
    reproducible. The result keeps ``_pid`` (its range partition).
    """
    return located(materialize(range_sorted(df, sort_cols, num_partitions), "positions"), pos_col)


def located(ranged: DataFrame, pos_col: str = GPOS) -> DataFrame:
    """A written table of :func:`range_sorted` rows with their positions."""
    return (
        ranged.join(F.broadcast(partition_offsets(ranged)), PID)
        .withColumn(pos_col, F.col("_loc") + F.col("_off"))
        .drop("_loc", "_off")
    )
