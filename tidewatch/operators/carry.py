"""Carry the last non-null value forward over a global order, in parallel.

A window ``last(x, ignorenulls)`` over an un-partitioned order puts all rows
in one task. Instead, rows are range-sorted and each partition is filled
forward where it lies, a batch at a time, and written once as a table (see
:mod:`tidewatch.operators.positions`). Each partition's last values (a table
of at most P rows) give the carry-in of the partitions behind it, which fills
the rows before a partition's first value. No row is shuffled a second time.
With ``key_cols`` values are carried inside each key only.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewatch.operators.positions import PID, key_changes, last_of_each, range_sorted
from tidewatch.session import materialize


def _filled(column: pa.Array, held: pa.Array | None, new: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """``column`` with nulls replaced by the last value before them (``held``
    stands before the first), and its last value as an array of one row;
    nothing is carried into a row that is ``new``."""
    known = np.asarray(column.is_valid()) | new
    at = np.maximum.accumulate(np.where(known, np.arange(len(column)), -1))
    if held is None:
        held = pa.nulls(1, column.type)
    whole = pa.concat_arrays([held.cast(column.type), column])
    out = whole.take(pa.array(at + 1))
    return out, out.slice(len(out) - 1)


def carry_forward(
    df: DataFrame, order_cols: Sequence[str], cols: Sequence[str], num_partitions: int | None = None, key_cols: Sequence[str] = (),
    keep_place: bool = False,
) -> DataFrame:
    """Replace NULLs in ``cols`` by the last non-null value earlier in
    ``order_cols`` order (of the same ``key_cols``). With ``keep_place`` rows
    keep the place that the sort gave them (``_pid``, ``_loc``)."""
    wanted, keys = list(cols), list(key_cols)
    ranged = range_sorted(df, [*keys, *order_cols], num_partitions)

    filled_type = T.StructType([ranged.schema[c] for c in wanted])

    def fill(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        held: dict[str, pa.Array] = {}
        last = None
        for b in batches:
            b = pa.RecordBatch.from_arrays(list(b) if isinstance(b, tuple) else [b], [*keys, *wanted])
            if b.num_rows:
                new = key_changes(b, keys)
                first = tuple(b.column(k)[0].as_py() for k in keys)
                new[0] = last is not None and first != last
                last = tuple(b.column(k)[b.num_rows - 1].as_py() for k in keys)
            made = []
            for name in wanted:
                column = b.column(name)
                if b.num_rows:
                    column, held[name] = _filled(column, held.get(name), new)
                made.append(column)
            yield pa.StructArray.from_arrays(made, wanted)

    # keys and the carried columns alone go through Python, in the rows' order, once
    carry = F.arrow_udf(fill, filled_type).asNondeterministic()
    others = [c for c in ranged.columns if c not in wanted]
    read_rows = ranged.select(*others, carry(*[F.col(c) for c in [*keys, *wanted]]).alias("_filled"))
    table = materialize(read_rows.select(*others, "_filled.*"), "carry")
    ends = last_of_each(table).select(PID, F.struct(F.struct(*wanted).alias("v"), *keys).alias("_end"))
    # what stands at a partition's end, also if its key began partitions ago
    run = Window.partitionBy(*[F.col("_end")[k] for k in keys]).orderBy(PID)
    last = ends.select(PID, "_end", *[F.last(F.col("_end.v")[c], ignorenulls=True).over(run).alias(f"_in_{c}") for c in wanted])
    shift = Window.orderBy(PID)
    before = last.select(
        PID, *[F.lag(F.col("_end")[k]).over(shift).alias(f"_key_{k}") for k in keys],
        *[F.lag(f"_in_{c}").over(shift).alias(f"_in_{c}") for c in wanted],
    ).withColumnRenamed(PID, "_at")
    same = F.col(PID) == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    out = table.join(F.broadcast(before), same, "left")  # one row per partition
    return out.select(*[F.coalesce(c, f"_in_{c}").alias(c) if c in wanted else F.col(c)
                        for c in [*df.columns, *([PID, "_loc"] if keep_place else [])]])
