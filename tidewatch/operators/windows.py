"""Count-based sliding windows: statistics over the last N values per key.

Two physical strategies, same numbers:

``frame``  -- ``Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(N-1), 0)``
              with built-in aggregates and exact quartiles of the sorted frame.
              All rows of a key meet in one task and the frame is re-evaluated
              per row, so it suits many small keys and small N only.

``halo``   -- skew-proof: rows are range-partitioned and sorted by
              ``(keys, order)`` (a hot key spreads over many partitions) and
              each partition is read through once, where it lies, in bounded
              steps that carry the last N-1 values along. Rows whose window
              reaches back into the partition before (at most N-1, its edge)
              are set aside; only they and the last N-1 rows of the partitions
              before them move, P x 2(N-1) rows in all, and are finished apart.
              No other row is shuffled again.

``auto`` picks ``halo``.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidewatch.functions.window_kernel import STAT_NAMES, window_stats
from tidewatch.operators.positions import PID, default_partitions, key_changes, range_sorted
from tidewatch.operators.wide import wide_windows
from tidewatch.session import materialize
from tidewatch.sources.events import unpivot_features

STAT_FIELDS = [T.StructField("win_count", T.LongType())] + [
    T.StructField(n, T.DoubleType()) for n in STAT_NAMES[1:]
]


def stat_fields(stats: Sequence[str] | None = None) -> list[T.StructField]:
    """The statistics named (default: all), in their order."""
    return [f for f in STAT_FIELDS if stats is None or f.name in stats]


def _default_step(window: int) -> int:
    return max(8 * window, 8192)


def rolling_stats(
    df: DataFrame,
    order_cols: Sequence[str],
    key_cols: Sequence[str] = ("feature",),
    value_col: str = "value",
    window: int = 1000,
    strategy: str = "auto",
    reset_col: str | None = None,
    passthrough: Sequence[str] | None = None,
    block_size: int | None = None,
    num_partitions: int | None = None,
    stats: Sequence[str] | None = None,
    features: Sequence[str] | None = None,
) -> DataFrame:
    """Add window statistics for each row: the window holds the last
    ``window`` values of the row's key (itself included), oldest evicted.

    Columns added: ``win_count`` (values in the window), ``win_mean``,
    ``win_std`` (sample), ``win_min``, ``win_max``, ``win_p25``,
    ``win_median``, ``win_p75``, ``win_iqr``, ``zscore`` of the row's value
    (0 when the deviation is 0). Statistics are NULL while the window holds
    fewer than two values. ``block_size`` rows are computed at a time in a
    task. ``stats`` names the statistics to keep (default: all); the others
    are not written. ``reset_col`` (boolean) clears the window before
    the row is added. ``order_cols`` must make a total order within a key.

    Rows whose value is NULL or NaN are absent: they enter no window and give
    no row; a reset on one clears the window for the rows after it.

    With ``features`` rows are events with a column for each feature and the
    result is that of their unpivoted rows (``feature``, ``value``), which are
    made after the rows have moved (:mod:`tidewatch.operators.wide`).
    ``key_cols`` end with ``feature`` then, and the sort needs no long rows.
    """
    if window < 1:
        raise ValueError("window must be >= 1")
    fields = stat_fields(stats)
    if features is not None:
        if reset_col or list(key_cols)[-1:] != ["feature"] or passthrough is None:
            raise ValueError("features need key_cols that end with feature, a passthrough, and no reset")
        scope = list(key_cols)[:-1]
        if strategy != "frame":
            wide = wide_windows(df, order_cols, features, scope, window, [c for c in passthrough if c not in ("feature", "value")],
                                num_partitions, block_size)
            return wide.statistics(fields, list(passthrough))
        ids = list(dict.fromkeys([*scope, *order_cols, *(c for c in passthrough if c not in ("feature", "value"))]))
        near = df.select(*ids, *features)
        if scope:  # all tasks at work; an event's features stay together
            near = near.repartition(default_partitions(df), *scope)
        df = unpivot_features(near, ids, features, in_place=True)
    keep = list(passthrough) if passthrough is not None else list(df.columns)
    needed = list(dict.fromkeys([*key_cols, *order_cols, value_col, *([reset_col] if reset_col else []), *keep]))
    present = F.col(value_col).isNotNull() & ~F.isnan(F.col(value_col).cast("double"))
    resets = F.coalesce(F.col(reset_col).cast("boolean"), F.lit(False)) if reset_col else F.lit(False)
    src = df.select(*needed).filter(present | resets)
    if strategy in ("auto", "halo"):
        out = _halo(src, list(order_cols), list(key_cols), value_col, window, reset_col, keep,
                    block_size or _default_step(window), num_partitions, fields)
    elif strategy == "frame":
        dealt = features is not None and len(key_cols) > 1
        out = _frame(src, list(order_cols), list(key_cols), value_col, window, reset_col, dealt)
        out = out.select(*keep, *[f.name for f in fields])
    else:
        raise ValueError(f"unknown strategy {strategy!r}")
    return out


# ---------------------------------------------------------------------------
# frame strategy (pure Spark SQL)
# ---------------------------------------------------------------------------

def _percentile(values: str, n: Column, q: Column) -> Column:
    """``percentile`` of a sorted array of ``n`` values, by its own formula."""
    pos = (n - 1) * q
    lo = F.floor(pos)
    a = F.get(values, lo.cast("int")).cast("double")
    b = F.get(values, F.least(lo + 1, n - 1).cast("int")).cast("double")
    return F.when((pos == lo) | (a == b), a).otherwise((lo + 1 - pos) * a + (pos - lo) * b)


def _frame(df, order_cols, key_cols, value_col, window, reset_col, dealt=False) -> DataFrame:
    keys: list[str | Column] = list(key_cols)
    if key_cols and not dealt:  # all tasks at work, however small Spark thinks the rows are
        df = df.repartition(default_partitions(df), *key_cols)
    if reset_col:
        grow = Window.partitionBy(*key_cols).orderBy(*order_cols).rowsBetween(Window.unboundedPreceding, 0)
        df = df.withColumn("_epoch", F.sum(F.coalesce(F.col(reset_col), F.lit(False)).cast("long")).over(grow))
        df = df.filter(F.col(value_col).isNotNull() & ~F.isnan(F.col(value_col).cast("double")))
        keys.append("_epoch")
    w = Window.partitionBy(*keys).orderBy(*order_cols).rowsBetween(-(window - 1), 0)
    v = F.col(value_col)
    # the frame's values, sorted once a row: a sliding ``percentile`` builds a
    # hash table and sorts it for every row
    out = df.select(
        "*",
        F.avg(v).over(w).alias("_mean"),
        F.stddev_samp(v).over(w).alias("_std"),
        F.collect_list(v).over(w).alias("_frame"),
    )
    out = out.withColumn("_frame", F.sort_array("_frame")).withColumn("win_count", F.size("_frame").cast("long"))
    out = out.select(
        "*",
        F.get("_frame", F.lit(0)).alias("_min"),
        F.get("_frame", (F.col("win_count") - 1).cast("int")).alias("_max"),
        F.transform(F.array(*[F.lit(x) for x in (0.25, 0.5, 0.75)]),
                    lambda x: _percentile("_frame", F.col("win_count"), x)).alias("_q"),
    )
    std = F.when(F.col("_min") == F.col("_max"), F.lit(0.0)).otherwise(F.col("_std"))
    z = F.when(std > 0, (v - F.col("_mean")) / std).otherwise(F.lit(0.0))
    r = F.col("win_count") >= 2
    out = out.select(
        *[c for c in df.columns if c != "_epoch"],
        "win_count",
        F.when(r, F.col("_mean")).alias("win_mean"),
        F.when(r, std).alias("win_std"),
        F.when(r, F.col("_min")).alias("win_min"),
        F.when(r, F.col("_max")).alias("win_max"),
        F.when(r, F.col("_q")[0]).alias("win_p25"),
        F.when(r, F.col("_q")[1]).alias("win_median"),
        F.when(r, F.col("_q")[2]).alias("win_p75"),
        F.when(r, F.col("_q")[2] - F.col("_q")[0]).alias("win_iqr"),
        F.when(r, z).alias("zscore"),
    )
    return out


# ---------------------------------------------------------------------------
# halo strategy (global positions + bounded blocks)
# ---------------------------------------------------------------------------

DONE, EDGE, ABSENT = 0, 1, 2


def _stat_columns(stats: dict[str, np.ndarray], names: Sequence[str]) -> list[pa.Array]:
    return [pa.array(stats[n], pa.int64() if n == "win_count" else pa.float64(), from_pandas=True) for n in names]


class _Reader:
    """Windows over one sorted range partition, a step of rows at a time.

    ``held`` are the last N-1 values of the open segment (a key's rows since
    its start or last reset); ``whole`` says whether that segment began in
    this partition, so that its windows need nothing from before it."""

    def __init__(self, key_cols, value_col, reset_col, window, names):
        self.key_cols, self.value_col, self.reset_col, self.window = key_cols, value_col, reset_col, window
        self.names = names
        self.held, self.whole, self.key = np.zeros(0), False, None

    def step(self, part: pa.RecordBatch) -> tuple[dict[str, np.ndarray], np.ndarray, np.ndarray]:
        """(statistics of all rows, finished rows, absent rows)."""
        n, window = part.num_rows, self.window
        values = part.column(self.value_col).cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)
        absent = np.isnan(values)  # rows that only reset
        new = key_changes(part, self.key_cols)
        key = tuple(part.column(k)[0].as_py() for k in self.key_cols)
        new[0] = self.key is not None and key != self.key
        if self.reset_col:
            new |= part.column(self.reset_col).cast(pa.bool_()).fill_null(False).to_numpy(zero_copy_only=False)
        k = len(self.held)
        at = np.arange(n) + k
        start = np.maximum.accumulate(np.where(new, at + absent, 0))
        every = np.concatenate([self.held, values])
        stats = window_stats(every, np.concatenate([np.zeros(k, np.int64), start]), window, at, names=self.names)
        began = np.logical_or.accumulate(new) | self.whole
        full = at - start + 1 >= window
        done = (began | full) & ~absent
        # on to the next step: the open segment's last values
        self.key = tuple(part.column(k)[n - 1].as_py() for k in self.key_cols)
        self.whole = bool(began[-1])
        self.held = every[max(start[-1], len(every) - (window - 1)) :] if window > 1 else np.zeros(0)
        return stats, done, absent


def _halo(df, order_cols, key_cols, value_col, window, reset_col, keep, step, num_partitions, fields) -> DataFrame:
    """See the module's head. The written table holds finished rows with their
    statistics (``_kind`` DONE), rows of a partition's edge (EDGE) and rows
    that only reset (ABSENT), in order. Keys, values and resets alone go
    through Python; a row's other columns stay where they are."""
    own = [*dict.fromkeys([*keep, *key_cols, value_col, *([reset_col] if reset_col else [])])]
    types = {f.name: f.dataType for f in df.schema.fields}
    place = [T.StructField(PID, T.IntegerType()), T.StructField("_loc", T.LongType()), T.StructField("_kind", T.IntegerType())]
    schema = T.StructType([*(T.StructField(c, types[c]) for c in own), *place, *fields])
    made_names = [f.name for f in fields]
    read_names = [*dict.fromkeys([*key_cols, value_col, *([reset_col] if reset_col else [])])]
    made_type = T.StructType([place[-1], *fields])

    def read(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        reader = _Reader(key_cols, value_col, reset_col, window, made_names)
        for b in batches:
            whole = pa.RecordBatch.from_arrays(list(b) if isinstance(b, tuple) else [b], read_names)
            made = []
            for lo in range(0, whole.num_rows, step):
                stats, done, absent = reader.step(whole.slice(lo, step))
                kind = np.where(done, DONE, np.where(absent, ABSENT, EDGE)).astype(np.int32)
                made.append(pa.StructArray.from_arrays([pa.array(kind), *_stat_columns(stats, made_names)], ["_kind", *made_names]))
            if made:
                yield pa.concat_arrays(made)
            else:
                yield pa.array([], to_arrow_type(made_type))

    made = F.arrow_udf(read, made_type).asNondeterministic()  # reads rows in their order, once
    ranged = range_sorted(df.select(*dict.fromkeys([*own, *order_cols])), [*key_cols, *order_cols], num_partitions)
    read_rows = ranged.select(*own, PID, "_loc", made(*[F.col(c) for c in read_names]).alias("_made"))
    table = materialize(read_rows.select(*own, PID, "_loc", "_made.*"), "windows")
    done = table.filter(F.col("_kind") == DONE).select(*keep, *made_names)
    if window == 1:
        return done
    edges = _edges(table, key_cols, value_col, reset_col, window, own, schema, made_names)
    return done.unionByName(edges.select(*keep, *made_names))


def _edges(table: DataFrame, key_cols, value_col, reset_col, window, own, schema, made_names) -> DataFrame:
    """The edge rows with their statistics: each partition's edge meets the
    last N-1 rows before it (of the partition before, or of several if they
    are short)."""
    spark = table.sparkSession
    ends = table.groupBy(PID).agg((F.max("_loc") + 1).alias("n")).orderBy(PID).collect()
    # one number per partition: where each begins in the whole order
    pids, n = [r[PID] for r in ends], np.array([r["n"] for r in ends], np.int64)
    first = np.concatenate(([0], np.cumsum(n)))[:-1]
    upto = np.searchsorted(first, first + n + window - 1, side="left")  # partitions that reach back into this one
    goes = [(p, pids[j], int(n[i]) - (window - 1)) for i, p in enumerate(pids) for j in range(i + 1, int(upto[i]))]
    targets = spark.createDataFrame(goes, f"{PID} int, _to int, _from long")
    late = F.col("_loc") >= F.lit(min((g[2] for g in goes), default=0))  # a filter that the file format can use
    tail = table.filter(late).join(F.broadcast(targets), PID).filter(F.col("_loc") >= F.col("_from")).drop("_from")
    edge = table.filter(F.col("_kind") == EDGE).withColumn("_to", F.col(PID))
    marked = tail.withColumn("_sent", F.lit(True)).unionByName(edge.withColumn("_sent", F.lit(False)))

    def finish(group: pa.Table) -> pa.Table:
        part = group.sort_by([(PID, "ascending"), ("_loc", "ascending")]).combine_chunks().to_batches()[0]
        stats, _, _ = _Reader(key_cols, value_col, reset_col, window, made_names).step(part)
        at = np.flatnonzero(~part.column("_sent").to_numpy(zero_copy_only=False))
        cols = part.select([*own, PID, "_loc", "_kind"]).take(pa.array(at))
        made = _stat_columns({n: stats[n][at] for n in made_names}, made_names)
        return pa.Table.from_arrays([*cols.columns, *made], [f.name for f in schema.fields])

    return marked.groupBy("_to").applyInArrow(finish, schema)


# ---------------------------------------------------------------------------
# z-score against an explicit reference, snapshots
# ---------------------------------------------------------------------------

def score_against(stats: DataFrame, values: DataFrame, on: Sequence[str], value_col: str = "value") -> DataFrame:
    """z-score of ``values`` rows against window statistics taken elsewhere.

    ``stats`` holds one row per key with ``win_mean``/``win_std`` (e.g. a
    snapshot); the value need not be in that window.
    """
    s = stats.select(*on, "win_count", "win_mean", "win_std", "win_min", "win_max",
                     "win_p25", "win_median", "win_p75", "win_iqr")
    j = values.join(s, list(on), "inner")
    std = F.col("win_std")
    z = F.when(F.col("win_count") >= 2, F.when(std > 0, (F.col(value_col) - F.col("win_mean")) / std).otherwise(0.0))
    return j.withColumn("zscore", z)


#: rows a task holds before it hands its candidates on
HELD = 1 << 18


def _keep_last(rows: DataFrame, key_cols: Sequence[str], order_cols: Sequence[str], n: int) -> DataFrame:
    """At most ``n`` rows of each key of each partition (or of each ``HELD``
    rows of a partition that holds very many keys): its last ones."""
    keys = list(key_cols)
    order = [*[(k, "ascending") for k in keys], *[(c, "descending") for c in order_cols]]

    def last(table: pa.Table) -> pa.Table:
        # nulls order first in Spark, so they come last from the end
        table = table.take(pc.sort_indices(table, order, null_placement="at_end")).combine_chunks()
        if not table.num_rows:
            return table
        new = key_changes(table.to_batches()[0], keys)
        at = np.arange(table.num_rows)
        rank = at - np.maximum.accumulate(np.where(new, at, 0))
        return table.filter(pa.array(rank < n))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, kept = [], 0
        for b in batches:
            held.append(b)
            if sum(x.num_rows for x in held) - kept < max(4 * n, 1 << 15):
                continue
            best = last(pa.Table.from_batches(held))
            if best.num_rows > HELD:
                yield from best.to_batches()
                held, kept = [], 0
            else:
                held, kept = best.to_batches(), best.num_rows
        if held:
            yield from last(pa.Table.from_batches(held)).to_batches()

    return rows.mapInArrow(work, rows.schema)


def last_rows(df: DataFrame, key_cols: Sequence[str], order_cols: Sequence[str], n: int) -> DataFrame:
    """The last ``n`` rows of each key in ``order_cols`` order, with their
    number from the end of the key in ``_back`` (1: the last).

    Every task keeps a key's last ``n`` rows of what it reads; these
    candidates are dealt by key and a salt, cut to ``n`` again, and ranked by
    key, so at most ``n`` x keys x tasks rows move and one key's last step
    holds ``n`` x salts rows.
    """
    if n < 1:
        return df.withColumn("_back", F.lit(0)).filter(F.lit(False))
    keys = list(key_cols)
    width = default_partitions(df)
    salts = max(1, int(np.sqrt(width)))
    near = _keep_last(df, keys, order_cols, n).withColumn("_salt", F.spark_partition_id() % salts)
    dealt = near.repartition(width, *keys, "_salt").drop("_salt")
    fewer = _keep_last(dealt, keys, order_cols, n)
    back = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in order_cols])
    return fewer.withColumn("_back", F.row_number().over(back)).filter(F.col("_back") <= n)


def window_snapshot(
    df: DataFrame,
    order_cols: Sequence[str],
    key_cols: Sequence[str] = ("feature",),
    value_col: str = "value",
    window: int = 1000,
) -> DataFrame:
    """Current contents of each key's window: its last ``window`` values,
    oldest first, as ``values ARRAY<DOUBLE>`` plus ``win_count``."""
    keys = list(key_cols)
    src = df.select(*dict.fromkeys([*keys, *order_cols, value_col])).filter(F.col(value_col).isNotNull())
    return last_rows(src, keys, order_cols, window).groupBy(*keys).agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct((-F.col("_back")).alias("p"), F.col(value_col).alias("v")))),
            lambda s: s["v"],
        ).alias("values"),
        F.count(F.lit(1)).alias("win_count"),
    )
