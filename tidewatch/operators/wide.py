"""Count windows of several features of the same events, without unpivoting
them before the sort.

Long rows repeat an event's keys for each feature, in the shuffle of the sort
and in the table that it leaves. All features of an event have the same order,
so the events are sorted as they are, once, and written as one table without
any statistics; who reads it computes the statistics that are wanted, file by
file, and nothing of them is written.

A file holds a block of ``block`` rows of one range partition (one row group,
so that it is read whole, in order). Its first row carries ``_halo``: the last
N values of each feature before the block, as far as they are in its partition
and scope. What is before the partition (at most N values a feature for each of
the P partitions) is found from the partitions' last blocks and goes to all
tasks. So every block is finished where it lies, whatever reads it.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tidewatch.functions.window_kernel import window_stats
from tidewatch.operators.positions import PID, key_changes, range_sorted
from tidewatch.session import drop_table, materialize

#: rows of a block, at least; also at least ``HALOS`` windows
BLOCK, HALOS = 1 << 16, 64


def _numbers(column: pa.Array) -> np.ndarray:
    """Values with NaN where there is none."""
    return column.cast(pa.float64()).fill_null(np.nan).to_numpy(zero_copy_only=False)


def _key(batch: pa.RecordBatch, scope: Sequence[str], i: int) -> tuple:
    return tuple(batch.column(k)[i].as_py() for k in scope)


class _Held:
    """The last N values of each feature in the open segment (a scope's rows),
    and whether that segment reaches back to the partition's first row."""

    def __init__(self, scope: Sequence[str], features: int, n: int):
        self.scope, self.n = scope, n
        self.values, self.open, self.key = [np.zeros(0)] * features, True, None

    def changes(self, batch: pa.RecordBatch) -> np.ndarray:
        """Rows that begin a segment."""
        new = key_changes(batch, self.scope)
        new[0] = self.key is not None and _key(batch, self.scope, 0) != self.key
        self.key = _key(batch, self.scope, batch.num_rows - 1)
        return new

    def take(self, new: np.ndarray, cols: Sequence[np.ndarray], lo: int, hi: int) -> None:
        cut = np.flatnonzero(new[lo:hi])
        if len(cut):
            lo += int(cut[-1])
            self.values, self.open = [np.zeros(0)] * len(cols), False
        for i, c in enumerate(cols):
            c = c[lo:hi]
            self.values[i] = np.concatenate([self.values[i], c[~np.isnan(c)]])[-self.n :]

    def halo(self, empty: bool = False) -> bytes:
        """This as bytes (a column of structs of lists is slow to hand over)."""
        values = [v[:0] if empty else v for v in self.values]
        head = np.array([self.open and not empty, *map(len, values)], "<i8")
        return head.tobytes() + np.concatenate(values).astype("<f8").tobytes()

    def enter(self, halo: bytes) -> None:
        n = len(self.values)
        head = np.frombuffer(halo, "<i8", n + 1)
        self.open = bool(head[0])
        self.values = np.split(np.frombuffer(halo, "<f8", offset=8 * (n + 1)), np.cumsum(head[1:])[:-1])


class WideWindows:
    """Sorted events (see the module's head) and their window statistics;
    ``distinct``: no two have the same scope and place in the order."""

    def __init__(self, table: DataFrame, scope: Sequence[str], features: Sequence[str], window: int, block: int, before: dict,
                 distinct: bool = True):
        self.table, self.scope, self.features, self.window, self.block = table, list(scope), list(features), window, block
        self.before, self.distinct = table.sparkSession.sparkContext.broadcast(before), distinct

    def drop(self) -> None:
        """Delete the table, once all that reads it has been written."""
        drop_table(self.table)

    def _made(self, fields: Sequence[T.StructField], carry: bool):
        """A struct of ``fields`` for each feature of an event; with ``carry``
        a feature that is absent has those of its last value."""
        scope, features, window, block, before = self.scope, self.features, self.window, self.block, self.before
        names = [f.name for f in fields]
        step = max(8 * window, 8192)
        made_type = T.StructType([T.StructField(f, T.StructType(list(fields))) for f in features])
        inputs = [*scope, *features, PID, "_loc", "_halo"]

        def piece(held: _Held, new: np.ndarray, cols: list[np.ndarray], i: int) -> pa.Array:
            """Statistics of one feature on rows that follow ``held``."""
            seg = np.cumsum(new)
            there = ~np.isnan(cols[i])
            v, own = cols[i][there], seg[there]
            k = len(held.values[i])
            at = np.arange(len(v)) + k
            begins = own != np.concatenate(([0], own[:-1]))
            start = np.maximum.accumulate(np.where(begins, at, 0))
            every = np.concatenate([held.values[i], v])
            rows = np.concatenate(([k - 1], at)) if k else at  # the value before the rows, for the carry
            stats = window_stats(every, np.concatenate([np.zeros(k, np.int64), start]), window, rows.astype(np.int64), names=names)
            from_ = np.full(len(seg), -1)  # the row of ``stats`` that an event's statistics are
            from_[there] = np.arange(len(v)) + (k > 0)
            if carry:
                upto = np.cumsum(there) - 1
                whose = np.concatenate(([0], own))[upto + 1]
                from_ = np.where(whose == seg, upto + (k > 0), -1)
            none = from_ < 0
            out = []
            for f in fields:
                x = np.append(stats[f.name], stats[f.name][:0] if len(rows) else 0)[np.maximum(from_, 0)]
                out.append(pa.array(x, to_arrow_type(f.dataType), mask=none | (np.isnan(x) if x.dtype.kind == "f" else False)))
            return pa.StructArray.from_arrays(out, names)

        def read(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
            held, due = _Held(scope, len(features), window), None
            for b in batches:
                b = pa.RecordBatch.from_arrays(list(b), inputs)
                n = b.num_rows
                if not n:
                    yield pa.array([], to_arrow_type(made_type))
                    continue
                pid, loc = (b.column(c).to_numpy() for c in (PID, "_loc"))
                cols = [_numbers(b.column(f)) for f in features]
                new = held.changes(b)
                heads = np.flatnonzero(loc % block == 0)
                if (heads[:1].tolist() or [n])[0] > 0 and due != (pid[0], loc[0]):
                    raise RuntimeError("a block of the sorted table was not read from its first row on")
                made = []
                bounds = [*dict.fromkeys([0, *heads.tolist(), n])]
                for lo, hi in zip(bounds[:-1], bounds[1:]):
                    if loc[lo] % block == 0:
                        held.enter(b.column("_halo")[lo].as_py())
                        new[lo] = False  # the halo is that of the row's own scope
                        key, far = before.value.get(int(pid[lo]), (None, []))
                        if held.open and far and key == _key(b, scope, lo):
                            held.values = [np.concatenate(x)[-window:] for x in zip(far, held.values)]
                    for a in range(lo, hi, step):
                        z = min(a + step, hi)
                        part = [c[a:z] for c in cols]
                        made.append(pa.StructArray.from_arrays([piece(held, new[a:z], part, i) for i in range(len(features))], features))
                        held.take(new, cols, a, z)
                due = (pid[n - 1], loc[n - 1] + 1)
                yield pa.concat_arrays(made)

        return F.arrow_udf(read, made_type).asNondeterministic()(*[F.col(c) for c in inputs])  # reads rows in their order

    def statistics(self, fields: Sequence[T.StructField], keep: Sequence[str]) -> DataFrame:
        """Long rows ``keep`` (columns of the table, ``feature`` and ``value``)
        with ``fields``, one for each feature that an event has."""
        from tidewatch.sources.events import unpivot_features

        ids = [c for c in keep if c not in ("feature", "value")]
        made = self.table.select(*ids, *self.features, self._made(fields, False).alias("_made"))
        return unpivot_features(made, ids, self.features, along="_made").select(*keep, *[f.name for f in fields])

    def zscores(self, keep: Sequence[str], carry: bool = True) -> DataFrame:
        """One row per event: ``keep``, ``z_<feature>`` as of the event (with
        ``carry`` an absent feature has that of its last value, whose window is
        still the same), and the row's place (``_pid``, ``_loc``) in the order."""
        made = self._made([T.StructField("zscore", T.DoubleType())], carry)
        rows = self.table.select(*keep, PID, "_loc", made.alias("_made"))
        return rows.select(*keep, *[F.col(f"_made.{f}.zscore").alias(f"z_{f}") for f in self.features], PID, "_loc")


def wide_windows(
    events: DataFrame,
    order_cols: Sequence[str],
    features: Sequence[str],
    scope_cols: Sequence[str] = (),
    window: int = 1000,
    keep: Sequence[str] = (),
    num_partitions: int | None = None,
    block: int | None = None,
) -> WideWindows:
    """Sort ``events`` by ``(scope_cols, order_cols)`` and write them with what
    their windows need. NULL and NaN features are absent: they enter no window.
    Python sees keys and features alone."""
    scope, features = list(scope_cols), list(features)
    block = block or max(BLOCK, HALOS * window)
    others = list(dict.fromkeys([*scope, *order_cols, *keep]))
    src = events.select(*others, *[F.nanvl(F.col(f).cast("double"), F.lit(None).cast("double")).alias(f) for f in features])
    ranged = range_sorted(src, [*scope, *order_cols], num_partitions)
    place = list(dict.fromkeys([*scope, *order_cols]))
    inputs = [*place, *features, "_loc"]
    made_type = T.StructType([T.StructField("_halo", T.BinaryType()), T.StructField("_same", T.BooleanType())])

    def halos(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        held, last = _Held(scope, len(features), window), None
        for b in batches:
            b = pa.RecordBatch.from_arrays(list(b), inputs)
            n = b.num_rows
            if not n:
                yield pa.array([], to_arrow_type(made_type))
                continue
            same = ~key_changes(b, place)
            same[0], last = last is not None and _key(b, place, 0) == last, _key(b, place, n - 1)
            cols = [_numbers(b.column(f)) for f in features]
            new, lo, made = held.changes(b), 0, []
            for i in np.flatnonzero(b.column("_loc").to_numpy() % block == 0).tolist():
                held.take(new, cols, lo, i)
                made += [pa.nulls(i - lo - bool(made), pa.binary()), pa.array([held.halo(empty=new[i])], pa.binary())]
                lo = i
            held.take(new, cols, lo, n)
            made.append(pa.nulls(n - lo - bool(made), pa.binary()))
            yield pa.StructArray.from_arrays([pa.concat_arrays(made), pa.array(same)], ["_halo", "_same"])

    carried = F.arrow_udf(halos, made_type).asNondeterministic()
    rows = ranged.select(*others, *features, PID, "_loc", carried(*[F.col(c) for c in inputs]).alias("_made"))
    rows = rows.select(*others, *features, PID, "_loc", "_made.*")
    # one file a block, one row group a file
    table = materialize(rows, "wide", lean=True, maxRecordsPerFile=block, **{"parquet.block.size": 1 << 30})
    distinct = not table.filter("_same").limit(1).count()
    return WideWindows(table, scope, features, window, block, _before(table, scope, features, window, block), distinct)


def _before(table: DataFrame, scope: list[str], features: list[str], window: int, block: int) -> dict:
    """What is before each partition: ``{_pid: (scope, values of each feature)}``."""
    ends = table.groupBy(PID).agg(F.max("_loc").alias("_end"))
    last = table.join(F.broadcast(ends), PID).filter(F.col("_loc") >= F.expr(f"_end - _end % {block}"))
    schema = T.StructType([T.StructField(PID, T.IntegerType()), *(table.schema[k] for k in scope),
                           T.StructField("_held", T.BinaryType())])
    names = [f.name for f in schema.fields]

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, mine = None, None
        for b in batches:
            loc, pid = b.column("_loc").to_numpy(), b.column(PID).to_numpy()
            heads = np.flatnonzero(loc % block == 0).tolist()
            for lo, hi in zip(bounds := [*dict.fromkeys([0, *heads])], [*bounds[1:], b.num_rows]):
                if lo == hi:
                    continue
                part = b.slice(lo, hi - lo)
                if loc[lo] % block == 0:
                    if held is not None:
                        yield row(mine, held)
                    held, mine = _Held(scope, len(features), window), int(pid[lo])
                    held.enter(part.column("_halo")[0].as_py())
                cols = [_numbers(part.column(f)) for f in features]
                held.take(held.changes(part), cols, 0, hi - lo)
        if held is not None:
            yield row(mine, held)

    def row(mine: int, held: _Held) -> pa.RecordBatch:
        types = [to_arrow_type(f.dataType) for f in schema.fields]
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip([mine, *held.key, held.halo()], types)], names)

    found = last.select(PID, "_loc", *scope, *features, "_halo").mapInArrow(tails, schema).toArrow().sort_by(PID).to_pylist()
    before, key, values = {}, None, None
    for r in found:
        pid, own = r[PID], tuple(r[k] for k in scope)
        if values is not None:
            before[pid] = (key, values)
        held = _Held(scope, len(features), window)
        held.enter(r["_held"])
        if held.open and values is not None and own == key:
            held.values = [np.concatenate(x)[-window:] for x in zip(values, held.values)]
        key, values = own, held.values
    return before
