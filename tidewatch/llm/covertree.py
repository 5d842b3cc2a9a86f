"""Hard-negative mining by cover trees over norm-augmented candidates.

Vectors are integers. Each candidate ``x`` gets one more coordinate,
``sqrt(M^2 - |x|^2)`` with ``M`` the largest norm, so all lie on one sphere
and the inner product with a query falls with the angle alone: a node whose
points lie within the angle ``r`` of its centre holds inner products between
``|q| M cos(a + r)`` and ``|q| M cos(a - r)``, ``a`` the query's angle to the
centre.

* Cells: the top of the tree is fitted to a sample of at most ``SAMPLE`` rows
  and cut where it has at most ``MAX_CELLS`` nodes. Every row goes to its
  nearest cell; a cell's covering radius and count are aggregated over all of
  its rows, so the sample decides speed and never results.
* Trees: a cell is dealt by hash to chunks of bounded size (a hot cell to
  many), and each chunk becomes one cover tree: level ``i`` is a net of radius
  ``R / BASE^i`` whose centres lie further apart than that, a node's first
  child keeps its centre, and each node has the covering radius of its points.
  A node whose next net would hardly group its points is a leaf.
* Search: a query goes to the cells whose bounds meet its window, and to each
  chunk of those. A chunk is read once by a task and its queries stream past
  in blocks; nodes are taken best bound first, nodes outside all open windows
  are skipped, leaves are verified exactly, and a window closes when its k-th
  score is above the best bound left. The chunks' best k meet in one ranking.

``mine_hard_negatives`` first asks each anchor's own cell for its positives,
then the cells that can still hold better ones, and then searches the
windows that the positives open, for rows of another label.

Scores are exact: products run in doubles while they stay under 2^53, else in
64-bit integers.

Defined results: rows without a label or vector, or with a component that is
null, not finite, or beyond 2^27 once scaled take no part; rows repeated in
full count once; rows sharing an id are separate rows but none of them is
another row to its anchor; a null id is never an anchor and ranks behind
others of its score; a shorter vector counts as filled up with zeros; an
anchor without positives gives no row; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from tidewatch.session import materialize

SAMPLE, MAX_CELLS = 4096, 256
#: rows of a chunk at most, and chunks at least (for the cluster's cores)
CHUNK_ROWS, MIN_CHUNKS = 16_384, 16
BASE, LEAF = 1.3, 64
#: queries searched at a time, points verified at a time
BLOCK, POINTS = 256, 2048
LIMIT = 2**27


def scaled_vectors(rows: DataFrame, vec_id: str, vector: str, label: Column, scale: float = 256.0) -> DataFrame:
    """(vec_id, label, v): whole vectors ``floor(scale * x)`` of the rows that take part."""
    v = F.transform(vector, lambda x: F.floor(x.cast("double") * scale))
    fit = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double") * scale) <= LIMIT, F.lit(False)))
    own = rows.filter(F.col(vector).isNotNull() & label.isNotNull() & fit)
    return own.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), v.alias("v"))


def _matrix(column: pa.Array, width: int = 0) -> np.ndarray:
    """Lists of whole numbers as rows of doubles, filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    off = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)[off[0] : off[-1]]
    n = np.diff(off)
    out = np.zeros((len(n), max(width, int(n.max(initial=0)))))
    at = np.repeat(np.arange(len(n)), n)
    out[at, np.arange(len(flat)) - np.repeat(off[:-1] - off[0], n)] = flat
    return out


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of rows of whole numbers, as 64-bit integers."""
    width = max(a.shape[1], b.shape[1])
    a, b = _wide(a, width), _wide(b, width)
    if width * np.abs(a).max(initial=0) * np.abs(b).max(initial=0) < 2**53:
        return (a @ b.T).astype(np.int64)
    return a.astype(np.int64) @ b.astype(np.int64).T


def _more(df: DataFrame, **types: str) -> StructType:
    schema = StructType(list(df.schema.fields))
    for name, kind in types.items():
        schema = schema.add(name, kind)
    return schema


class CoverTree:
    """A cover tree over rows of ``points``; node 0 is the root. Of each node:
    the row in its centre, its covering radius, its rows, its children."""

    def __init__(self, points: np.ndarray, largest: float, leaf: int = LEAF):
        self.points, self.largest = points, largest
        self.rest = np.sqrt(np.maximum(largest**2 - (points * points).sum(axis=1), 0))
        n = len(points)
        everything = np.arange(n)
        d = self._angles(0, everything) if n else np.zeros(0)
        top = float(d.max(initial=0))
        self.centre, self.radius, self.members, self.children = [0], [top], [everything], [()]
        self.level_of = [0]
        todo = [0] if n else []
        while todo:
            node = todo.pop()
            own, r = self.members[node], self.radius[node]
            if len(own) <= leaf or r == 0:
                continue
            level = self.level_of[node] + 1
            while top / BASE**level >= r:
                level += 1
            parts = self._net(self.centre[node], own, top / BASE**level, max(2, len(own) // 4))
            if parts is None:
                continue
            kids = range(len(self.centre), len(self.centre) + len(parts))
            for centre, radius, members in parts:
                self.centre.append(centre)
                self.radius.append(radius)
                self.members.append(members)
                self.children.append(())
                self.level_of.append(level)
            self.children[node] = tuple(kids)
            todo.extend(kids)

    def _angles(self, centre: int, others: np.ndarray) -> np.ndarray:
        """Angles between augmented points (0 if all vectors are 0)."""
        if self.largest == 0:
            return np.zeros(len(others))
        dot = self.points[others] @ self.points[centre] + self.rest[others] * self.rest[centre]
        angle = np.arccos(np.clip(dot / self.largest**2, -1, 1))
        # arccos cannot tell small angles from 0: equal points are 0 apart
        same = (angle < 1e-6) & (self.points[others] == self.points[centre]).all(axis=1)
        return np.where(same, 0.0, angle)

    def _net(self, centre: int, own: np.ndarray, r: float, most: int) -> list | None:
        """Centres more than ``r`` apart, each with the points within ``r`` of
        it; None if there are more than ``most``."""
        out = []
        while len(own):
            d = self._angles(centre, own)
            near = d <= r
            out.append((centre, float(d[near].max(initial=0)), own[near]))
            own = own[~near]
            if len(out) > most:
                return None
            if len(own):
                centre = int(own[0])
        return out

    def cut(self, most: int) -> list[int]:
        """Centres of the deepest frontier of at most ``most`` nodes."""
        frontier = [0]
        while True:
            deeper = [c for n in frontier for c in (self.children[n] or (n,))]
            if len(deeper) > most or len(deeper) == len(frontier):
                return [self.centre[n] for n in frontier]
            frontier = deeper


def _bounds(dot: np.ndarray, norms: np.ndarray, radius: np.ndarray, largest: float) -> tuple[np.ndarray, np.ndarray]:
    """Least and greatest inner product of queries (rows) with nodes (columns)."""
    reach = (norms * largest)[:, None]
    angle = np.arccos(np.clip(np.divide(dot, reach, out=np.zeros_like(dot), where=reach > 0), -1, 1))
    slack = 1 + reach * 1e-7  # arccos of a rounded cosine
    low = reach * np.cos(np.minimum(angle + radius, np.pi)) - slack
    return low, reach * np.cos(np.maximum(angle - radius, 0)) + slack


@dataclass
class Queries:
    """Vectors and, by (query, window), the lowest and highest score wanted."""

    vectors: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    of: np.ndarray  # window -> query
    low: np.ndarray
    high: np.ndarray


def best_first(
    tree: CoverTree, ids: np.ndarray, known: np.ndarray, labels: np.ndarray, asked: Queries, same_label: bool, k: int, seen=None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(window, score, point) of the ``k`` highest scores in each window, among
    points of the same (or another) label and another id."""
    n = len(asked.of)
    norms = np.sqrt((asked.vectors * asked.vectors).sum(axis=1))
    floor = asked.low.astype(np.int64)  # rises to a window's k-th score
    hits = np.zeros((0, 3), np.int64)
    heap = [(-np.inf, 0, np.arange(n), np.full(n, np.inf))] if n and len(ids) else []
    while heap:
        _, node, rows, best = heapq.heappop(heap)
        alive = best >= floor[rows]
        rows = rows[alive]
        if not len(rows):
            continue
        if seen is not None:
            seen[0] += 1
        queries, at = np.unique(asked.of[rows], return_inverse=True)
        kids = tree.children[node]
        if kids:
            centres = tree.points[[tree.centre[c] for c in kids]]
            width = max(centres.shape[1], asked.vectors.shape[1])
            dot = _wide(asked.vectors[queries], width) @ _wide(centres, width).T
            low, high = _bounds(dot, norms[queries], np.array([tree.radius[c] for c in kids]), tree.largest)
            low, high = low[at], high[at]
            clipped = np.minimum(high, asked.high[rows][:, None])
            meets = (clipped >= floor[rows][:, None]) & (low <= asked.high[rows][:, None])
            for j, c in enumerate(kids):
                on = np.flatnonzero(meets[:, j])
                if len(on):
                    heapq.heappush(heap, (-float(clipped[on, j].max()), c, rows[on], clipped[on, j]))
            continue
        members = tree.members[node]
        for lo in range(0, len(members), POINTS):
            own = members[lo : lo + POINTS]
            score = products(asked.vectors[queries], tree.points[own])
            fits = (labels[own] == asked.labels[queries][:, None]) == same_label
            fits &= ~known[own] | (ids[own] != asked.ids[queries][:, None])
            wanted, fits = score[at], fits[at]
            fits &= (wanted >= floor[rows][:, None]) & (wanted <= asked.high[rows][:, None])
            if len(own) > k:  # only what can be among this part's best k
                ranked = np.where(fits, wanted, np.iinfo(np.int64).min)
                fits &= ranked >= np.partition(ranked, -k, axis=1)[:, -k][:, None]
            r, p = np.nonzero(fits)
            if not len(r):
                continue
            hits = np.vstack([hits, np.column_stack([rows[r], wanted[r, p], own[p]])])
            order = np.lexsort((ids[hits[:, 2]], ~known[hits[:, 2]], -hits[:, 1], hits[:, 0]))
            hits = hits[order]
            rank = np.arange(len(hits)) - np.searchsorted(hits[:, 0], hits[:, 0])
            hits = hits[rank < k]
            last = hits[rank[rank < k] == k - 1]
            floor[last[:, 0]] = np.maximum(floor[last[:, 0]], last[:, 1])
    return hits[:, 0], hits[:, 1], hits[:, 2]


@dataclass
class Forest:
    """The chunks' rows, the cells' centres and radii, and the largest norm."""

    rows: DataFrame  # chunk, cell, vec_id, label, v
    centres: np.ndarray
    radius: np.ndarray
    chunks: np.ndarray  # of each cell
    largest: float

    def route(self, queries: DataFrame, low: Callable, high: Callable, skip_home: bool = False) -> DataFrame:
        """Each query once for every chunk whose cell's bounds meet a window.

        ``low`` and ``high`` give a batch's windows as (queries, windows) arrays."""
        centres, radius, chunks, largest = self.centres, self.radius, self.chunks, self.largest
        first = np.concatenate(([0], np.cumsum(chunks)))

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for lo in range(0, b.num_rows, 1024):
                    part = b.slice(lo, 1024)
                    q = _matrix(part.column("v"))
                    width = max(q.shape[1], centres.shape[1])
                    dot = _wide(q, width) @ _wide(centres, width).T
                    least, most = _bounds(dot, np.sqrt((q * q).sum(axis=1)), radius, largest)
                    a, z = low(part), high(part)
                    meets = ((most[:, :, None] >= a[:, None, :]) & (least[:, :, None] <= z[:, None, :])).any(axis=2)
                    if skip_home:
                        meets[np.arange(len(q)), part.column("cell").to_numpy()] = False
                    at, cell = np.nonzero(meets & (chunks > 0))
                    n = chunks[cell]
                    chunk = np.repeat(first[cell], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    sent = part.take(pa.array(np.repeat(at, n)))
                    yield sent.append_column("to", pa.array(chunk.astype(np.int64)))

        return queries.mapInArrow(work, _more(queries, to="long"))

    def search(self, routed: DataFrame, windows: Callable, same_label: bool, k: int, out: str) -> DataFrame:
        """(anchor_id, anchor, window, score, found) for each routed query and
        chunk: at most ``k`` a window. ``windows`` gives a batch's windows as
        lists (query row, low, high)."""
        largest = self.largest
        n = max(int(self.rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
        nothing = {f.name: F.lit(None).cast(f.dataType) for f in routed.schema if f.name not in ("to", "v", "vec_id", "label")}
        points = self.rows.select(F.col("chunk").alias("to"), "vec_id", "label", "v", *(c.alias(x) for x, c in nothing.items()))
        both = points.withColumn("_asks", F.lit(False)).unionByName(routed.withColumn("_asks", F.lit(True)))
        dealt = both.repartition(n, "to").sortWithinPartitions("to", "_asks")

        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            chunk, held, tree = None, [], None
            for b in batches:
                to = b.column("to").to_numpy()
                asks = b.column("_asks").to_numpy(zero_copy_only=False)
                edges = np.flatnonzero((np.diff(to) != 0) | (np.diff(asks) != 0)) + 1
                for lo, hi in zip(np.r_[0, edges], np.r_[edges, len(to)], strict=True):
                    if to[lo] != chunk:
                        chunk, held, tree = to[lo], [], None
                    part = b.slice(lo, hi - lo)
                    if not asks[lo]:
                        held.append(part.select(["vec_id", "label", "v"]))
                        continue
                    if not held:
                        continue  # no point in this chunk
                    if tree is None:
                        tree = _grown(held, largest)
                    for at in range(0, part.num_rows, BLOCK):
                        yield _answers(*tree, part.slice(at, BLOCK), windows, same_label, k)

        return dealt.mapInArrow(work, out)


def _grown(held: list[pa.RecordBatch], largest: float) -> tuple[CoverTree, np.ndarray, np.ndarray, np.ndarray]:
    """A chunk's tree, and its points' ids, known ids and labels; each distinct row once."""
    table = pa.Table.from_batches(held).combine_chunks()
    points = _matrix(table.column("v"))
    ids = table.column("vec_id").fill_null(0).to_numpy()
    known = table.column("vec_id").is_valid().to_numpy()
    labels = table.column("label").to_numpy()
    # a fixed order, whatever order the rows came in
    whole = np.column_stack([~known, ids, labels, points.astype(np.int64)])
    _, first = np.unique(whole, axis=0, return_index=True)
    return CoverTree(points[first], largest), ids[first], known[first], labels[first]


def _answers(tree, ids, known, labels, part: pa.RecordBatch, windows: Callable, same_label: bool, k: int) -> pa.RecordBatch:
    of, low, high, extra = windows(part)
    asked = Queries(
        _matrix(part.column("v")), part.column("vec_id").to_numpy(), part.column("label").to_numpy(), of, low, high
    )
    window, score, point = best_first(tree, ids, known, labels, asked, same_label, k)
    row = pa.array(of[window])
    cols = {c: part.column(c).take(row) for c in ("vec_id", "anchor")}
    cols |= {c: pa.array(x[window]) for c, x in extra.items()}
    cols |= {"score": pa.array(score), "found": pa.array(ids[point], mask=~known[point])}
    return pa.RecordBatch.from_arrays(list(cols.values()), list(cols))


def build_forest(vectors: DataFrame) -> Forest:
    """Cells, chunks and bounds of (vec_id, label, v) rows."""
    norm = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    keyed = vectors.withColumn("key", F.xxhash64("vec_id", "label", "v"))
    own = materialize(keyed.withColumn("norm2", norm), "vectors")
    total = own.agg(F.count(F.lit(1)).alias("n"), F.max("norm2").alias("m")).first()
    largest = float(np.sqrt(total["m"] or 0.0)) * (1 + 1e-12)
    # a bounded sample fits the cells; every row is indexed
    head = own.orderBy("key").limit(SAMPLE).select("v").toArrow()
    sample = CoverTree(_matrix(head.column("v")), largest, leaf=1) if total["n"] else None
    centres = sample.points[sample.cut(MAX_CELLS)] if sample else np.zeros((1, 1))
    rest = np.sqrt(np.maximum(largest**2 - (centres * centres).sum(axis=1), 0))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("v"))
            width = max(x.shape[1], centres.shape[1])
            own_rest = np.sqrt(np.maximum(largest**2 - (x * x).sum(axis=1), 0))
            dot = _wide(x, width) @ _wide(centres, width).T + own_rest[:, None] * rest
            cell = dot.argmax(axis=1) if len(x) else np.zeros(0, np.int64)
            cos = dot[np.arange(len(x)), cell] / largest**2 if largest else np.ones(len(x))
            # up to the error of arccos: radii cover all the same
            far = np.arccos(np.clip(cos, -1, 1)) + 1e-6
            yield b.append_column("cell", pa.array(cell.astype(np.int64))).append_column("far", pa.array(far))

    own = own.drop("norm2")
    placed = materialize(own.mapInArrow(assign, _more(own, cell="long", far="double")), "cells")
    radius, counts = np.zeros(len(centres)), np.zeros(len(centres), np.int64)
    for r in placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("far").alias("far")).collect():
        radius[r["cell"]], counts[r["cell"]] = r["far"], r["n"]
    size = max(1, min(CHUNK_ROWS, -(-total["n"] // MIN_CHUNKS)))
    chunks = -(-counts // size)
    first = np.concatenate(([0], np.cumsum(chunks)))[:-1]
    many, start = (F.array(*(F.lit(int(x)) for x in y)) for y in (np.maximum(chunks, 1), first))
    at = F.col("cell").cast("int")
    chunk = F.get(start, at) + F.pmod("key", F.get(many, at).cast("long"))
    rows = placed.select(chunk.cast("long").alias("chunk"), "cell", F.col("key").alias("anchor"), "vec_id", "label", "v")
    return Forest(rows, centres, radius, chunks, largest)


def mine_hard_negatives(
    vectors: DataFrame,
    is_anchor: Column,
    positives: int = 5,
    negatives: int = 3,
    low_pct: int = 50,
    high_pct: int = 95,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    For each anchor its ``positives`` best rows of the same label, and for each
    of those the ``negatives`` best rows of another label whose score lies
    between ``low_pct`` and ``high_pct`` per cent of the positive's."""
    forest = build_forest(vectors)
    anchors = forest.rows.filter(is_anchor).select("vec_id", "label", "v", "cell", "anchor")
    anchors = materialize(anchors.dropDuplicates(["vec_id", "anchor"]), "anchors")
    least, most = -(2.0**63), 2.0**63

    def from_floor(part: pa.RecordBatch):
        low = part.column("floor").fill_null(np.iinfo(np.int64).min).to_numpy()
        return np.arange(part.num_rows), low, np.full(part.num_rows, np.iinfo(np.int64).max), {}

    def floors(part: pa.RecordBatch) -> np.ndarray:
        return part.column("floor").cast(pa.float64()).fill_null(least).to_numpy(zero_copy_only=False)[:, None]

    def ceiling(part: pa.RecordBatch) -> np.ndarray:
        return np.full((part.num_rows, 1), most)

    ranked = Window.partitionBy("vec_id", "anchor").orderBy(F.desc("score"), F.asc_nulls_last("found"))
    hit = "vec_id long, anchor long, score long, found long"

    def nearest(routed: DataFrame) -> DataFrame:
        return forest.search(routed, from_floor, True, positives, hit)

    # a query's own cell first: its k-th score there is a floor everywhere else
    chunks = F.array(*(F.lit(int(x)) for x in forest.chunks))
    first = F.array(*(F.lit(int(x)) for x in np.concatenate(([0], np.cumsum(forest.chunks)))))
    at = F.col("cell").cast("int")
    open_ended = anchors.withColumn("floor", F.lit(None).cast("long"))
    begin = F.get(first, at)
    home = open_ended.withColumn("to", F.explode(F.sequence(begin, begin + F.get(chunks, at) - 1)))
    home = home.withColumn("to", F.col("to").cast("long"))
    near = materialize(nearest(home).withColumn("rank", F.row_number().over(ranked)).filter(F.col("rank") <= positives), "near")
    kth = near.filter(F.col("rank") == positives).select("vec_id", "anchor", F.col("score").alias("floor"))
    known = anchors.join(kth, ["vec_id", "anchor"], "left").select(*anchors.columns, "floor")
    further = nearest(forest.route(known, floors, ceiling, skip_home=True))
    best = near.drop("rank").unionByName(further).withColumn("rank", F.row_number().over(ranked))
    found = best.filter(F.col("rank") <= positives).groupBy("vec_id", "anchor")
    found = found.agg(F.sort_array(F.collect_list(F.struct("rank", "found", "score"))).alias("p"))
    pairs = anchors.join(found, ["vec_id", "anchor"]).select(
        *anchors.columns,
        F.transform("p", lambda x: x["score"]).alias("scores"),
        F.transform("p", lambda x: x["found"]).alias("positives"),
    )
    pairs = materialize(pairs, "positives")

    def opened(part: pa.RecordBatch):
        """Windows: low_pct * p <= 100 * n <= high_pct * p in whole numbers."""
        lists = part.column("scores")
        off = lists.offsets.to_numpy()
        p = lists.values.to_numpy()[off[0] : off[-1]]
        of = np.repeat(np.arange(part.num_rows), np.diff(off))
        low = -(-(low_pct * p) // 100)
        high = (high_pct * p) // 100
        ids = part.column("positives")
        names = ids.values.slice(off[0], off[-1] - off[0])
        j = np.arange(len(p)) - np.repeat(off[:-1] - off[0], np.diff(off))
        on = low <= high
        extra = {
            "j": j[on].astype(np.int64),
            "positive": np.array(names.fill_null(0).to_numpy()[on]),
            "named": names.is_valid().to_numpy(zero_copy_only=False)[on],
            "positive_score": p[on],
        }
        return of[on], low[on], high[on], extra

    def padded(part: pa.RecordBatch, pct: int, up: bool) -> np.ndarray:
        lists = part.column("scores")
        off = lists.offsets.to_numpy()
        p = lists.values.to_numpy()[off[0] : off[-1]]
        out = np.full((part.num_rows, positives), most if up else -most)
        at = np.repeat(np.arange(part.num_rows), np.diff(off))
        out[at, np.arange(len(p)) - np.repeat(off[:-1] - off[0], np.diff(off))] = pct / 100 * p
        return out

    # windows that do not exist are (most, -most): nothing meets them
    routed = forest.route(pairs, lambda b: padded(b, low_pct, True), lambda b: padded(b, high_pct, False))
    hits = forest.search(
        routed,
        opened,
        False,
        negatives,
        "vec_id long, anchor long, j long, positive long, named boolean, positive_score long, score long, found long",
    )
    order = Window.partitionBy("vec_id", "anchor", "j").orderBy(F.desc("score"), F.asc_nulls_last("found"))
    last = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    return last.select(
        F.col("vec_id").alias("anchor_id"),
        F.when(F.col("named"), F.col("positive")).alias("positive_id"),
        "rank",
        F.col("found").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
