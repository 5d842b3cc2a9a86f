"""Ranked lexical search by hashed max-sketches with exact rescoring.

``build_index`` turns each document into one row: its number of terms, its
distinct terms as sorted 64-bit hashes with their frequencies, and a sketch.
The sketch has two rows of ``B`` byte slots (``B`` a power of two, at least
``SLOTS`` for each distinct term); every term folds its impact into one slot
of each row, and a slot keeps the maximum. An impact grows with the frequency
and only with it inside one document, so slots hold frequencies (255 stands
for 255 and more) and become impacts when N and L are known.

``search`` takes queries in blocks. A batch of documents looks up all query
terms of the block at once (the smaller of a term's two slots bounds its
frequency) and one matrix product gives an upper bound for each (document,
query). Documents are then rescored exactly from their term lists in the
order of descending bounds, until no bound reaches the query's threshold, the
score of its k-th best document so far in the task. The tasks' best k meet in
one ranking a query. Nothing is lost: a document that was not rescored has a
bound, and so a score, below k others.

Scores are those of the contract: a term's weight is
``floor(1000 * ln((2N + 2) / (2df + 1)))`` in doubles, all else 64-bit
integers. Terms are compared by 64-bit hash.

Queries travel by broadcast in blocks of about ``block_rows`` (query, term)
rows, whatever their number; a block is one scan of the index.

Defined results: null and empty texts have no terms, are found by nothing and
find nothing, and do not count in N; repeated rows of documents are documents
of their own (equal result rows but for the rank), repeated rows of queries
are one query, rows sharing an id but not a text are queries of their own; a
null doc_id ranks behind others of its score; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.textkit import buffer_of, slices, word_hashes
from tidewatch.session import materialize

#: slots in each row of a sketch for each distinct term, at least
SLOTS = 2
SMALLEST = 64
#: documents rescored at a time, the most (document, query) scores and the
#: bytes of index rows held
ROUND, HELD, LISTED = 4096, 2_000_000, 16 << 20

_TERM = np.full(256, 0x20, np.uint8)
for _lo, _hi in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B), (0x80, 0x100)):
    _TERM[_lo:_hi] = np.arange(_lo, _hi)

_U = np.uint64


def term_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all terms of each text in order, and offsets into them."""
    buf, off = buffer_of(texts)
    return word_hashes(_TERM[buf], off, lower=True)


def sketch_sizes(distinct: np.ndarray) -> np.ndarray:
    """Slots in a row of the sketch of texts with so many distinct terms."""
    want = np.maximum(distinct * SLOTS, SMALLEST)
    return 1 << np.ceil(np.log2(want)).astype(np.int64)


def _slots(hashes: np.ndarray, size: np.ndarray | int) -> tuple[np.ndarray, np.ndarray]:
    """A term's slot in the first and in the second row."""
    mask = np.asarray(size, dtype=np.int64).astype(_U) - _U(1)
    return (hashes & mask).astype(np.int64), ((hashes >> _U(32)) & mask).astype(np.int64)


def _packed(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Binary values cut out of one array at the given offsets (in entries)."""
    data = np.ascontiguousarray(values)
    off = (ends * data.itemsize).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer(off), pa.py_buffer(data)])


def _unpacked(column: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """All entries of a binary column as one array, and each row's offsets."""
    buf, off = _buffer(column)
    size = np.dtype(dtype).itemsize
    return buf.view(dtype), off // size


def _buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return np.ascontiguousarray(raw), offsets - offsets[0]


def _parts(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """Slices of index rows of at most ``rows`` rows and about ``LISTED`` bytes."""
    size = np.cumsum(sum(np.diff(_buffer(batch.column(c))[1]) for c in ("terms", "sketch")))
    lo = 0
    while lo < batch.num_rows:
        upto = (size[lo - 1] if lo else 0) + LISTED
        hi = min(max(int(np.searchsorted(size, upto, side="right")), lo + 1), lo + rows, batch.num_rows)
        yield batch.slice(lo, hi - lo)
        lo = hi


def _index_rows(part: pa.RecordBatch) -> pa.RecordBatch:
    hashes, off = term_hashes(part.column("text"))
    lists, tfs, distinct = [], [], np.zeros(part.num_rows, np.int64)
    for i in range(part.num_rows):
        own, tf = np.unique(hashes[off[i] : off[i + 1]], return_counts=True)
        lists.append(own)
        tfs.append(tf)
        distinct[i] = len(own)
    terms = np.concatenate(lists) if lists else np.zeros(0, _U)
    tf = (np.concatenate(tfs) if tfs else np.zeros(0)).astype(np.uint32)
    sizes = sketch_sizes(distinct)
    base = np.concatenate(([0], np.cumsum(2 * sizes)))
    sketch = np.zeros(base[-1], np.uint8)
    wide = np.repeat(sizes, distinct)
    first, second = _slots(terms, wide)
    start = np.repeat(base[:-1], distinct)
    low = np.minimum(tf, 255).astype(np.uint8)
    np.maximum.at(sketch, start + first, low)
    np.maximum.at(sketch, start + wide + second, low)
    ends = np.concatenate(([0], np.cumsum(distinct)))
    return pa.RecordBatch.from_arrays(
        [
            part.column("doc_id").cast(pa.int64()),
            pa.array(np.diff(off)),
            _packed(sketch, base).cast(pa.binary()),
            _packed(terms, ends).cast(pa.binary()),
            _packed(tf, ends).cast(pa.binary()),
        ],
        ["doc_id", "n_terms", "sketch", "terms", "tfs"],
    )


def build_index(docs: DataFrame) -> DataFrame:
    """(doc_id, n_terms, sketch, terms, tfs) of every row with a term."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                yield _index_rows(part)

    rows = docs.filter("text is not null").select("doc_id", "text")
    schema = "doc_id long, n_terms long, sketch binary, terms binary, tfs binary"
    return materialize(rows.mapInArrow(work, schema).filter("n_terms > 0"), "lexical-index")


def query_terms(items: DataFrame) -> DataFrame:
    """(query, item_id, term): the distinct terms of each distinct query row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                hashes, off = term_hashes(part.column("text"))
                at = pa.array(np.repeat(np.arange(part.num_rows), np.diff(off)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("query").take(at), part.column("item_id").cast(pa.int64()).take(at), pa.array(hashes.view(np.int64))],
                    ["query", "item_id", "term"],
                )

    rows = items.filter("text is not null").select(F.xxhash64("item_id", "text").alias("query"), "item_id", "text")
    return rows.mapInArrow(work, "query long, item_id long, term long").distinct()


def term_counts(index: DataFrame, wanted: np.ndarray) -> DataFrame:
    """(term, df): how many documents hold each of the sorted ``wanted`` terms."""
    shared = index.sparkSession.sparkContext.broadcast(wanted)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = shared.value
        found = np.zeros(len(keys), np.int64)
        for b in batches:
            terms, _ = _unpacked(b.column("terms"), _U)
            at = np.minimum(np.searchsorted(keys, terms), len(keys) - 1)
            found += np.bincount(at[keys[at] == terms], minlength=len(keys))
        held = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(keys[held].view(np.int64)), pa.array(found[held])], ["term", "n"])

    parts = index.select("terms").mapInArrow(work, "term long, n long")
    return parts.groupBy("term").agg(F.sum("n").alias("df"))


class QueryBlock:
    """The terms of some queries: sorted hashes, weights, and for each term
    the queries that hold it."""

    def __init__(self, query: np.ndarray, item_id: list, term: np.ndarray, weights: dict[int, int], n_docs: int, n_terms: int):
        order = np.lexsort((query, term))
        query, term = query[order], term[order]
        self.terms, first, no = np.unique(term, return_index=True, return_inverse=True)
        self.queries, number = np.unique(query, return_inverse=True)
        ids = dict(zip(query.tolist(), (item_id[i] for i in order), strict=True))
        self.item_ids = [ids[q] for q in self.queries.tolist()]
        self.starts = np.append(first, len(term))
        self.holders = number  # queries by term, cut at ``starts``
        self.weights = np.array([weights.get(int(t), 0) for t in self.terms.view(np.int64)], np.int64)
        self.n_docs, self.n_terms = n_docs, n_terms
        self.matrix = np.zeros((len(self.terms), len(self.queries)), np.float32)
        self.matrix[no, number] = self.weights[no]
        most = int(np.bincount(number).max()) if len(number) else 0
        #: single precision, rounded at each of a query's terms
        self.slack = np.float32(1 + (most + 16) * 2.0**-23)

    def lengths(self, n: np.ndarray) -> np.ndarray:
        """m of documents with so many terms."""
        if 50 * int(n.max(initial=0)) * self.n_docs >= 2**63:  # beyond 64 bits in between
            return np.array([50 + 50 * int(x) * self.n_docs // self.n_terms for x in n], np.int64)
        return 50 + (50 * n * self.n_docs) // self.n_terms

    def bounds(self, m: np.ndarray, sketch: np.ndarray, off: np.ndarray) -> np.ndarray:
        """(documents, queries): upper bounds of the scores."""
        out = np.zeros((len(m), len(self.queries)), np.float32)
        sizes = np.diff(off) // 2
        for size in np.unique(sizes):
            a, b = _slots(self.terms, int(size))
            rows = np.flatnonzero(sizes == size)
            for lo in range(0, len(rows), 256):
                own = rows[lo : lo + 256]
                table = sketch[off[own][:, None] + np.arange(2 * size)]
                tf = np.minimum(table[:, a], table[:, size + b])
                f = tf.astype(np.float32)
                impact = f * np.float32(1e9) / (f * np.float32(1000) + (20 * m[own]).astype(np.float32)[:, None])
                impact[tf == 255] = 1e6
                worth = impact @ self.matrix
                out[own] = np.where(worth > 0, worth * self.slack + 1, 0)
        return out

    def scores(self, m: np.ndarray, terms: np.ndarray, tfs: np.ndarray, off: np.ndarray) -> np.ndarray:
        """(documents, queries): exact scores, from whole term lists."""
        out = np.zeros(len(m) * len(self.queries), np.int64)
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        hit = np.flatnonzero(self.terms[at] == terms)
        doc = np.searchsorted(off, hit, side="right") - 1
        no, tf = at[hit], tfs[hit].astype(np.int64)
        worth = self.weights[no] * ((1_000_000_000 * tf) // (1000 * tf + 20 * m[doc]))
        n = self.starts[no + 1] - self.starts[no]
        place = np.repeat(self.starts[no], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
        np.add.at(out, np.repeat(doc, n) * len(self.queries) + self.holders[place], np.repeat(worth, n))
        return out.reshape(len(m), len(self.queries))


class _Best:
    """The k best documents of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k = k
        self.rows = np.zeros((0, 4), np.int64)  # query, score, doc_id, 1 if doc_id is null
        self.least = np.ones(queries, np.int64)

    def add(self, doc: np.ndarray, null: np.ndarray, scores: np.ndarray) -> None:
        d, q = np.nonzero(scores >= self.least)
        if not len(d):
            return
        rows = np.vstack([self.rows, np.column_stack([q, scores[d, q], doc[d], null[d]])])
        rows = rows[np.lexsort((rows[:, 2], rows[:, 3], -rows[:, 1], rows[:, 0]))]
        first = np.searchsorted(rows[:, 0], np.arange(len(self.least)))
        rank = np.arange(len(rows)) - first[rows[:, 0]]
        self.rows = rows[rank < self.k]
        last = self.rows[(rank[rank < self.k] == self.k - 1)]
        self.least[last[:, 0]] = last[:, 1]


def _rescore(block: QueryBlock, best: _Best, part: pa.RecordBatch, counted: list[int]) -> None:
    """Documents of ``part`` in descending order of their bounds, until no
    bound reaches the threshold of its query."""
    n = part.column("n_terms").to_numpy(zero_copy_only=False)
    m = block.lengths(n)
    bounds = block.bounds(m, *_unpacked(part.column("sketch"), np.uint8))
    terms, off = _unpacked(part.column("terms"), _U)
    tfs, _ = _unpacked(part.column("tfs"), np.uint32)
    ids = part.column("doc_id")
    null = np.asarray(ids.is_null()).astype(np.int64)
    doc = ids.fill_null(0).to_numpy(zero_copy_only=False)
    waiting = np.ones(len(n), bool)
    while True:
        alive = (bounds >= best.least) & waiting[:, None]
        rows = np.flatnonzero(alive.any(axis=1))
        if not len(rows):
            return
        top = np.where(alive[rows], bounds[rows], -1)
        if len(rows) > best.k:
            # the next k of each query that still has some
            near = np.argpartition(-top, best.k - 1, axis=0)[: best.k]
            chosen = np.unique(near[np.take_along_axis(top, near, axis=0) >= 0])
            rows = rows[chosen]
        waiting[rows] = False
        counted[0] += len(rows)
        cut = np.concatenate(([0], np.cumsum(np.diff(off)[rows])))
        take = np.repeat(off[:-1][rows] - cut[:-1], np.diff(off)[rows]) + np.arange(cut[-1])
        best.add(doc[rows], null[rows], block.scores(m[rows], terms[take], tfs[take], cut))


def search_block(index: DataFrame, block: QueryBlock, k: int) -> DataFrame:
    """(query, item_id, doc_id, score): each task's ``k`` best of each query."""
    shared = index.sparkSession.sparkContext.broadcast(block)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        best, counted = _Best(len(own.queries), k), [0]
        rows = max(64, min(ROUND, HELD // max(len(own.queries), 1)))
        for b in batches:
            for part in _parts(b, rows):
                _rescore(own, best, part, counted)
        q = best.rows[:, 0]
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(own.queries[q].astype(np.int64)),
                pa.array([own.item_ids[i] for i in q], pa.int64()),
                pa.array(best.rows[:, 2], mask=best.rows[:, 3].astype(bool)),
                pa.array(best.rows[:, 1]),
            ],
            ["query", "item_id", "doc_id", "score"],
        )

    return index.mapInArrow(work, "query long, item_id long, doc_id long, score long")


def search(index: DataFrame, items: DataFrame, k: int = 50, block_rows: int = 200_000) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` best documents of each query."""
    spark = index.sparkSession
    total = index.agg(F.count(F.lit(1)).alias("n"), F.sum("n_terms").alias("l")).first()
    asked = materialize(query_terms(items), "query-terms")
    blocks = max(1, -(-asked.count() // block_rows))
    found = []
    for no in range(blocks):
        rows = asked.filter(F.pmod("query", F.lit(blocks)) == no)
        terms = rows.select("query", "item_id", "term").toPandas()
        if not len(terms) or not total["n"]:
            continue
        term = terms["term"].to_numpy(np.int64).view(_U)
        counts = term_counts(index, np.unique(term))
        weight = F.floor(F.lit(1000.0) * F.log((F.lit(2.0 * total["n"] + 2)) / (2 * F.col("df") + 1)))
        weights = {r["term"]: r["w"] for r in counts.select("term", weight.alias("w")).toLocalIterator()}
        ids = [None if v != v else int(v) for v in terms["item_id"]]
        block = QueryBlock(terms["query"].to_numpy(np.int64), ids, term, weights, total["n"], total["l"])
        found.append(materialize(search_block(index, block, k), "lexical-hits"))
    if not found:
        none = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
        return none
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("item_id", "rank", "doc_id", "score")
