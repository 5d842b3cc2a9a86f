"""Benchmark decontamination by an exact index of the items' shingles.

An item is found in a document if the document holds at least ``threshold``
of the item's distinct five-word shingles.

* Documents probe an index of all item shingles with all of theirs; the
  shingles in common are counted, so each (document, item) hit is exact.
* Each item also marks a bottom-k MinHash sketch whose k follows from its
  size: the ``size - ceil(threshold * size) + 1`` smallest shingle hashes. A
  document that holds the wanted share of the item misses at most ``k - 1``
  of its shingles, so it holds at least one hash of the sketch. The test on
  the sketch is therefore true for every pair that reaches the threshold and
  changes no row; items are not grouped by size. (Banded sketches of whole
  documents cannot stand in for the index: a short item's Jaccard similarity
  to a long document is close to zero.)

Sketches and item shingles go to the tasks by broadcast only while their
measured count is at most ``max_broadcast`` hashes (8 bytes each); beyond it
both steps are shuffled joins on the hash (``_joined``).

Defined results: null and empty texts, of documents or items, hold no
shingle and match nothing; a text of fewer than five words is one shingle,
its whole sequence; repeated rows with one doc_id are each judged, and equal
result rows are given once; null doc_ids or item_ids are kept as null; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.textkit import buffer_of, shingle_hashes, shingle_sets, slices, word_hashes

_SCHEMA = "doc_id long, item_id long, n_common long, n_item long"


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def sketch_size(n: int, threshold_pct: int) -> int:
    need = -(-threshold_pct * n // 100)
    return n - need + 1


def item_shingles(items: DataFrame, threshold_pct: int) -> DataFrame:
    """(row, item_id, n_item, hash, sketch): one row per distinct shingle;
    ``sketch`` marks the bottom-k hashes of the item."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            flat, off = shingle_sets(b.column("text"))
            n = np.diff(off)
            k = np.array([sketch_size(int(x), threshold_pct) if x else 0 for x in n], dtype=np.int64)
            place = np.arange(len(flat)) - np.repeat(off[:-1], n)
            at = pa.array(np.repeat(np.arange(len(n)), n))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("row").take(at),
                    b.column("item_id").cast(pa.int64()).take(at),
                    pa.array(np.repeat(n, n)),
                    pa.array(_signed(flat)),
                    pa.array(place < np.repeat(k, n)),
                ],
                ["row", "item_id", "n_item", "hash", "sketch"],
            )

    rows = items.select("item_id", "text").withColumn("row", F.xxhash64("item_id", "text"))
    return rows.select("row", "item_id", "text").mapInArrow(
        work, "row long, item_id long, n_item long, hash long, sketch boolean"
    ).distinct()


def _item_table(items: DataFrame, threshold_pct: int, max_broadcast: int) -> tuple[DataFrame, dict | None]:
    """Item shingles, and their probe table if they are few enough for one."""
    shingles = item_shingles(items, threshold_pct)
    # the measured size decides the form of the join, never what is found
    head = shingles.limit(max_broadcast + 1).toPandas()
    if len(head) > max_broadcast:
        return shingles, None
    head = head.sort_values(["hash", "row"])
    hashes = head["hash"].to_numpy(dtype=np.int64)
    _, item_no = np.unique(head["row"].to_numpy(), return_inverse=True)
    by_row = head.groupby("row", sort=True)
    keys = np.unique(hashes)
    return shingles, {
        "keys": keys,
        "from": np.searchsorted(hashes, keys, "left"),
        "to": np.searchsorted(hashes, keys, "right"),
        "item": item_no.astype(np.int64),
        "sketch": head["sketch"].to_numpy(dtype=bool),
        "size": by_row["n_item"].max().to_numpy(),
        "id": [None if v != v else int(v) for v in by_row["item_id"].max()],
    }


def _hits(batches: Iterator[pa.RecordBatch], t: dict, threshold_pct: int) -> Iterator[tuple[pa.RecordBatch, list[tuple]]]:
    """Slices of the input with their hits (row in the slice, item number,
    shingles in common)."""
    # one bit per low 20 bits of the keys: most shingles stop here
    bits = np.zeros(1 << 20, dtype=bool)
    bits[t["keys"].view(np.uint64) & np.uint64((1 << 20) - 1)] = True
    for b in batches:
        for part in slices(b):
            yield part, (_probe(part.column("text"), t, bits, threshold_pct) if len(t["keys"]) else [])


def contained_items(
    docs: DataFrame, items: DataFrame, threshold_pct: int = 75, max_broadcast: int = 1_000_000
) -> DataFrame:
    """(doc_id, item_id, n_common, n_item) for every document that holds at
    least ``threshold_pct`` per cent of an item's distinct shingles."""
    shingles, table = _item_table(items, threshold_pct, max_broadcast)
    if table is None:
        return _joined(docs.select("doc_id", "text"), shingles, threshold_pct).drop("tkey").distinct()
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = shared.value
        for part, hits in _hits(batches, t, threshold_pct):
            ids = part.column("doc_id")
            yield pa.RecordBatch.from_arrays(
                [
                    ids.cast(pa.int64()).take(pa.array([i for i, _, _ in hits], pa.int64())),
                    pa.array([t["id"][j] for _, j, _ in hits], pa.int64()),
                    pa.array([n for _, _, n in hits], pa.int64()),
                    pa.array([int(t["size"][j]) for _, j, _ in hits], pa.int64()),
                ],
                ["doc_id", "item_id", "n_common", "n_item"],
            )

    return docs.select("doc_id", "text").mapInArrow(work, _SCHEMA).distinct()


def drop_contaminated(
    docs: DataFrame, items: DataFrame, threshold_pct: int = 75, max_broadcast: int = 1_000_000
) -> DataFrame:
    """The rows of ``docs`` that hold no item, with all their columns."""
    shingles, table = _item_table(items, threshold_pct, max_broadcast)
    if table is None:
        bad = _joined(docs.select("doc_id", "text"), shingles, threshold_pct).select("tkey").distinct()
        keyed = docs.withColumn("_tkey", F.xxhash64("doc_id", "text"))
        return keyed.join(bad.withColumnRenamed("tkey", "_tkey"), "_tkey", "left_anti").drop("_tkey")
    shared = docs.sparkSession.sparkContext.broadcast(table)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, hits in _hits(batches, shared.value, threshold_pct):
            keep = np.ones(part.num_rows, dtype=bool)
            keep[[i for i, _, _ in hits]] = False
            yield part.filter(pa.array(keep))

    return docs.mapInArrow(work, docs.schema)


def _probe(texts: pa.Array, t: dict, bits: np.ndarray, threshold_pct: int) -> list[tuple]:
    sh, off = shingle_hashes(*word_hashes(*buffer_of(texts)))
    maybe = np.flatnonzero(bits[sh & np.uint64((1 << 20) - 1)])
    key = _signed(sh[maybe])
    at = np.minimum(np.searchsorted(t["keys"], key), len(t["keys"]) - 1)
    hit = t["keys"][at] == key
    if not hit.any():
        return []
    text = np.searchsorted(off, maybe[hit], side="right") - 1
    pairs = np.unique(np.stack([text, at[hit]]), axis=1)  # distinct shingles of each text
    n = t["to"][pairs[1]] - t["from"][pairs[1]]
    text = np.repeat(pairs[0], n)
    where = np.repeat(t["from"][pairs[1]], n) + (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))
    item, in_sketch = t["item"][where], t["sketch"][where]
    both, no = np.unique(text * len(t["size"]) + item, return_inverse=True)
    candidate = np.bincount(no, weights=in_sketch) > 0
    common = np.bincount(no)
    out = []
    for b, c, ok in zip(both, common, candidate, strict=True):
        i, j = divmod(int(b), len(t["size"]))
        if ok and 100 * int(c) >= threshold_pct * int(t["size"][j]):
            out.append((i, j, int(c)))
    return out


def _joined(docs: DataFrame, shingles: DataFrame, threshold_pct: int) -> DataFrame:
    """The same search with shuffled joins: for item tables of any size."""

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                flat, off = shingle_sets(part.column("text"))
                at = pa.array(np.repeat(np.arange(part.num_rows), np.diff(off)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()).take(at), part.column("tkey").take(at), pa.array(_signed(flat))],
                    ["doc_id", "tkey", "hash"],
                )

    own = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("tkey")).mapInArrow(
        explode, "doc_id long, tkey long, hash long"
    ).distinct()
    hits = own.join(shingles, "hash")
    sums = hits.groupBy("tkey", "doc_id", "row", "item_id", "n_item").agg(
        F.count(F.lit(1)).alias("n_common"), F.max("sketch").alias("_found")
    )
    return (
        sums.filter(F.col("_found") & (F.lit(100) * F.col("n_common") >= F.lit(threshold_pct) * F.col("n_item")))
        .select("tkey", "doc_id", "item_id", "n_common", "n_item")
    )
