"""Exact removal of long repeated byte strings, with a collection BWT.

Every byte covered by a ``WIDTH``-byte string that also starts earlier (in a
smaller document, or earlier in the same one) is removed. Method:

1. Anchors. Of the ``GRAM``-byte grams in each window of ``WIDTH`` bytes the
   one with the least hash is the window's anchor. Equal windows have equal
   anchors, so a window can only be repeated if its anchor occurs twice. One
   aggregate counts anchors over the corpus; one join marks, by document, the
   anchors that recur. Unrepeated text goes no further.
2. Pieces. Neighbouring windows with one recurring anchor form a piece (at
   most ``WIDTH - GRAM + MAX_RUN`` bytes or so). Equal pieces are grouped:
   all but the first are removed whole, the first goes on. A passage copied a
   million times is one piece from here on.
3. Collection BWT. Pieces are dealt by anchor to buckets of bounded size. In
   each bucket pieces are cut to the runs of windows whose hash recurs there,
   and of equal parts the first goes on. The Burrows-Wheeler transform of
   these parts is built column by column, right to left: each round inserts
   one symbol per piece, and updates the transform, the common prefixes and
   the order of suffixes through sequential passes. Suffixes whose common prefix reaches ``WIDTH``
   are equal windows; all but the first in document order are removed.
   Anchors with more text than a bucket holds are settled by an aggregate
   over the hashes of their single windows instead (same result).

A column-wise construction over whole documents needs a round over the
corpus for every byte of the longest document; by pieces it needs at most
``WIDTH + MAX_RUN`` rounds over a bucket, whose arrays are small enough that
the sequential files of the published algorithm become in-memory arrays.

Defined results: a null text has no bytes; texts shorter than ``WIDTH`` keep
all; a null doc_id comes before all others; rows repeated under one doc_id
are separate documents, in the order of their text's hash; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.textkit import _ramp, buffer_of, mix, slices
from tidewatch.session import bucketed, drop_table, free_shuffles, materialize

WIDTH = 100
GRAM = 32
SPAN = WIDTH - GRAM + 1  # grams in a window
MAX_RUN = 128  # windows in a piece
BUCKET_BYTES = 1 << 20
_CHUNK = 1 << 18
_U = np.uint64
_TOP = _U(0xFFFFFFFFFFFFFFFF)
_BASE = 0xD6E8FEB86659FD93


def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    inv = pow(_BASE, -1, 1 << 64)
    up = np.full(_CHUNK + 1, _U(_BASE), dtype=_U)
    down = np.full(_CHUNK + 1, _U(inv), dtype=_U)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


_BYTES = mix(np.arange(1, 257, dtype=_U) * _U(0x9E3779B97F4A7C15))
_TABLES: list[np.ndarray] = []


def _rolling(buf: np.ndarray, width: int, table: np.ndarray = _BYTES) -> np.ndarray:
    """64-bit hashes of all ``width``-byte strings of a chunk."""
    if not _TABLES:
        _TABLES.extend(_power_tables())
    n = len(buf)
    sums = np.zeros(n + 1, dtype=_U)
    np.cumsum(table[buf] * _TABLES[0][:n], out=sums[1:])
    return mix((sums[width:] - sums[:-width]) * _TABLES[1][: n - width + 1])


def anchor_hashes(buf: np.ndarray, ties: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The anchor hash of every window of a chunk of at least WIDTH bytes, and
    whether the window holds that gram twice. Without ``ties`` the second
    array is all false."""
    m = _rolling(buf, GRAM)
    twice = np.zeros(len(m), dtype=bool)
    n = len(m) - SPAN + 1
    out = out_twice = None
    size, done = 1, 0

    def join(a: np.ndarray, ta: np.ndarray, b: np.ndarray, tb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not ties:
            return np.minimum(a, b), ta[: len(b)]
        less, same = a < b, a == b
        return np.minimum(a, b), same | (less & ta) | (~less & tb)

    while True:  # the span as a sum of powers of two: ranges side by side
        if SPAN & size:
            part = m[done : done + n], twice[done : done + n]
            out, out_twice = part if out is None else join(out, out_twice, *part)
            done += size
        if size * 2 > SPAN:
            return out, out_twice
        m, twice = join(m[:-size], twice[:-size], m[size:], twice[size:])
        size *= 2


class Runs:
    """Runs of windows with one anchor, of the documents of one chunk: document,
    start and stop (of window starts in the document), anchor, ``own``: the
    anchor stands in the run more than once; with digests, two hashes of the
    bytes of each run cut into pieces of at most MAX_RUN windows."""

    def __init__(self, part: np.ndarray, doc: np.ndarray, shift: np.ndarray, room: np.ndarray, ties: bool):
        # room: windows that start in each document's part; shift: place of its first byte
        a, twice = anchor_hashes(part, ties=ties)
        size = np.diff(np.append(shift, len(part)))
        which = np.repeat(np.arange(len(doc)), size)[: len(a)]
        inside = np.arange(len(a)) - shift[which]
        valid = inside < room[which]
        edge = np.ones(len(a), dtype=bool)
        edge[1:] = (a[1:] != a[:-1]) | (which[1:] != which[:-1]) | (valid[1:] != valid[:-1])
        first = np.flatnonzero(edge)
        stop = np.append(first[1:], len(a))
        ok = valid[first]
        self.own = (np.maximum.reduceat(twice, first) | (stop - first > SPAN))[ok]
        self.at, self.length = first[ok], (stop - first)[ok]
        self.anchor = a[self.at]
        self.doc = doc[which[self.at]]
        self.start = inside[self.at]

    def take(self, some: np.ndarray) -> None:
        for name in ("own", "at", "length", "anchor", "doc", "start"):
            setattr(self, name, getattr(self, name)[some])

    def cut(self) -> None:
        """Split long runs into pieces."""
        n = -(-self.length // MAX_RUN)
        k = _ramp(n) * MAX_RUN
        self.take(np.repeat(np.arange(len(n)), n))
        self.at, self.start = self.at + k, self.start + k
        self.length = np.minimum(self.length - k, MAX_RUN)


def chunk_runs(buf: np.ndarray, off: np.ndarray, ties: bool = True) -> Iterator[tuple[Runs, np.ndarray]]:
    """Runs of all documents, chunk by chunk, with the chunk's bytes. A long
    document is cut into chunks that overlap by WIDTH - 1 bytes, so each
    window stands in one."""
    n, i = len(off) - 1, 0
    while i < n:
        j = i + 1
        while j < n and off[j + 1] - off[i] <= _CHUNK:
            j += 1
        if off[j] - off[i] <= _CHUNK:
            part = buf[off[i] : off[j]]
            if len(part) >= WIDTH:
                sizes = off[i + 1 : j + 1] - off[i:j]
                yield Runs(part, np.arange(i, j), off[i:j] - off[i], np.maximum(sizes - WIDTH + 1, 0), ties), part
        else:
            for lo in range(int(off[i]), int(off[j]) - WIDTH + 1, _CHUNK - WIDTH + 1):
                part = buf[lo : min(lo + _CHUNK, off[j])]
                runs = Runs(part, np.array([i]), np.array([0]), np.array([len(part) - WIDTH + 1]), ties)
                runs.start = runs.start + (lo - int(off[i]))
                yield runs, part
        i = j


# --- anchors -----------------------------------------------------------------


def _document_anchors(docs: DataFrame) -> DataFrame:
    """(hash, uid, n): distinct anchors of each document; n is 2 for an anchor
    that stands in it more than once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("uid").to_numpy(zero_copy_only=False)
            for r, _ in chunk_runs(*buffer_of(b.column("text"))):
                order = np.lexsort((r.anchor, r.doc))
                a, d, own = r.anchor[order], r.doc[order], r.own[order]
                first = np.flatnonzero(np.concatenate(([True], (a[1:] != a[:-1]) | (d[1:] != d[:-1])))[: len(a)])
                if len(first):
                    n = np.minimum(np.add.reduceat(1 + own, first), 2).astype(np.int32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(a[first].view(np.int64)), pa.array(ids[d[first]]), pa.array(n)], ["hash", "uid", "n"]
                    )

    return docs.select("uid", "text").mapInArrow(work, "hash long, uid long, n int")


# --- pieces ------------------------------------------------------------------

_SECOND = mix(np.arange(1001, 1257, dtype=_U) * _U(0x9E3779B97F4A7C15))


def _piece_digests(raw: np.ndarray, at: np.ndarray, size: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of the strings of a chunk at ``at``."""
    out = []
    for table in (_BYTES, _SECOND):
        sums = np.zeros(len(raw) + 1, dtype=_U)
        np.cumsum(table[raw] * _TABLES[0][: len(raw)], out=sums[1:])
        out.append(mix((sums[at + size] - sums[at]) * _TABLES[1][at] + size.astype(_U)).view(np.int64))
    return out


def _pieces(marked: DataFrame) -> DataFrame:
    """(h1, h2, anchor, own, uid, start, len) of every piece; h1 and h2 are
    hashes of its bytes. ``marked(uid, text, hashes)``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                ids = part.column("uid").to_numpy(zero_copy_only=False)
                lists = part.column("hashes")
                wanted = np.sort(lists.flatten().to_numpy(zero_copy_only=False))
                for r, raw in chunk_runs(*buffer_of(part.column("text"))):
                    if not len(wanted) or not len(r.at):
                        continue
                    key = r.anchor.view(np.int64)
                    at = np.minimum(np.searchsorted(wanted, key), len(wanted) - 1)
                    r.take(np.flatnonzero(wanted[at] == key))
                    r.cut()
                    size = r.length + WIDTH - 1
                    digests = _piece_digests(raw, r.at, size)
                    yield pa.RecordBatch.from_arrays(
                        [
                            *map(pa.array, digests),
                            pa.array(r.anchor.view(np.int64)),
                            pa.array(r.own),
                            pa.array(ids[r.doc]),
                            pa.array(r.start),
                            pa.array(size.astype(np.int32)),
                        ],
                        ["h1", "h2", "anchor", "own", "uid", "start", "len"],
                    )

    schema = "h1 long, h2 long, anchor long, own boolean, uid long, start long, len int"
    return marked.select("uid", "text", "hashes").mapInArrow(work, schema)


def _piece_bytes(asked: DataFrame) -> DataFrame:
    """(anchor, size, uid, start, bytes) of asked pieces. ``asked(uid, text,
    pieces)``, pieces: array of (start, len, anchor, size)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                buf, off = buffer_of(part.column("text"))
                raw = buf.tobytes()
                rows: list[tuple] = []
                for i, (uid, pieces) in enumerate(
                    zip(part.column("uid").to_pylist(), part.column("pieces").to_pylist(), strict=True)
                ):
                    for p in pieces:
                        s = int(off[i]) + p["start"]
                        rows.append((p["anchor"], p["size"], uid, p["start"], raw[s : s + p["len"]]))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["anchor", "size", "uid", "start", "bytes"]
                )

    return asked.select("uid", "text", "pieces").mapInArrow(
        work, "anchor long, size long, uid long, start long, bytes binary"
    )


# --- collection BWT ----------------------------------------------------------


def collection_bwt(pieces: list[bytes], width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of all pieces in order: (piece, offset, common prefix with the
    one before, counted up to ``width``), built column by column.

    ``bwt`` holds the symbol before each suffix (byte + 1, 0 at a piece's
    start). A round turns the symbol before each piece's newest suffix into a
    suffix of its own: its place follows from a stable sort of the transform
    (the last-to-first mapping); its common prefix is one more than the least
    common prefix between the two suffixes it was extended from.
    """
    n = len(pieces)
    lengths = np.array([len(p) for p in pieces], dtype=np.int64)
    if not n:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint8)
    ends = np.cumsum(lengths)
    text = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    used = np.flatnonzero(np.bincount(text, minlength=256))
    kind = np.uint8 if len(used) < 256 else np.int16
    symbol = np.zeros(256, dtype=kind)
    symbol[used] = np.arange(1, len(used) + 1)
    text = symbol[text]
    # round 0: the empty suffixes
    bwt = np.where(lengths > 0, text[np.maximum(ends - 1, 0)], 0).astype(kind)
    lcp = np.zeros(n, dtype=np.uint8)
    # places by (symbol, place): where each suffix goes once its symbol is put before it
    order = np.argsort(bwt, kind="stable").astype(np.int32)
    counts = np.bincount(bwt, minlength=len(used) + 1)
    newest = np.flatnonzero(lengths > 0).astype(np.int32)  # place of each active piece's newest suffix
    active = np.flatnonzero(lengths > 0)
    left = lengths.copy()  # symbols not yet inserted

    def ranks(symbols: np.ndarray, places: np.ndarray, table: np.ndarray, heads: np.ndarray) -> np.ndarray:
        """Index in ``table`` before which each (symbol, place) belongs; both
        arguments sorted by symbol."""
        out = np.empty(len(symbols), dtype=np.int64)
        cuts = np.searchsorted(symbols, np.arange(len(used) + 2))
        for k in np.flatnonzero(cuts[1:] > cuts[:-1]).tolist():
            q = slice(cuts[k], cuts[k + 1])
            out[q] = heads[k] + np.searchsorted(table[heads[k] : heads[k + 1]], places[q])
        return out

    while len(active):
        heads = np.concatenate(([0], np.cumsum(counts)))
        by_symbol = np.argsort(bwt[newest], kind="stable")
        active, newest = active[by_symbol], newest[by_symbol]
        at_order = ranks(bwt[newest], newest, order, heads)
        sorted_rank = np.argsort(at_order, kind="stable")
        active, at_order = active[sorted_rank], at_order[sorted_rank]
        place = (n - counts[0] + at_order).astype(np.int32)  # ascending; empty suffixes stand first
        left[active] -= 1
        at = left[active]
        before = np.where(at > 0, text[np.maximum(ends[active] - lengths[active] + at - 1, 0)], 0).astype(kind)
        size = len(bwt) + len(active)
        old = np.ones(size, dtype=bool)
        old[place] = False

        # common prefixes of the new suffixes and of those behind them
        v = np.stack([place, place + 1], axis=1).reshape(-1)  # ascending, since places are
        v = v[np.concatenate((v[1:] > v[:-1], [True])) & (v > n) & (v < size)]
        shift = counts[0] - n
        a, b = order[v + shift - 1], order[v + shift]
        value = np.zeros(len(v), dtype=np.uint8)
        same = bwt[a] == bwt[b]
        if same.any():
            x, y = a[same], b[same]
            down = np.argsort(-x, kind="stable")  # descending: reduceat skips the gaps
            pairs = np.stack([x[down] + 1, y[down] + 1], axis=1).reshape(-1)
            least = np.minimum.reduceat(np.append(lcp, np.uint8(0)), pairs)[::2]
            got = np.empty(len(x), dtype=np.uint8)
            got[down] = np.minimum(least, width - 1) + 1
            value[same] = got

        # one sequential pass over each array
        kept = np.flatnonzero(old).astype(np.int32)
        new_bwt, new_lcp = np.empty(size, dtype=kind), np.zeros(size, dtype=np.uint8)
        new_bwt[old], new_bwt[place] = bwt, before
        new_lcp[old] = lcp
        new_lcp[v] = value
        moved = kept[order]
        into = np.argsort(before, kind="stable")
        spot = ranks(before[into], place[into], moved, heads) + np.arange(len(into))
        new_order = np.empty(size, dtype=np.int32)
        stay = np.ones(size, dtype=bool)
        stay[spot] = False
        new_order[stay], new_order[spot] = moved, place[into]
        bwt, lcp, order = new_bwt, new_lcp, new_order
        counts = counts + np.bincount(before, minlength=len(used) + 1)
        go_on = at > 0
        newest, active = place[go_on], active[go_on]
    # the order of suffixes: follow every piece from its empty suffix
    order = order[counts[0] :]
    to = np.empty(len(bwt), dtype=np.int64)
    to[order] = n + np.arange(len(order))
    piece, offset = np.empty(len(bwt), dtype=np.int32), np.empty(len(bwt), dtype=np.int32)
    here, own, at = np.arange(n), np.arange(n), lengths.copy()
    while len(own):
        piece[here], offset[here] = own, at
        go_on = at > 0
        own, at = own[go_on], at[go_on] - 1
        here = to[here[go_on]]
    return piece, offset, lcp


def window_hashes(buf: np.ndarray) -> list[np.ndarray]:
    """Two 64-bit hashes of all WIDTH-byte strings of a chunk."""
    return [_rolling(buf, WIDTH, table) for table in (_BYTES, _SECOND)]


def recurring_parts(pieces: list[bytes]) -> list[tuple[int, int, int]]:
    """(piece, start, end) of the parts whose windows may recur: runs of windows
    whose hash stands in the bucket more than once."""
    lengths = np.array([len(p) for p in pieces], dtype=np.int64)
    begins = np.cumsum(lengths) - lengths
    text = np.frombuffer(b"".join(pieces), dtype=np.uint8)
    every = [_rolling(text[lo : lo + _CHUNK], WIDTH, _BYTES) for lo in range(0, len(text) - WIDTH + 1, _CHUNK - WIDTH + 1)]
    room = lengths - WIDTH + 1
    own = np.repeat(np.arange(len(pieces)), room)
    at = _ramp(room)
    window = np.concatenate(every)[begins[own] + at]
    order = np.argsort(window)
    same = window[order[1:]] == window[order[:-1]]
    ok = np.zeros(len(window), dtype=bool)
    ok[order[1:]] |= same
    ok[order[:-1]] |= same
    edge = np.concatenate(([True], (ok[1:] != ok[:-1]) | (own[1:] != own[:-1])))
    first = np.flatnonzero(edge)
    stop = np.append(first[1:], len(ok))
    some = ok[first]
    return list(zip(own[first[some]].tolist(), at[first[some]].tolist(), (at[stop[some] - 1] + WIDTH).tolist(), strict=True))


def repeated_windows(pieces: list[bytes], uid: np.ndarray, start: np.ndarray, width: int = WIDTH) -> list[tuple[int, int, int]]:
    """(uid, start, end) covers of the windows that also start earlier."""
    piece, offset, lcp = collection_bwt(pieces, width)
    lengths = np.array([len(p) for p in pieces])
    full = lengths[piece] - offset >= width
    group = np.cumsum(lcp < width)[full]
    piece, offset = piece[full], offset[full]
    u, s = uid[piece], start[piece] + offset
    order = np.lexsort((s, u, group))
    g = group[order]
    first = np.concatenate(([True], g[1:] != g[:-1])) if len(g) else np.zeros(0, bool)
    # the same place may stand in no two pieces, so all but the first go
    gone = order[~first]
    return _unite(u[gone], s[gone], width)


def _unite(u: np.ndarray, s: np.ndarray, width: int) -> list[tuple[int, int, int]]:
    """Unite windows (uid, start) into covers."""
    if not len(u):
        return []
    order = np.lexsort((s, u))
    u, s = u[order], s[order]
    new = np.concatenate(([True], (u[1:] != u[:-1]) | (s[1:] > s[:-1] + width)))
    at = np.flatnonzero(new)
    last = np.append(at[1:], len(u)) - 1
    return list(zip(u[at].tolist(), s[at].tolist(), (s[last] + width).tolist(), strict=True))


# --- the operator ------------------------------------------------------------

_COVER = "uid long, start long, stop long"


def _bucket_covers(pieces: DataFrame, total: int) -> DataFrame:
    """Covers of the windows that recur among first pieces, by buckets of
    anchors. ``pieces(anchor, size, uid, start, bytes)``, size: bytes of all
    pieces of the anchor, none over a bucket's; total: of all anchors."""
    buckets = max(1, -(-total // BUCKET_BYTES))
    small = pieces.select(F.pmod(F.xxhash64("anchor"), F.lit(buckets)).alias("bucket"), "anchor", "uid", "start", "bytes")

    def bwt(pdf: pd.DataFrame) -> pd.DataFrame:
        pieces = [bytes(x) for x in pdf["bytes"]]
        uid, start = (pdf[c].to_numpy() for c in ("uid", "start"))
        if not pieces:
            return pd.DataFrame(columns=["uid", "start", "stop"]).astype("int64")
        # parts in the order of their places: of equal ones the first goes on
        parts = recurring_parts(pieces)
        places = sorted((int(uid[p]), int(start[p]) + s, e - s, pieces[p][s:e]) for p, s, e in parts)
        firsts: dict[bytes, tuple[int, int]] = {}
        covers = []
        for u, s, n, text in places:
            if firsts.setdefault(text, (u, s)) != (u, s):
                covers.append((u, s, s + n))
        u, s = (np.array([x[c] for x in firsts.values()], dtype=np.int64) for c in (0, 1))
        covers += repeated_windows(list(firsts), u, s)
        return pd.DataFrame(covers, columns=["uid", "start", "stop"]).astype("int64")

    return small.drop("anchor").groupBy("bucket").applyInPandas(bwt, _COVER)


def _window_covers(pieces: DataFrame) -> DataFrame:
    """The same for anchors with more text than a bucket: first places of
    single windows, by an aggregate over their hashes."""

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            uid, start = (b.column(c).to_numpy(zero_copy_only=False) for c in ("uid", "start"))
            for i, piece in enumerate(b.column("bytes").to_pylist()):
                one, two = window_hashes(np.frombuffer(piece, dtype=np.uint8))
                at = np.arange(len(one)) + start[i]
                cols = [one.view(np.int64), two.view(np.int64), np.full(len(one), uid[i]), at]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["h1", "h2", "uid", "start"])

    single = pieces.select("uid", "start", "bytes").mapInArrow(windows, "h1 long, h2 long, uid long, start long")
    first = single.groupBy("h1", "h2").agg(F.min(F.struct("uid", "start")).alias("first"))
    return (
        single.join(first, ["h1", "h2"])
        .filter((F.col("uid") != F.col("first.uid")) | (F.col("start") != F.col("first.start")))
        .select("uid", "start", (F.col("start") + WIDTH).alias("stop"))
    )


def _marks(docs: DataFrame) -> DataFrame:
    """(uid, hashes): each document's anchors that recur in the corpus."""
    anchors = materialize(_document_anchors(docs), "repeat-anchors")
    recurring = anchors.groupBy("hash").agg(F.sum("n").alias("_n")).filter("_n > 1").select("hash")
    marks = anchors.select("hash", "uid").join(recurring, "hash").groupBy("uid").agg(F.collect_list("hash").alias("hashes"))
    marks = bucketed(marks, "uid", "repeat-marks")
    drop_table(anchors)
    return marks


def _covers(docs: DataFrame) -> DataFrame:
    """(uid, start, stop): all bytes to remove. ``docs(uid, text)``."""
    spark = docs.sparkSession
    marks = _marks(docs)
    free_shuffles(spark)
    pieces = materialize(_pieces(docs.join(marks, "uid")), "repeat-pieces")
    firsts = materialize(
        pieces.groupBy("h1", "h2").agg(
            F.min(F.struct("uid", "start")).alias("first"),
            F.max("anchor").alias("anchor"),
            F.max("own").alias("own"),
            F.max("len").alias("len"),
            F.count(F.lit(1)).alias("times"),
        ),
        "repeat-firsts",
    )
    # equal pieces: all but the first go whole
    twice = firsts.filter("times > 1").select("h1", "h2", F.col("first.uid").alias("_u"), F.col("first.start").alias("_s"))
    copies = materialize(
        pieces.join(twice, ["h1", "h2"])
        .filter("uid <> _u or start <> _s")
        .select("uid", "start", (F.col("start") + F.col("len")).alias("stop")),
        "repeat-covers",
    )
    drop_table(pieces)
    free_shuffles(spark)
    # different pieces of one anchor, or with the anchor twice, may share windows
    several = firsts.groupBy("anchor").agg(F.sum("len").alias("size"), F.count(F.lit(1)).alias("_c"), F.max("own").alias("_o"))
    asked = materialize(
        firsts.join(several.filter("_c > 1 or _o"), "anchor").select(
            F.col("first.uid").alias("uid"), F.struct(F.col("first.start").alias("start"), "len", "anchor", "size").alias("p")
        ),
        "repeat-asked",
    )
    drop_table(firsts)
    sums = asked.agg(F.sum("p.len"), F.max("p.size")).first()
    lists = asked.groupBy("uid").agg(F.collect_list("p").alias("pieces"))
    found = _piece_bytes(docs.join(lists, "uid"))
    covers = copies.unionByName(_bucket_covers(found.filter(F.col("size") <= BUCKET_BYTES), sums[0] or 0))
    if (sums[1] or 0) > BUCKET_BYTES:
        covers = covers.unionByName(_window_covers(found.filter(F.col("size") > BUCKET_BYTES)))
    return covers


def remove_repeats(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining
    bytes; null where nothing was removed) of every row of ``docs``."""
    ranked, ids = _with_uids(docs)
    own = bucketed(ranked, "uid", "repeat-documents")
    free_shuffles(docs.sparkSession)
    covers = materialize(_covers(own), "repeat-covers")
    free_shuffles(docs.sparkSession)
    spans = covers.groupBy("uid").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                buf, off = buffer_of(part.column("text"))
                rows = []
                for i, covered in enumerate(part.column("spans").to_pylist()):
                    one = buf[off[i] : off[i + 1]]
                    if not covered:
                        rows.append((len(one), 0, 0, hashlib.sha256(one.tobytes()).hexdigest(), None))
                        continue
                    gone = np.zeros(len(one) + 1, dtype=np.int32)
                    for x in covered:
                        gone[x["start"]] += 1
                        gone[x["stop"]] -= 1
                    flag = np.cumsum(gone[:-1]) > 0
                    runs = int(flag[0]) + int((flag[1:] & ~flag[:-1]).sum())
                    rest = one[~flag].tobytes()
                    rows.append((len(one), int(flag.sum()), runs, hashlib.sha256(rest).hexdigest(), rest))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("uid"), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                    ["uid", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
                )

    out = own.join(spans, "uid", "left").mapInArrow(
        cut, "uid long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    )
    if ids is None:
        return out.withColumnRenamed("uid", "doc_id")
    return out.join(ids, "uid").select("doc_id", *[c for c in out.columns if c != "uid"])


def _with_uids(docs: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """(uid, text) with uid the doc_id where that is a key; otherwise the rank
    of (doc_id, text hash), and the table that maps it back."""
    from tidewatch.operators.positions import with_global_position

    twice = docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null")
    if not twice.limit(1).count():
        return docs.select(F.col("doc_id").alias("uid"), "text"), None
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("_h"))
    ranked = with_global_position(hashed, [F.col("doc_id").asc_nulls_first(), F.col("_h"), F.col("text")], pos_col="uid")
    return ranked.select("uid", "text"), ranked.select("uid", "doc_id")
