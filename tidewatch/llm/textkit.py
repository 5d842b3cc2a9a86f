"""Words and word shingles of whole texts as hashes, in NumPy.

A batch of texts is one UTF-8 byte buffer with offsets (an Arrow string
column). Words are runs of bytes other than 0x20 and 0x09-0x0D, A-Z lowered
on request. Work goes in pieces of about ``PIECE`` bytes cut between words,
so memory stays bounded for texts of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

PIECE = 1 << 19
SLICE = 1 << 20
_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: spreads every input bit over the output."""
    x = x.astype(_U, copy=True)
    x ^= x >> _U(30)
    x *= _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def _byte_values(lower: bool) -> np.ndarray:
    b = np.arange(256, dtype=_U)
    v = mix((b + _U(1)) * _ODD)
    if lower:
        v = v[_LOWER]
    v[_SPACE] = 0
    return v


_VALUES = {False: _byte_values(False), True: _byte_values(True)}
_POWERS = np.array([1], dtype=_U)


def _powers(n: int) -> np.ndarray:
    global _POWERS
    if len(_POWERS) < n:
        size = max(n, 64)
        p = np.full(size, _U(0xD6E8FEB86659FD93), dtype=_U)
        p[0] = 1
        _POWERS = np.multiply.accumulate(p)
    return _POWERS[:n]


def buffer_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string array; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if isinstance(texts, pa.ChunkedArray):
        texts = pa.concat_arrays(texts.chunks) if texts.num_chunks else pa.array([], pa.large_string())
    texts = texts.cast(pa.large_string()).fill_null("")
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = texts.buffers()
    offsets = np.frombuffer(off, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str = "text", rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of at most ``rows`` rows and about ``SLICE`` bytes of
    text (a longer text has a slice of its own)."""
    _, off = buffer_of(batch.column(column))
    lo = 0
    while lo < batch.num_rows:
        hi = int(np.searchsorted(off, off[lo] + SLICE, side="right")) - 1
        hi = min(max(hi, lo + 1), lo + rows, batch.num_rows)
        yield batch.slice(lo, hi - lo)
        lo = hi


def _piece_ends(buf: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Cuts at text boundaries, or inside a long text after white space."""
    cuts, last, n = [], 0, len(buf)
    while last < n:
        end = int(offsets[np.searchsorted(offsets, last + PIECE, side="right") - 1])
        if end <= last:  # one text is longer than a piece
            end = min(last + PIECE, n)
            stop = int(offsets[np.searchsorted(offsets, last, side="right")])
            while end < stop and not _SPACE[buf[end - 1]]:
                step = np.flatnonzero(_SPACE[buf[end : min(end + PIECE, stop)]])
                end = end + int(step[0]) + 1 if len(step) else min(end + PIECE, stop)
            end = min(end, stop)
        cuts.append(end)
        last = end
    return cuts


def word_hashes(buf: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words in order, and each text's offsets into them."""
    values = _VALUES[lower]
    hashes, counts = [], np.zeros(len(offsets) - 1, dtype=np.int64)
    last = 0
    for end in _piece_ends(buf, offsets):
        b = buf[last:end]
        word = ~_SPACE[b]
        first = word.copy()
        first[1:] &= ~word[:-1]
        edges = offsets[np.searchsorted(offsets, last, "left") : np.searchsorted(offsets, end, "left")] - last
        first[edges[edges < len(b)]] = word[edges[edges < len(b)]]
        starts = np.flatnonzero(first)
        if len(starts):
            nth = np.cumsum(first) - 1
            place = np.arange(len(b)) - starts[np.maximum(nth, 0)]
            at = np.where(word, place, 0)
            v = values[b] * _powers(int(at.max()) + 1)[at]
            hashes.append(mix(np.add.reduceat(v, starts)))
            own = np.searchsorted(offsets, starts + last, side="right") - 1
            counts += np.bincount(own, minlength=len(counts))
        last = end
    flat = np.concatenate(hashes) if hashes else np.zeros(0, dtype=_U)
    return flat, np.concatenate(([0], np.cumsum(counts)))


def shingle_hashes(words: np.ndarray, offsets: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's ``size``-word shingles in order (a text with
    fewer words: its whole sequence), and offsets into them."""
    counts = np.diff(offsets)
    n = np.where(counts >= size, counts - size + 1, (counts > 0).astype(np.int64))
    out_off = np.concatenate(([0], np.cumsum(n)))
    factors = mix(np.arange(1, size + 1, dtype=_U) * _ODD) | _U(1)
    full = max(len(words) - size + 1, 0)
    acc = np.zeros(full, dtype=_U)
    for j in range(size):
        acc += words[j : j + full] * factors[j]
    out = np.zeros(out_off[-1], dtype=_U)
    long = counts >= size
    if long.any():
        # where each long text's shingles stand among all word positions
        src = np.repeat(offsets[:-1][long], n[long]) + _ramp(n[long])
        dst = np.repeat(out_off[:-1][long], n[long]) + _ramp(n[long])
        out[dst] = acc[src]
    for i in np.flatnonzero((counts > 0) & ~long):
        w = words[offsets[i] : offsets[i + 1]]
        salt = mix(np.array([len(w)], dtype=_U))
        out[out_off[i]] = ((w * factors[: len(w)]).sum(keepdims=True, dtype=_U) + salt)[0]
    return mix(out), out_off


def _ramp(n: np.ndarray) -> np.ndarray:
    """0..n0-1, 0..n1-1, ..."""
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(n) else 0) - np.repeat(ends - n, n)


def shingle_sets(texts: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, and offsets."""
    sh, off = shingle_hashes(*word_hashes(*buffer_of(texts)), size)
    parts, counts = [], np.zeros(len(off) - 1, dtype=np.int64)
    for i in range(len(off) - 1):
        one = np.unique(sh[off[i] : off[i + 1]])
        parts.append(one)
        counts[i] = len(one)
    flat = np.concatenate(parts) if parts else np.zeros(0, dtype=_U)
    return flat, np.concatenate(([0], np.cumsum(counts)))
