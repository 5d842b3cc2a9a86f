"""NumPy kernel for count-window statistics over a sorted value array.

Used inside Spark tasks on one bounded block of rows. Windows are the
last ``W`` values of the row's own segment (a key run, cut again at a
reset). Statistics follow NumPy's definitions: mean, sample std (ddof=1),
linear-interpolated quartiles, min/max; rows with fewer than two values are
"not ready" and get NaN (NULL in Spark).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

STAT_NAMES = (
    "win_count", "win_mean", "win_std", "win_min", "win_max",
    "win_p25", "win_median", "win_p75", "win_iqr", "zscore",
)
QUANTILES = (0.25, 0.5, 0.75)
#: statistics that follow from sums, without the order of a window's values
SUM_STATS = {"win_count", "win_mean", "win_std", "zscore"}


def _lerp_sorted(s: np.ndarray, n: np.ndarray, q: float) -> np.ndarray:
    """Linear-interpolated quantile of each row of ``s`` (rows sorted, first ``n`` valid)."""
    pos = (n - 1) * q
    lo = np.floor(pos).astype(np.int64)
    hi = np.minimum(lo + 1, n - 1)
    frac = pos - lo
    r = np.arange(s.shape[0])
    a = s[r, lo]
    b = s[r, hi]
    return a + (b - a) * frac


def _full_rows(sub: np.ndarray, w: int) -> dict[str, np.ndarray]:
    """Rows of exactly ``w`` values: one in-place sort per row gives min, max
    and the quartiles by index (faster than a multi-kth partition)."""
    a = np.array(sub, dtype=np.float64, copy=True)
    a.sort(axis=1)
    n = np.full(a.shape[0], w, dtype=np.int64)
    qs = [_lerp_sorted(a, n, q) for q in QUANTILES]
    return {"min": a[:, 0], "max": a[:, -1], "q": qs}


def _kth_of_union(core: np.ndarray, g: np.ndarray, extra: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """k-th and (k+1)-th smallest (0-based) of ``core[g[r]] U extra[r]`` per row r.

    ``core`` (G x m) and ``extra`` (R x e) rows are sorted. Binary search on
    j = how many of the k+1 smallest come from ``extra``, for all rows at once.
    """
    m = core.shape[1]
    e = extra.shape[1]
    r = np.arange(extra.shape[0])
    lo = np.full(r.shape, max(0, k + 1 - m), dtype=np.int64)
    hi = np.full(r.shape, min(k + 1, e), dtype=np.int64)
    while True:
        todo = lo < hi
        if not todo.any():
            break
        mid = (lo + hi) // 2
        i_a = k - mid  # index of the last element taken from core, if any
        a_val = core[g, np.clip(i_a, 0, m - 1)]
        b_val = extra[r, np.clip(mid, 0, e - 1)]
        need_more_b = (mid < e) & (i_a >= 0) & (a_val > b_val)
        lo = np.where(todo & need_more_b, mid + 1, lo)
        hi = np.where(todo & ~need_more_b, mid, hi)
    j = lo
    i = k + 1 - j
    neg, pos = -np.inf, np.inf
    a_prev = np.where(i > 0, core[g, np.clip(i - 1, 0, m - 1)], neg)
    b_prev = np.where(j > 0, extra[r, np.clip(j - 1, 0, e - 1)], neg)
    a_next = np.where(i < m, core[g, np.clip(i, 0, m - 1)], pos)
    b_next = np.where(j < e, extra[r, np.clip(j, 0, e - 1)], pos)
    return np.maximum(a_prev, b_prev), np.minimum(a_next, b_next)


def _full_chunks(v: np.ndarray, starts: np.ndarray, w: int, c: int) -> dict[str, np.ndarray]:
    """Full windows of ``c`` consecutive rows per chunk, chunk rows a..a+c-1.

    All windows of a chunk share the core v[a+c-w .. a]; row a+t adds the
    c-1 values O[t : t+c-1] of O = v[a-w+1 .. a+c-w-1] ++ v[a+1 .. a+c-1].
    One sort per chunk core plus one small sort per row replaces a sort of
    w values per row; quartiles come from a k-th-of-two-sorted-arrays search.
    """
    m = w - c + 1
    core = np.sort(sliding_window_view(v, m)[starts + c - w], axis=1)  # (G, m)
    side = sliding_window_view(v, c - 1)
    outer = np.concatenate([side[starts - w + 1], side[starts + 1]], axis=1)  # (G, 2c-2)
    extra = sliding_window_view(outer, c - 1, axis=1)[:, :c, :].reshape(-1, c - 1)  # (G*c, c-1)
    extra = np.sort(extra, axis=1)
    g = np.repeat(np.arange(len(starts)), c)
    qs = []
    for q in QUANTILES:
        pos = (w - 1) * q
        k = int(np.floor(pos))
        frac = pos - k
        a, b = _kth_of_union(core, g, extra, k)
        if k + 1 > w - 1:
            b = a
        qs.append(a + (b - a) * frac)
    return {"min": np.minimum(core[g, 0], extra[:, 0]), "max": np.maximum(core[g, -1], extra[:, -1]), "q": qs}


def _chunk_starts(full_rows: np.ndarray, c: int) -> tuple[np.ndarray, np.ndarray]:
    """Split sorted row indices into chunks of ``c`` consecutive rows.

    Returns (chunk start rows, positions in ``full_rows`` not covered)."""
    if len(full_rows) == 0:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
    brk = np.flatnonzero(np.diff(full_rows) != 1) + 1
    run_lo = np.r_[0, brk]
    run_hi = np.r_[brk, len(full_rows)]
    starts, rest = [], []
    for lo, hi in zip(run_lo, run_hi):
        n_chunks = (hi - lo) // c
        if n_chunks:
            starts.append(full_rows[lo] + c * np.arange(n_chunks))
        rest.append(np.arange(lo + n_chunks * c, hi))
    st = np.concatenate(starts) if starts else np.zeros(0, dtype=np.int64)
    return st.astype(np.int64), np.concatenate(rest).astype(np.int64)


def _partial_rows(sub: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """``sub`` right-aligned windows with NaN padding on the left."""
    s = np.sort(sub, axis=1)  # NaN sort last
    qs = [_lerp_sorted(s, n, q) for q in QUANTILES]
    r = np.arange(sub.shape[0])
    return {"min": s[:, 0], "max": s[r, n - 1], "q": qs}


def _spread(s1: np.ndarray, s2: np.ndarray, n) -> np.ndarray:
    return np.sqrt(np.maximum((s2 - s1 * s1 / n) / (n - 1), 0).astype(np.float64))


def _finite(x: np.ndarray) -> np.ndarray:
    return np.where(np.isfinite(x), x, 0)


def _block_moments(v: np.ndarray, rows: np.ndarray, w: int) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of the full windows that end at ``rows``, some
    operations per value of ``v`` whatever ``w``.

    ``v`` is cut into blocks of ``w`` values. A window that ends in a block is
    the end of the block before it and the start of its own: a running sum of
    each, nothing is subtracted again. Sums are taken in extended precision
    around the block's first value, which every such window holds, so that
    S2 - S1^2/w keeps its digits (S2 is at most w + 1 times the difference)."""
    ld = np.longdouble
    blocks = np.zeros((-(-len(v) // w), w), dtype=ld)
    blocks.reshape(-1)[: len(v)] = v
    anchor = _finite(blocks[:, 0])
    b, t = rows // w, rows % w
    s1, s2 = np.zeros(len(rows), dtype=ld), np.zeros(len(rows), dtype=ld)
    own = blocks - anchor[:, None]
    before = blocks[:-1, ::-1] - anchor[1:, None]
    reach = t < w - 1  # the window begins in the block before
    rb, rt = b[reach] - 1, w - 2 - t[reach]
    for total, power in ((s1, 1), (s2, 2)):
        total += np.cumsum(own**power if power > 1 else own, axis=1)[b, t]
        total[reach] += np.cumsum(before**power if power > 1 else before, axis=1)[rb, rt]
    return (anchor[b] + s1 / w).astype(np.float64), _spread(s1, s2, w)


def _prefix_moments(v: np.ndarray, start: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and deviation of ``n`` values from ``start`` on (not decreasing),
    by running sums from each start, around the value there."""
    ld = np.longdouble
    first = np.flatnonzero(np.r_[True, start[1:] != start[:-1]])
    at = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(start)]))
    length = np.maximum.reduceat(n, first)
    s1, s2 = np.zeros(len(n), dtype=ld), np.zeros(len(n), dtype=ld)
    size = np.frexp(length.astype(np.float64))[1]  # runs of like length together
    for k in np.unique(size):
        runs = np.flatnonzero(size == k)
        lot = max(1, (1 << 18) >> int(k))
        for lo in range(0, len(runs), lot):
            some = runs[lo : lo + lot]
            begin = start[first[some]]
            cells = np.minimum(begin[:, None] + np.arange(int(length[some].max())), len(v) - 1)
            y = v[cells].astype(ld) - _finite(v[begin]).astype(ld)[:, None]
            place = np.full(len(first), -1, dtype=np.int64)
            place[some] = np.arange(len(some))
            mine = np.flatnonzero(place[at] >= 0)
            cell = place[at[mine]], n[mine] - 1
            s1[mine] = np.cumsum(y, axis=1)[cell]
            s2[mine] = np.cumsum(y * y, axis=1)[cell]
    return (_finite(v[start]) + s1 / n).astype(np.float64), _spread(s1, s2, n)


def _sum_stats(v: np.ndarray, start: np.ndarray, rows: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, deviation) of the windows ``start[i]..rows[i]``; NaN where a
    window holds fewer than two values."""
    n = rows - start + 1
    mean, std = np.full(len(rows), np.nan), np.full(len(rows), np.nan)
    with np.errstate(invalid="ignore", over="ignore"):
        for pick, make in ((n == window, lambda r, s, k: _block_moments(v, r, window)),
                           (n < window, lambda r, s, k: _prefix_moments(v, s, k))):
            at = np.flatnonzero(pick & (n >= 2))
            if len(at):
                mean[at], std[at] = make(rows[at], start[at], n[at])
    # a constant window has deviation exactly 0 (sums may leave rounding noise)
    changes = np.concatenate(([0], np.cumsum(v[1:] != v[:-1])))
    std[(n >= 2) & (changes[rows] == changes[np.minimum(start, len(v) - 1)])] = 0.0
    return mean, std


def _zscores(x: np.ndarray, mean: np.ndarray, std: np.ndarray, ready: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        z = np.where(std > 0, (np.asarray(x, dtype=np.float64) - mean) / std, 0.0)
    return np.where(ready, z, np.nan)


def window_stats(
    values: np.ndarray,
    seg_start: np.ndarray,
    window: int,
    rows: np.ndarray,
    current: np.ndarray | None = None,
    chunk: int = 1024,
    merge_chunk: int | None = None,
    names: Sequence[str] | None = None,
) -> dict[str, np.ndarray]:
    """Statistics of the windows ending at ``rows`` (indices into ``values``).

    ``seg_start[i]`` is the first index of row i's segment. ``current`` is
    the value each z-score is taken for (default: the row's own value).
    ``names`` are the statistics that are read (default: all); where they all
    follow from sums, no window is sorted and the others stay NaN.
    """
    v = np.asarray(values, dtype=np.float64)
    rows = np.asarray(rows, dtype=np.int64)
    m = len(rows)
    start = np.maximum(np.asarray(seg_start, dtype=np.int64)[rows], rows - window + 1)
    n = rows - start + 1
    res = {k: np.full(m, np.nan) for k in STAT_NAMES}
    res["win_count"] = n.astype(np.int64)
    if m == 0:
        return res
    ready = n >= 2
    mean, std = _sum_stats(v, start, rows, window)
    res.update(win_mean=mean, win_std=std, zscore=_zscores(v[rows] if current is None else current, mean, std, ready))
    if names is not None and SUM_STATS.issuperset(names):
        return res
    vmin = np.full(m, np.nan)
    vmax = np.full(m, np.nan)
    qv = [np.full(m, np.nan) for _ in QUANTILES]

    def put(sel: np.ndarray, d: dict) -> None:
        vmin[sel] = d["min"]
        vmax[sel] = d["max"]
        for j in range(len(QUANTILES)):
            qv[j][sel] = d["q"][j]

    full = ready & (n == window)
    part = ready & (n < window)
    if merge_chunk is None:  # measured: merging pays from a few hundred values up
        merge_chunk = 32 if window >= 800 else (16 if window >= 256 else 0)
    if full.any():
        view = sliding_window_view(v, window)
        fsel = np.flatnonzero(full)
        if merge_chunk and window >= 2 * merge_chunk:
            # rows are sorted, so consecutive selections are consecutive rows
            starts, rest = _chunk_starts(rows[fsel], merge_chunk)
            if len(starts):
                covered = np.setdiff1d(np.arange(len(fsel)), rest, assume_unique=True)
                for c0 in range(0, len(starts), max(1, chunk // merge_chunk * 8)):
                    st = starts[c0 : c0 + max(1, chunk // merge_chunk * 8)]
                    sel = fsel[covered[c0 * merge_chunk : c0 * merge_chunk + len(st) * merge_chunk]]
                    put(sel, _full_chunks(v, st, window, merge_chunk))
                fsel = fsel[rest]
        for c in range(0, len(fsel), chunk):
            sel = fsel[c : c + chunk]
            put(sel, _full_rows(view[rows[sel] - window + 1], window))
    if part.any():
        psel = np.flatnonzero(part)
        padded = np.concatenate([np.full(window - 1, np.nan), v])
        pview = sliding_window_view(padded, window)  # pview[i] ends at v[i]
        for c in range(0, len(psel), chunk):
            sel = psel[c : c + chunk]
            nn = n[sel]
            width = int(nn.max())
            sub = pview[rows[sel]][:, window - width :].copy()
            cols = np.arange(width)[None, :]
            sub[cols < (width - nn)[:, None]] = np.nan
            put(sel, _partial_rows(sub, nn))

    res.update(win_min=vmin, win_max=vmax, win_p25=qv[0], win_median=qv[1], win_p75=qv[2], win_iqr=qv[2] - qv[0])
    return res
