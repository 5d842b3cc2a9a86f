"""The alert machine (deduplication and rate limit as one) over one run of rows.

Row by row: a row is a ``duplicate`` while less than the dedup window has
passed since its key's last emission; else it is a candidate. The first
candidate, and each candidate at least a rate window after the open one
began, opens a rate window; a candidate is ``emitted`` while the window has
budget, else ``rate_limited``, and then leaves no trace in the dedup state.

Only emissions and openings change the state, so the machine jumps from one
possible candidate of a key to its next (binary searches in the key's own
times): after an emission the key's next candidate is its first row a dedup
window later, after a refusal its first row after the open rate window. Rows
in between get their status afterwards, all at once.
"""

from __future__ import annotations

import heapq
import json

import numpy as np

DUPLICATE, EMITTED, LIMITED = 0, 1, 2
STATUS = np.array(["duplicate", "emitted", "rate_limited"], dtype=object)


class MachineState:
    """Last emission by dedup key, start of the open rate window, its count."""

    def __init__(self, text: str | None = None):
        was = json.loads(text) if text else {"last": [], "start": None, "count": 0}
        self.last = {(f, a): t for f, a, t in was["last"]}
        self.start, self.count = was["start"], was["count"]

    def forget(self, horizon: int, gap_d: int, gap_r: int) -> MachineState:
        """Drop what cannot matter to rows at ``horizon`` or later."""
        self.last = {k: t for k, t in self.last.items() if t + gap_d > horizon}
        if self.start is not None and self.start + gap_r <= horizon:
            self.start, self.count = None, 0
        return self

    def until(self, gap_d: int, gap_r: int) -> int | None:
        """The time from which the whole state no longer matters."""
        ends = [t + gap_d for t in self.last.values()]
        return max([*ends, *([self.start + gap_r] if self.start is not None else [])], default=None)

    def text(self) -> str:
        rows = sorted(([f, a, t] for (f, a), t in self.last.items()), key=lambda r: (str(r[0]), str(r[1])))
        return json.dumps({"last": rows, "start": self.start, "count": self.count})


def run_machine(ts: np.ndarray, keys: list[tuple], state: MachineState, gap_d: int, gap_r: int, limit: int) -> np.ndarray:
    """Status codes of rows in order; ``state`` becomes the state after them."""
    names: dict[tuple, int] = {}
    code = np.fromiter((names.setdefault(k, len(names)) for k in keys), np.int64, len(keys))
    return run_coded(ts, code, list(names), state, gap_d, gap_r, limit)


def run_coded(
    ts: np.ndarray, code: np.ndarray, names: list[tuple], state: MachineState, gap_d: int, gap_r: int, limit: int,
    status: bool = True,
) -> np.ndarray | None:
    """:func:`run_machine` over rows whose keys are ``names[code]``; without
    ``status`` for the state alone."""
    if len(ts) > 1 and (np.diff(ts) < 0).any():
        return _by_row(ts, [names[c] for c in code.tolist()], state, gap_d, gap_r, limit)
    order = np.argsort(code, kind="stable")
    edges = np.searchsorted(code[order], np.arange(len(names) + 1))
    place = np.empty(len(ts), np.int64)  # of a row among its key's rows
    place[order] = np.arange(len(ts)) - edges[code[order]]
    rows = [order[a:b] for a, b in zip(edges[:-1], edges[1:])]
    times = [ts[r] for r in rows]
    held = [state.last.get(k) for k in names]
    last, start, count = list(held), state.start, state.count
    emitted = np.zeros(len(ts), bool)
    heap = []
    for k, t in enumerate(held):
        j = 0 if t is None else int(np.searchsorted(times[k], t + gap_d))
        if j < len(rows[k]):
            heap.append((int(rows[k][j]), k))
    heapq.heapify(heap)
    while heap:
        i, k = heap[0]
        t = int(ts[i])
        if start is None or t - start >= gap_r:
            start, count = t, 0
        if count < limit:
            count += 1
            emitted[i], last[k] = True, t
            again = t + gap_d
        else:
            again = start + gap_r
        j = max(int(place[i]) + 1, int(np.searchsorted(times[k], again)))
        if j < len(rows[k]):
            heapq.heapreplace(heap, (int(rows[k][j]), k))
        else:
            heapq.heappop(heap)
    since = np.array([0 if t is None else t for t in held], np.int64)
    known = np.array([t is not None for t in held], bool)
    for k, name in enumerate(names):
        if last[k] is not None:
            state.last[name] = last[k]
    state.start, state.count = start, count
    if not status:
        return None
    # duplicates: rows within a dedup window of the emission before them
    mine, own = emitted[order], ts[order]
    at = np.arange(len(ts))
    before = np.concatenate(([-1], np.maximum.accumulate(np.where(mine, at, -1))[:-1])) if len(ts) else at
    inside = before >= edges[code[order]]
    prior = np.where(inside, own[np.maximum(before, 0)], since[code[order]])
    dup = (inside | known[code[order]]) & (own - prior < gap_d)
    found = np.empty(len(ts), np.int8)
    found[order] = np.where(mine, EMITTED, np.where(dup, DUPLICATE, LIMITED))
    return found


def _by_row(ts: np.ndarray, keys: list[tuple], state: MachineState, gap_d: int, gap_r: int, limit: int) -> np.ndarray:
    """The same for rows out of time order (late rows in arrival order)."""
    status = np.empty(len(ts), np.int8)
    last, start, count = state.last, state.start, state.count
    for i, (t, k) in enumerate(zip(ts.tolist(), keys)):
        before = last.get(k)
        if before is not None and t - before < gap_d:
            status[i] = DUPLICATE
            continue
        if start is None or t - start >= gap_r:
            start, count = t, 0
        if count < limit:
            count += 1
            last[k] = t
            status[i] = EMITTED
        else:
            status[i] = LIMITED
    state.start, state.count = start, count
    return status
