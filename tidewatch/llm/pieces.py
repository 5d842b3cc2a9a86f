"""Sampled SentencePiece encoding without replacement, and decoding.

A text's lattice has a node before every character and an edge for every
vocabulary piece that matches there; a character that no piece covers is one
edge of its UTF-8 byte pieces. The weights of pieces define a distribution
over segmentations. The model file holds merge ranks, not probabilities, so a
piece's weight is ``(rank + 2) ** -alpha``, normalised over the vocabulary.

``sample_segmentations`` draws the ``k`` segmentations with the largest
Gumbel-perturbed log-probabilities, a sample without replacement, by A* over
the tree of prefixes: the bound of a set of segmentations (a common prefix and
the edges excluded after it) is its own Gumbel maximum, drawn top-down and
truncated at its parent's, so the next best set always holds the next best
segmentation. The score of inclusion is the probability that a segmentation's
perturbed value passes the (k + 1)-th largest (``log_inclusion``; 0 if the
text has no more than k segmentations).

No piece holds a blank after another character, or a line break, so lattices
are built for single words and kept in a bounded cache; a text's lattice is
the chain of its words. Random numbers depend on the row's key, the draw and
the character's place only: results are the same under any partitioning.

Defined results: a null text is empty; the empty text has one segmentation
(of the leading blank), a null key is a key like any other; repeated rows get
equal samples; an empty table gives an empty result; other columns are
ignored, or carried along if asked. Blanks and U+2581 survive the round trip:
U+2581 in a text is written in bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.textkit import _ramp, mix, slices

MODEL_FILE = "/opt/tokenizers/piece_bpe_32k.model"
_U = np.uint64
_CLASSES = 128
_BLANK = 0x2581
_OTHER_BLANK = 0x110001  # U+2581 of the text itself
FALLBACK = 1 << 21  # edge ids from here on: a character in byte pieces
_CACHE_UNITS = 60_000  # about 1 kB each
_UNIT = re.compile(r"\n| *[^ \n]+| +")


def load_vocabulary(model_file: str = MODEL_FILE) -> tuple[list[str], list[int], list[int]]:
    """(pieces, their ids, ids of the 256 byte pieces), read on the driver."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces, ids, bytes_ = [], [], [0] * 256
    for i in range(m.get_piece_size()):
        if m.is_byte(i):
            bytes_[int(m.id_to_piece(i)[3:5], 16)] = i
        elif not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i)):
            pieces.append(m.id_to_piece(i))
            ids.append(i)
    return pieces, ids, bytes_


class Vocabulary:
    """Trie and weights, as arrays; built on the driver, where the trie's dicts
    stay, and sent to the Python workers."""

    def __init__(self, pieces: list[str], ids: list[int], byte_ids: list[int], alpha: float = 1.0):
        self.byte_ids = np.array(byte_ids, dtype=np.int64)
        raw = -alpha * np.log(np.arange(len(pieces)) + 2.0)
        raw -= np.log(np.exp(raw).sum())
        self.floor = float(raw.min()) - 1.0  # of a byte piece
        children: list[dict[int, int]] = [{}]
        end = [-1]
        for p, text in enumerate(pieces):
            at = 0
            for c in text:
                nxt = children[at].get(ord(c))
                if nxt is None:
                    nxt = children[at][ord(c)] = len(children)
                    children.append({})
                    end.append(-1)
                at = nxt
            end[at] = p
        self.end = np.array(end, dtype=np.int32)
        self.weight, self.ids = raw, np.array(ids, dtype=np.int64)
        # the most used characters have a dense table, the others a sorted one
        uses: dict[int, int] = {}
        for n in children:
            for c in n:
                uses[c] = uses.get(c, 0) + 1
        common = sorted(uses, key=lambda c: (-uses[c], c))[: _CLASSES - 1]
        self.klass = np.zeros(0x110002, dtype=np.uint8)
        self.klass[common] = np.arange(1, len(common) + 1)
        self.dense = np.zeros((len(children), _CLASSES), dtype=np.uint16 if len(children) < 1 << 16 else np.int32)
        rare = []
        for n, kids in enumerate(children):
            for c, to in kids.items():
                if self.klass[c]:
                    self.dense[n, self.klass[c]] = to
                else:
                    rare.append(((n << 21) | c, to))
        rare.sort()
        self.rare_key = np.array([k for k, _ in rare] or [-1], dtype=np.int64)
        self.rare_to = np.array([t for _, t in rare] or [0], dtype=np.int64)
        # bytes of every id, for decoding
        text = {i: p.replace("▁", " ").encode() for p, i in zip(pieces, ids, strict=True)}
        text |= {int(i): bytes([b]) for b, i in enumerate(byte_ids)}
        size = max(text) + 1
        parts = [text.get(i, b"") for i in range(size)]
        self.piece_off = np.concatenate(([0], np.cumsum([len(x) for x in parts])))
        self.piece_bytes = np.frombuffer(b"".join(parts), dtype=np.uint8)

    def step(self, state: np.ndarray, code: np.ndarray) -> np.ndarray:
        k = self.klass[code]
        out = self.dense[state, k]
        odd = np.flatnonzero(k == 0)
        if len(odd):
            key = (state[odd].astype(np.int64) << 21) | code[odd]
            at = np.minimum(np.searchsorted(self.rare_key, key), len(self.rare_key) - 1)
            out[odd] = np.where(self.rare_key[at] == key, self.rare_to[at], 0)
        return out

    def text_bytes(self, ids: np.ndarray) -> bytes:
        """Bytes of a token sequence: pieces joined, blanks restored, the
        leading blank dropped."""
        ids = np.asarray(ids, dtype=np.int64)
        n = self.piece_off[ids + 1] - self.piece_off[ids]
        raw = self.piece_bytes[np.repeat(self.piece_off[ids], n) + _ramp(n)].tobytes()
        return raw[1:] if raw[:1] == b" " else raw

    def decode(self, ids: np.ndarray) -> str:
        """Text of a token sequence."""
        return self.text_bytes(ids).decode("utf-8", "replace")

    def expand(self, edges: np.ndarray) -> np.ndarray:
        """Token ids of edge ids: fallback characters become byte pieces."""
        odd = np.flatnonzero(edges >= FALLBACK)
        if not len(odd):
            return edges
        parts, last = [], 0
        for i in odd.tolist():
            code = int(edges[i]) - FALLBACK
            raw = chr(_BLANK if code == _OTHER_BLANK else code).encode("utf-8", "surrogatepass")
            parts += [edges[last:i], self.byte_ids[list(raw)]]
            last = i + 1
        return np.concatenate([*parts, edges[last:]])


class _Numbers(dict):
    """Word -> number; a word that is asked for the first time gets the next
    one and waits for its lattice."""

    def __init__(self, lattices: Lattices, lead: str):
        self.lattices, self.lead = lattices, lead

    def __missing__(self, word: str) -> int:
        number = self[word] = self.lattices.n_units
        self.lattices.n_units = number + 1
        self.lattices.new.append(self.lead + word)
        return number


class Lattices:
    """Word lattices as arrays of nodes and edges, grown word by word.

    A node's edges stand together, the longest (mostly the likeliest) first,
    with their cumulative probabilities, so a uniform number is matched after
    few steps."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.clear()

    def clear(self) -> None:
        self.units = _Numbers(self, "")  # with their blanks
        self.words = _Numbers(self, " ")  # after one blank, left out
        self.n_units = 0
        self.new: list[str] = []
        self.n_nodes = 0
        self.n_edges = 0
        self.base = np.empty(1024, dtype=np.int64)
        self.size = np.empty(1024, dtype=np.int64)
        self.first = np.empty(1 << 18, dtype=np.int32)  # first edge of each node, -1 at a word's end
        self.degree = np.empty(1 << 18, dtype=np.int32)
        self.cum = np.empty(1 << 20)
        self.logp = np.empty(1 << 20)
        self.to = np.empty(1 << 20, dtype=np.int32)
        self.id = np.empty(1 << 20, dtype=np.int32)

    def _room(self, name: str, n: int) -> np.ndarray:
        a = getattr(self, name)
        if len(a) < n:
            more = np.empty(max(n, len(a) + len(a) // 2), dtype=a.dtype)
            more[: len(a)] = a
            setattr(self, name, more)
            return more
        return a

    def look_up(self, text: str) -> list[int]:
        """Numbers of the lattices of a text's words; unknown words are added
        by ``settle``."""
        if "  " in text:
            return list(map(self.units.__getitem__, _UNIT.findall(" " + text)))
        return list(map(self.words.__getitem__, text.split(" ")))

    def settle(self) -> None:
        if self.new:
            new, self.new = self.new, []
            self._add(new)

    def _add(self, words: list[str]) -> None:
        v = self.v
        code = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        code = np.where(code == _BLANK, _OTHER_BLANK, np.where(code == 0x20, _BLANK, code))
        size = np.array([len(w) for w in words], dtype=np.int64)
        stop = np.repeat(np.cumsum(size), size)  # behind the word of each character
        # edges: walk the trie from every character at once
        at = np.arange(len(code))
        state = np.zeros(len(code), dtype=np.int64)
        by_length = []  # (places, pieces) of the edges of each length
        for length in range(1, 1 << 30):
            state = v.step(state, code[at + length - 1]).astype(np.int64)
            alive = state > 0
            at, state = at[alive], state[alive]
            hit = v.end[state]
            own = hit >= 0
            by_length.append((at[own], hit[own]))
            alive = at + length < stop[at]
            at, state = at[alive], state[alive]
            if not len(at):
                break
        single = np.zeros(len(code), dtype=bool)
        single[by_length[0][0]] = True
        odd = np.flatnonzero(~single)
        n_bytes = np.where(code[odd] < 0x80, 1, np.where(code[odd] < 0x800, 2, np.where((code[odd] < 0x10000) | (code[odd] == _OTHER_BLANK), 3, 4)))
        # a place's edges stand together, the longest first
        degrees = np.bincount(odd, minlength=len(code))
        for place, _ in by_length:
            degrees[place] += 1
        head = np.concatenate(([0], np.cumsum(degrees)))
        free = head[:-1].copy()
        n_edges = int(head[-1])
        e, w, ids = np.empty(n_edges, np.int64), np.empty(n_edges), np.empty(n_edges, np.int64)
        for length in range(len(by_length), 0, -1):
            place, piece = by_length[length - 1]
            to = free[place]
            e[to], w[to], ids[to] = place + length, v.weight[piece], v.ids[piece]
            free[place] += 1
        to = free[odd]
        e[to], w[to], ids[to] = odd + 1, v.floor * n_bytes, FALLBACK + code[odd]
        s = np.repeat(np.arange(len(code)), degrees)
        # backward sums, by distance from the next place that no edge crosses
        reach = np.maximum.accumulate(np.maximum.reduceat(e, head[:-1])) if len(code) else np.zeros(0, np.int64)
        cut = np.concatenate(([True], reach[:-1] <= np.arange(1, len(code)), [True])) if len(code) else np.array([True])
        places = np.flatnonzero(cut)
        to_cut = places[np.searchsorted(places, np.arange(len(code)), side="right")] - np.arange(len(code))
        beta = np.zeros(len(code) + 1)
        by_distance = np.argsort(to_cut, kind="stable")
        groups = np.searchsorted(to_cut[by_distance], np.arange(1, (to_cut.max() if len(code) else 0) + 2))
        for d in range(len(groups) - 1):
            nodes = by_distance[groups[d] : groups[d + 1]]
            if not len(nodes):
                continue
            n = head[nodes + 1] - head[nodes]
            edge = np.repeat(head[nodes], n) + _ramp(n)
            # at a cut the sums start anew
            val = w[edge] + np.where(cut[e[edge]], 0.0, beta[e[edge]])
            first = np.cumsum(n) - n
            top = np.maximum.reduceat(val, first)
            beta[nodes] = top + np.log(np.add.reduceat(np.exp(val - np.repeat(top, n)), first))
        logp = w + np.where(cut[e], 0.0, beta[e]) - beta[s]
        # into the shared arrays; each word has a node more than characters
        word = np.repeat(np.arange(len(words)), size)
        node0 = self.n_nodes + np.cumsum(size + 1) - (size + 1)
        shift = node0 - (np.cumsum(size) - size)
        node = np.arange(len(code)) + shift[word]
        n_nodes = self.n_nodes + int((size + 1).sum())
        n_edges = self.n_edges + len(s)
        total = np.cumsum(np.exp(logp))
        before = np.concatenate(([0.0], total))[head[s]]
        share = total - before
        share[head[1:][degrees > 0] - 1] = 2.0  # the last edge takes the rest
        first, degree = self._room("first", n_nodes), self._room("degree", n_nodes)
        first[self.n_nodes : n_nodes] = -1
        first[node] = self.n_edges + head[:-1]
        degree[node] = degrees
        self._room("cum", n_edges)[self.n_edges : n_edges] = share
        self._room("logp", n_edges)[self.n_edges : n_edges] = logp
        self._room("to", n_edges)[self.n_edges : n_edges] = node[s] + (e - s)
        self._room("id", n_edges)[self.n_edges : n_edges] = ids
        u0 = self.n_units - len(words)
        self._room("base", self.n_units)[u0 : self.n_units] = node0
        self._room("size", self.n_units)[u0 : self.n_units] = size
        self.n_nodes, self.n_edges = n_nodes, n_edges


def _uniform(seed: np.ndarray, draw: int, place: np.ndarray, use: int) -> np.ndarray:
    """Numbers in (0, 1) from the row's seed, the draw and the place."""
    x = mix(place.astype(_U) * _U(4) + _U(use)) + seed * _U(0x9E3779B97F4A7C15) + _U((draw * 0xD1B54A32D192ED03) % (1 << 64))
    return ((mix(x) >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def _truncated(phi: np.ndarray, u: np.ndarray, bound: np.ndarray) -> np.ndarray:
    """Gumbel maxima of sets with log-masses ``phi``, given they are below
    ``bound``."""
    g = phi - np.log(-np.log(u))
    # -log(exp(-bound) + exp(-g)), safely
    return -np.logaddexp(-bound, -g)


def sample_segmentations(texts: list[str], seeds: np.ndarray, lattices: Lattices, k: int) -> list[list[tuple]]:
    """For each text, up to ``k`` (edge ids, log-probability, perturbed
    log-probability, log of inclusion), best first."""
    if lattices.n_units > _CACHE_UNITS:
        lattices.clear()
    units, counts = [], []
    for t in texts:
        w = lattices.look_up(t)
        units += w
        counts.append(len(w))
    lattices.settle()
    L = lattices
    unit = np.array(units, dtype=np.int64)
    size = L.size[unit]
    offset = np.cumsum(size) - size  # of each word among the batch's characters
    n_chars = int(size.sum())
    text_word = np.concatenate(([0], np.cumsum(counts)))
    text_start = np.append(offset, n_chars)[text_word]
    word_text = np.repeat(np.arange(len(texts)), counts)
    base = L.base[unit]
    seeds = seeds.astype(_U)
    to_place = offset - base
    start_of = text_start[word_text]
    seed_of = seeds[word_text]

    def walk(edge_at: np.ndarray, draw: int, occ: np.ndarray, node: np.ndarray) -> None:
        """Sample onward from the nodes of word occurrences to the words' ends."""
        while len(occ):
            edge = L.first[node]
            go_on = edge >= 0
            if not go_on.all():
                occ, node, edge = occ[go_on], node[go_on], edge[go_on]
                if not len(occ):
                    break
            place = node + to_place[occ]
            u = _uniform(seed_of[occ], draw, place - start_of[occ], 0)
            more = np.flatnonzero(L.cum[edge] <= u)
            while len(more):
                edge[more] += 1
                more = more[L.cum[edge[more]] <= u[more]]
            edge_at[place] = edge
            node = L.to[edge].astype(np.int64)

    n = len(texts)
    paths: list[np.ndarray] = []  # by draw: edge at each character, or -1
    bound: list[np.ndarray] = []  # by draw: perturbed value of each text's draw
    sets: list[list[list]] = [[] for _ in range(n)]  # open sets of each text: [value, draw, place]
    branch: list[dict[int, tuple[int, tuple[int, ...]]]] = []  # by draw: text -> (place, edges excluded before)
    found: list[list[int]] = [[] for _ in range(n)]
    logs: list[np.ndarray] = []

    first = np.full(n_chars, -1, dtype=np.int64)
    walk(first, 0, np.arange(len(unit)), base.copy())
    zero = np.zeros(n, dtype=np.int64)
    paths.append(first)
    bound.append(-np.log(-np.log(_uniform(seeds, 0, zero, 2))))
    branch.append({i: (int(text_start[i]), ()) for i in range(n)})
    live = list(range(n))
    values: list[tuple[np.ndarray, ...]] = []  # by draw: places, their values, texts' cuts
    for draw in range(k):
        # bounds of the sets left of this draw's path
        edge_at = paths[draw]
        place = np.flatnonzero(edge_at >= 0)
        cuts = np.searchsorted(place, text_start)
        edge = edge_at[place]
        logp = L.logp[edge]
        total = np.concatenate(([0.0], np.cumsum(logp)))
        prefix = total[:-1] - np.repeat(total[cuts[:-1]], np.diff(cuts))
        logs.append(total[cuts[1:]] - total[cuts[:-1]])
        own = np.zeros(n, dtype=bool)
        own[live] = True
        since = np.array([branch[draw][i][0] if own[i] else n_chars for i in range(n)])

        def bounds(some: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            """Values of the sets at some of the path's places."""
            at = place[some]  # noqa: B023
            text = np.searchsorted(text_start[1:], at, side="right")
            some, at, text = (x[own[text] & (at >= since[text])] for x in (some, at, text))  # noqa: B023
            rest = -np.expm1(np.minimum(logp[some], 0.0))  # noqa: B023
            cut = np.searchsorted(at, text_start)
            for i in live:  # noqa: B023
                start, gone = branch[draw][i]  # noqa: B023
                if gone:  # edges excluded earlier at the branching place
                    j = int(np.searchsorted(at, start))
                    rest[j] = max(0.0, rest[j] - float(np.exp(L.logp[list(gone)]).sum()))
            with np.errstate(divide="ignore"):
                phi = prefix[some] + np.log(np.where(rest < 1e-12, 0.0, rest))  # noqa: B023
            u = _uniform(seeds[text], draw, at - text_start[text], 1)  # noqa: B023
            return at, _truncated(phi, u, bound[draw][text]), cut  # noqa: B023

        # sets behind a prefix of less than e ** -100 pass e ** -40 with a chance below rounding
        value = bounds(np.flatnonzero(prefix > -100.0))
        low = [i for i in live if value[2][i + 1] == value[2][i] or value[1][value[2][i] : value[2][i + 1]].max() < -40]
        if low and len(value[0]) < len(place):
            value = bounds(np.arange(len(place)))
        values.append(value)
        for i in live:
            found[i].append(draw)
        if draw + 1 == k:
            break
        # the best open set of each text is the next draw
        nxt = np.full(n_chars, -1, dtype=np.int64)
        g = np.full(n, -np.inf)
        occ_all, node_all, branches, still = [], [], {}, []
        for i in live:
            r, j, best = _best(values, i)
            if best == -np.inf:
                continue
            p, val, c = values[r]
            val[j] = -np.inf  # opened
            at = int(p[j])
            old = int(paths[r][at])
            gone = (old,) + (branch[r][i][1] if at == branch[r][i][0] else ())
            nxt[text_start[i] : at] = paths[r][text_start[i] : at]
            # another edge at the branching place
            o = int(np.searchsorted(offset, at, side="right")) - 1
            node = int(base[o]) + at - int(offset[o])
            cand = np.setdiff1d(np.arange(L.first[node], L.first[node] + L.degree[node]), gone)
            prob = np.exp(L.logp[cand])
            x = float(_uniform(seeds[i : i + 1], draw + 1, np.array([at - text_start[i]]), 3)[0])
            pick = int(cand[min(int(np.searchsorted(np.cumsum(prob / prob.sum()), x, side="right")), len(cand) - 1)])
            nxt[at] = pick
            branches[i] = (at, gone)
            g[i] = best
            last = int(text_word[i + 1])
            occ_all.append(np.arange(o, last))
            node_all.append(np.concatenate(([L.to[pick]], base[o + 1 : last])))
            still.append(i)
        live = still
        if not live:
            break
        walk(nxt, draw + 1, np.concatenate(occ_all), np.concatenate(node_all))
        paths.append(nxt)
        bound.append(g)
        branch.append(branches)
    out: list[list[tuple]] = []
    for i in range(n):
        kappa = _best(values, i)[2]
        rows = []
        for r in found[i]:
            path = paths[r][text_start[i] : text_start[i + 1]]
            log = float(logs[r][i])
            rows.append((L.id[path[path >= 0]].astype(np.int64), log, float(bound[r][i]), _log_inclusion(log, kappa)))
        out.append(rows)
    return out


def _best(values: list[tuple[np.ndarray, ...]], i: int) -> tuple[int, int, float]:
    """(draw, index, value) of a text's best open set."""
    top = (-1, -1, -np.inf)
    for r, (_, val, cuts) in enumerate(values):
        if cuts[i + 1] > cuts[i]:
            j = int(cuts[i] + val[cuts[i] : cuts[i + 1]].argmax())
            if val[j] > top[2]:
                top = (r, j, float(val[j]))
    return top


def _log_inclusion(log: float, kappa: float) -> float:
    if kappa == -np.inf:
        return 0.0
    x = log - kappa
    if x > 4:
        return 0.0
    # log(1 - exp(-exp(x)))
    return x if x < -30 else float(np.log(-np.expm1(-np.exp(x))))


# --- Spark -------------------------------------------------------------------

_WORKER: dict[tuple, Lattices] = {}


def _lattices(vocabulary: Vocabulary, key: tuple) -> Lattices:
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Lattices(vocabulary)
    return _WORKER[key]


def encode(
    docs: DataFrame,
    k: int = 2,
    alpha: float = 1.0,
    model_file: str = MODEL_FILE,
    keep: tuple[str, ...] = (),
    with_ids: bool = True,
) -> DataFrame:
    """doc_id, the columns ``keep`` and ``samples``: array of (n_tokens, ids
    or null, ids_sha256, log_prob, perturbed, log_inclusion, round_trip), best
    first. ``round_trip``: the ids decode to the text."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(*load_vocabulary(model_file), alpha))
    key = (model_file, alpha)
    names = list(dict.fromkeys(["doc_id", *keep]))
    own = docs.select(*names, F.xxhash64("doc_id").alias("_seed"), F.col("text").alias("_text"))
    sample = pa.struct(
        [
            ("n_tokens", pa.int64()),
            ("ids", pa.list_(pa.int32())),
            ("ids_sha256", pa.string()),
            ("log_prob", pa.float64()),
            ("perturbed", pa.float64()),
            ("log_inclusion", pa.float64()),
            ("round_trip", pa.bool_()),
        ]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattices = _lattices(shared.value, key)
        try:
            for b in batches:
                yield from encoded(b, lattices)
        finally:
            lattices.clear()  # a worker outlives its tasks: its next one may need the memory

    def encoded(b: pa.RecordBatch, lattices: Lattices) -> Iterator[pa.RecordBatch]:
        v = lattices.v
        for part in slices(b, "_text", 64):
            texts = [t or "" for t in part.column("_text").to_pylist()]
            seeds = part.column("_seed").to_numpy(zero_copy_only=False).view(_U)
            found = sample_segmentations(texts, seeds, lattices, k)
            flat = [x for one in found for x in one]
            ids = [v.expand(edges).astype("<i4") for edges, *_ in flat]
            ends = np.cumsum([0, *(len(one) for one in found)])
            tokens = np.array([len(x) for x in ids], dtype=np.int64)
            trips = []
            for t, lo, hi in zip(texts, ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                raw = t.encode("utf-8", "surrogatepass")
                trips += [v.text_bytes(ids[x]) == raw for x in range(lo, hi)]
            if with_ids:
                every = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(tokens))), pa.int32()), pa.array(every))
            else:
                lists = pa.nulls(len(ids), pa.list_(pa.int32()))
            numbers = [pa.array([x[c] for x in flat], pa.float64()) for c in (1, 2, 3)]
            digests = pa.array([hashlib.sha256(x.tobytes()).hexdigest() for x in ids], pa.string())
            fields = [pa.array(tokens), lists, digests, *numbers, pa.array(trips, pa.bool_())]
            samples = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(fields, fields=list(sample)))
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), samples], [*names, "samples"])

    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + (
        ", samples array<struct<n_tokens:bigint,ids:array<int>,ids_sha256:string,log_prob:double,perturbed:double,"
        "log_inclusion:double,round_trip:boolean>>"
    )
    return own.mapInArrow(work, schema)


def decode(encoded: DataFrame, ids: str = "ids", model_file: str = MODEL_FILE) -> DataFrame:
    """The input's columns and ``text`` decoded from an array of token ids."""
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary(*load_vocabulary(model_file)))

    @F.pandas_udf("string")
    def text_of(column):
        v = shared.value
        return column.map(lambda x: None if x is None else v.decode(np.asarray(x)))

    return encoded.withColumn("text", text_of(F.col(ids)))
