"""Near-duplicate documents by MinHash and a multi-index Hamming join.

Two documents are linked if the Jaccard similarity of their sets of distinct
five-word shingles is at least ``threshold_pct`` per cent; documents form the
connected components of these links.

1. One pass over the texts gives each document's set size, a 128-bit
   fingerprint of its set, a b-bit MinHash signature (``HASHES`` symbols of 16
   bits) and a one-permutation sketch. Documents with equal sets form one
   class, represented by its smallest doc_id: from here on a class counts once.
2. Multi-index: the signature is cut into chunks of ``CHUNK`` symbols. By the
   pigeonhole principle two signatures that differ in at most
   ``2 * chunks - 1`` symbols differ in at most one symbol of some chunk. Each
   chunk is therefore entered once for every symbol that may be wrong, that
   symbol left out: every pair under that distance meets in a key. (At the
   similarity of 0.75 a pair misses all of its 32 keys with probability
   3e-5; under the distance of 15 of 32 symbols never.)
3. Each class is first compared with one other: of the smallest members of its
   keys the one it shares most keys with. Pairs that pass the sketch are
   verified on their full sets, and the links' components found.
4. What is left are keys whose members lie in different components. Their
   members are compared across components by sketch, in blocks (a key with
   many members is split into blocks, every pair of blocks meets in some
   task). First only the likeliest pair of each member with each other
   component is verified on full sets; then, of members whose components
   still differ, every pair that passes the sketch.

The sketch test passes a pair unless its estimate lies five standard
deviations below the threshold, so no pair of similar documents is lost to
more than one in a million; links themselves are always exact on full sets.

Defined results: null and empty texts and texts without words have an empty
set and are their own component; rows repeated under one doc_id count as one
document if equal and as linked through their id otherwise; a null doc_id
takes part only by equality of sets, and its component is the smallest id of
its class, or null; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.graph import connected_components
from tidewatch.llm.textkit import mix, shingle_sets, slices
from tidewatch.session import materialize

_U = np.uint64
HASHES = 32
CHUNK = 4
BINS = 512
_BLOCK = 512
SALTS = 64
#: pairs (of 20 bytes) that are sent to all tasks at most
MAX_BROADCAST = 1_000_000
_SEEDS = mix(np.arange(1, 2 * HASHES + 1, dtype=_U) * _U(0xA0761D6478BD642F))
_MUL, _ADD = _SEEDS[:HASHES] | _U(1), _SEEDS[HASHES:]


# --- one pass over the texts -------------------------------------------------


def signatures(flat: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, HASHES) uint16: low bits of the minima; zeros without shingles."""
    n = np.diff(off)
    out = np.zeros((len(n), HASHES), dtype=np.uint16)
    own = np.flatnonzero(n)
    if len(own):
        starts = off[:-1][own]
        for k in range(HASHES):
            v = flat * _MUL[k]
            v += _ADD[k]
            low = np.minimum.reduceat(v >> _U(20), starts)
            out[own, k] = (mix(low) & _U(0xFFFF)).astype(np.uint16)
    return out


def sketches(flat: np.ndarray, off: np.ndarray) -> np.ndarray:
    """(texts, BINS) uint8: the first hash of each bin (0: an empty bin).
    The sets are sorted, so a bin's first hash is where the bin changes."""
    n = np.diff(off)
    out = np.zeros((len(n), BINS), dtype=np.uint8)
    text = np.repeat(np.arange(len(n)), n)
    bins = (flat >> _U(64 - 9)).astype(np.int64)  # BINS = 2 ** 9
    place = text * BINS + bins
    first = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1]))) if len(place) else np.zeros(0, int)
    out.reshape(-1)[place[first]] = (mix(flat[first]) % _U(255)).astype(np.uint8) + 1
    return out


def estimates(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray, threshold_pct: int) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity of rows of two sketch tables, and whether they may
    reach the threshold: set sizes must allow it, and the estimate lies at most
    five standard deviations below. The bins are a sample without replacement
    from the union of the sets, which narrows the deviation of small sets."""
    same = ((a == b) & (a > 0)).sum(axis=1)
    seen = np.maximum(((a > 0) | (b > 0)).sum(axis=1), 1)
    t = threshold_pct / 100
    union = np.maximum((na + nb) / (1 + t), seen)
    slack = 5 * np.sqrt(t * (1 - t) / seen * np.maximum(1 - seen / union, 0)) + 2 / seen
    est = same / seen
    sizes = 100 * np.minimum(na, nb) >= threshold_pct * np.maximum(na, nb)
    return est, sizes & (est >= t - slack)


def document_sets(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, fp1, fp2, sig, sketch of each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                flat, off = shingle_sets(part.column("text"))
                pad = np.append(flat, _U(0))
                n = np.diff(off)
                sums = [np.where(n > 0, np.add.reduceat(mix(pad + _U(s)), off[:-1]), 0).astype(_U) for s in (1, 2)]
                sig, sk = signatures(flat, off), sketches(flat, off)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id").cast(pa.int64()),
                        pa.array(n),
                        pa.array(sums[0].view(np.int64)),
                        pa.array(sums[1].view(np.int64)),
                        pa.array([x.tobytes() for x in sig], pa.binary()),
                        pa.array([x.tobytes() for x in sk], pa.binary()),
                    ],
                    ["doc_id", "n_shingles", "fp1", "fp2", "sig", "sketch"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        work, "doc_id long, n_shingles long, fp1 long, fp2 long, sig binary, sketch binary"
    )


# --- multi-index -------------------------------------------------------------


def index_keys(classes: DataFrame) -> DataFrame:
    """(key, rep): each chunk of the signature with one symbol left out. A key
    packs the chunk's number, the place left out and the other three symbols."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), dtype=np.uint16).reshape(b.num_rows, -1)
            sig = sig.astype(_U)
            keys = []
            for c in range(HASHES // CHUNK):
                for j in range(CHUNK):
                    rest = [sig[:, c * CHUNK + i] for i in range(CHUNK) if i != j]
                    keys.append((_U(c * CHUNK + j) << _U(48)) | (rest[0] << _U(32)) | (rest[1] << _U(16)) | rest[2])
            key = np.stack(keys, axis=1).reshape(-1).view(np.int64)
            rep = np.repeat(b.column("rep").to_numpy(zero_copy_only=False), HASHES)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(rep)], ["key", "rep"])

    return classes.select("rep", "sig").mapInArrow(work, "key long, rep long")


def _passing(pairs: DataFrame, classes: DataFrame, threshold_pct: int) -> DataFrame:
    """Pairs (a, b) whose sketches may reach the threshold."""
    sk = classes.select("rep", "sketch", "n_shingles")
    both = pairs.join(sk.toDF("b", "sb", "nb"), "b").join(sk.toDF("a", "sa", "na"), "a")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (
                    np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=np.uint8).reshape(b.num_rows, BINS)
                    for c in ("sa", "sb")
                )
                _, ok = estimates(x, y, b.column("na").to_numpy(), b.column("nb").to_numpy(), threshold_pct)
                yield b.select(["a", "b"]).filter(pa.array(ok))

    return both.select("a", "b", "sa", "sb", "na", "nb").mapInArrow(work, "a long, b long")


# --- exact verification ------------------------------------------------------


def verified_links(pairs: DataFrame, docs: DataFrame, threshold_pct: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold.

    Each pair brings b's text to a's text: texts are joined once, by b, with a
    pair (a, a) for every a itself; the rows of one a are dealt in lots of
    about ``_BLOCK`` pairs, each lot with its own copy of a's text.
    """
    sizes = materialize(pairs.groupBy("a").agg(F.count(F.lit(1)).alias("_n")), "neardup-sizes")
    lots = F.ceil(F.col("_n") / _BLOCK).cast("int")
    # only stars of more than a lot need their size: at most pairs / _BLOCK rows,
    # met under SALTS keys each so that no task gets a whole star
    stars = sizes.filter(F.col("_n") > _BLOCK).select("a", lots.alias("_lots"))
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt")
    salted = pairs.withColumn("_salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    dealt = salted.join(stars.select("a", "_lots", salts), ["a", "_salt"], "left").select(
        "a", "b", F.coalesce(F.pmod(F.xxhash64(F.lit(1), "b"), F.col("_lots")), F.lit(0)).cast("int").alias("lot")
    )
    selves = sizes.select("a", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), lots - 1)).alias("lot"))
    wanted = materialize(dealt.unionByName(selves), "neardup-wanted")
    # a list of pairs of bounded size goes to the texts, else the texts move
    if wanted.count() <= MAX_BROADCAST:
        wanted = F.broadcast(wanted)
    texts = docs.select(F.col("doc_id").alias("b"), "text").filter("b is not null")
    rows = texts.join(wanted, "b").select("a", "lot", (F.col("a") != F.col("b")).alias("other"), "b", "text")
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartition(n, "a", "lot").sortWithinPartitions("a", "lot", "other")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lot, own = None, []
        for b in batches:
            for part in slices(b):
                flat, off = shingle_sets(part.column("text"))
                a, bb = part.column("a").to_pylist(), part.column("b").to_pylist()
                lots_, other = part.column("lot").to_pylist(), part.column("other").to_pylist()
                out = []
                for i in range(part.num_rows):
                    s = flat[off[i] : off[i + 1]]
                    if lot != (a[i], lots_[i]):
                        lot, own = (a[i], lots_[i]), []
                    if not other[i]:
                        own.append(s)  # more than one if rows repeat an id
                        continue
                    for o in own:
                        at = np.minimum(np.searchsorted(o, s), max(len(o) - 1, 0))
                        n_same = int((o[at] == s).sum()) if len(o) and len(s) else 0
                        if 100 * n_same >= threshold_pct * (len(o) + len(s) - n_same):
                            out.append((a[i], bb[i]))
                            break
                yield pa.RecordBatch.from_arrays(
                    [pa.array([x for x, _ in out], pa.int64()), pa.array([y for _, y in out], pa.int64())], ["a", "b"]
                )

    return ranged.select("a", "lot", "other", "b", "text").mapInArrow(work, "a long, b long").distinct()


# --- members of one key in different components ------------------------------


def first_key(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Number of the first key (chunk and place left out) that two signatures
    share, by rows; -1 for none."""
    same = (a == b).reshape(len(a), HASHES // CHUNK, CHUNK)
    n = same.sum(axis=2)
    chunk = (n >= CHUNK - 1).argmax(axis=1)
    row = np.arange(len(a))
    place = np.where(n[row, chunk] == CHUNK, 0, same[row, chunk].argmin(axis=1))
    return np.where(n[row, chunk] >= CHUNK - 1, chunk * CHUNK + place, -1)


def _cross_pairs(members: DataFrame, threshold_pct: int, best: bool) -> DataFrame:
    """Pairs of members of a key in different components whose sketches may
    reach the threshold; with ``best``, only the likeliest pair of each member
    with each other component. ``members(key, rep, label, m, n_shingles, sig,
    sketch)``, m: the key's number of members. A pair that shares several keys
    is given by the first of them only."""
    blocks = F.ceil(F.col("m") / _BLOCK).cast("int")
    own = F.pmod(F.xxhash64("rep"), F.col("_nb")).cast("int")
    dealt = (
        members.withColumn("_nb", blocks)
        .withColumn("_own", own)
        .withColumn("_x", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
        .select(
            "key",
            F.least("_own", "_x").alias("i"),
            F.greatest("_own", "_x").alias("j"),
            F.col("_own").alias("own"),
            "rep",
            "label",
            "n_shingles",
            "sig",
            "sketch",
        )
    )
    n = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = dealt.repartition(n, "key", "i", "j").sortWithinPartitions("key", "i", "j", "own", "rep")

    def compare(t: dict[str, np.ndarray]) -> pa.RecordBatch:
        left, right, est = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0)]
        n, d = len(t["key"]), 1
        while d < n:
            same = (t["key"][d:] == t["key"][:-d]) & (t["i"][d:] == t["i"][:-d]) & (t["j"][d:] == t["j"][:-d])
            if not same.any():
                break
            ask = same & (t["label"][d:] != t["label"][:-d])
            # a pair of two blocks compares only across them
            ask &= (t["i"][d:] == t["j"][d:]) | (t["own"][d:] != t["own"][:-d])
            small, large = np.minimum(t["n"][d:], t["n"][:-d]), np.maximum(t["n"][d:], t["n"][:-d])
            ask &= 100 * small >= threshold_pct * large
            x = np.flatnonzero(ask)
            for lo in range(0, len(x), 4096):
                p = x[lo : lo + 4096]
                p = p[first_key(t["sig"][p], t["sig"][p + d]) == t["key"][p] >> 48]
                e, ok = estimates(t["sketch"][p], t["sketch"][p + d], t["n"][p], t["n"][p + d], threshold_pct)
                left.append(p[ok])
                right.append(p[ok] + d)
                est.append(e[ok])
            d += 1
        x, y, e = np.concatenate(left), np.concatenate(right), np.concatenate(est)
        if best and len(x):  # one pair for each member and other component
            member = np.concatenate([t["rep"][x], t["rep"][y]])
            other = np.concatenate([t["label"][y], t["label"][x]])
            pair, est2 = np.concatenate([np.arange(len(x))] * 2), np.concatenate([e, e])
            order = np.lexsort((-est2, other, member))
            m, o = member[order], other[order]
            first = np.concatenate(([True], (m[1:] != m[:-1]) | (o[1:] != o[:-1])))
            some = np.unique(pair[order[first]])
            x, y, e = x[some], y[some], e[some]
        swap = t["rep"][x] > t["rep"][y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        cols = [t["rep"][x], t["rep"][y], t["label"][x], t["label"][y], e]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["a", "b", "la", "lb", "est"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, np.ndarray] | None = None
        for b in batches:
            if not b.num_rows:
                continue
            t = {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "i", "j", "own", "rep", "label")}
            t["n"] = b.column("n_shingles").to_numpy(zero_copy_only=False)
            t["sig"] = np.frombuffer(b"".join(b.column("sig").to_pylist()), dtype=np.uint16).reshape(-1, HASHES)
            t["sketch"] = np.frombuffer(b"".join(b.column("sketch").to_pylist()), dtype=np.uint8).reshape(-1, BINS)
            if held is not None:
                t = {c: np.concatenate([held[c], t[c]]) for c in t}
            # the last key's rows may go on in the next batch
            last = (t["key"] == t["key"][-1]) & (t["i"] == t["i"][-1]) & (t["j"] == t["j"][-1])
            cut = int(np.flatnonzero(last)[0])
            held = {c: v[cut:] for c, v in t.items()}
            yield compare({c: v[:cut] for c, v in t.items()})
        if held is not None:
            yield compare(held)

    found = ranged.mapInArrow(work, "a long, b long, la long, lb long, est double")
    if not best:
        return found.select("a", "b").distinct()
    # the same choice over all keys: the likeliest pair of a member and a component
    sides = found.select("a", "b", "est", F.explode(F.array(
        F.struct(F.col("a").alias("rep"), F.col("lb").alias("other")), F.struct(F.col("b").alias("rep"), F.col("la").alias("other"))
    )).alias("s")).select("a", "b", "est", "s.rep", "s.other")
    top = sides.groupBy("rep", "other").agg(F.max(F.struct("est", "a", "b")).alias("top"))
    return top.select("top.a", "top.b").distinct()


# --- the operator ------------------------------------------------------------


def near_duplicates(docs: DataFrame, threshold_pct: int = 75) -> DataFrame:
    """doc_id, n_shingles, component_id, kept, class_size for every row."""
    sets = materialize(document_sets(docs), "neardup-sets")
    classes = materialize(
        sets.filter("n_shingles > 0")
        .groupBy("fp1", "fp2", "n_shingles")
        .agg(F.min(F.struct("doc_id", "sig", "sketch")).alias("_m"), F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("class_size"))
        .select("fp1", "fp2", "n_shingles", "rep", "class_size", F.col("_m.sig").alias("sig"), F.col("_m.sketch").alias("sketch")),
        "neardup-classes",
    )
    reps = classes.filter("rep is not null")
    keys = materialize(index_keys(reps), "neardup-keys")
    shared = keys.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi"), F.count(F.lit(1)).alias("m"))
    members = materialize(keys.join(shared.filter("lo < hi"), "key").select("key", "rep", "lo", "m"), "neardup-members")

    # each class with the smallest member it shares most keys with
    star = members.filter("rep <> lo").groupBy("rep", "lo").agg(F.count(F.lit(1)).alias("n"))
    star = star.groupBy("rep").agg(F.max(F.struct("n", (-F.col("lo")).alias("lo"))).alias("top"))
    star = star.select((-F.col("top.lo")).alias("a"), F.col("rep").alias("b"))
    tried = materialize(_passing(star, reps, threshold_pct), "neardup-star")
    links = materialize(verified_links(tried, docs, threshold_pct), "neardup-links")
    labels = materialize(connected_components(links), "neardup-labels")
    for best in (True, False):
        named = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(
            "key", "rep", "m", F.coalesce("component", "rep").alias("label")
        )
        mixed = named.groupBy("key").agg(F.min("label").alias("_x"), F.max("label").alias("_y")).filter("_x < _y")
        left = named.join(mixed.select("key"), "key").join(reps.select("rep", "n_shingles", "sig", "sketch"), "rep")
        more = _cross_pairs(left.select("key", "rep", "label", "m", "n_shingles", "sig", "sketch"), threshold_pct, best)
        more = materialize(more.join(tried, ["a", "b"], "left_anti"), "neardup-cross")
        links = links.unionByName(materialize(verified_links(more, docs, threshold_pct), "neardup-links"))
        tried = tried.unionByName(more)
        labels = materialize(connected_components(links), "neardup-labels")
    final = labels

    named_classes = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select(
        "fp1", "fp2", "n_shingles", F.coalesce("component", "rep").alias("component_id"), "class_size"
    )
    return (
        sets.select("doc_id", "fp1", "fp2", "n_shingles")
        .join(named_classes, ["fp1", "fp2", "n_shingles"], "left")
        .select(
            "doc_id",
            "n_shingles",
            F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
            F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
        )
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )
