"""Language identification as inference of a mixture of languages.

Training counts hashed character n-grams (1 to 3 code points of letters,
lower case, words between blanks) by language over all labelled rows, in
Spark. A word's likelihood under a language is the product over its trigrams
(with backing off by smoothing).

A document is a mixture: every word comes from one language, languages have
proportions. Expectation-maximisation estimates the proportions; the set of
languages grows one by one, strongest first, as long as the penalised
log-likelihood (``penalty * log(words + 1)`` for each further language)
rises. The prediction is the language with the largest proportion in the
chosen set, the score its proportion times the posterior share of the set's
words that it explains better than chance.

Defined results: ``und`` with score 0 for a null text or one without a
letter; repeated and null doc_ids keep their own rows; with no labelled rows
everything is ``und``; an empty table gives an empty result; other columns
are ignored. The model has languages x ``BUCKETS`` numbers whatever the
corpus, and goes to the tasks by broadcast.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.textkit import slices

BUCKETS = 1 << 15
_SLICE = 1 << 19  # code points handled at once


def _fold_tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower-case map and letter flag of every code point."""
    low = np.arange(0x110000, dtype=np.uint32)
    letter = np.zeros(0x110000, dtype=bool)
    for c in range(0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        ch = chr(c)
        if ch.isalpha():
            letter[c] = True
            x = ch.lower()
            if len(x) == 1:
                low[c] = ord(x)
    return low, letter


_TABLES: list = []


def _tables() -> tuple[np.ndarray, np.ndarray]:
    if not _TABLES:
        _TABLES.extend(_fold_tables())
    return _TABLES[0], _TABLES[1]


def word_grams(text: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For slices of a text: trigram buckets of its letter words (with a blank
    at both ends), and the index of the first gram of each word."""
    low, letter = _tables()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lo = 0
    while lo < len(codes):
        hi = min(lo + _SLICE, len(codes))
        if hi < len(codes):  # cut behind a non-letter, if the slice has one
            stops = np.flatnonzero(~letter[codes[lo:hi]])
            if len(stops):
                hi = lo + int(stops[-1]) + 1
        yield grams_of(codes[lo:hi])
        lo = hi


def grams_of(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, letter = _tables()
    is_letter = letter[codes]
    c = np.where(is_letter, low[codes], 32).astype(np.uint32)
    c = np.concatenate(([32], c, [32])).astype(np.uint32)
    # a gram around every letter: it, the one before and the one after
    mid = np.flatnonzero(c != 32)
    if not len(mid):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = (c[mid - 1] * np.uint32(0x9E3779B1) + c[mid]) * np.uint32(0x85EBCA77) + c[mid + 1]
    h = (h ^ (h >> np.uint32(15))) * np.uint32(0xC2B2AE35)
    first = np.flatnonzero(c[mid - 1] == 32)
    return ((h >> np.uint32(13)) % np.uint32(BUCKETS)).astype(np.int64), first


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, bucket, n) over all rows of ``docs(text, lang)``; each task adds
    up its rows first."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for text, lang in zip(b.column("text"), b.column("lang"), strict=True):
                text, lang = text.as_py(), lang.as_py()
                if not text or lang is None:
                    continue
                own = sums.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                for grams, _ in word_grams(text):
                    own += np.bincount(grams, minlength=BUCKETS)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(own[at])],
                ["lang", "bucket", "n"],
            )

    part = docs.select("text", "lang").mapInArrow(work, "lang string, bucket int, n long")
    return part.groupBy("lang", "bucket").agg(F.sum("n").alias("n"))


class LanguageModel:
    """Log-probabilities of trigram buckets: (languages, BUCKETS)."""

    def __init__(self, langs: list[str], counts: np.ndarray, smooth: float = 0.5):
        self.langs = langs
        total = counts.sum(axis=1, keepdims=True)
        self.logp = np.log((counts + smooth) / (total + smooth * BUCKETS)).astype(np.float32)

    @classmethod
    def fit(cls, docs: DataFrame) -> LanguageModel:
        rows = gram_counts(docs).toPandas()  # languages x BUCKETS rows at most
        langs = sorted(rows["lang"].unique().tolist())
        counts = np.zeros((len(langs), BUCKETS))
        at = {x: i for i, x in enumerate(langs)}
        counts[rows["lang"].map(at).to_numpy(dtype=np.int64), rows["bucket"].to_numpy()] = rows["n"].to_numpy()
        return cls(langs, counts)

    def words(self, text: str) -> np.ndarray:
        """(words, languages) log-likelihoods."""
        out = []
        for grams, first in word_grams(text):
            if len(first):
                out.append(np.add.reduceat(self.logp[:, grams], first, axis=1).T)
        return np.concatenate(out) if out else np.zeros((0, len(self.langs)), np.float32)


def em(like: np.ndarray, doc: np.ndarray, n_docs: int, allowed: np.ndarray, steps: int) -> tuple[np.ndarray, np.ndarray]:
    """Proportions and log-likelihoods of documents.

    like: (words, languages) likelihoods scaled so that a word's best is 1;
    doc: the start of each document's words; allowed: (documents, languages).
    """
    sizes = np.diff(np.append(doc, len(like)))
    prop = allowed / allowed.sum(axis=1, keepdims=True)
    for _ in range(steps):
        joint = like * np.repeat(prop, sizes, axis=0)
        joint /= joint.sum(axis=1, keepdims=True)
        prop = np.add.reduceat(joint, doc, axis=0) / sizes[:, None]
        prop = np.maximum(prop, 1e-9) * allowed
        prop /= prop.sum(axis=1, keepdims=True)
    mass = (like * np.repeat(prop, sizes, axis=0)).sum(axis=1)
    return prop, np.add.reduceat(np.log(mass), doc)


def predict(words: list[np.ndarray], penalty: float = 3.0, steps: int = 8) -> list[np.ndarray | None]:
    """Language proportions of each document; None without words."""
    out: list[np.ndarray | None] = [None] * len(words)
    own = [i for i, w in enumerate(words) if len(w)]
    if not own:
        return out
    sizes = np.array([len(words[i]) for i in own])
    doc = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    log_like = np.concatenate([words[i] for i in own]).astype(np.float64)
    like = np.exp(np.maximum(log_like - log_like.max(axis=1, keepdims=True), -60))
    k = like.shape[1]
    single = np.add.reduceat(np.log(like), doc, axis=0)
    best_set = np.zeros((len(own), k))
    best_set[np.arange(len(own)), single.argmax(axis=1)] = 1
    best_ll = single.max(axis=1)
    best_prop = best_set.copy()
    if k > 1:
        full, _ = em(like, doc, len(own), np.ones((len(own), k)), steps)
        order = np.argsort(-full, axis=1, kind="stable")
        # the strongest of the mixture first, then one language more each round
        allowed = np.zeros((len(own), k))
        open_docs = np.arange(len(own))
        allowed[open_docs, order[:, 0]] = 1
        swap = single[open_docs, order[:, 0]] >= best_ll
        best_prop[swap] = allowed[swap]
        for m in range(1, k):
            allowed[open_docs, order[open_docs, m]] = 1
            word_at = np.concatenate([np.arange(doc[i], doc[i] + sizes[i]) for i in open_docs])
            starts = np.concatenate(([0], np.cumsum(sizes[open_docs])[:-1]))
            prop, ll = em(like[word_at], starts, len(open_docs), allowed[open_docs], steps)
            gain = ll - best_ll[open_docs] > penalty * np.log(sizes[open_docs] + 1)
            better = open_docs[gain]
            best_prop[better], best_ll[better] = prop[gain], ll[gain]
            open_docs = better
            if not len(open_docs):
                break
    for j, i in enumerate(own):
        out[i] = best_prop[j]
    return out


def identify(docs: DataFrame, model: LanguageModel, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``keep``, lang_pred, score, langs (the chosen set
    with proportions, ``lang:share`` by share)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast((model.langs, model.logp))
    fields = [f for f in docs.schema.fields if f.name in ("doc_id", *keep)]
    names = ["doc_id", *[c for c in keep if c != "doc_id"]]
    kinds = {f.name: f.dataType.simpleString() for f in fields}

    source = "text" if "text" in keep else "_text"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, logp = shared.value
        m = LanguageModel.__new__(LanguageModel)
        m.langs, m.logp = langs, logp
        for b in batches:
            for part in slices(b, source, 128):
                pred, score, sets = [], [], []
                words = [m.words(t) if t and langs else np.zeros((0, 1)) for t in part.column(source).to_pylist()]
                for p in predict(words):
                    if p is None:
                        pred.append("und"), score.append(0.0), sets.append("")
                        continue
                    order = np.argsort(-p, kind="stable")
                    pred.append(langs[order[0]])
                    score.append(float(min(1.0, p[order[0]])))
                    sets.append(",".join(f"{langs[j]}:{p[j]:.3f}" for j in order if p[j] > 1e-6))
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in names]
                    + [pa.array(pred, pa.string()), pa.array(score, pa.float64()), pa.array(sets, pa.string())],
                    [*names, "lang_pred", "score", "langs"],
                )

    own = docs.select(*names) if "text" in keep else docs.select(*names, F.col("text").alias("_text"))
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", lang_pred string, score double, langs string"
    return own.mapInArrow(work, schema)


def held_out(doc_id: Column) -> Column:
    """The contract's held-out quarter; a null id counts as held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(True))
