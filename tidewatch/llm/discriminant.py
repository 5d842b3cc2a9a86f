"""Quality classifier: regularised quadratic discriminant over text statistics.

* Each whole text becomes ``FEATURES``: logarithms of counts and shares
  (length, word size, symbols, capitals, digits, punctuation, lines, repeated
  words and windows, byte entropy), so that products of causes become sums
  and one Gaussian per class is a fair picture.
* Per class Spark aggregates the row count, the means and the covariances of
  all labelled training rows (``covar_samp``: partial sums by task, one row a
  class reaches the driver).
* Each class covariance is shrunk towards the diagonal of the pooled
  variances with weight ``prior_rows / (prior_rows + rows)``, its mean towards
  the pooled mean with ``1 / (1 + rows)``: a class with few rows, or none,
  gets the pooled Gaussian instead of a singular one.
* The model holds each class's Cholesky factor, inverted once, and its
  log-determinant; a batch of texts is scored by one matrix product a class:
  the Mahalanobis log-density difference plus the log prior odds, through the
  logistic function.

Defined results: null and empty texts have all counts 0 and get a score like
any text; rows repeated in ``docs`` keep their own rows; a null doc_id is
scored but never trained on; labels that are null, not 0 or 1, or both 0 and
1 for one doc_id take no part, equal labels count once a row of ``docs``;
without any label every score is 0.5; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.textkit import PIECE, buffer_of, shingle_hashes, slices, word_hashes
from tidewatch.session import materialize

FEATURES = (
    "words", "word_size", "symbols", "marks", "capitals", "digits", "stops", "lines",
    "same_words", "twin_words", "same_windows", "entropy", "non_ascii",
)


def _bytes_of(chars: str) -> np.ndarray:
    return np.frombuffer(chars.encode("ascii"), np.uint8)


_SPACES = np.array([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D])
_SYMBOLS = _bytes_of("#*$%&|<>@^~_=+/\\{}[]`")
_MARKS = _bytes_of("!?")
_STOPS = _bytes_of(".,;:")
_CAPITALS = np.arange(65, 91)
_SMALL = np.arange(97, 123)
_DIGITS = np.arange(48, 58)


def _histograms(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """(texts, 256): how often each byte value stands in each text."""
    rows = len(offsets) - 1
    out = np.zeros((rows, 256))
    for lo in range(0, len(buf), PIECE):
        hi = min(lo + PIECE, len(buf))
        own = np.searchsorted(offsets, np.arange(lo, hi), side="right") - 1
        first, last = int(own[0]), int(own[-1]) + 1
        spot = (own - first) * 256 + buf[lo:hi]
        out[first:last] += np.bincount(spot, minlength=(last - first) * 256).reshape(-1, 256)
    return out


def _distinct(hashes: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per text: distinct values, and entries whose value stands there before."""
    n = np.diff(offsets)
    distinct = np.array([len(np.unique(hashes[a:b])) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.float64)
    return distinct, n - distinct


def text_features(texts: pa.Array) -> np.ndarray:
    """(texts, len(FEATURES)) of an Arrow string array, whole texts."""
    buf, off = buffer_of(texts)
    hist = _histograms(buf, off)
    words, word_off = word_hashes(buf, off)
    n_words = np.diff(word_off).astype(np.float64)
    n_bytes = np.diff(off).astype(np.float64)
    chars = n_bytes - hist[:, 0x80:0xC0].sum(axis=1)

    def of(values: np.ndarray) -> np.ndarray:
        return hist[:, values].sum(axis=1)

    solid = chars - of(_SPACES)
    letters = of(_CAPITALS) + of(_SMALL)
    distinct, _ = _distinct(words, word_off)
    twin = np.zeros(len(n_words))
    if len(words) > 1:
        same = words[1:] == words[:-1]
        own = np.searchsorted(word_off, np.arange(1, len(words)), side="right") - 1
        inside = np.arange(1, len(words)) > word_off[own]
        twin = np.bincount(own, weights=same & inside, minlength=len(n_words))
    windows, window_off = shingle_hashes(words, word_off, 3)
    _, again = _distinct(windows, window_off)
    share = hist / np.maximum(n_bytes, 1)[:, None]
    entropy = -(share * np.log(np.where(share > 0, share, 1))).sum(axis=1)
    return np.column_stack([
        np.log1p(n_words),
        np.log((solid + 1) / (n_words + 1)),
        np.log((of(_SYMBOLS) + 0.5) / (chars + 1)),
        np.log((of(_MARKS) + 0.5) / (chars + 1)),
        np.log((of(_CAPITALS) + 0.5) / (letters + 1)),
        np.log((of(_DIGITS) + 0.5) / (chars + 1)),
        np.log((of(_STOPS) + 0.5) / (n_words + 1)),
        np.log((hist[:, 0x0A] + 1) / (n_words + 1)),
        np.log((n_words + 1) / (distinct + 1)),
        np.log((twin + 0.5) / (n_words + 1)),
        np.log((again + 0.5) / (np.diff(window_off) + 1)),
        entropy,
        np.log((hist[:, 0x80:].sum(axis=1) + 0.5) / (n_bytes + 1)),
    ])


def with_features(docs: DataFrame) -> DataFrame:
    """doc_id and one double column for each of ``FEATURES``."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in slices(b):
                x = text_features(part.column("text"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").cast(pa.int64()), *(pa.array(x[:, i]) for i in range(x.shape[1]))],
                    ["doc_id", *FEATURES],
                )

    schema = "doc_id long, " + ", ".join(f"{f} double" for f in FEATURES)
    return docs.select("doc_id", "text").mapInArrow(work, schema)


@dataclass(frozen=True)
class QuadraticDiscriminant:
    """Means, inverted Cholesky factors and log-determinants of two classes."""

    means: np.ndarray
    factors: np.ndarray
    logdets: np.ndarray
    log_odds: float

    @staticmethod
    def from_moments(
        counts: np.ndarray, means: np.ndarray, covariances: np.ndarray, prior_rows: float = 50.0
    ) -> QuadraticDiscriminant:
        """From each class's rows, mean and sample covariance (classes 0, 1)."""
        counts = np.asarray(counts, float)
        d = means.shape[1]
        total = max(counts.sum(), 1.0)
        centre = (counts[:, None] * means).sum(axis=0) / total
        spread = (means - centre) ** 2 * counts[:, None]
        within = np.maximum(counts - 1, 0)[:, None] * np.array([np.diag(c) for c in covariances])
        pooled = (spread + within).sum(axis=0) / total
        pooled = np.maximum(pooled, 1e-6) if counts.sum() else np.ones(d)
        own, factors, logdets = [], [], []
        for n, m, c in zip(counts, means, covariances, strict=True):
            shrink = prior_rows / (prior_rows + n)
            low = np.linalg.cholesky((1 - shrink) * c + shrink * np.diag(pooled))
            factors.append(np.linalg.inv(low))
            logdets.append(2 * np.log(np.diag(low)).sum())
            own.append((n * m + centre) / (n + 1))
        odds = float(np.log((counts[1] + 1) / (counts[0] + 1)))
        return QuadraticDiscriminant(np.array(own), np.array(factors), np.array(logdets), odds)

    @staticmethod
    def fit(rows: DataFrame, label: str, prior_rows: float = 50.0) -> QuadraticDiscriminant:
        """From ``rows``: the columns FEATURES and ``label`` (0 or 1)."""
        pairs = [(i, j) for i in range(len(FEATURES)) for j in range(i + 1)]
        moments = [F.avg(f).alias(f"m{i}") for i, f in enumerate(FEATURES)]
        moments += [F.covar_samp(FEATURES[i], FEATURES[j]).alias(f"c{i}_{j}") for i, j in pairs]
        found = rows.filter(F.col(label).isin(0, 1)).groupBy(F.col(label).cast("int").alias("_class"))
        d = len(FEATURES)
        counts, means, cov = np.zeros(2), np.zeros((2, d)), np.zeros((2, d, d))
        for r in found.agg(F.count(F.lit(1)).alias("n"), *moments).collect():  # two rows at most
            k = r["_class"]
            counts[k] = r["n"]
            means[k] = [r[f"m{i}"] for i in range(d)]
            for i, j in pairs:
                cov[k, i, j] = cov[k, j, i] = r[f"c{i}_{j}"] or 0.0  # one row has no covariance
        return QuadraticDiscriminant.from_moments(counts, means, cov, prior_rows)

    def log_density_difference(self, x: np.ndarray) -> np.ndarray:
        """log p(x | 1) - log p(x | 0) + log prior odds of each row."""
        logs = []
        for m, f, logdet in zip(self.means, self.factors, self.logdets, strict=True):
            z = (x - m) @ f.T
            logs.append(-0.5 * ((z * z).sum(axis=1) + logdet))
        return logs[1] - logs[0] + self.log_odds

    def score(self, x: np.ndarray) -> np.ndarray:
        """P(class 1) by the model."""
        z = self.log_density_difference(x)
        small = np.exp(-np.abs(z))
        return np.where(z >= 0, 1 / (1 + small), small / (1 + small))


def clean_labels(labels: DataFrame, column: str) -> DataFrame:
    """(doc_id, _label): one row for each doc_id with just one label of 0 or 1."""
    own = labels.filter(F.col("doc_id").isNotNull() & F.col(column).isin(0, 1))
    one = own.groupBy("doc_id").agg(F.min(column).alias("_low"), F.max(column).alias("_label"))
    return one.filter("_low = _label").select("doc_id", "_label")


def quality_scores(
    docs: DataFrame, labels: DataFrame, train, column: str = "quality", threshold: float = 0.7, prior_rows: float = 50.0
) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``docs``; ``train`` is the
    condition on doc_id under which a label may be learned from."""
    rows = materialize(with_features(docs), "text-features")
    learned = rows.filter(train).join(clean_labels(labels, column), "doc_id")
    model = QuadraticDiscriminant.fit(learned, "_label", prior_rows)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = np.column_stack([b.column(f).to_numpy(zero_copy_only=False) for f in FEATURES])
            score = model.score(x) if len(x) else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [b.column("doc_id"), pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                ["doc_id", "score", "predicted"],
            )

    return rows.mapInArrow(work, "doc_id long, score double, predicted int")
