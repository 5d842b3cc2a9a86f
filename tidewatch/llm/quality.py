"""Text quality by weak supervision (built-in functions only).

Each rule votes good (+1), bad (-1) or abstains (0) on a document. A
two-class model with one vote distribution per rule and class is fitted by
expectation-maximisation to the counts of vote patterns over all documents;
the posterior probability of the good class, not an all-must-pass filter,
decides.

The pattern table has at most 3 ** number-of-rules rows whatever the corpus
size; each EM step is one aggregate over it, and only the step's sums (three
numbers per rule and class) reach the driver, to become literals of the next
step.

Defined results: a null text has no words (all counts 0) and fails the base
test; repeated and null doc_ids keep their own rows; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.session import materialize

WS = r"[\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"


def quality_signals(docs: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the columns ``keep``, and whole-text counts."""
    kept = [F.col(c).alias(f"_k_{c}") for c in keep]
    text = docs.select("doc_id", *kept, F.coalesce("text", F.lit("")).alias("t"))
    kept = [f"_k_{c}" for c in keep]
    words = text.select(
        "doc_id",
        *kept,
        "t",
        F.filter(F.split("t", WS + "+", -1), lambda w: w != "").alias("w"),
        F.filter(F.split("t", "\n", -1), lambda x: F.rlike(x, F.lit(r"[^\x20\x09-\x0D]"))).alias("lines"),
    )
    # three-word windows as (hash, position), sorted: repeats become neighbours
    grams = words.select(
        "doc_id",
        *kept,
        "t",
        "w",
        "lines",
        F.when(
            F.size("w") >= 3,
            F.sort_array(
                F.transform(
                    F.sequence(F.lit(0), F.greatest(F.size("w") - 3, F.lit(0))),
                    lambda i: F.struct(
                        F.xxhash64(F.get("w", i), F.get("w", i + 1), F.get("w", i + 2)).alias("h"), i.alias("p")
                    ),
                )
            ),
        )
        .otherwise(F.expr("cast(array() as array<struct<h:bigint,p:int>>)"))
        .alias("g"),
    )
    repeated = grams.select(
        "doc_id",
        *kept,
        "t",
        "w",
        "lines",
        F.filter(
            F.col("g"),
            lambda x, i: (F.get(F.col("g"), i + 1)["h"] == x["h"])
            | ((i > 0) & (F.get(F.col("g"), F.greatest(i - 1, F.lit(0)))["h"] == x["h"])),
        ).alias("r"),
        (F.size("g") >= 0).alias("_g"),
    )
    covered = F.size(
        F.array_distinct(F.flatten(F.transform("r", lambda x: F.array(x["p"], x["p"] + 1, x["p"] + 2))))
    )
    n = F.size("w")
    return repeated.select(
        "doc_id",
        *[F.col(f"_k_{c}").alias(c) for c in keep],
        n.cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        (F.length("t") - F.length(F.translate("t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.size("lines").cast("long").alias("n_lines"),
        covered.cast("long").alias("n_repeat_words"),
        F.length(F.regexp_replace("t", r"[^\p{Lu}]+", "")).cast("long").alias("n_upper"),
        F.length(F.regexp_replace("t", r"[^0-9]+", "")).cast("long").alias("n_digits"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (F.lit(100) * F.col("n_repeat_words") > F.lit(50) * F.col("n_words"))


@dataclass(frozen=True)
class VoteRule:
    """Good where ``good`` holds, else bad where ``bad`` holds, else abstain."""

    name: str
    good: str
    bad: str


VOTE_RULES = (
    VoteRule("length", "n_words >= 50", "n_words < 30"),
    VoteRule("word_size", "word_chars between 3 * n_words and 9 * n_words", "word_chars < 2 * n_words or word_chars > 14 * n_words"),
    VoteRule("symbols", "20 * n_symbols <= n_words", "5 * n_symbols > n_words"),
    VoteRule("lines", "10 * n_dup_lines <= n_lines", "10 * n_dup_lines > 3 * n_lines and n_dup_lines > 2"),
    VoteRule("repeats", "100 * n_repeat_words <= 20 * n_words", "100 * n_repeat_words > 40 * n_words"),
    VoteRule("capitals", "10 * n_upper <= word_chars", "10 * n_upper > 3 * word_chars"),
    VoteRule("digits", "20 * n_digits <= word_chars", "10 * n_digits > 2 * word_chars"),
)


def cast_votes(signals: DataFrame, rules: tuple[VoteRule, ...] = VOTE_RULES) -> DataFrame:
    votes = [
        F.when(F.expr(r.good), F.lit(1)).when(F.expr(r.bad), F.lit(-1)).otherwise(F.lit(0)).alias(f"v_{r.name}")
        for r in rules
    ]
    return signals.select("*", *votes)


@dataclass(frozen=True)
class LabelModel:
    """P(good) and, by rule, P(vote | good) and P(vote | bad) for votes -1, 0, 1."""

    prior: float
    good: dict[str, tuple[float, float, float]]
    bad: dict[str, tuple[float, float, float]]

    def posterior(self) -> Column:
        import math

        logit = F.lit(math.log(self.prior / (1 - self.prior)))
        for name in self.good:
            steps = [F.lit(math.log(g / b)) for g, b in zip(self.good[name], self.bad[name], strict=True)]
            v = F.col(f"v_{name}")
            logit = logit + F.when(v == -1, steps[0]).when(v == 0, steps[1]).otherwise(steps[2])
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))

    def accuracy(self, name: str) -> float:
        """Estimated share of right votes among a rule's votes."""
        g, b, p = self.good[name], self.bad[name], self.prior
        right, wrong = p * g[2] + (1 - p) * b[0], p * g[0] + (1 - p) * b[2]
        return right / (right + wrong)


#: Starting vote distributions (bad, abstain, good) of the two classes. A rule
#: is written so that good text rarely gets its bad vote; bad text may get it.
START_GOOD = (0.005, 0.145, 0.85)
START_BAD = (0.15, 0.145, 0.705)
START_PRIOR = 0.8


def fit_label_model(
    votes: DataFrame, rules: tuple[VoteRule, ...] = VOTE_RULES, steps: int = 12, anchor: float = 1.0
) -> LabelModel:
    """EM (maximum a posteriori) over the vote patterns of all documents.

    Without labels the two classes have no names, and EM may settle on any
    two clusters of votes. A Dirichlet prior centred on the starting
    distributions, weighing ``anchor`` times a class's documents (and one
    document at least), ties the classes to their meaning at every corpus
    size and keeps every probability above zero."""
    names = [r.name for r in rules]
    patterns = materialize(
        votes.groupBy(*[f"v_{n}" for n in names]).agg(F.count(F.lit(1)).alias("_n")).coalesce(1), "vote-patterns"
    )
    model = LabelModel(START_PRIOR, dict.fromkeys(names, START_GOOD), dict.fromkeys(names, START_BAD))
    for _ in range(steps):
        w = patterns.withColumn("_p", model.posterior())
        sums = [F.sum(F.col("_n") * F.col("_p")).alias("g"), F.sum(F.col("_n") * (1 - F.col("_p"))).alias("b")]
        for n in names:
            for v in (-1, 0, 1):
                on = F.when(F.col(f"v_{n}") == v, F.col("_n")).otherwise(0)
                sums += [F.sum(on * F.col("_p")).alias(f"g{v}_{n}"), F.sum(on * (1 - F.col("_p"))).alias(f"b{v}_{n}")]
        row = w.agg(*sums).first()
        if row["g"] is None:  # an empty table keeps the starting model
            return model

        def dist(side: str, n: str, start: tuple[float, float, float]) -> tuple[float, float, float]:
            weight = max(1.0, anchor * row[side])
            c = [row[f"{side}{v}_{n}"] + weight * p for v, p in zip((-1, 0, 1), start, strict=True)]
            return tuple(x / sum(c) for x in c)

        total = row["g"] + row["b"]
        weight = max(1.0, anchor * total)
        model = LabelModel(
            (row["g"] + weight * START_PRIOR) / (total + weight),
            {n: dist("g", n, START_GOOD) for n in names},
            {n: dist("b", n, START_BAD) for n in names},
        )
    return model


def judge_quality(docs: DataFrame, threshold: float = 0.85, rules: tuple[VoteRule, ...] = VOTE_RULES) -> DataFrame:
    """Signals, base test, posterior P(good) and the verdict of each document:
    kept if the base test holds and P(good) is at least ``threshold``."""
    votes = materialize(cast_votes(quality_signals(docs), rules), "quality-votes")
    model = fit_label_model(votes, rules)
    return votes.select(
        "doc_id",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        "n_repeat_words",
        base_failed().alias("base_failed"),
        model.posterior().alias("p_good"),
    ).withColumn("kept", ~F.col("base_failed") & (F.col("p_good") >= threshold))
