"""A corpus cleaning pipeline of five stages, each one operator of ``tidewatch.llm``.

``STAGES`` lists (name, function) in order. A stage takes (spark, docs,
sf_dir) and returns the documents it keeps with the columns of ``documents``;
the last returns tokens. Every stage works on all its predecessor kept, and
is written as Parquet and read again in between.

Rows of any shape pass: a null text is language ``und`` and goes in the first
stage; of rows under one doc_id the one with the least text hash (then text)
stays; a null doc_id is never a
duplicate by itself; empty tables pass through empty; columns beyond those of
``documents`` are left behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm import contain, langid, neardup, pieces, secrets
from tidewatch.session import ensure_checkpoint_dir, materialize, ship_package

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: a document is rejected without a language, or if its largest share is less
MIN_LANGUAGE_SHARE = 0.3


def _ready(spark: SparkSession, docs: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return docs.select(*COLUMNS)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of a known language stay; a missing label is filled in."""
    docs = _ready(spark, docs)
    train = docs.filter(~langid.held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    found = langid.identify(docs, langid.LanguageModel.fit(train), keep=COLUMNS)
    kept = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SHARE))
    return kept.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the smallest id."""
    docs = _ready(spark, docs)
    gone = neardup.near_duplicates(docs).filter(~F.col("kept")).select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti")
    twice = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    if twice.limit(1).count():
        order = Window.partitionBy("doc_id").orderBy(F.xxhash64("text"), *(c for c in COLUMNS if c != "doc_id"))
        named = kept.filter("doc_id is not null").withColumn("_n", F.row_number().over(order)).filter("_n = 1")
        kept = named.drop("_n").unionByName(kept.filter("doc_id is null"))
    return kept.select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item stay."""
    docs = _ready(spark, docs)
    return contain.drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; its secrets are replaced by a mark."""
    docs = _ready(spark, docs)
    found = secrets.scan(docs, keep=tuple(c for c in COLUMNS if c != "doc_id"))
    clean = found.withColumn("text", secrets.redact(F.col("text"), F.col("spans")))
    return clean.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled token sequences of each document, with scores."""
    docs = _ready(spark, docs)
    out = pieces.encode(docs, k=2, keep=("doc_id", "lang", "source", "n_chars"))
    return out.select(
        "doc_id",
        "lang",
        "source",
        "n_chars",
        F.transform("samples", lambda s: s["ids"]).alias("ids"),
        F.transform("samples", lambda s: s["log_prob"]).alias("log_prob"),
        F.transform("samples", lambda s: s["log_inclusion"]).alias("log_inclusion"),
    )


STAGES = [
    ("language_id", language_id),
    ("near_dedup", near_dedup),
    ("decontaminate", decontaminate),
    ("secret_scan", secret_scan),
    ("sentencepiece", sentencepiece),
]

#: SQL cannot express language identification or sampling: see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
