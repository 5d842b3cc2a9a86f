"""The queries of this folder; their SQL is in ``oracle.py``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.llm import chat, contain, covertree, discriminant, htmltext, langid, lexsearch, neardup, pieces, pii
from tidewatch.llm import quality, repeats, secrets
from tidewatch.llm.oracle import ORACLE  # noqa: F401 (read by __spark_entry__.py)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"))


def op2_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pieces.encode(_table(spark, sf_dir, "documents"), k=2, with_ids=False)

    def each(field: str):
        return F.transform("samples", lambda s: s[field])

    return out.select(
        "doc_id",
        F.size("samples").cast("long").alias("n_samples"),
        each("n_tokens").alias("n_tokens"),
        each("ids_sha256").alias("ids_sha256"),
        F.transform("samples", lambda s: F.round(s["log_prob"], 6)).alias("log_prob"),
        F.transform("samples", lambda s: F.round(s["perturbed"], 6)).alias("perturbed"),
        F.transform("samples", lambda s: F.round(s["log_inclusion"], 6)).alias("log_inclusion"),
        F.forall("samples", lambda s: s["round_trip"]).alias("round_trip"),
    )


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secret_digest(secrets.scan(_table(spark, sf_dir, "documents")))


def op4_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract_text(_table(spark, sf_dir, "pages"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge_quality(_table(spark, sf_dir, "documents")).withColumn("p_good", F.round("p_good", 6))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    train = docs.filter(~langid.held_out(F.col("doc_id")) & F.col("lang").isNotNull())
    found = langid.identify(docs, langid.LanguageModel.fit(train))
    return found.select(
        "doc_id",
        langid.held_out(F.col("doc_id")).alias("held_out"),
        "lang_pred",
        F.round("score", 6).alias("score"),
        "langs",
    )


def op7_repeat_removal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op8_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_personal(_table(spark, sf_dir, "documents"))


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame(
        [(-1, 0, "user", probe), (-1, 1, "assistant", probe)], "conv_id long, turn long, role string, text string"
    )
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.chat_digest(chat.format_chats(rows.unionByName(own)))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contain.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = lexsearch.build_index(_table(spark, sf_dir, "documents"))
    return lexsearch.search(index, _table(spark, sf_dir, "benchmark"), k=50)


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = covertree.scaled_vectors(rows, "vec_id", "embedding", label)
    return covertree.mine_hard_negatives(vectors, F.col("vec_id") % 50 == 0)


def op13_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    train = ~langid.held_out(F.col("doc_id"))
    out = discriminant.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), train)
    return out.select("doc_id", langid.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {
    "op1_near_dedup": op1_near_dedup,
    "op3_secret_scan": op3_secret_scan,
    "op2_piece_sampling": op2_piece_sampling,
    "op4_page_text": op4_page_text,
    "op6_language_id": op6_language_id,
    "op10_decontaminate": op10_decontaminate,
    "op5_quality_rules": op5_quality_rules,
    "op7_repeat_removal": op7_repeat_removal,
    "op8_personal_data": op8_personal_data,
    "op9_chat_format": op9_chat_format,
    "op11_ranked_search": op11_ranked_search,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_quality_classifier": op13_quality_classifier,
}
