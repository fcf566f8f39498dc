"""The operators as queries over the given tables, with the columns that are compared."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spendscope.llm import (decontam, frames, langid, nearest, packing, pii, quality, rules, runs, sharding, simhash,
                            suffix_dedup, training_order, whitening)
from spendscope.llm.oracles import DECONTAMINATION

ORDER_KEY = "epoch-0"


def tokenizer_path() -> str:
    """The vocabulary file the queries use; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = frames.read(spark, sf_dir, "documents"), frames.read(spark, sf_dir, "labels")
    learn = docs.where(frames.remainder("doc_id", 5) != 0).select("doc_id", "text", "n_chars").join(
        labels.select("doc_id", "quality"), "doc_id")
    scored = quality.scores(docs, quality.fit(learn))
    return scored.select(
        "doc_id", F.coalesce(frames.remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.spans(frames.read(spark, sf_dir, "documents")))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pieces(frames.read(spark, sf_dir, "documents"), tokenizer_path(), with_ids=False)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = rules.judged(frames.read(spark, sf_dir, "documents"), frames.read(spark, sf_dir, "labels"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.hits(frames.read(spark, sf_dir, "documents"), frames.read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
                        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digest(frames.read(spark, sf_dir, "documents"))


def op7_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = training_order.numbered(frames.read(spark, sf_dir, "documents"), tokenizer_path(), ORDER_KEY)
    rows = training_order.materialised(rows, frames.temporary(spark))
    return rows.withColumnRenamed("first_id", "first_doc_id")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.components(frames.read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.assigned(frames.read(spark, sf_dir, "documents"), 8)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                       F.lit(None).cast("int").alias("grown_shard"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = frames.read(spark, sf_dir, "documents")
    model = langid.fit(langid.learned(docs))
    return langid.predict(docs, model).select(
        "doc_id", F.coalesce(frames.remainder("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = frames.read(spark, sf_dir, "embeddings")
    index = nearest.indexed(rows)
    if index is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return nearest.search(index, rows.where("vec_id % 100 = 0"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.runs(frames.read(spark, sf_dir, "documents"), plant=True))


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(frames.read(spark, sf_dir, "embeddings"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_quality_classifier, op2_pii, op3_packing, op4_quality_rules, op5_decontamination, op6_suffix_dedup,
        op7_training_order, op8_simhash, op9_sharding, op10_language_id, op11_nearest, op12_periodic_runs,
        op13_whitening)}


def oracle_sql() -> dict[str, str]:
    return {"op5_decontamination": DECONTAMINATION}
