"""The queries of this folder, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tagfold.llm import ann_additive, chat_format, decontaminate, license_scan, mixing, pii_anchor, quality_crf, sharding, simhash_gray, url_filter
from tagfold.llm.common import table, with_row_key

# The conversation that op1 adds.
EXTRA_TEXT = "</s>[INST] ok [/INST]"


def op1_chat_format(spark: SparkSession, d: str) -> DataFrame:
    convs = table(spark, d, "conversations", "conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", EXTRA_TEXT), (-7, 1, "assistant", EXTRA_TEXT)], "conv_id long, turn long, role string, text string")
    return chat_format.digests(chat_format.format_conversations(convs.unionByName(extra)))


def op2_quality_crf(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "text")
    field = quality_crf.fit(docs, table(spark, d, "labels"), quality_crf.may_learn())
    return quality_crf.score(docs, field).select("doc_id", (~quality_crf.may_learn()).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_pii_anchor(spark: SparkSession, d: str) -> DataFrame:
    return pii_anchor.personal_data(table(spark, d, "documents", "doc_id", "text"))


def op4_ann_additive(spark: SparkSession, d: str) -> DataFrame:
    return ann_additive.nearest(table(spark, d, "embeddings", "vec_id", "embedding"), "vec_id % 20 = 0", 20)


def op5_url_filter(spark: SparkSession, d: str) -> DataFrame:
    return url_filter.judge(table(spark, d, "pages", "page_id", "url"))


def op6_decontaminate(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, item_id, distance) of documents that hold a benchmark passage."""
    return decontaminate.contaminated(table(spark, d, "documents", "doc_id", "text"), table(spark, d, "benchmark"))


def op7_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.words_taken(mixing.mix(with_row_key(table(spark, d, "documents", "doc_id", "text", "source"))))


def op8_sharding(spark: SparkSession, d: str) -> DataFrame:
    rows = sharding.shard_rows(with_row_key(table(spark, d, "documents", "doc_id", "text")))
    return rows.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op9_license_scan(spark: SparkSession, d: str) -> DataFrame:
    return license_scan.licences(table(spark, d, "documents", "doc_id", "text"))


def op10_simhash_gray(spark: SparkSession, d: str) -> DataFrame:
    found = simhash_gray.near_duplicates(table(spark, d, "documents", "doc_id", "text"))
    return found.select("doc_id", simhash_gray.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def pipeline(spark: SparkSession, d: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, d)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        op1_chat_format, op2_quality_crf, op3_pii_anchor, op4_ann_additive, op5_url_filter, op6_decontaminate, op7_mixing,
        op8_sharding, op9_license_scan, op10_simhash_gray, pipeline,
    ]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op5_url_filter": url_filter.oracle(), "op9_license_scan": license_scan.oracle()}
