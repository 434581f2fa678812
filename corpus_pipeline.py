"""A corpus from raw documents to shards, in five stages over whole tables.

Each function takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs. The tables of
the stages stay in the shared folder; what a stage writes for itself goes when its table is written.

Odd rows are handled by the operators that the stages call, and no stage fails on them. A null text counts as empty. Empty
texts are scored by the classifier as one empty line, are copies of each other, hold no benchmark passage, give the mix no
words and so end there. Rows repeated as they are get the same score, are one document to the near-duplicate stage (so later
stages see each once), and stay as they are otherwise. A null doc_id is a document, and never preferred to one with an id. An
empty table stays empty, with the same columns. Extra columns go along, whatever their names; `shard` and `slot` are replaced
by the last stage. Texts are never cut but by the mix, which takes the words that it draws.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tagfold.llm import decontaminate, mixing, quality_crf, sharding, simhash_gray
from tagfold.llm.common import table
from tagfold.shared import new_folder, scratch


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on labelled ones among docs, does not take for bad."""
    field = quality_crf.fit(docs, table(spark, sf_dir, "labels"), quality_crf.may_learn())
    return quality_crf.keep_good(docs, field)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, similarity 0.8 or more), the row with the smallest doc_id (of rows
    repeated under it, one)."""
    return simhash_gray.keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words drawn from each document, a row for each pass."""
    return mixing.mixed_documents(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, with their shard and slot."""
    return sharding.sharded_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("mixing sources to target weights", mixture),
    ("sharding", shards),
]

#: A trained field, fingerprints and keyed draws are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = new_folder(spark, "corpus")
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
