"""Duplicate statistics of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagfold.functions.scalars import group_key


def group_sizes(index: DataFrame, exact_ids: bool = False) -> DataFrame:
    return index.where(~F.col("ignored")).groupBy(group_key(F.col("id"), exact_ids).alias("gkey")).agg(F.count("*").alias("n"))


def size_histogram(index: DataFrame, exact_ids: bool = False) -> DataFrame:
    """(n, groups, reads); size 1 is always there, with 0 groups if need be."""
    found = group_sizes(index, exact_ids).groupBy("n").agg(F.count("*").alias("groups"))
    one = index.sparkSession.range(1).select(F.lit(1).cast("long").alias("n"), F.lit(0).cast("long").alias("groups"))
    return found.unionByName(one).groupBy("n").agg(F.sum("groups").alias("groups")).withColumn("reads", F.col("n") * F.col("groups"))


def duplicate_stats(index: DataFrame, exact_ids: bool = False) -> DataFrame:
    """One row: total_reads, duplicate_reads, duplicate_ids, proportion_duplicate (NaN when empty), distribution."""
    many = F.col("n") > 1
    return (
        size_histogram(index, exact_ids)
        .agg(
            F.sum("reads").alias("total_reads"),
            F.sum(F.when(many, F.col("reads")).otherwise(0)).cast("long").alias("duplicate_reads"),
            F.sum(F.when(many, F.col("groups")).otherwise(0)).cast("long").alias("duplicate_ids"),
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("n", "groups")))).alias("distribution"),
        )
        .withColumn("proportion_duplicate", F.coalesce(F.try_divide(F.col("duplicate_reads").cast("double"), F.col("total_reads").cast("double")), F.lit(float("nan"))))
    )
