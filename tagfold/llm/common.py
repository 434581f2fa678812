"""What several operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tagfold.shared import hold, shared_dir


def cut(df: DataFrame) -> DataFrame:
    """Computes `df` once into the shared folder, so that a lost executor costs no recomputation upstream. What reads it
    plans by its true size; a checkpoint would hand on estimates, which multiply from join to join."""
    return hold(df, "cut")


def in_order(df: DataFrame) -> DataFrame:
    """The same, with its partitions as they are, and columns of any names."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def unit(*cols: Column | str) -> Column:
    """A number in [0, 1) that depends on the columns alone."""
    return F.pmod(F.xxhash64(*cols), F.lit(1 << 40)) / float(1 << 40)


def numbered(df: DataFrame, out: str, *order: Column) -> DataFrame:
    """Adds `out`, the row's place from 0 in the given order: sorted parts, whose sizes alone come to the driver."""
    parts = in_order(df.orderBy(*order))
    here = F.spark_partition_id()
    sizes = {r["p"]: r["count"] for r in parts.groupBy(here.alias("p")).count().collect()}
    starts = [0]
    for p in range(max(sizes, default=0)):
        starts.append(starts[-1] + sizes.get(p, 0))
    inside = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return parts.withColumn(out, inside + F.get(F.array(*(F.lit(x).cast("long") for x in starts)), here))


def fresh(name: str, columns: list[str]) -> str:
    """`name`, with as many underscores after it as make it none of the columns (names differ by case alone count as
    equal)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


ROW_KEY = ["_row", "_row2"]


def with_row_key(docs: DataFrame) -> DataFrame:
    """Puts `_row` and `_row2` first, two hashes of the whole row that together name it (and are never null, so joins on
    them share their partitioning); rows equal in all columns share them. Columns that have these names already go into
    the hashes and are renamed."""
    whole = [F.col(f"`{c}`") for c in docs.columns]
    names = {c: fresh(c + "_", docs.columns) if c.lower() in ROW_KEY else c for c in docs.columns}
    return docs.select(F.xxhash64(*whole).alias("_row"), F.xxhash64(F.lit(1), *whole).alias("_row2"), *(F.col(f"`{c}`").alias(n) for c, n in names.items()))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs: from `with_row_key`. One row of those equal in all columns, dealt by the key."""
    rest = [c for c in docs.columns if c not in ROW_KEY]
    first = docs.groupBy(*ROW_KEY).agg(*(F.first(F.col(f"`{c}`")).alias(f"c{k}") for k, c in enumerate(rest)))
    return first.select(*ROW_KEY, *(F.col(f"c{k}").alias(c) for k, c in enumerate(rest)))


def attach(docs: DataFrame, facts: DataFrame, out: str = "fact") -> DataFrame:
    """docs: from `with_row_key`. facts: the key and `fact` (a struct), a row for each copy of a document row. Gives each
    fact, as column `out`, the columns of its document, in one shuffle of the texts; a document without a fact goes."""
    joined = one_of_each(docs).join(facts.withColumnRenamed("fact", "_fact_of_row"), ROW_KEY)
    return joined.select(*(F.col(f"`{c}`") for c in docs.columns if c not in ROW_KEY), F.col("_fact_of_row").alias(out))
