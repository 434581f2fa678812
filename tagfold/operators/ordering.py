"""Running totals over a total order without a one-partition window over the rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def running_total(df: DataFrame, order: str, value: Column, width: int, out: str, first: Column | None = None) -> DataFrame:
    """Adds `out`: the sum of `value` over all rows before this one by the unique non-negative long `order`.

    Rows are dealt to ranges of `width` of the order; only the table of range sums, smaller by the rows of a range,
    meets in one partition. Each range is then summed on its own.
    """
    b = df.withColumn("_b", F.expr(f"{order} div {width}")).withColumn("_v", value.cast("long"))
    sums = b.groupBy("_b").agg(F.sum("_v").alias("_s"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_o"))
    within = Window.partitionBy("_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        b.join(offsets, "_b")
        .withColumn(out, (F.col("_o") + F.coalesce(F.sum("_v").over(within), F.lit(0))).cast("long"))
        .drop("_b", "_v", "_o")
    )
