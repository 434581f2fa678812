"""Joins in which one key may have any share of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key counts as hot from this share of all rows on, so there are at most as many hot keys.
HOT_SHARE = 1000


def join_counted(rows: DataFrame, facts: DataFrame, on: list[str], count: str, total: int) -> DataFrame:
    """rows (read twice) inner joined with facts, which has a row for each key and in `count` how many of the rows bear it.
    The facts of keys with 1 / HOT_SHARE of all rows or more, HOT_SHARE at most, are broadcast, so that no task gets all
    rows of such a key; the others meet by shuffling."""
    is_hot = F.col(count) * HOT_SHARE >= total
    hot = facts.where(is_hot)
    cold = rows.join(F.broadcast(hot.select(*on)), on, "left_anti").join(facts.where(~is_hot), on)
    return rows.join(F.broadcast(hot), on).unionByName(cold)
