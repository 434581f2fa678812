"""Connected components by alternating large and small stars (Kiveris et al. 2014), on joins and minima alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagfold.llm.common import cut
from tagfold.operators.skew import join_counted

MAX_ROUNDS = 60


def _stars(edges: DataFrame, n: int) -> DataFrame:
    """edges: (a, b), a > b, distinct, n of them. One large star and one small star. A node may have any share of all edges,
    so what is known of a node meets its edges by `join_counted`."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("k")).withColumn("m", F.least("a", "m"))
    large = cut(join_counted(both, least, ["a"], "k", 2 * n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a > b").distinct())
    down = large.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("k"))
    small = join_counted(large, down, ["a"], "k", n).where("b > m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return small.unionByName(down.select("a", F.col("m").alias("b"))).distinct()


def union(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """label: by number, the least known number of its component. The same with the links a, b."""
    while len(a):
        x, y = label[a], label[b]
        differ = x != y
        a, b, x, y = a[differ], b[differ], x[differ], y[differ]
        if not len(a):
            break
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while True:
            up = label[label]
            if np.array_equal(up, label):
                break
            label = up
    return label


def _at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All edges to (node, root)."""
    held = [[np.asarray(b.column(c)) for c in ("a", "b")] for b in batches if b.num_rows]
    if not held:
        return
    a, b = (np.concatenate(c) for c in zip(*held, strict=True))
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    label = union(np.arange(len(nodes)), at[: len(a)], at[len(a) :])
    other = label != np.arange(len(nodes))
    yield pa.RecordBatch.from_arrays([pa.array(nodes[other]), pa.array(nodes[label[other]])], ["node", "root"])


def components(edges: DataFrame, at_once: int = 0) -> DataFrame:
    """edges: two long columns (a, b) in any order. Returns (node, root): every node with an edge to another, and the
    smallest node of its component; the smallest itself is left out. Nulls and loops are dropped. At most `at_once` distinct
    edges are one task's work instead of rounds."""
    now = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct())
    seen = None
    for _ in range(MAX_ROUNDS):
        mark = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if mark == seen or not mark[0]:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        if mark[0] <= at_once:
            return cut(now.repartition(1).mapInArrow(_at_once, "node long, root long"))
        seen, now = mark, cut(_stars(now, mark[0]))
    raise RuntimeError("components did not settle")
