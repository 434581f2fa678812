"""Groups of reads that share a key: numbering, tagging, and consensus headers.

What is said of a read's place in its group is computed on three numbers a read (`slim`: gkey, pos, avg_qual), by running
windows, which spill, so no group is gathered in a value; a group of any share of all reads is spread over ranges of the file.
Headers and sequences then meet these facts by `pos`, in which no key is hot. Only consensus deals the reads themselves by
group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagfold.functions.scalars import group_key, read_tag, two_decimals
from tagfold.operators.index import IndexResult
from tagfold.operators.ordering import running_total
from tagfold.operators.skew import join_counted
from tagfold.shared import hold

#: Bytes of the read file that one range of the group numbering covers.
RANGE_BYTES = 1 << 26

KEPT = ("gkey", "id", "seq", "qual", "pos", "avg_qual")
SLIM = ("gkey", "pos", "avg_qual")


def kept_index(index: DataFrame, exact_ids: bool = False) -> DataFrame:
    """(gkey, pos, avg_qual) of the kept rows of an index."""
    return index.where(~F.col("ignored")).select(group_key(F.col("id"), exact_ids).alias("gkey"), "pos", "avg_qual")


def kept_reads(reads: DataFrame, index: DataFrame, exact_ids: bool = False) -> DataFrame:
    """Kept reads with their group key, of an index that came by itself. The join is on the start byte, so unmatched reads
    are simply absent."""
    return reads.select("id", "seq", "qual", "pos").join(kept_index(index, exact_ids), "pos").select(*KEPT)


def kept_of(result: IndexResult, exact_ids: bool = False) -> DataFrame:
    """The same of an index built in this session: its marked reads have all columns, so nothing is joined."""
    kept = result.marked.where(F.col("identifier").isNotNull() & ~F.col("ignored"))
    return kept.withColumn("gkey", group_key(F.col("identifier"), exact_ids)).select(*KEPT)


def number_groups(kept: DataFrame, duplicates_only: bool = False) -> DataFrame:
    """kept: gkey, pos, avg_qual. (gkey, n, ug, quality): ug counts groups from 0 by first appearance; with
    `duplicates_only` singles use none.

    `quality` is the mean of the members' rounded means, added up in file order: a sum over a running frame, row by row, so
    the three numbers of a group's reads pass through one task.
    """
    w = Window.partitionBy("gkey").orderBy("pos")
    so_far = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    running = kept.select(
        "gkey", F.row_number().over(w).cast("long").alias("n"), F.first("pos").over(so_far).alias("first_pos"),
        F.sum("avg_qual").over(so_far).alias("_sum"), F.lead("pos").over(w).alias("_next"),
    )
    groups = running.where("_next is null").select("gkey", "n", "first_pos", (F.col("_sum") / F.col("n")).alias("quality"))
    if duplicates_only:
        groups = groups.where("n > 1")
    return running_total(groups, "first_pos", F.lit(1), RANGE_BYTES, "ug").select("gkey", "n", "ug", "quality")


def member_facts(slim: DataFrame, duplicates_only: bool = False) -> DataFrame:
    """slim: gkey, pos, avg_qual of the kept reads. (gkey, pos, i, n, ug, quality): i is a read's place in its group from 1 in
    file order, counted in ranges of the file and over the ranges."""
    ranged = slim.select("gkey", "pos", F.expr(f"pos div {RANGE_BYTES}").alias("_b"))
    before = Window.partitionBy("gkey").orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    counts = ranged.groupBy("gkey", "_b").agg(F.count("*").alias("_c"))
    offsets = counts.select("gkey", "_b", F.coalesce(F.sum("_c").over(before), F.lit(0)).alias("_o"))
    inside = F.row_number().over(Window.partitionBy("gkey", "_b").orderBy("pos"))
    placed = hold(ranged.withColumn("_i", inside).join(offsets, ["gkey", "_b"]).select("gkey", "pos", (F.col("_o") + F.col("_i")).cast("long").alias("i")), "placed")
    return join_counted(placed, hold(number_groups(slim, duplicates_only), "groups"), ["gkey"], "n", placed.count())


def grouped_reads(kept: DataFrame, duplicates_only: bool = False, tasks: int | None = None, slim: DataFrame | None = None) -> DataFrame:
    """kept: from `kept_reads` or `kept_of`; slim: the same without its texts, where that is cheaper to read. Its rows with n,
    ug, quality and i, dealt by group: a group's rows are together in a partition, in order. `tasks` fixes the number of
    partitions."""
    numbered = number_groups(kept.select(*SLIM) if slim is None else slim, duplicates_only)
    dealt = kept if tasks is None else kept.repartition(tasks, "gkey")
    # neither side has a proven bound
    rows = dealt.join(numbered.hint("merge"), "gkey")
    return rows.withColumn("i", F.row_number().over(Window.partitionBy("gkey").orderBy("pos")).cast("long"))


def tag_groups(kept: DataFrame, slim: DataFrame | None = None) -> DataFrame:
    """(ug, i, id, seq, qual): every kept read, its header tagged with its place in its group."""
    facts = member_facts(kept.select(*SLIM) if slim is None else slim)
    g = kept.select("id", "seq", "qual", "pos").join(facts.select("pos", "ug", "i", "n"), "pos")
    return g.select("ug", "i", F.concat("id", read_tag("ORIG", F.col("ug"), F.col("i"), F.col("n"))).alias("id"), "seq", "qual")


def quality_tag(tag: Column, quality: Column) -> Column:
    return F.concat(tag, F.lit(" QL:f:"), two_decimals(quality))
