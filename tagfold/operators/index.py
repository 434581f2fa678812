"""Index of reads: identifier, quality, length and filter flag of each, and the statistics of the whole file."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagfold.functions.identify import check_pattern, preset_identifier, regex_captures
from tagfold.functions.intervals import Interval
from tagfold.functions.scalars import phred_average, phred_total
from tagfold.shared import hold

GIB = 1 << 30


class UnmatchedReads(ValueError):
    pass


class UnequalCaptures(ValueError):
    pass


@dataclass
class IndexResult:
    index: DataFrame
    metadata: DataFrame
    #: every read, all its columns, with `identifier` (null: unmatched), `avg_qual`, `total_q`, `n_bases`, `ignored`
    marked: DataFrame


def mark_reads(reads: DataFrame, length=(0, 15000), quality=(0, float("inf"))) -> DataFrame:
    """Adds total_q (unless the source gave it), n_bases, avg_qual and `ignored`; drops no read. An empty read is ignored
    (its mean is NaN)."""
    length, quality = Interval.of(length), Interval.of(quality)
    summed = reads if "total_q" in reads.columns else reads.withColumn("total_q", phred_total(F.col("qual")))
    return (
        summed.withColumn("n_bases", F.octet_length("seq").cast("long"))
        .withColumn("avg_qual", phred_average(F.col("total_q"), F.col("n_bases")))
        .withColumn("ignored", ~(length.contains(F.col("n_bases")) & quality.contains(F.col("avg_qual"))))
    )


def identify(marked: DataFrame, preset: str | None = None, barcode_regex: str | None = None, clusters: DataFrame | None = None) -> DataFrame:
    """Adds `identifier` (null: unmatched) and `n_captures`."""
    if preset is not None and barcode_regex is not None:
        raise ValueError("give a preset or a barcode regex, not both")
    if barcode_regex is not None:
        check_pattern(barcode_regex)
    if clusters is not None:
        last = clusters.groupBy("read_id").agg(F.max_by("identifier", "line_no").alias("identifier"))
        joined = marked.join(last, marked["id"] == last["read_id"], "left").drop("read_id")
        return joined.withColumn("n_captures", F.lit(1))
    if barcode_regex is not None:
        got = marked.withColumn("_c", regex_captures(F.col("id"), barcode_regex))
        return got.withColumn("identifier", F.concat_ws("_", "_c")).withColumn("identifier", F.when(F.col("_c").isNotNull(), F.col("identifier"))).withColumn("n_captures", F.size("_c")).drop("_c")
    return marked.withColumn("identifier", preset_identifier(F.col("id"), preset or "bc-umi")).withColumn("n_captures", F.lit(1))


def index_metadata(marked: DataFrame) -> DataFrame:
    """One row. Quality and length are means per *matched* read of its sums; `filtered_reads` counts unmatched ones too."""
    hit = F.col("identifier").isNotNull()
    return marked.agg(
        F.count("*").alias("read_count"),
        F.count_if(hit).alias("matched_read_count"),
        F.count_if(~hit).alias("unmatched_read_count"),
        F.count_if(F.col("ignored")).alias("filtered_reads"),
        F.sum(F.when(hit, F.col("total_q"))).alias("_q"),
        F.sum(F.when(hit, F.col("n_bases"))).alias("_n"),
        (F.coalesce(F.max(F.col("pos") + F.col("rec_len")), F.lit(0)) / F.lit(float(GIB))).alias("gb"),
    ).select(
        "read_count", "matched_read_count", "unmatched_read_count", "filtered_reads",
        F.coalesce(F.try_divide(F.col("_q").cast("double"), F.col("matched_read_count").cast("double")), F.lit(float("nan"))).alias("avg_qual"),
        F.coalesce(F.try_divide(F.col("_n").cast("double"), F.col("matched_read_count").cast("double")), F.lit(float("nan"))).alias("avg_len"),
        "gb",
    )


def match_facts(marked: DataFrame) -> DataFrame:
    """One row: unmatched reads and the header of the first of them in file order, least and most captures of a matched read."""
    lost = F.col("identifier").isNull()
    return marked.agg(
        F.min_by("id", F.when(lost, F.col("pos"))).alias("header"), F.count_if(lost).alias("unmatched"),
        F.min("n_captures").alias("least"), F.max("n_captures").alias("most"),
    )


def check_matches(marked: DataFrame, skip_unmatched: bool) -> None:
    """One pass: names the first offender in file order."""
    x = match_facts(marked).first()
    if x["unmatched"] and not skip_unmatched:
        raise UnmatchedReads(f"no identifier for {x['unmatched']} reads, the first of them {x['header']!r}")
    if x["least"] != x["most"]:
        raise UnequalCaptures(f"reads have between {x['least']} and {x['most']} captures")


def build_index(reads: DataFrame, preset: str | None = None, *, barcode_regex: str | None = None, clusters: DataFrame | None = None, skip_unmatched: bool = False, length=(0, 15000), quality=(0, float("inf")), check: bool = True, once: bool = False) -> IndexResult:
    """`check` runs the strict test eagerly; without it the caller answers for `check_matches`. With `once` the marked
    reads are written to the shared folder in one pass over the source, and everything after reads them from there."""
    marked = identify(mark_reads(reads, length, quality), preset, barcode_regex, clusters)
    if once:
        marked = hold(marked, "marked")
    if check:
        check_matches(marked, skip_unmatched)
    index = marked.where(F.col("identifier").isNotNull()).select(
        F.col("identifier").alias("id"), "pos", "avg_qual", "n_bases", "rec_len", "ignored"
    )
    return IndexResult(index, index_metadata(marked), marked)
