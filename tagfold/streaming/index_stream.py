"""Index as a stream: marking and identification look at one read at a time, so they run on a stream unchanged."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagfold.operators.index import identify, mark_reads


def index_stream(reads: DataFrame, preset: str | None = None, *, barcode_regex: str | None = None, length=(0, 15000), quality=(0, float("inf"))) -> DataFrame:
    """Rows of the index as reads arrive; unmatched ones are dropped, as no later read could change that."""
    marked = identify(mark_reads(reads, length, quality), preset, barcode_regex)
    return marked.where(F.col("identifier").isNotNull()).select(F.col("identifier").alias("id"), "pos", "avg_qual", "n_bases", "rec_len", "ignored")
