"""The four jobs from path to path, as functions and on the command line:

    python -m tagfold.jobs index reads.fastq -o index.tsv
    python -m tagfold.jobs summary --index index.tsv -o summary.html
    python -m tagfold.jobs call --index index.tsv --input reads.fastq -o called
    python -m tagfold.jobs group --index index.tsv --input reads.fastq -o tagged

`call` and `group` write folders of parts whose concatenation by name is in order.
"""

from __future__ import annotations

import argparse
import json
import sys
import time
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from tagfold import VERSION
from tagfold.functions.intervals import Interval
from tagfold.operators.consensus import call_consensus
from tagfold.operators.groups import kept_index, kept_reads, tag_groups
from tagfold.operators.index import build_index
from tagfold.shared import hold, scratch
from tagfold.sources.fastq import read_fastq, write_fastq
from tagfold.sources.index_file import read_clusters, read_index_file, write_index_file
from tagfold.sources.report import summary, write_report


def index(spark: SparkSession, reads: str, out: str, preset: str | None = None, *, barcode_regex: str | None = None, clusters: str | None = None, skip_unmatched: bool = False, length=(0, 15000), quality=(0, float("inf"))) -> dict:
    """Writes the index of a read file, or of a folder of them, as a single file; gives its metadata. Raises on reads
    without an identifier unless they are to be skipped."""
    began = time.time()
    named = None if clusters is None else read_clusters(spark, clusters)
    facts = {"tool_version": VERSION, "file_path": reads, "index_date": datetime.now().astimezone().isoformat()}
    with scratch(spark):
        found = build_index(read_fastq(spark, reads), preset, barcode_regex=barcode_regex, clusters=named, skip_unmatched=skip_unmatched, length=length, quality=quality, once=True)
        return write_index_file(found, out, **facts, elapsed=time.time() - began)


def summarise(spark: SparkSession, index_file: str, out: str, data: str | None = None) -> dict:
    """Writes the page (and the JSON, if `data` names a file) of an index file; gives the report."""
    metadata, rows = read_index_file(spark, index_file)
    report = summary(rows, metadata)
    write_report(report, out, data)
    return report


def _kept(spark: SparkSession, index_file: str, reads: str, exact_ids: bool) -> tuple[DataFrame, DataFrame]:
    """Kept reads, and of the index alone what numbers their groups; the read file is scanned for the former only."""
    rows = read_index_file(spark, index_file)[1]
    return kept_reads(read_fastq(spark, reads), rows, exact_ids), kept_index(rows, exact_ids)


def call(spark: SparkSession, index_file: str, reads: str, out: str, duplicates_only: bool = False, report_original_reads: bool = False, exact_ids: bool = False, max_group_reads: int | None = None) -> None:
    kept, slim = _kept(spark, index_file, reads, exact_ids)
    with scratch(spark):
        # the number of tasks is planned from the reads, and sorting looks at its input twice: both from tables
        called = hold(call_consensus(hold(kept, "kept"), duplicates_only, report_original_reads, max_group_reads, slim), "called")
        write_fastq(called, out, ("ug", "kind", "i"))


def group(spark: SparkSession, index_file: str, reads: str, out: str, exact_ids: bool = False) -> None:
    kept, slim = _kept(spark, index_file, reads, exact_ids)
    with scratch(spark):
        write_fastq(hold(tag_groups(kept, slim), "tagged"), out)


def arguments() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="tagfold")
    jobs = top.add_subparsers(dest="job", required=True)
    x = jobs.add_parser("index", help="index a FASTQ file or folder")
    x.add_argument("file")
    x.add_argument("preset", nargs="?", help="bc-umi (the default), umi-tools or illumina")
    x.add_argument("-o", dest="out", default="index.tsv")
    x.add_argument("--clusters", help="a file of read;identifier or read;barcode;umi")
    x.add_argument("--barcode-regex")
    x.add_argument("--skip-unmatched", action="store_true")
    x.add_argument("--len", dest="length", type=Interval.parse, default=Interval(0, 15000), help="minimum,maximum, both outside")
    x.add_argument("--qual", dest="quality", type=Interval.parse, default=Interval(0), help="minimum,maximum, both outside")
    x = jobs.add_parser("summary", help="statistics of an index")
    x.add_argument("--index", default="index.tsv")
    x.add_argument("-o", dest="out", default="summary.html")
    for name, told in (("call", "one read for each group"), ("group", "tag reads with their group")):
        x = jobs.add_parser(name, help=told)
        x.add_argument("--index", default="index.tsv")
        x.add_argument("--input", required=True)
        x.add_argument("-o", dest="out", required=True)
        if name == "call":
            x.add_argument("-d", "--duplicates-only", action="store_true")
            x.add_argument("-r", "--report-original-reads", action="store_true")
    return top


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = arguments().parse_args(argv)
    spark = spark or SparkSession.builder.appName("tagfold").getOrCreate()
    if a.job == "index":
        index(spark, a.file, a.out, a.preset, barcode_regex=a.barcode_regex, clusters=a.clusters, skip_unmatched=a.skip_unmatched, length=a.length, quality=a.quality)
    elif a.job == "summary":
        json.dump(summarise(spark, a.index, a.out), sys.stdout, indent=2)
    elif a.job == "call":
        call(spark, a.index, a.input, a.out, a.duplicates_only, a.report_original_reads)
    else:
        group(spark, a.index, a.input, a.out)


if __name__ == "__main__":
    main()
