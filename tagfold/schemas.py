"""Explicit schemas; nothing in the package infers one."""

from pyspark.sql import types as T

READS = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("seq", T.StringType()),
    T.StructField("qual", T.StringType()),
    T.StructField("pos", T.LongType()),
    T.StructField("rec_len", T.LongType()),
])

#: What the file source gives: reads, and the sum of each read's qualities.
FILE_READS = T.StructType([*READS.fields, T.StructField("total_q", T.LongType())])

INDEX = T.StructType([
    T.StructField("id", T.StringType()),
    T.StructField("pos", T.LongType()),
    T.StructField("avg_qual", T.DoubleType()),
    T.StructField("n_bases", T.LongType()),
    T.StructField("rec_len", T.LongType()),
    T.StructField("ignored", T.BooleanType()),
])

METADATA = T.StructType([
    T.StructField("tool_version", T.StringType()),
    T.StructField("file_path", T.StringType()),
    T.StructField("index_date", T.StringType()),
    T.StructField("elapsed", T.DoubleType()),
    T.StructField("gb", T.DoubleType()),
    T.StructField("matched_read_count", T.LongType()),
    T.StructField("unmatched_read_count", T.LongType()),
    T.StructField("read_count", T.LongType()),
    T.StructField("avg_qual", T.DoubleType()),
    T.StructField("avg_len", T.DoubleType()),
    T.StructField("filtered_reads", T.LongType()),
])
