"""Scalar column functions on reads and identifiers. All run inside the JVM but for `phred_total`, which has no
built-in short of a string for each base, and `two_decimals`."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


@F.arrow_udf(T.LongType())
def phred_total(qual: pa.Array) -> pa.Array:
    """Sum of Phred+33 qualities, by running sums over the batch's bytes. An empty string gives 0, null gives null."""
    filled = qual.fill_null("").cast(pa.large_binary())
    at = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
    low, high = int(at[0]), int(at[-1])
    sums = np.zeros(high - low + 1, np.int64)
    np.cumsum(np.frombuffer(filled.buffers()[2] or b"", np.uint8)[low:high], out=sums[1:])
    total = sums[at[1:] - low] - sums[at[:-1] - low] - 33 * np.diff(at)
    return pa.array(total, mask=np.asarray(qual.is_null()))


def phred_average(total: Column, n_bases: Column) -> Column:
    """Mean quality rounded half away from zero on the scaled value; NaN for an empty read."""
    scaled = F.round(F.try_divide(total.cast("double"), n_bases.cast("double")) * 100.0)
    return F.coalesce(scaled / 100.0, F.lit(float("nan")))


def group_key(identifier: Column, exact: bool = False) -> Column:
    """Key that reads are grouped by. Unless `exact`, an identifier whose first `_` is missing or is its last
    character loses that last character, as the index format's re-parse has it."""
    if exact:
        return identifier
    at = F.instr(identifier, "_")
    n = F.length(identifier)
    cut = F.substring(identifier, F.lit(1), n - 1)
    return F.when((at == 0) | (at == n), cut).otherwise(identifier)


@F.pandas_udf(T.StringType())
def two_decimals(x: pd.Series) -> pd.Series:
    """`%.2f` of the exact binary value, ties to even; JVM formatting rounds the shortest decimal instead."""
    return x.map(lambda v: None if v is None else f"{v:.2f}" if v == v else "NaN")


def read_tag(kind: str, ug: Column, i: Column | None = None, n: Column | None = None) -> Column:
    """` UT:Z:<label> UG:i:<group>`; kind is CON, SIN or ORIG."""
    label = {
        "SIN": lambda: F.lit("SIN"),
        "CON": lambda: F.concat(F.lit("CON_"), n.cast("string")),
        "ORIG": lambda: F.concat(F.lit("ORIG_"), i.cast("string"), F.lit("_OF_"), n.cast("string")),
    }[kind]()
    return F.concat(F.lit(" UT:Z:"), label, F.lit(" UG:i:"), ug.cast("string"))


def fastq_lines(id: Column, seq: Column, qual: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit("@"), id), seq, F.lit("+"), qual)


def fasta_lines(id: Column, seq: Column) -> Column:
    return F.concat_ws("\n", F.concat(F.lit(">"), id), seq)
