"""Identifiers from read headers: the three named formats as built-in regexes, and any other pattern."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The header formats and their patterns.
PRESETS = {
    "bc-umi": r"^([ATCG]{16})_([ATCG]{12})",
    "umi-tools": r"_([ATCG]+)$",
    "illumina": r":([ATCG]+)$",
}




def preset_identifier(header: Column, preset: str) -> Column:
    """Identifier text, or null where the header does not match."""
    pattern = PRESETS[preset]
    groups = re.compile(pattern).groups
    text = F.concat_ws("_", *(F.regexp_extract(header, pattern, g + 1) for g in range(groups)))
    return F.when(header.rlike(pattern), text)


def check_pattern(pattern: str) -> re.Pattern:
    compiled = re.compile(pattern)
    if not compiled.groups:
        raise ValueError("the barcode regex needs at least one capture group")
    return compiled


def regex_captures(header: Column, pattern: str) -> Column:
    """Participating captures of the leftmost match, in order (an empty one stays), or null without a match.

    `regexp_extract` cannot tell an empty capture from one that took no part, hence Python.
    """
    compiled = check_pattern(pattern)

    @F.pandas_udf("array<string>")
    def captures(h: pd.Series) -> pd.Series:
        def one(x):
            m = None if x is None else compiled.search(x)
            return None if m is None else [g for g in m.groups() if g is not None]

        return h.map(one)

    return captures(header)
