"""Runs a query and its SQL over the same tables and compares rows as multisets."""

from __future__ import annotations

import math
import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _cell(x):
    return "nan" if isinstance(x, float) and math.isnan(x) else x


def spark_rows(df):
    names = sorted(df.columns)
    return Counter(tuple(_cell(r[n]) for n in names) for r in df.collect()), names


def sql_rows(sql: str, d: str):
    c = duckdb.connect()
    for t in TABLES:
        p = f"{d}/{t}.parquet"
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    cur = c.execute(sql)
    names = [x[0] for x in cur.description]
    order = sorted(range(len(names)), key=names.__getitem__)
    return Counter(tuple(_cell(r[k]) for k in order) for r in cur.fetchall()), [names[k] for k in order]
