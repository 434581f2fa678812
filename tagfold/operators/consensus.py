"""One read per group: singles as they are, larger groups by partial-order alignment.

Reads are dealt by group once. Tasks that align get groups row by row, in file order, and hold one group at a time;
singles pass through them as whole batches.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tagfold.functions.scalars import read_tag
from tagfold.operators.groups import SLIM, grouped_reads, member_facts, quality_tag
from tagfold.operators.poa import consensus

#: Cells of alignment (reads of a group times the square of their mean length) that one task should fill.
CELLS_PER_TASK = 1 << 30

FACTS = ("gkey", "ug", "quality", "n")
CALLED = "gkey string, ug long, quality double, n long, kind int, i long, id string, seq string, qual string"


def _call_batches(originals: bool, most: int | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in CALLED.split(", ")]
        types = [{"string": pa.string(), "long": pa.int64(), "double": pa.float64(), "int": pa.int32()}[c.split()[1]] for c in CALLED.split(", ")]

        def out(b: pa.RecordBatch, kind: int, i: pa.Array) -> pa.RecordBatch:
            columns = {**{x: b.column(x) for x in (*FACTS, "id", "seq", "qual")}, "kind": pa.array(np.full(b.num_rows, kind)), "i": i}
            return pa.RecordBatch.from_arrays([columns[x].cast(t) for x, t in zip(names, types, strict=True)], names)

        def call(facts: tuple, members: list[tuple[str, str]]) -> list[tuple]:
            return [(*facts, 1, 0, None, *consensus(members))] if members else []

        facts, members = (), []
        for b in batches:
            single = np.asarray(b.column("n")) == 1
            alone = b.filter(pa.array(single))
            if alone.num_rows:
                yield out(alone, 1, pa.array(np.zeros(alone.num_rows, np.int64)))
            larger = b.filter(pa.array(~single))
            if not larger.num_rows:
                continue
            if most is not None and max(larger.column("n").to_pylist()) > most:
                raise ValueError("a group has more reads than max_group_reads")
            if originals:
                yield out(larger, 0, larger.column("i"))
            rows = []
            for *now, i, seq, qual in zip(*(larger.column(x).to_pylist() for x in (*FACTS, "i", "seq", "qual")), strict=True):
                if i == 1:
                    rows += call(facts, members)
                    facts, members = tuple(now), []
                members.append((seq, qual))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
        for row in call(facts, members):
            yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names)

    return run


def _tasks(kept: DataFrame) -> int:
    """How many tasks the alignments are worth. Aligning costs far more than the bytes suggest by which small partitions
    would be merged."""
    groups = kept.groupBy("gkey").agg(F.count("*").alias("n"), F.avg(F.octet_length("seq")).alias("b")).where("n > 1")
    cells = groups.agg(F.sum(F.col("n") * F.col("b") * F.col("b"))).first()[0] or 0
    return max(int(kept.sparkSession.conf.get("spark.sql.shuffle.partitions")), int(cells // CELLS_PER_TASK) + 1)


def _headed(rows: DataFrame, *body: str) -> DataFrame:
    """rows: gkey, ug, quality, n, kind, i, id (the read's own). (ug, kind, i, id with its tag, body)."""
    ug, n, quality = F.col("ug"), F.col("n"), F.col("quality")
    name = (
        F.when(F.col("kind") == 0, F.concat("id", read_tag("ORIG", ug, F.col("i"), n)))
        .when(n == 1, quality_tag(F.concat("id", read_tag("SIN", ug)), quality))
        .otherwise(quality_tag(F.concat("gkey", read_tag("CON", ug, n=n)), quality))
    )
    return rows.select("ug", "kind", "i", name.alias("id"), *body)


def call_consensus(kept: DataFrame, duplicates_only: bool = False, report_original_reads: bool = False, max_group_reads: int | None = None, slim: DataFrame | None = None) -> DataFrame:
    """kept: from `kept_reads` or `kept_of`. (ug, kind, i, id, seq, qual), one consensus row a group (kind 1, or a single's
    own read), originals of larger groups as kind 0 if asked for. Sort by (ug, kind, i) to write. A group beyond
    `max_group_reads` raises."""
    rows = grouped_reads(kept, duplicates_only, _tasks(kept), slim).sortWithinPartitions("gkey", "pos")
    called = rows.select(*FACTS, "i", "id", "seq", "qual").mapInArrow(_call_batches(report_original_reads, max_group_reads), CALLED)
    return _headed(called, "seq", "qual")


def call_headers(kept: DataFrame, duplicates_only: bool = False, report_original_reads: bool = False, slim: DataFrame | None = None) -> DataFrame:
    """(ug, kind, i, id) of the same rows; nothing is aligned."""
    facts = member_facts(kept.select(*SLIM) if slim is None else slim, duplicates_only)
    g = kept.select("id", "pos").join(facts, "pos")
    row = lambda kind, i: F.struct(F.lit(kind).alias("kind"), i.cast("long").alias("i"))
    con, orig = row(1, F.lit(0)), row(0, F.col("i"))
    kinds = F.when(F.col("n") == 1, F.array(con))
    if report_original_reads:
        kinds = kinds.when(F.col("i") == 1, F.array(con, orig)).otherwise(F.array(orig))
    else:
        kinds = kinds.when(F.col("i") == 1, F.array(con))
    return _headed(g.select(*FACTS, "id", F.explode(kinds).alias("k")).select(*FACTS, "id", "k.kind", "k.i"))
