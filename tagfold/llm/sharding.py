"""Operator 8: documents to shards by balanced label propagation.

Two documents are linked if their texts are equal. Each document begins in a shard by its hash. In each round it wishes
to be where most of its neighbours are, in one of as many shards as its group fills (counts by group and shard, so a group costs at most a row per shard however large
it is); a table of wishes from shard to shard, at most shards squared numbers, gives each way a quota: exchanges both
ways, and what room the target shard has left for linked documents. Wishes beyond the quota are thinned by hash, by group
if the group is small, so that it moves whole, else by document. At the end a shard's linked documents come first,
and whatever stands beyond its share of rows moves to the shards that lack rows.

Facts of groups with a share of all rows are broadcast, of others joined (`join_counted`); ranks are windows in two levels of
about the square root of all rows, over which groups larger than that are spread.

Law `rows`: the shards' row counts differ by one at most. Slots run from 0 without gaps. A group larger than a shard is
spread over several. Null texts count as empty; an empty table gives no rows; rows repeated as they are each have their slot.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagfold.llm.common import ROW_KEY, attach, cut, fresh, unit, with_row_key
from tagfold.operators.skew import join_counted

SHARDS, ROUNDS = 16, 4
GROUP = ("g", "crc", "size")


def _prepare(docs: DataFrame, shards: int) -> tuple[DataFrame, int]:
    """The rows with their first shard and n, the rows of their group; and how many rows there are."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    slim = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), *ROW_KEY, F.xxhash64(text).alias("g"), F.crc32(text.cast("binary")).alias("crc"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
    )
    slim = cut(slim.withColumn("shard", F.pmod(F.xxhash64(*ROW_KEY), F.lit(shards)).cast("int")))
    counts = cut(slim.groupBy(*GROUP).agg(F.count("*").alias("n")))
    rows = slim.count()
    return cut(join_counted(slim, counts, list(GROUP), "n", rows)), rows


def shares(rows: int, shards: int) -> list[int]:
    return [rows // shards + (k < rows % shards) for k in range(shards)]


def quotas(wishes: dict[tuple[int, int], int], linked: list[int], room: list[int]) -> dict[tuple[int, int], float]:
    """Share of the wishes of each way that are granted."""
    swap = {(a, b): min(n, wishes.get((b, a), 0)) for (a, b), n in wishes.items()}
    into = [sum(n - swap[w] for w, n in wishes.items() if w[1] == b) for b in range(len(room))]
    out = {}
    for (a, b), n in wishes.items():
        free = max(0, room[b] - linked[b])
        granted = swap[a, b] + (n - swap[a, b]) * min(1.0, free / into[b] if into[b] else 0.0)
        out[a, b] = granted / n
    return out


def propagate(linked: DataFrame, rows: int, shards: int, rounds: int = ROUNDS) -> DataFrame:
    """linked: rows of groups of two or more with `shard`, of `rows` rows in all; gives them their shard after the last round."""
    room = shares(rows, shards)
    for turn in range(rounds):
        load = [0] * shards
        for r in linked.groupBy("shard").count().collect():  # at most `shards` rows
            load[r["shard"]] = r["count"]
        here = linked.groupBy(*GROUP, "n", "shard").agg(F.count("*").alias("c"))
        tie = F.xxhash64("g", "crc", "shard")
        # at most `shards` entries a group; a group larger than a shard has as many homes as it needs
        ranked = here.groupBy(*GROUP, "n").agg(F.sort_array(F.collect_list(F.struct("c", tie.alias("tie"), "shard")), asc=False)["shard"].alias("ranked"))
        homes = cut(ranked.select(*GROUP, "n", F.slice("ranked", F.lit(1), F.expr(f"cast(ceil(n / {max(1, room[-1])}) as int)")).alias("homes")))
        mine = F.get("homes", F.pmod(F.xxhash64(*ROW_KEY, F.lit(3)), F.size("homes")).cast("int"))
        to = F.when(F.array_contains("homes", F.col("shard")), F.col("shard")).otherwise(mine)
        wish = join_counted(linked, homes, [*GROUP, "n"], "n", rows).withColumn("to", to).drop("homes")
        table = {(r["shard"], r["to"]): r["count"] for r in wish.where("`to` <> shard").groupBy("shard", "to").count().collect()}
        if not table:
            break
        granted = quotas(table, load, room)
        grant = F.get(F.lit([granted.get((a, b), 0.0) for a in range(shards) for b in range(shards)]), F.col("shard") * shards + F.col("to"))
        whole = F.col("n") * 100 < rows // shards + 1
        draw = F.when(whole, unit("g", "crc", F.lit(turn))).otherwise(unit(*ROW_KEY, F.lit(turn)))
        linked = cut(wish.withColumn("shard", F.when((F.col("to") != F.col("shard")) & (draw < grant), F.col("to")).otherwise(F.col("shard"))).drop("to"))
    return linked


def _step(x: Column, edges: list[int]) -> Column:
    """Number of edges at or below x."""
    return sum((F.when(x >= e, 1).otherwise(0) for e in edges), F.lit(0))


def _pick(index: Column, values: list[int]) -> Column:
    return F.element_at(F.array(*(F.lit(v).cast("long") for v in values)), (index + 1).cast("int"))


def settle(placed: DataFrame, rows: int, shards: int) -> DataFrame:
    """Final shard and slot: counts of rows at most one apart."""
    room = shares(rows, shards)
    buckets = max(1, math.isqrt(rows))
    large = F.col("n") > buckets
    b = (
        placed.withColumn("k", F.when(F.col("n") > 1, 0).otherwise(1))
        .withColumn("gb", F.when(F.col("k") == 0, F.pmod(F.xxhash64("g", "crc"), F.lit(buckets))).otherwise(F.pmod(F.xxhash64(*ROW_KEY, F.lit(1)), F.lit(buckets))))
        .withColumn("db", F.when(large, F.pmod(F.xxhash64(*ROW_KEY, F.lit(2)), F.lit(buckets))).otherwise(F.lit(0)))
    )
    keys = ["shard", "k", "gb", "db"]
    sums = cut(b.groupBy(*keys).agg(F.count("*").alias("c")))
    have = [0] * shards
    for r in sums.groupBy("shard").agg(F.sum("c").alias("c")).collect():
        have[r["shard"]] = r["c"]
    before = Window.partitionBy("shard").orderBy("k", "gb", "db").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(*keys, F.coalesce(F.sum("c").over(before), F.lit(0)).alias("o"))
    inside = F.row_number().over(Window.partitionBy(*keys).orderBy("g", *ROW_KEY)) - 1
    ranked = b.withColumn("i", inside).join(offsets, keys).withColumn("rank", (F.col("o") + F.col("i")).cast("long"))
    extra, lack = [0], [0]
    for k in range(shards):
        extra.append(extra[-1] + max(0, have[k] - room[k]))
        lack.append(lack[-1] + max(0, room[k] - have[k]))
    x = _pick(F.col("shard"), extra[:-1]) + F.col("rank") - _pick(F.col("shard"), room)
    moved = _step(x, lack[1:])
    slot = _pick(moved, have) + x - _pick(moved, lack[:-1])
    stays = F.col("rank") < _pick(F.col("shard"), room)
    return ranked.select(
        "doc_id", *ROW_KEY, "size", F.col("crc").alias("text_crc32"),
        F.when(stays, F.col("shard")).otherwise(moved).cast("int").alias("shard"),
        F.when(stays, F.col("rank")).otherwise(slot).cast("long").alias("slot"),
    )


def shard_rows(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """docs: from `with_row_key`. (doc_id, the row key, size, text_crc32, shard, slot)."""
    grouped, rows = _prepare(docs, shards)
    linked = propagate(grouped.where("n > 1"), rows, shards)
    return settle(grouped.where("n = 1").unionByName(linked), rows, shards)


def sharded_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Rows of docs with `shard` and `slot`, which replace columns of those names."""
    slim = docs.drop("shard", "slot")
    keyed = with_row_key(slim)
    facts = shard_rows(keyed, shards).select(*ROW_KEY, F.struct("shard", "slot").alias("fact"))
    fact = fresh("fact", slim.columns)
    return attach(keyed, facts, fact).select(*(F.col(f"`{c}`") for c in slim.columns), F.col(fact)["shard"].alias("shard"), F.col(fact)["slot"].alias("slot"))
