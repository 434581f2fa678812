"""Operator 7: a mix of sources by target weights, drawn as blocks of words.

The words of each source, its documents in a pseudorandom order, are packed into blocks of BLOCK_WORDS words (the last
one may be short). A source's target in words is met by whole passes over its blocks and a part of one more; the last
block drawn is cut, so that the words drawn are the target rounded down. Output shards hold about SLOTS_PER_SHARD blocks. How
many of its slots a source has in each shard is a multinomial draw, in two steps: over groups of SHARDS_AT_ONCE shards, and
over the shards of a group; so the draws of a shard are multinomial over the sources, and a source's total holds exactly.
Slot j of a source maps to a block by a keyed permutation of the block numbers, another one for each pass, and slots join
blocks by that number. The same input and seed give the same mix.

Sources, their targets, draws and slots are tables, of any size; the driver sees sums alone. The order of a source's documents
is a window in two levels, of about the square root of all rows each. Null texts have no words; a null source is a source, the
last one. Empty tables give no rows. Rows repeated as they are are drawn as documents of their own.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from tagfold.llm.common import ROW_KEY, attach, cut, fresh, numbered, with_row_key
from tagfold.operators.skew import join_counted

WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
BLOCK_WORDS, SLOTS_PER_SHARD, SHARDS_AT_ONCE, SEED = 512, 4096, 1024, 20_240
SLOTS_PER_TASK = 1 << 20
WORD = r"[^\x20\x09-\x0D]+"


def with_targets(sources: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """sources: s (number of the source), n (its words). Adds `target`: words wanted of it, by weight, none above `most` times
    its words, the excess shared out again. Each round looks at the sources that the level so far caps, which only grow."""
    w = F.get(F.array(*map(F.lit, weights)), F.pmod("s", F.lit(len(weights))).cast("int"))
    some = sources.where("n > 0")
    sums = some.agg(F.sum("n").alias("n"), F.sum(w).alias("w")).first()
    if not sums["n"]:
        return sources.withColumn("target", F.lit(0.0))
    left, total, capped = share * sums["n"], sums["w"], 0
    while total:
        over = F.lit(left) * w / F.lit(total) > F.lit(float(most)) * F.col("n")
        now = some.agg(F.count_if(over).alias("k"), F.sum(F.when(over, F.col("n"))).alias("n"), F.sum(F.when(~over, w)).alias("w")).first()
        if now["k"] == capped:
            break
        left, total, capped = share * sums["n"] - most * now["n"], now["w"], now["k"]
    level = F.lit(left) * w / F.lit(total) if total else F.lit(math.inf)
    return sources.withColumn("target", F.when(F.col("n") > 0, F.least(level, F.lit(float(most)) * F.col("n"))).otherwise(0.0))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Permutation:
    """Of 0 .. n-1: a Feistel network over the next even number of bits, walked until it falls below n."""

    ROUNDS = 4

    def __init__(self, n: int, key: int) -> None:
        self.n, self.half = n, max(1, (max(1, n - 1).bit_length() + 1) // 2)
        self.mask = np.uint64((1 << self.half) - 1)
        self.keys = [_mix(np.uint64([(key * self.ROUNDS + r + 1) & (2**63 - 1)]))[0] for r in range(self.ROUNDS)]

    def _once(self, x: np.ndarray, back: bool) -> np.ndarray:
        a, b = x >> np.uint64(self.half), x & self.mask
        for k in reversed(self.keys) if back else self.keys:
            if back:
                a, b = b ^ (_mix(a ^ k) & self.mask), a
            else:
                a, b = b, a ^ (_mix(b ^ k) & self.mask)
        return a << np.uint64(self.half) | b

    def __call__(self, i: np.ndarray, back: bool = False) -> np.ndarray:
        x = self._once(np.asarray(i, np.uint64), back)
        while (out := x >= np.uint64(self.n)).any():
            x[out] = self._once(x[out], back)
        return x.astype(np.int64)


@dataclass
class SourcePlan:
    """How one source fills its slots."""

    number: int
    words: int
    quota: int
    block_words: int
    seed: int

    @property
    def blocks(self) -> int:
        return -(-self.words // self.block_words)

    def permutation(self, turn: int) -> Permutation:
        return Permutation(self.blocks, (self.seed * 1_000_003 + self.number) * 64 + turn)

    def slots(self) -> tuple[int, int]:
        """Number of slots, and the words of the last one."""
        if not self.words or not self.quota:
            return 0, 0
        size, n = self.block_words, self.blocks
        short = self.words - (n - 1) * size
        turns, rest = divmod(self.quota, self.words)
        if not rest:
            return turns * n, size
        at = int(self.permutation(turns)(np.array([n - 1]), back=True)[0])  # when the short block comes
        held = lambda k: k * size - (size - short) * (at < k)
        k = -(-rest // size)
        k += held(k) < rest
        return turns * n + k, rest - held(k - 1)


def draw_counts(n: int, sizes: np.ndarray, *key: int) -> np.ndarray:
    """n slots dealt to places by a multinomial draw, a place's chance by its size; the key seeds the draw."""
    return np.random.Generator(np.random.PCG64(key)).multinomial(n, sizes / sizes.sum())


FACTS = "s long, words long, quota long, n_slots long, last_take long"


def _plans(block_words: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            quota = [int(t) for t in b["target"]]
            found = [SourcePlan(int(s), int(n), q, block_words, seed).slots() for s, n, q in zip(b["s"], b["n"], quota, strict=True)]
            yield pd.DataFrame({"s": b["s"], "words": b["n"], "quota": quota, "n_slots": [k for k, _ in found], "last_take": [x for _, x in found]})

    return run


def _draws(shards: int, seed: int):
    """Slots by source to slots by source and group of shards."""
    groups = -(-shards // SHARDS_AT_ONCE)
    sizes = np.minimum(SHARDS_AT_ONCE, shards - np.arange(groups) * SHARDS_AT_ONCE)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                c = draw_counts(r.n_slots, sizes, seed, r.s)
                at = np.flatnonzero(c)
                yield pd.DataFrame({**r._asdict(), "part": at, "first": (np.cumsum(c) - c)[at], "count": c[at]})

    return run


def _draws_within(shards: int, seed: int):
    """Slots by source and group of shards to slots by source and shard."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for r in b.itertuples(index=False):
                here = r.part * SHARDS_AT_ONCE
                c = draw_counts(r.count, np.ones(min(SHARDS_AT_ONCE, shards - here)), seed, r.s, r.part)
                at = np.flatnonzero(c)
                first = r.first + (np.cumsum(c) - c)[at]
                facts = {x: getattr(r, x) for x in ("s", "words", "quota", "n_slots", "last_take")}
                yield pd.DataFrame({**facts, "shard": here + at, "first": first, "last": first + c[at] - 1})

    return run


def _place(block_words: int, seed: int):
    """Slots to blocks, by the permutation of the source and pass."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for (s, words, quota), rows in b.groupby(["s", "words", "quota"]):
                p = SourcePlan(int(s), int(words), int(quota), block_words, seed)
                j = rows["j"].to_numpy()
                turn, block = j // p.blocks, np.zeros(len(j), np.int64)
                for t in np.unique(turn):
                    block[turn == t] = p.permutation(int(t))(j[turn == t] % p.blocks)
                take = np.where(j == rows["n_slots"] - 1, rows["last_take"], p.block_words)
                yield pd.DataFrame({"s": rows["s"], "block": block, "shard": rows["shard"], "turn": turn.astype("int32"), "take": take})

    return run


def draw_slots(plans: DataFrame, slots_per_shard: int, block_words: int, seed: int) -> DataFrame:
    """plans: FACTS, a row for each source. (s, block, shard, turn, take), a row for each slot."""
    total = plans.agg(F.sum("n_slots")).first()[0] or 0
    shards = max(1, -(-total // slots_per_shard))
    tasks = max(int(plans.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // SLOTS_PER_TASK))
    drawn = plans.where("n_slots > 0").mapInPandas(_draws(shards, seed), f"{FACTS}, part long, first long, count long")
    within = drawn.repartition(tasks, "s", "part").mapInPandas(_draws_within(shards, seed), f"{FACTS}, shard long, first long, last long")
    each = within.repartition(tasks, "s", "shard").select("s", "words", "quota", "n_slots", "last_take", "shard", F.explode(F.sequence("first", "last")).alias("j"))
    return each.mapInPandas(_place(block_words, seed), "s long, block long, shard long, turn int, take long")


@dataclass
class Mix:
    #: doc_id, the row key, size, s (source's number), start (first word in the source), source_size, target
    docs: DataFrame
    #: s, block, shard, turn, take (words of the block that the slot holds)
    slots: DataFrame
    #: documents' parts of blocks that slots hold: s, start, the row key, size, shard, turn, low, high (words within the document)
    parts: DataFrame


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST, block_words: int = BLOCK_WORDS, seed: int = SEED, slots_per_shard: int = SLOTS_PER_SHARD) -> Mix:
    """docs: from `with_row_key`."""
    source = F.col("source").cast("string")
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    name = [source.isNull().alias("none"), F.coalesce(source, F.lit("")).alias("name")]  # never null, so that rows join on it
    sized = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *ROW_KEY, *name, size.alias("size")))
    sources = numbered(sized.groupBy("none", "name").agg(F.sum("size").alias("n"), F.count("*").alias("docs")), "s", F.col("none"), F.col("name"))
    sources = cut(with_targets(cut(sources), weights, share, most))
    rows = sources.agg(F.sum("docs")).first()[0] or 0
    facts = sources.select("none", "name", "docs", "s", F.col("n").alias("source_size"), "target")
    named = join_counted(sized, facts, ["none", "name"], "docs", rows).drop("docs")

    # both levels of the order are about as large
    buckets = max(1, math.isqrt(rows))
    dealt = named.withColumn("_h", F.xxhash64(*ROW_KEY, F.lit(seed))).withColumn("_b", F.pmod("_h", F.lit(buckets)))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("size").over(before(Window.partitionBy("s", "_b").orderBy("_h", *ROW_KEY))), F.lit(0))
    ordered = cut(dealt.withColumn("_i", inside).drop("_h"))
    sums = ordered.groupBy("s", "_b").agg(F.sum("size").alias("_n"))
    offsets = cut(sums.select("s", "_b", F.coalesce(F.sum("_n").over(before(Window.partitionBy("s").orderBy("_b"))), F.lit(0)).alias("_o")))
    placed = cut(ordered.join(offsets, ["s", "_b"]).withColumn("start", F.col("_o") + F.col("_i")).drop("_b", "_i", "_o"))

    plans = cut(sources.mapInPandas(_plans(block_words, seed), FACTS))
    # its size is not known to the planner, which would take it for small; it grows with the mix, so it is never broadcast
    slots = draw_slots(plans, slots_per_shard, block_words, seed)
    covers = F.sequence(F.expr(f"start div {block_words}"), F.expr(f"(start + size - 1) div {block_words}"))
    pieces = placed.where("size > 0").select("s", "start", *ROW_KEY, "size", F.explode(covers).alias("block"))
    a = F.col("block") * block_words
    parts = (
        pieces.join(slots.hint("merge"), ["s", "block"])
        .withColumn("low", F.greatest(F.col("start"), a) - F.col("start"))
        .withColumn("high", F.least(F.col("start") + F.col("size"), a + F.col("take")) - F.col("start"))
        .where("high > low")
        .select("s", "start", *ROW_KEY, "size", "shard", "turn", "low", "high")
    )
    return Mix(placed, slots, parts)


def words_taken(m: Mix) -> DataFrame:
    """(doc_id, size, source_size, target, taken), a row for each row of documents."""
    taken = m.parts.groupBy("s", "start").agg(F.sum(F.col("high") - F.col("low")).alias("taken"))
    # a document with words is the only one at its place; one without takes none
    full = m.docs.where("size > 0").join(taken, ["s", "start"], "left")
    none = m.docs.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    return full.unionByName(none).select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"))


def _cut_texts(fact_name: str):
    return lambda batches: _cut(batches, fact_name)


def _cut(batches: Iterator[pa.RecordBatch], fact_name: str) -> Iterator[pa.RecordBatch]:
    word = re.compile(rb"[^\x20\x09-\x0D]+")
    for b in batches:
        texts = []
        for text, fact in zip(b.column("text").cast(pa.binary()), b.column(fact_name), strict=True):
            text, fact = text.as_py(), fact.as_py()
            ranges = sorted((r["low"], r["high"]) for r in fact["ranges"])
            if sum(z - a for a, z in ranges) == fact["size"]:
                texts.append(text.decode())
                continue
            spans = [m.span() for m in word.finditer(text)]
            runs: list[list[int]] = []
            for a, z in ranges:
                if runs and runs[-1][1] == a:
                    runs[-1][1] = z
                else:
                    runs.append([a, z])
            texts.append(b"\n".join(text[spans[a][0] : spans[z - 1][1]] for a, z in runs).decode())
        names = [n for n in b.schema.names if n != fact_name]
        columns = [pa.array(texts, pa.string()) if n == "text" else b.column(n) for n in names]
        yield pa.RecordBatch.from_arrays(columns, names)


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix as documents: one row for each pass in which words of a document are drawn, its text the drawn words
    (the whole text as it is if all are drawn), n_chars to match. Documents of which no word is drawn go."""
    keyed = with_row_key(docs)
    m = mix(keyed, **options)
    drawn = m.parts.groupBy(*ROW_KEY, "s", "start", "size", "turn").agg(F.collect_list(F.struct("low", "high")).alias("ranges"))
    facts = drawn.select(*ROW_KEY, F.struct("size", "turn", "ranges").alias("fact"))
    fact = fresh("fact", docs.columns)
    schema = StructType([StructField(f.name, StringType() if f.name == "text" else f.dataType) for f in docs.schema])
    out = attach(keyed, facts, fact).mapInArrow(_cut_texts(fact), schema)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out
