"""Operator 2: document quality from a linear-chain conditional random field over lines.

Every line of a text is a node with two labels, bad and good. Its features are shares of character classes, word
repetition and copies of the line within the document, for the line itself and for the lines before and after. The field
is trained by gradient ascent on documents whose lines all bear the document's label; the marginals that
forward-backward gives each line, weighted by the line's length, add up to the document's score.

Training takes at most TRAIN_PER_CLASS labelled documents of each class, the first by a hash of doc_id, from the rows
the caller lets it learn from, and of these as many as have TRAIN_LINES lines together (a document that would pass that bound
is left out, the next may fit); the classes are weighted back to their shares. Everything else runs over whole texts. Only
line features of that sample and its labels reach the driver, and only weights go back. Of several rows of a labelled
doc_id the one with the least hash of its text trains.

An empty or null text is one empty line. Without any labelled row, or with one class alone, the field has zero weights
or that class's share as its prior. Repeated rows score alike; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tagfold.llm.common import cut, fresh

TRAIN_PER_CLASS, TRAIN_LINES = 3000, 120_000
STEPS, RATE, L2 = 250, 0.08, 1e-3
#: Text bytes whose features are computed at once, unless a single text is longer.
CHUNK_BYTES = 1 << 18

UPPER, LOWER, DIGIT, STOP, SYMBOL, HIGH = range(1, 7)
SPACES = b" \t\n\r\x0b\x0c"


def _classes() -> np.ndarray:
    table = np.full(256, SYMBOL, np.uint8)
    table[ord("A") : ord("Z") + 1] = UPPER
    table[ord("a") : ord("z") + 1] = LOWER
    table[ord("0") : ord("9") + 1] = DIGIT
    table[[ord(c) for c in ".,"]] = STOP
    table[128:] = HIGH
    table[list(SPACES)] = 0
    return table


CLASS = _classes()
MIX = np.uint64(0x9E3779B97F4A7C15)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2 ** 64."""
    r = 0xD1342543DE82EF95
    up, down = np.full(n, r, np.uint64), np.full(n, pow(r, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


BASE_NAMES = ("length", "upper", "digit", "stop", "symbol", "high", "word_length", "repeat", "distinct", "twin_symbol", "copies")
N_FEATURES = len(BASE_NAMES) * 2 * 3 + 1


class LineFeatures:
    """Features of the lines of a run of texts, by array operations on their bytes."""

    def __init__(self) -> None:
        self.powers = _powers(1 << 10)

    def _spans_hash(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        if len(data) + 1 > len(self.powers[0]):
            self.powers = _powers(2 * len(data) + 2)
        up, down = self.powers
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=total[1:])
        h = (total[ends] - total[starts]) * down[starts]
        return h ^ (h >> np.uint64(29))

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """data: bytes of all texts; offsets: where each begins, and the end. Returns features by line, the lines'
        weights, and where each text's lines begin (with the end)."""
        n_docs = len(offsets) - 1
        breaks = np.flatnonzero(data == 10)
        doc_of_break = np.searchsorted(offsets[1:], breaks, "right")
        starts = np.concatenate([offsets[:-1], breaks + 1])
        doc = np.concatenate([np.arange(n_docs), doc_of_break])
        order = np.lexsort((starts, doc))
        starts, doc = starts[order], doc[order]
        last = np.r_[doc[1:] != doc[:-1], True]
        ends = np.where(last, offsets[doc + 1], np.r_[starts[1:] - 1, 0])
        n = len(starts)
        size = (ends - starts).astype(np.float64)
        kind = CLASS[data]

        def count(flags: np.ndarray) -> np.ndarray:
            total = np.zeros(len(flags) + 1, np.int64)
            np.cumsum(flags, out=total[1:])
            return (total[ends] - total[starts]).astype(np.float64)

        shares = {k: count(kind == k) for k in range(1, 7)}
        solid = np.maximum(sum(shares.values()), 1.0)
        symbol = kind == SYMBOL
        twin = np.zeros(len(data), bool)
        twin[1:] = symbol[1:] & (data[1:] == data[:-1])
        text = kind > 0
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True
        w_start = np.flatnonzero(text & np.r_[True, ~text[:-1] | edge[1 : len(data)]][: len(data)]) if len(data) else np.zeros(0, np.int64)
        w_end = np.flatnonzero(text & np.r_[~text[1:] | edge[1 : len(data)], True][: len(data)]) + 1 if len(data) else np.zeros(0, np.int64)
        line = np.searchsorted(starts, w_start, "right") - 1
        # lines that are empty share their start with none of the words: the last of equal starts holds the word
        h = self._spans_hash(data, w_start, w_end)
        words = np.bincount(line, minlength=n).astype(np.float64)
        some = np.maximum(words, 1.0)
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (line[1:] == line[:-1])
        repeat = np.bincount(line[again], minlength=n) / some
        key = (h + np.uint64(1)) * MIX ^ (line.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        # of equal words in a line one counts; lines with few words are all distinct by nature, hence the log
        _, at = np.unique(key, return_index=True)
        distinct = np.log1p(words) - np.log1p(np.bincount(line[at], minlength=n))
        line_hash = self._spans_hash(data, starts, ends) * MIX ^ (doc.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))
        _, back, copies = np.unique(line_hash, return_inverse=True, return_counts=True)
        base = np.stack([
            np.log1p(size) / 8.0, shares[UPPER] / solid, shares[DIGIT] / solid, shares[STOP] / solid, shares[SYMBOL] / solid,
            shares[HIGH] / solid, np.log1p(solid / some) / 3.0, repeat, distinct, count(twin) / solid, np.log(copies[back]) * (size > 0),
        ], axis=1)
        both = np.concatenate([base, np.sqrt(np.maximum(base, 0.0))], axis=1)
        first = np.r_[True, doc[1:] != doc[:-1]]
        before, after = np.zeros_like(both), np.zeros_like(both)
        before[1:] = both[:-1]
        before[first] = both[first]
        after[:-1] = both[1:]
        after[last] = both[last]
        features = np.concatenate([both, before, after, np.ones((n, 1))], axis=1)
        return features, size + 1.0, np.r_[np.flatnonzero(first), n]


def _chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows with their bytes; no run holds more than CHUNK_BYTES unless it is one row."""
    lists = texts.cast(pa.large_binary())
    if lists.null_count:
        lists = lists.fill_null(b"")
    buffers = lists.buffers()
    at = np.frombuffer(buffers[1], np.int64)[lists.offset : lists.offset + len(lists) + 1]
    data = np.frombuffer(buffers[2] or b"", np.uint8)
    a = 0
    while a < len(lists):
        b = max(a + 1, int(np.searchsorted(at, at[a] + CHUNK_BYTES, "right")) - 1)
        b = min(b, len(lists))
        yield a, b, data[at[a] : at[b]], at[a : b + 1] - at[a]
        a = b


class Field:
    """weights: log-odds of good by feature. pair: scores of (label before, label)."""

    def __init__(self, weights: np.ndarray, pair: np.ndarray, center: np.ndarray, scale: np.ndarray) -> None:
        self.weights, self.pair, self.center, self.scale = weights, pair, center, scale

    def log_odds(self, features: np.ndarray) -> np.ndarray:
        return ((features - self.center) / self.scale) @ self.weights


def _steps(first: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For t = 0, 1, ..: the chains that have a line t, longest chains first; chains come sorted so."""
    n = np.diff(first)
    order = np.argsort(-n, kind="stable")
    alive, t = len(n), 0
    sorted_n = n[order]
    while alive:
        alive = int(np.searchsorted(-sorted_n, -t, "left")) if t else len(n)
        if not alive:
            return
        yield t, order[:alive]
        t += 1


def marginals(odds: np.ndarray, first: np.ndarray, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """P(good) by line, expected pair counts by chain step (lines, 2, 2; zero on first lines), log Z by chain."""
    n = len(odds)
    node = np.stack([np.zeros(n), odds], axis=1)
    fore, back = np.zeros((n, 2)), np.zeros((n, 2))
    rows = [first[:-1][chains] + t for t, chains in _steps(first)]
    fore[rows[0]] = node[rows[0]]
    for r in rows[1:]:
        x = fore[r - 1][:, :, None] + pair
        fore[r] = np.logaddexp(x[:, 0], x[:, 1]) + node[r]
    for r in rows[:0:-1]:
        x = pair + (node[r] + back[r])[:, None, :]
        back[r - 1] = np.logaddexp(x[:, :, 0], x[:, :, 1])
    last = first[1:] - 1
    z = np.logaddexp(fore[last, 0], fore[last, 1])
    zl = np.repeat(z, np.diff(first))
    good = np.exp(np.minimum(fore[:, 1] + back[:, 1] - zl, 0.0))
    joint = np.zeros((n, 2, 2))
    later = np.ones(n, bool)
    later[first[:-1]] = False
    k = np.flatnonzero(later)
    joint[k] = np.exp(np.minimum(fore[k - 1][:, :, None] + pair + (node[k] + back[k])[:, None, :] - zl[k][:, None, None], 0.0))
    return good, joint, z


def train(features: np.ndarray, first: np.ndarray, label: np.ndarray, weight: np.ndarray) -> Field:
    """label, weight: by document (chain)."""
    if not len(label):
        return Field(np.zeros(N_FEATURES), np.zeros((2, 2)), np.zeros(N_FEATURES), np.ones(N_FEATURES))
    center, scale = features.mean(0), features.std(0)
    center[-1], scale[-1] = 0.0, 1.0
    scale[scale < 1e-9] = 1.0
    x = (features - center) / scale
    n = np.diff(first)
    y, w = np.repeat(label, n).astype(float), np.repeat(weight / n, n)  # a long document weighs as much as a short one
    later = np.ones(len(y), bool)
    later[first[:-1]] = False
    seen = np.zeros((2, 2))
    for s in (0, 1):
        seen[s, s] = w[later & (y == s)].sum()
    total = weight.sum()
    theta, pair = np.zeros(x.shape[1]), np.zeros((2, 2))
    m = [np.zeros_like(theta), np.zeros_like(pair)]
    v = [np.zeros_like(theta), np.zeros_like(pair)]
    for step in range(1, STEPS + 1):
        good, joint, _ = marginals(x @ theta, first, pair)
        grads = [x.T @ (w * (y - good)) / total - L2 * theta, (seen - (w[:, None, None] * joint).sum(0)) / total - 0.05 * pair]
        for k, (p, g) in enumerate(zip((theta, pair), grads, strict=True)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            p += RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return Field(theta, pair, center, scale)


def _features_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    make = LineFeatures()
    for b in batches:
        for a, z, data, offsets in _chunks(b.column("text")):
            f, _, first = make(data, offsets)
            blobs = [f[i:j].astype("<f4").tobytes() for i, j in zip(first[:-1], first[1:], strict=True)]
            known = [b.column(x).slice(a, z - a) for x in ("doc_id", "good", "hash")]
            yield pa.RecordBatch.from_arrays([*known, pa.array(np.diff(first)), pa.array(blobs, pa.binary())], ["doc_id", "good", "hash", "n", "lines"])


def within_lines(rows: list, lines: int) -> list:
    """rows: (doc_id, n) in order. Those that fit into so many lines together, taken in turn."""
    taken = []
    for r in rows:
        if r["n"] <= lines:
            lines -= r["n"]
            taken.append(r)
    return taken


def fit(docs: DataFrame, labels: DataFrame, may_learn: Column | None = None, per_class: int = TRAIN_PER_CLASS, lines: int = TRAIN_LINES) -> Field:
    """labels: doc_id, quality. may_learn: a condition on doc_id."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("good")).where("doc_id is not null and good in (0, 1)")
    if may_learn is not None:
        known = known.where(may_learn)
    known = known.groupBy("doc_id").agg(F.max("good").alias("good"))
    counts = {r["good"]: r["count"] for r in known.groupBy("good").count().collect()}
    picked = None
    for g in sorted(counts):
        part = known.where(F.col("good") == g).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    if picked is None:
        return train(np.zeros((0, N_FEATURES)), np.zeros(1, np.int64), np.zeros(0), np.zeros(0))
    # at most 2 * per_class rows of two numbers are broadcast
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id").withColumn("hash", F.xxhash64("text"))
    held = cut(texts.mapInArrow(_features_batches, "doc_id long, good int, hash long, n long, lines binary"))
    sizes = held.groupBy("doc_id", "good").agg(F.min(F.struct("hash", "n")).alias("one")).select("doc_id", "good", "one.*", F.xxhash64("doc_id").alias("order")).collect()
    sizes.sort(key=lambda r: (r["order"], r["doc_id"]))
    chosen = [r for g in (0, 1) for r in within_lines([r for r in sizes if r["good"] == g], lines // 2)]
    names = docs.sparkSession.createDataFrame([(r["doc_id"], r["hash"]) for r in chosen], "doc_id long, hash long")
    rows = held.join(F.broadcast(names), ["doc_id", "hash"]).groupBy("doc_id", "good").agg(F.min("lines").alias("lines")).collect()
    rows.sort(key=lambda r: r["doc_id"])
    parts = [np.frombuffer(r["lines"], "<f4").reshape(-1, N_FEATURES) for r in rows]
    label = np.array([r["good"] for r in rows])
    taken = {g: max(1, int((label == g).sum())) for g in (0, 1)}
    weight = np.array([counts.get(g, 0) / taken[g] for g in label], float)
    first = np.r_[0, np.cumsum([len(p) for p in parts])].astype(np.int64)
    features = np.concatenate(parts).astype(float) if parts else np.zeros((0, N_FEATURES))
    return train(features, first, label, weight)


def _score_batches(field: Field, text: str, score: str, drop: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make = LineFeatures()
        for b in batches:
            scores = np.zeros(b.num_rows)
            for a, z, data, offsets in _chunks(b.column(text)):
                f, weight, first = make(data, offsets)
                good, _, _ = marginals(field.log_odds(f), first, field.pair)
                scores[a:z] = np.add.reduceat(good * weight, first[:-1]) / np.add.reduceat(weight, first[:-1])
            names = [x for x in b.schema.names if not drop or x != text]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), pa.array(np.clip(scores, 0.0, 1.0))], [*names, score])

    return run


def score(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, score), a row for each row of docs."""
    slim = docs.select("doc_id", F.col("text").cast("string").alias("_text"))
    return slim.mapInArrow(_score_batches(field, "_text", "score", True), f"doc_id {dict(slim.dtypes)['doc_id']}, score double")


def keep_good(docs: DataFrame, field: Field, threshold: float = 0.5) -> DataFrame:
    """Rows of docs, with all their columns, whose score reaches the threshold."""
    score = fresh("score", docs.columns)
    plain = isinstance(docs.schema["text"].dataType, StringType)  # else a copy as a string goes along
    text = "text" if plain else fresh("_text", docs.columns)
    with_text = docs if plain else docs.withColumn(text, F.col("text").cast("string"))
    schema = StructType([*docs.schema.fields, StructField(score, DoubleType())])
    return with_text.mapInArrow(_score_batches(field, text, score, not plain), schema).where(F.col(score) >= threshold).drop(score)


def may_learn(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 != 1
