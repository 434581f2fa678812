"""Operator 4: nearest neighbours by inner product over additively quantised vectors.

A vector is its norm times a direction; the direction is the sum of one word from each of BOOKS codebooks of full
dimension, each trained by k-means on what the ones before left over. Encoding keeps the BEAM best partial sums from book
to book, by products looked up in tables. Queries are scored against codes by a table of their products with all words,
times the stored norm; the SHORTLIST best of each batch of rows are scored again on the original vectors in double precision.

Books are trained on at most TRAIN_ROWS rows, the first by a hash of vec_id; every row is encoded, once, into a table. Queries
are broadcast in turns of QUERIES_AT_A_TURN; in each turn tasks read the encoded rows where they lie, batch by batch, and keep
the best rows of each query so far. No vector is shuffled, and a query costs k rows of a few numbers a task, however many turns
there are. The best of all tasks are merged by a window.

Vectors that are null, empty, zero, or hold null or non-finite parts take no part. An inner product needs equal lengths, so a
query meets the vectors of its own length, each length with its own books. Every row is a row of its own: of rows that repeat
a vec_id each is a query (if it qualifies) and a candidate for the others. Equal scores go by vec_id, then by the
row's number. Null vec_ids take no part. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagfold.llm.common import cut

BOOKS, WORDS, BEAM, ROUNDS = 24, 64, 4, 8
TRAIN_ROWS, SEED = 16_384, 7
QUERIES_AT_A_TURN, SHORTLIST, QUERIES_AT_ONCE = 4096, 384, 256


def train(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = ROUNDS, seed: int = SEED) -> np.ndarray:
    """x: unit vectors. (books, words, dimension); a book with fewer rows than words repeats some."""
    rng = np.random.default_rng(seed)
    left, out = x.copy(), []
    for _ in range(books):
        c = left[rng.choice(len(left), words, replace=len(left) < words)].copy()
        for _ in range(rounds):
            own = (left @ c.T * 2 - (c * c).sum(1)).argmax(1)
            n = np.bincount(own, minlength=words)
            total = np.zeros_like(c)
            np.add.at(total, own, left)
            c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        own = (left @ c.T * 2 - (c * c).sum(1)).argmax(1)
        left = left - c[own]
        out.append(c)
    return np.stack(out)


def encode(x: np.ndarray, books: np.ndarray, beam: int = BEAM) -> np.ndarray:
    """x: unit vectors. (rows, books) numbers of words, by beam search on the squared error of the sum."""
    m, k, d = books.shape
    flat = books.reshape(m * k, d)
    cross = (flat @ flat.T).reshape(m, k, m, k)
    with_x = (x @ flat.T).reshape(len(x), m, k)
    rows = np.arange(len(x))[:, None]
    codes = np.zeros((len(x), 1, 0), np.int64)
    error = np.zeros((len(x), 1))
    for j in range(m):
        # ||x - s - c||^2 = ||x - s||^2 + ||c||^2 - 2 x.c + 2 s.c
        own = np.diagonal(cross[j, :, j, :]) - 2 * with_x[:, j]
        e = error[:, :, None] + own[:, None, :]
        for i in range(j):
            e += 2 * cross[i, :, j, :][codes[:, :, i]]
        flat_e = e.reshape(len(x), -1)
        b = min(beam, flat_e.shape[1])
        best = np.argpartition(flat_e, b - 1, axis=1)[:, :b]
        error = flat_e[rows, best]
        codes = np.concatenate([codes[rows, best // k], (best % k)[:, :, None]], axis=2)
    return codes[np.arange(len(x)), error.argmin(1)].astype(np.uint8 if k <= 256 else np.uint16)


def take_best(scores: np.ndarray, n: int) -> np.ndarray:
    """Places of the n greatest of each row; of equal ones the first places."""
    if scores.shape[1] <= n:
        return np.broadcast_to(np.arange(scores.shape[1]), scores.shape)
    edge = -np.partition(-scores, n - 1, axis=1)[:, n - 1 : n]
    above, equal = scores > edge, scores == edge
    room = n - above.sum(1, keepdims=True)
    take = above | (equal & (np.cumsum(equal, axis=1) <= room))
    return np.nonzero(take)[1].reshape(len(scores), n)


def _search(k: int, books_value, queries_value):
    """Encoded rows to the k best of a task for each query of a turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, (own, q_id, q) = books_value.value, queries_value.value
        m, _, d = books.shape
        # only a query's own order counts, so its scale is taken out
        tables = np.einsum("qd,mkd->mqk", q / np.abs(q).max(1, keepdims=True), books).astype(np.float32)
        best = np.full((len(q), k), -np.inf)
        best_id, best_row = np.zeros((len(q), k), np.int64), np.zeros((len(q), k), np.int64)
        for b in batches:
            if not b.num_rows:
                continue
            row, ids, norm = (np.asarray(b.column(c)) for c in ("row", "vec_id", "norm"))
            x = np.frombuffer(b"".join(b.column("v").to_pylist()), "<f8").reshape(-1, d)
            codes = np.frombuffer(b"".join(b.column("codes").to_pylist()), np.uint8).reshape(-1, m)
            order = np.lexsort((row, ids))  # equal scores go by place
            row, ids, norm, x, codes = row[order], ids[order], norm[order], x[order], codes[order]
            for a in range(0, len(q), QUERIES_AT_ONCE):
                z = slice(a, a + QUERIES_AT_ONCE)
                score = np.zeros((len(own[z]), len(row)), np.float32)
                for j in range(m):
                    score += tables[j, z][:, codes[:, j]]
                score = score * norm
                score[own[z, None] == row] = -np.inf
                short = take_best(score, SHORTLIST)
                exact = np.einsum("qd,qrd->qr", q[z], x[short])
                exact[row[short] == own[z, None]] = -np.inf
                all_ = [np.concatenate([old[z], new], axis=1) for old, new in ((best, exact), (best_id, ids[short]), (best_row, row[short]))]
                pick = np.lexsort((all_[2], all_[1], -all_[0]), axis=1)[:, :k]
                best[z], best_id[z], best_row[z] = (np.take_along_axis(c, pick, axis=1) for c in all_)
        who, at = np.nonzero(best > -np.inf)
        for a in range(0, len(who), 1 << 16):
            w, i = who[a : a + (1 << 16)], at[a : a + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in (own[w], q_id[w], best_id[w, i], best_row[w, i], best[w, i])], ["query_row", "query_id", "vec_id", "row", "score"])

    return run


def usable(v: Column) -> Column:
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def _encoder(books_value):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books = books_value.value
        for b in batches:
            if not b.num_rows:
                continue
            v = b.column("v")
            x = np.asarray(v.flatten(), np.float64).reshape(b.num_rows, -1)
            big = np.abs(x).max(1)
            norm = np.linalg.norm(x / big[:, None], axis=1) * big
            parts = [encode(x[a : a + 2048] / norm[a : a + 2048, None], books) for a in range(0, len(x), 2048)]
            codes = np.concatenate(parts)
            blobs = [pa.array([r.tobytes() for r in y], pa.binary()) for y in (x, codes)]
            yield pa.RecordBatch.from_arrays([b.column("vec_id"), *blobs, pa.array(norm)], ["vec_id", "v", "codes", "norm"])

    return run


def _turns(asked: DataFrame, n: int) -> Iterator[list]:
    """Queries in turns, each collected by itself."""
    turns = -(-n // QUERIES_AT_A_TURN)
    for t in range(turns):
        rows = asked.where(F.pmod(F.xxhash64("row"), F.lit(turns)) == t).collect()
        if rows:
            yield rows


def _nearest_of_length(rows: DataFrame, d: int, n: int, queries_where: str, k: int) -> DataFrame | None:
    """rows: vec_id, v, n of them, all of length d."""
    spark = rows.sparkSession
    asked = rows.where(queries_where).count()
    if not asked or n < 2:
        return None
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id", "v").limit(TRAIN_ROWS).select("v").toArrow()
    x = np.asarray(sample.column("v").combine_chunks().flatten(), np.float64).reshape(-1, d)
    x = x / np.abs(x).max(1, keepdims=True)
    books = spark.sparkContext.broadcast(train(x / np.linalg.norm(x, axis=1, keepdims=True)))  # BOOKS * WORDS vectors
    encoded = rows.mapInArrow(_encoder(books), "vec_id long, v binary, codes binary, norm double")
    # a row's number is stored with it
    encoded = cut(encoded.withColumn("row", F.monotonically_increasing_id()))
    found = []
    for turn in _turns(encoded.where(queries_where).select("row", "vec_id", "v"), asked):
        turn.sort(key=lambda r: r["row"])
        value = (np.array([r["row"] for r in turn]), np.array([r["vec_id"] for r in turn]), np.frombuffer(b"".join(r["v"] for r in turn), "<f8").reshape(-1, d))
        held = spark.sparkContext.broadcast(value)  # QUERIES_AT_A_TURN vectors or about so many
        found.append(encoded.mapInArrow(_search(k, books, held), "query_row long, query_id long, vec_id long, row long, score double"))
    best = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(best))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def nearest(vectors: DataFrame, queries_where: str, k: int) -> DataFrame:
    """vectors: vec_id, embedding. (query_id, rank, vec_id, score) of the k nearest rows to each row that meets
    `queries_where`."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    good = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    lengths = good.groupBy(F.size("v").alias("d")).count().orderBy("d").collect()
    found = [_nearest_of_length(good.where(F.size("v") == r["d"]), r["d"], r["count"], queries_where, k) for r in lengths]
    found = [f for f in found if f is not None]
    if not found:
        return vectors.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    return reduce(DataFrame.unionByName, found)
