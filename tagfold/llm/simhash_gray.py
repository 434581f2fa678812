"""Operator 10: near duplicates by SimHash, searched in a Gray-ordered hierarchical index.

Fingerprints (one per text) are dealt by pigeonhole: with at most d differing bits, one of d + 1 blocks of bits is
intact, so two linked fingerprints meet in at least one bucket (block, value of the block). Beyond `WIDE` distinct
fingerprints, two intact blocks of d + 2 make the key, so that buckets stay small; both ways are exact. In each bucket
the fingerprints are sorted by Gray rank and form the leaves of a tree of fanout 8. A node holds the bits that all its
leaves share, less those that its parent already holds. A search adds up differences from the root down and drops a whole
group once they pass d; a group of which every member must be within d is linked as one. Only a spanning forest of each
bucket leaves the task: at most a row per member, however many pairs link.

Empty or null texts have fingerprint zero and link like others. Rows repeated as they are, or with equal texts, share a
fingerprint and so a component. Extra columns are ignored. A null doc_id is kept, and never is a component's name unless
the component has no other.

`keep_first` thins a corpus to one row of each group of copies: texts whose sets of five-word shingles have a Jaccard
similarity of 0.8 or more. Pairs within d bits come from the index above, all of them. Similar texts may lie further apart, at any
bits, as fingerprints weigh repeated shingles and sets do not, and there no intact block of 64 bits is left to deal by: for these,
buckets keyed by runs of minima of the shingles' hashes stand beside those of the index. Links settle in rounds. In the first ones
each text of a bucket of minima is held against one text of it, so a bucket of any size costs as many pairs as it has rows, and these
are few different ones, as large groups share theirs over all buckets. In the last one the tree searches all buckets that still hold
texts of different groups and gives all pairs still apart, within d bits in those of the index and at any bits in those of minima.
A near fingerprint alone never links texts. A bucket beyond AT_ONCE rows is cut into parts, and each two
parts are a task's work. An odd sketch of each set (Mitzenmacher, Pagh,
Pham 2014: a bit for each of 512 classes of hashes, set if an odd number of shingles falls in it) takes out most pairs
that are not similar: sets differ in at least as many shingles as their sketches do in bits, so a pair whose sketches differ in more bits
than a similar pair has shingles apart is not similar, and no similar pair is lost. The rest is settled on the whole
shingle sets.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagfold.llm.common import ROW_KEY, cut, one_of_each, with_row_key
from tagfold.llm.components import components, union
from tagfold.operators.skew import join_counted
from tagfold.shared import let_go

SHINGLE_WORDS, MAX_BITS, SEED = 4, 4, 42
FANOUT_BITS = 3
#: Distinct fingerprints beyond which two blocks key a bucket, and rows of a bucket beyond which it is dealt by more bits.
WIDE, FINER = 1 << 24, 1 << 20
#: Copies: words a shingle, least similarity as a fraction, and buckets of a text with the minima that key one (at a
#: similarity of 0.8 two texts miss each other in all buckets once in 8 million times).
COPY_WORDS, SIMILAR = 5, (4, 5)
BANDS, MINIMA = 40, 5
SKETCH_LONGS = 8
#: Rows of at most 40 bytes that are broadcast; more are joined by shuffling.
BROADCAST_ROWS = 200_000
#: Rows of a bucket that are compared in one task, and pairs that get the text of one of them in one task.
AT_ONCE = 8192
#: Links of texts of which one task finds the groups, some 16 bytes each; more settle in rounds of joins.
LINKS_AT_ONCE = 1 << 18
#: Rows of whole buckets that are searched together, and pairs that are compared at once.
ROWS_AT_ONCE, PAIRS_AT_ONCE = 1 << 14, 1 << 17
HASHES_AT_ONCE = 1 << 16


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()


def shingle_hashes(words: list[bytes], words_per_shingle: int) -> Iterator[np.ndarray]:
    """The hashes of all shingles, in runs."""
    import xxhash

    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    k = min(words_per_shingle, len(words))
    starts, ends = starts[: len(words) - k + 1], ends[k - 1 :]
    h = xxhash.xxh64_intdigest
    for a in range(0, len(starts), HASHES_AT_ONCE):
        z = slice(a, a + HASHES_AT_ONCE)
        yield np.array([h(joined[i:j], SEED) for i, j in zip(starts[z].tolist(), ends[z].tolist(), strict=True)], "<u8")


def majority(runs: Iterable[np.ndarray]) -> int:
    """Unsigned 64 bits; a bit is set if it is set in over half the hashes."""
    votes, n = np.zeros(64, np.int64), 0
    for hashes in runs:
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += np.add.reduce(bits, axis=0, dtype=np.uint32)
        n += len(hashes)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, words_per_shingle: int = SHINGLE_WORDS) -> int:
    return majority(shingle_hashes(_words(text), words_per_shingle))


def _fingerprint_batches(words_per_shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").cast(pa.binary())
            found = np.fromiter((fingerprint(t.as_py() or b"", words_per_shingle) for t in texts), np.uint64, len(texts))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(found.view(np.int64))], ["doc_id", "fp"])

    return run


def fingerprints(docs: DataFrame, words_per_shingle: int = SHINGLE_WORDS) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint's bits as a signed long."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_fingerprint_batches(words_per_shingle), "doc_id long, fp long")


def gray_rank(x: Column) -> Column:
    """Rank of the bits as a Gray code: neighbours in this order mostly differ in few bits."""
    for n in (1, 2, 4, 8, 16, 32):
        x = x.bitwiseXOR(F.shiftrightunsigned(x, n))
    return x


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def bucket_masks(max_bits: int, wide: bool) -> list[int]:
    """Masks of which at least one is intact between any two fingerprints that differ in at most `max_bits` bits."""
    blocks, intact = (max_bits + 2, 2) if wide else (max_bits + 1, 1)
    edges = [64 * k // blocks for k in range(blocks + 1)]
    part = [((1 << edges[k + 1]) - 1) ^ ((1 << edges[k]) - 1) for k in range(blocks)]
    return [sum(c) for c in combinations(part, intact)]


class GrayForest:
    """One tree for each bucket over leaves sorted by bucket and Gray rank."""

    def __init__(self, leaves: np.ndarray, bucket: np.ndarray) -> None:
        """bucket: numbers of buckets, from 0, in order."""
        n = len(leaves)
        first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        place = np.arange(n) - first[bucket]
        self.levels = []  # from the leaves up: (pattern, mask, first child, end of children)
        pattern, mask = leaves, np.full(n, ~np.uint64(0))
        low, high, b = leaves, leaves, bucket
        self.levels.append((pattern, mask, None, None))
        while len(b) > b[-1] + 1:
            place = place >> FANOUT_BITS
            start = np.flatnonzero(np.r_[True, (b[1:] != b[:-1]) | (place[1:] != place[:-1])])
            end = np.r_[start[1:], len(b)]
            low, high = np.bitwise_and.reduceat(low, start), np.bitwise_or.reduceat(high, start)
            self.levels.append((low, ~(low ^ high), start, end))
            b, place = b[start], place[start]
        # bits that the parent holds are taken out of its children
        self.residual = [self.levels[-1][1]]
        for level in range(len(self.levels) - 2, -1, -1):
            _, up, start, end = self.levels[level + 1]
            self.residual.insert(0, self.levels[level][1] & ~np.repeat(up, end - start))
        self.first_leaf = [np.arange(n)]
        for _, _, start, _ in self.levels[1:]:
            self.first_leaf.append(self.first_leaf[-1][start])
        self.bucket = bucket

    def search(self, queries: np.ndarray, q: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Links (query, leaf) of queries (numbers of leaves) with leaves after them; of a group that is wholly within
        reach, its first leaf alone (its members are linked by `solid`)."""
        who, node, seen = queries, self.bucket[queries], np.zeros(len(queries), np.int64)
        found_q, found_leaf = [], []
        for level in range(len(self.levels) - 1, -1, -1):
            pattern, mask, start, end = self.levels[level]
            seen = seen + np.bitwise_count((q[who] ^ pattern[node]) & self.residual[level][node])
            keep = seen <= max_bits
            if level:
                last = np.r_[self.first_leaf[level][1:], len(self.first_leaf[0])][node] - 1
                keep &= last > who
            who, node, seen = who[keep], node[keep], seen[keep]
            if level == 0:
                keep = node > who
                found_q.append(who[keep])
                found_leaf.append(node[keep])
                break
            whole = (seen + np.bitwise_count(~mask[node]) <= max_bits) & (self.first_leaf[level][node] > who)
            found_q.append(who[whole])
            found_leaf.append(self.first_leaf[level][node[whole]])
            who, node, seen = who[~whole], node[~whole], seen[~whole]
            n = end[node] - start[node]
            at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            who, seen, node = np.repeat(who, n), np.repeat(seen, n), np.repeat(start[node], n) + at
        return np.concatenate(found_q), np.concatenate(found_leaf)

    def pairs(self, queries: np.ndarray, q: np.ndarray, max_bits: int, label: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All (query, leaf after it) within reach whose labels differ; groups of the query's own label alone are passed
        over whole."""
        who, node, seen = queries, self.bucket[queries], np.zeros(len(queries), np.int64)
        low, high = [label], [label]
        for _, _, start, _ in self.levels[1:]:
            low.append(np.minimum.reduceat(low[-1], start))
            high.append(np.maximum.reduceat(high[-1], start))
        for level in range(len(self.levels) - 1, -1, -1):
            pattern, _, start, end = self.levels[level]
            last = np.r_[self.first_leaf[level][1:], len(label)] - 1
            seen = seen + np.bitwise_count((q[who] ^ pattern[node]) & self.residual[level][node])
            keep = (seen <= max_bits) & (last[node] > who) & ((low[level][node] != label[who]) | (high[level][node] != label[who]))
            who, node, seen = who[keep], node[keep], seen[keep]
            if level:
                n = end[node] - start[node]
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                who, seen, node = np.repeat(who, n), np.repeat(seen, n), np.repeat(start[node], n) + at
        return who, node

    def solid(self, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
        """Links of each leaf to the first of the group above it, where any two members of the group are within reach."""
        out = [(np.zeros(0, np.int64),) * 2]
        for level in range(1, len(self.levels)):
            _, mask, start, end = self.levels[level]
            lone = np.bitwise_count(~mask) <= max_bits
            n = (end - start)[lone]
            children = np.repeat(start[lone], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            out.append((self.first_leaf[level - 1][children], np.repeat(self.first_leaf[level][lone], n)))
        return np.concatenate([x for x, _ in out]), np.concatenate([x for _, x in out])


def _portions(bucket: np.ndarray) -> Iterator[np.ndarray]:
    """All rows in runs that are compared with about PAIRS_AT_ONCE others, or of one row."""
    cost = np.cumsum(np.bincount(bucket)[bucket])
    at = 0
    while at < len(bucket):
        until = max(at + 1, int(np.searchsorted(cost, (cost[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
        yield np.arange(at, until)
        at = until


def forest_links(fps: np.ndarray, bucket: np.ndarray, max_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a spanning forest of all links within the buckets; rows sorted by bucket and Gray rank."""
    if len(fps) < 2:
        return fps[:0], fps[:0]
    tree = GrayForest(fps, bucket)
    label = union(np.arange(len(fps)), *tree.solid(max_bits))
    for rows in _portions(bucket):
        label = union(label, *tree.search(rows, fps, max_bits))
    child = np.flatnonzero(label != np.arange(len(fps)))
    return fps[child], fps[label[child]]


def _whole_buckets(batches: Iterator[pa.RecordBatch], key: list[str], values: list[str]) -> Iterator[tuple[np.ndarray, list[np.ndarray]]]:
    """Runs of whole buckets, by rows that come sorted by key: the buckets' numbers from 0, and the columns of values."""
    held: list[list[np.ndarray]] = []
    n = 0

    def run(columns: list[np.ndarray], new: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        return np.cumsum(np.r_[False, new]), columns[len(key) :]

    def merged() -> tuple[list[np.ndarray], np.ndarray]:
        columns = [np.concatenate(c) for c in zip(*held, strict=True)]
        return columns, np.any([c[1:] != c[:-1] for c in columns[: len(key)]], axis=0)

    for batch in batches:
        if batch.num_rows:
            held.append([np.asarray(batch.column(c)) for c in (*key, *values)])
            n += batch.num_rows
        if n < ROWS_AT_ONCE:
            continue
        columns, new = merged()
        changes = np.flatnonzero(new)
        if len(changes):  # the last bucket may go on
            end = int(changes[-1]) + 1
            yield run([c[:end] for c in columns], new[: end - 1])
            columns = [c[end:] for c in columns]
        held, n = [columns], len(columns[0])
    if n:
        yield run(*merged())


def _search_batches(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, (fp,) in _whole_buckets(batches, ["t", "key"], ["fp"]):
            a, b = forest_links(fp.view(np.uint64), bucket, max_bits)
            yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    return run


def finer_masks(mask: int, max_bits: int) -> list[int]:
    """The mask with one of max_bits + 1 parts of the other bits each: of two fingerprints that agree in the mask and differ
    in at most `max_bits` bits, one of these is intact too."""
    free = [k for k in range(64) if not mask >> k & 1]
    n = max_bits + 1
    return [mask | sum(1 << k for k in free[len(free) * i // n : len(free) * (i + 1) // n]) for i in range(n)]


def _keyed(rows: DataFrame, masks: list[int], first: int) -> DataFrame:
    """(t, key, fp): t counts the masks from `first`."""
    keys = F.explode(F.array(*(F.struct(F.lit(first + k).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks))))
    return rows.select("fp", keys.alias("k")).select("k.t", "k.key", "fp")


def similar_links(classes: DataFrame, max_bits: int = MAX_BITS, wide_from: int = WIDE, finer_from: int = FINER) -> DataFrame:
    """classes: distinct `fp`. (a, b): edges that join all fingerprints linked at `max_bits` or fewer. Beyond `wide_from` of
    them all buckets are by two blocks; a bucket of more than `finer_from` is dealt anew by a part of its other bits."""
    masks = bucket_masks(max_bits, classes.count() > wide_from)
    spread = _keyed(classes, masks, 0)
    # there are few values of a block, so counts are few; of the full buckets at most masks / finer_from of all rows
    full = [(r["t"], r["key"]) for r in spread.groupBy("t", "key").count().where(F.col("count") > finer_from).select("t", "key").collect()]
    if full:
        held = F.broadcast(spread.sparkSession.createDataFrame(full, "t int, key long"))
        rest = spread.join(held, ["t", "key"], "left_anti")
        for t in sorted({t for t, _ in full}):
            rows = spread.where(F.col("t") == t).join(held, ["t", "key"], "left_semi")
            rest = rest.unionByName(_keyed(rows, finer_masks(masks[t], max_bits), len(masks) + t * (max_bits + 1)))
        spread = rest
    dealt = spread.repartition("t", "key").withColumn("gray", gray_rank(F.col("fp"))).sortWithinPartitions("t", "key", "gray")
    return dealt.select("t", "key", "fp").mapInArrow(_search_batches(max_bits), "a long, b long")


def label_fingerprints(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, n, root, first_doc): each distinct fingerprint, its rows, the one its component is named by, its own smallest
    doc_id."""
    classes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("n")))
    roots = components(similar_links(classes.select("fp"), max_bits))
    named = classes.join(roots, classes["fp"] == roots["node"], "left")
    return cut(named.select("fp", "n", F.coalesce("root", "fp").alias("root"), "first_doc"))


def near_duplicates(docs: DataFrame, words_per_shingle: int = SHINGLE_WORDS, max_bits: int = MAX_BITS) -> DataFrame:
    """(doc_id, fp, component_id): component_id is the smallest doc_id that links reach."""
    fps = cut(fingerprints(docs, words_per_shingle))
    named = label_fingerprints(fps, max_bits)
    least = cut(named.groupBy("root").agg(F.min("first_doc").alias("component_id"), F.count("*").alias("k")))
    sizes = named.agg(F.count("*").alias("k"), F.sum("n").alias("n")).first()
    labels = cut(join_counted(named.select("fp", "n", "root"), least, ["root"], "k", sizes["k"]).select("fp", "n", "component_id"))
    return join_counted(fps, labels, ["fp"], "n", sizes["n"] or 0).select("doc_id", "fp", "component_id")


def hex16(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _multipliers() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 63, BANDS * MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def odd_sketch(hashes: np.ndarray) -> np.ndarray:
    """hashes: distinct. Bits, as longs, of which no more differ between two sets than there are hashes in one set alone."""
    width = 64 * SKETCH_LONGS
    odd = np.bincount((hashes % np.uint64(width)).astype(np.int64), minlength=width) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import xxhash

    factors = _multipliers()
    mix, band = factors[:MINIMA], np.arange(BANDS, dtype=np.uint64)
    for b in batches:
        class1, class2, fp, n = (np.zeros(b.num_rows, np.int64) for _ in range(4))
        keys: list[np.ndarray | None] = []
        odd = np.zeros((b.num_rows, SKETCH_LONGS), np.int64)
        for row, t in enumerate(b.column("text").cast(pa.binary())):
            words = _words(t.as_py() or b"")
            name = xxhash.xxh128_intdigest(b" ".join(words), SEED)
            class1[row], class2[row] = _signed(name >> 64), _signed(name & (1 << 64) - 1)
            runs = list(shingle_hashes(words, COPY_WORDS))
            fp[row] = _signed(majority(runs))
            if not runs:
                keys.append(None)
                continue
            hashes = np.unique(np.concatenate(runs))
            n[row] = len(hashes)
            odd[row] = odd_sketch(hashes)
            least = np.full(len(factors), ~np.uint64(0))
            for a in range(0, len(hashes), 2048):
                np.minimum(least, (hashes[a : a + 2048] * factors[:, None]).min(axis=1), out=least)
            x = ((least.reshape(BANDS, MINIMA) >> np.uint64(7)) * mix).sum(axis=1) + band
            keys.append(((x ^ x >> np.uint64(31)) * factors[-1]).view(np.int64))
        arrays = [pa.array(class1), pa.array(class2), pa.array(fp), pa.array(n), pa.array(keys, pa.list_(pa.int64())), pa.array(list(odd), pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", *ROW_KEY)), *arrays], ["doc_id", *ROW_KEY, "c", "c2", "fp", "n", "keys", "odd"])


def sketches(keyed: DataFrame) -> DataFrame:
    """keyed: from `with_row_key`. For each row, two hashes of its words that together name its text, its fingerprint, its
    number of distinct shingles, the keys of its buckets (null without words) and its odd sketch."""
    slim = keyed.select(F.col("doc_id").cast("long").alias("doc_id"), *ROW_KEY, F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_sketch_batches, "doc_id long, _row long, _row2 long, c long, c2 long, fp long, n long, keys array<long>, odd array<long>")


SKETCH = [f"s{k}" for k in range(SKETCH_LONGS)]


def _fitting(tree: GrayForest, fp: np.ndarray, max_bits: int, n: np.ndarray, sketch: list[np.ndarray], label: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of pairs of different labels, within reach, that may be similar by sizes and sketches."""
    up, down = SIMILAR
    for rows in _portions(tree.bucket):
        a, b = tree.pairs(rows, fp, max_bits, label)
        fit = down * np.minimum(n[a], n[b]) >= up * np.maximum(n[a], n[b])
        a, b = a[fit], b[fit]
        far = np.zeros(len(a), np.int64)
        for s in sketch:
            far += np.bitwise_count((s[a] ^ s[b]).view(np.uint64))
        fit = (up + down) * far <= (down - up) * (n[a] + n[b])
        yield a[fit], b[fit]


def _apart_batches(max_bits: int):
    """Rows of pairs of parts of buckets: pairs within reach of different groups, of a row of each part, that may be similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, (root, fp, c, n, part, both, *sketch) in _whole_buckets(batches, ["key", "x", "y"], ["root", "fp", "c", "n", "part", "both", *SKETCH]):
            fp = fp.view(np.uint64)
            for a, b in _fitting(GrayForest(fp, bucket), fp, max_bits, n, sketch, root):
                across = (part[a] != part[b]) | ~both[a]
                yield pa.RecordBatch.from_arrays([pa.array(c[a][across]), pa.array(c[b][across])], ["a", "b"])

    return run


def _similar_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    up, down = SIMILAR

    def shingles(text: pa.Scalar) -> np.ndarray:
        return np.unique(np.concatenate(list(shingle_hashes(_words(text.as_py()), COPY_WORDS))))

    last, t = None, None
    for batch in batches:
        yes = []
        for b, x, y in zip(batch.column("b").to_pylist(), batch.column("x").cast(pa.binary()), batch.column("y").cast(pa.binary()), strict=True):
            if b != last:  # pairs come sorted by b
                last, t = b, shingles(y)
            s = shingles(x)
            both = len(np.intersect1d(s, t, assume_unique=True))
            yes.append(down * both >= up * (len(s) + len(t) - both))
        yield batch.select(["a", "b"]).filter(pa.array(yes, pa.bool_()))


def texts_of_pairs(pairs: DataFrame, keyed: DataFrame, classes: DataFrame) -> DataFrame:
    """(c, text) of the texts that some pair names; only these are shuffled."""
    named = pairs.select(F.col("a").alias("c")).union(pairs.select("b")).distinct()
    need = cut(classes.join(named, "c", "left_semi").select("c", F.col("best._row").alias("_row"), F.col("best._row2").alias("_row2")))
    small = need.count() <= BROADCAST_ROWS
    rows = keyed.select(*ROW_KEY, F.col("text").cast("string").alias("text")).join(F.broadcast(need) if small else need, ROW_KEY)
    return cut(rows.select("c", "text").dropDuplicates(["c"]))


def _with_facts(pairs: DataFrame, side: str, facts: DataFrame) -> DataFrame:
    """pairs, cut, with `k_`side, the pairs that a text is in on this side, and its facts (`c` and others) with the side as suffix."""
    counts = pairs.groupBy(F.col(side).alias("c")).agg(F.count("*").alias("k"))
    named = cut(counts.join(facts, "c")).select(F.col("c").alias(side), *(F.col(x).alias(f"{x}_{side}") for x in ("k", *facts.columns) if x != "c"))
    return join_counted(pairs, named, [side], f"k_{side}", pairs.count())


def _with_text(pairs: DataFrame, side: str, texts: DataFrame) -> DataFrame:
    """pairs with `k_`side: adds `text_`side. A text that is in many pairs is repeated, so that no task joins more than about
    AT_ONCE pairs with it."""
    other = "b" if side == "a" else "a"
    copies = lambda k: F.ceil(k / AT_ONCE).cast("int")
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64(other), copies(F.col(f"k_{side}"))).cast("int"))
    times = cut(pairs.groupBy(F.col(side).alias("c")).agg(F.max(f"k_{side}").alias("k")))
    spread = texts.join(times, "c").select(F.col("c").alias(side), F.col("text").alias(f"text_{side}"), F.explode(F.sequence(F.lit(0), copies(F.col("k")) - 1)).alias("part"))
    return dealt.join(spread, [side, "part"]).drop("part")


def similar_pairs(pairs: DataFrame, keyed: DataFrame, classes: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) of texts whose shingle sets are similar: by sizes, by sketches, and by the whole sets of the
    rest."""
    up, down = SIMILAR
    sets = classes.select("c", "n", "odd")
    known = _with_facts(cut(_with_facts(pairs, "a", sets)), "b", sets)
    far = sum((F.bit_count(F.col("odd_a")[k].bitwiseXOR(F.col("odd_b")[k])) for k in range(SKETCH_LONGS)), F.lit(0))
    fits = (down * F.least("n_a", "n_b") >= up * F.greatest("n_a", "n_b")) & ((up + down) * far <= (down - up) * (F.col("n_a") + F.col("n_b")))
    left = cut(known.where(fits).select("a", "b", "k_a", "k_b"))
    if left.isEmpty():
        return left.select("a", "b")
    texts = texts_of_pairs(left, keyed, classes)
    both = _with_text(cut(_with_text(left, "a", texts)), "b", texts).sortWithinPartitions("b")
    return both.select("a", "b", F.col("text_a").alias("x"), F.col("text_b").alias("y")).mapInArrow(_similar_batches, "a long, b long")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _unsettled(rows: DataFrame, pick, n: int) -> tuple[DataFrame, int]:
    """rows: key, c, root; n of them. Those of buckets with several roots, with m, the rows of the bucket, and the text of it
    that `pick` names and its root; and how many are left."""
    row = F.struct("c", "root")
    facts = cut(rows.groupBy("key").agg(F.count("*").alias("m"), F.min("root").alias("low"), F.max("root").alias("high"), pick(row).alias("pivot")).where("low < high").select("key", "m", "pivot"))
    if facts.count() <= BROADCAST_ROWS:
        left = rows.join(F.broadcast(facts), "key")
    else:
        left = join_counted(rows, facts, ["key"], "m", n)
    left = cut(left)
    return left, left.count()


def _in_parts(rows: DataFrame, classes: DataFrame) -> DataFrame:
    """rows: key, c, root, m. Each bucket for each two of its parts of about AT_ONCE rows, sorted for `_apart_batches`."""
    sketch = (F.col("odd")[k].alias(x) for k, x in enumerate(SKETCH))
    known = rows.join(classes.select("c", "fp", "n", *sketch), "c")
    parts = F.ceil(F.col("m") / AT_ONCE).cast("int")
    met = known.withColumn("part", F.pmod(F.xxhash64("c"), parts).cast("int")).withColumn("z", F.explode(F.sequence(F.lit(0), parts - 1)))
    two = [F.least("part", "z").alias("x"), F.greatest("part", "z").alias("y")]
    dealt = met.select("key", *two, "root", "fp", "c", "n", "part", *SKETCH).withColumn("both", F.col("x") != F.col("y"))
    gray = gray_rank(F.col("fp")).alias("gray")
    return dealt.repartition("key", "x", "y").select("*", gray).sortWithinPartitions("key", "x", "y", "gray", "c").drop("gray")


def _by_blocks(texts: DataFrame, masks: list[int]) -> DataFrame:
    """texts: c, fp, root. (key, c, root): their buckets in the index."""
    keys = F.array(*(F.xxhash64(F.lit(t), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for t, m in enumerate(masks)))
    return texts.select(F.explode(keys).alias("key"), "c", "root")


def copy_groups(keyed: DataFrame) -> DataFrame:
    """keyed: from `with_row_key`. (c, root, best): each distinct text, its group and its row with the smallest doc_id.
    Texts within MAX_BITS, and texts of a bucket of minima, link if they are similar. Texts are named by 64 bits in links and by 128 elsewhere."""
    best = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", *ROW_KEY)).alias("best")
    classes = cut(sketches(keyed).groupBy("c", "c2").agg(best, *(F.first(x).alias(x) for x in ("fp", "n", "keys", "odd"))))
    names, many = classes.select("c", "best"), classes.count()
    n, masks = many * BANDS, bucket_masks(MAX_BITS, many > WIDE)
    rows = classes.select(F.explode("keys").alias("key"), "c").withColumn("root", F.col("c"))
    roots, tried = None, None

    def settle(pairs: DataFrame) -> DataFrame:
        nonlocal tried
        new = _ordered(pairs)
        new = cut(new if tried is None else new.join(tried, ["a", "b"], "left_anti"))
        if roots is not None and new.isEmpty():
            return roots
        tried = new if tried is None else tried.unionByName(new)
        found = similar_pairs(new, keyed, classes)
        links = found if roots is None else found.unionByName(roots.select(F.col("node").alias("a"), F.col("root").alias("b")))
        groups = components(links, LINKS_AT_ONCE)
        let_go(keyed.sparkSession)
        return groups

    def named(rows: DataFrame) -> DataFrame:
        return cut(rows.join(roots, rows["c"] == roots["node"], "left").withColumn("root", F.coalesce(roots["root"], "c")).drop("node"))

    for pick in (F.min, F.max):
        rows, n = _unsettled(rows, pick, n)
        roots = settle(rows.where("root <> pivot.root").select(F.col("c").alias("a"), F.col("pivot.c").alias("b")))
        rows = named(rows.select("key", "c"))
    indexed = _by_blocks(named(classes.where("n > 0").select("c", "fp")), masks)
    apart = []
    for some, n_some, max_bits in ((indexed, many * len(masks), MAX_BITS), (rows, n, 64)):
        left, _ = _unsettled(some, F.min, n_some)
        apart.append(_in_parts(left.drop("pivot"), classes).mapInArrow(_apart_batches(max_bits), "a long, b long"))
    roots = settle(apart[0].unionByName(apart[1]))
    return names.join(roots, names["c"] == roots["node"], "left").select("c", F.coalesce("root", "c").alias("root"), "best")


def keep_first(docs: DataFrame) -> DataFrame:
    """Rows of docs, one of each group of copies: that of its smallest doc_id and, where rows repeat that doc_id, the least
    by a hash of the row. A group without any doc_id keeps one row too; texts without words are copies of each other."""
    keyed = with_row_key(docs)
    first = copy_groups(keyed).groupBy("root").agg(F.min("best").alias("best"))
    kept = cut(first.select("best._row", "best._row2"))
    # rows equal in every column are one document
    return one_of_each(keyed.join(kept, ROW_KEY, "left_semi")).drop(*ROW_KEY)
