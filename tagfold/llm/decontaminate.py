"""Operator 6: documents that hold a benchmark passage, up to an edit budget.

Texts and items are lower-cased, runs of white space become one space. An item of m characters may be hit with k =
floor(m * EDIT_SHARE) edits. It is split into k + 1 pieces; by the pigeonhole principle any substring of a text within
k edits of the item holds one piece unchanged. One Aho-Corasick automaton of all pieces runs over each whole text, and
around every piece hit Myers' bit-parallel distance (1999) settles whether the item is there. Hits that fall in a window
already verified for the item are not verified again.

Items go to workers in parts of about PART_BYTES (an automaton takes some 53 times the bytes of its items, as measured), each
broadcast; a larger benchmark takes a pass over the texts for each part, so any size is searched whole. Items of fewer than MIN_CHARS normalised characters, which would hit by chance, must be
there without an edit and as whole words. Null and empty items are left out; items without an id count, and all of them are
one item with a null id in the result. Null texts hit nothing. A document and item
give one row, however often the document row is repeated; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from tagfold.llm.common import cut, fresh, in_order

EDIT_SHARE = 0.05
MIN_CHARS = 20
PART_BYTES = 8 << 20


def normalise(text: str | None) -> str:
    return " ".join((text or "").lower().split())


def budget(item: str, share: float = EDIT_SHARE) -> int:
    return int(len(item) * share)


def pieces(item: str, errors: int) -> list[tuple[int, str]]:
    """errors + 1 pieces that cover the item, of near equal length, with their places."""
    n = errors + 1
    edges = [len(item) * k // n for k in range(n + 1)]
    return [(edges[k], item[edges[k] : edges[k + 1]]) for k in range(n)]


def myers(pattern: str, text: str) -> tuple[int, int]:
    """Least edit distance of the pattern to any substring of the text, and the end of the first such substring."""
    m = len(pattern)
    if not m:
        return 0, 0
    peq: dict[str, int] = {}
    for i, c in enumerate(pattern):
        peq[c] = peq.get(c, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    pv, mv, score = full, 0, m
    best, at = m, 0
    for j, c in enumerate(text):
        eq = peq.get(c, 0)
        xv = eq | mv
        xh = (((eq & pv) + pv) ^ pv) | eq
        ph = mv | (full & ~(xh | pv))
        mh = pv & xh
        if ph & top:
            score += 1
        elif mh & top:
            score -= 1
        ph = ph << 1 & full
        mh = mh << 1 & full
        pv = mh | (full & ~(xv | ph))
        mv = ph & xv
        if score < best:
            best, at = score, j + 1
    return best, at


def whole_words(text: str, a: int, b: int) -> bool:
    """Whether no word goes on over either end of text[a:b]."""
    return not (a and text[a - 1].isalnum() and text[a].isalnum()) and not (b < len(text) and text[b - 1].isalnum() and text[b].isalnum())


class Passages:
    def __init__(self, items: list[tuple[int | None, str]], share: float = EDIT_SHARE) -> None:
        import ahocorasick

        self.items = [(i, t) for i, t in items if t]
        self.errors = [budget(t, share) if len(t) >= MIN_CHARS else 0 for _, t in self.items]
        owners: dict[str, list[tuple[int, int]]] = {}
        for k, (_, t) in enumerate(self.items):
            for place, piece in pieces(t, self.errors[k]):
                owners.setdefault(piece, []).append((k, place))
        self.automaton = ahocorasick.Automaton()
        for piece, at in owners.items():
            self.automaton.add_word(piece, (len(piece), at))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def hits(self, text: str) -> dict[int, int]:
        """Item number -> least distance found, for items within their budget."""
        found: dict[int, int] = {}
        if self.empty:
            return found
        done: dict[int, tuple[int, int]] = {}
        for end, (n, owners) in self.automaton.iter(text):
            for k, place in owners:
                if found.get(k) == 0:
                    continue
                item, e = self.items[k][1], self.errors[k]
                start = end + 1 - n - place
                if len(item) < MIN_CHARS:  # its one piece is the item
                    if whole_words(text, start, end + 1):
                        found[k] = 0
                    continue
                a, b = max(0, start - e), start + len(item) + e
                if (a, b) == done.get(k):
                    continue
                done[k] = (a, b)
                window = text[a:b]
                if item in window:
                    found[k] = 0
                    continue
                d, _ = myers(item, window)
                if d <= e:
                    found[k] = min(d, found.get(k, d))
        return found


def hold_items(benchmark: DataFrame, part_bytes: int = PART_BYTES) -> Iterator:
    """The items, normalised and sorted, in parts of about `part_bytes`, each as a broadcast value. At least one part."""
    items = cut(benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct())
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    parts = max(1, -(-size // part_bytes))
    for k in range(parts):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == k).collect()
        yield benchmark.sparkSession.sparkContext.broadcast(sorted(((r[0], normalise(r[1])) for r in part), key=lambda x: (x[0] is None, x[0] or 0, x[1])))


def _searcher(held, edit_share: float):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = Passages(held.value, edit_share)
        for b in batches:
            rows = [
                (doc, passages.items[k][0], d)
                for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True)
                for k, d in sorted(passages.hits(normalise(text.as_py())).items())
            ]
            columns = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["doc_id", "item_id", "distance"])

    return search


def contaminated(docs: DataFrame, benchmark: DataFrame, edit_share: float = EDIT_SHARE, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, item_id, distance): every document and item whose passage it holds within the budget."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = [slim.mapInArrow(_searcher(held, edit_share), "doc_id long, item_id long, distance long") for held in hold_items(benchmark, part_bytes)]
    return reduce(DataFrame.unionByName, found).groupBy("doc_id", "item_id").agg(F.min("distance").alias("distance"))


def _cleaner(held, edit_share: float, text: str, copied: bool):
    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passages = Passages(held.value, edit_share)
        for b in batches:
            good = [not passages.hits(normalise(t.as_py())) for t in b.column(text)]
            yield (b.drop_columns([text]) if copied else b).filter(pa.array(good, pa.bool_()))

    return clean


def keep_clean(docs: DataFrame, benchmark: DataFrame, edit_share: float = EDIT_SHARE, part_bytes: int = PART_BYTES) -> DataFrame:
    """Rows of docs whose text holds no item, settled row by row without a join. Rows between passes are written to the
    shared folder, so that a worker holds one automaton."""
    plain = isinstance(docs.schema["text"].dataType, StringType)  # else a copy as a string goes along
    text = "text" if plain else fresh("_text", docs.columns)
    kept, last = docs, None
    for held in hold_items(benchmark, part_bytes):
        kept = kept if last is None else in_order(kept)
        last = held
        source = kept if plain else kept.withColumn(text, F.col("text").cast("string"))
        kept = source.mapInArrow(_cleaner(held, edit_share, text, not plain), docs.schema)
    return kept
