"""FASTQ and FASTA as a Spark source, split by byte ranges, and writers of both.

    spark.dataSource.register(FastqSource)
    spark.read.format("fastq").load(path)

A range owns the records that start in it and reads past its end to finish the last. A chunk of bytes becomes one Arrow
batch without a Python object for a line: newlines are found by numpy, and strings are taken from the chunk by offsets.
`pos` is the record's start byte in the concatenation of all files, in order of their names, so it names a record among
several files too. `total_q` is the sum of the record's Phred qualities. A file whose first byte is `>` is read as FASTA:
records of one line or more of sequence, with empty qualities.

Files are opened through pyarrow's file systems, so any store that pyarrow knows works; a plain path is local (or a
shared mount).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tagfold.functions.scalars import fasta_lines, fastq_lines
from tagfold.schemas import FILE_READS

SPLIT_BYTES = 64 << 20
CHUNK_BYTES, LOOK_BYTES = 4 << 20, 64 << 10
NEWLINE, RETURN, AT, PLUS, MORE = b"\n\r@+>"
SCHEMA = pa.schema([("id", pa.string()), ("seq", pa.string()), ("qual", pa.string()), ("pos", pa.int64()), ("rec_len", pa.int64()), ("total_q", pa.int64())])


class FastqError(ValueError):
    pass


def open_store(path: str):
    """pyarrow's file system of a path, and the path inside it."""
    from pyarrow import fs

    if "://" in path:
        return fs.FileSystem.from_uri(path)
    import os

    return fs.LocalFileSystem(), os.path.abspath(path.removeprefix("file:"))


def list_files(path: str) -> list[tuple[str, int]]:
    """The file, or all files below the folder by name, with their sizes; names that begin with `_` or `.` are left out."""
    from pyarrow import fs

    store, inner = open_store(path)
    info = store.get_file_info(inner)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.is_file:
        return [(path, info.size)]
    base = path.split("://")[0] + "://" if "://" in path else ""
    found = store.get_file_info(fs.FileSelector(inner, recursive=True))
    return sorted((base + x.path, x.size) for x in found if x.is_file and not x.base_name.startswith(("_", ".")))


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int
    #: bytes of all files before this one
    base: int


def _first_lines(handle, at: int, n: int) -> list[tuple[int, int]]:
    """(start, first byte or -1) of the first n lines that start after byte `at`."""
    handle.seek(at)
    held, want = b"", LOOK_BYTES
    while True:
        more = handle.read(want)
        held += more
        breaks = np.flatnonzero(np.frombuffer(held, np.uint8) == NEWLINE)
        if len(breaks) > n or not more:
            return [(at + int(b) + 1, held[b + 1]) for b in breaks[:n] if b + 1 < len(held)]
        want *= 2


def first_record(handle, start: int, fasta: bool) -> int | None:
    """Start of the first record at or after `start`, if any: in FASTA a line that begins with `>`; in FASTQ a line that
    begins with `@` and whose second next begins with `+`. Two lines below a quality line that begins with `@` is a
    sequence, which cannot begin with `+`."""
    if start == 0:
        return 0
    if fasta:
        at, n = start - 1, 64
        while lines := _first_lines(handle, at, n):
            for where, first in lines:
                if first == MORE:
                    return where
            at, n = lines[-1][0], n * 2
        return None
    lines = _first_lines(handle, start - 1, 7)
    for k in range(max(0, len(lines) - 2)):
        if lines[k][1] == AT and lines[k + 2][1] == PLUS:
            return lines[k][0]
    # the rest of a record that starts before, and blank lines at the end
    if sum(first not in (NEWLINE, RETURN) for _, first in lines) <= 3:
        return None
    raise FastqError(f"no record of four lines near byte {start}")


def _strings(data: bytes, bounds: np.ndarray) -> pa.Array:
    """bounds: (rows, 2). The bytes between the bounds of each row."""
    flat = np.ascontiguousarray(bounds.reshape(-1), np.int64)
    cells = pa.Array.from_buffers(pa.large_binary(), len(flat) - 1, [None, pa.py_buffer(flat), pa.py_buffer(data)])
    return cells.take(pa.array(np.arange(0, len(flat), 2))).cast(pa.binary())


def _text(cells: pa.Array, path: str) -> pa.Array:
    try:
        return cells.cast(pa.string())
    except pa.ArrowInvalid as e:
        raise FastqError(f"{path}: {e}") from None


def _quality_sums(cells: pa.Array) -> np.ndarray:
    at = np.frombuffer(cells.buffers()[1], np.int32)[: len(cells) + 1].astype(np.int64)
    sums = np.zeros(at[-1] + 1, np.int64)
    np.cumsum(np.frombuffer(cells.buffers()[2] or b"", np.uint8)[: at[-1]], out=sums[1:])
    return sums[at[1:]] - sums[at[:-1]] - 33 * np.diff(at)


def _line_ends(bytes_: np.ndarray, starts: np.ndarray, breaks: np.ndarray) -> np.ndarray:
    """Ends of lines without a return before the newline."""
    return breaks - ((breaks > starts) & (bytes_[breaks - 1] == RETURN))


def _fastq_batch(data: bytes, breaks: np.ndarray, at: int, base: int, path: str) -> pa.RecordBatch:
    """breaks: where the lines of whole records end."""
    bytes_ = np.frombuffer(data, np.uint8)
    starts = np.r_[0, breaks[:-1] + 1]
    ends = _line_ends(bytes_, starts, breaks)
    head, plus = starts[0::4], starts[2::4]
    wrong = (ends[0::4] == head) | (bytes_[head] != AT) | (ends[2::4] == plus) | (bytes_[np.minimum(plus, len(data) - 1)] != PLUS)
    if wrong.any():
        raise FastqError(f"{path}: invalid record at byte {at + int(head[wrong.argmax()])}")
    uneven = ends[1::4] - starts[1::4] != ends[3::4] - starts[3::4]
    if uneven.any():
        raise FastqError(f"{path}: sequence and quality differ in length at byte {at + int(head[uneven.argmax()])}")
    ids = _strings(data, np.stack([head + 1, ends[0::4]], axis=1))
    seq = _strings(data, np.stack([starts[1::4], ends[1::4]], axis=1))
    qual = _strings(data, np.stack([starts[3::4], ends[3::4]], axis=1))
    columns = [_text(ids, path), _text(seq, path), _text(qual, path), pa.array(base + at + head), pa.array(breaks[3::4] + 1 - head), pa.array(_quality_sums(qual))]
    return pa.RecordBatch.from_arrays(columns, schema=SCHEMA)


def _fasta_batch(data: bytes, breaks: np.ndarray, heads: np.ndarray, at: int, base: int, path: str) -> pa.RecordBatch:
    """heads: numbers of the lines that begin records, the first of them 0."""
    bytes_ = np.frombuffer(data, np.uint8)
    starts = np.r_[0, breaks[:-1] + 1]
    ends = _line_ends(bytes_, starts, breaks)
    last = np.r_[heads[1:], len(breaks)] - 1
    ids = _strings(data, np.stack([starts[heads] + 1, ends[heads]], axis=1))
    inside = np.zeros(len(breaks), bool)
    inside[heads] = True
    # bytes of sequence lines, without line ends, and how many each record has
    d = np.zeros(len(data) + 2, np.int8)
    d[starts[~inside]] += 1
    d[ends[~inside]] -= 1
    size = np.add.reduceat(np.where(inside, 0, ends - starts), heads)
    bounds = np.r_[0, np.cumsum(size)].astype(np.int32)
    letters = bytes_[np.cumsum(d[: len(data)], dtype=np.int8) > 0].tobytes()
    seq = pa.Array.from_buffers(pa.binary(), len(heads), [None, pa.py_buffer(bounds), pa.py_buffer(letters)])
    none = pa.array([""] * len(heads))
    columns = [_text(ids, path), _text(seq, path), none, pa.array(base + at + starts[heads]), pa.array(breaks[last] + 1 - starts[heads]), pa.array(np.zeros(len(heads), np.int64))]
    return pa.RecordBatch.from_arrays(columns, schema=SCHEMA)


def read_range(path: str, start: int, end: int, base: int = 0) -> Iterator[pa.RecordBatch]:
    """The records that start in the range, a batch for each chunk of bytes."""
    store, inner = open_store(path)
    with store.open_input_file(inner) as handle:
        fasta = handle.read(1) == b">"
        at = first_record(handle, start, fasta)
        if at is None:
            return
        handle.seek(at)
        data, want, ended = b"", CHUNK_BYTES, False
        while not ended and at < end:
            more = handle.read(want)
            ended = len(more) < want
            data = data + more if data else more
            bytes_ = np.frombuffer(data, np.uint8)
            breaks = np.flatnonzero(bytes_ == NEWLINE)
            if ended:
                # the last line end may be missing, also that of an empty quality line
                whole = len(data) == 0 or data[-1] == NEWLINE
                blank = lambda b: not data[b + 1 :].strip(b"\r\n")
                if not whole or (not fasta and len(breaks) % 4 == 3 and not blank(breaks[-4] if len(breaks) > 3 else -1)):
                    breaks = np.r_[breaks, len(data)]
            if fasta:
                starts = np.r_[0, breaks[:-1] + 1] if len(breaks) else breaks
                heads = np.flatnonzero((starts < len(data)) & (bytes_[np.minimum(starts, max(0, len(data) - 1))] == MORE))
                if not ended:  # the last record may go on
                    breaks, heads = breaks[: heads[-1] if len(heads) else 0], heads[:-1]
                lines = len(breaks)
                keep = np.flatnonzero(at + starts[heads] >= end)
                if len(keep):
                    breaks, heads = breaks[: heads[keep[0]]], heads[: keep[0]]
                if len(heads):
                    yield _fasta_batch(data, breaks, heads, at, base, path)
                elif ended and len(data) and data.strip() and not len(keep):
                    raise FastqError(f"{path}: invalid record at byte {at}")
                if len(keep):
                    return
            else:
                lines = len(breaks) // 4 * 4
                rest = data[int(breaks[lines - 1]) + 1 if lines else 0 :]
                if ended and rest.strip(b"\r\n"):
                    raise FastqError(f"{path}: invalid record at byte {at + len(data) - len(rest)}")
                breaks = breaks[:lines]
                # blank lines may end a file, so they wait for what follows
                while lines >= 4 and not data[int(breaks[lines - 5]) + 1 if lines > 4 else 0 :].strip(b"\r\n"):
                    lines -= 4
                    breaks = breaks[:lines]
                if lines:
                    heads = np.r_[0, breaks[3:-1:4] + 1]
                    n = int(np.searchsorted(at + heads, end))
                    if n:
                        yield _fastq_batch(data, breaks[: 4 * n], at, base, path)
                    if n < len(heads):
                        return
            done = int(breaks[lines - 1]) + 1 if lines else 0
            data, at = data[done:], at + done
            want = CHUNK_BYTES if lines else want * 2


class FastqReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options["path"]
        self.split = int(options.get("splitBytes", SPLIT_BYTES))

    def partitions(self) -> list[ByteRange]:
        ranges, base = [], 0
        for path, size in list_files(self.path):
            ranges += [ByteRange(path, a, min(a + self.split, size), base) for a in range(0, size, self.split)]
            base += size
        return ranges or [ByteRange("", 0, 0, 0)]

    def read(self, partition: ByteRange) -> Iterator[pa.RecordBatch]:
        if partition.end > partition.start:
            yield from read_range(partition.path, partition.start, partition.end, partition.base)


class FastqSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fastq"

    def schema(self):
        return FILE_READS

    def reader(self, schema) -> FastqReader:
        return FastqReader(self.options)


def read_fastq(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """A FASTQ or FASTA file, or a folder of them: id, seq, qual, pos, rec_len, total_q."""
    spark.dataSource.register(FastqSource)
    return spark.read.format("fastq").option("splitBytes", str(split_bytes)).load(path)


def write_fastq(rows: DataFrame, path: str, order: tuple[str, ...] = ("ug", "i")) -> None:
    """Text files, range-sorted, so that their concatenation by name is in order; one record a row."""
    rows.orderBy(*order).select(fastq_lines(F.col("id"), F.col("seq"), F.col("qual")).alias("value")).write.text(path)


def write_fasta(rows: DataFrame, path: str, order: tuple[str, ...] = ("ug", "i")) -> None:
    rows.orderBy(*order).select(fasta_lines(F.col("id"), F.col("seq")).alias("value")).write.text(path)
