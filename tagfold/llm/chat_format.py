"""Operator 1: conversations as one training text each, with a loss mask over the assistant's words.

A turn is prefix, body, suffix. Control strings that occur inside a text or a role get a backslash after their first
character, and those that already have backslashes there get one more, so that unescaping by one gives the text back.
Bodies, prefixes and suffixes are copied by numpy: from the segments' lengths come their offsets in the run's output, and the
bytes of each kind of segment are scattered to these places in one allocated Arrow buffer. The mask is kept as spans of bytes of the formatted text.

Turns stand in the order of turn, role, text (nulls first); rows repeated as they are stay. A null text or role is empty.
A null conv_id is a conversation. A conversation's text is one value, so it must fit a row; runs of turns are bounded
otherwise. Extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The template. Roles that are not listed take OTHER with their name in it.
TEMPLATE = {"user": ("<s>[INST] ", " [/INST]"), "assistant": ("<s>[ANSWER] ", "</s>")}
OTHER = ("<s>[ROLE]", "[/ROLE] ", "</s>")
CONTROL = r"/?s>|/?INST\]|/?ROLE\]|ANSWER\]"
ESCAPE = rf"([<\[])(\\*)({CONTROL})"
UNESCAPE = re.compile(rf"([<\[])\\(\\*)({CONTROL})")
ANY_TURN = re.compile(r"<s>(?:\[(INST|ANSWER)\] |\[ROLE\](.*?)\[/ROLE\] )", re.S)
TURN_END = re.compile(r" \[/INST\]|</s>")

#: Bytes of text formatted at once, unless one conversation is longer.
RUN_BYTES = 4 << 20


def escape(texts: pa.Array) -> pa.Array:
    return pc.replace_substring_regex(texts, ESCAPE, r"\1\\\2\3")


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1\2\3", text)


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    a = texts.cast(pa.large_binary())
    at = np.frombuffer(a.buffers()[1], np.int64)[a.offset : a.offset + len(a) + 1]
    return np.frombuffer(a.buffers()[2] or b"", np.uint8), at[:-1], np.diff(at)


def _scatter(out: np.ndarray, to: np.ndarray, length: np.ndarray, data: np.ndarray) -> None:
    """Copies segments that lie one after another in data to their places in out."""
    from_ = np.cumsum(length) - length
    out[np.arange(int(length.sum())) + np.repeat(to - from_, length)] = data


def assemble(conv: np.ndarray, roles: pa.Array, texts: pa.Array) -> tuple[pa.Array, list[np.ndarray], list[np.ndarray]]:
    """conv: number of the conversation of each turn, from 0, in order. Formatted texts, and the loss spans of each."""
    n = len(conv)
    fixed = [x.encode() for pair in TEMPLATE.values() for x in pair] + [b"", OTHER[2].encode()]
    prefix, suffix = np.full(n, len(TEMPLATE) * 2), np.full(n, len(TEMPLATE) * 2 + 1)
    for k, role in enumerate(TEMPLATE):
        own = np.asarray(pc.equal(roles, role))
        prefix[own], suffix[own] = 2 * k, 2 * k + 1
    other = prefix == len(TEMPLATE) * 2
    names = pc.if_else(pa.array(other), pc.binary_join_element_wise(OTHER[0], escape(roles), OTHER[1], ""), "")
    name_data, name_at, name_n = _buffers(names)
    body_data, body_at, body_n = _buffers(escape(texts))
    fixed_n = np.array([len(x) for x in fixed])
    # segments of a turn: prefix or role name, body, suffix
    length = np.stack([np.where(other, name_n, fixed_n[prefix]), body_n, fixed_n[suffix]], 1).ravel()
    to = np.concatenate([[0], np.cumsum(length)])
    total = int(to[-1])
    buffer = pa.allocate_buffer(total)
    out = np.frombuffer(buffer, np.uint8)
    for at, number in ((to[:-1:3], prefix), (to[2:-1:3], suffix)):
        for k, x in enumerate(fixed):
            if x:
                out[at[number == k][:, None] + np.arange(len(x))] = np.frombuffer(x, np.uint8)
    for at, size, data, first_byte in ((to[:-1:3], name_n, name_data, name_at), (to[1:-1:3], body_n, body_data, body_at)):
        if n:
            _scatter(out, at, size, data[first_byte[0] : first_byte[0] + int(size.sum())])
    first = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
    edges = np.concatenate([to[3 * first], [total]]).astype(np.int64)
    formatted = pa.Array.from_buffers(pa.large_string(), len(first), [None, pa.py_buffer(edges.tobytes()), buffer])
    masked = np.asarray(pc.equal(roles, "assistant"))
    a, z = to[1::3][masked], to[2::3][masked]
    owner = conv[masked] - conv[0]
    split = np.searchsorted(owner, np.arange(1, len(first)))
    base = edges[:-1][owner]
    return formatted, np.split(a - base, split), np.split(z - base, split)


def _format(rows: pa.Table) -> pa.RecordBatch:
    ids = rows.column("conv_id").combine_chunks()
    plain, none = np.asarray(ids.fill_null(0)), np.asarray(ids.is_null())
    new = np.r_[False, (plain[1:] != plain[:-1]) | (none[1:] != none[:-1])]
    conv = np.cumsum(new)
    texts, a, z = assemble(conv, rows.column("role").combine_chunks(), rows.column("text").combine_chunks())
    first = np.flatnonzero(np.r_[True, new[1:]])
    spans = pa.list_(pa.int64())
    return pa.RecordBatch.from_arrays([ids.take(pa.array(first)), pa.array(np.bincount(conv), pa.int64()), texts.cast(pa.string()) if texts.nbytes < 1 << 31 else texts, pa.array(a, spans), pa.array(z, spans)], ["conv_id", "n_turns", "formatted", "loss_start", "loss_end"])


def _format_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by conversation; one that may go on in the next batch is held back."""
    held: list[pa.RecordBatch] = []
    size, kept = 0, 0
    for b in batches:
        held.append(b)
        size += b.nbytes
        if size < max(RUN_BYTES, kept):  # so that a long conversation is not copied at every batch
            continue
        rows = pa.Table.from_batches(held)
        ids = rows.column("conv_id").combine_chunks()
        last = ids[-1].as_py()
        same = np.asarray(pc.is_null(ids) if last is None else pc.fill_null(pc.equal(ids, last), False))
        cut = int(np.argmax(same))
        if cut:
            yield _format(rows.slice(0, cut))
        held = rows.slice(cut).to_batches()
        size, kept = 0, sum(x.nbytes for x in held)
    if held and (rows := pa.Table.from_batches(held)).num_rows:
        yield _format(rows)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, loss_start, loss_end): spans are byte offsets, end exclusive."""
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = "conv_id long, n_turns long, formatted string, loss_start array<long>, loss_end array<long>"
    return dealt.select("conv_id", "role", "text").mapInArrow(_format_batches, schema)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Turns (role, text) of a formatted text."""
    out, at = [], 0
    while at < len(formatted):
        head = ANY_TURN.match(formatted, at)
        if not head:
            raise ValueError(f"no turn begins at {at}")
        end = TURN_END.search(formatted, head.end())
        if not end or (end.group() == "</s>") == (head.group(1) == "INST"):
            raise ValueError(f"the turn at {at} has no end of its kind")
        role = {"INST": "user", "ANSWER": "assistant"}.get(head.group(1)) if head.group(1) else unescape(head.group(2))
        out.append((role, unescape(formatted[head.end() : end.start()])))
        at = end.end()
    return out


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = []
        for f, starts, ends in zip(b.column("formatted").to_pylist(), b.column("loss_start").to_pylist(), b.column("loss_end").to_pylist(), strict=True):
            turns = parse(f)
            whole, loss, chars = hashlib.sha256(), hashlib.sha256(), 0
            for role, text in turns:
                whole.update(f"{role}\n{text}\n".encode())
            data = f.encode()
            for a, z in zip(starts, ends, strict=True):
                text = unescape(data[a:z].decode())
                chars += len(text)
                loss.update(text.encode())
            rows.append((len(turns), whole.hexdigest(), chars, loss.hexdigest(), len(f)))
        columns = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        yield pa.RecordBatch.from_arrays([b.column("conv_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted texts hold, read back from them."""
    return formatted.mapInArrow(_digest_batches, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
