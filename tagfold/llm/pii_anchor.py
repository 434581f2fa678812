"""Operator 3: personal data by anchor expansion.

One Aho-Corasick automaton finds anchors in a whole text: at-signs, plus signs, digits, `://`, and cues of identifiers.
At each anchor a local parser finds the boundaries of the span around it and a check decides on it. email, ip, card and
phone are found as their patterns would find them from left to right without overlap; account (an identifier after a cue,
or an access key by its own shape) and address (a link that names a user or a bare ip as its host) are further kinds.

Null and empty texts have no spans; rows repeated as they are give equal rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BASE = ("email", "ip", "card", "phone")
KINDS = (*BASE, "account", "address")
DIGITS = "0123456789"
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
# Shapes of the parts that a parser expands to.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
RUN = re.compile(r"[0-9]+")
IP = re.compile(r"[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CUES = ("password", "passwd", "token", "account", "acct", "iban", "customer id", "user id", "ssn", "api_key", "secret")
VALUE = re.compile(r"(?: (?:no|number|id)\.?)? ?[=:#] ?[\"']?([A-Za-z0-9][A-Za-z0-9_/+-]{5,})")
KEY_CUE, KEY = "AKIA", re.compile(r"AKIA[0-9A-Z]{16}(?![0-9A-Za-z])")
SCHEMES = ("http", "https", "ftp", "ssh", "ftps", "sftp")
LINK = re.compile(r"[^\s<>\"']+")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def build():
    import ahocorasick

    a = ahocorasick.Automaton()
    for c in DIGITS:
        a.add_word(c, ("digit", 1))
        a.add_word("+" + c, ("plus", 2))
    a.add_word("@", ("at", 1))
    a.add_word("://", ("scheme", 3))
    for cue in CUES:
        for form in {cue, cue.capitalize(), cue.upper()}:
            a.add_word(form, ("cue", len(form)))
    a.add_word(KEY_CUE, ("key", len(KEY_CUE)))
    a.make_automaton()
    return a


def email_at(text: str, at: int, least: int) -> tuple[int, int] | None:
    """Around the at-sign; `least` is where the email before it ended."""
    a = at
    while a > least and text[a - 1] in LOCAL:
        a -= 1
    m = DOMAIN.match(text, at + 1) if a < at else None
    return (a, m.end()) if m else None


def ip_ok(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def address_at(text: str, colon: int) -> tuple[int, int] | None:
    """A link with user information, or with an ip as its host; the scheme stands before the colon."""
    a = colon
    while a > 0 and colon - a < 6 and text[a - 1].isascii() and text[a - 1].isalpha():
        a -= 1
    if text[a:colon].lower() not in SCHEMES:
        return None
    m = LINK.match(text, colon + 3)
    if not m:
        return None
    link = m.group().rstrip(".,;:!?)]}")
    authority = re.split(r"[/?#]", link, maxsplit=1)[0]
    host = authority.rpartition("@")[2].partition(":")[0]
    if "@" not in authority and not (IP.fullmatch(host) and ip_ok(host)):
        return None
    return a, colon + 3 + len(link)


def find(text: str, automaton) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end), sorted."""
    out = []
    end = dict.fromkeys(("email", "ip", "card", "phone", "account"), 0)
    for last, (what, n) in automaton.iter(text):
        i = last + 1 - n
        if what == "digit":
            if i >= end["card"]:
                m = CARD.match(text, i)
                end["card"] = m.end() if m else i + 1
                if m:
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 14 <= len(digits) <= 19 and luhn(digits):
                        out.append((i, 2, m.end()))
            if i >= end["ip"]:
                m = IP.match(text, i)
                end["ip"] = m.end() if m else RUN.match(text, i).end()
                if m and ip_ok(m.group()):
                    out.append((i, 1, m.end()))
        elif what == "plus":
            if i >= end["phone"]:
                m = PHONE.match(text, i)
                if m:
                    end["phone"] = m.end()
                    if 10 <= sum(c in DIGITS for c in m.group()) <= 15:
                        out.append((i, 3, m.end()))
        elif what == "at":
            if i >= end["email"] and (span := email_at(text, i, end["email"])):
                end["email"] = span[1]
                out.append((span[0], 0, span[1]))
        elif what == "scheme":
            if span := address_at(text, i):
                out.append((span[0], 5, span[1]))
        elif what == "key":
            if (i == 0 or not text[i - 1].isalnum()) and (m := KEY.match(text, i)):
                out.append((i, 4, m.end()))
        elif i >= end["account"] and (i == 0 or not text[i - 1].isalnum()):
            m = VALUE.match(text, last + 1)
            if m and any(c in DIGITS for c in m.group(1)):
                end["account"] = m.end(1)
                out.append((m.start(1), 4, m.end(1)))
    out.sort()
    return out


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = build()
    for b in batches:
        counts: list[list[int]] = [[] for _ in BASE]
        digests, spans = [], []
        for text in b.column("text"):
            found = find(text.as_py() or "", automaton)
            for k, c in enumerate(counts):
                c.append(sum(x[1] == k for x in found))
            base = ",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in found if k < len(BASE))
            digests.append(hashlib.sha256(base.encode()).hexdigest())
            spans.append(",".join(f"{KINDS[k]}:{a}:{z}" for a, k, z in found))
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(c, pa.int64()) for c in counts), pa.array(digests, pa.string()), pa.array(spans, pa.string())], ["doc_id", *(f"n_{k}" for k in BASE), "base_sha256", "spans"])


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans), a row for each row of docs."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    counts = ", ".join(f"n_{k} long" for k in BASE)
    return slim.mapInArrow(_batches, f"doc_id long, {counts}, base_sha256 string, spans string")
