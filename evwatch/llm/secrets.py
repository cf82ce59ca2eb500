"""Secret scans: fixed patterns, and sliding windows of high entropy over candidate strings.

A candidate is a maximal run of characters in which secrets are written. Over each candidate a
window slides; its Shannon entropy follows from the sum of c * log2(c) over its character counts,
which changes by two terms when the window moves by one. It is held against every character class
that has all of the window's characters. Windows at
or over the class's threshold, in which only the class's characters occur and as many of its
kinds as the class asks for, are joined to spans. A span is suppressed if an allow-list pattern
matches all of it or of its candidate; the fixed patterns' spans are not touched by that.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import log2

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evwatch.llm import common

KINDS = ("assign", "access", "hex", "entropy")


def either_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


#: Key words of an assignment; ``?`` makes the character before it optional.
KEYS = ("password", "passwd", "secret", "token", "api_?key")
ASSIGN = re.compile(rf"(?:{'|'.join(map(either_case, KEYS))})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
#: Runs too short are dropped anyway, and no longer run starts inside of them.
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST_ASSIGNED = 12
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")


@dataclass(frozen=True)
class CharClass:
    """Characters, bits per character that a window must reach, and how many of
    lower case, upper case and digits it must mix."""

    name: str
    characters: frozenset[str]
    bits: float
    mixes: int


LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", common.UPPER, "0123456789"
#: Thresholds lie where 99 % and more of random windows of the class are over them: of 20 characters
#: drawn from 16, 36, 62 and 66 kinds. A shorter candidate is one window; for each character less its
#: threshold is lower by ``SHORTER`` bits.
CLASSES = (
    CharClass("hex", frozenset(DIGITS + "abcdef"), 2.8, 2),
    CharClass("HEX", frozenset(DIGITS + "ABCDEF"), 2.8, 2),
    CharClass("alnum", frozenset(LOWER + UPPER + DIGITS), 3.4, 2),
    CharClass("base64", frozenset(LOWER + UPPER + DIGITS + "+/_=-"), 3.6, 2),
)
SHORTER = 0.06
#: A word as people write it: one case, or a capital first; letters at random hardly ever are.
WORD = r"(?:[A-Z]?[a-z]{3,}|[A-Z]{3,})"
#: What looks random but is no secret: placeholders (a word for one at either end, or nothing but a
#: filler; a key that merely holds such a piece is a key), identifiers meant to be public, names made of
#: words and numbers, dates.
ALLOWED = (
    r"(?i)(?:example|placeholder|changeme)\w*|\w*(?:example|placeholder|changeme)",
    r"(?i)(?:x+|0+|0?123456789?0?|[-_/+=])+",
    r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}",
    rf"{WORD}{{1,8}}\d{{0,4}}",
    rf"[-_/+=]*(?:{WORD}|[A-Za-z]{{1,3}}\d{{0,2}}|\d{{1,8}})(?:[-_/+=]+(?:{WORD}|[A-Za-z]{{1,3}}\d{{0,2}}|\d{{1,8}}))+[-_/+=]*",
    r"\d{4}-\d{2}-\d{2}T?[\d-]*",
)
WINDOW = 20


#: For each character a bit for every class that lacks it, and which of lower, upper and digit it is.
LACKING = {c: sum(1 << k for k, kind in enumerate(CLASSES) if c not in kind.characters) for c in sorted(frozenset.union(*(x.characters for x in CLASSES)))}
MIXED = {c: 0 if c in LOWER else 1 if c in UPPER else 2 if c in DIGITS else 3 for c in LACKING}


def entropy_spans(text: str, window: int = WINDOW) -> list[tuple[int, int]]:
    """Spans of a candidate that windows over a class's threshold cover, in order."""
    lower = SHORTER * max(0, window - len(text))
    window = min(window, len(text))
    if text.isalpha() and (text.islower() or text.isupper()):
        return []
    term = [0.0] + [c * log2(c) for c in range(1, window + 1)]
    counts, mixed, outside, total = dict.fromkeys(text, 0), [0] * 4, [0] * len(CLASSES), 0.0
    found: list[tuple[int, int]] = []
    for i, c in enumerate(text):
        for x, step in ((c, 1),) if i < window else ((text[i - window], -1), (c, 1)):
            total += term[counts[x] + step] - term[counts[x]]
            counts[x] += step
            mixed[MIXED[x]] += step
            if LACKING[x]:
                for k in range(len(CLASSES)):
                    outside[k] += step * (LACKING[x] >> k & 1)
        if i >= window - 1:
            bits, kinds = log2(window) - total / window + 1e-9, sum(map(bool, mixed[:3]))
            if any(not n and bits >= kind.bits - lower and kinds >= kind.mixes for n, kind in zip(outside, CLASSES, strict=True)):
                found.append((i - window + 1, i + 1))
    return joined(found)


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def scan(text: str, allowed: list[re.Pattern[str]]) -> list[tuple[int, int, int]]:
    """(start, rank of the kind, end) of every span, in order."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= LEAST_ASSIGNED]
    spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    for m in CANDIDATE.finditer(text):
        if found := entropy_spans(m[0]):
            if not any(p.fullmatch(m[0]) for p in allowed):
                spans += [(m.start() + a, 3, m.start() + b) for a, b in found if not any(p.fullmatch(m[0], a, b) for p in allowed)]
    return sorted(spans)


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", allow: tuple[str, ...] = ALLOWED
) -> DataFrame:
    """``(doc_id, spans)`` for each row of ``docs``: spans are structs of kind, start, end and
    value by start, then kind; positions are code points, ends exclusive.

    A null or empty text has no spans. Repeated rows each give a row, a null id stays null, other
    columns are not looked at, an empty table gives an empty result.
    """
    common.importable(docs.sparkSession)
    schema = "doc_id long, spans array<struct<kind: string, start: long, end: long, value: string>>"
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        allowed = [re.compile(p) for p in allow]
        for batch in batches:
            rows = []
            for text in (x.as_py() or "" for x in batch.column(1)):
                rows.append([{"kind": KINDS[k], "start": a, "end": b, "value": text[a:b]} for a, k, b in scan(text, allowed)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, kind)], ["doc_id", "spans"])

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, schema)
