"""Token counts by section: each document is encoded once, as a whole, and its tokens' character
spans are joined to the spans of its sections.

A token can reach over a section's end. ``rule`` says to whom it counts:

- ``first``: the section that holds its first character (the default);
- ``most``: the section that holds most of its characters, the earlier one of equals;
- ``share``: each section by its share of the token's characters.

Token spans and sections of a document are both in order, so the interval join is a binary
search of section bounds among token bounds, in the row that holds both; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evwatch.llm import common, tokens

RULES = ("first", "most", "share")
SCHEMA = "doc_id long, section long, char_start long, char_end long, n_tokens double, n_crossing long, doc_tokens long"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


def line_sections(text: str) -> np.ndarray:
    """Character bounds of a text's lines, each with its newline: n + 1 numbers for n lines."""
    cuts = [0]
    at = text.find("\n")
    while at >= 0:
        cuts.append(at + 1)
        at = text.find("\n", at + 1)
    if cuts[-1] < len(text):
        cuts.append(len(text))
    return np.array(cuts, np.int64)


def token_spans(text: str, n_bytes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Character spans of tokens of ``n_bytes`` bytes each. A token that begins inside of a
    character's bytes starts at that character, one that ends inside ends after it."""
    ends = np.cumsum(n_bytes)
    starts = ends - n_bytes
    data = np.frombuffer(text.encode(), np.uint8)
    if len(data) == len(text):
        return starts, ends
    before = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # characters begun before each byte
    inside = np.append((data & 0xC0) == 0x80, False)
    return before[starts] - inside[starts], before[ends]


def allocate(starts: np.ndarray, ends: np.ndarray, bounds: np.ndarray, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of its tokens (by first character) cross its end."""
    n = len(bounds) - 1
    first = np.searchsorted(bounds, starts, "right") - 1
    last = np.searchsorted(bounds, ends, "left") - 1
    over = last > first
    crossing = np.bincount(first[over], minlength=n)
    if rule == "first":
        return np.bincount(first, minlength=n).astype(float), crossing
    counts = np.bincount(first[~over], minlength=n).astype(float)
    for a, b, i, j in zip(starts[over].tolist(), ends[over].tolist(), first[over].tolist(), last[over].tolist(), strict=True):
        held = [min(b, int(bounds[k + 1])) - max(a, int(bounds[k])) for k in range(i, j + 1)]
        if rule == "most":
            counts[i + held.index(max(held))] += 1
        else:
            counts[i : j + 1] += np.array(held) / (b - a)
    return counts, crossing


def attribute(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, rule: str = "first", sections=line_sections
) -> DataFrame:
    """One row for each section of each row of ``docs``, in ``SCHEMA``; sections are lines unless
    ``sections`` gives other bounds.

    A null or empty text has one empty section without tokens. Repeated rows give their sections
    again, a null id stays null, other columns are not looked at, an empty table gives no row.
    Whatever the rule, a document's sections sum to its tokens.
    """
    if rule not in RULES:
        raise ValueError(f"rule must be one of {', '.join(RULES)}")
    path = path or tokens.default_path()
    common.importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokens.byte_bpe(path)
        for batch in batches:
            out: list[list[np.ndarray]] = [[] for _ in NAMES[1:]]
            sizes = []
            for text in (x.as_py() or "" for x in batch.column(1)):
                bounds = sections(text) if text else np.zeros(2, np.int64)
                ids = bpe.encode(text)
                n = len(bounds) - 1
                starts, ends = token_spans(text, bpe.n_bytes[ids])
                counts, crossing = allocate(starts, ends, bounds, rule)
                sizes.append(n)
                for column, x in zip(out, (np.arange(n), bounds[:-1], bounds[1:], counts, crossing, np.full(n, len(ids))), strict=True):
                    column.append(x)
            if sizes:
                of_row = pa.array(np.repeat(np.arange(len(sizes)), sizes))
                columns = [batch.column(0).take(of_row), *(pa.array(np.concatenate(c)) for c in out)]
                yield pa.RecordBatch.from_arrays(columns, NAMES)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, SCHEMA)
