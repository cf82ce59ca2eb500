"""Packing documents into token sequences by order-preserving dynamic programming.

The documents of a partition are one stream of tokens in their stored order. It is cut at
document ends, at sentence ends or, where a sentence is long, inside of one, so that padding
plus the penalties of the cuts is least:

    best(j) = min over i with 0 < at(j) - at(i) <= size of best(i) + size - (at(j) - at(i)) + penalty(j)

``best(i) + at(i)`` is all that depends on i, and the window of i only moves on, so a monotone
queue gives each minimum in constant time. Partitions are packed on their own: no shuffle, and
at most one short sequence for each. Blocks of a partition are cut with their last sequence held
back for the next block, which bounds memory by a block and the longest document.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evwatch.llm import common, tokens

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
NAMES = [x.split()[0] for x in SCHEMA.split(", ")]


@dataclass(frozen=True)
class Plan:
    """What a cut costs, in tokens of padding; ``stride`` is the most tokens between two places to cut."""

    size: int = 2048
    sentence: float = 4.0
    inside: float = 20.0
    stride: int = 32
    block: int = 1 << 19


def best_cuts(at: list[int], penalty: list[float], size: int, ended: bool = True) -> list[int]:
    """Indices of the chosen places, first and last included. ``at`` ascends, by ``size`` at most.

    If the stream hasn't ended, the last sequence is still to be filled: its padding doesn't count.
    """
    n = len(at)
    back, key = [0] * n, [0.0] * n
    key[0] = at[0]
    queue = deque([0])
    for j in range(1, n):
        here = at[j]
        low = here - size
        while at[queue[0]] < low:
            queue.popleft()
        i = back[j] = queue[0]
        mine = key[j] = key[i] + size + penalty[j]  # best(j) + at(j)
        while queue and key[queue[-1]] > mine:
            queue.pop()
        queue.append(j)
    path = [n - 1]
    if not ended and n > 1:
        reach = [j for j in range(n - 1) if at[-1] - at[j] <= size]
        path.append(min(reach, key=lambda j: key[j] - at[j] if j else 0.0))
    while path[-1]:
        path.append(back[path[-1]])
    return path[::-1]


def places(ids: np.ndarray, starts: np.ndarray, ends_sentence: np.ndarray, plan: Plan) -> tuple[np.ndarray, np.ndarray]:
    """Where the stream ``ids`` may be cut, and the penalties; ``starts``: where documents start in it."""
    penalty = np.full(len(ids) + 1, np.inf)
    penalty[1:][ends_sentence[ids]] = plan.sentence
    penalty[starts] = 0
    penalty[[0, -1]] = 0
    at = np.flatnonzero(np.isfinite(penalty))
    gaps = np.diff(at)
    n = (gaps - 1) // plan.stride  # more places between two that are far apart
    nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + 1
    penalty[np.repeat(at[:-1], n) + nth * plan.stride] = plan.inside
    at = np.flatnonzero(np.isfinite(penalty))
    return at, penalty[at]


@dataclass
class Stream:
    """The part of a partition's stream that isn't in a sequence yet."""

    plan: Plan
    ends_sentence: np.ndarray
    first_sequence: int
    ids: list[np.ndarray] = field(default_factory=list)
    docs: list[tuple[int | None, int, int]] = field(default_factory=list)  # id, start in the buffer, tokens
    held: int = 0
    sequences: int = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id, self.held, len(ids)))
        self.ids.append(ids)
        self.held += len(ids)

    def flush(self, last: bool) -> list[tuple]:
        """Pieces of the sequences that are settled: all if this is the last block."""
        if not self.held:
            return []
        ids = np.concatenate(self.ids)
        starts = np.array([s for _, s, _ in self.docs], np.int64)
        at, penalty = places(ids, starts[starts >= 0], self.ends_sentence, self.plan)
        cuts = at[best_cuts(at.tolist(), penalty.tolist(), self.plan.size, last)]
        if not last:
            cuts = cuts[:-1]
        until = int(cuts[-1])
        out = []
        bounds = np.union1d(cuts, starts[(starts > 0) & (starts < until)])
        doc = np.searchsorted(starts, bounds[:-1], "right") - 1
        seq = np.searchsorted(cuts, bounds[:-1], "right") - 1
        for a, b, d, s in zip(bounds[:-1].tolist(), bounds[1:].tolist(), doc.tolist(), seq.tolist(), strict=True):
            doc_id, begin, n = self.docs[d]
            piece = ids[a:b].astype("<u4").tobytes()
            out.append((doc_id, a - begin, b - a, piece, n, self.first_sequence + self.sequences + s, a - int(cuts[s])))
        self.sequences += len(cuts) - 1
        self.ids, self.held = [ids[until:]] if until < len(ids) else [], len(ids) - until
        self.docs = [(k, s - until, n) for k, s, n in self.docs if s + n > until]
        return out


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, end_id: int = 1, plan: Plan = Plan()
) -> DataFrame:
    """One row for each piece of a document in a sequence.

    ``ids`` are the piece's ids as little-endian unsigned 32-bit numbers, ``start`` counts the
    document's ids before it, ``doc_tokens`` all of them, ``offset`` those before it in its
    sequence. A document's ids end with ``end_id``; a null or empty text has that id alone.
    Documents keep their stored order, repeated rows are packed one by one, a null id stays
    null. A text of any length is cut as it must be. An empty table gives no row.
    """
    path = path or tokens.default_path()
    common.importable(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = tokens.byte_bpe(path)
        ends = np.array([x.rstrip().endswith((b".", b"!", b"?")) or b"\n" in x for x in bpe.vocabulary])
        stream = Stream(plan, ends, TaskContext.get().partitionId() << 33)
        end = np.array([end_id], np.uint32)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                stream.add(doc_id, np.concatenate([bpe.encode(text.as_py() or ""), end]))
                if stream.held >= plan.block:
                    yield from rows(stream.flush(False))
        yield from rows(stream.flush(True))

    def rows(pieces: list[tuple]) -> Iterator[pa.RecordBatch]:
        if pieces:
            kinds = [pa.binary() if x == "ids" else pa.int64() for x in NAMES]
            columns = [pa.array(c, k) for c, k in zip(zip(*pieces, strict=True), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(columns, NAMES)

    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return texts.mapInArrow(run, SCHEMA)
