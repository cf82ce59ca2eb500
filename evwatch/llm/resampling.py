"""Importance resampling towards a target: documents are drawn by how much more likely their words
are in the target's texts than in all texts.

Words are found by an Aho-Corasick automaton over the distinct words of a piece of the texts, each
between two delimiters, so that only whole words match and neighbours share a delimiter. A match
emits the word's payload, its CRC-32 and its length. The CRC of a run of words follows from the
payloads of neighbours alone: the left one's, moved on by as many bytes as the right one has, xor
the right one's. A run's bucket is its CRC modulo the number of buckets; texts are never hashed anew.

Texts are scanned once: what is stored of each is the buckets of its runs, in two or four bytes each.
Counts by bucket are summed in each task before they are shuffled. Gains of buckets are a table of
``buckets`` rows, which is all that tasks get.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evwatch.llm import common
from evwatch.operators.ranks import numbered
from evwatch.tables import stored

#: Bytes of texts whose distinct words make one automaton.
PIECE = 1 << 18
#: A-Z to a-z; digits, a-z and bytes of characters past ASCII are words; all else is a space.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def zero_bytes(powers: int) -> list[np.ndarray]:
    """For each p below ``powers``, what 2^p bytes more make of a CRC-32: four tables, by its bytes."""
    value = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        value = (value >> np.uint32(1)) ^ (value & np.uint32(1)) * np.uint32(0xEDB88320)
    low = np.arange(256, dtype=np.uint32)
    ops = [np.stack([value, low, low << np.uint32(8), low << np.uint32(16)])]
    while len(ops) < powers:
        ops.append(moved_once(ops[-1], ops[-1]))
    return ops


def moved_once(op: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return op[0][crc & 255] ^ op[1][crc >> 8 & 255] ^ op[2][crc >> 16 & 255] ^ op[3][crc >> 24]


OPS = zero_bytes(32)


def composed(left: np.ndarray, right: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC-32 of two strings one after the other, from theirs and the second one's length."""
    for p in range(int(length.max(initial=0)).bit_length()):
        left = np.where(length >> p & 1, moved_once(OPS[p], left), left)
    return left ^ right


def pieces(texts: list[bytes]) -> Iterator[list[tuple[int, str]]]:
    """Numbered texts, cut at delimiters where they are long, in groups of about ``PIECE`` bytes."""
    group: list[tuple[int, str]] = []
    size = 0
    for i, text in enumerate(texts):
        at = 0
        while at < len(text):
            end = len(text) if len(text) - at <= PIECE else text.find(b" ", at + PIECE)
            end = len(text) if end < 0 else end
            group.append((i, f" {text[at:end].decode('latin-1')} "))
            size, at = size + end - at, end
            if size >= PIECE:
                yield group
                group, size = [], 0
    if group:
        yield group


def payloads(texts: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """CRC-32 and length of each word of each text, in order; a null has none."""
    folded = [(x or b"").translate(FOLDED) for x in texts]
    found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in folded]
    for group in pieces(folded):
        words = list({w for _, text in group for w in text.split()})
        if not words:
            continue
        automaton = ahocorasick.Automaton()
        for k, word in enumerate(words):
            automaton.add_word(f" {word} ", k)
        automaton.make_automaton()
        crcs = np.array([zlib.crc32(w.encode("latin-1")) for w in words], np.uint32)
        lengths = np.array([len(w) for w in words], np.int64)
        for i, text in group:
            at = np.fromiter((k for _, k in automaton.iter(text)), np.int64)
            found[i].append((crcs[at], lengths[at]))
    none = (np.zeros(0, np.uint32), np.zeros(0, np.int64))
    return [tuple(map(np.concatenate, zip(*x, strict=True))) if x else none for x in found]


def buckets_of(crc: np.ndarray, length: np.ndarray, most_words: int, buckets: int) -> np.ndarray:
    """The bucket of each run of 1 to ``most_words`` words that a space joins."""
    space = np.full(len(crc), zlib.crc32(b" "), np.uint32)
    after_space = composed(space, crc, length) if most_words > 1 else space
    run, out = crc, [crc % np.uint32(buckets)]
    for n in range(2, most_words + 1):
        if len(crc) < n:
            break
        run = composed(run[:-1], after_space[n - 1 :], length[n - 1 :] + 1)
        out.append(run % np.uint32(buckets))
    return np.concatenate(out)


def kind_of(buckets: int) -> type[np.unsignedinteger]:
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def bucketed(texts: DataFrame, id_col: str | None = "doc_id", text_col: str = "text", most_words: int = 1, buckets: int = 10_000) -> DataFrame:
    """``(doc_id, n_words, buckets)`` of every row of ``texts``: the buckets of its features, in
    ``kind_of(buckets)``'s bytes each."""
    common.importable(texts.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = payloads(batch.column(1).to_pylist())
            told = [buckets_of(crc, length, most_words, buckets).astype(kind_of(buckets)).tobytes() for crc, length in words]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(crc) for crc, _ in words], pa.int64()), pa.array(told, pa.binary())], ["doc_id", "n_words", "buckets"])

    key = F.lit(None) if id_col is None else F.col(id_col)
    rows = texts.select(key.cast("long").alias("doc_id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, buckets binary")


def bucket_counts(found: DataFrame, buckets: int = 10_000) -> DataFrame:
    """``(bucket, n)`` over all rows of ``bucketed``, for the buckets that occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for told in batch.column(0):
                counts += np.bincount(np.frombuffer(told.as_py(), kind_of(buckets)), minlength=buckets)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["bucket", "n"])

    return found.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = 10_000) -> DataFrame:
    """``(bucket, gain)`` for every bucket: 1000 ln of its smoothed share of the target's features
    over that of all documents', rounded down. Both are rows of ``bucketed``."""
    spark = docs.sparkSession
    raw, wanted = (stored(bucket_counts(x, buckets)) for x in (docs, target))
    totals = raw.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_raw")).join(wanted.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("all_wanted")))
    each = spark.range(buckets).withColumnRenamed("id", "bucket").join(raw.withColumnRenamed("n", "s"), "bucket", "left").join(wanted.withColumnRenamed("n", "t"), "bucket", "left").na.fill(0)

    def plus(c: str, k: int) -> Column:
        return F.col(c).cast("double") + F.lit(float(k))

    ratio = plus("t", 1) * plus("all_raw", buckets) / (plus("s", 1) * plus("all_wanted", buckets))
    return each.join(totals).select("bucket", F.floor(1000 * F.log(ratio)).cast("long").alias("gain"))


def importance(found: DataFrame, gains: DataFrame) -> DataFrame:
    """``(doc_id, n_words, n_features, weight)`` of every row of ``bucketed``: the weight is the mean gain of
    its features, rounded down, 0 without any. ``gains`` has a row for each bucket and comes to the driver."""
    table = np.array([x["gain"] for x in gains.orderBy("bucket").select("gain").collect()], np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            told = [np.frombuffer(x.as_py(), kind_of(len(table))) for x in batch.column(2)]
            n_features = pa.array([len(x) for x in told], pa.int64())
            weight = pa.array([int(table[x].sum()) // max(1, len(x)) for x in told], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), n_features, weight], ["doc_id", "n_words", "n_features", "weight"])

    return found.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def gumbel(seed: int, id_col: str = "doc_id") -> Column:
    """A Gumbel draw by the id's hash, times 1000, rounded down."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    most_words: int = 1, buckets: int = 10_000, percent: int = 10, least_words: int = 20, seed: int = 2024,
) -> DataFrame:
    """``(doc_id, n_words, n_features, weight, score, rank)`` of every row of ``docs``: the score is the
    weight plus a Gumbel draw by ``seed`` and id; of the rows with ``least_words`` words and more the
    highest ``percent`` in a hundred are drawn, which is a draw by weight without replacement. Ranks
    start at 1; ties go to the smaller id; what isn't drawn has none.

    A null or empty text has no features and weight 0. A row without an id has no score and is neither
    drawn nor counted. Repeated rows each have a score and may each be drawn. An empty target or an
    empty table is as good as no features. Other columns are not looked at. Ids must be numbers.
    """
    found = stored(bucketed(docs, id_col, text_col, most_words, buckets))
    weights = importance(found, bucket_gains(found, bucketed(target, None, text_col, most_words, buckets), buckets))
    scored = weights.withColumn("score", F.col("weight") + gumbel(seed)).withColumn("__out", (F.col("score").isNull() | (F.col("n_words") < least_words)).cast("int"))
    scored = stored(scored)
    take = scored.where("__out = 0").count() * percent // 100
    placed = numbered(scored, ["__out", F.col("score").desc(), "doc_id", "n_words"])
    rank = F.when((F.col("__out") == 0) & (F.col("place") < take), F.col("place") + 1)
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))
