"""Exact substring dedup: bytes of strings of ``length`` that also start in an earlier document.

Which strings are equal is told by suffix arrays and their common prefixes. Every string of
``length`` bytes has an anchor, the gram of ``GRAM`` bytes in it with the least hash (the first of
equals), which depends on its bytes alone; strings that are equal have equal anchors. A document is
cut into segments of consecutive starts with one anchor:

1. Within a chunk of documents, the text under anchors that several of its documents have goes
   through suffix arrays. Starts whose string an earlier document of the chunk has are repeats;
   segments of nothing but repeats end there, so that of a passage that very many documents hold
   one copy goes on for each chunk. The others' anchors go to buckets.
2. In a bucket, equal segments (by anchor, length and 48 bits of a hash of their bytes) are a class: a
   later document's are repeats, the earliest's stand for the class. Where an anchor still has
   several of several documents, these are wanted; of an anchor with very many
   segments, only halves whose next ``SIDE`` bytes on their side of the anchor, by a hash, several
   documents have as well, and these are dealt anew by those bytes. Wanted bytes are fetched.
3. By shards of bounded size, suffix arrays and common prefixes group equal strings, the shards of
   one anchor are merged by binary search among their strings, and a start is a repeat if the least
   document of its string comes before its own.

Repeats go back to their documents as spans. Both ways of travel are blobs for buckets whose
number follows from the bytes of the input.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evwatch.llm import common, suffixes

GRAM = 24
SIDE = 13  # bytes next to an anchor that all strings on that side of it hold
CHUNK = 8 << 20  # bytes of texts whose strings are compared before they travel
BUCKET = 6 << 20  # bytes of texts for each bucket
SHARD = 1 << 21  # bytes of a suffix array
HOT = 1024  # segments of an anchor from which it is split
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
LOW = np.uint64(0xFFFFFFFF)
BASE = 0x100000001B3
#: A segment's place: document, tag (tells rows of one id apart), first start; ``n`` starts.
PLACE = [("doc", np.int64), ("tag", np.uint32), ("start", np.uint32), ("n", np.uint16)]
#: Within a bucket, 32 bits of an anchor do: one that meets another's only has more segments compared.
#: ``left`` starts lie more than ``SIDE`` bytes before the anchor; hashes of the bytes on either side.
SENT = np.dtype([("anchor", np.uint32), ("content", np.uint64), *PLACE, ("left", np.uint16), ("before", np.uint16), ("after", np.uint16)])
WANTED = np.dtype([("anchor", np.uint32), ("bucket", np.uint32), *PLACE])
SPAN = np.dtype([("doc", np.int64), ("tag", np.uint32), ("start", np.uint32), ("end", np.uint32)])


@lru_cache(maxsize=4)
def powers(bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of ``BASE`` and of its inverse modulo 2**64."""
    up, down = np.full(1 << bits, BASE, np.uint64), np.full(1 << bits, pow(BASE, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * MIX[0]
    return h ^ h >> np.uint64(29)


def segments(data: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """A text's segments as rows of ``SENT`` without document and tag, and their anchors' hashes."""
    n = len(data) - length + 1
    if n < 1:
        return np.zeros(0, SENT), np.zeros(0, np.uint64)
    words = np.ndarray((len(data) - 7,), "<u8", data.tobytes(), strides=(1,))
    grams = len(data) - GRAM + 1
    hashes = mixed(sum(words[8 * j : 8 * j + grams] * MIX[j] for j in range(GRAM // 8)))
    least = hashes & ~LOW | np.arange(grams, dtype=np.uint64)  # ties go to the first place
    have, want = 1, length - GRAM + 1  # windows of grams, doubled as long as they fit
    while have < want:
        step = min(have, want - have)
        least = np.minimum(least[: len(least) - step], least[step:])
        have += step
    place = (least & LOW).astype(np.int64)
    first = np.flatnonzero(np.append(True, place[1:] != place[:-1]))
    rows, at = np.zeros(len(first), SENT), place[first]
    rows["start"], rows["n"] = first, np.diff(np.append(first, n))
    rows["left"] = np.minimum(np.maximum(at - SIDE - first, 0), rows["n"])
    for name, begin in (("before", at - SIDE), ("after", at + GRAM)):
        begin = np.clip(begin, 0, len(words) - 1)
        second = np.minimum(begin + SIDE - 8, len(words) - 1)
        rows[name] = mixed(words[begin] * MIX[1] + words[second] * MIX[2]) >> np.uint64(48)
    up, down = powers(max(16, int(len(data)).bit_length()))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)])])
    rows["content"] = mixed((sums[first + rows["n"] + length - 1] - sums[first]) * down[first]) >> np.uint64(16)
    return rows, hashes[at]


def heads_of(*columns: np.ndarray) -> np.ndarray:
    """Where sorted rows differ from the row before."""
    out = np.zeros(len(columns[0]), bool)
    out[:1] = True
    for c in columns:
        out[1:] |= c[1:] != c[:-1]
    return out


def runs_of(*columns: np.ndarray) -> list[tuple[int, int]]:
    """First and last + 1 of the runs of equal sorted rows."""
    at = np.flatnonzero(heads_of(*columns)).tolist()
    return list(zip(at, [*at[1:], len(columns[0])], strict=False))


def shared(key: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Whether a row's key is found in several documents."""
    if not len(key):
        return np.zeros(0, bool)
    order = np.argsort(np.ascontiguousarray(key))
    heads, doc = heads_of(key[order]), doc[order]
    at, out = np.flatnonzero(heads), np.empty(len(key), bool)
    out[order] = (np.maximum.reduceat(doc, at) != np.minimum.reduceat(doc, at))[np.cumsum(heads) - 1]
    return out


def late_starts(texts: list[np.ndarray], owner: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Which text, and where in it, strings start that a text of a smaller owner has too."""
    texts, nth, skipped = pieces(texts, length)
    size = np.array([len(t) for t in texts], np.int64)
    cuts, held = [0], 0
    for i, m in enumerate(size.tolist()):
        if held + m > SHARD and held:
            cuts.append(i)
            held = 0
        held += m
    cuts.append(len(texts))
    shards = [(np.concatenate(texts[i:j]), np.cumsum(size[i:j]), owner[nth[i:j]]) for i, j in zip(cuts, cuts[1:], strict=False)]
    which, where = [], []
    for (_, ends, own), (at, least), i in zip(shards, suffixes.least_owners(shards, length), cuts, strict=False):
        segment = np.searchsorted(ends, at, "right")
        late = least < own[segment]
        at, segment = at[late], segment[late]
        which.append(nth[i + segment])
        where.append(at - (ends - np.diff(ends, prepend=0))[segment] + skipped[i + segment])
    return np.concatenate(which), np.concatenate(where)


def pieces(texts: list[np.ndarray], length: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """``texts`` with those over a shard's size cut, each piece repeating the ``length - 1`` bytes before
    its own, the text that each is of and where it starts there."""
    out, nth, skipped, step = [], [], [], max(SHARD, 2 * length) - length + 1
    for i, t in enumerate(texts):
        for a in range(0, max(len(t) - length + 1, 1), step):
            out.append(t[a : a + step + length - 1])
            nth.append(i)
            skipped.append(a)
    return out, np.array(nth), np.array(skipped)


def joined(spans: np.ndarray) -> np.ndarray:
    """Spans of a document that overlap or touch, as one."""
    if not len(spans):
        return spans
    spans = spans[np.lexsort((spans["start"], spans["tag"], spans["doc"]))]
    fresh = heads_of(spans["doc"], spans["tag"])
    # Ends within a document only matter up to the largest so far: lift documents apart.
    lift = np.cumsum(fresh).astype(np.int64) << 33
    reach = np.maximum.accumulate(lift + spans["end"])
    fresh[1:] |= lift[1:] + spans["start"][1:] > reach[:-1]
    at = np.flatnonzero(fresh)
    out = spans[at].copy()
    out["end"] = np.maximum.reduceat(spans["end"], at)
    return out


def blobs(rows: np.ndarray, bucket: np.ndarray, kind: int) -> list[tuple[int, int, bytes]]:
    """(bucket, kind, bytes) for the rows of each bucket."""
    order = np.argsort(bucket, kind="stable")
    rows, bucket = rows[order], bucket[order]
    return [(int(bucket[i]), kind, packed(rows[i:j])) for i, j in runs_of(bucket)]


CODEC = pa.Codec("zstd", 1)
HASHES = ("seed", "anchor", "content", "before", "after")  # columns whose neighbours tell nothing of each other


def packed(rows: np.ndarray) -> bytes:
    """Rows as differences from the row before, byte by byte: all first bytes, all second bytes and
    so on, compressed; places in order cost a byte or two."""
    told = rows.copy()
    for name in rows.dtype.names:
        if name not in HASHES:
            told[name][1:] = rows[name][1:] - rows[name][:-1]
    planes = np.ascontiguousarray(told).view(np.uint8).reshape(len(rows), -1).T.tobytes()
    return len(rows).to_bytes(8, "little") + CODEC.compress(planes, asbytes=True)


def unpacked(data: pa.Buffer, dtype: np.dtype) -> np.ndarray:
    n = int.from_bytes(data[:8].to_pybytes(), "little")
    planes = np.frombuffer(CODEC.decompress(data[8:], n * dtype.itemsize), np.uint8)
    rows = np.ascontiguousarray(planes.reshape(dtype.itemsize, n).T).view(dtype).ravel()
    for name in dtype.names:
        if name not in HASHES:
            rows[name] = np.cumsum(rows[name], dtype=rows[name].dtype)
    return rows


def bucket_of(doc: str, n: int) -> Column:
    """A document's bucket, by a checksum of its id: ids in steps of any kind are dealt evenly."""
    return F.pmod(F.crc32(F.col(doc).cast("string").cast("binary")), F.lit(n)).cast("long")


def doc_bucket(rows: np.ndarray, n: int, column: str = "doc") -> np.ndarray:
    """``bucket_of`` for rows within a task."""
    docs, which = np.unique(rows[column], return_inverse=True)
    return np.array([zlib.crc32(str(d).encode()) % n for d in docs.tolist()], np.int64)[which]


BLOBS = "bucket long, kind int, blob binary"
A_SENT, A_SPAN, A_WANTED = range(3)


def blob_batches(out: list[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    for i in range(0, len(out), 4096):
        part = list(zip(*out[i : i + 4096], strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), pa.array(part[1], pa.int32()), pa.array(part[2], pa.binary())], ["bucket", "kind", "blob"])


def read(table: pa.Table | pa.RecordBatch, kind: int, dtype: np.dtype) -> np.ndarray:
    kinds = table.column("kind").to_pylist()
    found = [unpacked(b.as_buffer(), dtype) for b, k in zip(table.column("blob"), kinds, strict=True) if k == kind]
    return np.concatenate(found) if found else np.zeros(0, dtype)


def cut(docs: DataFrame, length: int, n: int) -> DataFrame:
    """Blobs of segments for anchor buckets, and of spans found within chunks for document buckets.

    A span's blob rides to the anchor bucket of the same number and is passed on from there.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0
        for batch in batches:
            for doc, tag, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), strict=True):
                data = np.frombuffer(text.as_buffer(), np.uint8)
                rows, anchor = segments(data, length)
                rows["doc"], rows["tag"], rows["anchor"] = doc, tag, anchor & LOW
                held.append((rows, anchor, data))
                size += len(data)
                if size >= CHUNK:
                    yield from flush(held)
                    held, size = [], 0
        if held:
            yield from flush(held)

    def flush(held: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        rows, anchor = (np.concatenate([x[k] for x in held]) for k in (0, 1))
        text = np.repeat(np.arange(len(held)), [len(x[0]) for x in held])
        several = shared(anchor, rows["doc"])
        chosen = np.flatnonzero(several)
        out: list[tuple[int, int, bytes]] = []
        if len(chosen):
            # Neighbouring segments of a text are one stretch.
            fresh = np.append(True, (np.diff(chosen) > 1) | (np.diff(text[chosen]) > 0))
            first = chosen[fresh]
            last = chosen[np.append(fresh[1:], True)]
            low = rows["start"][first].astype(np.int64)
            high = rows["start"][last].astype(np.int64) + rows["n"][last] + length - 1
            stretches = [held[k][2][a:b] for k, a, b in zip(text[first].tolist(), low.tolist(), high.tolist(), strict=True)]
            which, where = late_starts(stretches, rows["doc"][first], length)
            spans = np.empty(len(which), SPAN)
            spans["doc"], spans["tag"] = rows["doc"][first][which], rows["tag"][first][which]
            spans["start"] = low[which] + where
            spans["end"] = spans["start"] + length
            # How many of a segment's starts are repeats: all of them, and it needn't go on.
            order = np.lexsort((spans["start"], which))
            begin = np.cumsum(np.append(0, [len(x[2]) for x in held]))
            late = np.sort(begin[text[first][which[order]]] + spans["start"][order])
            mine = begin[text] + rows["start"]
            repeats = np.searchsorted(late, mine + rows["n"]) - np.searchsorted(late, mine)
            keep = repeats < rows["n"]
            rows, anchor = rows[keep], anchor[keep]
            spans = joined(spans)
            out = blobs(spans, doc_bucket(spans, n), A_SPAN)
        yield from blob_batches(blobs(rows, (anchor >> np.uint64(32)).astype(np.int64) % n, A_SENT) + out)

    return docs.select("doc", "tag", "data").mapInArrow(run, BLOBS)


def meet(sent: DataFrame, length: int, n: int) -> DataFrame:
    """Blobs for document buckets: spans that are repeats, and segments whose bytes are wanted."""

    def run(table: pa.Table) -> pa.Table:
        rows, spans = read(table, A_SENT, SENT), read(table, A_SPAN, SPAN)
        rows = rows[shared(rows["anchor"], rows["doc"])]
        rows = rows[np.lexsort((rows["n"], rows["content"], rows["anchor"]))]
        if len(rows):
            heads = heads_of(rows["anchor"], rows["content"], rows["n"])
            again = rows["doc"] > np.minimum.reduceat(rows["doc"], np.flatnonzero(heads))[np.cumsum(heads) - 1]
            copies = np.empty(int(again.sum()), SPAN)
            for name in ("doc", "tag", "start"):
                copies[name] = rows[name][again]
            copies["end"] = copies["start"].astype(np.int64) + rows["n"][again] + length - 1
            spans, rows = np.concatenate([spans, joined(copies)]), rows[~again]
            rows = rows[shared(rows["anchor"], rows["doc"])]
        at = np.flatnonzero(np.append(heads_of(rows["anchor"]), True))
        hot = np.repeat(np.diff(at) >= HOT, np.diff(at))
        wanted = np.concatenate([places_of(rows[~hot], table.column("bucket")[0].as_py()), halves(rows[hot], n)])
        out = blobs(spans, doc_bucket(spans, n), A_SPAN) + blobs(wanted, doc_bucket(wanted, n), A_WANTED)
        return pa.Table.from_batches(blob_batches(out), schema=EMPTY.schema)

    return sent.groupBy("bucket").applyInArrow(run, BLOBS)


def places_of(rows: np.ndarray, bucket: int | np.ndarray) -> np.ndarray:
    wanted = np.empty(len(rows), WANTED)
    for name in ("anchor", *(c for c, _ in PLACE)):
        wanted[name] = rows[name]
    wanted["bucket"] = bucket
    return wanted


def halves(rows: np.ndarray, n: int) -> np.ndarray:
    """Segments of hot anchors, cut where the bytes before the anchor give way to those after it as
    what all strings hold; wanted where several documents have the same, in a bucket of that."""
    left, right = rows.copy(), rows.copy()
    left["n"] = rows["left"]
    right["start"], right["n"] = rows["start"] + rows["left"], rows["n"] - rows["left"]
    key = [mixed(r["anchor"].astype(np.uint64) << np.uint64(17) | np.uint64(side << 16) | r[name]) for side, (r, name) in enumerate(((left, "before"), (right, "after")))]
    both, key = np.concatenate([left, right]), np.concatenate(key)
    some = both["n"] > 0
    both, key = both[some], key[some]
    again = shared(key, both["doc"])
    both, key = both[again], key[again]
    both["anchor"] = key & LOW
    return places_of(both, (key >> np.uint64(32)).astype(np.int64) % n)


EMPTY = pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], pa.int32()), pa.array([], pa.binary())], ["bucket", "kind", "blob"])


def fetch(docs: DataFrame, met: DataFrame, length: int, n: int) -> DataFrame:
    """Blobs for anchor buckets: the wanted segments' places, then their bytes, one after the other."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        wanted = read(right, A_WANTED, WANTED)
        text_of = {key: i for i, key in enumerate(zip(left.column("doc").to_pylist(), left.column("tag").to_pylist(), strict=True))}
        texts = left.column("data")
        bucket = wanted["bucket"]
        order = np.argsort(bucket, kind="stable")
        wanted, bucket = wanted[order], bucket[order]
        out = []
        for i, j in runs_of(bucket):
            part = []
            for doc, tag, start, size in wanted[["doc", "tag", "start", "n"]][i:j].tolist():
                part.append(texts[text_of[doc, tag]].as_buffer()[start : start + size + length - 1].to_pybytes())
            head = np.array([j - i], "<i8").tobytes()
            out.append((int(bucket[i]), A_WANTED, head + wanted[i:j].tobytes() + b"".join(part)))
        return pa.Table.from_batches(blob_batches(out), schema=EMPTY.schema)

    return docs.groupBy("bucket").cogroup(met.groupBy("bucket")).applyInArrow(run, BLOBS)


def resolve(fetched: DataFrame, length: int, n: int) -> DataFrame:
    """Blobs of spans for document buckets: starts whose string an earlier document has."""

    def run(table: pa.Table) -> pa.Table:
        places, texts = [], []
        for blob in table.column("blob"):
            data = np.frombuffer(blob.as_buffer(), np.uint8)
            count = int(data[:8].view("<i8")[0])
            rows = data[8 : 8 + count * WANTED.itemsize].view(WANTED)
            ends = np.cumsum(rows["n"].astype(np.int64) + length - 1)
            places.append(rows)
            texts += np.split(data[8 + count * WANTED.itemsize :], ends[:-1])
        rows = np.concatenate(places)
        order = np.lexsort((rows["start"], rows["doc"], rows["anchor"]))
        rows, texts = rows[order], [texts[i] for i in order]
        # Anchors share arrays as long as they fit into one.
        ends = np.cumsum([len(t) for t in texts])
        heads, found = [i for i, _ in runs_of(rows["anchor"])] + [len(rows)], []
        i = 0
        while i < len(heads) - 1:
            j = i + 1
            begin = ends[heads[i]] - len(texts[heads[i]])
            while j < len(heads) - 1 and ends[heads[j + 1] - 1] - begin <= SHARD:
                j += 1
            part = rows[heads[i] : heads[j]]
            which, where = late_starts(texts[heads[i] : heads[j]], part["doc"], length)
            spans = np.empty(len(which), SPAN)
            spans["doc"], spans["tag"] = part["doc"][which], part["tag"][which]
            spans["start"] = part["start"][which] + where
            spans["end"] = spans["start"] + length
            found.append(joined(spans))
            i = j
        spans = joined(np.concatenate(found))
        return pa.Table.from_batches(blob_batches(blobs(spans, doc_bucket(spans, n), A_SPAN)), schema=EMPTY.schema)

    return fetched.groupBy("bucket").applyInArrow(run, BLOBS)


RESULT = "doc long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary"


def apply(docs: DataFrame, spans: DataFrame) -> DataFrame:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    schema = pa.schema([("doc", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", kind), ("kept", pa.binary())])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        every = joined(read(right, A_SPAN, SPAN))
        of_doc: dict[tuple[int, int], list[tuple[int, int]]] = {}
        for doc, tag, start, end in every.tolist():
            of_doc.setdefault((doc, tag), []).append((start, end))
        rows = []
        for doc, tag, copies, text in zip(*(left.column(c).to_pylist() for c in ("doc", "tag", "copies")), left.column("data"), strict=True):
            data, cuts = text.as_buffer(), of_doc.get((doc, tag), [])
            at, kept = 0, []
            for start, end in cuts:
                kept.append(data[at:start].to_pybytes())
                at = end
            kept.append(data[at:].to_pybytes())
            row = (doc, len(data), sum(b - a for a, b in cuts), [{"start": a, "end": b} for a, b in cuts], b"".join(kept))
            rows += [row] * copies
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(schema)], schema=schema)

    return docs.groupBy("bucket").cogroup(spans.groupBy("bucket")).applyInArrow(run, RESULT)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50) -> DataFrame:
    """``doc, n_bytes, n_removed, spans, kept`` for each row of ``docs``: the text's UTF-8 bytes
    without those that a string of ``length`` bytes covers which also starts in a document with
    a smaller id. Strings are judged on the input, and never cross documents.

    A null or empty text has no bytes. Repeated rows give the same row again. Rows of one id with
    different texts are told apart, and none is earlier than another. A row without an id is
    neither before nor after any and stays whole. An empty table gives an empty result; other
    columns are not looked at. ``length`` must be at least ``GRAM``.
    """
    if length < GRAM:
        raise ValueError(f"length must be {GRAM} or more")
    common.importable(docs.sparkSession)
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary").alias("data"))
    size, twice = rows.agg(F.sum(F.octet_length("data")), F.count("doc") - F.count_distinct("doc")).first()
    n = max(1, (size or 0) // BUCKET)
    named = rows.where("doc IS NOT NULL")
    if twice:  # tell rows of one id apart by their texts, and tell exact repeats once
        tag = F.xxhash64("data").bitwiseAND(F.lit(0xFFFFFFFF))
        named = named.withColumn("tag", tag).groupBy("doc", "tag", "data").agg(F.count("*").alias("copies"))
    else:
        named = named.select("doc", "data", F.lit(0).cast("long").alias("tag"), F.lit(1).cast("long").alias("copies"))
    met = common.stored(meet(cut(named, length, n), length, n))
    placed = named.select(bucket_of("doc", n).alias("bucket"), "doc", "tag", "copies", "data")
    fetched = fetch(placed, met.where(F.col("kind") == A_WANTED), length, n)
    spans = met.where(F.col("kind") == A_SPAN).unionByName(resolve(fetched, length, n))
    unnamed = rows.where("doc IS NULL").select(
        "doc",
        F.octet_length("data").cast("long").alias("n_bytes"),
        F.lit(0).cast("long").alias("n_removed"),
        F.array().cast("array<struct<start: long, end: long>>").alias("spans"),
        F.col("data").alias("kept"),
    )
    return apply(placed, spans).unionByName(unnamed)
