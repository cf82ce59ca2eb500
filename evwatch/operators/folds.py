"""CUSUM as a fold over time that many tasks share.

S = max(0, S + x - k), back to 0 once S reaches h. What a slice of time makes of the S that it gets
needs few numbers. Until something happens, S moves along with the sums of x - k. A record high of
these sums is where some S reaches h; a record low is where some S falls to 0 and from there on is
what it would be had the slice begun with 0. So records, and what follows from 0 after each high,
tell the S that leaves the slice for any S that enters it. Slices are summed up side by side, a key's
slices are chained (few rows), and each slice is folded from the S that enters it.

The S that leaves a slice is that of the fold to the last bit, unless neither happens in a slice,
where it is S plus the slice's sum and may differ in rounding.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evwatch.tables import importable, stored

Pair = tuple[float, float]
#: Of a slice: record highs, their places and what follows; record lows and their places; the sum; what follows from 0.
SUMMARY = "highs array<double>, high_at array<int>, then array<double>, lows array<double>, low_at array<int>, total double, from_zero double"


def step(s: float, x: float, k: float, h: float) -> tuple[float, float]:
    """S as told, and as it goes on."""
    s = max(0.0, s + x - k)
    return s, 0.0 if s >= h else s


def after(xs: list[float], k: float, h: float, s: float = 0.0) -> float:
    for x in xs:
        s = max(0.0, s + x - k)
        if s >= h:
            s = 0.0
    return s


def summed(xs: list[float], k: float, h: float) -> dict:
    highs, high_at, lows, low_at = [], [], [], []
    most, least = float("-inf"), 0.0
    sums = list(accumulate(x - k for x in xs))
    for i, p in enumerate(sums):
        if p > most:
            most = p
            if p > 0:
                highs.append(p)
                high_at.append(i)
        if p < least:
            least = p
            lows.append(-p)
            low_at.append(i)
        if most >= h or least <= -h:  # whatever came in, something has happened
            break
    then = [after(xs[i + 1 :], k, h) for i in high_at]
    return {"highs": highs, "high_at": high_at, "then": then, "lows": lows, "low_at": low_at, "total": sums[-1] if sums else 0.0, "from_zero": after(xs, k, h)}


def carried(s: float, h: float, of: dict) -> float:
    """The S that leaves a slice which S = ``s`` enters."""
    if s <= 0:
        return of["from_zero"]
    high, low = bisect_left(of["highs"], h - s), bisect_left(of["lows"], s)
    up = of["high_at"][high] if high < len(of["highs"]) else None
    down = of["low_at"][low] if low < len(of["lows"]) else None
    if up is None and down is None:
        return s + of["total"]
    if down is None or up is not None and up < down:
        return of["then"][high]
    return of["from_zero"]


def grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[object, object, list]]:
    """Rows of sorted batches by key and slice, where a group may go on in the next batch."""
    now, rows = None, []
    for batch in batches:
        for key, piece, row in zip(batch.column("key").to_pylist(), batch.column("slice").to_pylist(), batch.column("x").to_pylist(), strict=True):
            if now != (key, piece):
                if now is not None:
                    yield *now, rows
                now, rows = (key, piece), []
            rows.append(row)
    if now is not None:
        yield *now, rows


def carries(rows: DataFrame, pairs: list[Pair], kind: str) -> DataFrame:
    """``(key, slice, carry)`` for each slice but a key's first: the S of each pair that enters it.
    ``rows`` are dealt and sorted by key and slice."""
    struct = pa.struct([("highs", pa.list_(pa.float64())), ("high_at", pa.list_(pa.int32())), ("then", pa.list_(pa.float64())), ("lows", pa.list_(pa.float64())), ("low_at", pa.list_(pa.int32())), ("total", pa.float64()), ("from_zero", pa.float64())])

    def summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, slices, told = [], [], []

        def batch() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, KEY), pa.array(slices, pa.int64()), pa.array(told, pa.list_(struct))], ["key", "slice", "x"])

        KEY = None
        for key, piece, xs in grouped(batches):
            if KEY is None:
                KEY = pa.string() if kind == "string" else pa.array([key]).type if key is not None else None
            xs = [x for x in xs if x is not None]
            keys.append(key)
            slices.append(piece)
            told.append([summed(xs, k, h) for k, h in pairs])
            if len(keys) == 1000:
                yield batch()
                keys, slices, told = [], [], []
        if keys:
            yield batch()

    def chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, first = object(), [], True
        for batch in batches:
            keys, slices, out = [], [], []
            for key, piece, told in zip(*(batch.column(c).to_pylist() for c in ("key", "slice", "x")), strict=True):
                first = first or key != now
                if first:
                    now, state, first = key, [0.0] * len(pairs), False
                else:
                    keys.append(key)
                    slices.append(piece)
                    out.append(state)
                state = [carried(s, h, of) for s, (_, h), of in zip(state, pairs, told, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, batch.schema.field("key").type), pa.array(slices, pa.int64()), pa.array(out, pa.list_(pa.float64()))], ["key", "slice", "carry"])

    of_slices = rows.mapInArrow(summaries, f"key {kind}, slice long, x array<struct<{SUMMARY.replace(' array', ': array').replace(' double', ': double')}>>")
    by_key = of_slices.repartition("key").sortWithinPartitions("key", "slice")
    return by_key.mapInArrow(chained, f"key {kind}, slice long, carry array<double>")


def cusum_rows(values: DataFrame, pairs: list[Pair], by: str, ts: str, x: str, tie: str | None, slice_s: int | None) -> DataFrame:
    """``key, ts, told`` of each row of ``values``, an array of S for the pairs in their order; ``slice_s`` seconds
    of a key's time are one task's, all of it without."""
    importable(values.sparkSession)
    usable = F.when(~F.isnan(x) & (F.abs(x) != float("inf")), F.col(x).cast("double"))
    piece = F.lit(0).cast("long") if slice_s is None else F.floor(F.col(ts) / slice_s).cast("long")
    order = ["key", "slice", F.col("ts").asc_nulls_first(), *(["tie"] if tie else []), F.col("x").asc_nulls_first()]
    rows = values.select(F.col(by).alias("key"), piece.alias("slice"), F.col(ts).alias("ts"), *([F.col(tie).alias("tie")] if tie else []), usable.alias("x"))
    kinds = dict(rows.dtypes)
    if slice_s is not None:
        rows = stored(rows)  # read for the summaries and for the fold
    dealt = rows.repartition("key", "slice")
    entering = F.lit(None).cast("array<double>")
    rows = dealt.withColumn("carry", entering)
    if slice_s is not None:
        begun = carries(dealt.sortWithinPartitions(*order), pairs, kinds["key"])
        rows = rows.unionByName(begun, allowMissingColumns=True).repartition("key", "slice")
    # A slice's first row is the S that enters it, where there is one.
    rows = rows.sortWithinPartitions("key", "slice", F.col("carry").isNull(), *order[2:])

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = object(), []
        for batch in batches:
            keys, slices, xs, entered = (batch.column(c).to_pylist() for c in ("key", "slice", "x", "carry"))
            told: list[list[float | None]] = []
            kept = []
            for i, (key, piece, value, carry) in enumerate(zip(keys, slices, xs, entered, strict=True)):
                if now != (key, piece):
                    now, state = (key, piece), [0.0] * len(pairs)
                if carry is not None:
                    state = carry
                    continue
                kept.append(i)
                if value is None:
                    told.append([None] * len(pairs))
                    continue
                steps = [step(s, value, k, h) for s, (k, h) in zip(state, pairs, strict=True)]
                told.append([s for s, _ in steps])
                state = [then for _, then in steps]
            rest = batch.select(["key", "ts"]).take(pa.array(kept, pa.int64()))
            yield pa.RecordBatch.from_arrays([rest.column(0), rest.column(1), pa.array(told, pa.list_(pa.float64()))], ["key", "ts", "told"])

    return rows.mapInArrow(fold, f"key {kinds['key']}, ts {kinds['ts']}, told array<double>")
