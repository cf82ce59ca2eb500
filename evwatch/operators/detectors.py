"""Detectors: each gives a score column, or a frame with one where rows depend on rows before.

To add one, subclass ``Detector`` and register it; ``predict`` does the rest.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evwatch.config import DAY
from evwatch.functions.scalars import clean_observation
from evwatch.functions.timecal import sealed_guard, trading_hours
from evwatch.operators import contract, folds, ranks
from evwatch.tables import stored

#: Seconds of a key's time that one task folds.
SLICE = 30 * DAY

REGISTRY: dict[str, type[Detector]] = {}


def register(name: str):
    def add(cls: type[Detector]) -> type[Detector]:
        REGISTRY[name] = cls
        return cls

    return add


class Detector:
    threshold: float = float("inf")

    def score_column(self) -> Column:
        raise NotImplementedError

    def score(self, frame: DataFrame) -> DataFrame:
        return frame.withColumn("score", self.score_column())

    columns: tuple[str, ...] = ()  # features that scores are made of

    def predict(self, frame: DataFrame, threshold: float | None = None, sealed: tuple[int, int] | None = None, wait: tuple[DataFrame, float] | None = None, unscoreable: str = "floor") -> DataFrame:
        """``frame`` (window_id, ticker, ts_utc, t0_utc, is_scheduled, item_code, features) as
        conforming predictions. Rows in a ``sealed`` period raise; with ``wait``, a clock and trading
        hours, flags sooner after a window's start are taken back. What breaks the contract is for
        ``contract.validated`` to tell."""
        if absent := sorted({*self.columns} - {*frame.columns}):
            raise ValueError(f"the frame lacks {absent}")
        if sealed:
            frame = sealed_guard(frame, "ts_utc", *sealed)
        plain = type(self).score is Detector.score and unscoreable == "floor"  # an expression over the frame, which is stored once for all
        scored = self.score(stored(frame) if plain else frame)
        scored = contract.floored(scored.withColumn("score", F.col("score").cast("double")), unscoreable, keep=not plain)
        at = F.lit(self.threshold if threshold is None else threshold)
        acted = scored.withColumn("action", contract.first_crossing(scored, at))
        return contract.conform(contract.minimum_wait(acted, *wait) if wait else acted)


@register("constant")
class Constant(Detector):
    """One score everywhere; never flags."""

    def score_column(self) -> Column:
        return F.lit(0.0)


@register("random")
class Noise(Detector):
    """Uniform by row and seed, however the rows are dealt."""

    def __init__(self, seed: int = 42):
        self.seed = seed

    def score_column(self) -> Column:
        digest = F.md5(F.concat_ws("|", "window_id", "ts_utc", F.lit(self.seed)))
        return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / float(16**12)


@register("volume_z")
class VolumeZ(Detector):
    columns = ("volume_z",)

    def __init__(self, threshold: float = 2.648):
        self.threshold = threshold

    def score_column(self) -> Column:
        return F.col("volume_z")


def cusum(values: DataFrame, k: float, h: float, by: str = "ticker", ts: str = "ts_utc", x: str = "volume_z", tie: str | None = None, slice_s: int | None = SLICE) -> DataFrame:
    """S = max(0, S + x - k) along each key; S is told before it falls back to 0 at h, a null or
    infinite x tells null and keeps S."""
    if h < k:
        raise ValueError("h must not be below k")
    return cusum_grid(values, [(k, h)], by, ts, x, tie, slice_s).drop("k", "h")


def cusum_grid(values: DataFrame, grid: list[tuple[float, float]], by: str = "ticker", ts: str = "ts_utc", x: str = "volume_z", tie: str | None = None, slice_s: int | None = SLICE) -> DataFrame:
    """``k, h`` and the CUSUM of ``cusum`` for each legal pair of the grid (h not below k). A key's rows are
    folded in slices of ``slice_s`` seconds, which are different tasks'; see ``folds``."""
    pairs = legal(grid)
    out = folds.cusum_rows(values, pairs, by, ts, x, tie, slice_s)
    each = F.inline(by_pair(pairs, lambda i: F.col("told")[i].alias("cusum")))
    return out.select(each, F.col("key").alias(by), F.col("ts").alias(ts)).select("k", "h", by, ts, "cusum")


def legal(grid: list[tuple[float, float]]) -> list[tuple[float, float]]:
    pairs = [(float(k), float(h)) for k, h in grid if h >= k]
    if not pairs:
        raise ValueError("no pair with h at or over k")
    return pairs


def by_pair(pairs: list[tuple[float, float]], *told: Callable[[int], Column]) -> Column:
    """An array with a struct for each pair: ``k``, ``h`` and what is told of the pair's place."""
    return F.array(*(F.struct(F.lit(k).alias("k"), F.lit(h).alias("h"), *(f(i) for f in told)) for i, (k, h) in enumerate(pairs)))


def tune_cusum(frame: DataFrame, grid: list[tuple[float, float]], budget: int, days: DataFrame) -> DataFrame:
    """For each legal pair: the threshold that ``budget`` alerts give (ties admitted), their precision, and
    the middle lead in trading hours of positive windows at their first crossing. The best first: by
    precision, then the longer lead (none last), then smaller k, then smaller h. ``frame``: window_id, ticker,
    ts_utc, t0_utc, volume_z.

    Thresholds and medians of all pairs come from one range partitioning each; no task holds a pair. Rows
    travel once with the sums of all pairs, which become rows of their own once windows are summed up.
    """
    frame, pairs = stored(frame), legal(grid)
    told = folds.cusum_rows(frame.select("ticker", "ts_utc", "volume_z").distinct(), pairs, "ticker", "ts_utc", "volume_z", None, SLICE)
    told = told.select(F.col("key").alias("ticker"), F.col("ts").alias("ts_utc"), "told")
    rows = stored(frame.select("window_id", "ticker", "ts_utc", "t0_utc").join(told, ["ticker", "ts_utc"]))
    most = (F.max(F.col("told")[i]).alias(f"most_{i}") for i in range(len(pairs)))
    windows = rows.groupBy("window_id").agg(F.max(F.col("t0_utc").isNotNull()).alias("positive"), F.max_by("told", "ts_utc").alias("last"), *most)
    peak = lambda i: F.when(F.col("positive"), F.col("last")[i]).otherwise(F.col(f"most_{i}")).alias("peak")
    peaks = windows.select("positive", F.inline(by_pair(pairs, peak))).where("peak IS NOT NULL")
    peaks = stored(peaks)
    cut = ranks.cumulated(peaks, "peak", ["k", "h"], descending=True).groupBy("k", "h").agg(F.min(F.when(F.col("upto") - F.col("n") < budget, F.col("peak"))).alias("threshold"))
    cut = stored(cut)  # a row for each pair
    alerts = peaks.join(cut, ["k", "h"]).where(F.col("peak") >= F.col("threshold"))
    out = alerts.groupBy("k", "h").agg(F.first("threshold").alias("threshold"), F.count("*").alias("alerts"), F.avg(F.col("positive").cast("double")).alias("precision"))
    each = F.inline(by_pair(pairs, lambda i: F.col("told")[i].alias("cusum")))
    crossed = rows.where("t0_utc IS NOT NULL").select("window_id", "ts_utc", "t0_utc", each).join(F.broadcast(cut), ["k", "h"]).where(F.col("cusum") >= F.col("threshold"))
    first = crossed.groupBy("k", "h", "window_id").agg(F.min("ts_utc").alias("ts_utc"), F.max("t0_utc").alias("t0_utc"))
    leads = trading_hours(first, days, "ts_utc", "t0_utc", "lead_trading_h")
    out = out.join(ranks.interpolated(leads, "lead_trading_h", {"median_lead_h": 0.5}, ["k", "h"]), ["k", "h"], "left")
    return out.orderBy(F.col("precision").desc(), F.col("median_lead_h").desc_nulls_last(), "k", "h")


def cusum_no_reset(values: DataFrame, k: float, by: str = "ticker", ts: str = "ts_utc", x: str = "volume_z") -> DataFrame:
    """The same without falling back: C - min(0, min C) of the running sum C, in two windows."""
    order = Window.partitionBy(by).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    out = values.withColumn("__c", F.sum(F.when(F.col(x).isNotNull(), F.col(x) - k)).over(order))
    told = F.col("__c") - F.least(F.lit(0.0), F.min("__c").over(order))
    return out.withColumn("cusum", F.when(F.col(x).isNotNull(), told)).drop("__c")


@register("cusum")
class Cusum(Detector):
    columns = ("volume_z",)

    def __init__(self, k: float = 1.5, h: float = 1.5):
        self.k, self.threshold = k, h

    def score(self, frame: DataFrame) -> DataFrame:
        told = cusum(frame.select("ticker", "ts_utc", "volume_z").distinct(), self.k, self.threshold)
        return frame.join(told, ["ticker", "ts_utc"], "left").withColumn("score", F.col("cusum")).drop("cusum")


@register("trees")
class Trees(Detector):
    """Boosted trees of Spark ML; a missing value is a sentinel with a flag beside it."""

    threshold = 0.5

    def __init__(self, features: list[str], trees: int = 400, depth: int = 4, rate: float = 0.05, seed: int = 42):
        self.features, self.trees, self.depth, self.rate, self.seed, self.model = features, trees, depth, rate, seed, None

    def assembled(self, frame: DataFrame) -> DataFrame:
        from pyspark.ml.feature import VectorAssembler

        filled = frame.withColumns({f"__{c}": F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(-999.0)) for c in self.features} | {f"__{c}_null": F.col(c).isNull().cast("double") for c in self.features})
        inputs = [n for c in self.features for n in (f"__{c}", f"__{c}_null")]
        return VectorAssembler(inputCols=inputs, outputCol="__vector").transform(filled).drop(*inputs)

    def fit(self, frame: DataFrame) -> Trees:
        from pyspark.ml.classification import GBTClassifier

        rows = self.assembled(frame).withColumn("label", F.col("t0_utc").isNotNull().cast("double"))
        if rows.select("label").distinct().count() < 2:
            raise ValueError("training rows of one class only")
        self.model = GBTClassifier(featuresCol="__vector", maxIter=self.trees, maxDepth=self.depth, stepSize=self.rate, seed=self.seed).fit(rows)
        return self

    def score(self, frame: DataFrame) -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        out = self.model.transform(self.assembled(frame))
        return out.withColumn("score", vector_to_array("probability")[1]).drop("__vector", "rawPrediction", "probability", "prediction")


@register("policy")
class Policy(Detector):
    """A stored network of two tanh layers: P(FLAG) of each row, as an expression. ``weights`` are
    (matrix, bias) pairs of a few hundred numbers."""

    threshold = 0.5

    def __init__(self, features: list[str], weights: list[tuple[list[list[float]], list[float]]], clip: float = 10.0):
        self.features, self.weights, self.clip = features, weights, clip
        if len(weights[0][0][0]) != len(features):
            raise ValueError("the stored features differ")

    def score_column(self) -> Column:
        x = [clean_observation(F.col(c).cast("double"), self.clip) for c in self.features]
        array = F.array(*x)
        for i, (matrix, bias) in enumerate(self.weights):
            rows = F.array(*(F.array(*map(F.lit, row + [b])) for row, b in zip(matrix, bias, strict=True)))
            sums = dense(rows, F.concat(array, F.array(F.lit(1.0))))
            array = sums if i == len(self.weights) - 1 else F.transform(sums, lambda v: F.tanh(v))
        return 1 / (1 + F.exp(array[0] - array[1]))


def dense(rows: Column, given: Column) -> Column:
    return F.transform(rows, lambda w: F.aggregate(F.zip_with(w, given, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v))
