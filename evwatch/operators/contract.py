"""The prediction contract: conforming, checking, and turning scores into actions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evwatch.schemas import TABLES
from evwatch.tables import stored

COLUMNS = dict(c.split() for c in TABLES["predictions"].split(", "))
ACTIONS = ("WAIT", "FLAG")
PER_WINDOW = ("t0_utc", "ticker", "is_scheduled", "item_code")


def conform(df: DataFrame) -> DataFrame:
    """The contract's columns, in its types and order; all others are left behind."""
    if absent := sorted({*COLUMNS} - {*df.columns}):
        raise ValueError(f"predictions lack {absent}")
    return df.select(*(F.col(c).cast(kind) for c, kind in COLUMNS.items()))


def violations(df: DataFrame) -> DataFrame:
    """Windows that break a rule, with the rule. Times of a window are ranked, so that one that is there
    twice is told by the same grouping."""
    required = ("window_id", "ticker", "ts_utc", "score", "action")
    null = F.lit(False)
    for c in required:
        null = null | F.col(c).isNull()
    # min and max skip nulls, so a null beside a value is counted as a value of its own.
    varied = {c: (F.coalesce(F.min(c) != F.max(c), F.lit(False))) | ((F.count(c) > 0) & (F.count(c) < F.count("*"))) for c in PER_WINDOW}
    labelled = F.max(F.col("t0_utc").isNotNull())
    rules = {
        "null in a required column": F.max(null),
        "score is not finite": F.max(F.coalesce(F.isnan("score") | (F.abs("score") == float("inf")), F.lit(False))),
        **{f"{c} differs within a window": v for c, v in varied.items()},
        "is_scheduled is not null exactly with t0": F.max(F.col("is_scheduled").isNull() != F.col("t0_utc").isNull()),
        "item_code is not null exactly with t0": F.max(F.col("item_code").isNull() != F.col("t0_utc").isNull()),
        "unknown action": F.max(~F.coalesce(F.col("action").isin(*ACTIONS), F.lit(False))),
        "more than one FLAG": F.count(F.when(F.col("action") == "FLAG", 1)) > 1,
        "a row after t0": F.max(F.coalesce(F.col("ts_utc") > F.col("t0_utc"), F.lit(False))) & labelled,
        "repeated (window_id, ts_utc)": F.count("*") > F.max("__nth"),
    }
    df = df.withColumn("__nth", F.dense_rank().over(Window.partitionBy("window_id").orderBy("ts_utc")))
    checked = df.groupBy("window_id").agg(F.array_compact(F.array(*(F.when(v, F.lit(k)) for k, v in rules.items()))).alias("broken"))
    return checked.select("window_id", F.explode("broken").alias("rule"))


def validated(df: DataFrame) -> DataFrame:
    """``df``, or an error that names up to five windows that break a rule, or that it is empty."""
    if df.isEmpty():
        raise ValueError("no predictions")
    bad = violations(df).limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r.window_id}: {r.rule}" for r in bad))
    return df


def first_crossing(df: DataFrame, threshold: Column) -> Column:
    """FLAG at the first row of a window whose score reaches the threshold, else WAIT."""
    at = F.min(F.when(F.col("score") >= threshold, F.col("ts_utc"))).over(Window.partitionBy("window_id"))
    return F.when(F.col("ts_utc") == at, "FLAG").otherwise("WAIT")


def minimum_wait(df: DataFrame, days: DataFrame, hours: float) -> DataFrame:
    """A FLAG within ``hours`` trading hours of its window's start becomes WAIT."""
    from evwatch.functions.timecal import trading_hours

    begun = df.withColumn("__start", F.min("ts_utc").over(Window.partitionBy("window_id")))
    waited = trading_hours(begun, days, "__start", "ts_utc", "__waited")
    early = (F.col("action") == "FLAG") & (F.col("__waited") < hours)
    return waited.withColumn("action", F.when(early, "WAIT").otherwise(F.col("action"))).drop("__start", "__waited")


def floored(df: DataFrame, policy: str = "floor", keep: bool = True) -> DataFrame:
    """Scores that aren't finite one below the least finite score of the frame, 0 if there is none;
    with policy ``error`` a window without any finite score raises. Without ``keep``, ``df`` is cheap to read
    twice and isn't stored."""
    from evwatch.functions.scalars import finite

    if policy == "error":
        alive = F.max(finite(F.col("score")).isNotNull()).over(Window.partitionBy("window_id"))
        told = F.raise_error(F.concat(F.lit("no finite score in "), "window_id")).cast("double")
        df = df.withColumn("__alive", alive).withColumn("score", F.when(F.col("__alive"), F.col("score")).otherwise(told)).drop("__alive")
    if keep:
        df = stored(df)  # read for the floor and for the rows
    least = df.agg(F.coalesce(F.min(finite(F.col("score"))) - 1, F.lit(0.0)).alias("__floor"))
    return df.join(F.broadcast(least)).withColumn("score", F.coalesce(finite(F.col("score")), F.col("__floor"))).drop("__floor")  # one row


def payoffs(df: DataFrame, wait: float, correct: float, early: float, false: float, missed: float) -> DataFrame:
    """The stopping payoff of each window's decisions."""
    of = Window.partitionBy("window_id").orderBy("ts_utc")
    steps = df.withColumn("__step", F.row_number().over(of) - 1)
    by = steps.groupBy("window_id").agg(F.count("*").alias("n"), F.min(F.when(F.col("action") == "FLAG", F.col("__step"))).alias("s"), F.max(F.col("t0_utc").isNotNull()).alias("positive"))
    n, s = F.col("n"), F.col("s")
    hit = correct + early * (n - 1 - s) / F.greatest(n - 1, F.lit(1))
    flagged = s * wait + F.when(F.col("positive"), hit).otherwise(false)
    silent = (n - 1) * wait + F.when(F.col("positive"), missed).otherwise(0.0)
    return by.select("window_id", "n", F.coalesce(flagged, silent).alias("payoff"))


def episodes(df: DataFrame, features: list[str]) -> DataFrame:
    """Rows of a window as arrays in order of time."""
    rows = F.sort_array(F.collect_list(F.struct("ts_utc", F.array(*features).alias("x"))))
    out = df.groupBy("window_id").agg(F.min("ticker").alias("ticker"), F.min("t0_utc").alias("t0_utc"), rows.alias("rows"))
    return out.select("window_id", "ticker", "t0_utc", F.col("t0_utc").isNotNull().alias("is_positive"), F.col("rows.ts_utc").alias("ts"), F.col("rows.x").alias("x"))
