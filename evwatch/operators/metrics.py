"""Metrics at a fixed alert budget, slices that share their negatives, calibration, delays."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evwatch.functions.scalars import kept_items, parse_items
from evwatch.operators.ranks import cumulated, interpolated
from evwatch.tables import stored


def window_summary(df: DataFrame) -> DataFrame:
    """A row per window: a positive one by its last bar, a quiet one by its highest."""
    last = F.max_by("score", "ts_utc")
    positive = F.max(F.col("t0_utc").isNotNull())
    return df.groupBy("window_id").agg(
        F.min("ticker").alias("ticker"), positive.alias("is_positive"), F.when(positive, last).otherwise(F.max("score")).alias("peak"),
        F.max("is_scheduled").alias("is_scheduled"), F.max("item_code").alias("item_code"),
    )


def ticker_months(df: DataFrame) -> DataFrame:
    """One row, ``n``: the months in which a ticker has rows, over all tickers."""
    month = F.date_trunc("month", F.timestamp_seconds("ts_utc"))
    return df.select("ticker", month.alias("m")).distinct().agg(F.count("*").alias("n"))


def alert_budget(df: DataFrame, rate: float, most: int | None = None) -> DataFrame:
    """One row, ``budget``: half-up rounding of the rate by ticker and month, or ``most``."""
    if most is not None:
        return df.sparkSession.range(1).select(F.lit(max(0, most)).cast("long").alias("budget"))
    return ticker_months(df).select(F.greatest(F.lit(0), F.floor(F.col("n") * F.lit(rate) + 0.5)).cast("long").alias("budget"))


def thresholds(summary: DataFrame, budget: Column) -> DataFrame:
    """One row, ``threshold``: the peak of the ``budget``-th window, or the least if there are no more; all
    ties at it will be alerts."""
    placed = cumulated(summary, "peak", descending=True)
    within = F.min(F.when(F.col("upto") - F.col("n") < budget, F.col("peak").cast("double")))
    few = F.coalesce(F.max("total"), F.lit(0)) <= budget
    return placed.agg(F.when(budget <= 0, float("inf")).when(few, float("-inf")).otherwise(within).alias("threshold"))


def threshold_at(summary: DataFrame, budget: int) -> float:
    """``thresholds`` as a number on the driver."""
    return thresholds(summary, F.lit(budget)).first()[0]


def budgeted(df: DataFrame, rate: float, most: int | None = None, summary: DataFrame | None = None) -> tuple[Column, Column]:
    """Budget and threshold of a frame as scalar subqueries: nothing is read on the driver, and no join
    is needed to bring them to the rows. ``summary``: its ``window_summary``, where that is at hand."""
    budget = stored(alert_budget(df, rate, most))
    return budget.scalar(), stored(thresholds(window_summary(df) if summary is None else summary, budget.scalar())).scalar()


def sliced(summary: DataFrame, excluded: tuple[str, ...]) -> DataFrame:
    """Positive windows once for each of their slices, quiet ones once for every slice: quiet rows
    are counted once and joined to the slices, so none of them is repeated."""
    codes = F.array_distinct(kept_items(parse_items(F.col("item_code")), excluded))
    kind = F.when(F.col("is_scheduled"), "scheduled").otherwise("unscheduled")
    names = F.concat(F.array(F.lit("all"), kind), F.transform(codes, lambda c: F.concat(F.lit("item "), c)))
    return summary.where("is_positive").withColumn("slice", F.explode(names))


def report(df: DataFrame, threshold: float | Column, excluded: tuple[str, ...]) -> DataFrame:
    """Precision, recall, ceiling and base rate by slice at one threshold."""
    return summary_report(stored(window_summary(df)), threshold, excluded)


def summary_report(summary: DataFrame, threshold: float | Column, excluded: tuple[str, ...]) -> DataFrame:
    """``report`` of the windows of ``window_summary``."""
    alert = (F.col("peak") >= threshold).cast("int")
    hits = sliced(summary, excluded).groupBy("slice").agg(F.count("*").alias("n_positive"), F.sum(alert).alias("true_positives"))
    quiet = summary.where("NOT is_positive").agg(F.count("*").alias("n_quiet"), F.coalesce(F.sum(alert), F.lit(0)).alias("false_positives"))
    rows = hits.join(F.broadcast(quiet))  # one row
    alerts = F.col("true_positives") + F.col("false_positives")
    n = F.col("n_positive") + F.col("n_quiet")
    return rows.select(
        "slice", n.alias("windows"), "n_positive", alerts.alias("alerts"), "true_positives",
        F.when(alerts > 0, F.col("true_positives") / alerts).alias("precision"),
        F.when(alerts > 0, F.least("n_positive", alerts) / alerts).alias("ceiling"),
        (F.col("true_positives") / F.col("n_positive")).alias("recall"),
        (F.col("n_positive") / n).alias("base_rate"),
    )


def with_lift(table: DataFrame, floor: DataFrame) -> DataFrame:
    """Lift of each slice's precision over that of the constant detector."""
    return table.join(floor.select("slice", F.col("precision").alias("floor")), "slice", "left").withColumn("lift", F.when(F.col("floor") > 0, F.col("precision") / F.col("floor")))


def variant_gap(table: DataFrame, metric: str, first: str, second: str) -> DataFrame:
    by = table.groupBy("slice").pivot("variant", [first, second]).agg(F.first(metric))
    return by.select("slice", (F.col(first) - F.col(second)).alias("gap"))


def delays(df: DataFrame, days: DataFrame) -> DataFrame:
    """Lead of each FLAG on a positive window, in trading hours and by the wall clock."""
    from evwatch.functions.timecal import trading_hours

    flags = df.where("action = 'FLAG' AND t0_utc IS NOT NULL")
    return trading_hours(flags, days, "ts_utc", "t0_utc", "lead_trading_h").withColumn("lead_wall_h", (F.col("t0_utc") - F.col("ts_utc")) / 3600.0)


def delay_summary(df: DataFrame, days: DataFrame) -> DataFrame:
    found = stored(delays(df, days).select("lead_trading_h"))
    ends = found.agg(F.count("*").alias("detections"), F.min("lead_trading_h").alias("least"), F.max("lead_trading_h").alias("most"))
    quarters = interpolated(found, "lead_trading_h", {"p25": 0.25, "p50": 0.5, "p75": 0.75})
    positives = df.where("t0_utc IS NOT NULL").agg(F.count_distinct("window_id").alias("positives")).scalar()
    part = {c: quarters.select(c).scalar().alias(c) for c in ("p25", "p50", "p75")}
    return ends.select("detections", positives.alias("positives"), (positives - F.col("detections")).alias("missed"), *part.values(), "least", "most")


def checked_probability(score):
    return F.when((score < 0) | (score > 1), F.raise_error(F.lit("scores are no probabilities")).cast("double")).otherwise(score)


def brier(df: DataFrame) -> DataFrame:
    y, p = F.col("t0_utc").isNotNull().cast("double"), checked_probability(F.col("score"))
    out = df.agg(F.avg((p - y) * (p - y)).alias("brier"), F.avg(y).alias("rate"))
    base = F.col("rate") * (1 - F.col("rate"))
    return out.select("brier", base.alias("baseline"), F.when(base > 0, 1 - F.col("brier") / base).alias("skill"))


def reliability(df: DataFrame, bins: int) -> DataFrame:
    p = checked_probability(F.col("score"))
    return df.groupBy(F.least(F.floor(p * bins), F.lit(bins - 1)).alias("bin")).agg(
        F.count("*").alias("n"), F.avg("score").alias("predicted"), F.avg(F.col("t0_utc").isNotNull().cast("double")).alias("actual")
    )


def calibration_error(curve: DataFrame) -> DataFrame:
    return curve.agg((F.sum(F.abs(F.col("actual") - F.col("predicted")) * F.col("n")) / F.sum("n")).alias("ece"))


def action_counts(df: DataFrame) -> DataFrame:
    flag = F.col("action") == "FLAG"
    return df.agg(
        F.count_if(~flag).alias("wait_hours"), F.count_if(flag).alias("flag_hours"), F.avg(flag.cast("double")).alias("share_flagged"),
        (F.count_distinct(F.when(flag, F.col("window_id"))) / F.count_distinct("window_id")).alias("share_alerted"),
    )


def fingerprint(df: DataFrame) -> DataFrame:
    """Rows, windows and an order-free digest of the window ids: a sum of hashes, so that the ids
    are never gathered. It is told modulo 2^63, as that of many windows is beyond a long."""
    ids = df.groupBy("window_id").agg(F.count("*").alias("n"), F.max(F.col("t0_utc").isNotNull()).alias("positive"))
    part = F.conv(F.substring(F.md5("window_id"), 1, 12), 16, 10).cast("decimal(15,0)")
    digest = (F.sum(part) % F.lit(Decimal(1 << 63))).cast("long")
    return ids.agg(F.sum("n").alias("rows"), F.count("*").alias("windows"), F.count_if("positive").alias("positive_windows"), digest.alias("digest"))


def null_audit(df: DataFrame, columns: list[str]) -> DataFrame:
    """Nulls and values that aren't finite, by column."""
    counts = df.agg(F.count("*").alias("rows"), *(F.count_if(F.col(c).isNull()).alias(f"n:{c}") for c in columns), *(F.count_if(F.isnan(c) | (F.abs(c) == float("inf"))).alias(f"f:{c}") for c in columns))
    each = [F.struct(F.lit(c).alias("column"), F.col(f"n:{c}").alias("nulls"), F.col(f"f:{c}").alias("not_finite")) for c in columns]
    return counts.select("rows", F.inline(F.array(*each)))
