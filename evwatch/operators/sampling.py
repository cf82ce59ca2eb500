"""Quiet windows: which bars are quiet, anchors by tiling, seeded draws, the evaluation frame."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evwatch.operators.joins import asof, laid_before


def mark_quiet(bars: DataFrame, filings: DataFrame, gap_s: int) -> DataFrame:
    """``quiet``: over ``gap_s`` from the filing before and from the one after; ``filings``: ticker, at."""
    out = asof(bars, filings, "ticker", "ts_utc", "at", {"__before": F.col("at")})
    out = asof(out, filings, "ticker", "ts_utc", "at", {"__after": F.col("at")}, "forward")
    far = lambda d: F.coalesce(d > gap_s, F.lit(True))
    return out.withColumn("quiet", far(F.col("ts_utc") - F.col("__before")) & far(F.col("__after") - F.col("ts_utc"))).drop("__before", "__after")


def anchors(marked: DataFrame, horizon: int, least_base: int) -> DataFrame:
    """Anchors of quiet windows. In each run of quiet bars the first is the run's ``horizon``-th
    bar after its start, at least ``horizon + least_base`` bars into the ticker's history, and
    each further one ``horizon + 1`` bars on."""
    of = Window.partitionBy("ticker").orderBy("ts_utc")
    numbered = marked.withColumn("__i", F.row_number().over(of) - 1)
    loud = F.max(F.when(~F.col("quiet"), F.col("__i"))).over(of.rowsBetween(Window.unboundedPreceding, 0))
    first = F.greatest(F.coalesce(loud, F.lit(-1)) + 1 + horizon, F.lit(least_base + horizon))
    numbered = numbered.withColumn("__first", first)
    hit = F.col("quiet") & (F.col("__i") >= F.col("__first")) & ((F.col("__i") - F.col("__first")) % (horizon + 1) == 0)
    return numbered.where(hit).select("ticker", F.col("ts_utc").alias("anchor_utc"))


def draw(pool: DataFrame, n: int, seed: int) -> DataFrame:
    """``n`` anchors without replacement, the same for the same seed however rows are dealt; a
    smaller draw is part of a larger one."""
    key = F.md5(F.concat_ws("|", "ticker", "anchor_utc", F.lit(seed)))
    return pool.withColumn("__key", key).orderBy("__key", "ticker", "anchor_utc").limit(n).drop("__key")


def eval_frame(bars: DataFrame, events: DataFrame, horizon: int, low: int, high: int) -> DataFrame:
    """Positive windows, ``horizon`` bars before each usable event of [low, high), and every other
    bar of the range as a window of its own. ``events``: ticker, event_id, t0_utc, is_scheduled, items.

    Bars and events are laid in one order once; which bars no event has follows from it too."""
    anchors_ = events.where((F.col("t0_utc") >= low) & (F.col("t0_utc") < high)).select("ticker", "event_id", "t0_utc", "is_scheduled", "items")
    laid = laid_before(bars.select("ticker", "ts_utc", "volume_z"), anchors_, horizon, anchor_ts="t0_utc")
    single = F.when((F.col("__ts") >= low) & (F.col("__ts") < high) & ~F.col("__taken"), F.array("__bar"))
    rows = laid.select("ticker", "__anchor", F.explode(F.when(F.col("__bar").isNull(), F.col("__bars")).otherwise(single)).alias("__bar"))
    named = F.when(F.col("__anchor").isNull(), F.concat_ws(":", F.lit("bar"), "ticker", "__bar.ts_utc")).otherwise(F.concat(F.lit("event:"), "__anchor.event_id"))
    return rows.select(named.alias("window_id"), "ticker", "__bar.ts_utc", "__anchor.t0_utc", "__anchor.is_scheduled", F.col("__anchor.items").alias("item_code"), "__bar.volume_z")
