"""Event clocks, coverage, materiality, census."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evwatch.operators.joins import asof
from evwatch.operators.ranks import at_ranks, nearest_rank  # noqa: F401  the operators take them from here
from evwatch.tables import stored


def correct_t0(filings: DataFrame, news: DataFrame, lookback_s: int, max_tier: int | None, crawl_time: bool = False) -> DataFrame:
    """``filings`` with ``t0_news_utc`` (the earliest credible article in the lookback, ends
    included), ``t0_utc``, ``t0_source`` and ``fallback_reason``."""
    seen = F.coalesce("published_utc", "seen_utc") if crawl_time else F.col("published_utc")
    articles = news.where(F.col("source_tier") <= max_tier) if max_tier is not None else news
    articles = articles.select("ticker", seen.alias("at")).where("at IS NOT NULL")
    # The earliest in the lookback is the first from its start on, if that isn't past the filing.
    begun = filings.withColumn("__from", F.col("acceptance_utc") - lookback_s)
    first = asof(begun, articles, "ticker", "__from", "at", {"t0_news_utc": F.col("at")}, "forward").drop("__from")
    first = first.withColumn("t0_news_utc", F.when(F.col("t0_news_utc") <= F.col("acceptance_utc"), F.col("t0_news_utc")))
    known = news.select("ticker").distinct().withColumn("__known", F.lit(True))
    out = first.join(known, "ticker", "left")
    matched = F.col("t0_news_utc").isNotNull()
    reason = F.when(matched, F.lit(None)).when(F.col("__known"), "no_news_in_lookback").otherwise("no_news_for_ticker")
    return (
        out.withColumn("t0_utc", F.least("acceptance_utc", "t0_news_utc"))
        .withColumn("t0_source", F.when(matched, "news").otherwise("filing"))
        .withColumn("fallback_reason", reason)
        .drop("__known")
    )


def headline(matches: DataFrame, news: DataFrame) -> DataFrame:
    """The article at the matched second: a tier before none, then the lower tier, then the url."""
    order = F.struct(F.col("source_tier").isNull(), "source_tier", "url")
    at = news.select(F.col("ticker").alias("__t"), F.col("published_utc").alias("__at"), "url", "title", "source_tier")
    pairs = matches.where("t0_news_utc IS NOT NULL").join(at, (F.col("ticker") == F.col("__t")) & (F.col("t0_news_utc") == F.col("__at")))
    return pairs.groupBy("accession_no").agg(F.min_by("title", order).alias("title"), F.min_by("url", order).alias("url"))


def event_move(events: DataFrame, bars: DataFrame, benchmark: DataFrame, hours: int, bar_s: int = 3600) -> DataFrame:
    """``events`` (ticker, t0_utc) with the move from the last price before ``t0_utc`` to the first
    close ``hours`` after it, less the benchmark's where that has both prices, and a reason if
    there is none. ``benchmark``: ts_utc, open, close."""
    def price(ts: str, end: bool):
        return F.col("close") if end else F.when(F.col("ts_utc") + bar_s <= F.col(ts), F.col("close")).otherwise(F.col("open"))

    # Four as-of joins read them.
    bars, benchmark = stored(bars.select("ticker", "ts_utc", "open", "close")), stored(benchmark.select("ts_utc", "open", "close"))
    known = bars.select("ticker").distinct().withColumn("__known", F.lit(True))
    out = events.join(known, "ticker", "left").withColumn("__end", F.col("t0_utc") + hours * 3600).withColumn("__all", F.lit(0))
    market = benchmark.withColumn("__all", F.lit(0))
    for name, prices, by in (("own", bars, "ticker"), ("b", market, "__all")):
        # Of the benchmark's few rows as of the events', so its key is one for all; slices deal it.
        slices = None if by == "ticker" else 86400
        out = asof(out, prices, by, "t0_utc", "ts_utc", {f"__{name}_ts": F.col("ts_utc"), f"__{name}_o": F.col("open"), f"__{name}_c": F.col("close")}, slice_s=slices)
        whole = F.col(f"__{name}_ts") + bar_s <= F.col("t0_utc")
        out = out.withColumn(f"__{name}_0", F.when(whole, F.col(f"__{name}_c")).otherwise(F.col(f"__{name}_o")))
        out = asof(out, prices, by, "__end", "ts_utc", {f"__{name}_1": F.col("close")}, "forward", slice_s=slices)
    start, end = F.col("__own_0"), F.col("__own_1")
    own, both = end / start - 1, (F.col("__b_0") > 0) & (F.col("__b_1") > 0)
    priced = (start > 0) & (end > 0)
    move = F.when(priced & both, own - F.when(F.col("__b_0") > 0, F.col("__b_1") / F.col("__b_0") - 1)).when(priced, own)
    reason = F.when(F.col("__known").isNull(), "no_bars").when(~F.coalesce(start > 0, F.lit(False)), "no_pre_t0_bar").when(~F.coalesce(end > 0, F.lit(False)), "no_post_t0_bar")
    return out.withColumn("move", F.when(priced, move)).withColumn("move_reason", reason).drop(*(c for c in out.columns if c.startswith("__")))


def material(moved: DataFrame, least: float) -> DataFrame:
    """Whether the move's size reaches ``least``; upstream reasons stay."""
    reason = F.coalesce(F.col("move_reason"), F.when(F.abs("move") < least, "immaterial"))
    return moved.withColumn("is_material", (F.abs("move") >= least).cast("int")).withColumn("exclude_reason", reason).withColumn("usable", reason.isNull().cast("int"))


def announcements(events: DataFrame, gap_s: int) -> DataFrame:
    """Clusters by ticker: a new one where the gap is over ``gap_s``."""
    of = Window.partitionBy("ticker").orderBy("t0_utc")
    fresh = F.lag("t0_utc").over(of).isNull() | (F.col("t0_utc") - F.lag("t0_utc").over(of) > gap_s)
    return events.withColumn("fresh", fresh.cast("int")).groupBy("ticker").agg(F.sum("fresh").alias("announcements"), F.count("*").alias("events"))


def coverage(filings: DataFrame, bars: DataFrame, sessions: DataFrame, pad_before_s: int, pad_after_s: int, tolerance_s: int, least: float, window_start: int) -> DataFrame:
    """Session coverage of each filing's span and what is wrong with it, if anything.

    Sessions are few and are joined by their day's number: a filing's span is dealt to its days.
    """
    start = F.greatest(F.col("acceptance_utc") - pad_before_s, F.lit(window_start))
    spans = filings.select("accession_no", "ticker", "acceptance_utc", start.alias("span_start"), (F.col("acceptance_utc") + pad_after_s).alias("span_end"))
    spans = spans.withColumn("clamped", F.col("acceptance_utc") - pad_before_s < window_start)
    days = F.sequence(F.floor(F.col("span_start") / 86400), F.floor(F.col("span_end") / 86400))
    session_days = sessions.select(F.datediff("date", F.lit("1970-01-01").cast("date")).cast("long").alias("day"))
    expected = spans.select("accession_no", "ticker", F.explode(days).alias("day")).join(F.broadcast(session_days), "day")
    seen = bars.select("ticker", F.floor(F.col("ts_utc") / 86400).alias("day")).distinct().withColumn("present", F.lit(1))
    counts = expected.join(seen, ["ticker", "day"], "left").groupBy("accession_no").agg(F.count("*").alias("n_sessions"), F.count("present").alias("n_present"))
    ends = bars.groupBy("ticker").agg(F.min("ts_utc").alias("first_bar"), F.max("ts_utc").alias("last_bar"))
    out = spans.join(counts, "accession_no", "left").join(ends, "ticker", "left").na.fill(0, ["n_sessions", "n_present"])
    outcome = (
        F.when(F.col("n_sessions") == 0, "no_sessions")
        .when(F.col("first_bar").isNull(), "no_bars")
        .when(F.col("first_bar") > F.col("span_start") + tolerance_s, "starts_late")
        .when(F.col("last_bar") < F.col("span_end") - tolerance_s, "ends_early")
        .when(F.col("n_present") < least * F.col("n_sessions"), "gaps")
        .otherwise("ok")
    )
    return out.withColumn("outcome", outcome)


def thin_sessions(bars: DataFrame, sessions: DataFrame, universe: int, least_share: float) -> DataFrame:
    """Session hours, whole ones from the open, in which fewer than ``least_share`` of the universe have a bar."""
    full = bars.groupBy("ts_utc").agg(F.count_distinct("ticker").alias("n")).where(F.col("n") >= least_share * universe)
    hours = sessions.select("date", F.explode(F.sequence(F.floor(F.col("open_utc") / 3600) * 3600, F.col("close_utc") - 3600, F.lit(3600))).alias("ts_utc"))
    missing = hours.join(full, "ts_utc", "left_anti")
    return missing.groupBy("date").agg(F.count("*").alias("n_missing"), F.min("ts_utc").alias("first_missing"))
