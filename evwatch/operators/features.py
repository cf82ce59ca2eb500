"""Backward-looking features of bars by ticker. All share one order, so one shuffle and one sort
feed them; nothing at a bar is read from a later one. What is undefined is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evwatch.config import Config
from evwatch.operators.joins import asof


def of_ticker():
    return Window.partitionBy("ticker").orderBy("ts_utc")


def change(now: Column, then: Column) -> Column:
    return F.when(then > 0, now / then - 1)


def returns(horizons: tuple[int, ...]) -> dict[str, Column]:
    return {f"ret_{h}h": change(F.col("close"), F.lag("close", h).over(of_ticker())) for h in horizons}


def volume_z(window: int, least: int) -> Column:
    """Against the mean and sample deviation of the ``window`` bars before, this one excluded."""
    base = of_ticker().rowsBetween(-window, -1)
    mean, sd, n = F.avg("volume").over(base), F.stddev_samp("volume").over(base), F.count("volume").over(base)
    return F.when((n >= least) & (sd > 0), (F.col("volume") - mean) / sd)


def with_volatility(bars: DataFrame, window: int) -> DataFrame:
    """Sample deviation of the last ``window`` one-bar returns, this bar's included."""
    frame = of_ticker().rowsBetween(1 - window, 0)
    out = bars.withColumn("__ret", change(F.col("close"), F.lag("close", 1).over(of_ticker())))
    full = F.count("__ret").over(frame) == window
    return out.withColumn("volatility", F.when(full, F.stddev_samp("__ret").over(frame))).drop("__ret")


def with_benchmark(bars: DataFrame, benchmark: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """Own return less the benchmark's over the same bars; ``benchmark``: ts_utc, b_close."""
    out = bars.join(benchmark, "ts_utc", "left")
    for h in horizons:
        own = change(F.col("close"), F.lag("close", h).over(of_ticker()))
        market = change(F.col("b_close"), F.lag("b_close", h).over(of_ticker()))
        out = out.withColumn(f"ret_rel_{h}h", own - market)
    return out.drop("b_close")


def days_since(bars: DataFrame, events: DataFrame, name: str) -> DataFrame:
    """Days from the last event at or before each bar; ``events``: ticker, at."""
    out = asof(bars, events, "ticker", "ts_utc", "at", {"__at": F.col("at")})
    return out.withColumn(name, (F.col("ts_utc") - F.col("__at")) / 86400.0).drop("__at")


def news_features(bars: DataFrame, news: DataFrame, hours: tuple[int, ...]) -> DataFrame:
    """Hours since the last article, articles and distinct publishers in (t - W, t].

    ``news``: ticker, published_utc, publisher. A publisher counts from an article on until W
    after it or until its next article, whichever is first: +1 and -1 in a running sum, so a
    window's publishers are never gathered.
    """
    out = asof(bars, news, "ticker", "ts_utc", "published_utc", {"__at": F.col("published_utc")})
    out = out.withColumn("hours_since_news", (F.col("ts_utc") - F.col("__at")) / 3600.0).drop("__at")
    of_publisher = Window.partitionBy("ticker", "publisher").orderBy("published_utc")
    for h in hours:
        w = h * 3600
        following = F.lead("published_utc").over(of_publisher)
        until = F.least(F.col("published_utc") + w, F.coalesce(following, F.col("published_utc") + w))
        steps = news.where("published_utc IS NOT NULL").withColumn("__until", until)
        came = steps.select("ticker", F.col("published_utc").alias("__ts"), F.lit(1).alias("__n"), F.lit(1).alias("__p"))
        left = steps.select("ticker", F.col("__until").alias("__ts"), F.lit(0).alias("__n"), F.lit(-1).alias("__p"))
        old = news.where("published_utc IS NOT NULL").select("ticker", (F.col("published_utc") + w).alias("__ts"), F.lit(-1).alias("__n"), F.lit(0).alias("__p"))
        moves = came.unionByName(left).unionByName(old).groupBy("ticker", "__ts").agg(F.sum("__n").alias("__n"), F.sum("__p").alias("__p"))
        totals = Window.partitionBy("ticker").orderBy("__ts").rowsBetween(Window.unboundedPreceding, 0)
        running = moves.select("ticker", "__ts", F.sum("__n").over(totals).alias("__n"), F.sum("__p").over(totals).alias("__p"))
        out = asof(out, running, "ticker", "ts_utc", "__ts", {"__now_n": F.col("__n"), "__now_p": F.col("__p")})
        out = out.withColumn(f"news_count_{h}h", F.coalesce("__now_n", F.lit(0))).withColumn(f"news_breadth_{h}h", F.coalesce("__now_p", F.lit(0))).drop("__now_n", "__now_p")
    return out


def price_features(bars: DataFrame, cfg: Config) -> DataFrame:
    """Returns, volume z and volatility on the full history of each ticker."""
    out = bars.withColumns(returns(cfg.horizons)).withColumn("volume_z", volume_z(cfg.z_window, cfg.z_min))
    return with_volatility(out, cfg.vol_window)


def ticker_features(bars: DataFrame, benchmark: DataFrame, filings: DataFrame, news: DataFrame | None, days: DataFrame, cfg: Config) -> DataFrame:
    """All features of each bar on its ticker's full history, to be sliced afterwards. ``benchmark``:
    ts_utc, b_close; ``filings``: ticker, items, at; ``days``: a clock; no news, no news features."""
    from evwatch.functions.timecal import hours_to_close

    out = with_benchmark(price_features(bars, cfg), benchmark, cfg.horizons)
    out = days_since(out, filings, "days_since_last_8k")
    scheduled = F.lit(False)
    for code in cfg.scheduled_items:
        scheduled = scheduled | F.col("items").contains(code)
    out = days_since(out, filings.where(scheduled), "days_since_last_earnings")
    out = hours_to_close(out, days, "ts_utc", "hours_to_close")
    return out if news is None else news_features(out, news, cfg.news_windows_h)


def feature_names(cfg: Config, with_news: bool = True) -> list[str]:
    names = [f"ret_{h}h" for h in cfg.horizons] + ["volume_z", "volatility"] + [f"ret_rel_{h}h" for h in cfg.horizons]
    names += ["days_since_last_8k", "days_since_last_earnings", "hours_to_close"]
    return names + (["hours_since_news", *(f"news_{kind}_{h}h" for h in cfg.news_windows_h for kind in ("count", "breadth"))] if with_news else [])


def moving_average_normal(bars: DataFrame, flagged: DataFrame, column: str, days: int = 30) -> DataFrame:
    """For each flagged bar: median, 5th and 95th percentile of ``column`` over the days strictly
    before it, and the share of those values below its own. ``flagged``: ticker, ts_utc, value."""
    from evwatch.operators.joins import within

    past = bars.select("ticker", "ts_utc", column)
    pairs = within(flagged, past, "ticker", "ts_utc", "ts_utc", days * 86400, after=False).where(F.col("r_ts_utc") < F.col("ts_utc"))
    p = F.percentile(f"r_{column}", F.array(F.lit(0.05), F.lit(0.5), F.lit(0.95)))
    below = F.avg((F.col(f"r_{column}") < F.col("value")).cast("double"))
    out = pairs.groupBy("ticker", "ts_utc", "value").agg(p.alias("p"), below.alias("share_below"), F.count("*").alias("n"))
    return out.select("ticker", "ts_utc", "value", F.col("p")[0].alias("p05"), F.col("p")[1].alias("median"), F.col("p")[2].alias("p95"), "share_below", "n")


def lookaheads(features, bars: DataFrame, cuts: list[int], columns: list[str]) -> DataFrame:
    """``cut, feature, n``: at how many rows at or before a cut a feature changes when all bars later than the
    cut do. All cuts are one plan: each has a copy of the bars whose tickers tell the cut, and
    features are made of all copies at once."""
    noise = 1000 + F.pmod(F.xxhash64("ticker", "ts_utc"), F.lit(97))
    each = bars.withColumn("__cut", F.explode(F.array(F.lit(None).cast("long"), *(F.lit(c).cast("long") for c in cuts))))
    moved = F.coalesce(F.col("ts_utc") > F.col("__cut"), F.lit(False))
    each = each.withColumns({c: F.when(moved, F.col(c) * noise).otherwise(F.col(c)) for c in ("close", "volume")})
    named = F.concat_ws("|", F.coalesce(F.col("__cut").cast("string"), F.lit("")), "ticker")
    out = features(each.withColumn("ticker", named).drop("__cut")).select(F.split("ticker", r"\|", 2).alias("__name"), "ts_utc", *columns)
    cut = F.expr("try_cast(__name[0] AS bigint)")
    told = out.select(cut.alias("cut"), F.col("__name")[1].alias("ticker"), "ts_utc", F.struct(*columns).alias("told"))
    plain = told.where("cut IS NULL").select("ticker", "ts_utc", F.col("told").alias("plain"))
    met = told.where("ts_utc <= cut").join(plain, ["ticker", "ts_utc"])
    differ = F.array_compact(F.array(*(F.when(~F.col(f"told.{c}").eqNullSafe(F.col(f"plain.{c}")), F.lit(c)) for c in columns)))
    return met.select("cut", F.explode(differ).alias("feature")).groupBy("cut", "feature").agg(F.count("*").alias("n"))


def lookahead(features, bars: DataFrame, cut: int, columns: list[str]) -> DataFrame:
    """Rows at or before ``cut`` whose features change when all later bars do: ``features`` looks
    ahead if there are any."""
    noise = 1000 + F.pmod(F.xxhash64("ticker", "ts_utc"), F.lit(97))
    later = F.col("ts_utc") > cut
    moved = bars.withColumns({c: F.when(later, F.col(c) * noise).otherwise(F.col(c)) for c in ("close", "volume")})
    a, b = features(bars).where(F.col("ts_utc") <= cut), features(moved).where(F.col("ts_utc") <= cut)
    b = b.select("ticker", "ts_utc", *(F.col(c).alias(f"__{c}") for c in columns))
    differs = F.lit(False)
    for c in columns:
        differs = differs | ~F.col(c).eqNullSafe(F.col(f"__{c}"))
    return a.join(b, ["ticker", "ts_utc"]).where(differs).select("ticker", "ts_utc", *columns)
