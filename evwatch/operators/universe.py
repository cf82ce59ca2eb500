"""Choosing a liquid universe as of a date."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evwatch.config import DAY, Config
from evwatch.tables import stored


def candidates(companies: DataFrame, daily: DataFrame, filings: DataFrame, as_of: int, cfg: Config) -> DataFrame:
    """Liquidity of each company's ticker from daily bars up to ``as_of``, in one aggregation."""
    low = as_of - cfg.history_days * DAY
    inside = F.col("ts_utc") >= low
    stats = daily.where(F.col("ts_utc") <= as_of).groupBy("ticker").agg(
        F.min("ts_utc").alias("first_ts"),
        F.avg(F.when(inside, F.col("close") * F.col("volume"))).alias("adv_usd"),
        F.count(F.when(inside, F.lit(1))).alias("n_bars"),
        F.max("ts_utc").alias("last_ts"),
        F.max_by("close", "ts_utc").alias("last_price"),
    )
    prior = filings.where(F.col("form").isin(*cfg.forms) & (F.col("acceptance_utc") >= as_of - cfg.prior_filing_days * DAY) & (F.col("acceptance_utc") < as_of))
    prior = prior.select("ticker").distinct().withColumn("has_prior", F.lit(True))
    return companies.select("ticker").distinct().join(stats, "ticker", "left").join(prior, "ticker", "left").na.fill(False, ["has_prior"])


def classify(rows: DataFrame, as_of: int, cfg: Config) -> DataFrame:
    """``candidates`` with the first reason against them, or null."""
    reason = (
        F.when(~F.col("has_prior"), "no_prior_8k")
        .when(F.col("first_ts").isNull(), "no_bars")
        .when(F.col("first_ts") > as_of - cfg.history_days * DAY, "short_history")
        .when(F.col("last_ts") < as_of - cfg.stale_days * DAY, "not_trading_at_as_of")
        .when(F.col("n_bars") < cfg.min_bars, "too_few_bars")
        .when(F.col("adv_usd").isNull() | F.col("last_price").isNull(), "no_usable_bars")
        .when(F.col("last_price") < cfg.min_price, "below_min_price")
        .when(F.col("adv_usd") < cfg.min_adv, "below_min_adv")
    )
    return rows.withColumn("reason", reason)


def select(classified: DataFrame, cfg: Config) -> DataFrame:
    """The ``max_tickers`` most traded of those without a reason."""
    return classified.where("reason IS NULL").orderBy(F.col("adv_usd").desc(), "ticker").limit(cfg.max_tickers)


def applied(companies: DataFrame, classified: DataFrame, as_of: int, cfg: Config) -> DataFrame:
    """``companies`` with ``in_universe`` and ``universe_as_of`` set, and the figures that the choice was made by; no
    survivor at all raises, as what follows would collect nothing."""
    chosen = select(classified, cfg).select("ticker", F.col("adv_usd").alias("__adv"), F.col("last_price").alias("__price"), F.lit(1).alias("__in"))
    chosen = stored(chosen)
    if chosen.isEmpty():
        raise ValueError("no company is left in the universe")
    out = companies.drop("in_universe", "universe_as_of", "adv_usd", "last_price").join(chosen, "ticker", "left")
    flags = {"in_universe": F.coalesce("__in", F.lit(0)), "universe_as_of": F.lit(as_of).cast("long"), "adv_usd": F.col("__adv"), "last_price": F.col("__price")}
    return out.withColumns(flags).drop("__in", "__adv", "__price")


def tally(classified: DataFrame, cfg: Config) -> DataFrame:
    """How many each reason excludes, those over the cap included."""
    counts = classified.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))
    over = classified.where("reason IS NULL").agg(F.greatest(F.count("*") - cfg.max_tickers, F.lit(0)).alias("n")).where("n > 0")
    return counts.unionByName(over.select(F.lit("over_max_tickers").alias("reason"), "n"))


def drift(computed: DataFrame, stored: DataFrame) -> DataFrame:
    """Tickers in one of the sets only."""
    a, b = computed.select("ticker").distinct().withColumn("in_computed", F.lit(1)), stored.select("ticker").distinct().withColumn("in_stored", F.lit(1))
    return a.join(b, "ticker", "full").na.fill(0).where("in_computed <> in_stored")
