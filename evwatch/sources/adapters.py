"""Bars, filings, news, companies and sessions, read off general event and order tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Sessions of the test month: weekdays 14:30 to 21:00 UTC but for these days.
HOLIDAYS = ("2024-01-01", "2024-01-15")
HALF_DAYS = ("2024-01-24",)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch(column: str):
    """Seconds of a time without zone, taken as UTC."""
    return F.unix_seconds(F.col(column).cast("timestamp"))


def hourly_bars(spark: SparkSession, sf_dir: str, ticker: str = "user_id") -> DataFrame:
    events = read(spark, sf_dir, "events").select(F.col(ticker).cast("string").alias("ticker"), "ts", "event_id", "value")
    slot = (F.floor(epoch("ts") / 3600) * 3600).alias("ts_utc")
    key = F.struct("ts", "event_id")
    return events.groupBy("ticker", slot).agg(
        F.min_by("value", key).alias("open"),
        F.max("value").alias("high"),
        F.min("value").alias("low"),
        F.max_by("value", key).alias("close"),
        F.round(F.sum("value"), 2).alias("volume"),
    )


def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice")
    day = (F.floor(epoch("l_shipdate") / 86400) * 86400).alias("ts_utc")
    price, key = F.col("l_extendedprice") / F.col("l_quantity"), F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    return lines.groupBy(F.col("l_suppkey").cast("string").alias("ticker"), day).agg(
        F.min_by(price, key).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, key).alias("close"), F.sum("l_quantity").alias("volume")
    )


def with_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", epoch("ts").alias("at"), k.alias("k"))


def filings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    items = F.when(k % 4 == 0, "2.02,9.01").when(k % 4 == 1, "8.01").when(k % 4 == 2, "9.01").otherwise("1.01,8.01")
    return with_k(spark, sf_dir).where("event_type = 'purchase'").select(
        F.format_string("%010d-24-%06d", F.col("user_id"), F.col("event_id")).alias("accession_no"),
        F.lpad(F.col("user_id").cast("string"), 10, "0").alias("cik"),
        F.col("user_id").cast("string").alias("ticker"),
        F.when(k % 5 == 0, "8-K/A").otherwise("8-K").alias("form"),
        items.alias("items"),
        F.col("at").alias("acceptance_utc"),
    )


def news(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    return with_k(spark, sf_dir).where("event_type IN ('click', 'view')").select(
        F.concat(F.lit("https://www.pub"), k % 7, F.lit(".com/"), "event_id").alias("url"),
        F.col("user_id").cast("string").alias("ticker"),
        F.concat(F.lit("story "), "event_id").alias("title"),
        F.concat(F.lit("pub"), k % 7, F.lit(".com")).alias("source_domain"),
        F.concat(F.lit("pub"), k % 7).alias("publisher"),
        F.when(k % 3 == 0, 1).when(k % 3 == 1, 2).alias("source_tier"),
        F.col("at").alias("published_utc"),
    )


def companies(spark: SparkSession, sf_dir: str) -> DataFrame:
    user = F.col("user_id")
    return read(spark, sf_dir, "events").select("user_id").distinct().select(
        F.lpad(user.cast("string"), 10, "0").alias("cik"),
        user.cast("string").alias("ticker"),
        F.concat(F.lit("Company "), user, F.when(user % 2 == 0, " Inc.").otherwise(" Corp")).alias("name"),
        F.when(user % 3 == 0, "Nasdaq").when(user % 3 == 1, "NYSE").otherwise("OTC").alias("exchange"),
        (user % 10).cast("string").alias("sic"),
    )


def sessions(spark: SparkSession, first: str = "2024-01-01", last: str = "2024-02-29") -> DataFrame:
    from evwatch.functions.timecal import session_table

    return session_table(spark, first, last, open_hm=(14, 30), close_hm=(21, 0), early_hm=(18, 0), holidays=HOLIDAYS, half_days=HALF_DAYS, zone="UTC")
