"""Scans of stored tables: predicates and columns that reach the files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evwatch.config import DAY, Config
from evwatch.functions.timecal import date_to_epoch


def bars_of(bars: DataFrame, ticker: str, interval: str | None = None) -> DataFrame:
    """``ts_utc, close, volume`` of a ticker, at one interval if the table has several; none is valid."""
    rows = bars.where(F.col("ticker") == ticker)
    rows = rows.where(F.col("interval") == interval) if interval is not None else rows
    return rows.select("ts_utc", "close", "volume").orderBy("ts_utc")


def between(rows: DataFrame, ts: str, low: int, high: int, forms: tuple[str, ...] | None = None) -> DataFrame:
    """Rows of [low, high], both ends included, of some forms if given; no time, no row."""
    inside = rows.where(F.col(ts).between(low, high))
    return inside.where(F.col("form").isin(*forms)) if forms is not None else inside


def latest(rows: DataFrame, by: str, ts: str) -> DataFrame:
    return rows.groupBy(by).agg(F.max(ts).alias("latest_utc"))


def history_floor(cfg: Config) -> int:
    """Collection starts before the study by the lookback that a prior filing is looked for in."""
    from datetime import UTC, datetime

    return int(datetime.fromisoformat(cfg.study_start).replace(tzinfo=UTC).timestamp()) - cfg.prior_filing_days * DAY


def flagged_tickers(companies: DataFrame, flag: str) -> DataFrame:
    """Distinct tickers with the flag; where no row has it, all tickers."""
    some = companies.agg(F.max(F.col(flag) == 1).alias("__some"))  # one row
    kept = companies.join(F.broadcast(some)).where((F.col(flag) == 1) | ~F.coalesce("__some", F.lit(False)))
    return kept.select("ticker").distinct()


def without_successor(companies: DataFrame) -> DataFrame:
    return companies.where("successor_cik IS NULL").agg(F.count("*").alias("n"))


def filed_before(filings: DataFrame, cutoff: int) -> DataFrame:
    return filings.where(F.col("acceptance_utc") < cutoff).select("ticker").distinct()


def usable_events(events: DataFrame, scheduled: bool | None = None) -> DataFrame:
    rows = events.where("usable = 1")
    return rows if scheduled is None else rows.where(F.col("is_scheduled") == scheduled)


def display_names(companies: DataFrame) -> DataFrame:
    """A ticker's name: of a row without a successor if there is one, of several the least."""
    order = F.struct(F.col("successor_cik").isNotNull(), "name")
    return companies.groupBy("ticker").agg(F.min_by("name", order).alias("name"))


def recent(rows: DataFrame, ts: str, key: str, n: int) -> DataFrame:
    return rows.orderBy(F.col(ts).desc(), key).limit(n)


def filed_at(filings: DataFrame, events: DataFrame) -> DataFrame:
    """``filings`` with ``filed_utc``: the corrected time of its event, else its acceptance."""
    known = events.select("accession_no", F.col("t0_utc").alias("__t0"))
    return filings.join(known, "accession_no", "left").withColumn("filed_utc", F.coalesce("__t0", "acceptance_utc")).drop("__t0")


def register_lines(spark, path: str) -> DataFrame:
    """The register's text file, whose names are in latin-1."""
    return spark.read.option("encoding", "ISO-8859-1").option("lineSep", "\n").text(path)


def study_bounds(cfg: Config):
    return date_to_epoch(F.lit(cfg.study_start)), date_to_epoch(F.lit(cfg.study_end))
