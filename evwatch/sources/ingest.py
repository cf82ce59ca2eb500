"""Landed files of the feeds to rows of the tables. Readers declare their schemas."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from evwatch.functions.scalars import domain_of, name_stem, normal_items
from evwatch.functions.timecal import ZONED, compact_to_epoch


def company_map(spark: SparkSession, path: str, exchanges: tuple[str, ...], as_of: int) -> DataFrame:
    """JSON ``{fields, data}`` of positional rows to one row for each company of the exchanges.

    Its ticker is the first in file order without ``-``, else the first; its name and exchange are
    the first row's.
    """
    raw = spark.read.schema("fields array<string>, data array<array<string>>").json(path, multiLine=True)
    rows = raw.select("fields", F.posexplode("data").alias("pos", "row"))

    def field(name: str) -> Column:
        at = F.array_position("fields", name)
        return F.when(at > 0, F.get("row", (at - 1).cast("int"))).otherwise(F.raise_error(F.lit(f"no field {name}")).cast("string"))

    return company_rows(rows.select("pos", *(field(c).alias(c) for c in ("cik", "name", "ticker", "exchange"))), exchanges, as_of)


def company_rows(rows: DataFrame, exchanges: tuple[str, ...], as_of: int) -> DataFrame:
    kept = rows.where(F.col("exchange").isin(*exchanges) & F.col("ticker").isNotNull() & (F.col("ticker") != ""))
    kept = kept.withColumn("cik", F.lpad(F.col("cik").cast("string"), 10, "0"))
    return kept.groupBy("cik").agg(
        F.min_by("ticker", F.struct(F.contains("ticker", F.lit("-")), "pos")).alias("ticker"), F.min_by("name", "pos").alias("name"), F.min_by("exchange", "pos").alias("exchange")
    ).withColumn("universe_as_of", F.lit(as_of).cast("long")).withColumn("in_universe", F.lit(None).cast("int"))


def records(block: DataFrame, columns: list[str]) -> DataFrame:
    """Parallel arrays to one row for each place; unequal lengths raise."""
    sizes = [F.size(c) for c in columns]
    same = F.lit(True)
    for s in sizes[1:]:
        same = same & (s == sizes[0])
    zipped = F.when(same, F.arrays_zip(*columns)).otherwise(F.raise_error(F.lit("columns of unequal length")))
    others = [c for c in block.columns if c not in columns]
    return block.select(*others, F.posexplode(zipped).alias("pos", "__r")).select(*others, "pos", "__r.*")


def pages_to_read(pages: DataFrame, since: int, until: int) -> DataFrame:
    """Pages whose dates overlap [since, until]; one without a bound is read, one without a name isn't."""
    low, high = F.col("from_utc"), F.col("to_utc")
    return pages.where(F.col("name").isNotNull() & (low.isNull() | high.isNull() | ((high >= since) & (low <= until))))


def filing_rows(raw: DataFrame, forms: tuple[str, ...]) -> tuple[DataFrame, DataFrame]:
    """Filings of exactly these forms, and the rows that can't be read: without a key, or without an
    acceptance time that tells its zone."""
    rows = raw.where(F.col("form").isin(*forms))
    at = F.when(F.col("acceptance").rlike(ZONED), F.unix_seconds(F.try_to_timestamp("acceptance")))
    day = F.unix_timestamp(F.try_to_timestamp(F.nullif(F.trim("filing_date"), F.lit("")), F.lit("yyyy-MM-dd")))
    out = rows.withColumn("acceptance_utc", at).withColumn("filing_date_utc", day).withColumn("items", normal_items(F.col("items")))
    good = F.col("acceptance_utc").isNotNull() & F.col("accession_no").isNotNull() & (F.col("accession_no") != "")
    return out.where(good).drop("acceptance", "filing_date"), rows.where(at.isNull() | F.col("accession_no").isNull() | (F.col("accession_no") == ""))


def counted_filings(raw: DataFrame, forms: tuple[str, ...]) -> tuple[DataFrame, Observation]:
    """``filing_rows``' good rows, with ``report_date_utc`` where ``raw`` has a ``report_date``, and counts that are
    told once they have been written: rows read, of other forms, without a key, without a time, kept. No
    pass of its own is made for them."""
    told = Observation(f"filings-{uuid.uuid4().hex}")
    ours = F.coalesce(F.col("form").isin(*forms), F.lit(False))
    keyed = F.coalesce(F.col("accession_no") != "", F.lit(False))
    timed = F.coalesce(F.col("acceptance").rlike(ZONED), F.lit(False)) & F.try_to_timestamp("acceptance").isNotNull()
    raw = raw.observe(
        told, F.count("*").alias("read"), F.count_if(~ours).alias("other_form"), F.count_if(ours & ~keyed).alias("no_key"),
        F.count_if(ours & keyed & ~timed).alias("no_time"), F.count_if(ours & keyed & timed).alias("kept"),
    )
    if "report_date" in raw.columns:
        day = F.unix_timestamp(F.try_to_timestamp(F.nullif(F.trim("report_date"), F.lit("")), F.lit("yyyy-MM-dd")))
        raw = raw.withColumn("report_date_utc", day).drop("report_date")
    return filing_rows(raw, forms)[0], told


def counted_bars(raw: DataFrame, interval: str) -> tuple[DataFrame, Observation, Observation]:
    """``bar_rows`` with counts that are told once they have been written: rows read and rows without a
    price; and rows kept, the rest being repeated times."""
    before, after = Observation(f"bars-{uuid.uuid4().hex}"), Observation(f"kept-{uuid.uuid4().hex}")
    priced = F.lit(True)
    for c in ("open", "high", "low", "close"):
        priced &= F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).isNotNull()
    raw = raw.observe(before, F.count("*").alias("read"), F.count_if(~priced).alias("no_price"))
    return bar_rows(raw, interval).observe(after, F.count("*").alias("kept")), before, after


def bar_rows(raw: DataFrame, interval: str) -> DataFrame:
    """Bars with all prices; a missing volume is 0, the last row of a time stays. ``raw`` has ``pos``."""
    clean = [F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(c) for c in ("open", "high", "low", "close", "volume")]
    rows = raw.select("ticker", "ts_utc", "pos", *clean).na.drop(subset=["open", "high", "low", "close"]).na.fill(0.0, ["volume"])
    last = Window.partitionBy("ticker", "ts_utc").orderBy(F.col("pos").desc())
    return rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n", "pos").withColumn("interval", F.lit(interval))


def published_news(raw: DataFrame, api: str) -> DataFrame:
    """A feed that tells when an article came out."""
    rows = raw.withColumn("published_utc", F.expr("try_cast(datetime AS bigint)")).where("url IS NOT NULL AND url <> '' AND published_utc IS NOT NULL")
    return rows.select("url", "ticker", F.coalesce("headline", F.lit("")).alias("title"), domain_of(F.col("url")).alias("source_domain"), F.col("source").alias("source_name"), "published_utc", F.lit(None).cast("long").alias("seen_utc"), F.lit(api).alias("api"))


def crawled_news(raw: DataFrame, api: str) -> DataFrame:
    """A feed that tells when it saw an article."""
    rows = raw.withColumn("seen_utc", compact_to_epoch(F.col("seendate"))).where("url IS NOT NULL AND url <> '' AND seen_utc IS NOT NULL")
    domain = F.coalesce(F.nullif("domain", F.lit("")), domain_of(F.col("url")))
    return rows.select("url", "ticker", F.coalesce("title", F.lit("")).alias("title"), domain.alias("source_domain"), F.lit(None).cast("string").alias("source_name"), F.lit(None).cast("long").alias("published_utc"), "seen_utc", F.lit(api).alias("api"))


def register_rows(lines: DataFrame) -> DataFrame:
    """Lines ``NAME:CIK:`` to stem, name and cik."""
    cut = r"^(.*):(\d+):?$"
    rows = lines.select(F.regexp_extract("value", cut, 1).alias("name"), F.regexp_extract("value", cut, 2).alias("cik")).where("cik <> ''")
    return rows.select(name_stem(F.col("name")).alias("stem"), "name", F.lpad("cik", 10, "0").alias("cik"))


def post_rows(raw: DataFrame, low: int, high: int) -> DataFrame:
    """Posts of [low, high) with an id and a time; bodies cut at 10,000 characters."""
    rows = raw.withColumn("created_utc", F.expr("try_cast(created_utc AS bigint)")).where(F.col("id").isNotNull() & (F.col("created_utc") >= low) & (F.col("created_utc") < high))
    return rows.withColumn("selftext", F.substring(F.coalesce("selftext", F.lit("")), 1, 10000)).withColumn("title", F.coalesce("title", F.lit(""))).withColumn("score", F.coalesce("score", F.lit(0)))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Newline-delimited JSON, plain or compressed; lines that can't be read are skipped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def retier(news: DataFrame, first: tuple[str, ...], second: tuple[str, ...]) -> DataFrame:
    from evwatch.functions.scalars import tier_of

    return news.withColumn("source_tier", tier_of(F.col("source_domain"), F.col("source_name"), first, second))


def move_seen(news: DataFrame, api: str) -> DataFrame:
    """For rows of ``api`` without a publication time, the crawl time is that."""
    here = (F.col("api") == api) & F.col("published_utc").isNull()
    return news.withColumn("published_utc", F.when(here, F.col("seen_utc")).otherwise(F.col("published_utc"))).withColumn("seen_utc", F.when(F.col("api") == api, F.lit(None)).otherwise(F.col("seen_utc")))


def window_grid(spark: SparkSession, start: int, end: int, days: int) -> DataFrame:
    """Slices of [start, end), the last one clipped; an empty range is one window."""
    span = days * 86400
    if start >= end:
        return spark.range(1).select(F.lit(0).cast("long").alias("no"), F.lit(start).cast("long").alias("low"), F.lit(end).cast("long").alias("high"))
    n = -(-(end - start) // span)
    low = F.lit(start) + F.col("id") * span
    return spark.range(n).select(F.col("id").alias("no"), low.alias("low"), F.least(low + span, F.lit(end)).alias("high"))


def needed_windows(filings: DataFrame, low: int, high: int, days: int, lookback_s: int) -> DataFrame:
    """Windows that hold an acceptance or the start of its lookback."""
    edge = F.explode(F.array(F.col("acceptance_utc"), F.col("acceptance_utc") - lookback_s))
    rows = filings.select("ticker", edge.alias("edge")).where((F.col("edge") >= low) & (F.col("edge") < high))
    return rows.select("ticker", F.floor((F.col("edge") - low) / (days * 86400)).alias("no")).distinct()


def high_water(bars: DataFrame, wanted: DataFrame) -> DataFrame:
    """Where to go on for each ticker: after its last bar if the start lies in what is stored.
    ``wanted``: ticker, start_utc, end_utc."""
    have = bars.groupBy("ticker").agg(F.min("ts_utc").alias("__min"), F.max("ts_utc").alias("__max"))
    rows = wanted.join(have, "ticker", "left")
    start = F.when(F.col("start_utc").between(F.col("__min"), F.col("__max")), F.col("__max") + 1).otherwise(F.col("start_utc"))
    return rows.withColumn("start_utc", start).where("start_utc < end_utc").drop("__min", "__max")


def clamped(wanted: DataFrame, now: int, interval: str, default_start: int) -> DataFrame:
    """Ranges with a start: the default where none is asked for; hourly bars are kept for 729 days."""
    start = F.coalesce("start_utc", F.lit(default_start).cast("long"))
    return wanted.withColumn("start_utc", start if interval == "1d" else F.greatest(start, F.lit(now - 729 * 86400).cast("long")))


def reread(stored: DataFrame, landed: DataFrame, key: str, ts: str, overlap_s: int) -> DataFrame:
    """New rows of ``landed`` from ``overlap_s`` before the newest stored time on, so that late ones
    aren't missed; known keys are skipped."""
    newest = stored.agg(F.max(ts).alias("__newest"))  # one row
    late = landed.join(F.broadcast(newest)).where(F.col("__newest").isNull() | (F.col(ts) >= F.col("__newest") - overlap_s)).drop("__newest")
    return late.join(stored.select(key), key, "left_anti")


def new_posts(stored: DataFrame, landed: DataFrame, by: str, ts: str = "created_utc") -> DataFrame:
    """Posts after the newest stored one of their group, known ids left out; a new group from its start. Of
    rows that share an id the earliest stays, of those the first by all columns."""
    mark = stored.groupBy(by).agg(F.max(ts).alias("__mark"))
    fresh = landed.join(mark, by, "left").where(F.col("__mark").isNull() | (F.col(ts) > F.col("__mark"))).drop("__mark")
    fresh = fresh.join(stored.select("id"), "id", "left_anti")
    rest = [c for c in landed.columns if c not in ("id", ts)]
    first = fresh.groupBy("id").agg(F.min(F.struct(ts, *rest)).alias("__row"))
    return first.select("id", "__row.*").select(*landed.columns)
