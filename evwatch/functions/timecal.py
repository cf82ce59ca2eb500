"""Times as epoch seconds, and the session calendar.

Trading hours are read off a cumulative clock: seconds that were open before a session's day,
plus how far into the day's session a time is. A span is the difference of two readings, each an
equi-join on a day with a table of one row per day, so no range join is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

ZONED = r"(Z|[+-]\d\d:?\d\d)$"


def date_to_epoch(text: Column) -> Column:
    """``YYYY-MM-DD`` at UTC midnight."""
    return F.unix_timestamp(F.to_date(text).cast("timestamp"))


def iso_to_epoch(text: Column) -> Column:
    """ISO-8601 with zone; a time without one raises, null stays null."""
    return F.when(text.isNull() | text.rlike(ZONED), F.unix_seconds(F.to_timestamp(text))).otherwise(F.raise_error(F.concat(F.lit("no zone: "), text)).cast("long"))


def compact_to_epoch(text: Column) -> Column:
    """``YYYYMMDDHHMMSS`` with optional T and Z; unreadable is null."""
    return F.unix_seconds(F.try_to_timestamp(F.regexp_replace(text, "[TZ]", ""), F.lit("yyyyMMddHHmmss")))


def epoch_to_compact(ts: Column) -> Column:
    return F.date_format(F.timestamp_seconds(ts), "yyyyMMddHHmmss")


def epoch_to_iso(ts: Column) -> Column:
    return F.date_format(F.timestamp_seconds(ts), "yyyy-MM-dd HH:mm:ss'Z'")


def epoch_to_short(ts: Column) -> Column:
    return F.date_format(F.timestamp_seconds(ts), "dd MMM HH:mm")


def interval_seconds(text: Column) -> Column:
    """``60m``, ``1d``, ``2h``; an unknown unit raises."""
    n, unit = F.regexp_extract(text, r"^(\d+)", 1).cast("long"), F.regexp_extract(text, r"^\d+([a-z]+)$", 1)
    size = F.when(unit == "m", 60).when(unit == "h", 3600).when(unit == "d", 86400).otherwise(F.raise_error(F.concat(F.lit("unknown interval: "), text)).cast("int"))
    return n * size


def new_york_label(hour: Column) -> Column:
    """A UTC hour as New York time in summer and in winter."""
    parts = [F.date_format(F.from_utc_timestamp(F.timestamp_seconds(F.unix_timestamp(F.lit(day)) + hour * 3600), "America/New_York"), "HH:mm") for day in ("2024-07-01 00:00:00", "2024-01-02 00:00:00")]
    return F.concat_ws(" / ", *parts)


def split_of(ts: Column, start: int, end: int, shares: tuple[float, float, float]) -> Column:
    """train, val or test by shares of [start, end), live after it."""
    if abs(sum(shares) - 1) > 1e-9:
        raise ValueError("shares must sum to 1")
    first = start + int((end - start) * shares[0])
    second = start + int((end - start) * (shares[0] + shares[1]))
    return F.when(ts < first, "train").when(ts < second, "val").when(ts < end, "test").otherwise("live")


def session_table(
    spark: SparkSession, first: str, last: str, open_hm=(9, 30), close_hm=(16, 0), early_hm=(13, 0), holidays=(), half_days=(), zone: str = "America/New_York"
) -> DataFrame:
    """``date, open_utc, close_utc`` of weekdays but holidays; sessions are [open, close)."""
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)))).alias("date"))
    days = days.where(F.weekday("date") < 5)
    if holidays:
        days = days.where(~F.date_format("date", "yyyy-MM-dd").isin(*holidays))
    half = F.date_format("date", "yyyy-MM-dd").isin(*half_days) if half_days else F.lit(False)

    def at(hm: tuple[int, int]) -> Column:
        return F.unix_seconds(F.to_utc_timestamp(F.timestamp_seconds(F.unix_timestamp(F.col("date").cast("timestamp")) + hm[0] * 3600 + hm[1] * 60), zone))

    return days.select("date", at(open_hm).alias("open_utc"), F.when(half, at(early_hm)).otherwise(at(close_hm)).alias("close_utc"))


def clock(sessions: DataFrame) -> DataFrame:
    """A row for each day from a month before the first session to the last: the session (if any),
    seconds open before the day, and the next open and close once the day's own times are past.
    A time on another day has no reading: reading it raises.

    The table has as many rows as the calendar has days, so it may be broadcast and its windows
    may run over all of it.
    """
    bounds = sessions.agg(F.min("date").alias("a"), F.max("date").alias("b"))
    days = bounds.select(F.explode(F.sequence(F.date_sub("a", 31), F.col("b"))).alias("date")).join(sessions, "date", "left")
    before = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(F.lit(0)).orderBy("date").rowsBetween(1, Window.unboundedFollowing)
    return days.select(
        (F.datediff("date", F.lit("1970-01-01").cast("date"))).alias("day"),
        "open_utc",
        "close_utc",
        F.coalesce(F.sum(F.col("close_utc") - F.col("open_utc")).over(before), F.lit(0)).alias("open_before"),
        F.first("open_utc", ignorenulls=True).over(after).alias("later_open"),
        F.first("close_utc", ignorenulls=True).over(after).alias("later_close"),
    )


def read_clock(df: DataFrame, days: DataFrame, ts: str, prefix: str, optional: bool = False) -> DataFrame:
    """A time that is null or out of the calendar raises; with ``optional`` a null time reads null.

    ``df`` with ``<prefix>_clock`` (open seconds up to ``ts``), ``_open`` (whether a session
    holds it), ``_next_open`` and ``_next_close`` (both strictly after it)."""
    names = {c: f"__{prefix}_{c}" for c in days.columns}
    there = F.broadcast(days.select([F.col(c).alias(n) for c, n in names.items()]))
    out = df.join(there, F.floor(F.col(ts) / 86400) == F.col(names["day"]), "left")
    at, opens, closes = F.col(ts), F.col(names["open_utc"]), F.col(names["close_utc"])
    known = F.col(names["day"]).isNotNull() | (at.isNull() if optional else F.lit(False))
    lost = F.raise_error(F.concat(F.lit(f"{ts} is out of the calendar: "), F.coalesce(at.cast("string"), F.lit("null"))))
    before = F.when(known, F.col(names["open_before"])).otherwise(lost.cast("long"))
    into = F.coalesce(F.greatest(F.least(at, closes) - opens, F.lit(0)), F.lit(0))
    return (
        out.withColumn(f"{prefix}_clock", before + F.when(at.isNotNull(), into))
        .withColumn(f"{prefix}_open", F.coalesce((at >= opens) & (at < closes), F.lit(False)))
        .withColumn(f"{prefix}_next_open", F.when(before.isNotNull(), F.when(at < opens, opens).otherwise(F.col(names["later_open"]))))
        .withColumn(f"{prefix}_next_close", F.when(before.isNotNull(), F.when(at < closes, closes).otherwise(F.col(names["later_close"]))))
        .drop(*names.values())
    )


def trading_hours(df: DataFrame, days: DataFrame, start: str, end: str, name: str, optional: bool = False) -> DataFrame:
    """``df`` with the trading hours of [start, end): 0 if equal; an end before the start raises, as do
    times that are out of the calendar and, but for ``optional``, null."""
    out = read_clock(read_clock(df, days, start, "__a", optional), days, end, "__b", optional)
    span = (F.col("__b_clock") - F.col("__a_clock")) / 3600.0
    checked = F.when(F.col(end) < F.col(start), F.raise_error(F.lit("end before start")).cast("double")).otherwise(span)
    added = [f"{p}_{c}" for p in ("__a", "__b") for c in ("clock", "open", "next_open", "next_close")]
    return out.withColumn(name, checked).drop(*added)


def hours_to_close(df: DataFrame, days: DataFrame, ts: str, name: str) -> DataFrame:
    """Trading hours from ``ts`` to the next close; out of hours, the whole next session."""
    out = read_clock(df, days, ts, "__c")
    length = F.col("__c_next_close") - F.col("__c_next_open")
    hours = F.when(F.col("__c_open"), F.col("__c_next_close") - F.col(ts)).otherwise(length) / 3600.0
    return out.withColumn(name, hours).drop("__c_clock", "__c_open", "__c_next_open", "__c_next_close")


def split_bounds(name: str, start: int, end: int, shares: tuple[float, float, float]) -> tuple[int, int]:
    """Where a split of [start, end) begins and ends."""
    if abs(sum(shares) - 1) > 1e-9:
        raise ValueError("shares must sum to 1")
    cuts = [start, start + int((end - start) * shares[0]), start + int((end - start) * (shares[0] + shares[1])), end]
    at = ("train", "val", "test").index(name)
    return cuts[at], cuts[at + 1]


def sealed_guard(df: DataFrame, ts: str, start: int, end: int, sealed: bool = True) -> DataFrame:
    """``df``; rows with start <= ts < end raise while the period is sealed."""
    inside = (F.col(ts) >= start) & (F.col(ts) < end)
    return df.where(F.when(inside & F.lit(sealed), F.raise_error(F.lit("the period is sealed")).cast("boolean")).otherwise(F.lit(True)))
