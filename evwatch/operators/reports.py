"""Reports on a study's tables: the funnel of its census, coverage, matches, moves and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evwatch.config import DAY
from evwatch.functions.scalars import is_scheduled, item_reason, kept_items, parse_items, scope_reason
from evwatch.functions.timecal import split_of
from evwatch.operators import labels, ranks
from evwatch.tables import stored

MONTH = 365.25 / 12 * DAY


def top(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """The ``k`` most frequent values, of equals the least."""
    counts = rows.groupBy(*by).agg(F.count("*").alias("n"))
    return counts.orderBy(F.col("n").desc(), *by).limit(k)


def census(events: DataFrame, low: int, high: int, gaps_h: tuple[int, ...]) -> DataFrame:
    """One row: events, those outside of [low, high), pending ones (not usable, no reason), usable and
    scheduled ones, tickers, months, usable ones per ticker and month, announcements for each gap."""
    events = stored(events.select("ticker", "t0_utc", "usable", "exclude_reason", "is_scheduled"))  # each gap reads them
    inside = (F.col("t0_utc") >= low) & (F.col("t0_utc") < high)
    usable = F.col("usable") == 1
    out = events.agg(
        F.count("*").alias("events"),
        F.count_if(~inside).alias("out_of_window"),
        F.count_if(~usable & F.col("exclude_reason").isNull()).alias("pending"),
        F.count_if(usable).alias("usable"),
        F.count_if(usable & F.col("is_scheduled")).alias("scheduled"),
        F.count_distinct(F.when(usable, F.col("ticker"))).alias("tickers"),
    )
    months = (high - low) / MONTH
    out = out.withColumn("months", F.lit(months)).withColumn("rate", F.when(F.col("tickers") > 0, F.col("usable") / (F.col("tickers") * months)))
    for gap in gaps_h:
        clusters = labels.announcements(events.where(usable), gap * 3600).agg(F.coalesce(F.sum("announcements"), F.lit(0)).alias(f"announcements_{gap}h"))
        out = out.join(F.broadcast(clusters))  # one row
    return out


def item_codes(events: DataFrame, excluded: tuple[str, ...]) -> DataFrame:
    return events.select(F.explode(kept_items(parse_items(F.col("items")), excluded)).alias("code"))


def coverage_counts(audited: DataFrame) -> DataFrame:
    """Filings, clamped spans and tickers for each outcome of ``labels.coverage``."""
    return audited.groupBy("outcome").agg(F.count("*").alias("n"), F.count_if("clamped").alias("clamped"), F.count_distinct("ticker").alias("tickers"))


def coverage_exclusions(audited: DataFrame) -> DataFrame:
    return audited.where("outcome <> 'ok'").select("accession_no", F.concat(F.lit("no_price_coverage:"), "outcome").alias("reason"))


def collected(candidates: DataFrame, bars: DataFrame, state: DataFrame, start: int, end: int, tolerance_s: int) -> DataFrame:
    """How far each candidate's bars reach, with the last fetch status; ``state``: key, status."""
    reach = bars.groupBy("ticker").agg(F.min("ts_utc").alias("first_ts"), F.max("ts_utc").alias("last_ts"))
    rows = candidates.select("ticker").distinct().join(reach, "ticker", "left").join(state.select(F.col("key").alias("ticker"), "status"), "ticker", "left")
    outcome = F.when(F.col("first_ts").isNull(), "missing").when(F.col("first_ts") > start + tolerance_s, "late_start").when(F.col("last_ts") < end - tolerance_s, "early_end").otherwise("covered")
    return rows.select("ticker", outcome.alias("outcome"), F.coalesce("status", F.lit("never")).alias("status"))


def matched(corrected: DataFrame) -> DataFrame:
    return corrected.groupBy("t0_source", "fallback_reason").agg(F.count("*").alias("n"))


def gap_shares(gaps: DataFrame, column: str, lookback_s: int, parts: tuple[float, ...]) -> DataFrame:
    """Mean gap, and the share of gaps up to each part of the lookback."""
    return gaps.agg(F.avg(column).alias("mean"), *(F.avg((F.col(column) <= p * lookback_s).cast("double")).alias(f"within_{round(p * 100)}") for p in parts))


def moves(measured: DataFrame) -> DataFrame:
    """One row: events usable, immaterial and without a price, and the middle, the 90 % rank and the
    largest of the moves' sizes."""
    measured = stored(measured.select("move", "usable", "exclude_reason"))
    ranked = stored(ranks.nearest_rank(measured.select(F.abs("move").alias("size")), "size", [0.5, 0.9]))  # one row
    reason = F.col("exclude_reason")
    counts = measured.agg(
        F.count("*").alias("events"), F.count_if(F.col("usable") == 1).alias("usable"), F.count_if(reason == "immaterial").alias("immaterial"),
        F.count_if(reason.startswith("no_")).alias("no_price"), F.max(F.abs("move")).alias("largest"),
    )
    return counts.select("*", *(ranked.select(c).scalar().alias(c) for c in ranked.columns))


def splits(events: DataFrame, bars: DataFrame, low: int, high: int, shares: tuple[float, float, float]) -> DataFrame:
    """Events and bars of each split, and the events for a bar."""
    of = lambda ts: split_of(F.col(ts), low, high, shares).alias("split")
    a = events.groupBy(of("t0_utc")).agg(F.count("*").alias("events"))
    b = bars.groupBy(of("ts_utc")).agg(F.count("*").alias("bars"))
    out = a.join(b, "split", "full").na.fill(0, ["events", "bars"])
    return out.withColumn("base_rate", F.when(F.col("bars") > 0, F.col("events") / F.col("bars")))


def decision_points(bars: DataFrame, universe: DataFrame, events: DataFrame, low: int, high: int, horizon: int) -> DataFrame:
    """Bars of the universe in [low, high), those that lie in a positive window, their share and the rest's."""
    points = bars.where((F.col("ts_utc") >= low) & (F.col("ts_utc") < high)).join(universe.select("ticker").distinct(), "ticker", "left_semi").agg(F.count("*").alias("points"))
    positives = events.where((F.col("t0_utc") >= low) & (F.col("t0_utc") < high)).agg((F.count("*") * horizon).alias("positives"))
    base = F.when(F.col("points") > 0, F.col("positives") / F.col("points"))
    return points.join(F.broadcast(positives)).select("points", "positives", base.alias("base_rate"), (1 - base).alias("quiet_rate"))


def cascade(filings: DataFrame, members: DataFrame, exclusions: DataFrame, low: int, high: int, excluded: tuple[str, ...], scheduled: tuple[str, ...]) -> DataFrame:
    """``filings`` with ``is_scheduled``, ``exclude_reason`` and ``kept``: out of scope first, then by items, and only then
    by what prices cover, as what is no event isn't a matter of coverage. ``members``: ticker;
    ``exclusions``: accession_no, reason."""
    known = members.select("ticker").distinct().withColumn("__member", F.lit(True))
    out = filings.join(known, "ticker", "left").join(exclusions.select("accession_no", F.col("reason").alias("__cover")), "accession_no", "left")
    scope = scope_reason(F.col("acceptance_utc"), low, high, F.coalesce("__member", F.lit(False)))
    reason = F.coalesce(scope, item_reason(F.col("items"), excluded), "__cover")
    out = out.withColumn("is_scheduled", is_scheduled(F.col("items"), excluded, scheduled)).withColumn("exclude_reason", reason)
    return out.withColumn("kept", reason.isNull()).drop("__member", "__cover")


def surviving(events: DataFrame) -> DataFrame:
    """``events``, or an error that names the commonest reason if none is left."""
    reason = dominant_reason(events)
    if reason is not None:
        raise ValueError(f"every event was excluded, most as {reason!r}")
    return events


def dominant_reason(events: DataFrame) -> Column | None:
    """The commonest reason if every event has one, else None: a cascade that leaves nothing must fail."""
    if not events.where("exclude_reason IS NULL").isEmpty():
        return None
    first = top(events, ["exclude_reason"], 1).first()
    return first[0] if first else None
