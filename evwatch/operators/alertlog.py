"""The append-only alert log: a hash chain for each detector, deferred outcomes, and the tables
that a dashboard shows of them."""

from __future__ import annotations

import hashlib

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evwatch.config import DAY
from evwatch.functions.scalars import among, multiple, parse_items
from evwatch.operators.joins import asof

#: Columns that an alert has, and its row of the log.
CHAIN_FIELDS = ("alert_id", "ts_utc", "ticker", "detector", "score", "threshold")


def alert_id(detector: Column, ticker: Column, ts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", detector, ticker, ts), 256), 1, 24)


def row_text() -> Column:
    return F.concat_ws("|", "alert_id", "ts_utc", "ticker", "detector", F.format_string("%.6f", "score"), F.format_string("%.6f", "threshold"))


def scan(predictions: DataFrame, detector: str, threshold: float) -> DataFrame:
    """Alerts of the rows that a detector flags; of a ticker's windows at one time, that of the first."""
    fired = predictions.where("action = 'FLAG'").groupBy("ticker", "ts_utc").agg(F.min_by("score", "window_id").alias("score"))
    fired = fired.select("ticker", "ts_utc", F.lit(detector).alias("detector"), "score", F.lit(threshold).cast("double").alias("threshold"))
    return fired.withColumn("alert_id", alert_id(F.col("detector"), F.col("ticker"), F.col("ts_utc")))


def with_features(alerts: DataFrame, matrix: DataFrame, columns: list[str]) -> DataFrame:
    """``alerts`` with ``features``: JSON of their row of ``matrix``, of several the first by all
    columns; values that aren't finite are null. Without a row it is null."""
    from evwatch.functions.scalars import finite

    told = F.struct(*(finite(F.col(c).cast("double")).alias(c) for c in columns))
    rows = matrix.groupBy("ticker", "ts_utc").agg(F.min(told).alias("__row"))
    out = alerts.join(rows, ["ticker", "ts_utc"], "left")
    return out.withColumn("features", F.to_json("__row", {"ignoreNullFields": "false"})).drop("__row")


def ordered(alerts: DataFrame, appending: bool = False) -> DataFrame:
    """As scans tell alerts, by time, or as they are appended, by detector first."""
    return alerts.orderBy(*(("detector", "ts_utc", "ticker") if appending else ("ts_utc", "detector", "ticker")))


def append(log: DataFrame | None, alerts: DataFrame) -> DataFrame:
    """New rows for the log: known ids are skipped, ``seq`` and ``prev_sha`` go on from each
    detector's last row. A chain is one after the other by nature; its fold holds a batch's rows
    of one detector, as the log is written a batch at a time."""
    new = alerts.select(*CHAIN_FIELDS, row_text().alias("text"))
    if log is not None:
        new = new.join(log.select("alert_id"), "alert_id", "left_anti")
        heads = log.groupBy("detector").agg(F.max("seq").alias("last_seq"), F.max_by("row_sha", "seq").alias("head"))
        new = new.join(heads, "detector", "left")
    else:
        new = new.withColumn("last_seq", F.lit(None).cast("long")).withColumn("head", F.lit(None).cast("string"))
    order = [(c, "ascending") for c in ("ts_utc", "ticker", "text", "alert_id", "score", "threshold")]

    def fold(rows: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, order, null_placement="at_start"))
        last, sha = rows.column("last_seq")[0].as_py() or 0, rows.column("head")[0].as_py() or ""
        prev, shas = [], []
        for text in rows.column("text").to_pylist():
            prev.append(sha)
            sha = hashlib.sha256(f"{sha}|{text}".encode()).hexdigest()
            shas.append(sha)
        links = {"seq": pa.array(range(last + 1, last + 1 + len(shas)), pa.int64()), "prev_sha": pa.array(prev, pa.string()), "row_sha": pa.array(shas, pa.string())}
        return pa.table({**{c: rows.column(c) for c in CHAIN_FIELDS}, **links})

    kinds = dict(new.dtypes)
    return new.groupBy("detector").applyInArrow(fold, ", ".join(f"{c} {kinds[c]}" for c in CHAIN_FIELDS) + ", seq long, prev_sha string, row_sha string")


def chain_breaks(log: DataFrame) -> DataFrame:
    """The first break of each detector's chain, with its kind; no row if all hold."""
    of = Window.partitionBy("detector").orderBy("seq")
    told = F.sha2(F.concat(F.col("prev_sha"), F.lit("|"), row_text()), 256)
    kind = (
        F.when(F.col("seq") != F.coalesce(F.lag("seq").over(of), F.lit(0)) + 1, "gap in seq")
        .when(F.col("prev_sha") != F.coalesce(F.lag("row_sha").over(of), F.lit("")), "prev_sha differs")
        .when(F.col("row_sha") != told, "row_sha differs")
    )
    return log.withColumn("kind", kind).where("kind IS NOT NULL").groupBy("detector").agg(F.min("seq").alias("seq"), F.min_by("kind", "seq").alias("kind"))


def outcomes(alerts: DataFrame, filings: DataFrame, days: DataFrame, span_h: int, edge: int) -> DataFrame:
    """An outcome for each alert whose span has ended by ``edge``: the first filing strictly after
    it and within the span, by ``filed_utc``, with the trading hours of lead. ``filings``:
    ticker, filed_utc, accession_no, items."""
    from evwatch.functions.timecal import trading_hours

    due = alerts.where(F.col("ts_utc") + span_h * 3600 <= edge)
    found = asof(due, filings, "ticker", "ts_utc", "filed_utc", {"__at": F.col("filed_utc"), "__no": F.col("accession_no"), "__items": F.col("items")}, "forward", strict=True)
    hit = F.col("__at") <= F.col("ts_utc") + span_h * 3600
    out = found.withColumn("t0_utc", F.when(hit, F.col("__at"))).withColumn("accession_no", F.when(hit, F.col("__no"))).withColumn("item_code", F.when(hit, F.col("__items")))
    return trading_hours(out, days, "ts_utc", "t0_utc", "lead_trading_h", optional=True).select("alert_id", F.coalesce(hit, F.lit(False)).cast("int").alias("filed"), "accession_no", "item_code", "t0_utc", "lead_trading_h")


def unscored(alerts: DataFrame, known: DataFrame, limit: int | None = None) -> DataFrame:
    """Alerts without an outcome, the oldest first."""
    rows = alerts.join(known.select("alert_id"), "alert_id", "left_anti").orderBy("ts_utc", "detector", "ticker")
    return rows if limit is None else rows.limit(limit)


def hit_rates(alerts: DataFrame, known: DataFrame) -> DataFrame:
    rows = alerts.join(known, "alert_id", "left")
    filed = F.col("filed")
    return rows.groupBy("detector").agg(
        F.count("filed").alias("scored"), F.count_if(filed == 1).alias("n_filed"), F.count_if(filed == 0).alias("missed"), F.count_if(filed.isNull()).alias("pending"),
        F.avg(filed.cast("double")).alias("rate"), F.avg(F.when(filed == 1, F.col("lead_trading_h"))).alias("mean_lead_h"),
    )


def split_rates(alerts: DataFrame, known: DataFrame, scheduled: tuple[str, ...]) -> DataFrame:
    """Resolved alerts, and of them those followed by scheduled and by other filings."""
    rows = alerts.join(known.where("filed IS NOT NULL"), "alert_id").withColumn("__s", F.coalesce(among(parse_items(F.col("item_code")), scheduled), F.lit(False)))
    hit = F.col("filed") == 1
    return rows.groupBy("detector").agg(F.count("*").alias("resolved"), F.count_if(hit & F.col("__s")).alias("scheduled"), F.count_if(hit & ~F.col("__s")).alias("unscheduled"))


def states(alerts: DataFrame, known: DataFrame, span_h: int, edge: int) -> DataFrame:
    """filed, none, open (its span isn't over) or unscored."""
    rows = alerts.join(known.select("alert_id", "filed"), "alert_id", "left")
    state = F.when(F.col("filed") == 1, "filed").when(F.col("filed") == 0, "none").when(F.col("ts_utc") + span_h * 3600 > edge, "open").otherwise("unscored")
    return rows.withColumn("state", state).drop("filed")


def log_coverage(stated: DataFrame) -> DataFrame:
    state = F.col("state")
    graded = F.count_if(state.isin("filed", "none"))
    return stated.agg(F.count("*").alias("logged"), graded.alias("graded"), F.count_if(state == "open").alias("open"), F.count_if(state == "unscored").alias("unscored"), F.count_if(state != "open").alias("answerable"))


def item_breakdown(known: DataFrame) -> DataFrame:
    return known.where("filed = 1").groupBy("item_code").agg(F.count("*").alias("n"))


def log_summary(log: DataFrame) -> DataFrame:
    return log.groupBy("detector").agg(F.count("*").alias("n"), F.min("ts_utc").alias("first_ts"), F.max("ts_utc").alias("last_ts"))


def per_day(log: DataFrame) -> DataFrame:
    return log.groupBy(F.floor(F.col("ts_utc") / DAY).alias("day")).agg(F.count("*").alias("n"), F.max(multiple(F.col("score"), F.col("threshold"))).alias("strongest"))


def budget_line(log: DataFrame, universe: int | None, rate: float) -> DataFrame:
    """Alerts in the newest month that has any, and the month's allowance."""
    month = F.date_trunc("month", F.timestamp_seconds("ts_utc"))
    months = log.groupBy(month.alias("month")).agg(F.count("*").alias("n"))
    newest = months.orderBy(F.col("month").desc()).limit(1)
    return newest.select(F.date_format("month", "yyyy-MM").alias("month"), "n", F.lit(int(rate * universe) if universe is not None else None).cast("long").alias("allowance"))


def queue(stated: DataFrame, since: int, detector: str | None = None, state: str | None = None) -> DataFrame:
    rows = stated.where(F.col("ts_utc") >= since)
    if detector:
        rows = rows.where(F.col("detector") == detector)
    if state:
        rows = rows.where(F.col("state") == state)
    return rows.withColumn("multiple", multiple(F.col("score"), F.col("threshold"))).orderBy(F.col("multiple").desc(), "ts_utc", "ticker")


def queue_stats(stated: DataFrame) -> DataFrame:
    return stated.agg(F.count_if(F.col("state") == "open").alias("open"), F.count_if(F.col("state") == "unscored").alias("unscored"), F.max(multiple(F.col("score"), F.col("threshold"))).alias("strongest"))
