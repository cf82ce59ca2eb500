"""The monitor as Structured Streaming: bars from ticks, CUSUM with carried state, deduplicated
alerts, filings that follow them, and batches that run the same operators as a batch job."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from evwatch.operators.alertlog import CHAIN_FIELDS, row_text


def bars(ticks: DataFrame, late: str = "72 hours", slot: str = "1 hour") -> DataFrame:
    """Tumbling bars of ``ticks`` (ticker, ts timestamp, event_id, value)."""
    key = F.struct("ts", "event_id")
    out = ticks.withWatermark("ts", late).groupBy(F.window("ts", slot).alias("w"), "ticker").agg(
        F.min_by("value", key).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", key).alias("close"), F.round(F.sum("value"), 2).alias("volume")
    )
    return out.select("ticker", F.unix_seconds("w.start").alias("ts_utc"), "open", "high", "low", "close", "volume")


def announcements(events: DataFrame, gap: str, late: str = "72 hours") -> DataFrame:
    """Clusters of a ticker's events by session windows."""
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "ticker").agg(F.count("*").alias("n"), F.min("ts").alias("t0"))


def once(alerts: DataFrame, late: str = "72 hours") -> DataFrame:
    """An alert id once, whatever scans overlap."""
    return alerts.withWatermark("ts", late).dropDuplicatesWithinWatermark(["alert_id"])


def followed(alerts: DataFrame, filings: DataFrame, span: str = "48 hours", late: str = "72 hours") -> DataFrame:
    """Alerts with the filings strictly after them within ``span``, or with none."""
    a, f = alerts.withWatermark("ts", late).alias("a"), filings.withWatermark("filed", late).alias("f")
    near = F.expr(f"f.ticker = a.ticker AND f.filed > a.ts AND f.filed <= a.ts + INTERVAL {span}")
    return a.join(f, near, "leftOuter").select("a.alert_id", "a.ticker", "a.ts", "f.accession_no", "f.filed")


def cusum(values: DataFrame, k: float, h: float) -> DataFrame:
    """CUSUM carried from batch to batch by ticker. ``values``: ticker, ts_utc, x, each ticker's
    rows in time order over the batches."""

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (s,) = state.get if state.exists else (0.0,)
        rows = pd.concat(list(parts)).sort_values("ts_utc", kind="stable")
        told = []
        for x in rows["x"].tolist():
            if x is None or x != x or abs(x) == float("inf"):
                told.append(None)
                continue
            s = max(0.0, s + x - k)
            told.append(s)
            s = 0.0 if s >= h else s
        state.update((s,))
        yield pd.DataFrame({"ticker": key[0], "ts_utc": rows["ts_utc"], "cusum": told})

    return values.groupBy("ticker").applyInPandasWithState(fold, "ticker string, ts_utc long, cusum double", "s double", "append", GroupStateTimeout.NoTimeout)


def chained(alerts: DataFrame) -> DataFrame:
    """``seq``, ``prev_sha`` and ``row_sha`` of alerts as they come: each detector's last number and hash are its
    state. Alerts of a batch go in by time, ticker and id; ids are to be told ``once`` before."""
    kinds = dict(alerts.dtypes)

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seq, sha = state.get if state.exists else (0, "")
        rows = pd.concat(list(parts)).sort_values(["ts_utc", "ticker", "alert_id"], kind="stable").reset_index(drop=True)
        told = []
        for text in rows.pop("text"):
            before, seq = sha, seq + 1
            sha = hashlib.sha256(f"{before}|{text}".encode()).hexdigest()
            told.append((seq, before, sha))
        state.update((seq, sha))
        yield pd.concat([rows[list(CHAIN_FIELDS)], pd.DataFrame(told, columns=["seq", "prev_sha", "row_sha"])], axis=1)

    schema = ", ".join(f"{c} {kinds[c]}" for c in CHAIN_FIELDS) + ", seq long, prev_sha string, row_sha string"
    rows = alerts.select(*CHAIN_FIELDS, row_text().alias("text"))
    return rows.groupBy("detector").applyInPandasWithState(fold, schema, "seq long, sha string", "append", GroupStateTimeout.NoTimeout)


def news_windows(news: DataFrame, hours: int, slide: str = "1 hour", late: str = "72 hours") -> DataFrame:
    """Articles and distinct publishers of each ticker in (t - W, t] at each ``t`` of the slide. ``news``: ticker,
    publisher, ts timestamp of whole seconds. Publishers are counted by a second grouping of the same
    windows, so none are gathered."""
    # Windows are closed at their start and open at their end, so they are moved on by a second.
    w = F.window("ts", f"{hours} hours", slide, "1 second").alias("w")
    by_publisher = news.withWatermark("ts", late).groupBy(w, "ticker", "publisher").agg(F.count("*").alias("n"))
    out = by_publisher.groupBy("w", "ticker").agg(F.sum("n").alias("news_count"), F.count("*").alias("news_breadth"))
    return out.select("ticker", (F.unix_seconds("w.end") - 1).alias("ts_utc"), "news_count", "news_breadth")


def past_mark(rows: DataFrame, by: str, ts: str) -> DataFrame:
    """Rows later than any of their key in an earlier batch: the mark is a number in the key's state. Files
    that land again and late rows change nothing; of rows of one time in a batch the first by all
    columns stays. A benchmark is a key like any other and goes on from its own mark."""
    kinds = dict(rows.dtypes)
    columns = rows.columns

    def fold(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        (mark,) = state.get if state.exists else (None,)
        new = pd.concat(list(parts)).sort_values([ts, *(c for c in columns if c != ts)], kind="stable").drop_duplicates(ts)
        new = new if mark is None else new[new[ts] > mark]
        if len(new):
            state.update((int(new[ts].max()),))
        yield new[columns]

    schema = ", ".join(f"{c} {kinds[c]}" for c in columns)
    return rows.where(F.col(ts).isNotNull()).groupBy(by).applyInPandasWithState(fold, schema, "mark long", "append", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, checkpoint: str, each: Callable[[DataFrame, int], None]) -> None:
    """Everything that has landed, in batches given to ``each``, then stop."""
    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
