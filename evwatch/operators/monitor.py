"""The monitor: the newest bars' features, scans of all detectors, and one cycle of a live run."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from evwatch.operators import alertlog
from evwatch.operators.detectors import Detector
from evwatch.tables import stored


def latest_bars(matrix: DataFrame, as_of: int, lookback: int) -> DataFrame:
    """The last ``lookback`` bars up to ``as_of`` of each ticker, of features on the full history, as
    windows of their own without labels. No bars at all raise when it is read."""
    newest = Window.partitionBy("ticker").orderBy(F.col("ts_utc").desc())
    rows = matrix.where(F.col("ts_utc") <= as_of).withColumn("__n", F.row_number().over(newest)).where(F.col("__n") <= lookback).drop("__n")
    labels = {"t0_utc": F.lit(None).cast("long"), "is_scheduled": F.lit(None).cast("boolean"), "item_code": F.lit(None).cast("string")}
    return rows.withColumn("window_id", F.concat_ws(":", F.lit("live"), "ticker", "ts_utc")).withColumns(labels)


def scan(frame: DataFrame, detectors: dict[str, Detector], thresholds: dict[str, float] | None = None) -> DataFrame:
    """Alerts of every detector at its threshold, given or its own, by time, detector and ticker."""
    found = []
    for name, detector in detectors.items():
        at = (thresholds or {}).get(name, detector.threshold)
        found.append(alertlog.scan(detector.predict(frame, at), name, at))
    return alertlog.ordered(reduce(DataFrame.unionByName, found))


def cycle(log: DataFrame | None, alerts: DataFrame, filings: DataFrame, days: DataFrame, span_h: int, edge: int) -> tuple[DataFrame, DataFrame]:
    """One run: alerts go into the log, due ones get outcomes, the chain is verified, and the table to
    show is made: the whole log and that table. A broken chain raises."""
    new = stored(alertlog.append(log, alerts))  # a chain that isn't folded anew each time it is read
    whole = new if log is None else log.unionByName(new)
    broken = alertlog.chain_breaks(whole).limit(1).collect()
    if broken:
        raise ValueError(f"the log of {broken[0].detector} breaks at {broken[0].seq}: {broken[0].kind}")
    known = alertlog.outcomes(whole, filings, days, span_h, edge)
    return whole, alertlog.states(whole, known, span_h, edge)
