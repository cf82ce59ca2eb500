"""The frames that the registered queries share: adapters with the parameters of ``SMALL``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evwatch.config import SMALL
from evwatch.functions import scalars, timecal
from evwatch.operators import alertlog, contract, detectors, features, sampling
from evwatch.plans.views_sql import HIGH, LOW
from evwatch.sources import adapters


def with_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    return adapters.hourly_bars(spark, sf_dir).withColumn("volume_z", features.volume_z(SMALL.z_window, SMALL.z_min))


def market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mean over all tickers, as the benchmark; sums are of cents, so they are exact."""
    def mean(c: str):
        return (F.sum(F.round(F.col(c) * 100).cast("long")) / (100.0 * F.count("*"))).alias(c)

    return adapters.hourly_bars(spark, sf_dir).groupBy("ts_utc").agg(mean("open"), mean("close"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = adapters.filings(spark, sf_dir)
    reason = F.coalesce(scalars.scope_reason(F.col("acceptance_utc"), LOW, HIGH - 1, F.lit(True)), scalars.item_reason(F.col("items"), SMALL.excluded_items))
    scheduled = scalars.is_scheduled(F.col("items"), SMALL.excluded_items, SMALL.scheduled_items)
    return rows.where(reason.isNull()).select(scalars.event_id(F.col("accession_no")).alias("event_id"), "accession_no", "ticker", "items", F.col("acceptance_utc").alias("t0_utc"), scheduled.alias("is_scheduled"))


def frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.eval_frame(with_z(spark, sf_dir), labelled(spark, sf_dir), SMALL.horizon_bars, LOW, HIGH)


def predictions(spark: SparkSession, sf_dir: str, detector: detectors.Detector | None = None) -> DataFrame:
    return (detector or detectors.VolumeZ(SMALL.z_threshold)).predict(frame(spark, sf_dir))


def clock(spark: SparkSession) -> DataFrame:
    return timecal.clock(adapters.sessions(spark))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = predictions(spark, sf_dir).withColumn("score", F.round("score", 6))
    return alertlog.scan(rows, "volume_z", SMALL.z_threshold)


def edge(spark: SparkSession, sf_dir: str) -> int:
    """The newest filing less the lookback: later spans can't be answered yet."""
    return adapters.filings(spark, sf_dir).agg(F.max("acceptance_utc") - SMALL.t0_lookback_s).first()[0]


def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    filed = adapters.filings(spark, sf_dir).withColumnRenamed("acceptance_utc", "filed_utc")
    return alertlog.outcomes(alerts(spark, sf_dir), filed, clock(spark), SMALL.outcome_h, edge(spark, sf_dir))
