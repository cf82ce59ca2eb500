"""The sealed test period: its state is an append-only table, and guards read it as of a time.

``history``: at_utc, sealed, reason. What was never sealed or unsealed counts as sealed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evwatch.operators.joins import asof

HISTORY = "at_utc long, sealed boolean, reason string"


def turned(spark: SparkSession, at: int, sealed: bool, reason: str | None = None) -> DataFrame:
    """A row for the history. Opening the seal needs a reason."""
    if not sealed and not (reason or "").strip():
        raise ValueError("the seal is opened for a reason only")
    return spark.createDataFrame([(at, sealed, reason)], HISTORY)


def recorded(spark: SparkSession, path: str) -> DataFrame:
    """The history in a folder; an empty one before the first row."""
    spark.createDataFrame([], HISTORY).coalesce(1).write.mode("ignore").parquet(f"{path}/none")
    return spark.read.schema(HISTORY).option("recursiveFileLookup", "true").parquet(path)


def record(path: str, row: DataFrame) -> None:
    row.coalesce(1).write.mode("append").parquet(f"{path}/rows")


def is_sealed(history: DataFrame, now: int) -> Column:
    """Whether the period is sealed at ``now``, as a scalar subquery. Of two rows at a time the sealing one counts."""
    last = history.where(F.col("at_utc") <= now).agg(F.max_by("sealed", F.struct("at_utc", F.col("sealed").cast("int"))).alias("sealed"))
    return F.coalesce(last.scalar(), F.lit(True))


def states(rows: DataFrame, ts: str, history: DataFrame) -> DataFrame:
    """``rows`` with ``sealed``, the state at their time, and the reason on record."""
    turns = history.groupBy("at_utc").agg(F.max("sealed").alias("sealed"), F.max_by("reason", F.struct(F.col("sealed").cast("int"), "reason")).alias("reason"))
    turns = turns.withColumn("__all", F.lit(0))
    out = asof(rows.withColumn("__all", F.lit(0)), turns, "__all", ts, "at_utc", {"sealed": F.col("sealed"), "reason": F.col("reason")}, slice_s=7 * 86400)
    return out.withColumn("sealed", F.coalesce("sealed", F.lit(True))).drop("__all")


def guarded(df: DataFrame, ts: str, start: int, end: int, history: DataFrame, now: int) -> DataFrame:
    """``df``; a row with start <= ts < end raises when it is read, if the period is sealed at ``now``."""
    inside = (F.col(ts) >= start) & (F.col(ts) < end) & is_sealed(history, now)
    return df.where(F.when(inside, F.raise_error(F.lit("the period is sealed")).cast("boolean")).otherwise(F.lit(True)))
