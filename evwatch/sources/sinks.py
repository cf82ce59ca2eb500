"""Writing and reading results, with the guards that keep a file from losing rows."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from evwatch.config import DAY
from evwatch.schemas import TABLES


def write_matrix(matrix: DataFrame, folder: str, arm: str = "features") -> str:
    """Overwrites, never appends; the name tells the ablation arm."""
    path = f"{folder}/{arm}"
    matrix.write.mode("overwrite").parquet(path)
    return path


def update_matrix(part: DataFrame, folder: str, arm: str = "features") -> str:
    """Writes months of a matrix: those that ``part`` has rows of are replaced as a whole, others stay as they
    are, files and all."""
    path = f"{folder}/{arm}-by-month"
    month = F.date_format(F.timestamp_seconds("ts_utc"), "yyyy-MM")
    dealt = part.withColumn("month", month).repartition("month", F.pmod(F.xxhash64("ticker"), F.lit(8)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    return path


def read_matrix(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    rows = spark.read.parquet(path)
    if low is not None:
        rows = rows.where(F.col("ts_utc") >= low)
    return rows.where(F.col("ts_utc") < high) if high is not None else rows


def export_log(log: DataFrame, path: str, on_record: DataFrame | None) -> None:
    """The alert log as CSV; refuses if a detector would have fewer rows than on record."""
    if on_record is not None:
        shrunk = shrinking(log, on_record).limit(5).collect()
        if shrunk:
            raise ValueError(f"fewer rows than on record: {', '.join(r.detector for r in shrunk)}")
    log.repartitionByRange("detector", "seq").sortWithinPartitions("detector", "seq").write.mode("overwrite").csv(path, header=True)


def shrinking(log: DataFrame, on_record: DataFrame) -> DataFrame:
    now, then = log.groupBy("detector").agg(F.count("*").alias("now")), on_record.groupBy("detector").agg(F.count("*").alias("then"))
    return then.join(now, "detector", "left").na.fill(0, ["now"]).where("now < then")


def import_log(spark: SparkSession, path: str, known: DataFrame | None = None) -> DataFrame:
    """Rows as exported, hashes and all, but for keys that are known."""
    rows = spark.read.schema(TABLES["alerts"]).csv(path, header=True, enforceSchema=False)
    return rows if known is None else rows.join(known.select("alert_id"), "alert_id", "left_anti")


def read_result(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A result table, or an empty one if there is no file."""
    try:
        return spark.read.schema(schema).csv(path, header=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def unpack(rows: DataFrame, column: str, keys: list[str]) -> DataFrame:
    """A JSON object of numbers as one column for each key."""
    parsed = F.from_json(column, "map<string,double>")
    return rows.withColumns({k: parsed[k] for k in keys})


def keys_of(rows: DataFrame, column: str) -> DataFrame:
    return rows.select(F.explode(F.map_keys(F.from_json(column, "map<string,double>"))).alias("key")).distinct()


def snapshot(bars: DataFrame, filings: DataFrame, keep: DataFrame, days: int, filing_days: int) -> dict[str, DataFrame]:
    """The newest part of the tables for tickers in ``keep``."""
    newest = bars.agg(F.max("ts_utc").alias("__newest"))
    recent = lambda df, ts, n: df.join(F.broadcast(newest)).where(F.col(ts) >= F.col("__newest") - n * 86400).drop("__newest")  # noqa: E731  one row
    return {"bars": recent(bars, "ts_utc", days).join(keep.select("ticker"), "ticker", "left_semi"), "filings": recent(filings, "acceptance_utc", days + filing_days)}


def write_snapshot(tables: dict[str, DataFrame], keep: DataFrame, newest: int, days: dict[str, int], path: str, ts: dict[str, str]) -> DataFrame:
    """Writes a part of each table and tells a manifest: table, rows, first_utc, last_utc.

    Of a table with a ``ticker`` the tickers in ``keep`` stay (a benchmark's may be among them), others
    are taken whole; of one in ``days`` the rows stay whose time (column ``ts``) is at most so many days
    before ``newest``. Counts are observed while the tables are written."""
    told = []
    for name, rows in tables.items():
        if "ticker" in rows.columns:
            rows = rows.join(keep.select("ticker").distinct(), "ticker", "left_semi")
        if name in days:
            rows = rows.where(F.col(ts[name]) >= newest - days[name] * DAY)
        at = F.col(ts[name]) if name in ts else F.lit(None).cast("long")
        seen = Observation(f"snapshot-{name}-{uuid.uuid4().hex}")
        rows.observe(seen, F.count("*").alias("rows"), F.min(at).alias("low"), F.max(at).alias("high")).write.mode("overwrite").parquet(f"{path}/{name}")
        told.append((name, seen.get["rows"], seen.get["low"], seen.get["high"]))
    out = keep.sparkSession.createDataFrame(told, "table string, rows long, first_utc long, last_utc long")
    out.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest")
    return out


def browse(rows: DataFrame, where: str | None = None, columns: list[str] | None = None, limit: int = 50, offset: int = 0, raw: bool = False) -> DataFrame:
    """A page of a table; ``*_utc`` columns are told as times unless ``raw``. An unknown column raises."""
    if where:
        rows = rows.where(where)
    rows = rows.select(*columns) if columns else rows
    page = rows.orderBy(*rows.columns).offset(offset).limit(limit)
    if raw:
        return page
    return page.withColumns({c: F.date_format(F.timestamp_seconds(c), "yyyy-MM-dd HH:mm:ss'Z'") for c in page.columns if c.endswith("_utc")})


def inventory(tables: dict[str, DataFrame]) -> DataFrame:
    counts = [df.agg(F.count("*").alias("rows")).select(F.lit(name).alias("dataset"), "rows") for name, df in tables.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


def not_empty(rows: DataFrame, attempted: int, what: str) -> DataFrame:
    """``rows``; a run that attempted work and has none of them fails."""
    if attempted and rows.isEmpty():
        raise ValueError(f"{attempted} attempted, no {what} read")
    return rows


def run_guard(attempts: DataFrame, known_empty: DataFrame) -> DataFrame:
    """One row on a run's ``attempts`` (key, records): keys attempted, those known to have nothing, those of
    the rest with records, and ``failed``: there was a rest and none of it has any. Attempts of a resumed
    run count with those before it, a key once."""
    once = attempts.groupBy("key").agg(F.max(F.coalesce("records", F.lit(0))).alias("records"))
    empty = known_empty.select("key").distinct().withColumn("__empty", F.lit(True))
    rows = once.join(empty, "key", "left").withColumn("__empty", F.col("__empty").isNotNull() & (F.col("records") == 0))
    counted = rows.agg(F.count("*").alias("attempted"), F.count_if("__empty").alias("known_empty"), F.count_if(F.col("records") > 0).alias("with_records"))
    return counted.withColumn("failed", (F.col("attempted") > F.col("known_empty")) & (F.col("with_records") == 0))


def guarded_run(attempts: DataFrame, known_empty: DataFrame, what: str) -> None:
    told = run_guard(attempts, known_empty).first()
    if told.failed:
        raise ValueError(f"{told.attempted - told.known_empty} attempted, no {what} read")


def not_frozen(batch: DataFrame, frozen_from: int | None, enforced: bool = True) -> DataFrame:
    """``batch``; rows from before the freeze stamp fail, and so does a missing stamp."""
    if not enforced:
        return batch
    if frozen_from is None:
        raise ValueError("no freeze stamp on record")
    early = F.when(F.col("ts_utc") < frozen_from, F.raise_error(F.lit("the snapshot is frozen")).cast("boolean")).otherwise(F.lit(True))
    return batch.where(early)
