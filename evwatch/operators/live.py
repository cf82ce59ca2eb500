"""A live run over stored tables: what lands is appended, scanned, logged, scored, verified and shown.

A ``Store`` is a folder of tables that are written batch by batch, each batch into a partition of its
own; the last step of a batch is to say that it is done. Readers see done batches only, and a batch
that runs again after a failure replaces what it had written, so nothing is written twice. The only
state between batches is in these tables: the log's last row of each detector carries its chain on.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evwatch.operators import alertlog, monitor
from evwatch.operators.detectors import Detector
from evwatch.schemas import TABLES

#: Columns of the log and of outcomes, and the keys by which rows of the tables are known again.
LOG = "alert_id string, ts_utc long, ticker string, detector string, score double, threshold double, seq long, prev_sha string, row_sha string"
OUTCOMES = "alert_id string, filed int, accession_no string, item_code string, t0_utc long, lead_trading_h double"
KEYS = {"bars": ("ticker", "ts_utc"), "filings": ("accession_no",), "log": ("alert_id",), "outcomes": ("alert_id",)}
NONE = -1


@dataclass
class Store:
    spark: SparkSession
    path: str
    bars_schema: str = TABLES["bars"]
    filings_schema: str = TABLES["filings"]

    def __post_init__(self) -> None:
        """An empty batch for each table, unless the folder has one."""
        self.schemas = {"bars": self.bars_schema, "filings": self.filings_schema, "log": LOG, "outcomes": OUTCOMES, "done": "n long"}
        for name, schema in self.schemas.items():
            rows = self.spark.createDataFrame([(0,)], schema) if name == "done" else self.spark.createDataFrame([], schema)
            rows.coalesce(1).write.mode("ignore").parquet(self.folder(name, NONE))

    def folder(self, name: str, batch: int) -> str:
        return f"{self.path}/{name}/batch={batch}"

    def last(self) -> int:
        """The last batch that is done; batches follow one another."""
        return self.rows("done").agg(F.max("batch")).first()[0]

    def rows(self, name: str) -> DataFrame:
        return self.spark.read.schema(f"{self.schemas[name]}, batch long").parquet(f"{self.path}/{name}")

    def table(self, name: str, upto: int) -> DataFrame:
        """Rows of the batches up to ``upto``; these are partitions, so no other is read."""
        return self.rows(name).where(F.col("batch") <= upto).drop("batch")

    def put(self, name: str, batch: int, rows: DataFrame) -> DataFrame:
        """Rows of a batch whose key isn't known, once each (of several the first by all columns), written."""
        key = KEYS[name]
        rest = [c.split()[0] for c in self.schemas[name].split(", ") if c.split()[0] not in key]
        rows = self.spark.createDataFrame([], self.schemas[name]).unionByName(rows.select(*(c for c in rows.columns if c in (*key, *rest))), allowMissingColumns=True)
        once = rows.groupBy(*key).agg(F.min(F.struct(*rest)).alias("__row")).select(*key, "__row.*")
        fresh = once.join(self.table(name, batch - 1).select(*key), list(key), "left_anti")
        fresh.write.mode("overwrite").parquet(self.folder(name, batch))
        return self.spark.read.schema(self.schemas[name]).parquet(self.folder(name, batch))

    def finish(self, batch: int) -> None:
        self.spark.createDataFrame([(0,)], "n long").coalesce(1).write.mode("overwrite").parquet(self.folder("done", batch))


def linked_breaks(log: DataFrame, new: DataFrame | None = None) -> DataFrame:
    """Rows of a log that don't follow from the row before, with what is wrong; of ``new`` rows only, if
    given, as older ones were verified before. Each row meets its predecessor by detector and number,
    so that a detector with most of the log is no task's alone."""
    rows = log if new is None else new
    before = log.select(F.col("detector").alias("__d"), (F.col("seq") + 1).alias("__seq"), F.col("row_sha").alias("__sha"))
    met = rows.join(before, (F.col("detector") == F.col("__d")) & (F.col("seq") == F.col("__seq")), "left")
    told = F.sha2(F.concat(F.col("prev_sha"), F.lit("|"), alertlog.row_text()), 256)
    kind = (
        F.when(F.col("__d").isNull() & (F.col("seq") != 1), "gap in seq")
        .when(F.col("prev_sha") != F.coalesce("__sha", F.lit("")), "prev_sha differs")
        .when(F.col("row_sha") != told, "row_sha differs")
    )
    return met.withColumn("kind", kind).where("kind IS NOT NULL").select("detector", "seq", "kind")


@dataclass
class Monitor:
    """``featurise``: all bars and all filings to the matrix (ticker, ts_utc, features); ``span_h``: hours in which a
    filing answers an alert; ``lookback``: newest bars of a ticker that are scanned."""

    store: Store
    detectors: dict[str, Detector]
    days: DataFrame
    featurise: Callable[[DataFrame, DataFrame], DataFrame]
    span_h: int
    lookback: int = 24

    def run(self, batch: int, bars: DataFrame, filings: DataFrame, as_of: int) -> bool:
        """One cycle, in order: bars and filings are appended, features made, detectors scanned, alerts
        logged, due alerts answered, the new links verified, and the batch is done. A batch that is done
        already changes nothing; False tells so. A broken link raises before the batch is done."""
        store = self.store
        if batch <= store.last():
            return False
        store.put("bars", batch, bars.where(F.col("ts_utc") <= as_of))
        store.put("filings", batch, filings)
        all_bars, all_filings = store.table("bars", batch), store.table("filings", batch)
        live = monitor.latest_bars(self.featurise(all_bars, all_filings), as_of, self.lookback)
        found = monitor.scan(live, self.detectors)
        old = store.table("log", batch - 1)
        new = store.put("log", batch, alertlog.append(old, found))
        log, known = store.table("log", batch), store.table("outcomes", batch - 1)
        due = log.join(known.select("alert_id"), "alert_id", "left_anti")
        filed = all_filings.withColumnRenamed("acceptance_utc", "filed_utc")
        store.put("outcomes", batch, alertlog.outcomes(due, filed, self.days, self.span_h, as_of))
        broken = linked_breaks(log, new).limit(1).collect()
        if broken:
            raise ValueError(f"the log of {broken[0].detector} breaks at {broken[0].seq}: {broken[0].kind}")
        store.finish(batch)
        return True

    def shown(self, as_of: int) -> DataFrame:
        """The log of done batches with each alert's state."""
        last = self.store.last()
        return alertlog.states(self.store.table("log", last), self.store.table("outcomes", last), self.span_h, as_of)

    def follow(self, bars: DataFrame, filings: Callable[[], DataFrame], checkpoint: str) -> None:
        """Cycles over a stream of bars that has landed, a cycle for each micro-batch; ``filings`` is read anew
        each time. Spark repeats a batch that failed under the same number, and so does the store."""

        def each(rows: DataFrame, batch: int) -> None:
            newest = rows.agg(F.max("ts_utc")).first()[0]
            if newest is not None:
                # Late bars don't take the run back behind what it has seen.
                before = self.store.table("bars", self.store.last()).agg(F.max("ts_utc")).first()[0]
                as_of = max(newest, before or newest)
                self.run(batch, rows, filings().where(F.col("acceptance_utc") <= as_of), as_of)

        query = bars.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()
