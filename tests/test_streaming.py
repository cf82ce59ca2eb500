"""Streams over landed files give what the batch operators give."""

import pytest
from evwatch.operators import alertlog, detectors, features, live
from evwatch.sources import adapters
from evwatch.streaming import streams
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def few_partitions(spark):
    """State is kept by partition and batch; rows here are few."""
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.set("spark.sql.shuffle.partitions", "8")


def drain(stream, tmp_path, mode="append"):
    out = str(tmp_path / "out")
    query = stream.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    return out


def landed(spark, rows, tmp_path, order, n):
    """Rows in order of time over ``n`` files, read as a stream one file at a time."""
    path, table = str(tmp_path / "in"), rows.orderBy(order).toPandas()
    for part in table.groupby(lambda k: k * n // len(table)):
        spark.createDataFrame(part[1], rows.schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_bars_equal_batch(spark, tmp_path):
    ticks = adapters.read(spark, SF, "events").select(F.col("user_id").cast("string").alias("ticker"), F.col("ts").cast("timestamp").alias("ts"), "event_id", "value")
    got = spark.read.parquet(drain(streams.bars(landed(spark, ticks, tmp_path, "ts", 3)), tmp_path))
    want = adapters.hourly_bars(spark, SF)
    newest = got.agg(F.max("ts_utc")).first()[0]
    a = {tuple(r) for r in got.select("ticker", "ts_utc", "open", "high", "low", "close", "volume").collect()}
    b = {tuple(r) for r in want.where(F.col("ts_utc") <= newest).collect()}
    assert a and a == {r for r in b if r[1] <= newest}


def test_cusum_state_is_carried(spark, tmp_path):
    bars = adapters.hourly_bars(spark, SF).select("ticker", "ts_utc", (F.col("volume") - 20).alias("x"))
    got = spark.read.parquet(drain(streams.cusum(landed(spark, bars, tmp_path, "ts_utc", 3), 0.5, 60.0), tmp_path))
    want = detectors.cusum(bars.withColumnRenamed("x", "volume_z"), 0.5, 60.0)
    key = lambda df: sorted((r.ticker, r.ts_utc, round(r.cusum, 6)) for r in df.collect())
    assert key(got) == key(want)


def test_alerts_once_and_batches(spark, tmp_path):
    alerts = adapters.read(spark, SF, "events").select(F.col("event_id").cast("string").alias("alert_id"), F.col("ts").cast("timestamp").alias("ts"))
    twice = alerts.unionByName(alerts)
    assert spark.read.parquet(drain(streams.once(landed(spark, twice, tmp_path, "ts", 2)), tmp_path)).count() == alerts.count()
    seen = []
    source = spark.readStream.schema(twice.schema).parquet(str(tmp_path / "in"))
    streams.run_available(source, str(tmp_path / "cp2"), lambda df, i: seen.append(df.count()))
    assert sum(seen) == twice.count()


def test_filings_follow_alerts(spark, tmp_path):
    rows = [("x", "A", 1_700_000_000), ("y", "B", 1_700_000_000), ("late", "Z", 1_709_000_000)]
    alerts = spark.createDataFrame(rows, "alert_id string, ticker string, t long").select("alert_id", "ticker", F.timestamp_seconds("t").alias("ts"))
    filed = spark.createDataFrame([("A", "n1", 1_700_003_600), ("B", "n2", 1_700_216_000), ("Z", "n3", 1_709_000_000)], "ticker string, accession_no string, t long").select("ticker", "accession_no", F.timestamp_seconds("t").alias("filed"))
    (tmp_path / "a").mkdir(), (tmp_path / "b").mkdir()
    out = streams.followed(landed(spark, alerts, tmp_path / "a", "ts", 3), landed(spark, filed, tmp_path / "b", "filed", 3))
    got = {r.alert_id: r.accession_no for r in spark.read.parquet(drain(out, tmp_path)).collect()}
    assert got["x"] == "n1" and got.get("y") is None


def test_news_windows_equal_the_batch_feature(spark, tmp_path):
    news = adapters.news(spark, SF).select("ticker", "publisher", "published_utc")
    rows = news.withColumn("ts", F.timestamp_seconds("published_utc"))
    end = spark.createDataFrame([("end", "none", 1_800_000_000)], "ticker string, publisher string, published_utc long").withColumn("ts", F.timestamp_seconds("published_utc"))
    stream = landed(spark, rows.unionByName(end), tmp_path, "published_utc", 3)
    got = spark.read.parquet(drain(streams.news_windows(stream, 24, "12 hours"), tmp_path)).where("ticker <> 'end'")
    # At every end of a slide that has news: what the batch feature gives for a bar at that time.
    at = got.select("ticker", "ts_utc")
    want = features.news_features(at, news, (24,)).select("ticker", "ts_utc", "news_count_24h", "news_breadth_24h")
    a, b = ({tuple(r) for r in df.collect()} for df in (got, want))
    assert a == b and len(a) > 100
    low, high = news.agg(F.min("published_utc"), F.max("published_utc")).first()
    every = spark.range(low // 43200, high // 43200 + 4).select((F.col("id") * 43200).alias("ts_utc")).crossJoin(news.select("ticker").distinct())
    assert features.news_features(every, news, (24,)).where("news_count_24h > 0").count() == len(a)


def test_chain_state_equals_the_batch_chain(spark, tmp_path):
    rows = [(f"id{i:03d}", 1_700_000_000 + i * 60, f"T{i % 5}", f"d{i % 2}", i / 7, 0.5) for i in range(60)]
    alerts = spark.createDataFrame(rows, "alert_id string, ts_utc long, ticker string, detector string, score double, threshold double")
    got = spark.read.parquet(drain(streams.chained(landed(spark, alerts, tmp_path, "ts_utc", 4)), tmp_path))
    key = lambda df: sorted((r.alert_id, r.seq, r.prev_sha, r.row_sha) for r in df.collect())
    assert key(got) == key(alertlog.append(None, alerts))
    assert not live.linked_breaks(got).count()
    broken = got.withColumn("score", F.when(F.col("alert_id") == "id031", 9.0).otherwise(F.col("score"))).where("alert_id <> 'id010'")
    assert {(r.detector, r.seq, r.kind) for r in live.linked_breaks(broken).collect()} == {("d1", 16, "row_sha differs"), ("d0", 7, "gap in seq")}


def test_marks_by_key(spark, tmp_path):
    one = [("A", 1, 1.0), ("A", 2, 2.0), ("B", 1, 1.0), ("SPY", 5, 9.0)]
    two = [("A", 1, 7.0), ("A", 2, 2.0), ("A", 3, 3.0), ("A", 3, 4.0), ("B", 0, 0.0), ("SPY", 4, 8.0), ("SPY", 6, 9.5), ("C", None, 1.0)]
    path = str(tmp_path / "in")
    for part in (one, two, one, two):
        spark.createDataFrame(part, "ticker string, ts_utc long, close double").coalesce(1).write.mode("append").parquet(path)
    stream = spark.readStream.schema("ticker string, ts_utc long, close double").option("maxFilesPerTrigger", 1).parquet(path)
    got = sorted(tuple(r) for r in spark.read.parquet(drain(streams.past_mark(stream, "ticker", "ts_utc"), tmp_path)).collect())
    assert got == [("A", 1, 1.0), ("A", 2, 2.0), ("A", 3, 3.0), ("B", 1, 1.0), ("SPY", 5, 9.0), ("SPY", 6, 9.5)]


def watch(spark, path, fail_at=None):
    """A monitor whose features are the bars' closes, which may fail in a batch."""
    bars, filings = "ticker string, ts_utc long, close double", "accession_no string, ticker string, items string, acceptance_utc long"

    def featurise(rows, _):
        if fail_at is not None and store.last() == fail_at - 1:
            raise RuntimeError("lost")
        return rows.withColumn("volume_z", F.col("close"))

    store = live.Store(spark, path, bars, filings)
    sessions = adapters.sessions(spark)
    from evwatch.functions import timecal

    return live.Monitor(store, {"volume_z": detectors.VolumeZ(2.0)}, timecal.clock(sessions), featurise, 48, 4)


def test_live_run_over_a_stream(spark, tmp_path):
    """Three files with late and repeated rows; the second batch fails once, after it has written bars."""
    start = 1_705_000_000
    bars = [[("A", start, 1.0), ("A", start + 3600, 3.0), ("B", start, 2.5)], [("A", start, 1.0), ("A", start + 3600, 9.0), ("B", start + 200_000, 2.1)], [("A", start + 400_000, 5.0), ("C", start + 10, 0.0)]]
    filings = spark.createDataFrame([("n1", "A", "8.01", start + 7200), ("n2", "B", "1.01", start + 399_000)], "accession_no string, ticker string, items string, acceptance_utc long")
    for part in bars:
        spark.createDataFrame(part, "ticker string, ts_utc long, close double").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("ticker string, ts_utc long, close double").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="lost"):
        watch(spark, str(tmp_path / "store"), fail_at=1).follow(source, lambda: filings, str(tmp_path / "cp"))
    run = watch(spark, str(tmp_path / "store"))
    assert run.store.last() == 0
    run.follow(source, lambda: filings, str(tmp_path / "cp"))
    last = run.store.last()
    assert last == 2 and run.store.table("bars", last).count() == 6
    log = run.store.table("log", last)
    assert sorted((r.ticker, r.ts_utc - start, r.score) for r in log.collect()) == [("A", 3600, 3.0), ("A", 400_000, 5.0), ("B", 0, 2.5), ("B", 200_000, 2.1)]
    assert sorted(r.seq for r in log.collect()) == [1, 2, 3, 4] and not live.linked_breaks(log).count() and not alertlog.chain_breaks(log).count()
    state = {(r.ticker, r.ts_utc - start): r.state for r in run.shown(start + 400_000).collect()}
    assert state == {("A", 3600): "filed", ("B", 0): "none", ("B", 200_000): "none", ("A", 400_000): "open"}
    before = sorted(map(tuple, log.collect()))
    run.follow(source, lambda: filings, str(tmp_path / "cp2"))  # all files again, as batches that are done
    assert sorted(map(tuple, run.store.table("log", run.store.last()).collect())) == before
