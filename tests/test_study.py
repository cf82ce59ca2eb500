"""Guards and whole-run operators that queries can't show: what must raise, what a template refuses."""

import pytest
from pyspark.sql import functions as F

from evwatch.config import SMALL
from evwatch.functions import timecal
from evwatch.operators import alertlog, contract, detectors, evaluation, joins, labels, merge, metrics, monitor, reports
from evwatch.plans import frames
from evwatch.sources import adapters, ingest

SF = "/root/testdata/sf0.001"


def test_times_out_of_the_calendar_and_null_raise(spark):
    days = timecal.clock(adapters.sessions(spark))
    ask = lambda rows, **how: timecal.trading_hours(spark.createDataFrame(rows, "a long, b long"), days, "a", "b", "h", **how).collect()
    assert ask([(1704300000, 1704300000)])[0].h == 0
    for bad in [(1704300000, 1900000000), (1000, 1704300000), (None, 1704300000)]:
        with pytest.raises(Exception, match="out of the calendar"):
            ask([bad])
    assert ask([(1704300000, None)], optional=True)[0].h is None
    with pytest.raises(Exception, match="out of the calendar"):
        timecal.hours_to_close(spark.createDataFrame([(1900000000,)], "a long"), days, "a", "h").collect()


def test_filings_without_a_zone_are_rejected(spark):
    rows = [("1", "8-K", "2024-01-05T10:00:00Z"), ("2", "8-K", "2024-01-05T10:00:00"), ("3", "8-K", None), ("4", "8-K", "nonsense"), (None, "8-K", "2024-01-05T10:00:00+01:00"), ("6", "10-Q", "x")]
    raw = spark.createDataFrame([(*r, "", None) for r in rows], "accession_no string, form string, acceptance string, filing_date string, items string")
    good, bad = ingest.filing_rows(raw, ("8-K",))
    assert [r.accession_no for r in good.collect()] == ["1"] and good.first().acceptance_utc == 1704448800
    assert {r.accession_no for r in bad.collect()} == {"2", "3", "4", None}


def test_ranks_equal_sorted_lists(spark):
    for values in ([], [3.0], [1.0, 1.0, 2.0], [float(i * 37 % 101) for i in range(500)], [5.0] * 50):
        df = spark.createDataFrame([(v,) for v in [*values, None]], "x double")
        got = labels.nearest_rank(df, "x", [0.1, 0.5, 0.99]).first()
        n = len(values)
        assert list(got) == [sorted(values)[min(int(n * p), n - 1)] if n else None for p in (0.1, 0.5, 0.99)]
        summary = df.where("x IS NOT NULL").withColumnRenamed("x", "peak")
        for budget in (0, 1, 2, n, n + 5):
            want = float("inf") if budget == 0 else float("-inf") if budget >= n else sorted(values)[n - budget]
            assert metrics.threshold_at(summary, budget) == want


def test_template_refuses(spark):
    rows = [("w", "t", i * 3600, 90_000, True, "2.02", x) for i, x in enumerate([None, 1.0, 3.0])] + [("v", "t", 7200, None, None, None, None)]
    frame = spark.createDataFrame(rows, "window_id string, ticker string, ts_utc long, t0_utc long, is_scheduled boolean, item_code string, volume_z double")
    z = detectors.VolumeZ(2.0)
    assert [r.action for r in z.predict(frame.where("window_id = 'w'")).orderBy("ts_utc").collect()] == ["WAIT", "WAIT", "FLAG"]
    with pytest.raises(ValueError, match="volume_z"):
        z.predict(frame.drop("volume_z"))
    with pytest.raises(Exception, match="sealed"):
        z.predict(frame, sealed=(3600, 7200)).collect()
    with pytest.raises(Exception, match="no finite score in v"):
        z.predict(frame, unscoreable="error").collect()
    no_code = z.predict(frame).withColumn("item_code", F.lit(None).cast("string"))
    with pytest.raises(ValueError, match="item_code"):
        contract.validated(no_code)
    with pytest.raises(ValueError, match="no predictions"):
        contract.validated(z.predict(frame.limit(0)))


def test_monitor_cycle_is_idempotent_and_sees_tampering(spark):
    found, by = frames.alerts(spark, SF), adapters.filings(spark, SF).withColumnRenamed("acceptance_utc", "filed_utc")
    run = lambda log: monitor.cycle(log, found, by, frames.clock(spark), SMALL.outcome_h, 1706486400)
    log, _ = run(None)
    again, shown = run(log)
    assert again.count() == log.count() == found.count() == shown.count() > 5
    with pytest.raises(ValueError, match="breaks at 3: row_sha differs"):
        run(log.withColumn("score", F.when(F.col("seq") == 3, 99.0).otherwise(F.col("score"))))


def test_flags_that_cannot_be_set_are_named(spark):
    rows = spark.createDataFrame([("A", None), ("B", "9")], "ticker string, successor_cik string")
    survivors = spark.createDataFrame([("A", 1.0, 2.0), ("B", 1.0, 2.0)], "ticker string, adv_usd double, last_price double")
    assert {r.ticker: r.in_universe for r in merge.replace_flags(rows, survivors.where("ticker = 'A'"), 1, 1).collect()} == {"A": 1, "B": 0}
    with pytest.raises(ValueError, match="without a row: B"):
        merge.replace_flags(rows, survivors, 1, 2)


def test_a_cascade_that_leaves_nothing_tells_its_commonest_reason(spark):
    events = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "y")], "event_id string, exclude_reason string")
    assert reports.dominant_reason(events) == "y"
    assert reports.dominant_reason(events.unionByName(spark.createDataFrame([("d", None)], events.schema))) is None
    assert merge.broken_reasons(events.withColumn("usable", F.lit(1))).count() == 3


def test_same_alert_of_two_windows_is_the_first_windows(spark):
    rows = spark.createDataFrame([("w2", "t", 5, 9.0, "FLAG"), ("w1", "t", 5, 3.0, "FLAG"), ("w1", "t", 6, 3.0, "WAIT")], "window_id string, ticker string, ts_utc long, score double, action string")
    assert [r.score for r in alertlog.scan(rows, "d", 1.0).collect()] == [3.0]


def test_longer_waits_keep_fewer_flags(spark):
    out = evaluation.tune_wait(frames.predictions(spark, SF), frames.clock(spark), [0.0, 1.0, 3.0]).collect()
    flags = {r["wait"]: r.flags for r in out}
    assert flags[0.0] > flags[1.0] >= flags.get(3.0, 0)


def counted(spark, frame):
    """``frame`` and how often a row of it has been made."""
    made = spark.sparkContext.accumulator(0)

    def seen(value):
        made.add(1)
        return value

    return frame.withColumn("volume_z", F.udf(seen, "double")("volume_z")), made


@pytest.mark.parametrize("names", [("volume_z",), ("volume_z", "random", "constant")])
def test_a_frame_is_made_once_for_all_detectors_and_checks(spark, names):
    frame = frames.frame(spark, SF).cache()
    rows, made = counted(spark, frame)
    found = evaluation.run_detectors(rows, {name: detectors.REGISTRY[name]() for name in names})
    assert found.count() == len(names) * frame.count() and made.value == frame.count()


def test_scores_are_made_once_for_the_floor_and_the_rows(spark):
    frame = frames.frame(spark, SF).cache()
    rows, made = counted(spark, frame)
    assert detectors.VolumeZ(1.5).predict(rows).count() == frame.count() == made.value


def test_proposed_names_equal_brute_force(spark):
    stems = ["abcde"] * 25 + ["abcdef"] * 3 + ["abcdefgh", "xy", "xy", "xyz", "lonely", "lonelyone"]
    names = [(f"{i:03d}", stem) for i, stem in enumerate(stems)]
    df = spark.createDataFrame(names, "cik string, stem string")
    got = {r.cik: (r.r_stem, r.n, r.status, r.candidates) for r in joins.propose(df, df).collect()}
    for cik, stem in names:
        near = [(len(s), s, c) for c, s in names if c != cik and (s == stem or len(s) >= 5 and stem.startswith(s))]
        best = sorted(c for n, _, c in near if n == max(near)[0])
        status = "none" if not best else "unresolved" if len(best) > 20 else "proposed"
        assert got[cik] == (max(near)[1] if near else None, len(best), status, best if status == "proposed" else None)
