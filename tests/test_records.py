"""Counts, guards, snapshots, the seal, training frames, look-ahead."""

import os

import pytest
from evwatch.config import SMALL
from evwatch.functions import scalars, timecal
from evwatch.operators import evaluation, features, merge, reports, seal, universe
from evwatch.sources import adapters, ingest, scans, sinks
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_counts_come_with_the_write(spark, tmp_path):
    rows = [("1", "8-K", "2024-01-05T10:00:00Z", "2024-01-04"), ("2", "8-K", "2024-01-05T10:00:00", ""), ("", "8-K", "2024-01-05T10:00:00Z", None), (None, "8-K", "x", "x"), ("5", "10-Q", "x", ""), ("6", None, None, None)]
    raw = spark.createDataFrame([(*r, "", "2.02") for r in rows], "accession_no string, form string, acceptance string, report_date string, filing_date string, items string")
    good, told = ingest.counted_filings(raw, ("8-K",))
    good.write.parquet(str(tmp_path / "f"))
    assert told.get == {"read": 6, "other_form": 2, "no_key": 2, "no_time": 1, "kept": 1}
    assert spark.read.parquet(str(tmp_path / "f")).first().report_date_utc == 1704326400
    nan = float("nan")
    bars = [("A", 1, 0, 1.0, 2.0, 0.5, 1.5, None), ("A", 1, 1, 1.0, 2.0, 0.5, 1.6, 3.0), ("A", 2, 2, None, 2.0, 0.5, 1.5, 1.0), ("B", 1, 3, 1.0, nan, 0.5, 1.5, 1.0)]
    kept, before, after = ingest.counted_bars(spark.createDataFrame(bars, "ticker string, ts_utc long, pos long, open double, high double, low double, close double, volume double"), "1h")
    kept.write.parquet(str(tmp_path / "b"))
    assert before.get == {"read": 4, "no_price": 2} and after.get == {"kept": 1}
    none, told = ingest.counted_filings(raw.limit(0), ("8-K",))
    none.write.parquet(str(tmp_path / "n"))
    assert told.get["read"] == 0


@pytest.mark.parametrize("attempts, empty, failed", [
    ([("a", 0), ("b", None)], [], True), ([("a", 0), ("b", None)], ["a"], True), ([("a", 0), ("b", 0)], ["a", "b"], False),
    ([("a", 0), ("b", 3)], [], False), ([("a", 0), ("a", 2), ("b", 0)], ["b"], False), ([], [], False),
])
def test_run_guard(spark, attempts, empty, failed):
    tried, known = spark.createDataFrame(attempts, "key string, records long"), spark.createDataFrame([(k,) for k in empty], "key string")
    assert sinks.run_guard(tried, known).first().failed == failed
    if failed:
        with pytest.raises(ValueError):
            sinks.guarded_run(tried, known, "bars")
    else:
        sinks.guarded_run(tried, known, "bars")


def test_only_months_touched_are_rewritten(spark, tmp_path):
    jan, feb = 1_704_200_000, 1_707_000_000
    first = spark.createDataFrame([("A", jan, 1.0), ("A", feb, 2.0), ("B", feb, 3.0)], "ticker string, ts_utc long, x double")
    path = sinks.update_matrix(first, str(tmp_path))
    before = {m: sorted(os.listdir(f"{path}/month={m}")) for m in ("2024-01", "2024-02")}
    sinks.update_matrix(spark.createDataFrame([("A", feb, 9.0)], first.schema), str(tmp_path))
    assert sorted(os.listdir(f"{path}/month=2024-01")) == before["2024-01"] and sorted(os.listdir(f"{path}/month=2024-02")) != before["2024-02"]
    assert sorted(tuple(r) for r in sinks.read_matrix(spark, path).select("ts_utc", "x").collect()) == [(jan, 1.0), (feb, 9.0)]


def test_snapshot_and_manifest(spark, tmp_path):
    bars = spark.createDataFrame([("A", 86_400 * d) for d in range(10)] + [("Z", 86_400 * 9)], "ticker string, ts_utc long")
    days = spark.createDataFrame([(1,)], "n int")
    keep = spark.createDataFrame([("A",), ("A",), ("BENCH",)], "ticker string")
    told = sinks.write_snapshot({"bars": bars, "days": days}, keep, 86_400 * 9, {"bars": 2}, str(tmp_path), {"bars": "ts_utc"})
    assert sorted(map(tuple, told.collect())) == [("bars", 3, 7 * 86_400, 9 * 86_400), ("days", 1, None, None)]
    assert spark.read.parquet(str(tmp_path / "bars")).count() == 3 and spark.read.parquet(str(tmp_path / "manifest")).count() == 2


def test_seal_unseal_and_guard(spark, tmp_path):
    path = str(tmp_path / "seal")
    rows = spark.createDataFrame([(k,) for k in (5, 15, 25)], "ts_utc long")
    with pytest.raises(PySparkException):  # never sealed counts as sealed
        seal.guarded(rows, "ts_utc", 10, 20, seal.recorded(spark, path), 100).collect()
    with pytest.raises(ValueError):
        seal.turned(spark, 50, False, " ")
    seal.record(path, seal.turned(spark, 50, False, "final evaluation"))
    seal.record(path, seal.turned(spark, 70, True))
    history = seal.recorded(spark, path)
    assert seal.guarded(rows, "ts_utc", 10, 20, history, 60).count() == 3
    for now in (40, 70, 100):
        with pytest.raises(PySparkException):
            seal.guarded(rows, "ts_utc", 10, 20, history, now).collect()
        assert seal.guarded(rows, "ts_utc", 16, 20, history, now).count() == 3
    told = {r.ts_utc: (r.sealed, r.reason) for r in seal.states(spark.createDataFrame([(k,) for k in (0, 50, 69, 70)], "ts_utc long"), "ts_utc", history).collect()}
    assert told == {0: (True, None), 50: (False, "final evaluation"), 69: (False, "final evaluation"), 70: (True, None)}


def test_training_anchors_are_nested_and_short(spark):
    events = spark.createDataFrame([(f"e{k}", "T", k * 10, k % 2 == 0, "8.01") for k in range(6)], "event_id string, ticker string, t0_utc long, is_scheduled boolean, items string")
    quiet = spark.createDataFrame([(f"t{k % 3}", k) for k in range(12)], "ticker string, anchor_utc long")
    drawn = {}
    for ratio in (1, 2, 3):
        rows, short = evaluation.training_anchors(events, quiet, 0, 50, ratio, 42)
        rows = rows.collect()
        drawn[ratio] = {r.window_id: r.depth for r in rows if not r.label}
        assert sum(r.label for r in rows) == 5 and len(drawn[ratio]) == min(5 * ratio, 12)
        assert tuple(short.first()) == (5 * ratio, max(0, 5 * ratio - 12))
    assert drawn[1].items() <= drawn[2].items() <= drawn[3].items()
    assert {w for w, d in drawn[3].items() if d <= 1} == set(drawn[1])


def test_lookaheads_equal_single_cuts(spark):
    bars = adapters.hourly_bars(spark, SF)
    cuts = [int(c) for c in bars.selectExpr("percentile(ts_utc, array(0.2, 0.5, 0.9))").first()[0]]
    made = lambda b: features.price_features(b, SMALL).withColumn("ahead", F.lead("close").over(features.of_ticker()))
    got = {(r.cut, r.feature): r.n for r in features.lookaheads(made, bars, cuts, ["ret_1h", "volume_z", "ahead"]).collect()}
    want = {(c, "ahead"): features.lookahead(made, bars, c, ["ahead"]).count() for c in cuts}
    assert got == want and min(want.values()) > 0


def test_cascade_order_and_survivors(spark):
    rows = [("1", "A", 5, "8.01"), ("2", "B", 5, "8.01"), ("3", "A", 50, "9.01"), ("4", "A", 5, "9.01"), ("5", "A", 6, "2.02"), ("6", "A", None, "2.02")]
    filings = spark.createDataFrame(rows, "accession_no string, ticker string, acceptance_utc long, items string")
    members, cover = spark.createDataFrame([("A",), ("A",)], "ticker string"), spark.createDataFrame([("4", "gaps"), ("5", "gaps")], "accession_no string, reason string")
    out = reports.cascade(filings, members, cover, 0, 10, ("9.01",), ("2.02",))
    told = {r.accession_no: (r.exclude_reason, r.kept) for r in out.collect()}
    assert told == {"1": (None, True), "2": ("not_in_universe", False), "3": ("outside_study_window", False), "4": ("only_excluded_items", False), "5": ("gaps", False), "6": ("outside_study_window", False)}
    assert reports.surviving(out).count() == 6
    with pytest.raises(ValueError, match="outside_study_window"):
        reports.surviving(out.where("NOT kept"))


def test_code_sets_and_split_bounds():
    scalars.disjoint(excluded=("9.01", "5.07"), scheduled=("2.02",), focus=("1.01",))
    with pytest.raises(ValueError, match="2.02"):
        scalars.disjoint(excluded=("9.01", "2.02"), scheduled=("2.02",))
    bounds = [timecal.split_bounds(name, 100, 300, (0.7, 0.15, 0.15)) for name in ("train", "val", "test")]
    assert bounds == [(100, 240), (240, 270), (270, 300)]
    with pytest.raises(ValueError):
        timecal.split_bounds("train", 0, 1, (0.5, 0.1, 0.1))


def test_a_universe_without_survivors_fails(spark):
    companies = spark.createDataFrame([("1", "A", None, None, 1.0, 2.0)], "cik string, ticker string, in_universe int, universe_as_of long, adv_usd double, last_price double")
    judged = spark.createDataFrame([("A", 9.0, 3.0, None), ("B", 1.0, 1.0, "no_bars")], "ticker string, adv_usd double, last_price double, reason string")
    assert universe.applied(companies, judged, 7, SMALL).select("in_universe", "universe_as_of", "adv_usd", "last_price").first() == (1, 7, 9.0, 3.0)
    with pytest.raises(ValueError):
        universe.applied(companies, judged.where("ticker = 'B'"), 7, SMALL)


def test_small_helpers(spark, tmp_path):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert [one(scalars.outcome_slice(F.lit(v).cast("string"), ("2.02",))) for v in (None, "2.02,9.01", "8.01")] == ["—", "scheduled", "unscheduled"]
    assert one(timecal.epoch_to_short(F.lit(1_704_164_645))) == "02 Jan 03:04"
    state = spark.createDataFrame([("news", "a", "ok"), ("news", "b", "empty"), ("bars", "b", "ok")], "source string, key string, status string")
    assert [r.key for r in merge.keys_with(state, "news", "ok").collect()] == ["a"]
    news = spark.createDataFrame([("u", "x", None, 5), ("v", "x", 3, 4), ("w", "y", None, 6)], "url string, api string, published_utc long, seen_utc long")
    moved = {r.url: (r.published_utc, r.seen_utc) for r in ingest.move_seen(news, "x").collect()}
    assert moved == {"u": (5, None), "v": (3, None), "w": (None, 6)}
    low, high = spark.range(1).select(*scans.study_bounds(SMALL)).first()
    assert (low, high) == (1_704_240_000, 1_706_486_400)
    posts = spark.createDataFrame([("1", "s", 9, "late"), ("1", "s", 7, "b"), ("1", "s", 7, "a"), ("2", "s", 3, "old")], "id string, sub string, created_utc long, title string")
    have = spark.createDataFrame([("0", "s", 5)], "id string, sub string, created_utc long")
    assert [tuple(r) for r in ingest.new_posts(have, posts, "sub").collect()] == [("1", "s", 7, "a")]
