"""Hand vectors and brute force for the surveillance operators."""

import hashlib
import random

import pytest
from evwatch.config import SMALL
from evwatch.functions import scalars, timecal
from evwatch.operators import alertlog, contract, detectors, features, joins, labels, merge, metrics, ranks, sampling, text
from evwatch.plans import frames
from evwatch.schemas import TABLES
from evwatch.sources import adapters, ingest, sinks
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def cusum_of(spark, xs, k, h):
    df = spark.createDataFrame([("a", i, x) for i, x in enumerate(xs)], "ticker string, ts_utc long, volume_z double")
    return [r.cusum for r in detectors.cusum(df, k, h).orderBy("ts_utc").collect()]


def test_cusum_vectors(spark):
    assert cusum_of(spark, [1.0, 1.0, 1.0], 0.5, 100.0) == [0.5, 1.0, 1.5]
    assert cusum_of(spark, [-5.0] * 10, 0.5, 100.0) == [0.0] * 10
    assert cusum_of(spark, [3.0, 3.0, 3.0], 0.0, 5.0) == [3.0, 6.0, 3.0]
    assert cusum_of(spark, [3.0, 3.0, 3.0], 0.0, 100.0) == [3.0, 6.0, 9.0]
    assert cusum_of(spark, [3.0, None, float("nan"), 1.0], 0.0, 100.0) == [3.0, None, None, 4.0]
    with pytest.raises(ValueError):
        cusum_of(spark, [1.0], 2.0, 1.0)


def test_cusum_without_reset_equals_the_fold(spark):
    rng = random.Random(5)
    rows = [(t, i, rng.choice([None, rng.gauss(0, 2)])) for t in "ab" for i in range(60)]
    df = spark.createDataFrame(rows, "ticker string, ts_utc long, volume_z double")
    fold = {(r.ticker, r.ts_utc): r.cusum for r in detectors.cusum(df, 0.5, 1e9).collect()}
    for r in detectors.cusum_no_reset(df, 0.5).collect():
        want = fold[r.ticker, r.ts_utc]
        assert (r.cusum is None) == (want is None) and (want is None or abs(r.cusum - want) < 1e-9)


def test_cusum_grid_equals_single_folds(spark):
    rng = random.Random(6)
    rows = [(t, i, rng.choice([None, rng.gauss(0, 2)])) for t in "ab" for i in range(30)]
    df = spark.createDataFrame(rows, "ticker string, ts_utc long, volume_z double")
    got = {(r.k, r.h, r.ticker, r.ts_utc): r.cusum for r in detectors.cusum_grid(df, [(0.5, 1.0), (0.5, 3.0), (2.0, 1.0)]).collect()}
    want = {(0.5, h, r.ticker, r.ts_utc): r.cusum for h in (1.0, 3.0) for r in detectors.cusum(df, 0.5, h).collect()}
    assert got == want


@pytest.mark.parametrize("slice_s", [1, 3, 7, 50, None])
@pytest.mark.parametrize("scale", [0.5, 2.0, 20.0])
def test_cusum_in_slices_equals_the_fold(spark, slice_s, scale):
    """Values are halves, so that all sums are exact and equal to the last bit."""
    rng = random.Random(int(scale * 10))
    rows = [(t, i, rng.choice([None, float("nan"), *[round(rng.gauss(0.2, scale) * 2) / 2] * 8])) for t in ("a", "b", None) for i in range(rng.choice([1, 40, 90]))]
    rows += [("hot", i, round(rng.gauss(0.6, scale) * 2) / 2) for i in range(400)]
    df = spark.createDataFrame(rows, "ticker string, ts_utc long, volume_z double")
    pairs = [(0.5, 1.0), (0.5, 3.0), (0.0, 0.0), (1.0, 60.0)]
    got = {(r.k, r.h, r.ticker, r.ts_utc): r.cusum for r in detectors.cusum_grid(df, pairs, slice_s=slice_s).collect()}
    want = {}
    for k, h in pairs:
        s = {}
        for t, i, x in sorted(rows, key=lambda r: (r[0] or "", r[1])):
            if x is None or x != x:
                want[k, h, t, i] = None
                continue
            s[t] = max(0.0, s.get(t, 0.0) + x - k)
            want[k, h, t, i] = s[t]
            s[t] = 0.0 if s[t] >= h else s[t]
    assert got == want


def test_ranks_in_groups(spark):
    rng = random.Random(9)
    rows = [(rng.choice(["a", "b", None]), float(rng.randrange(12))) for _ in range(300)] + [("c", None), ("d", 5.0)] + [("hot", 1.0)] * 400
    df = spark.createDataFrame(rows, "g string, x double")
    got = {r.g: (r.p10, r.p50, r.p99) for r in ranks.nearest_rank(df, "x", [0.1, 0.5, 0.99], ["g"]).collect()}
    middle = {r.g: r.m for r in ranks.interpolated(df, "x", {"m": 0.4}, ["g"]).collect()}
    of = {}
    for g, x in rows:
        if x is not None:
            of.setdefault(g, []).append(x)
    assert got == {g: tuple(sorted(v)[min(int(len(v) * p), len(v) - 1)] for p in (0.1, 0.5, 0.99)) for g, v in of.items()}
    for g, v in of.items():
        v, at = sorted(v), 0.4 * (len(v) - 1)
        assert middle[g] == pytest.approx(v[int(at)] + (v[min(int(at) + 1, len(v) - 1)] - v[int(at)]) * (at - int(at)))
    placed = {(r.place, r.x) for r in ranks.numbered(df.where("g = 'a'").select("x"), ["x"]).collect()}
    assert placed == set(enumerate(sorted(of["a"])))


@pytest.mark.parametrize("direction", ["backward", "forward"])
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("slice_s", [None, 7])
def test_asof_equals_brute_force(spark, direction, strict, slice_s):
    rng = random.Random(1)
    left = [(rng.choice("ab"), rng.randrange(60), i) for i in range(80)]
    right = [(rng.choice("abc"), t, t * 10) for t in rng.sample(range(60), 25)]
    a = spark.createDataFrame(left, "k string, t long, no long")
    b = spark.createDataFrame(right, "k string, u long, v long")
    got = {r.no: r.got for r in joins.asof(a, b, "k", "t", "u", {"got": F.col("v")}, direction, strict, slice_s).collect()}
    for k, t, no in left:
        near = [(u, v) for kk, u, v in right if kk == k and ((u < t or u == t and not strict) if direction == "backward" else (u > t or u == t and not strict))]
        want = (max(near) if direction == "backward" else min(near))[1] if near else None
        assert got[no] == want


def test_within_equals_brute_force(spark):
    rng = random.Random(2)
    left, right = [("a", rng.randrange(100), i) for i in range(40)], [("a", rng.randrange(100), i) for i in range(40)]
    a, b = spark.createDataFrame(left, "k string, t long, i long"), spark.createDataFrame(right, "k string, u long, j long")
    for after, closed in ((True, False), (True, True), (False, False)):
        got = sorted((r.i, r.r_j) for r in joins.within(a, b, "k", "t", "u", 13, after, closed).collect())
        ok = lambda d: (0 < d <= 13 or d == 0 and closed) if after else 0 <= -d <= 13
        assert got == sorted((i, j) for _, t, i in left for _, u, j in right if ok(u - t))


def test_bars_before_is_strict_and_short_history_stays(spark):
    bars = spark.createDataFrame([("a", t) for t in (10, 20, 30, 40)], "ticker string, ts_utc long")
    anchors = spark.createDataFrame([("a", 30, 1), ("a", 10, 2), ("b", 99, 3), ("a", 99, 4)], "ticker string, anchor_utc long, id long")
    got = sorted((r.id, r.ts_utc) for r in joins.bars_before(bars, anchors, 3).collect())
    assert got == [(1, 10), (1, 20), (4, 20), (4, 30), (4, 40)]


def test_trading_hours_equal_session_overlap(spark):
    sessions = adapters.sessions(spark)
    bounds = [(r.open_utc, r.close_utc) for r in sessions.collect()]
    rng = random.Random(3)
    low, high = min(bounds)[0] - 86400, max(bounds)[1] - 1
    spans = sorted((rng.randrange(low, high), rng.randrange(0, 10 * 86400)) for _ in range(500))
    spans = [(a, min(a + d, high), i) for i, (a, d) in enumerate(spans)] + [(bounds[0][0], bounds[0][0], 500), (bounds[0][0], bounds[0][1], 501)]
    df = spark.createDataFrame(spans, "a long, b long, i long")
    for r in timecal.trading_hours(df, timecal.clock(sessions), "a", "b", "h").collect():
        assert abs(r.h - sum(max(0, min(r.b, c) - max(r.a, o)) for o, c in bounds) / 3600) < 1e-9
    with pytest.raises(PySparkException):
        timecal.trading_hours(spark.createDataFrame([(high, low)], "a long, b long"), timecal.clock(sessions), "a", "b", "h").collect()


def test_new_york_sessions_follow_daylight_saving(spark):
    rows = {str(r.date): (r.open_utc % 86400, r.close_utc % 86400) for r in timecal.session_table(spark, "2024-01-01", "2024-12-31", holidays=("2024-07-04",), half_days=("2024-07-03",)).collect()}
    assert rows["2024-01-02"] == (52200, 75600) and rows["2024-07-01"] == (48600, 72000) and rows["2024-07-03"] == (48600, 61200)
    assert "2024-07-04" not in rows and "2024-07-06" not in rows


def test_time_scalars(spark):
    df = spark.createDataFrame([("2024-01-02", "2024-01-02T03:04:05Z", "20240102T030405Z", "2h")], "d string, i string, c string, v string")
    row = df.select(timecal.date_to_epoch(F.col("d")), timecal.iso_to_epoch(F.col("i")), timecal.compact_to_epoch(F.col("c")), timecal.interval_seconds(F.col("v")), timecal.epoch_to_iso(F.lit(1704164645)), timecal.new_york_label(F.lit(14))).first()
    assert tuple(row) == (1704153600, 1704164645, 1704164645, 7200, "2024-01-02 03:04:05Z", "10:00 / 09:00")
    for bad in (timecal.iso_to_epoch(F.lit("2024-01-02T03:04:05")), timecal.interval_seconds(F.lit("3q"))):
        with pytest.raises(PySparkException):
            df.select(bad).collect()
    guarded = timecal.sealed_guard(df.select(F.lit(5).alias("ts_utc")), "ts_utc", 0, 10)
    with pytest.raises(PySparkException):
        guarded.collect()


def test_scalars(spark):
    df = spark.range(1)
    one = lambda c: df.select(c).first()[0]
    assert one(scalars.parse_items(F.lit(" 2.02, ,9.01,"))) == ["2.02", "9.01"] and one(scalars.parse_items(F.lit(None).cast("string"))) == []
    assert one(scalars.item_reason(F.lit("9.01,5.07"), ("9.01", "5.07"))) == "only_excluded_items" and one(scalars.item_reason(F.lit(""), ())) == "no_item_codes"
    assert one(scalars.publisher_stem(F.lit("www.Reuters.com"))) == "wwwreuters" and one(scalars.publisher_stem(F.lit("Wall St. Journal"))) == "wallstjournal"
    assert one(scalars.domain_of(F.lit("https://www.Example.com/a"))) == "example.com"
    assert one(scalars.tier_of(F.lit("reuters.com"), F.lit(None).cast("string"), ("reuters",), ("blog",))) == 1
    assert one(scalars.name_stem(F.lit("ExxonMobil Holdings Corp"))) == one(scalars.name_stem(F.lit("EXXON MOBIL CORP"))) == "exxonmobil"
    assert one(scalars.clean_observation(F.lit(float("inf")), 10.0)) == 0.0 and one(scalars.clean_observation(F.lit(-99.0), 10.0)) == -10.0
    assert [one(scalars.strength(F.lit(s), F.lit(1.0))) for s in (11.0, 4.0, 2.5, 1.0)] == ["extreme", "strong", "elevated", "marginal"]
    assert one(scalars.strength(F.lit(5.0), F.lit(0.0))) == "marginal"
    assert one(scalars.number(F.lit(None).cast("double"))) == "—" and one(scalars.percent(F.lit(0.125))) == "12.5%"
    assert one(scalars.reasons([[("a %s", F.lit(None).cast("string")), ("b %s", F.lit("x"))], [("c %s", F.lit(None).cast("string"))], [("d %s", F.lit("y"))]], 1)) == ["b x"]
    assert one(scalars.event_id(F.lit("0001-24.5 "))) == "0001245"


def test_merges(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", 5)], "k long, x string, y long")
    new = spark.createDataFrame([(2, None, 6), (3, "c", 7)], "k long, x string, y long")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(merge.merge(old, new, ["k"])) == [(1, "a", None), (2, "b", 6), (3, "c", 7)]
    assert rows(merge.merge(old, new, ["k"], default=merge.OLD)) == [(1, "a", None), (2, "b", 5), (3, "c", 7)]
    assert rows(merge.merge(old, new, ["k"], {"x": merge.OVERWRITE})) == [(1, "a", None), (2, None, 6), (3, "c", 7)]
    assert rows(merge.insert_new(old, new, ["k"])) == [(1, "a", None), (2, "b", 5), (3, "c", 7)]
    assert rows(merge.prune(old, new, ["k"])) == [(2, "b", 5)]
    companies = spark.createDataFrame([("1", "A", None), ("2", "A", "1"), ("3", "B", None)], "cik string, ticker string, successor_cik string")
    survivors = spark.createDataFrame([("A", 9.0, 3.0)], "ticker string, adv_usd double, last_price double")
    flagged = {r.cik: (r.in_universe, r.adv_usd, r.universe_as_of) for r in merge.replace_flags(companies, survivors, 7, 1).collect()}
    assert flagged == {"1": (1, 9.0, 7), "2": (0, None, None), "3": (0, None, None)}
    with pytest.raises(ValueError):
        merge.replace_flags(companies, survivors, 7, 2)
    events = spark.createDataFrame([("e1", None, 1), ("e2", "other", 0), ("e3", "mine", 0)], "event_id string, exclude_reason string, usable int")
    fresh = spark.createDataFrame([("e1", "mine"), ("e2", "mine"), ("e3", None)], "event_id string, reason string")
    got = {r.event_id: (r.exclude_reason, r.usable) for r in merge.own_reasons(events, fresh, ["mine"]).collect()}
    assert got == {"e1": ("mine", 0), "e2": ("other", 0), "e3": (None, 0)}


def test_no_feature_looks_ahead(spark):
    bars = adapters.hourly_bars(spark, SF)
    cut = bars.agg(F.percentile("ts_utc", 0.5)).first()[0]
    bad = features.lookahead(lambda b: features.price_features(b, SMALL), bars, int(cut), ["ret_1h", "ret_4h", "volume_z", "volatility"])
    assert bad.count() == 0
    cheat = lambda b: b.withColumn("ahead", F.lead("close").over(features.of_ticker()))
    assert features.lookahead(cheat, bars, int(cut), ["ahead"]).count() > 0


def test_tiling_equals_the_walk(spark):
    rng = random.Random(9)
    rows = [(t, i, rng.random() < 0.85) for t in "abcd" for i in range(120)]
    got = sorted(map(tuple, sampling.anchors(spark.createDataFrame(rows, "ticker string, ts_utc long, quiet boolean"), 6, 10).collect()))
    want = []
    for t in "abcd":
        run = 0
        for _, i, quiet in (r for r in rows if r[0] == t):
            run = run + 1 if quiet else 0
            if run > 6 and i - 6 >= 10:
                want.append((t, i))
                run = 0
    assert got == want


def test_contract(spark):
    good = frames.predictions(spark, SF)
    assert contract.validated(good).columns == list(contract.COLUMNS)
    w = good.limit(1).collect()[0].asDict()
    frame = lambda *rows: spark.createDataFrame([tuple((w | r).values()) for r in rows], TABLES["predictions"])
    cases = [
        ([{"score": None}], "null in a required column"), ([{"score": float("nan")}], "score is not finite"), ([{"action": "SELL"}], "unknown action"),
        ([{}, {}], "repeated (window_id, ts_utc)"), ([{"ts_utc": 1, "ticker": "q"}, {}], "ticker differs within a window"),
        ([{"t0_utc": 5, "is_scheduled": True}], "a row after t0"), ([{"t0_utc": None, "is_scheduled": True}], "is_scheduled is not null exactly with t0"),
        ([{"action": "FLAG"}, {"ts_utc": 1, "action": "FLAG"}], "more than one FLAG"), ([{"t0_utc": None, "item_code": "8.01", "is_scheduled": None}], "item_code is not null exactly with t0"), ([{"t0_utc": 5, "item_code": None, "is_scheduled": True}], "item_code is not null exactly with t0"),
    ]
    for rows, rule in cases:
        assert rule in {r.rule for r in contract.violations(frame(*rows)).collect()}, rule
        with pytest.raises(ValueError):
            contract.validated(frame(*rows))
    with pytest.raises(ValueError):
        contract.validated(good.limit(0))
    with pytest.raises(ValueError):
        contract.conform(good.drop("score"))


def test_random_scores_have_no_lift(spark):
    """A detector that knows nothing lands at the base rate on windows of unequal length."""
    rows = [(f"p{i}", f"t{i % 12}", h * 3600, 48 * 3600, True, "8.01") for i in range(200) for h in range(48)] + [(f"q{i}", f"t{i % 12}", i * 3600, None, None, None) for i in range(2000)]
    frame = spark.createDataFrame(rows, "window_id string, ticker string, ts_utc long, t0_utc long, is_scheduled boolean, item_code string")
    lifts = []
    for seed in range(4):
        summary = metrics.window_summary(detectors.Noise(seed).predict(frame)).cache()
        threshold = metrics.threshold_at(summary, 220)
        hit = summary.where(F.col("peak") >= threshold).agg(F.avg(F.col("is_positive").cast("double"))).first()[0]
        lifts.append(hit / (200 / 2200))
    assert 0.6 < sum(lifts) / len(lifts) < 1.4


def test_budget_edges(spark):
    summary = spark.createDataFrame([(3.0,), (2.0,), (2.0,), (1.0,)], "peak double")
    assert metrics.threshold_at(summary, 0) == float("inf") and metrics.threshold_at(summary, 4) == float("-inf") and metrics.threshold_at(summary, 2) == 2.0


def test_policy_and_trees(spark):
    df = spark.createDataFrame([("w", "a", 1, None, None, None, 2.0), ("v", "a", 2, 9, True, "8.01", float("nan"))], "window_id string, ticker string, ts_utc long, t0_utc long, is_scheduled boolean, item_code string, x double")
    policy = detectors.Policy(["x"], [([[1.0]], [0.0]), ([[0.0], [1.0]], [0.0, 0.0])])
    import math

    got = {r.window_id: r.score for r in policy.predict(df).collect()}
    assert abs(got["w"] - 1 / (1 + math.exp(-math.tanh(2.0)))) < 1e-12 and got["v"] == 0.5
    with pytest.raises(ValueError):
        detectors.Policy(["x", "y"], policy.weights)
    with pytest.raises(ValueError):
        detectors.Trees(["x"], trees=1).fit(df.where("t0_utc IS NULL"))
    assert set(detectors.REGISTRY) == {"constant", "random", "volume_z", "cusum", "trees", "policy"}
    assert {r.action for r in detectors.Constant().predict(df).collect()} == {"WAIT"}


def test_alert_log_goes_on_and_tells_of_tampering(spark):
    alerts = frames.alerts(spark, SF)
    half = alerts.where("ts_utc % 7200 = 0")
    first = alertlog.append(None, half)
    both = first.unionByName(alertlog.append(first, alerts))
    assert both.count() == alerts.count() and alertlog.chain_breaks(both).count() == 0
    assert alertlog.append(both, alerts).count() == 0
    for change, kind in ((("score", F.col("score") + 1), "row_sha differs"), (("prev_sha", F.lit("x")), "prev_sha differs")):
        bad = both.withColumn(change[0], F.when(F.col("seq") == 2, change[1]).otherwise(F.col(change[0])))
        assert [(r.seq, r.kind) for r in alertlog.chain_breaks(bad).collect()] == [(2, kind)]
    assert [(r.seq, r.kind) for r in alertlog.chain_breaks(both.where("seq <> 2")).collect()] == [(3, "gap in seq")]


def test_deferred_outcomes(spark):
    alerts = spark.createDataFrame([("x", 0, "A"), ("y", 0, "B"), ("z", 0, "C")], "alert_id string, ts_utc long, ticker string")
    base = 1704207600  # in a session
    alerts = alerts.withColumn("ts_utc", F.col("ts_utc") + base)
    filed = spark.createDataFrame([("A", base + 3600, "n1", "8.01"), ("B", base + 60 * 3600, "n2", "8.01"), ("C", base, "n3", "9.01")], "ticker string, filed_utc long, accession_no string, items string")
    days = frames.clock(spark)
    assert alertlog.outcomes(alerts, filed, days, 48, base).count() == 0
    got = {r.alert_id: (r.filed, r.accession_no, r.lead_trading_h) for r in alertlog.outcomes(alerts, filed, days, 48, base + 48 * 3600).collect()}
    assert got == {"x": (1, "n1", 1.0), "y": (0, None, None), "z": (0, None, None)}


def test_ingest(spark, tmp_path):
    (tmp_path / "map.json").write_text('{"fields": ["cik", "name", "ticker", "exchange"], "data": [["7", "Seven", "SV-A", "NYSE"], ["7", "Seven B", "SVN", "NYSE"], ["8", "Eight", "EI", "OTC"]]}')
    rows = ingest.company_map(spark, str(tmp_path / "map.json"), ("NYSE",), 5).collect()
    assert [(r.cik, r.ticker, r.name) for r in rows] == [("0000000007", "SVN", "Seven")]
    (tmp_path / "bad.json").write_text('{"fields": ["cik", "ticker", "exchange"], "data": [["7", "SV", "NYSE"]]}')
    with pytest.raises(PySparkException):
        ingest.company_map(spark, str(tmp_path / "bad.json"), ("NYSE",), 5).collect()
    block = spark.createDataFrame([([1, 2], ["a", "b"])], "x array<int>, y array<string>")
    assert [(r.pos, r.x, r.y) for r in ingest.records(block, ["x", "y"]).collect()] == [(0, 1, "a"), (1, 2, "b")]
    with pytest.raises(PySparkException):
        ingest.records(spark.createDataFrame([([1], ["a", "b"])], "x array<int>, y array<string>"), ["x", "y"]).collect()
    pages = spark.createDataFrame([("p", 1, 5), ("q", 6, 9), ("r", None, 3), (None, 1, 5)], "name string, from_utc long, to_utc long")
    assert {r.name for r in ingest.pages_to_read(pages, 2, 5).collect()} == {"p", "r"}
    lines = spark.createDataFrame([("A:B CORP:0000000123:",), ("junk",)], "value string")
    assert [tuple(r) for r in ingest.register_rows(lines).collect()] == [("ab", "A:B CORP", "0000000123")]
    (tmp_path / "posts.json").write_text('{"id": "a", "created_utc": 5, "title": "t"}\nnot json\n{"id": "b", "created_utc": 50}\n')
    raw = ingest.json_lines(spark, str(tmp_path / "posts.json"), "id string, created_utc string, title string, selftext string, score int")
    assert [(r.id, r.title, r.selftext, r.score) for r in ingest.post_rows(raw, 0, 10).collect()] == [("a", "t", "", 0)]
    assert ingest.window_grid(spark, 0, 0, 3).count() == 1 and [tuple(r) for r in ingest.window_grid(spark, 0, 5 * 86400, 3).collect()] == [(0, 0, 259200), (1, 259200, 432000)]


def test_sinks(spark, tmp_path):
    log = alertlog.append(None, frames.alerts(spark, SF)).withColumn("features", F.lit('{"a": 1.5}')).withColumn("raised_utc", F.lit(1).cast("long"))
    log = log.select("alert_id", "ts_utc", "raised_utc", "ticker", "detector", "score", "threshold", "features", "seq", "prev_sha", "row_sha").cache()
    path = str(tmp_path / "log")
    sinks.export_log(log, path, None)
    back = sinks.import_log(spark, path)
    assert back.count() == log.count() and sinks.import_log(spark, path, log.limit(3)).count() == log.count() - 3
    with pytest.raises(ValueError):
        sinks.export_log(log.limit(1), str(tmp_path / "other"), back)
    assert sinks.unpack(back, "features", ["a", "b"]).select("a", "b").first() == (1.5, None) and sinks.keys_of(back, "features").count() == 1
    bars = adapters.hourly_bars(spark, SF)
    matrix = sinks.read_matrix(spark, sinks.write_matrix(bars, str(tmp_path)), low=1705000000)
    assert matrix.count() == bars.where("ts_utc >= 1705000000").count()
    assert sinks.read_result(spark, str(tmp_path / "none"), "a int").count() == 0
    with pytest.raises(ValueError):
        sinks.not_empty(bars.limit(0), 3, "bars")
    with pytest.raises(PySparkException):
        sinks.not_frozen(bars, 1 << 40).collect()
    with pytest.raises(ValueError):
        sinks.not_frozen(bars, None)


def test_nearest_rank_index_rule(spark):
    df = spark.createDataFrame([(x,) for x in (5, 1, 1, 9, 7)], "v long")
    assert tuple(labels.nearest_rank(df, "v", [0.1, 0.5, 0.99]).first()) == (1, 5, 9)


def test_fingerprint_of_more_windows_than_a_long_sums(spark):
    rows = spark.range(80000).select(F.concat(F.lit("bar:"), "id").alias("window_id"), F.lit(None).cast("long").alias("t0_utc"))
    want = sum(int(hashlib.md5(f"bar:{i}".encode()).hexdigest()[:12], 16) for i in range(80000))
    assert want >= 1 << 63
    assert tuple(metrics.fingerprint(rows).first()) == (80000, 80000, 0, want % (1 << 63))


@pytest.mark.parametrize("slice_s", [None, 7])
def test_asof_forward_has_no_frame_to_the_end(spark, capsys, slice_s):
    a, b = spark.createDataFrame([("a", 1)], "k string, t long"), spark.createDataFrame([("a", 2, 3)], "k string, u long, v long")
    joins.asof(a, b, "k", "t", "u", {"got": F.col("v")}, "forward", slice_s=slice_s).explain()
    assert "unboundedfollowing" not in capsys.readouterr().out.lower()


def test_mentions_end_at_letters_beyond_ascii(spark):
    posts = spark.createDataFrame([(1, "AI!! SUR\u00c9ELLE"), (2, "\u00c9SUR $ABC\u00c9"), (3, "SUR_X XSUR SUR1 $ABCX_ sur")], "id long, t string")
    known = spark.createDataFrame([("SUR", None), ("AI", None)], "ticker string, name string")
    assert {r.id: r.tickers for r in text.mentions(posts, known, "id", "t").collect()} == {1: ["AI", "SUR"], 2: ["ABC", "SUR"]}
