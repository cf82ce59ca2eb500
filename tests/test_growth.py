"""Steps that many queries share: what they tell, and how often their rows travel."""

from evwatch.operators import contract, detectors, evaluation, folds, joins, sampling

PREDICTED = "window_id string, ticker string, ts_utc long, score double, action string, t0_utc long, is_scheduled boolean, item_code string"


def shuffles(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def bars_and_events(spark):
    bars = [(t, 10 * i, float(i)) for t in "ab" for i in range(40) if (i * 7) % 5]
    events = [(f"{t}{at}", t, at, at % 2 == 0, "8.01") for t in "abc" for at in (0, 5, 100, 101, 130, 130, 395, 900)]
    return bars, events, spark.createDataFrame(bars, "ticker string, ts_utc long, volume_z double"), spark.createDataFrame(events, "event_id string, ticker string, t0_utc long, is_scheduled boolean, items string")


def test_the_evaluation_frame_is_laid_out_once(spark):
    bars, events, df, ev = bars_and_events(spark)
    out = sampling.eval_frame(df, ev, 8, 20, 390)
    assert shuffles(out) == 1
    want, used = [], set()
    for name, ticker, at, *_ in events:
        if 20 <= at < 390:
            mine = sorted(b for b in bars if b[0] == ticker and b[1] < at)[-8:]
            want += [(f"event:{name}", *b) for b in mine]
            used |= {b[:2] for b in mine}
    want += [(f"bar:{t}:{ts}", t, ts, z) for t, ts, z in bars if 20 <= ts < 390 and (t, ts) not in used]
    assert sorted((r.window_id, r.ticker, r.ts_utc, r.volume_z) for r in out.collect()) == sorted(want)


def test_a_bar_without_a_time_is_before_no_anchor(spark):
    bars = spark.createDataFrame([("a", None, 1.0), ("a", 10, 2.0)], "ticker string, ts_utc long, x double")
    anchors = spark.createDataFrame([("e", "a", 20), ("f", None, 20)], "id string, ticker string, anchor_utc long")
    assert [(r.id, r.ts_utc, r.x) for r in joins.bars_before(bars, anchors, 8).collect()] == [("e", 10, 2.0)]


def test_windows_are_checked_in_one_grouping(spark):
    rows = [("w", "a", 1, 0.5, "WAIT", None, None, None), ("w", "a", 1, 0.7, "WAIT", None, None, None), ("v", "a", 1, 0.5, "WAIT", None, None, None), ("v", "a", 2, 0.5, "WAIT", None, None, None)]
    found = contract.violations(spark.createDataFrame(rows, PREDICTED))
    assert shuffles(found) == 1
    assert [tuple(r) for r in found.collect()] == [("w", "repeated (window_id, ts_utc)")]


def test_precisions_are_those_of_the_whole_evaluation(spark):
    from evwatch.plans import frames

    rows = frames.predictions(spark, "/root/testdata/sf0.001")
    brief = evaluation.precisions(rows, 2.0, ("9.01",))
    whole = evaluation.evaluate(rows, frames.clock(spark), 2.0, ("9.01",)).select(brief.columns)
    assert sorted(map(tuple, brief.collect())) == sorted(map(tuple, whole.collect())) != []


def test_an_expression_over_a_stored_frame_is_not_stored_again(spark, monkeypatch):
    from evwatch.plans import frames
    from evwatch.tables import stored

    frame, written = stored(frames.frame(spark, "/root/testdata/sf0.001")), []
    monkeypatch.setattr(contract, "stored", lambda df: written.append(df) or stored(df))
    assert detectors.VolumeZ(1.5).predict(frame).where("score IS NULL").isEmpty() and not written


def test_sums_of_all_pairs_travel_in_one_row(spark):
    values = spark.createDataFrame([("a", i, (i * 37 % 11) / 3) for i in range(50)], "ticker string, ts_utc long, volume_z double")
    pairs = [(0.25, 0.5), (0.5, 2.0), (1.0, 4.0)]
    wide = folds.cusum_rows(values, pairs, "ticker", "ts_utc", "volume_z", None, None)
    assert wide.count() == 50
    told = {r.ts: r.told for r in wide.collect()}
    each = {(r.k, r.h, r.ts_utc): r.cusum for r in detectors.cusum_grid(values, pairs).collect()}
    assert each == {(k, h, ts): of[i] for ts, of in told.items() for i, (k, h) in enumerate(pairs)}
