"""Registered queries of whole evaluations: every detector on one frame, both clocks of the events, the top table."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evwatch.config import SMALL
from evwatch.operators import detectors, evaluation, metrics, sampling
from evwatch.plans import frames
from evwatch.plans.queries import NOISE_SQL, query, rounded
from evwatch.plans.study import EVALUATED, TOLD, TRAIN_END, events_t0
from evwatch.plans.views_sql import HIGH, LOW, VIEWS
from evwatch.tables import stored

#: A stored policy of two hidden units; its numbers are made up, as the network is trained elsewhere.
POLICY = [([[1.0], [-0.5]], [0.0, 0.25]), ([[0.2, -0.3], [0.9, 0.1]], [0.1, -0.4])]
CLIPPED = "greatest(least(coalesce(volume_z, 0), 10.0), -10.0)::DOUBLE"
FIVE = {
    "constant": ("0.0::DOUBLE", "'inf'::DOUBLE"),
    "random": (NOISE_SQL, "'inf'::DOUBLE"),
    "volume_z": ("coalesce(volume_z, min(volume_z) OVER () - 1)", "1.5"),
    "cusum": ("coalesce(told, min(told) OVER () - 1)", "2.0"),
    "policy": (f"1 / (1 + exp((0.2 * tanh({CLIPPED}) - 0.3 * tanh(0.25 - 0.5 * {CLIPPED}) + 0.1) - (0.9 * tanh({CLIPPED}) + 0.1 * tanh(0.25 - 0.5 * {CLIPPED}) - 0.4)))", "0.5"),
}


def named(sql: str, suffix: str, *names: str) -> str:
    """``sql`` with views' names followed by a suffix."""
    return re.sub(rf"\b({'|'.join(names)})\b(?! AS \()", rf"\1_{suffix}", sql)


#: Views of each detector; they read the fold, so they come after it and not among the others.
OWN_VIEWS: dict[str, str] = {}
VIEWS["rounded_frame"] = "SELECT * REPLACE (round(volume_z, 6) AS volume_z) FROM frame"
for name, (score, threshold) in FIVE.items():
    source = "rounded_frame" if name != "cusum" else "rounded_frame LEFT JOIN folded USING (ticker, ts_utc)"
    OWN_VIEWS[f"scored_{name}"] = f"SELECT window_id, ticker, ts_utc, t0_utc, is_scheduled, item_code, {score} AS score FROM {source}"
    OWN_VIEWS[f"pred_{name}"] = named(VIEWS["pred"], name, "scored").replace("score >= 1.5", f"score >= {threshold}")
    OWN_VIEWS[f"summary_{name}"] = named(VIEWS["summary"], name, "pred")
VIEWS["moved"] = f"SELECT event_id, accession_no, ticker, items, is_scheduled, t0_utc FROM events_t0 WHERE t0_utc >= {LOW} AND t0_utc < {HIGH}"
VIEWS["pos_news"] = VIEWS["pos"].replace("labelled l", "moved l")
VIEWS["frame_news"] = named(VIEWS["frame"], "news", "pos")
VIEWS["scored_news"] = named(VIEWS["scored"], "news", "frame")
VIEWS["pred_news"] = named(VIEWS["pred"], "news", "scored")
VIEWS["summary_news"] = named(VIEWS["summary"], "news", "pred")


def evaluated_sql(name: str) -> str:
    return f"SELECT '{name}' AS name, * FROM ({named(EVALUATED, name, 'pred', 'summary')})"


FOLDED = """WITH RECURSIVE n AS (SELECT ticker, ts_utc, volume_z AS x, row_number() OVER (PARTITION BY ticker ORDER BY ts_utc) AS i FROM (SELECT DISTINCT ticker, ts_utc, volume_z FROM rounded_frame)),
walk AS (SELECT ticker, ts_utc, i, CASE WHEN x IS NULL THEN 0.0 ELSE greatest(0.0, x - 0.5) END::DOUBLE AS s, x FROM n WHERE i = 1
  UNION ALL SELECT n.ticker, n.ts_utc, n.i, CASE WHEN n.x IS NULL THEN CASE WHEN walk.x IS NOT NULL AND walk.s >= 2.0 THEN 0.0 ELSE walk.s END ELSE greatest(0.0, CASE WHEN walk.x IS NOT NULL AND walk.s >= 2.0 THEN 0.0 ELSE walk.s END + n.x - 0.5) END, n.x FROM walk JOIN n ON n.ticker = walk.ticker AND n.i = walk.i + 1),
folded AS (SELECT ticker, ts_utc, CASE WHEN x IS NOT NULL THEN s END AS told FROM walk),
"""


def with_folded(sql: str) -> str:
    """The views that read the fold come after it, as they are part of the same statement."""
    return FOLDED + ",\n".join(f"{name} AS ({view})" for name, view in OWN_VIEWS.items()) + "\n" + sql


def all_five() -> dict[str, detectors.Detector]:
    return {
        "constant": detectors.Constant(), "random": detectors.Noise(SMALL.seed), "volume_z": detectors.VolumeZ(SMALL.z_threshold),
        "cusum": detectors.Cusum(SMALL.cusum_k, SMALL.cusum_h), "policy": detectors.Policy(["volume_z"], POLICY),
    }


def compared(spark, sf_dir, names: tuple[str, ...] = tuple(FIVE)) -> DataFrame:
    """``evaluate`` of each detector on the same frame, with its lift over the constant one and its own rule."""
    frame, days = stored(rounded(frames.frame(spark, sf_dir), "volume_z")), frames.clock(spark)
    found = {name: stored(d.predict(frame)) for name, d in all_five().items() if name in names}
    tables = {name: stored(evaluation.evaluate(df, days, SMALL.budget_per_month, SMALL.excluded_items)) for name, df in found.items()}
    rows = reduce(DataFrame.unionByName, [df.withColumn("detector", F.lit(name)) for name, df in found.items()])
    return evaluation.comparison(tables, "constant", evaluation.own_rules(rows, ("random", "policy")))


OWN = """own AS (SELECT 'random' AS name, count(*) FILTER (score >= 0.5) AS own_flags, round(avg((score >= 0.5)::INT), 6) AS own_rate FROM pred_random
  UNION ALL SELECT 'policy', count(*) FILTER (score >= 0.5), round(avg((score >= 0.5)::INT), 6) FROM pred_policy)"""


@query(with_folded(f""", told AS ({" UNION ALL ".join(evaluated_sql(name) for name in FIVE)}), {OWN}
SELECT t.name AS detector, t.*  EXCLUDE (name), round((round(t.precision * t.alerts) / t.alerts) / nullif(round(c.precision * c.alerts) / c.alerts, 0), 5) AS lift, own_flags, own_rate
FROM told t JOIN told c ON c.name = 'constant' AND c.slice = t.slice LEFT JOIN own ON own.name = t.name"""))
def detectors_compared(spark, sf_dir):
    """Five detectors: the chance ones, the z-score, CUSUM and a stored policy; trees have a report of their own."""
    out = compared(spark, sf_dir).withColumn("lift", F.round("lift", 5))
    return rounded(out.select("detector", *TOLD, "lift", "own_flags", "own_rate"), "precision", "lead_p50", "tie_spill", "brier", "own_rate")


@query(with_folded(f""", told AS ({" UNION ALL ".join(evaluated_sql(name) for name in ("constant", "volume_z", "random"))})
SELECT name AS detector, precision, lead_p50 FROM told WHERE slice = 'unscheduled' ORDER BY precision DESC NULLS LAST, name LIMIT 2"""))
def top_detectors(spark, sf_dir):
    """The top table of one slice."""
    out = evaluation.best_first(compared(spark, sf_dir, ("constant", "volume_z", "random")), "unscheduled", 2)
    return rounded(out.select("detector", "precision", "lead_p50"), "precision", "lead_p50")


@query(f"SELECT 'filing' AS variant, * FROM ({EVALUATED}) UNION ALL SELECT 'news_adjusted', * FROM ({named(EVALUATED, 'news', 'pred', 'summary')})")
def clock_report(spark, sf_dir):
    """The same detector under both clocks: the filing's own time, and the time corrected by news."""
    moved = sampling.eval_frame(frames.with_z(spark, sf_dir), events_t0(spark, sf_dir), SMALL.horizon_bars, LOW, HIGH)
    both = {"filing": frames.predictions(spark, sf_dir), "news_adjusted": detectors.VolumeZ(SMALL.z_threshold).predict(moved)}
    table = evaluation.report_table(both, frames.clock(spark), SMALL.budget_per_month, SMALL.excluded_items)
    return rounded(table.select("variant", *TOLD), "precision", "lead_p50", "tie_spill", "brier")


@query()
def trees_report(spark, sf_dir):
    """Boosted trees on the frame's later part, fitted on the earlier one, evaluated like the others; a fit
    has no SQL."""
    rows = rounded(frames.frame(spark, sf_dir), "volume_z").withColumn("hour", F.hour(F.timestamp_seconds("ts_utc")).cast("double"))
    rows = stored(rows)
    model = detectors.Trees(["volume_z", "hour"], trees=20, depth=SMALL.tree_depth, rate=0.1, seed=SMALL.seed).fit(rows.where(F.col("ts_utc") < TRAIN_END))
    found = stored(model.predict(rows.where(F.col("ts_utc") >= TRAIN_END)))
    table = evaluation.evaluate(found, frames.clock(spark), SMALL.budget_per_month, SMALL.excluded_items)
    floor = metrics.report(detectors.Constant().score(rows.where(F.col("ts_utc") >= TRAIN_END)), 0.0, SMALL.excluded_items)
    return metrics.with_lift(table, floor).select(*TOLD, "lift")
