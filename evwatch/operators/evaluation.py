"""Whole evaluations: one frame, variants of it, several detectors, and what is tuned on them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evwatch.functions.timecal import trading_hours
from evwatch.operators import metrics, sampling
from evwatch.operators.contract import validated
from evwatch.operators.detectors import Detector
from evwatch.operators.joins import bars_before
from evwatch.operators.ranks import interpolated, numbered
from evwatch.tables import stored


def evaluate(df: DataFrame, days: DataFrame, rate: float, excluded: tuple[str, ...], most: int | None = None) -> DataFrame:
    """A row for each slice, all at the threshold that the frame's alert budget gives: the columns of
    ``metrics.report``, flagged positive windows and their middle lead, whether alerts spill over the
    budget by ties, and of the whole frame the actions, the Brier score where scores are
    probabilities, and whether it is degenerate: no flag, or one score only."""
    df = stored(df)
    summary = stored(metrics.window_summary(df))
    budget, threshold = metrics.budgeted(df, rate, most, summary)
    table = metrics.summary_report(summary, threshold, excluded)
    leads = metrics.delays(df, days).select("window_id", "lead_trading_h")
    led = stored(metrics.sliced(summary, excluded).select("window_id", "slice").join(leads, "window_id", "left"))
    delays = led.groupBy("slice").agg(F.count("lead_trading_h").alias("detections"))
    delays = delays.join(interpolated(led, "lead_trading_h", {"lead_p50": 0.5}, ["slice"]), "slice", "left")
    y, p = F.col("t0_utc").isNotNull().cast("double"), F.col("score")
    whole = df.agg(
        F.count_if(F.col("action") == "WAIT").alias("wait_hours"), F.count_if(F.col("action") == "FLAG").alias("flag_hours"),
        F.min("score").alias("__least"), F.max("score").alias("__most"), F.avg((p - y) * (p - y)).alias("__brier"),
    )
    whole = whole.select(
        "wait_hours", "flag_hours", F.when((F.col("__least") >= 0) & (F.col("__most") <= 1), F.col("__brier")).alias("brier"),
        ((F.col("flag_hours") == 0) | (F.col("__least") == F.col("__most"))).alias("degenerate"),
    )
    whole = stored(whole)  # one row
    told = [whole.select(c).scalar().alias(c) for c in whole.columns]
    spill = F.when(budget > 0, F.col("alerts") / budget).alias("tie_spill")
    return table.join(delays, "slice").select("*", *told, budget.alias("budget"), spill)


def precisions(df: DataFrame, rate: float, excluded: tuple[str, ...], most: int | None = None) -> DataFrame:
    """``metrics.report`` at the threshold that the frame's alert budget gives: what ``evaluate`` tells, without
    leads and actions. ``df`` is read twice."""
    summary = stored(metrics.window_summary(df).drop("window_id", "ticker"))
    _, threshold = metrics.budgeted(df, rate, most, summary)
    return metrics.summary_report(summary, threshold, excluded)


def report_table(variants: dict[str, DataFrame], days: DataFrame, rate: float, excluded: tuple[str, ...], leads: bool = True) -> DataFrame:
    """``evaluate`` of each variant of the event clock, each at its own threshold, one after the other; without
    ``leads``, ``precisions`` of each."""
    judged = {name: evaluate(df, days, rate, excluded) if leads else precisions(df, rate, excluded) for name, df in variants.items()}
    return reduce(DataFrame.unionByName, [table.withColumn("variant", F.lit(name)) for name, table in judged.items()])


def predicted(frame: DataFrame, detectors: dict[str, Detector]) -> dict[str, DataFrame]:
    """Valid predictions of every detector on the same frame; the frame and they are stored, as the checks
    and what follows read them again."""
    frame = stored(frame)
    return {name: validated(stored(d.predict(frame))) for name, d in detectors.items()}


def side_by_side(found: dict[str, DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, [df.withColumn("detector", F.lit(name)) for name, df in found.items()])


def run_detectors(frame: DataFrame, detectors: dict[str, Detector]) -> DataFrame:
    """``predicted`` as one frame, with the detector's name."""
    return side_by_side(predicted(frame, detectors))


def own_rules(predictions: DataFrame, ruled: tuple[str, ...], at: float = 0.5) -> DataFrame:
    """What detectors would do by a rule of their own, a flag from P = ``at`` on: flags, their rate and
    the share of windows with one; null for detectors without such a rule."""
    flag = F.when(F.col("detector").isin(*ruled), F.col("score") >= at)
    return predictions.groupBy("detector").agg(
        F.sum(flag.cast("long")).alias("own_flags"), F.avg(flag.cast("double")).alias("own_rate"),
        F.when(F.count(flag) > 0, F.count_distinct(F.when(flag, F.col("window_id"))) / F.count_distinct("window_id")).alias("own_windows"),
    )


def comparison(tables: dict[str, DataFrame], floor: str, own: DataFrame) -> DataFrame:
    """A row for each detector and slice with its lift over the ``floor`` detector's precision of the
    same slice, and what its own rule would do."""
    rows = reduce(DataFrame.unionByName, [t.withColumn("detector", F.lit(name)) for name, t in tables.items()])
    return metrics.with_lift(rows, tables[floor]).join(own, "detector", "left")


def best_first(table: DataFrame, slice_: str, n: int) -> DataFrame:
    return table.where(F.col("slice") == slice_).orderBy(F.col("precision").desc_nulls_last(), "detector").limit(n)


def pivoted(table: DataFrame, metric: str, variants: list[str]) -> DataFrame:
    """Detectors by variants, of one metric."""
    return table.groupBy("detector").pivot("variant", variants).agg(F.first(metric))


def ablation(full: DataFrame, reduced: DataFrame, metric: str = "precision") -> DataFrame:
    """Two result tables side by side: the metric in both, its ratio and its difference."""
    a, b = full.select("slice", F.col(metric).alias("full")), reduced.select("slice", F.col(metric).alias("reduced"))
    return a.join(b, "slice").withColumn("ratio", F.when(F.col("full") != 0, F.col("reduced") / F.col("full"))).withColumn("difference", F.col("reduced") - F.col("full"))


def training_anchors(events: DataFrame, quiet: DataFrame, low: int, until: int, ratio: int, seed: int) -> tuple[DataFrame, DataFrame]:
    """Anchors of windows to train on: each event of [low, until), and of the quiet anchors there ``ratio``
    for each event, drawn by seed. ``depth`` is 0 for an event and for a quiet one the least ratio at which
    it is drawn, so frames of smaller ratios are parts of this one. And one row: how many quiet ones were
    wanted and how many lacked; none is drawn twice to make up for it."""
    inside = lambda df, ts: df.where((F.col(ts) >= low) & (F.col(ts) < until))
    blank = {"t0_utc": F.lit(None).cast("long"), "is_scheduled": F.lit(None).cast("boolean"), "item_code": F.lit(None).cast("string")}
    positives = inside(events, "t0_utc").select(F.concat(F.lit("event:"), "event_id").alias("window_id"), "ticker", F.col("t0_utc").alias("anchor_utc"), "t0_utc", "is_scheduled", F.col("items").alias("item_code"), F.lit(1).alias("label"), F.lit(0).cast("long").alias("depth"))
    positives = stored(positives)
    n = stored(positives.agg(F.count("*").alias("n"))).scalar()
    key = F.md5(F.concat_ws("|", "ticker", "anchor_utc", F.lit(seed)))
    pool = stored(inside(quiet, "anchor_utc").select("ticker", "anchor_utc"))
    placed = numbered(pool.withColumn("__key", key), ["__key", "ticker", "anchor_utc"]).where(F.col("place") < n * ratio)
    drawn = placed.select(F.concat_ws(":", F.lit("quiet"), "ticker", "anchor_utc").alias("window_id"), "ticker", "anchor_utc", *(c.alias(name) for name, c in blank.items()), F.lit(0).alias("label"), (F.floor(F.col("place") / n) + 1).cast("long").alias("depth"))
    short = pool.agg(F.count("*").alias("available")).select((n * ratio).alias("wanted"), F.greatest(F.lit(0), n * ratio - F.col("available")).alias("lacking"))
    return positives.unionByName(drawn), short


def training_matrix(matrix: DataFrame, anchors: DataFrame, features: list[str], horizon: int) -> DataFrame:
    """The ``horizon`` rows of ``matrix`` (ticker, ts_utc, features) before each anchor: the contract's columns but
    score and action, ``label``, ``depth`` and the features."""
    rows = bars_before(matrix.select("ticker", "ts_utc", *features), anchors, horizon)
    return rows.select("window_id", "ticker", "ts_utc", "t0_utc", "is_scheduled", "item_code", "label", "depth", *features)


def training_frame(bars: DataFrame, events: DataFrame, quiet: DataFrame, low: int, until: int, horizon: int, ratio: int, seed: int) -> tuple[DataFrame, int]:
    """Windows to train on: those before each event of [low, until), and of the quiet anchors there
    ``ratio`` for each event, drawn by seed; and how many quiet ones were lacking."""
    inside = lambda df, ts: df.where((F.col(ts) >= low) & (F.col(ts) < until))
    positives = inside(events, "t0_utc").select(F.concat(F.lit("event:"), "event_id").alias("window_id"), "ticker", F.col("t0_utc").alias("anchor_utc"), F.lit(1).alias("label"))
    pool, wanted = inside(quiet, "anchor_utc"), positives.count() * ratio
    drawn = sampling.draw(pool, wanted, seed)
    negatives = drawn.select(F.concat_ws(":", F.lit("quiet"), "ticker", "anchor_utc").alias("window_id"), "ticker", "anchor_utc", F.lit(0).alias("label"))
    return bars_before(bars, positives.unionByName(negatives), horizon), max(0, wanted - pool.count())


def tune_wait(df: DataFrame, days: DataFrame, waits: list[float]) -> DataFrame:
    """For each wait, what is left of the flags once those within so many trading hours of their
    window's start are taken back: flags, precision, mean lead; the best first, by precision, lead,
    then the shorter wait. All waits are judged in one pass over the flags."""
    start = df.groupBy("window_id").agg(F.min("ts_utc").alias("__start"))
    flags = trading_hours(df.where("action = 'FLAG'").join(start, "window_id"), days, "__start", "ts_utc", "__waited")
    flags = trading_hours(flags, days, "ts_utc", "t0_utc", "__lead", optional=True)
    each = flags.withColumn("wait", F.explode(F.array(*(F.lit(float(w)) for w in waits)))).where(F.col("__waited") >= F.col("wait"))
    positive = F.col("t0_utc").isNotNull()
    out = each.groupBy("wait").agg(F.count("*").alias("flags"), F.avg(positive.cast("double")).alias("precision"), F.avg("__lead").alias("mean_lead_h"))
    return out.orderBy(F.col("precision").desc(), F.col("mean_lead_h").desc_nulls_last(), "wait")
