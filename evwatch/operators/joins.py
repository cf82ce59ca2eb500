"""Joins in time: as-of, within a span, rows before an anchor."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evwatch.tables import stored


def asof(left: DataFrame, right: DataFrame, by: str, left_ts: str, right_ts: str, values: dict[str, Column], direction: str = "backward", strict: bool = False, slice_s: int | None = None) -> DataFrame:
    """``left`` with ``values`` of the last row of ``right`` at or before its time (``backward``)
    or the first at or after it (``forward``); ``strict`` leaves the same time out.

    Both sides are laid in one order and the nearest right row is carried along: one shuffle, no
    pairs. With ``slice_s`` a key's rows are dealt by slices of time as well, and what a slice
    leaves open is filled from the slices beside it, so that a key with very many rows isn't one
    task's.
    """
    back = direction == "backward"
    right_first = (back and not strict) or (not back and strict)
    payload = F.struct(*(c.alias(n) for n, c in values.items()))
    a = left.select(F.col(by).alias("__by"), F.col(left_ts).alias("__ts"), F.lit(1 if right_first else 0).alias("__kind"), F.struct(*left.columns).alias("__left"), F.lit(None).cast(right.select(payload.alias("x")).schema["x"].dataType).alias("__right"))
    b = right.where(F.col(right_ts).isNotNull()).select(F.col(by).alias("__by"), F.col(right_ts).alias("__ts"), F.lit(0 if right_first else 1).alias("__kind"), F.lit(None).cast(a.schema["__left"].dataType).alias("__left"), payload.alias("__right"))
    both = a.unionByName(b).withColumn("__slice", F.floor(F.col("__ts") / slice_s) if slice_s else F.lit(0))
    # Forward is backward in the opposite order: a frame to the end would be gone through anew for every row.
    turn = (lambda c: F.col(c).asc()) if back else (lambda c: F.col(c).desc())
    frame = Window.partitionBy("__by", "__slice").orderBy(*map(turn, ("__ts", "__kind", "__right")))
    out = both.withColumn("__near", F.last("__right", ignorenulls=True).over(frame.rowsBetween(Window.unboundedPreceding, 0)))
    if slice_s:
        rights = F.when(F.col("__right").isNotNull(), F.struct("__ts", "__right"))
        edge = (F.max if back else F.min)(rights).getField("__right")
        slices = both.groupBy("__by", "__slice").agg(edge.alias("__edge"))
        beside = Window.partitionBy("__by").orderBy(turn("__slice"))
        reach = F.last("__edge", ignorenulls=True).over(beside.rowsBetween(Window.unboundedPreceding, -1))
        carried = slices.select("__by", "__slice", reach.alias("__carried"))
        out = out.join(carried, ["__by", "__slice"]).withColumn("__near", F.coalesce("__near", "__carried"))
    rows = out.where(F.col("__left").isNotNull())
    return rows.select("__left.*", *(F.col("__near")[n].alias(n) for n in values))


def within(left: DataFrame, right: DataFrame, by: str, left_ts: str, right_ts: str, span: int, after: bool = True, closed: bool = False) -> DataFrame:
    """Pairs with right's time in (t, t + span] of left's time t (``after``), else in [t - span, t];
    ``closed`` takes t itself in with ``after``.

    Times are dealt into buckets of ``span``; a left row looks into its own and the next one, so
    the join is an equality on key and bucket.
    """
    step = 1 if after else -1
    here = F.floor(F.col(left_ts) / span)
    a = left.withColumn("__bucket", F.explode(F.array(here, here + step)))
    b = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns), F.floor(F.col(right_ts) / span).alias("__r_bucket"))
    ahead = (F.col(f"r_{right_ts}") - F.col(left_ts)) * step
    near = (ahead <= span) & ((ahead >= 0) if closed or not after else (ahead > 0))
    return a.join(b, (F.col(by) == F.col(f"r_{by}")) & (F.col("__bucket") == F.col("__r_bucket")) & near).drop("__bucket", "__r_bucket")


def laid_before(bars: DataFrame, anchors: DataFrame, horizon: int, by: str = "ticker", ts: str = "ts_utc", anchor_ts: str = "anchor_utc") -> DataFrame:
    """Bars and anchors of all keys, ``by``: of an anchor ``__anchor``, its columns, and ``__bars``, the last
    ``horizon`` bars strictly before it; of a bar ``__bar`` and ``__taken``, whether an anchor has it among these.

    One shuffle: an anchor lies between the bars that it falls between and has the number of the last
    one before it, so what is near in numbers is near in the order. Bars without a time are no anchor's.
    """
    a = anchors.where(F.col(by).isNotNull() & F.col(anchor_ts).isNotNull())
    a = a.select(by, F.col(anchor_ts).alias("__ts"), F.struct(*(c for c in anchors.columns if c != by)).alias("__anchor"))
    b = bars.select(by, F.col(ts).alias("__ts"), F.struct(*(c for c in bars.columns if c != by)).alias("__bar"))
    both = b.unionByName(a, allowMissingColumns=True)
    bar, key = F.col("__bar").isNotNull() & F.col("__ts").isNotNull(), Window.partitionBy(by)
    # At one time an anchor comes first.
    order = key.orderBy("__ts", F.col("__bar").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    near = key.orderBy("__no")
    return both.withColumn("__no", F.sum(bar.cast("long")).over(order)).withColumns({
        "__bars": F.collect_list(F.when(bar, F.col("__bar"))).over(near.rangeBetween(1 - horizon, 0)),
        "__taken": F.count("__anchor").over(near.rangeBetween(0, horizon - 1)) > 0,
    })


def bars_before(bars: DataFrame, anchors: DataFrame, horizon: int, by: str = "ticker", ts: str = "ts_utc", anchor_ts: str = "anchor_utc") -> DataFrame:
    """For each anchor, its columns with the last ``horizon`` bars strictly before it; fewer if
    history is short, none if there is none."""
    laid = laid_before(bars, anchors, horizon, by, ts, anchor_ts).where("__anchor IS NOT NULL")
    return laid.select(by, "__anchor", F.explode("__bars").alias("__bar")).select(by, "__anchor.*", "__bar.*")


def propose(names: DataFrame, register: DataFrame, least: int = 5, most: int = 20) -> DataFrame:
    """``cik, r_stem, n, status, candidates`` for each of ``names`` (cik, stem): the register's other
    entries of the same stem, else of the longest stem of at least ``least`` characters that is a
    proper prefix of it. More than ``most`` are unresolved: too many to tell apart.

    The register is grouped by stem first, so entries are counted but never paired. Lists are made
    only of stems with few enough entries, and meet a name once its stem is known.
    """
    stems = register.groupBy(F.col("stem").alias("r_stem")).agg(F.count("*").alias("n"))
    few = stems.where(F.col("n") <= most + 1).select(F.col("r_stem").alias("stem"))
    some = register.join(few, "stem").groupBy(F.col("stem").alias("r_stem")).agg(F.sort_array(F.collect_list("cik")).alias("ciks"))
    shorter = F.when(F.length("stem") >= least, F.transform(F.sequence(F.lit(least), F.length("stem")), lambda n: F.substring(F.col("stem"), F.lit(1), n))).otherwise(F.array("stem"))
    own = register.select("cik", F.col("stem").alias("r_stem"), F.lit(1).alias("__own")).distinct()
    tried = names.select("cik", F.explode(shorter).alias("r_stem")).join(stems, "r_stem").join(own, ["cik", "r_stem"], "left")
    others = tried.withColumn("n", F.col("n") - F.coalesce("__own", F.lit(0))).where("n > 0")
    best = others.groupBy("cik").agg(F.max_by(F.struct("r_stem", "n"), F.length("r_stem")).alias("b"))
    out = names.select("cik").join(best, "cik", "left").select("cik", F.col("b.r_stem").alias("r_stem"), F.coalesce("b.n", F.lit(0).cast("long")).alias("n"))
    status = F.when(F.col("n") == 0, "none").when(F.col("n") > most, "unresolved").otherwise("proposed")
    out = stored(out.withColumn("status", status))
    listed = out.where("status = 'proposed'").join(some, "r_stem", "left").withColumn("candidates", F.array_except("ciks", F.array("cik")))
    rest = out.where("status <> 'proposed'").withColumn("candidates", F.lit(None).cast(listed.schema["candidates"].dataType))
    return listed.select(rest.columns).unionByName(rest)


def verify_predecessors(proposed: DataFrame, companies: DataFrame, filings: DataFrame, forms: tuple[str, ...], before: int) -> DataFrame:
    """Each proposed (cik, r_cik) with the reason against it, or none; a successor is accepted only
    where exactly one of its candidates survives. ``companies``: cik, sic, is_primary."""
    info = companies.select(F.col("cik").alias("__c"), "sic", "is_primary")
    own = companies.select(F.col("cik").alias("__o"), F.col("sic").alias("__sic"))
    early = filings.where(F.col("form").isin(*forms) & (F.col("acceptance_utc") < before)).select(F.col("cik").alias("__f")).distinct().withColumn("__filed", F.lit(True))
    rows = proposed.join(info, F.col("r_cik") == F.col("__c"), "left").join(own, F.col("cik") == F.col("__o"), "left").join(early, F.col("r_cik") == F.col("__f"), "left")
    reason = (
        F.when(F.col("is_primary"), "already_primary").when(F.col("__sic").isNull(), "no_successor_sic").when(~F.col("sic").eqNullSafe(F.col("__sic")), "sic_differs").when(F.col("__filed").isNull(), "no_early_filing")
    )
    judged = rows.select("cik", "r_cik", reason.alias("reason"))
    survivors = judged.groupBy("cik").agg(F.count_if(F.col("reason").isNull()).alias("survivors"))
    return judged.join(survivors, "cik").withColumn("accepted", F.col("reason").isNull() & (F.col("survivors") == 1))
