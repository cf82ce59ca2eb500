"""Keyed merges: each takes the stored rows and new rows, and returns the rows to store.

A merge is one full outer join on the key with a rule for each column, so that new keys,
kept keys and changed keys come out of a single shuffle. Keys must be unique on either side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEW, OLD, OVERWRITE = "new else old", "old else new", "new"


def merge(target: DataFrame, source: DataFrame, keys: list[str], rules: dict[str, str] | None = None, default: str = NEW) -> DataFrame:
    """``target`` with ``source`` merged in; ``rules`` say for a column which side's value stays."""
    t, s = target.alias("t"), source.alias("s")
    there = [F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    joined = t.withColumn("__t", F.lit(True)).alias("t").join(s.withColumn("__s", F.lit(True)).alias("s"), there, "full")

    def value(c: str) -> Column:
        if c not in source.columns:
            return F.col(f"t.{c}")
        if c not in target.columns:
            return F.col(f"s.{c}")
        new, old, rule = F.col(f"s.{c}"), F.col(f"t.{c}"), NEW if c in keys else (rules or {}).get(c, default)
        if rule == OVERWRITE:
            return F.when(F.col("s.__s"), new).otherwise(old)
        return F.coalesce(new, old) if rule == NEW else F.coalesce(old, new)

    columns = target.columns + [c for c in source.columns if c not in target.columns]
    return joined.select(*(value(c).alias(c) for c in columns))


def last_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key, by ``order``."""
    last = Window.partitionBy(*keys).orderBy(*(F.col(c).desc() for c in order))
    return rows.withColumn("__n", F.row_number().over(last)).where("__n = 1").drop("__n")


def first_of(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key that isn't null, by ``order``."""
    first = Window.partitionBy(*keys).orderBy(*order)
    kept = rows.na.drop(subset=keys)
    return kept.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n")


def insert_new(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """The first write of a key stays."""
    return target.unionByName(new_keys(target, source, keys))


def new_keys(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    return source.join(target.select(*keys), keys, "left_anti")


def prune(target: DataFrame, keep: DataFrame, keys: list[str]) -> DataFrame:
    return target.join(keep.select(*keys).distinct(), keys, "left_semi")


def carry_forward(rebuilt: DataFrame, stored: DataFrame, keys: list[str], owned: dict[str, Column]) -> DataFrame:
    """``rebuilt`` with the ``owned`` columns as they were stored; a new key gets their defaults."""
    old = stored.select(*keys, *(F.col(c).alias(f"__{c}") for c in owned), F.lit(True).alias("__known"))
    out = rebuilt.drop(*owned).join(old, keys, "left")
    values = [F.when(F.col("__known"), F.col(f"__{c}")).otherwise(default).alias(c) for c, default in owned.items()]
    return out.select(*(c for c in rebuilt.columns if c not in owned), *values)


def replace_flags(companies: DataFrame, survivors: DataFrame, as_of: int, expected: int) -> DataFrame:
    """Universe flags cleared, then set for ``survivors`` on rows without a successor; another
    number of flagged rows than ``expected`` raises."""
    hit = survivors.select(F.col("ticker").alias("__ticker"), F.col("adv_usd").alias("__adv"), F.col("last_price").alias("__price"))
    rows = companies.join(hit, (F.col("ticker") == F.col("__ticker")) & F.col("successor_cik").isNull(), "left")
    found = F.col("__ticker").isNotNull()
    out = (
        rows.withColumn("in_universe", found.cast("int"))
        .withColumn("adv_usd", F.col("__adv"))
        .withColumn("last_price", F.col("__price"))
        .withColumn("universe_as_of", F.when(found, F.lit(as_of).cast("long")))
        .drop("__ticker", "__adv", "__price")
    )
    got = out.agg(F.sum("in_universe")).first()[0] or 0
    if got != expected:
        lost = survivors.join(out.where("in_universe = 1").select("ticker"), "ticker", "left_anti").select("ticker").orderBy("ticker").limit(10)
        raise ValueError(f"{got} rows flagged, {expected} expected; without a row: {', '.join(r.ticker for r in lost.collect())}")
    return out


def own_reasons(events: DataFrame, fresh: DataFrame, owned: list[str]) -> DataFrame:
    """Exclusion reasons of a pass: only reasons it owns are overwritten, ``usable`` falls to 0
    where a reason stands and is never raised."""
    rows = events.join(fresh.select("event_id", F.col("reason").alias("__reason")), "event_id", "left")
    mine = F.col("exclude_reason").isNull() | F.col("exclude_reason").isin(*owned)
    reason = F.when(mine, F.col("__reason")).otherwise(F.col("exclude_reason"))
    return rows.withColumn("exclude_reason", reason).withColumn("usable", F.when(reason.isNotNull(), 0).otherwise(F.col("usable"))).drop("__reason")


def changed(before: DataFrame, after: DataFrame, key: list[str], column: str) -> DataFrame:
    """Keys whose value of ``column`` differs, nulls compared as values."""
    b = after.select(*key, F.col(column).alias("__after"))
    return before.join(b, key).where(~F.col(column).eqNullSafe(F.col("__after"))).select(*key, column, F.col("__after").alias(f"{column}_after"))


def pending(requested: DataFrame, state: DataFrame, source: str) -> DataFrame:
    """Requested keys that aren't completed yet."""
    done = state.where((F.col("source") == source) & (F.col("status") == "ok")).select("key")
    return requested.join(done, "key", "left_anti")


def pruned(target: DataFrame, keep: DataFrame, keys: list[str]) -> DataFrame:
    """How many stored rows ``prune`` takes away."""
    return target.join(keep.select(*keys).distinct(), keys, "left_anti").agg(F.count("*").alias("pruned"))


def broken_reasons(events: DataFrame) -> DataFrame:
    """Events that are usable in spite of a reason: there must be none."""
    return events.where("usable = 1 AND exclude_reason IS NOT NULL")


def record_state(state: DataFrame, updates: DataFrame) -> DataFrame:
    """The progress table (source, key, status, records, rows, error) with updates written over it."""
    return merge(state, updates, ["source", "key"], default=OVERWRITE)


def keys_with(state: DataFrame, source: str, status: str) -> DataFrame:
    return state.where((F.col("source") == source) & (F.col("status") == status)).select("key")


def set_values(table: DataFrame, values: DataFrame) -> DataFrame:
    """A key/value table (key, value, ts_utc): the value with the later stamp stays, of equals the new one."""
    both = table.withColumn("__new", F.lit(0)).unionByName(values.withColumn("__new", F.lit(1)))
    return last_of(both, ["key"], ["ts_utc", "__new"]).drop("__new")


def write_events(stored: DataFrame, rebuilt: DataFrame, provenance: DataFrame, built_utc: int, tier: int | None, lookback_s: int) -> tuple[DataFrame, DataFrame]:
    """The events to store, rebuilt ones over old and stale ones gone, and the provenance with when
    and by what they were built, and how many took their time from news."""
    events = prune(merge(stored, rebuilt, ["event_id"]), rebuilt, ["event_id"])
    told = rebuilt.agg(F.count_if(F.col("t0_source") == "news").cast("string").alias("n"))
    pairs = F.array(
        F.struct(F.lit("events.built_utc").alias("key"), F.lit(str(built_utc)).alias("value")), F.struct(F.lit("events.tier").alias("key"), F.lit(str(tier)).alias("value")),
        F.struct(F.lit("events.lookback_s").alias("key"), F.lit(str(lookback_s)).alias("value")), F.struct(F.lit("events.from_news").alias("key"), F.col("n").alias("value")),
    )
    return events, set_values(provenance, told.select(F.inline(pairs)).withColumn("ts_utc", F.lit(built_utc).cast("long")))
