"""Places of rows and values in an order over all of them, without a task that holds them all.

A range partitioning is written once, with the number of its partition in each row. What the
partitions hold is a table of as many rows as tasks (times groups, where there are groups); its
running sums say at which place each partition starts, and an equality join brings that back.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evwatch.tables import stored

EARLIER = (Window.unboundedPreceding, -1)


def numbered(df: DataFrame, order: Sequence[str | Column], name: str = "place") -> DataFrame:
    """``df`` with each row's place, from 0, in the order of ``order``; rows that tie are in any
    order among themselves, so ``order`` should end in what tells rows apart."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = df.repartitionByRange(n, *order).sortWithinPartitions(*order)
    # The lower 33 bits of Spark's id count a partition's rows in their order.
    laid = stored(laid.withColumns({"__part": F.spark_partition_id(), "__at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)}))
    sizes = laid.groupBy("__part").agg(F.count("*").alias("__n"))
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(*EARLIER)), F.lit(0)).alias("__before"))
    return laid.join(starts, "__part").withColumn(name, F.col("__before") + F.col("__at")).drop("__part", "__at", "__before")


def cumulated(values: DataFrame, column: str, by: Sequence[str] = (), weight: Column | None = None, descending: bool = False) -> DataFrame:
    """A row for each value of ``column`` within the groups ``by``: ``n`` rows have it (or their
    ``weight``), ``upto`` have it or one before it in the order, and the group has ``total``.

    Nulls of ``column`` are left out; equal values are counted before anything is ordered, so a value
    that very many rows share is one row here. There may be many groups or one. ``column`` may not be
    named as a column told.
    """
    counted = values.where(F.col(column).isNotNull()).groupBy(*by, column).agg((F.count("*") if weight is None else F.sum(weight)).alias("n"))
    order = F.col(column).desc() if descending else F.col(column).asc()
    laid = stored(counted.repartitionByRange(*by, order).withColumn("__part", F.spark_partition_id()))
    pieces = laid.groupBy(*by, "__part").agg(F.sum("n").alias("__n"))
    group = Window.partitionBy(*by)
    before = F.coalesce(F.sum("__n").over(group.orderBy("__part").rowsBetween(*EARLIER)), F.lit(0))
    pieces = pieces.select(*(F.col(c).alias(f"__by_{c}") for c in by), F.col("__part").alias("__piece"), before.alias("__before"), F.sum("__n").over(group).alias("total"))
    same = F.col("__part") == F.col("__piece")
    for c in by:
        same &= F.col(c).eqNullSafe(F.col(f"__by_{c}"))
    here = Window.partitionBy(*by, "__part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("__before") + F.sum("n").over(here)
    return laid.join(pieces, same).withColumn("upto", upto).select(*by, column, "n", "upto", "total")


def at_ranks(values: DataFrame, column: str, ranks: dict[str, Callable[[Column], Column]], by: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """Of each group ``by``, or of all rows, the values at some places, from 0, of the values in
    order; each place follows from how many there are. A place below 0 or past the end has none.
    Without groups there is one row, of nulls if there are no values."""
    placed = cumulated(values.select(*by, F.col(column).alias("__value")), "__value", by, descending=descending)
    picks = {name: rank(F.col("total")) for name, rank in ranks.items()}
    first = F.max if descending else F.min
    return placed.groupBy(*by).agg(*(first(F.when((r >= 0) & (F.col("upto") > r), F.col("__value"))).alias(name) for name, r in picks.items()))


def nearest_rank(values: DataFrame, column: str, shares: list[float], by: Sequence[str] = ()) -> DataFrame:
    """``sorted[min(int(n * p), n - 1)]`` for each share."""
    return at_ranks(values, column, {f"p{round(p * 100)}": lambda n, p=p: F.least(F.floor(n * F.lit(p)), n - 1) for p in shares}, by)


def interpolated(values: DataFrame, column: str, shares: dict[str, float], by: Sequence[str] = ()) -> DataFrame:
    """Percentiles by linear interpolation between the two nearest values, as ``percentile`` has them."""
    placed = cumulated(values.select(*by, F.col(column).cast("double").alias("__value")), "__value", by)
    last = F.col("total") - 1
    picks = []
    for name, p in shares.items():
        for side, r in (("low", F.floor(last * F.lit(p))), ("high", F.ceil(last * F.lit(p)))):
            picks.append(F.min(F.when(F.col("upto") > r, F.col("__value"))).alias(f"__{side}_{name}"))
    found = placed.groupBy(*by).agg(F.max(last).alias("__last"), *picks)
    out = []
    for name, p in shares.items():
        place = F.col("__last") * F.lit(p)
        low, high = F.col(f"__low_{name}"), F.col(f"__high_{name}")
        out.append((low + (high - low) * (place - F.floor(place))).alias(name))
    return found.select(*by, *out)
