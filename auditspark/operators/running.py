"""Running sums by key without a task that holds a whole key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.sources.workspace import written


def ranges(c: Column, bounds: Sequence) -> Column:
    """How many of the sorted ``bounds`` are below a value (or above it where they fall): a tree of comparisons."""

    def part(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(c > bounds[middle], part(middle + 1, high)).otherwise(part(low, middle))

    return part(0, len(bounds))


def quantiles(df: DataFrame, column: str, parts: int, by: Sequence[str] = ()) -> dict[tuple, list]:
    """Approximate quantiles that cut a column into ``parts``, by key: a row for each of few keys reaches the driver."""
    shares = [k / parts for k in range(1, parts)]
    rows = df.groupBy(*by).agg(F.percentile_approx(column, shares, 1000).alias("bounds")).collect()
    return {tuple(r[b] for b in by): sorted(set(r["bounds"] or [])) for r in rows}


def sums_before(df: DataFrame, key: str, order: str, tie: Sequence[str], value: str, name: str, parts: int = 64) -> DataFrame:
    """Adds ``name``: the sum of ``value`` over a key's rows that come before, by (order, tie); 0 for the first.

    ``order`` is a number. Two levels: its range is cut at quantiles of all rows, the sums of each key's ranges
    are added up over its few ranges, and rows are summed inside their range only. So a key that holds all rows still runs
    in ``parts`` tasks. Rows without an order value come first, as in a sorted window. The rows are written once.
    """
    rows = written(df, "running")
    bounds = quantiles(rows, order, parts).get((), [])
    spread = rows.withColumn("part", F.when(F.col(order).isNull(), -1).otherwise(ranges(F.col(order), bounds)))
    totals = spread.groupBy(key, "part").agg(F.sum(value).alias("total"))
    earlier = Window.partitionBy(key).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col(key).alias("own_key"), F.col("part").alias("own_part"), F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy(key, "part").orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, -1)
    joined = spread.join(offsets, F.col(key).eqNullSafe(F.col("own_key")) & (F.col("part") == F.col("own_part")))
    return joined.withColumn(name, F.col("offset") + F.coalesce(F.sum(value).over(inside), F.lit(0))).drop("part", "own_key", "own_part", "offset")
