"""The commonest values of a column, exactly, without shuffling those that are rare.

1. Values are counted by hash cell, ``CELLS`` of them, whatever the number of values: a cell holds at least as many rows as
   any of its values.
2. The values of the fullest cells are counted exactly. The k-th largest of these counts is a lower bound for the k-th
   largest of all.
3. Only values in cells with that many rows are counted: none of the k commonest can lie elsewhere, so nothing is missed and
   no second try is needed. Values that occur once are left out where they lie unless their cell is full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark.sources.workspace import written

#: Cells that values are counted in (a table of as many rows at most is broadcast), and full cells looked at first.
CELLS, FIRST = 1 << 20, 256


def cell(value: Column) -> Column:
    return F.pmod(F.xxhash64(value), F.lit(CELLS))


def candidates(df: DataFrame, value: str, k: int, least: int) -> DataFrame:
    """The rows (value) that may hold one of the k commonest values of at least ``least`` rows."""
    rows = df.where(F.col(value).isNotNull()).select(value).withColumn("cell", cell(F.col(value)))
    sketch = written(rows.groupBy("cell").agg(F.count("*").alias("n")), "cells")
    full = sketch.where(F.col("n") >= least).orderBy(F.desc("n"), "cell").limit(FIRST).select("cell")
    best = rows.join(F.broadcast(full), "cell").groupBy(value).agg(F.count("*").alias("n")).orderBy(F.desc("n")).limit(k).collect()
    bound = max(least, min(r["n"] for r in best)) if len(best) == k else least
    return rows.join(F.broadcast(sketch.where(F.col("n") >= bound).select("cell")), "cell", "left_semi").select(value)


def commonest(df: DataFrame, value: str, k: int, least: int = 2) -> DataFrame:
    """(value, n) of the k commonest values with at least ``least`` rows; of equals the smaller one. A top-k report."""
    counts = candidates(df, value, k, least).groupBy(value).agg(F.count("*").alias("n"))
    return counts.where(F.col("n") >= least).orderBy(F.desc("n"), value).limit(k)
