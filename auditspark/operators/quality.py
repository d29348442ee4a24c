"""Data-quality audits: missingness, leakage, summaries, attrition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.functions.scalars import ratio
from auditspark.operators.models import medians


def missingness(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, n_missing, pct_missing) of every column in one pass."""
    columns = list(columns or df.columns)
    one = df.agg(F.count("*").alias("rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one.unpivot(["rows"], columns, "column", "n_missing").select("column", "n_missing", (100.0 * ratio(F.col("n_missing"), F.col("rows"))).alias("pct_missing"))


def top_missing(table: DataFrame, k: int) -> DataFrame:
    return table.orderBy(F.desc("pct_missing"), "column").limit(k)


def missing_by_outcome(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """(column, per class share of nulls, leak): a column that is null for one class nearly always gives the outcome away."""
    by = df.groupBy(target).agg(*[F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns]).unpivot([target], list(columns), "column", "share")
    return by.groupBy("column").agg(F.min("share").alias("least"), F.max("share").alias("most")).withColumn("leak", (F.col("most") >= 0.99) & (F.col("least") < 0.5))


def numeric_summary(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, minimum, median, maximum)."""
    ends = df.agg(*[a for c in columns for a in (F.min(c).cast("double").alias(f"low_{c}"), F.max(c).cast("double").alias(f"high_{c}"))])
    rows = [F.struct(F.lit(c).alias("column"), F.col(f"low_{c}").alias("minimum"), F.col(f"m_{c}").alias("median"), F.col(f"high_{c}").alias("maximum")) for c in columns]
    return ends.crossJoin(F.broadcast(medians(df, columns))).select(F.inline(F.array(*rows)))


def category_counts(df: DataFrame, columns: Sequence[str], top: int = 5) -> DataFrame:
    """(column, value, n, by_value, by_count, in_top): counts of each category, in the order of values and of counts.

    Ranks are windows over the counts; ``in_top`` marks the ``top`` commonest values (the smaller one of equals).
    """
    cells = F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]))
    counts = df.select(cells).where("value IS NOT NULL").groupBy("column", "value").agg(F.count("*").alias("n"))
    own = Window.partitionBy("column")
    place = F.row_number().over(own.orderBy(F.desc("n"), "value"))
    return counts.select("column", "value", "n", F.row_number().over(own.orderBy("value")).alias("by_value"), place.alias("by_count"), (place <= top).alias("in_top"))


def ordered_distinct(df: DataFrame, keys: Sequence[str], value: str, position: str) -> DataFrame:
    """(keys, place, value): each key's distinct values in the order in which they first occur."""
    first = df.groupBy(*keys, value).agg(F.min(position).alias("first"))
    return first.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy("first", value)).alias("place"), value)


def split_report(df: DataFrame, split: str, target: str) -> DataFrame:
    return df.groupBy(split).agg(F.count("*").alias("rows"), F.avg(target).alias("positive_rate"))


def attrition(df: DataFrame, rules: Sequence[tuple[str, Column, Column]]) -> DataFrame:
    """(step, category, dropped, remaining): each row counts at the first rule that it fails.

    ``rules`` are (name, passes, category). One pass groups by (step, category); the running remainder is a window over
    that small table.
    """
    step, category = F.lit(len(rules) + 1), F.lit("kept")
    for k in range(len(rules), 0, -1):
        _, passes, cat = rules[k - 1]
        fails = ~F.coalesce(passes, F.lit(False))
        step, category = F.when(fails, k).otherwise(step), F.when(fails, F.coalesce(cat.cast("string"), F.lit("null"))).otherwise(category)
    counts = df.select(step.alias("number"), category.alias("category")).groupBy("number", "category").agg(F.count("*").alias("n"))
    total = counts.withColumn("total", F.sum("n").over(Window.partitionBy(F.lit(0)))).withColumn("gone", F.sum("n").over(Window.orderBy("number")))
    names = F.element_at(F.array(*[F.lit(r[0]) for r in rules]), F.col("number"))
    return total.where(F.col("number") <= len(rules)).select("number", names.alias("step"), "category", F.col("n").alias("dropped"), (F.col("total") - F.col("gone")).alias("remaining"))


def category_di(df: DataFrame, category: Column, outcome: Column, kept: Sequence[str], reference: str) -> DataFrame:
    """(category, retained, n, rate, DI against the named category and against the best), dropped categories included."""
    t = df.select(category.alias("category"), outcome.cast("int").alias("y")).groupBy("category").agg(F.count("*").alias("n"), F.avg("y").alias("rate"))
    w = Window.partitionBy(F.lit(0))
    named = F.max(F.when(F.col("category") == reference, F.col("rate"))).over(w)
    return t.select("category", F.col("category").isin(*kept).alias("retained"), "n", "rate", ratio(F.col("rate"), named).alias("di_vs_named"), ratio(F.col("rate"), F.max("rate").over(w)).alias("di_vs_best"))
