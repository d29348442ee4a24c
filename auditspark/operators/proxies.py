"""Features that stand in for a protected attribute."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.functions.scalars import ratio

LEAST, LEAST_ROWS = 0.15, 10


def strength(r: Column) -> Column:
    return F.when(r >= 0.5, "strong").when(r >= 0.3, "moderate").when(r >= 0.15, "weak").otherwise("negligible")


def associations(df: DataFrame, attrs: Sequence[str], features: Sequence[str]) -> DataFrame:
    """(attribute, feature, groups, r): correlation ratio sqrt(SSb / SSt) of every pair, in one pass over the rows.

    Rows are unpivoted to (attribute, value, feature, x) and reduced to count, mean and variance by partial sums; for two
    groups the ratio is the absolute point-biserial correlation. Null values and null features are left out.
    """
    rows = df.select(F.explode(F.array(*[F.struct(F.lit(a).alias("attribute"), F.col(a).cast("string").alias("value")) for a in attrs])).alias("a"), F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("x")) for f in features]).alias("fs"))
    rows = rows.where("a.value IS NOT NULL").select("a.attribute", "a.value", F.inline("fs")).where("x IS NOT NULL")
    g = rows.groupBy("attribute", "feature", "value").agg(F.count("*").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var"))
    w = Window.partitionBy("attribute", "feature")
    g = g.withColumn("grand", F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w))
    apart = F.col("n") * F.pow(F.col("mean") - F.col("grand"), 2)
    t = g.groupBy("attribute", "feature").agg(F.sum("n").alias("n"), F.count("*").alias("groups"), F.sum(apart).alias("ssb"), F.sum(F.col("n") * F.col("var") + apart).alias("sst"))
    return t.where((F.col("n") >= LEAST_ROWS) & (F.col("groups") >= 2)).select("attribute", "feature", "groups", F.sqrt(ratio(F.col("ssb"), F.col("sst"))).alias("r"))


def binary_correlation(df: DataFrame, attr: str, features: Sequence[str]) -> DataFrame:
    """(feature, r): signed correlation with a two-valued attribute coded 0 and 1 in sorted order; null values are left out."""
    codes = df.where(F.col(attr).isNotNull()).agg(F.min(attr).alias("low"), F.max(attr).alias("high"))
    rows = df.where(F.col(attr).isNotNull()).crossJoin(F.broadcast(codes)).withColumn("code", (F.col(attr) == F.col("high")).cast("double"))
    return rows.agg(*[F.corr(f, "code").alias(f) for f in features]).unpivot([], list(features), "feature", "r")


def proxies(table: DataFrame, least: float = LEAST) -> DataFrame:
    return table.where(F.abs("r") >= least).withColumn("strength", strength(F.abs("r")))


def top_proxies(table: DataFrame, k: int = 8) -> DataFrame:
    """The k strongest features of each attribute."""
    w = Window.partitionBy("attribute").orderBy(F.desc(F.abs("r")), "feature")
    return table.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
