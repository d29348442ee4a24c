"""Seeded splits, samples and folds that depend on ids only, without a global sort.

The order of rows is that of ``md5(id|seed)``. To take an exact quota of each stratum, rows are counted by the digest's
first digits (a table of at most 65,536 rows a stratum), the running sum of that table gives the bucket in which the quota
ends, and only the rows of this bucket are ranked.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.functions.scalars import key_hash

DIGITS = 4


def _ranked(df: DataFrame, strata: Sequence[str], key: str, seed: int) -> DataFrame:
    """Adds ``rank``: a row's place in its stratum by (digest, id), from bucket offsets and ranks inside buckets."""
    rows = df.withColumn("h", key_hash(F.col(key), seed)).withColumn("bucket", F.substring("h", 1, DIGITS))
    rows = rows.withColumn("stratum", F.struct(*[F.col(s) for s in strata]) if strata else F.struct(F.lit(0)))
    counts = rows.groupBy("stratum", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("stratum").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("stratum", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"), F.sum("n").over(Window.partitionBy("stratum")).alias("total"))
    rows = rows.join(counts, ["stratum", "bucket"])
    inside = Window.partitionBy("stratum", "bucket").orderBy("h", key)
    return rows.withColumn("rank", F.col("offset") + F.row_number().over(inside))


def quota_split(df: DataFrame, share: float, strata: Sequence[str] = (), key: str = "record_id", seed: int = 42) -> DataFrame:
    """Adds ``split``: test for the first floor(share * size) rows of each stratum, else train."""
    r = _ranked(df, strata, key, seed)
    return r.withColumn("split", F.when(F.col("rank") <= F.floor(F.lit(share) * F.col("total")), "test").otherwise("train")).select(*df.columns, "split")


def sample(df: DataFrame, n: int, key: str = "record_id", seed: int = 42) -> DataFrame:
    """n rows (all, if there are fewer)."""
    return _ranked(df, [], key, seed).where(F.col("rank") <= n).select(*df.columns)


def class_quotas(df: DataFrame, target: str, size: int, rate: float) -> DataFrame:
    """One row (positives, negatives): missing positives are made up by negatives; missing negatives shrink the sample."""
    c = df.agg(F.count_if(F.col(target) == 1).alias("pos"), F.count_if(F.col(target) != 1).alias("neg"))
    want = F.least(F.lit(int(size * rate)), F.col("pos"))
    return c.select(want.alias("positives"), F.least(F.lit(size) - want, F.col("neg")).alias("negatives"))


def class_sample(df: DataFrame, target: str, size: int, rate: float, key: str = "record_id", seed: int = 42) -> DataFrame:
    """A sample with a given size and positive rate, as far as the classes allow."""
    r = _ranked(df, [target], key, seed).crossJoin(F.broadcast(class_quotas(df, target, size, rate)))
    quota: Column = F.when(F.col(target) == 1, F.col("positives")).otherwise(F.col("negatives"))
    return r.where(F.col("rank") <= quota).select(*df.columns)


def folds(df: DataFrame, k: int, strata: Sequence[str], key: str = "record_id", seed: int = 42) -> DataFrame:
    """Adds ``fold``: 0 to k - 1, even in each stratum."""
    return _ranked(df, strata, key, seed).withColumn("fold", ((F.col("rank") - 1) % k).cast("int")).select(*df.columns, "fold")
