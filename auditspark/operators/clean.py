"""Cleaning: winsorising, validation, filters, decoding, joins by record id, schema harmonisation."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.operators.models import exact_quantiles, medians


def iqr_bounds(train: DataFrame, columns: Sequence[str], exact: bool = True, accuracy: int = 10_000) -> DataFrame:
    """One row with low_<c> and high_<c>: quartiles less and plus 1.5 interquartile ranges. ``exact=False`` uses sketches."""
    if exact:
        quartiles = exact_quantiles(train, columns, [0.25, 0.75])
    else:
        quartiles = train.agg(*[F.percentile_approx(c, [0.25, 0.75], accuracy).alias(c) for c in columns])
    out = []
    for c in columns:
        q = F.col(c)
        out += [(q[0] - 1.5 * (q[1] - q[0])).alias(f"low_{c}"), (q[1] + 1.5 * (q[1] - q[0])).alias(f"high_{c}")]
    return quartiles.select(*out)


def winsorised(df: DataFrame, bounds: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Values clipped to the one row of bounds; nulls stay."""
    clip = {c: F.when(F.col(c).isNotNull(), F.greatest(F.col(f"low_{c}"), F.least(F.col(f"high_{c}"), F.col(c)))) for c in columns}
    return df.crossJoin(F.broadcast(bounds)).withColumns(clip).drop(*[f"{s}_{c}" for c in columns for s in ("low", "high")])


def median_target(df: DataFrame, column: str, train: Column) -> DataFrame:
    """Adds ``high``: above the median of the training rows. The median is one row, so it is broadcast."""
    middle = medians(df.where(train), [column]).select(F.col(f"m_{column}").alias("middle"))
    return df.crossJoin(F.broadcast(middle)).withColumn("high", F.coalesce(F.col(column) > F.col("middle"), F.lit(False)).cast("int")).drop("middle")


def validated(df: DataFrame, members: dict[str, Sequence[str]], ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """Values outside their set or range become null."""
    out = {c: F.when(F.col(c).isin(*v), F.col(c)) for c, v in members.items()} | {c: F.when(F.col(c).between(*r), F.col(c)) for c, r in ranges.items()}
    return df.withColumns(out)


#: Invalid values of a column that the short report names.
NAMED_VALUES = 20


def invalid_values(df: DataFrame, members: dict[str, Sequence[str]], ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """(column, value, n): every invalid value and its rows, by partial sums; values out of range are one row (null)."""
    none = F.lit(None).cast("string")
    bad = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value"), (F.col(c).isNotNull() & ~F.col(c).isin(*v)).alias("bad")) for c, v in members.items()]
    bad += [F.struct(F.lit(c).alias("column"), none.alias("value"), (F.col(c).isNotNull() & ~F.col(c).between(*r)).alias("bad")) for c, r in ranges.items()]
    return df.select(F.inline(F.array(*bad))).where("bad").groupBy("column", "value").agg(F.count("*").alias("n"))


def validity_report(df: DataFrame, members: dict[str, Sequence[str]], ranges: dict[str, tuple[float, float]]) -> DataFrame:
    """(column, invalid, values): rows with an invalid value, and the first ``NAMED_VALUES`` such values of a category."""
    place = F.row_number().over(Window.partitionBy("column").orderBy("value"))
    counts = invalid_values(df, members, ranges).withColumn("place", place)
    named = F.array_sort(F.collect_list(F.when(F.col("place") <= NAMED_VALUES, F.col("value"))))
    found = counts.groupBy("column").agg(F.sum("n").alias("invalid"), F.array_join(named, ",").alias("values"))
    columns = df.sparkSession.createDataFrame([(c,) for c in [*members, *ranges]], "column string")
    empty = F.when(F.col("column").isin(*ranges), F.lit(""))
    return columns.join(F.broadcast(found), "column", "left").select("column", F.coalesce("invalid", F.lit(0)).alias("invalid"), F.coalesce(empty, "values", F.lit("")).alias("values"))


def one_hot_decoded(flags: dict[str, Column], base: str) -> Column:
    """The label whose flag is 1, the first of several, else the base category."""
    out = None
    for label, flag in flags.items():
        out = F.when(flag == 1, label) if out is None else out.when(flag == 1, label)
    return out.otherwise(base)


def all_nonzero(columns: Sequence[str]) -> Column:
    """Every column differs from 0; null differs."""
    out = F.lit(True)
    for c in columns:
        out = out & F.coalesce(F.col(c) != 0, F.lit(True))
    return out


def zipped(left: DataFrame, right: DataFrame, key: str = "record_id") -> DataFrame:
    """One-to-one join by record id."""
    return left.join(right, key)


def zip_report(left: DataFrame, right: DataFrame, key: str = "record_id") -> DataFrame:
    """Rows of both sides, matched rows, and rows without a partner: the length check of a join by position."""
    both = left.select(key, F.lit(1).alias("l")).join(right.select(key, F.lit(1).alias("r")), key, "full")
    return both.agg(F.count("l").alias("left_rows"), F.count("r").alias("right_rows"), F.count_if(F.col("l").isNotNull() & F.col("r").isNotNull()).alias("matched"), F.count_if(F.col("l").isNull()).alias("only_right"), F.count_if(F.col("r").isNull()).alias("only_left"))


def feature_columns(df: DataFrame, excluded: Sequence[str]) -> list[str]:
    """Numeric columns that are no target, prediction or attribute."""
    return [c for c, t in df.dtypes if c not in excluded and t.split("(")[0] in ("int", "bigint", "double", "float", "decimal", "smallint", "tinyint")]


#: Other names of the metric columns.
METRIC_NAMES = {
    "attribute": "Attribute", "privileged_value": "PrivilegedValue", "disparate_impact": "DisparateImpact", "demographic_parity_difference": "DemographicParityDiff",
    "equal_opportunity_difference": "EqualOpportunityDiff", "average_odds_difference": "AverageOddsDiff", "theil_index": "TheilIndex", "bias_flag": "BiasFlag",
}
METRIC_COLUMNS = {"Attribute": "string", "PrivilegedValue": "string", "DisparateImpact": "double", "DemographicParityDiff": "double", "EqualOpportunityDiff": "double", "AverageOddsDiff": "double", "TheilIndex": "double", "BiasFlag": "boolean"}


def harmonised(df: DataFrame) -> DataFrame:
    """A metric table under the common names and types; missing metrics are null, a missing flag follows from the DI."""
    df = df.withColumnsRenamed({a: b for a, b in METRIC_NAMES.items() if a in df.columns})
    if not {"Attribute", "DisparateImpact"} <= set(df.columns):
        raise ValueError("a metric table needs an attribute and a disparate impact")
    cols = {c: (F.col(c).try_cast(t) if c in df.columns else F.lit(None).cast(t)) for c, t in METRIC_COLUMNS.items()}
    cols["BiasFlag"] = F.coalesce(cols["BiasFlag"], F.try_divide(cols["DisparateImpact"], F.lit(1.0)) < 0.8, F.lit(False))
    return df.select(*[c.alias(n) for n, c in cols.items()])
