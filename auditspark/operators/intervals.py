"""Interval estimates of cell disparities, reference-group conventions, shrinkage."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.functions.scalars import ratio, wilson

CONVENTIONS = ("max_rate", "max_rate_floor15", "control")


def with_reference(cells: DataFrame, convention: str, by: Sequence[str] = (), rate: str = "rate", floor: int = 15, control: str | None = None, strict: bool = False) -> DataFrame:
    """Adds ref_cell, ref_rate, ref_k and ref_n: the partition's reference cell. Ties go to the first label.

    With a floor, the largest rate of any cell stands in where no cell reaches it, or nothing (``strict``).
    """
    w = Window.partitionBy(*(by or [F.lit(0)]))
    if convention == "control":
        eligible: Column = F.col("cell") == control
    elif convention == "max_rate":
        eligible = F.col("n") >= 1
    else:
        eligible = F.col("n") >= floor
    some = F.max(eligible.cast("int")).over(w) == 1
    if convention == "max_rate_floor15" and not strict:
        eligible = F.when(some, eligible).otherwise(F.col("n") >= 1)
    order = F.when(eligible, F.struct((-F.col(rate)).alias("r"), F.col("cell").alias("c"), F.col(rate).alias("rate"), F.col("k").alias("k"), F.col("n").alias("n")))
    return cells.withColumn("ref", F.min(order).over(w)).withColumns({"ref_cell": F.col("ref.c"), "ref_rate": F.col("ref.rate"), "ref_k": F.col("ref.k"), "ref_n": F.col("ref.n")}).drop("ref")


def with_references(cells: DataFrame, by: Sequence[str], rate: str = "rate", floor: int = 15, control: str | None = None) -> DataFrame:
    """As ``with_reference`` for rows that name their convention (a column of ``by``), all in one window."""
    w, c = Window.partitionBy(*by), F.col
    eligible = F.when(c("convention") == "control", c("cell").eqNullSafe(F.lit(control))).when(c("convention") == "max_rate", c("n") >= 1).otherwise(c("n") >= floor)
    cells = cells.withColumn("some", F.max(eligible.cast("int")).over(w) == 1)
    eligible = F.when((c("convention") == "max_rate_floor15") & ~c("some"), c("n") >= 1).otherwise(eligible)
    order = F.when(eligible, F.struct((-c(rate)).alias("r"), c("cell").alias("c"), c(rate).alias("rate"), c("k").alias("k"), c("n").alias("n")))
    return cells.withColumn("ref", F.min(order).over(w)).withColumns({"ref_cell": c("ref.c"), "ref_rate": c("ref.rate"), "ref_k": c("ref.k"), "ref_n": c("ref.n")}).drop("ref", "some")


def di_intervals(cells: DataFrame, floor: int = 15) -> DataFrame:
    """DI against the reference with conservative bounds lo / ref_hi and hi / ref_lo, and what they decide.

    Cells without a reference (no cell is eligible) give no row.
    """
    cells = cells.where(F.col("ref_cell").isNotNull())
    lo, hi = wilson(F.col("k"), F.col("n"))
    ref_lo, ref_hi = wilson(F.col("ref_k"), F.col("ref_n"))
    c = F.col
    out = cells.withColumns({"di": ratio(c("rate"), c("ref_rate")), "di_ci_low": ratio(lo, ref_hi), "di_ci_high": ratio(hi, ref_lo)})
    sure = F.coalesce((c("di_ci_high") < 0.72) | (c("di_ci_low") >= 0.8) | ((c("di_ci_low") >= 0.72) & (c("di_ci_high") < 0.8)), F.lit(False))
    out = out.withColumns({"band_determinate": sure, "spans_four_fifths": F.coalesce((c("di_ci_low") < 0.8) & (c("di_ci_high") >= 0.8), F.lit(False)), "below_floor": c("n") < floor})
    return out.withColumn("defensible", F.coalesce(c("band_determinate") & (F.round("di_ci_high", 4) < 1.0), F.lit(False)))


def eb_shrunk(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``shrunk``: cell rates drawn to the pooled rate by a beta prior whose strength comes from moments."""
    w = Window.partitionBy(*(by or [F.lit(0)]))
    c = F.col
    total = F.sum("n").over(w)
    pooled = F.sum("k").over(w) / total
    rows = cells.withColumns({"pooled": pooled, "total": total, "seen": F.sum((c("n") >= 1).cast("int")).over(w), "squares": F.sum(c("n").cast("double") * c("n")).over(w)})
    spread = F.sum(F.when(c("n") >= 1, c("n") * F.pow(c("k") / F.nullif(c("n"), F.lit(0)) - c("pooled"), 2)).otherwise(0.0)).over(w)
    rows = rows.withColumn("spread", spread)
    pq = c("pooled") * (1 - c("pooled"))
    rho = ratio(c("spread") - pq * (c("seen") - 1), pq * (c("total") - c("squares") / c("total")))
    rho = F.greatest(F.lit(1e-4), F.least(F.lit(0.99), F.coalesce(rho, F.lit(1e-4))))
    rows = rows.withColumn("tau", (1 - rho) / rho)
    shrunk = F.when(c("n") >= 1, (c("k") + c("pooled") * c("tau")) / (c("n") + c("tau")))
    return rows.withColumn("shrunk", shrunk).drop("total", "seen", "squares", "spread")
