"""Group-fairness metrics. Everything derives from one additive table of confusion cells.

Decision tables have a record id, ``actual`` and ``predicted`` labels and attribute columns. ``favorable`` names the
label that is good for the person. Undefined ratios are null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.functions.scalars import band, ratio, severity

COUNTS = ("n", "sel", "pos", "tp", "fp")


def confusion_cells(df: DataFrame, attrs: Sequence[str], favorable: int = 1, actual: str = "actual", predicted: str = "predicted") -> DataFrame:
    """One row for each combination of attribute values (nulls too): n, sel, pos, tp, fp. One scan with partial sums."""
    y, p = F.col(actual).eqNullSafe(favorable), F.col(predicted).eqNullSafe(favorable)
    return df.groupBy(*attrs).agg(F.count("*").alias("n"), F.count_if(p).alias("sel"), F.count_if(y).alias("pos"), F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"))


def grouped_cells(cells: DataFrame, attrs: Sequence[str]) -> DataFrame:
    """(attribute, value, counts) for each attribute alone: grouping sets over the small cell table, nulls kept apart."""
    sums = [F.sum(c).alias(c) for c in COUNTS]
    wide = cells.groupingSets([[F.col(a)] for a in attrs], *map(F.col, attrs)).agg(F.grouping_id().alias("gid"), *sums)
    name, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for k, a in enumerate(attrs):
        here = F.col("gid") == ((1 << len(attrs)) - 1 - (1 << (len(attrs) - 1 - k)))
        name, value = F.when(here, a).otherwise(name), F.when(here, F.col(a).cast("string")).otherwise(value)
    return wide.select(name.alias("attribute"), value.alias("value"), *COUNTS)


def rates(counts: DataFrame) -> DataFrame:
    """Adds base_rate, selection_rate, tpr and fpr to rows of counts."""
    c = F.col
    return counts.withColumns({"base_rate": ratio(c("pos"), c("n")), "selection_rate": ratio(c("sel"), c("n")), "tpr": ratio(c("tp"), c("pos")), "fpr": ratio(c("fp"), c("n") - c("pos"))})


def two_groups(long: DataFrame, privileged: DataFrame, null_group: str = "unprivileged") -> DataFrame:
    """Counts of the privileged group and of all others by attribute: columns p_n .. p_fp and u_n .. u_fp.

    ``privileged`` has (attribute, privileged). Rows with a null value count as unprivileged, or not at all ('exclude').
    """
    rows = long.join(privileged, "attribute")
    if null_group == "exclude":
        rows = rows.where("value IS NOT NULL")
    inside = F.col("value").eqNullSafe(F.col("privileged"))
    return rows.groupBy("attribute", "privileged").agg(*[F.coalesce(F.sum(F.when(side, F.col(c))), F.lit(0)).alias(f"{tag}_{c}") for tag, side in (("p", inside), ("u", ~inside)) for c in COUNTS])


def theil(selected: Column, n: Column, mode: str = "selected") -> Column:
    """Theil index of the benefit 'selected'. ``selected`` averages over selected rows only: (1/b) ln(1/b); ``all``: ln(1/b)."""
    b = ratio(selected, n)
    value = F.log(1 / b) * (1 / b if mode == "selected" else F.lit(1.0))
    return F.when(b.isNull() | (b <= 0) | (b >= 1), F.lit(0.0)).otherwise(value)


def pair_metrics(sides: DataFrame, orientation: str = "unpriv_over_priv", outcome: str = "predicted") -> DataFrame:
    """Disparate impact, demographic parity, equal opportunity and average odds differences of ``two_groups`` rows.

    ``outcome='actual'`` takes the labels themselves as selections for the first two.
    """
    a, b = ("u", "p") if orientation == "unpriv_over_priv" else ("p", "u")
    c = lambda tag, x: F.col(f"{tag}_{x}")
    got = "sel" if outcome == "predicted" else "pos"
    sel = {t: ratio(c(t, got), c(t, "n")) for t in "pu"}
    tpr = {t: ratio(c(t, "tp"), c(t, "pos")) for t in "pu"}
    fpr = {t: ratio(c(t, "fp"), c(t, "n") - c(t, "pos")) for t in "pu"}
    return sides.withColumns({
        "di": ratio(sel[a], sel[b]), "dpd": sel[a] - sel[b], "eod": tpr[a] - tpr[b], "aod": ((fpr[a] - fpr[b]) + (tpr[a] - tpr[b])) / 2,
        "theil": theil(c("p", "sel") + c("u", "sel"), c("p", "n") + c("u", "n")),
    })


def attribute_metrics(df: DataFrame, privileged: dict[str, str], favorable: int = 1, threshold: float = 0.8, null_group: str = "unprivileged", outcome: str = "predicted", orientation: str = "unpriv_over_priv") -> DataFrame:
    """All metrics of every configured attribute in one job, with the four-fifths flag (false where undefined) and severity."""
    return cell_metrics(confusion_cells(df, list(privileged), favorable), privileged, threshold, null_group, outcome, orientation)


def cell_metrics(cells: DataFrame, privileged: dict[str, str], threshold: float = 0.8, null_group: str = "unprivileged", outcome: str = "predicted", orientation: str = "unpriv_over_priv") -> DataFrame:
    """The same from confusion cells over these attributes."""
    config = cells.sparkSession.createDataFrame(list(privileged.items()), "attribute string, privileged string")
    sides = two_groups(grouped_cells(cells, list(privileged)), config, null_group)
    return pair_metrics(sides, orientation, outcome).select("attribute", "privileged", "di", "dpd", "eod", "aod", "theil", F.coalesce(F.col("di") < threshold, F.lit(False)).alias("bias_flag"), severity(F.col("di"), threshold).alias("severity"))


def majority_groups(long: DataFrame) -> DataFrame:
    """(attribute, privileged): each attribute's largest group, the smallest value of equals."""
    first = Window.partitionBy("attribute").orderBy(F.desc("n"), "value")
    return long.where("value IS NOT NULL").withColumn("k", F.row_number().over(first)).where("k = 1").select("attribute", F.col("value").alias("privileged"))


def breakdown(df: DataFrame, attrs: Sequence[str], favorable: int = 1, keep_null: bool = True) -> DataFrame:
    """Per group: n, share of all rows in percent, base rate, selection rate, TPR, FPR."""
    return cell_breakdown(confusion_cells(df, attrs, favorable), attrs, keep_null)


def cell_breakdown(cells: DataFrame, attrs: Sequence[str], keep_null: bool = True) -> DataFrame:
    """The same from confusion cells over these attributes."""
    long = grouped_cells(cells, attrs)
    long = long if keep_null else long.where("value IS NOT NULL")
    share = 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("attribute"))
    return rates(long).select("attribute", F.col("value").alias("group"), "n", share.alias("pct_of_total"), "base_rate", "selection_rate", "tpr", "fpr")


def parity_ratio(long: DataFrame) -> DataFrame:
    """Smallest over largest selection rate of an attribute's groups."""
    r = rates(long.where("value IS NOT NULL"))
    return r.groupBy("attribute").agg(ratio(F.min("selection_rate"), F.max("selection_rate")).alias("parity_ratio"))


def orientations(df: DataFrame, attrs: Sequence[str], privileged: dict[str, str]) -> DataFrame:
    """The metrics under favorable label 0 and 1."""
    out = [attribute_metrics(df, privileged, fav).withColumn("favorable", F.lit(fav)) for fav in (0, 1)]
    return out[0].unionByName(out[1])


def overall_rates(df: DataFrame, favorable: int = 1) -> DataFrame:
    """Target rate, selection rate and the share of the commoner label, in one row."""
    y, p = F.col("actual") == favorable, F.col("predicted") == favorable
    mean = lambda c: F.avg(c.cast("int"))
    return df.agg(mean(y).alias("target_rate"), mean(p).alias("selection_rate"), F.greatest(mean(y), 1 - mean(y)).alias("majority_rate"))


def cell_table(df: DataFrame, attrs: Sequence[str], favorable: int = 1, floor: int = 15, keep_null: bool = False, by: Sequence[str] = ()) -> DataFrame:
    """Intersectional cells: n, k, rate, below_floor, DI against the best cell of at least ``floor`` rows (any, if none has)."""
    rows = confusion_cells(df, [*by, *attrs], favorable)
    if not keep_null:
        rows = rows.na.drop(subset=list(attrs))
    w = Window.partitionBy(*(by or [F.lit(0)]))
    rate = F.col("sel") / F.col("n")
    rows = rows.select(*by, F.concat_ws(" x ", *[F.coalesce(F.col(a).cast("string"), F.lit("null")) for a in attrs]).alias("cell"), "n", F.col("sel").alias("k"), rate.alias("rate"), (F.col("n") < floor).alias("below_floor"))
    sized = F.max(F.when(F.col("n") >= floor, F.col("rate"))).over(w)
    return rows.withColumn("best_sized", sized).withColumn("di_vs_best", ratio(F.col("rate"), F.coalesce("best_sized", F.max("rate").over(w)))).withColumn("di_vs_sized", ratio(F.col("rate"), F.col("best_sized")))


def cell_summary(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Cells, suppressed ones, worst visible and worst actual cell, suppressed cells worse than any visible one.

    Cells without a DI come last: if no cell reaches the floor, the first label is the worst actual one, with a null DI.
    """
    worst = lambda cond: F.min_by("cell", F.when(cond, F.struct(F.col("di_vs_sized").isNull(), "di_vs_sized", "cell")))
    visible = ~F.col("below_floor")
    w = Window.partitionBy(*(by or [F.lit(0)]))
    cells = cells.withColumn("least_visible", F.min(F.when(visible, F.col("di_vs_sized"))).over(w))
    return cells.groupBy(*by).agg(
        F.count("*").alias("cells"), F.count_if("below_floor").alias("suppressed"), worst(visible).alias("worst_visible"), F.min("least_visible").alias("worst_visible_di"),
        worst(F.lit(True)).alias("worst_actual"), F.min("di_vs_sized").alias("worst_actual_di"), F.count_if(F.col("below_floor") & (F.col("di_vs_sized") < F.col("least_visible"))).alias("suppressed_worse"),
    )


def extremes(cells: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Lowest and highest cell of sufficient size, and their gap."""
    sized = cells.where("NOT below_floor")
    return sized.groupBy(*by).agg(F.min_by("cell", F.struct("rate", "cell")).alias("worst"), F.min("rate").alias("worst_rate"), F.max_by("cell", F.struct("rate", "cell")).alias("best"), F.max("rate").alias("best_rate"), (F.max("rate") - F.min("rate")).alias("gap"))


def attribute_severities(cells: DataFrame) -> DataFrame:
    """Cells with the fixed-cut band of their DI."""
    return cells.select("cell", "n", "rate", "di_vs_best", "below_floor", band(F.col("di_vs_best")).alias("band"))
