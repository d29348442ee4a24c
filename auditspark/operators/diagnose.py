"""Findings, root causes and remedies from audit tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditspark.functions.scalars import any_contained, ratio, severity

#: Cause -> named remedy.
REMEDIES = {
    "historical_label_bias": "Reweighing",
    "proxy_discrimination": "DisparateImpactRemover",
    "representation_bias": "Data collection",
    "unequal_opportunity": "PrejudiceRemover",
    "unequal_odds": "EqOddsPostprocessing",
}
#: Phrase in a cause text -> label.
CAUSE_LABELS = {
    "historical / label bias": "historical_label_bias",
    "proxy discrimination": "proxy_discrimination",
    "representation bias": "representation_bias",
    "unequal opportunity": "unequal_opportunity",
    "unequal odds": "unequal_odds",
}
SMALL_GROUP = 30


def imbalance(breakdown: DataFrame) -> DataFrame:
    """One row for each attribute: size ratio and its finding, small groups, base-rate gap and its groups."""
    order = F.struct("n", "group")
    agg = breakdown.groupBy("attribute").agg(
        F.max("n").alias("largest_n"), F.min("n").alias("smallest_n"), F.max_by("group", order).alias("largest"), F.min_by("group", order).alias("smallest"),
        F.array_sort(F.collect_list(F.when(F.col("n") < SMALL_GROUP, F.coalesce("group", F.lit("null"))))).alias("small_groups"), F.count("base_rate").alias("with_base"),
        (F.max("base_rate") - F.min("base_rate")).alias("base_rate_gap"),
    )
    size = ratio(F.col("largest_n"), F.col("smallest_n"))
    gap = F.when(F.col("with_base") >= 2, F.col("base_rate_gap"))
    return agg.select(
        "attribute", "largest", "smallest", size.alias("size_ratio"), F.when(size > 10, "severe").when(size > 3, "moderate").alias("imbalance"),
        F.array_join("small_groups", ", ").alias("small_groups"), gap.alias("base_rate_gap"), F.coalesce(gap > 0.15, F.lit(False)).alias("base_rate_disparity"),
    )


def findings(imbalances: DataFrame) -> DataFrame:
    """(attribute, finding): one row for each rule that fires."""
    c = F.col
    all_ = F.array_compact(F.array(
        F.when(c("imbalance").isNotNull(), F.concat(c("imbalance"), F.lit(" size imbalance"))),
        F.when(c("small_groups") != "", F.lit("small groups")), F.when(c("base_rate_disparity"), F.lit("base-rate disparity")),
    ))
    return imbalances.select("attribute", F.explode(all_).alias("finding"))


def root_causes(metrics: DataFrame, imbalances: DataFrame, proxies: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(attribute, di, severity, causes, remedies). A missing DI counts as 1, other missing metrics as 0.

    ``proxies`` has (attribute, strength).
    """
    c = F.col
    strong = proxies.where(c("strength").isin("strong", "moderate")).select("attribute").distinct().withColumn("has_proxy", F.lit(True))
    rows = metrics.join(imbalances.select("attribute", "imbalance", "small_groups", "base_rate_gap"), "attribute", "left").join(strong, "attribute", "left")
    di, eod, aod = F.coalesce("di", F.lit(1.0)), F.coalesce("eod", F.lit(0.0)), F.coalesce("aod", F.lit(0.0))
    rules = [
        ("historical_label_bias", c("base_rate_gap") > 0.10), ("proxy_discrimination", c("has_proxy")),
        ("representation_bias", (c("imbalance") == "severe") | (c("small_groups") != "")), ("unequal_opportunity", F.abs(eod) > 0.05), ("unequal_odds", F.abs(aod) > 0.05),
    ]
    named = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for name, rule in rules]))
    fixes = F.array_compact(F.array(*[F.when(rule, F.lit(REMEDIES[name])) for name, rule in rules]))
    fair = di >= 0.95
    causes = F.when((F.size(named) == 0) & fair, F.array(F.lit("none_detected"))).otherwise(named)
    remedies = (
        F.when(F.size(fixes) > 0, fixes).when(di < threshold, F.array(F.lit("AdversarialDebiasing"))).when(di < 0.95, F.array(F.lit("CalibratedEqOddsPostprocessing"))).otherwise(F.array(F.lit("Continue monitoring")))
    )
    return rows.select("attribute", "di", severity(c("di"), threshold).alias("severity"), causes.alias("causes"), remedies.alias("remedies"))


def summary(causes: DataFrame) -> DataFrame:
    """(attribute, di, severity, top cause cut to 80 characters)."""
    return causes.select("attribute", "di", "severity", F.substring(F.try_element_at("causes", F.lit(1)), 1, 80).alias("top_cause"))


def statements(breakdown: DataFrame) -> DataFrame:
    """Highest and lowest group of each attribute, the gap and its direction words."""
    hi, lo = F.struct("selection_rate", "group"), F.struct("selection_rate", "group")
    agg = breakdown.where("group IS NOT NULL").groupBy("attribute").agg(F.max_by("group", hi).alias("highest"), F.max("selection_rate").alias("high"), F.min_by("group", lo).alias("lowest"), F.min("selection_rate").alias("low"))
    gap = F.col("high") - F.col("low")
    return agg.select("attribute", "highest", "lowest", gap.alias("gap"), F.when(gap > 0.1, "large").when(gap > 0.02, "small").otherwise("no").alias("gap_word"))


def cause_labels(text):
    """Sorted distinct labels of the phrases that a cause text contains."""
    low = F.lower(text)
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*[F.when(any_contained(low, [p]), F.lit(v)) for p, v in CAUSE_LABELS.items()]))))


def ranked(causes: DataFrame) -> DataFrame:
    """Attributes from the lowest DI up."""
    return causes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("di").asc_nulls_last(), "attribute")))
