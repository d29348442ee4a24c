"""Feature statistics, classifiers with out-of-fold predictions, and their metrics."""

from __future__ import annotations

import functools
from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.functions.scalars import ratio
from auditspark.operators import fits, running
from auditspark.sources.workspace import written


def feature_statistics(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, median, mean, std): the mean and population deviation after the median has filled nulls."""
    mids = medians(train, columns)
    rows = train.crossJoin(F.broadcast(mids))
    filled = {c: F.coalesce(F.col(c).cast("double"), F.col(f"m_{c}")) for c in columns}
    out = rows.agg(*[F.struct(F.lit(c).alias("column"), F.max(f"m_{c}").cast("double").alias("median"), F.avg(x).alias("mean"), F.stddev_pop(x).alias("std")).alias(c) for c, x in filled.items()])
    return out.select(F.inline(F.array(*columns)))


def standardised(df: DataFrame, train: Column, columns: Sequence[str]) -> DataFrame:
    """Nulls filled with the training median, then centred and scaled by the training rows (no scaling where constant)."""
    mids = medians(df.where(train), columns)
    rows = df.crossJoin(F.broadcast(mids)).withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"m_{c}")) for c in columns})
    stats = rows.where(train).agg(*[a for c in columns for a in (F.avg(c).alias(f"a_{c}"), F.stddev_pop(c).alias(f"s_{c}"))])
    rows = rows.crossJoin(F.broadcast(stats))
    return rows.withColumns({c: (F.col(c) - F.col(f"a_{c}")) / F.when(F.col(f"s_{c}") > 0, F.col(f"s_{c}")).otherwise(1.0) for c in columns}).select(*df.columns)


def modes(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value): each column's commonest value, the smallest of equals."""
    long = train.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns])).alias("x")).select("x.*").where("value IS NOT NULL")
    n = long.groupBy("column", "value").agg(F.count("*").alias("n"))
    return n.groupBy("column").agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("value"))


def one_hot(df: DataFrame, column: str, categories: Sequence[str]) -> DataFrame:
    """0/1 columns for all sorted categories but the first; unknown values are all zeros."""
    return df.withColumns({f"{column}_{v}": F.coalesce(F.col(column) == v, F.lit(False)).cast("int") for v in sorted(categories)[1:]})


def class_weights(df: DataFrame, target: str) -> DataFrame:
    """(target, n, weight): n_all / (2 n_class)."""
    c = df.groupBy(target).agg(F.count("*").alias("n"))
    return c.withColumn("weight", F.sum("n").over(Window.partitionBy(F.lit(0))) / (2.0 * F.col("n")))


def fitted(train: DataFrame, features: Sequence[str], target: str, kind: str = "logistic", balanced: bool = False):
    """A pipeline (assembled features, classifier or regression) fitted on the rows."""
    stages = [VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="skip")]
    if balanced:
        train = train.join(F.broadcast(class_weights(train, target).select(target, "weight")), target)
    extra = {"weightCol": "weight"} if balanced else {}
    if kind == "logistic":
        stages.append(LogisticRegression(labelCol=target, maxIter=50, **extra))
    else:
        stages.append(LinearRegression(labelCol=target, maxIter=50))
    return Pipeline(stages=stages).fit(train)


def logistic_metrics(train: DataFrame, test: DataFrame, features: Sequence[str], target: str) -> DataFrame:
    """n, accuracy, precision, recall, f1 and auc of a balanced logistic model on the test rows.

    If the training rows have one class only, nothing is fitted: accuracy 1, precision, recall and f1 0, AUC 0.5. An AUC of
    test rows with one class only is 0.5 too.
    """
    model = fits.logistic_fit(train, features, target, balanced=True)
    if model.label is not None:
        fixed = {"accuracy": 1.0, "precision": 0.0, "recall": 0.0, "f1": 0.0, "auc": 0.5}
        return test.agg(F.count("*").alias("n"), *[F.lit(v).alias(k) for k, v in fixed.items()])
    tested = written(test.select(F.col(target).alias("actual"), model.predicted(features).alias("predicted"), model.probability(features).alias("score")), "tested")
    return classification_metrics(tested).crossJoin(F.broadcast(auc(tested).select(F.coalesce("auc", F.lit(0.5)).alias("auc"))))


def classification_metrics(df: DataFrame, by: Sequence[str] = (), positive: int = 1) -> DataFrame:
    """accuracy, precision, recall, f1; 0 where a denominator is 0."""
    y, p = F.col("actual") == positive, F.col("predicted") == positive
    c = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(F.col("actual") == F.col("predicted")).alias("ok"), F.count_if(y & p).alias("tp"), F.count_if(p).alias("sel"), F.count_if(y).alias("pos"))
    z = lambda a, b: F.coalesce(ratio(a, b), F.lit(0.0))
    return c.select(*by, "n", z(F.col("ok"), F.col("n")).alias("accuracy"), z(F.col("tp"), F.col("sel")).alias("precision"), z(F.col("tp"), F.col("pos")).alias("recall"), z(2 * F.col("tp"), F.col("sel") + F.col("pos")).alias("f1"))


def score_counts(df: DataFrame, score: str = "score", by: Sequence[str] = ()) -> DataFrame:
    """(score, pos, neg): labels by distinct score, by partial sums; written once, since several passes read it."""
    counts = df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("score")).agg(F.count_if(F.col("actual") == 1).cast("double").alias("pos"), F.count_if(F.col("actual") != 1).cast("double").alias("neg"))
    return written(counts, "score-counts")


def _ranges(counts: DataFrame, columns: Sequence[str], parts: int, by: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """The counts with the score range (``part``) of each, and for each range its sums t_, those of higher scores o_ and of all a_.

    The ranges' bounds are approximate quantiles (of each ``by``, few names), their totals one row a range, so both are
    small at any size. ``counts`` should lie in a table. Part 0 has the highest scores.
    """
    part = None
    for key, bounds in running.quantiles(counts, "score", parts, by).items():
        own = F.lit(len(bounds)) - running.ranges(F.col("score"), bounds)
        if by:
            here = functools.reduce(Column.__and__, [F.col(b) == k for b, k in zip(by, key, strict=True)])
            own = F.when(here, own) if part is None else part.when(here, own)
        part = own
    spread = counts.withColumn("part", F.lit(0) if part is None else part)
    totals = spread.groupBy(*by, "part").agg(*[F.sum(c).alias(f"t_{c}") for c in columns])
    every = Window.partitionBy(*(by or [F.lit(0)]))
    before = every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    more = [x for c in columns for x in (F.coalesce(F.sum(f"t_{c}").over(before), F.lit(0.0)).alias(f"o_{c}"), F.sum(f"t_{c}").over(every).alias(f"a_{c}"))]
    return spread, totals.select(*by, "part", *[f"t_{c}" for c in columns], *more)


def _running(spread: DataFrame, offsets: DataFrame, columns: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Running sums cum_ by falling score without a single-task window: inside the ranges of ``offsets``, which are few rows."""
    inside = Window.partitionBy(*by, "part").orderBy(F.desc("score"))
    rows = spread.join(F.broadcast(offsets), [*by, "part"]).withColumns({f"cum_{c}": F.col(f"o_{c}") + F.sum(c).over(inside) for c in columns})
    return rows.drop("part", *[f"{x}_{c}" for c in columns for x in "ot"])


def exact_quantiles(df: DataFrame, columns: Sequence[str], shares: Sequence[float]) -> DataFrame:
    """One row: for each column an array of its exact quantiles (nulls left out), interpolated between neighbours.

    Values are counted by partial sums and the counts written; of the value ranges only those that hold a wanted rank are
    sorted, so no task sees all distinct values and most of them aren't looked at again.
    """
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("score")) for c in columns]))
    counts = df.select(cells.alias("x")).select("x.*").where("score IS NOT NULL").groupBy("column", "score").agg(F.count("*").cast("double").alias("n"))
    spread, offsets = _ranges(written(counts, "value-counts"), ["n"], 64, ["column"])
    ranks = [f((F.col("a_n") - 1) * share) for share in shares for f in (F.floor, F.ceil)]
    holds = [(F.col("a_n") - F.col("o_n") - F.col("t_n") <= r) & (r < F.col("a_n") - F.col("o_n")) for r in ranks]
    places = _running(spread, offsets.where(functools.reduce(Column.__or__, holds)), ["n"], ["column"]).withColumn("first", F.col("a_n") - F.col("cum_n"))
    values = []
    for share in shares:
        at = (F.col("a_n") - 1) * share
        on = lambda rank: F.max(F.when((F.col("first") <= rank) & (rank < F.col("first") + F.col("n")), F.col("score")))
        values.append(on(F.floor(at)) + (on(F.ceil(at)) - on(F.floor(at))) * F.max(at - F.floor(at)))
    found = places.groupBy("column").agg(F.array(*values).alias("values"))
    none = F.array(*[F.lit(None).cast("double")] * len(shares))
    return found.agg(*[F.coalesce(F.max(F.when(F.col("column") == c, F.col("values"))), none).alias(c) for c in columns])


def medians(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row with the exact median m_<c> of each column."""
    return exact_quantiles(df, columns, [0.5]).select(*[F.col(c)[0].alias(f"m_{c}") for c in columns])


def roc_curve(df: DataFrame, score: str = "score") -> DataFrame:
    """(score, tpr, fpr) at every distinct score."""
    spread, offsets = _ranges(score_counts(df, score), ["pos", "neg"], 64)
    rows = _running(spread, offsets, ["pos", "neg"]).withColumnsRenamed({"a_pos": "all_pos", "a_neg": "all_neg"})
    return rows.select("score", "pos", "neg", ratio(F.col("cum_pos"), F.col("all_pos")).alias("tpr"), ratio(F.col("cum_neg"), F.col("all_neg")).alias("fpr"), "cum_pos", "cum_neg", "all_pos", "all_neg")


def auc(df: DataFrame, score: str = "score") -> DataFrame:
    """Area under the ROC curve, ties counted half; null if only one class occurs."""
    r = roc_curve(df, score)
    area = F.sum(F.col("neg") * (F.col("cum_pos") - F.col("pos") / 2))
    return r.agg(ratio(area, F.max("all_pos") * F.max("all_neg")).alias("auc"))


def confusion_matrix(df: DataFrame) -> DataFrame:
    return df.groupBy("actual", "predicted").agg(F.count("*").alias("n"))


def score_histogram(df: DataFrame, low: float, high: float, bins: int = 50) -> DataFrame:
    """(actual, bin, n) with bins of equal width."""
    k = F.floor((F.col("score") - low) / ((high - low) / bins)).cast("int")
    return df.select("actual", F.greatest(F.lit(0), F.least(F.lit(bins - 1), k)).alias("bin")).groupBy("actual", "bin").agg(F.count("*").alias("n"))


def regression_metrics(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """mae, rmse, r2."""
    e = F.col(actual) - F.col(predicted)
    return df.agg(F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), (1 - ratio(F.avg(e * e), F.var_pop(actual))).alias("r2"))
