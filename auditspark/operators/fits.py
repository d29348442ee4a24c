"""Linear and logistic fits of few features from additive moments, for all folds at once.

A fold's moments (rows, means, sums of products about the means) add up, so the moments of all rows but one fold's are the
sum of the others: K linear fits cost one scan. A logistic fit takes Newton steps; each step is one scan that sums
gradients and curvatures for all K models, a row counting for every model that doesn't hold its fold out. What reaches the
driver is a few numbers for each fold and pair of features, whatever the rows.

Rows with a null feature or target take no part in a fit and get a null prediction.
"""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark.sources.workspace import written

#: Newton steps, and the largest change of a standardised coefficient at which they end.
STEPS, TOLERANCE = 40, 1e-10


class Moments(NamedTuple):
    """Rows, means and sums of products about the means of some columns."""

    n: float
    mean: np.ndarray
    products: np.ndarray

    def __add__(self, other: Moments) -> Moments:
        if not self.n or not other.n:
            return other if not self.n else self
        n, apart = self.n + other.n, other.mean - self.mean
        return Moments(n, self.mean + apart * (other.n / n), self.products + other.products + np.outer(apart, apart) * (self.n * other.n / n))


def complete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def moments(df: DataFrame, columns: Sequence[str], fold: Column) -> dict[int, Moments]:
    """Moments of the columns by fold, in one scan."""
    pairs = [(i, j) for i in range(len(columns)) for j in range(i, len(columns))]
    x = [F.col(c).cast("double") for c in columns]
    aggs = [F.count("*").alias("n"), *[F.avg(c).alias(f"m{i}") for i, c in enumerate(x)], *[F.covar_pop(x[i], x[j]).alias(f"c{i}_{j}") for i, j in pairs]]
    out = {}
    for r in complete(df, columns).groupBy(fold.alias("fold")).agg(*aggs).collect():  # one row a fold
        products = np.zeros((len(columns), len(columns)))
        for i, j in pairs:
            products[i, j] = products[j, i] = r[f"c{i}_{j}"] * r["n"]
        out[r["fold"]] = Moments(float(r["n"]), np.array([r[f"m{i}"] for i in range(len(columns))]), products)
    return out


def _others(by_fold: dict, fold) -> Moments:
    total = Moments(0.0, np.zeros(0), np.zeros((0, 0)))
    for k in sorted(by_fold):
        if k != fold:
            total = total + by_fold[k]
    return total


def _scales(m: Moments, n: float) -> tuple[np.ndarray, np.ndarray]:
    """Deviations (times the root of rows over n) of all columns but the last, 1 for constant ones; and 0 for these, 1 for others.

    A column whose spread is within the rounding of its mean is constant.
    """
    varied = np.diag(m.products) > 1e-26 * m.n * m.mean**2
    return np.where(varied, np.sqrt(np.diag(m.products) / n), 1.0)[:-1], varied.astype(float)


class Linear(NamedTuple):
    """intercept + sum of slope * feature."""

    intercept: float
    slopes: tuple[float, ...]

    def column(self, features: Sequence[str]) -> Column:
        out = F.lit(self.intercept)
        for f, b in zip(features, self.slopes, strict=True):
            out = out + F.lit(b) * F.col(f).cast("double")
        return out


def linear(m: Moments) -> Linear:
    """Least squares of the last column on the others; of several solutions the shortest (constant features get 0)."""
    unit, held = _scales(m, 1.0)
    m = m._replace(products=m.products * np.outer(held, held))
    slopes = np.linalg.lstsq(m.products[:-1, :-1] / np.outer(unit, unit), m.products[:-1, -1] / unit, rcond=1e-12)[0] / unit
    return Linear(float(m.mean[-1] - slopes @ m.mean[:-1]), tuple(map(float, slopes)))


def linear_fit(df: DataFrame, features: Sequence[str], target: str) -> Linear:
    """Least squares over all rows."""
    return linear(_others(moments(df, [*features, target], F.lit(0)), None))


def out_of_fold_linear(df: DataFrame, features: Sequence[str], target: str, fold: str = "fold") -> DataFrame:
    """Adds ``prediction``: by the fit of all rows of other folds. One scan for all fits, one for the predictions."""
    by_fold = moments(df, [*features, target], F.col(fold))
    if len(by_fold) < 2:
        return df.withColumn("prediction", F.lit(None).cast("double"))
    out = None
    for k in sorted(by_fold):
        p = linear(_others(by_fold, k)).column(features)
        out = F.when(F.col(fold) == k, p) if out is None else out.when(F.col(fold) == k, p)
    return df.withColumn("prediction", out)


class Logistic(NamedTuple):
    """A linear score of the log odds, or only one ``label`` where the rows had no other."""

    score: Linear
    label: int | None = None

    def probability(self, features: Sequence[str]) -> Column:
        """Of label 1; 0 where only one class was seen, as no odds are known."""
        if self.label is not None:
            return F.lit(0.0)
        return 1.0 / (1.0 + F.exp(-self.score.column(features)))

    def predicted(self, features: Sequence[str]) -> Column:
        if self.label is not None:
            return F.lit(self.label)
        return (self.probability(features) >= 0.5).cast("int")


def _newton_sums(rows: DataFrame, features: Sequence[str], target: str, state: dict, held_out: bool) -> dict:
    """{model: (gradient, curvature, loss)} of the weighted log loss, in one scan. ``state``: (coefficients, means, scales, weights)."""
    d = len(features)
    model = lambda k, s: F.struct(F.lit(k).alias("model"), *[F.lit(float(v)).alias(n) for n, v in [*((f"b{i}", s[0][i]) for i in range(d + 1)), *((f"m{i}", s[1][i]) for i in range(d)), *((f"s{i}", s[2][i]) for i in range(d)), ("w0", s[3][0]), ("w1", s[3][1])]])
    each = rows.select(*features, target, "fold", F.inline(F.array(*[model(k, s) for k, s in state.items()])))
    if held_out:
        each = each.where(F.col("fold") != F.col("model"))
    z = [F.lit(1.0), *[(F.col(f).cast("double") - F.col(f"m{i}")) / F.col(f"s{i}") for i, f in enumerate(features)]]
    each = each.select("model", F.col(target).cast("double").alias("y"), F.when(F.col(target) == 1, F.col("w1")).otherwise(F.col("w0")).alias("w"), *[x.alias(f"z{i}") for i, x in enumerate(z)], sum((F.col(f"b{i}") * x for i, x in enumerate(z)), F.lit(0.0)).alias("t"))
    p = 1.0 / (1.0 + F.exp(-F.col("t")))
    each = each.withColumns({"e": F.col("w") * (p - F.col("y")), "c": F.col("w") * p * (1.0 - p), "loss": F.col("w") * (F.greatest(F.col("t"), F.lit(0.0)) - F.col("t") * F.col("y") + F.log1p(F.exp(-F.abs("t"))))})
    pairs = [(i, j) for i in range(d + 1) for j in range(i, d + 1)]
    sums = each.groupBy("model").agg(F.sum("loss").alias("loss"), *[F.sum(F.col("e") * F.col(f"z{i}")).alias(f"g{i}") for i in range(d + 1)], *[F.sum(F.col("c") * F.col(f"z{i}") * F.col(f"z{j}")).alias(f"h{i}_{j}") for i, j in pairs])
    out = {}
    for r in sums.collect():  # one row a model
        h = np.zeros((d + 1, d + 1))
        for i, j in pairs:
            h[i, j] = h[j, i] = r[f"h{i}_{j}"]
        out[r["model"]] = np.array([r[f"g{i}"] for i in range(d + 1)]), h, r["loss"]
    return out


def logistic_fits(df: DataFrame, features: Sequence[str], target: str, fold: str | None = None, balanced: bool = False, ridge: float = 1.0) -> dict[int, Logistic]:
    """A logistic model for each fold, from all other folds (or one model, 0, of all rows without ``fold``).

    ``ridge`` penalises half the squared slopes of standardised features; ``balanced`` weighs classes evenly. Where a model's
    rows have one class only, that class is the model. A step that doesn't lower the loss is halved.
    """
    d = len(features)
    rows = complete(df, [*features, target]).select(*features, target, (F.col(fold) if fold else F.lit(-1)).alias("fold"))
    rows = written(rows, "fit")
    by_fold = moments(rows, [*features, target], F.col("fold"))
    models, state, done = {}, {}, {}
    for k in sorted(by_fold) if fold else [0]:
        m = _others(by_fold, k if fold else None)
        share = m.mean[-1] if m.n else 0.0
        if not 0 < share < 1 or m.products[-1, -1] <= 0:
            models[k] = Logistic(Linear(0.0, (0.0,) * d), int(round(share)))
            continue
        weights = (0.5 / (1 - share), 0.5 / share) if balanced else (1.0, 1.0)
        state[k] = [np.zeros(d + 1), m.mean[:-1], _scales(m, m.n)[0], weights]
        done[k] = [np.inf, np.zeros(d + 1), np.zeros(d + 1)]  # the last loss, the coefficients it had, the step from there
    penalty = ridge * np.r_[0.0, np.ones(d)]
    todo = set(state)
    for _ in range(STEPS):
        if not todo:
            break
        sums = _newton_sums(rows, features, target, {k: state[k] for k in sorted(todo)}, bool(fold))
        for k, (g, h, loss) in sums.items():
            b, before = state[k][0], done[k]
            whole = loss + 0.5 * (penalty * b * b).sum()
            if whole > before[0] * (1 + 1e-12):
                before[2] = before[2] / 2
                state[k][0] = before[1] + before[2]
            else:
                step = -np.linalg.lstsq(h + np.diag(penalty), g + penalty * b, rcond=1e-12)[0]
                done[k] = before = [whole, b, step]
                state[k][0] = b + step
            if np.abs(before[2]).max() < TOLERANCE:
                todo.discard(k)
    for k, (b, mean, scale, _) in state.items():
        slopes = b[1:] / scale
        models[k] = Logistic(Linear(float(b[0] - slopes @ mean), tuple(map(float, slopes))))
    return models


def logistic_fit(df: DataFrame, features: Sequence[str], target: str, balanced: bool = False, ridge: float = 1.0) -> Logistic:
    return logistic_fits(df, features, target, None, balanced, ridge)[0]


def out_of_fold_logistic(df: DataFrame, features: Sequence[str], target: str, fold: str = "fold", ridge: float = 1.0) -> DataFrame:
    """Adds ``score`` (probability of label 1) and ``predicted``, by the model that didn't see the row's fold."""
    score = predicted = None
    for k, m in sorted(logistic_fits(df, features, target, fold, ridge=ridge).items()):
        p, label = m.probability(features), m.predicted(features)
        here = F.col(fold) == k
        score, predicted = (F.when(here, p), F.when(here, label)) if score is None else (score.when(here, p), predicted.when(here, label))
    none = F.lit(None)
    return df.withColumns({"score": none.cast("double") if score is None else score, "predicted": none.cast("int") if predicted is None else predicted})


def gradients(df: DataFrame, features: Sequence[str], target: str, models: dict[int, Logistic], fold: str | None = None, balanced: bool = False, ridge: float = 1.0) -> DataFrame:
    """(model, parameter, gradient): the mean gradient of each model's penalised loss over its rows, recomputed from the rows.

    It vanishes at the best fit. Slopes are those of features in units of their deviation, as in the fit.
    """
    rows = complete(df, [*features, target])
    parts = []
    for k, m in sorted(models.items()):
        own = rows.where(F.col(fold) != k) if fold else rows
        stats = own.agg(F.count("*").alias("n"), F.avg(target).alias("share"), *[F.avg(F.col(f).cast("double")).alias(f"m_{f}") for f in features], *[F.stddev_pop(F.col(f).cast("double")).alias(f"s_{f}") for f in features])
        own = own.crossJoin(F.broadcast(stats))
        w = F.when(F.col(target) == 1, 0.5 / F.col("share")).otherwise(0.5 / (1 - F.col("share"))) if balanced else F.lit(1.0)
        e = w * (m.probability(features) - F.col(target))
        unit = [F.col(f"s_{f}") for f in features]
        terms = [F.avg(e), *[F.avg(e * (F.col(f).cast("double") - F.col(f"m_{f}")) / s) + F.max(F.lit(ridge * b) * s / F.col("n")) for f, s, b in zip(features, unit, m.score.slopes, strict=True)]]
        found = own.agg(*[t.alias(f"g{i}") for i, t in enumerate(terms)])
        names = ["intercept", *features]
        parts.append(found.select(F.inline(F.array(*[F.struct(F.lit(k).alias("model"), F.lit(x).alias("parameter"), F.col(f"g{i}").alias("gradient")) for i, x in enumerate(names)]))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
