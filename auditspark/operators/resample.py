"""How often an audit of a sample errs: repeated draws, reporting policies, error events.

A simple random sample of size m reduces to cell counts, and those are multivariate hypergeometric over (cell, favorable)
counts. ``drawn_counts`` draws them on the executors from the small cell table, one generator for each (seed, m, draw), so
its cost does not depend on the number of rows. ``hash_draws`` draws rows by hash order instead, for data of oracle size.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditspark.functions.scalars import ratio, wilson
from auditspark.operators.intervals import eb_shrunk, with_reference, with_references
from auditspark.operators.split import DIGITS
from auditspark.sources.workspace import written

POLICIES = ("floor15", "floor30", "point", "wilson", "eb")
#: Most cells of a study: their table goes to every task.
MOST_CELLS = 100_000


def drawn_counts(cells: DataFrame, sizes: Sequence[int], draws: int, seed: int = 20260808) -> DataFrame:
    """(m, draw, cell, k, n) for every size, draw and cell (cells that a draw misses have n = 0).

    ``cells`` has (cell, k, n) and one row a cell; it is collected, since it doesn't grow with the rows. More than
    ``MOST_CELLS`` cells are an error.
    """
    table = [(r["cell"], int(r["k"]), int(r["n"])) for r in cells.select("cell", "k", "n").limit(MOST_CELLS + 1).collect()]
    if len(table) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} cells")
    table.sort()
    spark = cells.sparkSession

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import numpy as np

        counts = np.array([x for _, k, n in table for x in (k, n - k)], np.int64)
        names = [c for c, _, _ in table]
        for b in batches:
            if len(b):
                one = lambda m, draw: np.random.default_rng([seed, int(m), int(draw)]).multivariate_hypergeometric(counts, min(int(m), int(counts.sum())), method="marginals")
                got = np.array([one(m, draw) for m, draw in zip(b["m"], b["draw"], strict=True)]).reshape(-1, 2)
                yield pd.DataFrame({"m": np.repeat(b["m"], len(names)), "draw": np.repeat(b["draw"], len(names)), "cell": names * len(b), "k": got[:, 0], "n": got.sum(1)})

    grid = spark.range(draws).select(F.explode(F.array(*[F.lit(m) for m in sizes])).alias("m"), F.col("id").cast("int").alias("draw"))
    parts = max(1, min(len(sizes) * draws // 100, 2000))
    return grid.repartition(parts, "m", "draw").mapInPandas(run, "m int, draw int, cell string, k long, n long")


def hash_draws(rows: DataFrame, sizes: Sequence[int], draws: int) -> DataFrame:
    """(m, draw, cell, k, n) from rows (record_id, cell, fav): the m rows with the smallest md5(record_id|draw).

    Rows are counted by the digest's first digits; only those up to the digits at which the largest sample ends are ranked.
    """
    each = rows.select("record_id", "cell", "fav", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("draw"))
    each = each.withColumn("h", F.md5(F.concat_ws("|", F.col("record_id").cast("string"), F.col("draw").cast("string")))).withColumn("bucket", F.substring("h", 1, DIGITS))
    before = Window.partitionBy("draw").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    counts = each.groupBy("draw", "bucket").agg(F.count("*").alias("rows")).select("draw", "bucket", F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("offset"))
    near = each.join(counts.where(F.col("offset") < max(sizes)), ["draw", "bucket"])
    ranked = near.withColumn("rank", F.col("offset") + F.row_number().over(Window.partitionBy("draw", "bucket").orderBy("h", "record_id")))
    taken = ranked.select("draw", "cell", "fav", F.explode(F.filter(F.array(*[F.lit(m) for m in sizes]), lambda m: F.col("rank") <= m)).alias("m"))
    seen = taken.groupBy("m", "draw", "cell").agg(F.sum("fav").cast("long").alias("k"), F.count("*").alias("n"))
    grid = rows.select("cell").distinct().crossJoin(F.broadcast(rows.sparkSession.createDataFrame([(m, d) for m in sizes for d in range(draws)], "m int, draw int")))
    return grid.join(seen, ["m", "draw", "cell"], "left").select("m", "draw", "cell", F.coalesce("k", F.lit(0)).alias("k"), F.coalesce("n", F.lit(0)).alias("n"))


def draw_totals(draws: DataFrame, cells: DataFrame) -> DataFrame:
    """(m, draw, rows, cells, possible): what every draw must satisfy exactly. ``cells`` has one row a cell."""
    own = cells.select("cell", F.col("k").alias("all_k"), F.col("n").alias("all_n"))
    fits = (F.col("k") >= 0) & (F.col("k") <= F.col("all_k")) & (F.col("n") - F.col("k") >= 0) & (F.col("n") - F.col("k") <= F.col("all_n") - F.col("all_k"))
    return draws.join(F.broadcast(own), "cell").groupBy("m", "draw").agg(F.sum("n").alias("rows"), F.count("*").alias("cells"), F.bool_and(fits).alias("possible"))


def draw_moments(draws: DataFrame, cells: DataFrame, errors: float = 6.0) -> DataFrame:
    """(m, cell, n_mean, k_mean, n_variance, k_variance, covariance): whether the draws' moments fit sampling without replacement.

    A mean may miss the expected one by ``errors`` standard errors; a variance, or the covariance of n and k, by ``errors``
    times the error that variances of so many nearly normal draws have (and of few counts: at least 1 % of a row).
    """
    total = F.sum("n").over(Window.partitionBy(F.lit(0)))
    own = cells.select("cell", F.col("k").alias("all_k"), F.col("n").alias("all_n"), total.alias("total"))
    seen = draws.groupBy("m", "cell").agg(F.count("*").alias("draws"), F.avg("n").alias("n"), F.avg("k").alias("k"), F.var_pop("n").alias("vn"), F.var_pop("k").alias("vk"), F.covar_pop("n", "k").alias("c"))
    rows = seen.join(F.broadcast(own), "cell").withColumn("s", F.least(F.col("m"), F.col("total")).cast("double"))
    c, m = F.col, F.col("s")
    pn, pk = c("all_n") / c("total"), c("all_k") / c("total")
    left = ratio(c("total") - m, c("total") - 1)
    want_vn, want_vk, want_c = m * pn * (1 - pn) * left, m * pk * (1 - pk) * left, m * pk * (1 - pn) * left
    near = lambda got, want, error: F.abs(got - want) <= errors * error + 1e-9
    mean = lambda variance: F.sqrt(variance / c("draws"))
    spread = lambda x, y: F.sqrt(2 * x * y / c("draws")) + 0.01
    return rows.select(
        "m", "cell", near(c("n"), m * pn, mean(want_vn)).alias("n_mean"), near(c("k"), m * pk, mean(want_vk)).alias("k_mean"),
        near(c("vn"), want_vn, spread(want_vn, want_vn)).alias("n_variance"), near(c("vk"), want_vk, spread(want_vk, want_vk)).alias("k_variance"), near(c("c"), want_c, spread(want_vn, want_vk)).alias("covariance"),
    )


def population_truth(cells: DataFrame, conventions: Sequence[str], control: str | None = None) -> DataFrame:
    """(convention, cell, theta, is_ref, violating, is_worst): the DI of each cell in the whole population, to 4 digits."""
    out = None
    for c in conventions:
        one = with_reference(cells.withColumn("rate", ratio(F.col("k"), F.col("n"))), c, control=control).withColumn("convention", F.lit(c))
        out = one if out is None else out.unionByName(one)
    out = out.withColumn("exact", ratio(F.col("rate"), F.col("ref_rate"))).withColumn("theta", F.round("exact", 4))
    w = Window.partitionBy("convention")
    worst = F.min(F.struct("exact", "cell")).over(w)
    return out.select("convention", "cell", "theta", (F.col("cell") == F.col("ref_cell")).alias("is_ref"), ((F.col("exact") < 0.8) & (F.col("cell") != F.col("ref_cell"))).alias("violating"), (worst["cell"] == F.col("cell")).alias("is_worst"))


def assertions(draws: DataFrame, conventions: Sequence[str], control: str | None = None) -> DataFrame:
    """One row for each (m, draw, cell, convention, policy): reported, di, clear, violate, asserted, bounds, is_sample_ref.

    The draws are written once; conventions and kinds of rates are rows of one table, so that windows run once for all.
    """
    keys = ["m", "draw"]
    base = eb_shrunk(written(draws, "draws"), keys).withColumn("point", ratio(F.col("k"), F.col("n")))
    kinds = [F.struct(F.lit(c).alias("convention"), F.lit(x).alias("source"), F.array(*map(F.lit, p)).alias("policies")) for x, p in (("point", POLICIES[:4]), ("shrunk", POLICIES[4:])) for c in conventions]
    rows = base.select("*", F.inline(F.array(*kinds))).withColumn("est", F.when(F.col("source") == "point", F.col("point")).otherwise(F.col("shrunk")))
    out = with_references(rows, [*keys, "convention", "source"], "est", control=control).withColumn("policy", F.explode("policies")).drop("policies")
    lo, hi = wilson(F.col("k"), F.col("n"))
    ref_lo, ref_hi = wilson(F.col("ref_k"), F.col("ref_n"))
    c = F.col
    reported = F.when(c("policy") == "floor15", c("n") >= 15).when(c("policy") == "floor30", c("n") >= 30).otherwise(c("n") >= 1)
    rows = out.withColumns({"reported": reported, "di_lo": F.when(c("policy") == "wilson", ratio(lo, ref_hi)), "di_hi": F.when(c("policy") == "wilson", ratio(hi, ref_lo)), "di": F.when(reported, ratio(c("est"), c("ref_rate")))})
    w = c("policy") == "wilson"
    no = lambda x: F.coalesce(x, F.lit(False))
    rows = rows.withColumns({"clear": no(c("reported") & F.when(w, c("di_lo") >= 0.8).otherwise(c("di") >= 0.8)), "violate": no(c("reported") & F.when(w, c("di_hi") < 0.8).otherwise(c("di") < 0.8)), "is_sample_ref": no(c("cell") == c("ref_cell"))})
    asserted = F.when(w, c("clear") | c("violate")).otherwise(c("reported")) & ~c("is_sample_ref")
    return rows.select(*keys, "convention", "policy", "cell", "n", "reported", "di", "di_lo", "di_hi", "clear", "violate", "is_sample_ref", asserted.alias("asserted"))


def draw_events(asserted: DataFrame, truth: DataFrame) -> DataFrame:
    """One row for each (m, convention, policy, draw): which errors the audit of this draw makes."""
    c = F.col
    # The truth has one row for each convention and cell.
    rows = asserted.join(F.broadcast(truth), ["convention", "cell"])
    wilson_ = c("policy") == "wilson"
    inverted = c("asserted") & (c("theta") != 1.0) & ((c("di") - 1.0) * (c("theta") - 1.0) < 0)
    rankable = F.when(wilson_, c("violate")).otherwise(c("asserted"))
    some = lambda x: F.coalesce(F.bool_or(x), F.lit(False))
    shown = c("reported") & ~c("is_sample_ref")
    inside = shown & (c("di_lo") <= c("theta")) & (c("theta") <= c("di_hi"))
    return rows.groupBy("m", "convention", "policy", "draw").agg(
        some(inverted).alias("sign_inversion"), some(c("clear") & c("violating")).alias("false_clearance"), some(c("clear") & c("is_worst")).alias("false_clearance_worst"),
        some(c("violate") & ~c("violating") & ~c("is_ref")).alias("false_alarm"), F.min(F.when(rankable, F.struct("di", "cell", "is_worst"))).alias("named"),
        F.count_if(~c("reported")).alias("suppressed"), F.count_if(inside).alias("inside"), F.count_if(shown).alias("shown"), F.count_if(c("reported") & ~(c("clear") | c("violate"))).alias("open"),
    ).select(
        "m", "convention", "policy", "draw", "sign_inversion", "false_clearance", "false_clearance_worst", "false_alarm", F.coalesce(~c("named.is_worst"), F.lit(False)).alias("worst_wrong"), c("named").isNull().alias("worst_abstain"),
        "suppressed", F.when(wilson_, c("inside") / F.greatest(c("shown"), F.lit(1))).alias("coverage"), F.when(wilson_, c("open")).alias("indeterminate"),
    )


EVENTS = ("sign_inversion", "false_clearance", "false_clearance_worst", "false_alarm", "worst_wrong", "worst_abstain")


def study(events: DataFrame) -> DataFrame:
    """Rates of all events by (m, convention, policy), with the Wilson interval of the false clearances."""
    rates = [F.avg(F.col(e).cast("int")).alias(e) for e in EVENTS]
    low, high = wilson(F.count_if("false_clearance"), F.count("*"))
    return events.groupBy("m", "convention", "policy").agg(*rates, low.alias("fc_low"), high.alias("fc_high"), F.avg("suppressed").alias("mean_suppressed"), F.avg("coverage").alias("coverage"), F.avg("indeterminate").alias("mean_indeterminate"))
