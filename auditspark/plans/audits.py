"""Queries: confusion cells, fairness metrics, intersections, intervals, diagnosis."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.functions import scalars as S
from auditspark.operators import audit, diagnose, intervals, proxies
from auditspark.plans import views
from auditspark.plans.views import ORDERS_SQL, PRIVILEGED
from auditspark.sources.workspace import written

ATTRS = list(PRIVILEGED)
QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, rounded: tuple[str, ...] = ()):
    """Registers a query. ``rounded`` columns hold sums of doubles, whose last digits depend on the order of rows."""

    def add(f):
        def run(spark, sf_dir):
            return f(spark, sf_dir).withColumns({c: F.round(c, 8) for c in rounded})

        QUERIES[name] = run if rounded else f
        if sql:
            ORACLE_SQL[name] = f"SELECT * REPLACE ({', '.join(f'round({c}, 8) AS {c}' for c in rounded)}) FROM ({sql})" if rounded else sql
        return f

    return add


LONG_SQL = f"""{ORDERS_SQL},
marked AS (SELECT *, actual = 1 AS y, predicted = 1 AS p FROM audit_orders),
unfolded AS (SELECT 'r_name' AS attribute, r_name AS value, y, p FROM marked UNION ALL SELECT 'seg', seg, y, p FROM marked UNION ALL SELECT 'prio', prio, y, p FROM marked),
long AS (SELECT attribute, value, count(*) AS n, count(*) FILTER (p) AS sel, count(*) FILTER (y) AS pos, count(*) FILTER (y AND p) AS tp, count(*) FILTER (NOT y AND p) AS fp FROM unfolded GROUP BY 1, 2)"""
PRIV_SQL = "priv(attribute, privileged) AS (VALUES ('r_name', 'EUROPE'), ('seg', 'BUILDING'), ('prio', '5-LOW'))"


def _sides(priv: str = PRIV_SQL, keep: str = "TRUE") -> str:
    return f"""WITH {LONG_SQL}, {priv},
sides AS (SELECT attribute, privileged, {', '.join(f"CAST(coalesce(sum({c}) FILTER ({'' if t == 'p' else 'NOT '}(value IS NOT DISTINCT FROM privileged)), 0) AS DOUBLE) AS {t}_{c}" for t in 'pu' for c in audit.COUNTS)}
          FROM long JOIN priv USING (attribute) WHERE {keep} GROUP BY 1, 2),
r AS (SELECT *, p_sel / nullif(p_n, 0) AS ps, u_sel / nullif(u_n, 0) AS us, p_pos / nullif(p_n, 0) AS pb, u_pos / nullif(u_n, 0) AS ub, p_tp / nullif(p_pos, 0) AS pt, u_tp / nullif(u_pos, 0) AS ut,
             p_fp / nullif(p_n - p_pos, 0) AS pf, u_fp / nullif(u_n - u_pos, 0) AS uf, (p_sel + u_sel) / (p_n + u_n) AS b FROM sides)"""


_THEIL = "CASE WHEN b > 0 AND b < 1 THEN (1 / b) * ln(1 / b) ELSE 0.0 END AS theil"
_SEVERITY = "CASE WHEN di IS NULL THEN 'UNKNOWN' WHEN di < 0.7200000000000001 THEN 'CRITICAL' WHEN di < 0.8 THEN 'HIGH' WHEN di < 0.95 THEN 'MODERATE (borderline)' ELSE 'LOW (fair)' END"
METRICS_SQL = "attribute, privileged, us / nullif(ps, 0) AS di, us - ps AS dpd, ut - pt AS eod, ((uf - pf) + (ut - pt)) / 2 AS aod, " + _THEIL


def _flagged(body: str) -> str:
    return f"SELECT *, coalesce(di < 0.8, FALSE) AS bias_flag, {_SEVERITY.replace('0.7200000000000001', '0.8 * 0.9::DOUBLE')} AS severity FROM ({body})"


@query("a01_confusion_cells", f"WITH {ORDERS_SQL} SELECT n_name, seg, prio, count(*) AS n, count(*) FILTER (predicted = 1) AS sel, count(*) FILTER (actual = 1) AS pos, count(*) FILTER (actual = 1 AND predicted = 1) AS tp, count(*) FILTER (actual <> 1 AND predicted = 1) AS fp FROM audit_orders GROUP BY 1, 2, 3")
def a01(spark, sf_dir) -> DataFrame:
    return audit.confusion_cells(views.orders(spark, sf_dir), ["n_name", "seg", "prio"])


@query("a01_grouping_sets", f"WITH {LONG_SQL} SELECT * FROM long")
def a01_sets(spark, sf_dir) -> DataFrame:
    return _long(spark, sf_dir)


def _long(spark, sf_dir, favorable: int = 1) -> DataFrame:
    return audit.grouped_cells(audit.confusion_cells(views.orders(spark, sf_dir), ATTRS, favorable), ATTRS)


@query("a07_attribute_metrics", _flagged(f"{_sides()} SELECT {METRICS_SQL} FROM r"))
def a07(spark, sf_dir) -> DataFrame:
    return audit.attribute_metrics(views.orders(spark, sf_dir), PRIVILEGED)


def _metric(name: str, columns: list[str]):
    def run(spark, sf_dir) -> DataFrame:
        return audit.attribute_metrics(views.orders(spark, sf_dir), PRIVILEGED).select("attribute", *columns)

    query(name, f"SELECT attribute, {', '.join(columns)} FROM ({_flagged(f'{_sides()} SELECT {METRICS_SQL} FROM r')})")(run)


for _name, _cols in (("a02_disparate_impact", ["di"]), ("a03_parity_difference", ["dpd"]), ("a04_equal_opportunity", ["eod"]), ("a05_average_odds", ["aod"]), ("x01_severity", ["di", "severity"])):
    _metric(_name, _cols)


@query("a06_theil_modes", f"WITH {LONG_SQL}, t AS (SELECT attribute, sum(sel) / CAST(sum(n) AS DOUBLE) AS b FROM long GROUP BY 1) SELECT attribute, {_THEIL}, CASE WHEN b > 0 AND b < 1 THEN ln(1 / b) ELSE 0.0 END AS theil_all FROM t")
def a06(spark, sf_dir) -> DataFrame:
    t = _long(spark, sf_dir).groupBy("attribute").agg(F.sum("sel").alias("sel"), F.sum("n").alias("n"))
    return t.select("attribute", audit.theil(F.col("sel"), F.col("n")).alias("theil"), audit.theil(F.col("sel"), F.col("n"), "all").alias("theil_all"))


@query("a07_null_group_excluded", _flagged(f"{_sides(keep='value IS NOT NULL')} SELECT {METRICS_SQL} FROM r"))
def a07_excluded(spark, sf_dir) -> DataFrame:
    return audit.attribute_metrics(views.orders(spark, sf_dir), PRIVILEGED, null_group="exclude")


_MAJORITY = "priv AS (SELECT attribute, first(value ORDER BY n DESC, value) AS privileged FROM long WHERE value IS NOT NULL GROUP BY 1)"


@query("a08_majority_privileged", f"{_sides(_MAJORITY)} SELECT {METRICS_SQL} FROM r")
def a08(spark, sf_dir) -> DataFrame:
    long = _long(spark, sf_dir)
    return audit.pair_metrics(audit.two_groups(long, audit.majority_groups(long))).select("attribute", "privileged", "di", "dpd", "eod", "aod", "theil")


@query("a09_label_level", f"{_sides()} SELECT attribute, ub / nullif(pb, 0) AS di, ub - pb AS mean_difference FROM r")
def a09(spark, sf_dir) -> DataFrame:
    return audit.attribute_metrics(views.orders(spark, sf_dir), PRIVILEGED, outcome="actual").select("attribute", "di", F.col("dpd").alias("mean_difference"))


@query("a10_inverse_orientation", f"{_sides()} SELECT attribute, ps / nullif(us, 0) AS di, ps - us AS dpd, pt - ut AS eod, ((pf - uf) + (pt - ut)) / 2 AS aod FROM r")
def a10(spark, sf_dir) -> DataFrame:
    return audit.attribute_metrics(views.orders(spark, sf_dir), PRIVILEGED, orientation="priv_over_unpriv").select("attribute", "di", "dpd", "eod", "aod")


@query("a11_parity_ratio", f"WITH {LONG_SQL} SELECT attribute, min(sel / CAST(n AS DOUBLE)) / nullif(max(sel / CAST(n AS DOUBLE)), 0) AS parity_ratio FROM long WHERE value IS NOT NULL GROUP BY 1")
def a11(spark, sf_dir) -> DataFrame:
    return audit.parity_ratio(_long(spark, sf_dir))


_RATES = "pos / CAST(n AS DOUBLE) AS base_rate, sel / CAST(n AS DOUBLE) AS selection_rate, tp / CAST(nullif(pos, 0) AS DOUBLE) AS tpr, fp / CAST(nullif(n - pos, 0) AS DOUBLE) AS fpr"
_BREAKDOWN = f"SELECT attribute, value AS \"group\", n, 100.0 * n / sum(n) OVER (PARTITION BY attribute) AS pct_of_total, {_RATES} FROM long"


@query("a12_group_breakdown", f"WITH {LONG_SQL} {_BREAKDOWN}")
def a12(spark, sf_dir) -> DataFrame:
    return audit.breakdown(views.orders(spark, sf_dir), ATTRS)


@query("a13_group_rates", f"WITH {LONG_SQL} SELECT attribute, value, sel / CAST(n AS DOUBLE) AS selection_rate, tp / CAST(nullif(pos, 0) AS DOUBLE) AS tpr, fp / CAST(nullif(n - pos, 0) AS DOUBLE) AS fpr FROM long WHERE value IS NOT NULL")
def a13(spark, sf_dir) -> DataFrame:
    return audit.rates(_long(spark, sf_dir).where("value IS NOT NULL")).select("attribute", "value", "selection_rate", "tpr", "fpr")


@query("a14_selection_rates", f"WITH {LONG_SQL} SELECT attribute, value, sel / CAST(n AS DOUBLE) AS selection_rate FROM long")
def a14(spark, sf_dir) -> DataFrame:
    return audit.rates(_long(spark, sf_dir)).select("attribute", "value", "selection_rate")


@query("a19_overall_rates", f"WITH {ORDERS_SQL} SELECT avg(actual) AS target_rate, avg(predicted) AS selection_rate, greatest(avg(actual), 1 - avg(actual)) AS majority_rate FROM audit_orders")
def a19(spark, sf_dir) -> DataFrame:
    return audit.overall_rates(views.orders(spark, sf_dir))


CELLS_SQL = f"""{ORDERS_SQL}, raw AS (SELECT coalesce(n_name, 'null') || ' x ' || coalesce(seg, 'null') || ' x ' || coalesce(prio, 'null') AS cell, count(*) AS n, count(*) FILTER (predicted = 1) AS k FROM audit_orders {{keep}} GROUP BY 1),
cells AS (SELECT *, k / CAST(n AS DOUBLE) AS rate, n < 30 AS below_floor, max(k / CAST(n AS DOUBLE)) FILTER (n >= 30) OVER () AS best_sized, max(k / CAST(n AS DOUBLE)) OVER () AS best FROM raw),
tab AS (SELECT cell, n, k, rate, below_floor, best_sized, rate / nullif(coalesce(best_sized, best), 0) AS di_vs_best, rate / nullif(best_sized, 0) AS di_vs_sized FROM cells)"""
CELL_ATTRS = ["n_name", "seg", "prio"]


@query("a24_intersections", f"WITH {CELLS_SQL.format(keep='')} SELECT cell, n, k, rate, below_floor, di_vs_best FROM tab")
def a24(spark, sf_dir) -> DataFrame:
    return audit.cell_table(views.orders(spark, sf_dir), CELL_ATTRS, floor=30, keep_null=True).select("cell", "n", "k", "rate", "below_floor", "di_vs_best")


@query("a25_cells_without_nulls", f"WITH {CELLS_SQL.format(keep='WHERE seg IS NOT NULL')} SELECT cell, n, k, rate, below_floor, di_vs_sized FROM tab")
def a25(spark, sf_dir) -> DataFrame:
    return audit.cell_table(views.orders(spark, sf_dir), CELL_ATTRS, floor=30).select("cell", "n", "k", "rate", "below_floor", "di_vs_sized")


_SUMMARY = """SELECT count(*) AS cells, count(*) FILTER (below_floor) AS suppressed, first(cell ORDER BY di_vs_sized, cell) FILTER (NOT below_floor) AS worst_visible, min(di_vs_sized) FILTER (NOT below_floor) AS worst_visible_di,
first(cell ORDER BY di_vs_sized, cell) AS worst_actual, min(di_vs_sized) AS worst_actual_di, count(*) FILTER (below_floor AND di_vs_sized < lv) AS suppressed_worse FROM (SELECT *, min(di_vs_sized) FILTER (NOT below_floor) OVER () AS lv FROM tab)"""


@query("a26_population_summary", f"WITH {CELLS_SQL.format(keep='WHERE seg IS NOT NULL')} {_SUMMARY}")
def a26(spark, sf_dir) -> DataFrame:
    return audit.cell_summary(audit.cell_table(views.orders(spark, sf_dir), CELL_ATTRS, floor=30))


_POP = f"""WITH {ORDERS_SQL}, tagged AS (SELECT 'all' AS population, * FROM audit_orders UNION ALL SELECT 'split', * FROM audit_orders WHERE record_id % 5 = 0),
raw AS (SELECT population, n_name || ' x ' || prio AS cell, count(*) AS n, count(*) FILTER (predicted = 1) AS k FROM tagged GROUP BY 1, 2),
c AS (SELECT *, k / CAST(n AS DOUBLE) AS rate, max(k / CAST(n AS DOUBLE)) FILTER (n >= 15) OVER (PARTITION BY population) AS best FROM raw),
tab AS (SELECT population, cell, n, n < 15 AS below_floor, rate / nullif(best, 0) AS di_vs_sized FROM c)
SELECT population, count(*) AS cells, count(*) FILTER (below_floor) AS suppressed, first(cell ORDER BY di_vs_sized, cell) FILTER (NOT below_floor) AS worst_visible, min(di_vs_sized) FILTER (NOT below_floor) AS worst_visible_di,
first(cell ORDER BY di_vs_sized, cell) AS worst_actual, min(di_vs_sized) AS worst_actual_di, count(*) FILTER (below_floor AND di_vs_sized < lv) AS suppressed_worse
FROM (SELECT *, min(di_vs_sized) FILTER (NOT below_floor) OVER (PARTITION BY population) AS lv FROM tab) GROUP BY 1"""


@query("a27_population_against_split", _POP)
def a27(spark, sf_dir) -> DataFrame:
    tags = F.array_compact(F.array(F.lit("all"), F.when(F.col("record_id") % 5 == 0, "split")))
    rows = views.orders(spark, sf_dir).withColumn("population", F.explode(tags))
    return audit.cell_summary(audit.cell_table(rows, ["n_name", "prio"], by=["population"]), ["population"])


@query("a31_attribute_summary", f"WITH {CELLS_SQL.format(keep='')} SELECT cell, n, rate, di_vs_best, below_floor, CASE WHEN di_vs_best IS NULL THEN 'UNKNOWN' WHEN di_vs_best < 0.72 THEN 'CRITICAL' WHEN di_vs_best < 0.8 THEN 'HIGH' WHEN di_vs_best < 0.95 THEN 'MODERATE' ELSE 'LOW' END AS band FROM tab")
def a31(spark, sf_dir) -> DataFrame:
    return audit.attribute_severities(audit.cell_table(views.orders(spark, sf_dir), CELL_ATTRS, floor=30, keep_null=True))


QUERIES["x02_fixed_band"], ORACLE_SQL["x02_fixed_band"] = a31, ORACLE_SQL["a31_attribute_summary"]
QUERIES["w01_best_sized"], ORACLE_SQL["w01_best_sized"] = a24, ORACLE_SQL["a24_intersections"]


@query("w02_share_of_total", f"WITH {ORDERS_SQL} SELECT n_name, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS pct FROM audit_orders GROUP BY 1")
def w02(spark, sf_dir) -> DataFrame:
    return value_counts(views.orders(spark, sf_dir), "n_name")


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """Counts and percentages of a column's values."""
    counts = df.groupBy(column).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select(column, "n", (100.0 * F.col("n") / F.col("total")).alias("pct"))


@query("a15_value_counts", "SELECT l_returnflag, count(*) AS n, 100.0 * count(*) / sum(count(*)) OVER () AS pct FROM lineitem GROUP BY 1")
def a15(spark, sf_dir) -> DataFrame:
    return value_counts(spark.read.parquet(f"{sf_dir}/lineitem.parquet"), "l_returnflag")


@query("w08_extremes", f"WITH {CELLS_SQL.format(keep='WHERE seg IS NOT NULL')} SELECT first(cell ORDER BY rate, cell) AS worst, min(rate) AS worst_rate, first(cell ORDER BY rate DESC, cell DESC) AS best, max(rate) AS best_rate, max(rate) - min(rate) AS gap FROM tab WHERE NOT below_floor")
def w08(spark, sf_dir) -> DataFrame:
    return audit.extremes(audit.cell_table(views.orders(spark, sf_dir), CELL_ATTRS, floor=30))


@query("f05_floor_filter", f"WITH {CELLS_SQL.format(keep='')} SELECT cell, n, rate FROM tab WHERE n >= 30")
def f05(spark, sf_dir) -> DataFrame:
    return audit.cell_table(views.orders(spark, sf_dir), CELL_ATTRS, floor=30, keep_null=True).where("NOT below_floor").select("cell", "n", "rate")


@query("k04_cells_sorted", f"WITH {CELLS_SQL.format(keep='')} SELECT cell, rate, row_number() OVER (ORDER BY rate, cell) AS place FROM tab ORDER BY place LIMIT 50")
def k04(spark, sf_dir) -> DataFrame:
    """The 50 cells with the lowest rates (a top-k report)."""
    from pyspark.sql import Window

    cells = audit.cell_table(views.orders(spark, sf_dir), CELL_ATTRS, floor=30, keep_null=True)
    low = cells.orderBy("rate", "cell").limit(50)
    return low.select("cell", "rate", F.row_number().over(Window.orderBy("rate", "cell")).alias("place"))


_ORIENT = f"""WITH {ORDERS_SQL}, u AS (SELECT favorable, r_name = 'EUROPE' AS priv, count(*) FILTER (predicted = favorable) / CAST(count(*) AS DOUBLE) AS s,
 count(*) FILTER (predicted = favorable AND actual = favorable) / CAST(nullif(count(*) FILTER (actual = favorable), 0) AS DOUBLE) AS t FROM audit_orders, (VALUES (0), (1)) f(favorable) GROUP BY 1, 2)
SELECT favorable, 'r_name' AS attribute, b.s / a.s AS di, b.s - a.s AS dpd, b.t - a.t AS eod FROM (SELECT * FROM u WHERE priv) a JOIN (SELECT * FROM u WHERE NOT priv) b USING (favorable)"""


@query("p25_label_orientation", _ORIENT)
def p25(spark, sf_dir) -> DataFrame:
    return audit.orientations(views.orders(spark, sf_dir), ["r_name"], {"r_name": "EUROPE"}).select("favorable", "attribute", "di", "dpd", "eod")


# Intervals


def _wilson(k: str, n: str) -> tuple[str, str]:
    p, m = f"({k} / CAST({n} AS DOUBLE))", f"CAST({n} AS DOUBLE)"
    low = f"(1 + 3.8416 / {m})"
    centre, half = f"(({p} + 3.8416 / (2 * {m})) / {low})", f"(1.96 * sqrt({p} * (1 - {p}) / {m} + 3.8416 / (4 * {m} * {m})) / {low})"
    return f"greatest(0.0, least(1.0, round({centre} - {half}, 12)))", f"greatest(0.0, least(1.0, round({centre} + {half}, 12)))"


_LO, _HI = _wilson("k", "n")
_BOUNDS = f"raw AS (SELECT n_name || ' x ' || prio AS cell, count(*) AS n, count(*) FILTER (predicted = 1) AS k FROM audit_orders GROUP BY 1), w AS (SELECT *, k / CAST(n AS DOUBLE) AS rate, {_LO} AS lo, {_HI} AS hi FROM raw)"


def _pair_cells(spark, sf_dir) -> DataFrame:
    return audit.cell_table(views.orders(spark, sf_dir), ["n_name", "prio"]).select("cell", "n", "k", "rate")


@query("x04_wilson", f"WITH {ORDERS_SQL}, {_BOUNDS} SELECT cell, n, k, lo, hi FROM w")
def x04(spark, sf_dir) -> DataFrame:
    lo, hi = S.wilson(F.col("k"), F.col("n"))
    return _pair_cells(spark, sf_dir).select("cell", "n", "k", lo.alias("lo"), hi.alias("hi"))


_REF = {
    "max_rate": "n >= 1",
    "max_rate_floor15": "n >= 60",
    "control": "cell = 'NATION_7 x 5-LOW'",
}


def _interval_sql(eligible: str) -> str:
    return f"""WITH {ORDERS_SQL}, {_BOUNDS}, ref AS (SELECT cell AS ref_cell, rate AS ref_rate, lo AS ref_lo, hi AS ref_hi FROM w WHERE {eligible} ORDER BY rate DESC, cell LIMIT 1),
d AS (SELECT cell, n, ref_cell, rate / nullif(ref_rate, 0) AS di, lo / nullif(ref_hi, 0) AS di_ci_low, hi / nullif(ref_lo, 0) AS di_ci_high FROM w, ref)
SELECT cell, ref_cell, di, di_ci_low, di_ci_high, coalesce(di_ci_high < 0.72 OR di_ci_low >= 0.8 OR (di_ci_low >= 0.72 AND di_ci_high < 0.8), FALSE) AS band_determinate,
coalesce(di_ci_low < 0.8 AND di_ci_high >= 0.8, FALSE) AS spans_four_fifths, n < 60 AS below_floor,
coalesce((di_ci_high < 0.72 OR di_ci_low >= 0.8 OR (di_ci_low >= 0.72 AND di_ci_high < 0.8)) AND round(di_ci_high, 4) < 1.0, FALSE) AS defensible FROM d"""


def _intervals(convention: str):
    def run(spark, sf_dir) -> DataFrame:
        cells = intervals.with_reference(_pair_cells(spark, sf_dir), convention, floor=60, control="NATION_7 x 5-LOW", strict=True)
        return intervals.di_intervals(cells, floor=60).select("cell", "ref_cell", "di", "di_ci_low", "di_ci_high", "band_determinate", "spans_four_fifths", "below_floor", "defensible")

    return run


for _convention, _eligible in _REF.items():
    query(f"x05_di_interval_{_convention}", _interval_sql(_eligible))(_intervals(_convention))
QUERIES["j09_reference_cell"], ORACLE_SQL["j09_reference_cell"] = QUERIES["x05_di_interval_control"], ORACLE_SQL["x05_di_interval_control"]
QUERIES["x06_determinacy"], ORACLE_SQL["x06_determinacy"] = QUERIES["x05_di_interval_max_rate"], ORACLE_SQL["x05_di_interval_max_rate"]


@query("w03_reference_conventions", " UNION ALL ".join(f"(WITH {ORDERS_SQL}, {_BOUNDS} SELECT '{c}' AS convention, cell AS ref_cell, rate AS ref_rate FROM w WHERE {e} ORDER BY rate DESC, cell LIMIT 1)" for c, e in _REF.items()))
def w03(spark, sf_dir) -> DataFrame:
    cells, out = _pair_cells(spark, sf_dir), None
    for c in intervals.CONVENTIONS:
        referred = intervals.with_reference(cells, c, floor=60, control="NATION_7 x 5-LOW", strict=True).where("ref_cell IS NOT NULL")
        one = referred.select(F.lit(c).alias("convention"), "ref_cell", "ref_rate").distinct()
        out = one if out is None else out.unionByName(one)
    return out


@query("x07_rate_interval", f"WITH {ORDERS_SQL}, raw AS (SELECT r_name, count(*) AS n, count(*) FILTER (predicted = 1) AS k FROM audit_orders GROUP BY 1) SELECT r_name, k / CAST(n AS DOUBLE) AS rate, {_LO} AS ci_low, {_HI} AS ci_high FROM raw")
def x07(spark, sf_dir) -> DataFrame:
    cells = audit.confusion_cells(views.orders(spark, sf_dir), ["r_name"])
    lo, hi = S.wilson(F.col("sel"), F.col("n"))
    return cells.select("r_name", S.ratio(F.col("sel"), F.col("n")).alias("rate"), lo.alias("ci_low"), hi.alias("ci_high"))


@query("x08_shrinkage", f"""WITH {ORDERS_SQL}, raw AS (SELECT r_name, n_name || ' x ' || prio AS cell, count(*) AS n, count(*) FILTER (predicted = 1) AS k FROM audit_orders GROUP BY 1, 2),
t AS (SELECT r_name, sum(k) / CAST(sum(n) AS DOUBLE) AS pooled, CAST(sum(n) AS DOUBLE) AS total, count(*) AS c, sum(CAST(n AS DOUBLE) * n) AS sq FROM raw GROUP BY 1),
s AS (SELECT r_name, sum(n * pow(k / CAST(n AS DOUBLE) - pooled, 2)) AS s FROM raw JOIN t USING (r_name) GROUP BY 1),
rho AS (SELECT r_name, pooled, greatest(1e-4, least(0.99, coalesce((s - pooled * (1 - pooled) * (c - 1)) / nullif(pooled * (1 - pooled) * (total - sq / total), 0), 1e-4))) AS rho FROM t JOIN s USING (r_name))
SELECT cell, pooled, (k + pooled * (1 - rho) / rho) / (n + (1 - rho) / rho) AS shrunk FROM raw JOIN rho USING (r_name)""", rounded=("pooled", "shrunk"))
def x08(spark, sf_dir) -> DataFrame:
    cells = audit.confusion_cells(views.orders(spark, sf_dir), ["r_name", "n_name", "prio"]).select("r_name", F.concat_ws(" x ", "n_name", "prio").alias("cell"), "n", F.col("sel").alias("k"))
    return intervals.eb_shrunk(cells, ["r_name"]).select("cell", "pooled", "shrunk")


# Diagnosis

_IMB = f"""WITH {LONG_SQL}, b AS ({_BREAKDOWN}), i AS (SELECT attribute, first("group" ORDER BY n DESC, "group" DESC NULLS LAST) AS largest, first("group" ORDER BY n, "group" NULLS FIRST) AS smallest, max(n) / CAST(min(n) AS DOUBLE) AS size_ratio,
coalesce(string_agg(coalesce("group", 'null'), ', ' ORDER BY coalesce("group", 'null')) FILTER (n < 30), '') AS small_groups, CASE WHEN count(base_rate) >= 2 THEN max(base_rate) - min(base_rate) END AS base_rate_gap FROM b GROUP BY 1),
imb AS (SELECT attribute, largest, smallest, size_ratio, CASE WHEN size_ratio > 10 THEN 'severe' WHEN size_ratio > 3 THEN 'moderate' END AS imbalance, small_groups, base_rate_gap, coalesce(base_rate_gap > 0.15, FALSE) AS base_rate_disparity FROM i)"""


def _breakdown(spark, sf_dir) -> DataFrame:
    return audit.breakdown(views.orders(spark, sf_dir), ATTRS)


@query("d01_imbalance", f"{_IMB} SELECT * FROM imb")
def d01(spark, sf_dir) -> DataFrame:
    return diagnose.imbalance(_breakdown(spark, sf_dir))


@query("d01_findings", f"{_IMB} SELECT attribute, imbalance || ' size imbalance' AS finding FROM imb WHERE imbalance IS NOT NULL UNION ALL SELECT attribute, 'small groups' FROM imb WHERE small_groups <> '' UNION ALL SELECT attribute, 'base-rate disparity' FROM imb WHERE base_rate_disparity")
def d01_findings(spark, sf_dir) -> DataFrame:
    return diagnose.findings(diagnose.imbalance(_breakdown(spark, sf_dir)))


_FEATURES = ("score", "price", "balance")
_PROXIES = f"""l AS (SELECT * FROM (SELECT attribute, unnest([{', '.join(repr(f) for f in _FEATURES)}]) AS feature, value, unnest([{', '.join(f'{f}::DOUBLE' for f in _FEATURES)}]) AS x FROM (SELECT *, unnest(['r_name', 'seg', 'prio']) AS attribute, unnest([r_name, seg, prio]) AS value FROM audit_orders)) WHERE value IS NOT NULL AND x IS NOT NULL),
v AS (SELECT attribute, feature, value, count(*) AS n, avg(x) AS mean, var_pop(x) AS var FROM l GROUP BY 1, 2, 3), w AS (SELECT *, sum(n * mean) OVER (PARTITION BY attribute, feature) / sum(n) OVER (PARTITION BY attribute, feature) AS grand FROM v),
o AS (SELECT attribute, feature, sqrt(sum(n * pow(mean - grand, 2)) / sum(n * var + n * pow(mean - grand, 2))) AS r FROM w GROUP BY 1, 2 HAVING sum(n) >= 10 AND count(*) >= 2)
SELECT DISTINCT attribute FROM o WHERE r >= 0.3"""
_CAUSES = f"""proxied AS (WITH {ORDERS_SQL}, {_PROXIES}), m AS ({_flagged(f'{_sides()} SELECT {METRICS_SQL} FROM r')}), i AS ({_IMB} SELECT * FROM imb),
x AS (SELECT attribute, di, severity, coalesce(di, 1.0) AS d, [CASE WHEN base_rate_gap > 0.10 THEN 'historical_label_bias' END, CASE WHEN attribute IN (SELECT attribute FROM proxied) THEN 'proxy_discrimination' END,
 CASE WHEN imbalance = 'severe' OR small_groups <> '' THEN 'representation_bias' END, CASE WHEN abs(coalesce(eod, 0)) > 0.05 THEN 'unequal_opportunity' END, CASE WHEN abs(coalesce(aod, 0)) > 0.05 THEN 'unequal_odds' END] AS c FROM m JOIN i USING (attribute)),
y AS (SELECT attribute, di, severity, d, list_filter(c, lambda v: v IS NOT NULL) AS c FROM x),
causes AS (SELECT attribute, di, severity, CASE WHEN len(c) = 0 AND d >= 0.95 THEN ['none_detected'] ELSE c END AS causes,
 CASE WHEN len(c) > 0 THEN list_transform(c, lambda v: CASE v WHEN 'historical_label_bias' THEN 'Reweighing' WHEN 'proxy_discrimination' THEN 'DisparateImpactRemover' WHEN 'representation_bias' THEN 'Data collection' WHEN 'unequal_opportunity' THEN 'PrejudiceRemover' ELSE 'EqOddsPostprocessing' END)
 WHEN d < 0.8 THEN ['AdversarialDebiasing'] WHEN d < 0.95 THEN ['CalibratedEqOddsPostprocessing'] ELSE ['Continue monitoring'] END AS remedies FROM y)"""


def _causes(spark, sf_dir) -> DataFrame:
    rows = views.orders(spark, sf_dir)
    cells = written(audit.confusion_cells(rows, ATTRS), "cells")
    found = written(proxies.proxies(proxies.associations(rows, ATTRS, _FEATURES)), "proxies")
    return diagnose.root_causes(audit.cell_metrics(cells, PRIVILEGED), diagnose.imbalance(audit.cell_breakdown(cells, ATTRS)), found)


@query("d02_root_causes", f"WITH {_CAUSES} SELECT attribute, di, severity, array_to_string(causes, ',') AS causes, array_to_string(remedies, ',') AS remedies FROM causes")
def d02(spark, sf_dir) -> DataFrame:
    return _causes(spark, sf_dir).select("attribute", "di", "severity", F.array_join("causes", ",").alias("causes"), F.array_join("remedies", ",").alias("remedies"))


@query("d03_remedies", f"WITH {_CAUSES} SELECT attribute, unnest(remedies) AS remedy FROM causes")
def d03(spark, sf_dir) -> DataFrame:
    return _causes(spark, sf_dir).select("attribute", F.explode("remedies").alias("remedy"))


@query("d04_group_statements", f"WITH {LONG_SQL}, b AS ({_BREAKDOWN}), s AS (SELECT attribute, first(\"group\" ORDER BY selection_rate DESC, \"group\" DESC) AS highest, first(\"group\" ORDER BY selection_rate, \"group\") AS lowest, max(selection_rate) - min(selection_rate) AS gap FROM b WHERE \"group\" IS NOT NULL GROUP BY 1) SELECT attribute, highest, lowest, gap, CASE WHEN gap > 0.1 THEN 'large' WHEN gap > 0.02 THEN 'small' ELSE 'no' END AS gap_word FROM s")
def d04(spark, sf_dir) -> DataFrame:
    return diagnose.statements(_breakdown(spark, sf_dir))


@query("d05_summary", f"WITH {_CAUSES} SELECT attribute, di, severity, substr(causes[1], 1, 80) AS top_cause FROM causes")
def d05(spark, sf_dir) -> DataFrame:
    return diagnose.summary(_causes(spark, sf_dir))


@query("d06_baseline_rows", f"WITH {_CAUSES} SELECT attribute, severity, array_to_string(list_sort(causes), ',') AS cause_labels, len(causes) AS n_causes, len(remedies) AS n_remedies FROM causes")
def d06(spark, sf_dir) -> DataFrame:
    return _causes(spark, sf_dir).select("attribute", "severity", F.array_join(F.array_sort("causes"), ",").alias("cause_labels"), F.size("causes").cast("long").alias("n_causes"), F.size("remedies").cast("long").alias("n_remedies"))
