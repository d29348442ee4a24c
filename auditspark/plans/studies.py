"""Queries: data quality, proxies, splits, models, resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditspark.operators import audit, fits, forest, models, proxies, quality, resample, running, split
from auditspark.plans import views
from auditspark.plans.audits import _wilson
from auditspark.plans.views import DOCUMENTS_SQL, ORDERS_SQL
from auditspark.sources.workspace import written

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, rounded: tuple[str, ...] = (), digits: int = 6):
    """Registers a query. ``rounded`` columns hold sums of doubles, whose last digits depend on the order of rows."""

    def add(f):
        def run(spark, sf_dir):
            return f(spark, sf_dir).withColumns({c: F.round(c, digits) for c in rounded})

        QUERIES[name] = run if rounded else f
        if sql:
            ORACLE_SQL[name] = f"SELECT * REPLACE ({', '.join(f'round({c}, {digits}) AS {c}' for c in rounded)}) FROM ({sql})" if rounded else sql
        return f

    return add


def _t(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Data quality

_HOLES = "SELECT c_custkey, nullif(c_mktsegment, 'FURNITURE') AS seg, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS bal, CASE WHEN c_acctbal < 3000 THEN c_name END AS name, CASE WHEN c_acctbal < 3000 THEN 1 ELSE 0 END AS low FROM customer"


def _holes(spark, sf_dir) -> DataFrame:
    b = F.col("c_acctbal")
    return _t(spark, sf_dir, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("FURNITURE")).alias("seg"), F.when(b >= 0, b).alias("bal"), F.when(b < 3000, F.col("c_name")).alias("name"), F.when(b < 3000, 1).otherwise(0).alias("low"))


_MISSING = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER ({c} IS NULL) AS n_missing, 100.0 * count(*) FILTER ({c} IS NULL) / count(*) AS pct_missing FROM h" for c in ("c_custkey", "seg", "bal", "name", "low"))


@query("a16_missingness", f"WITH h AS ({_HOLES}) {_MISSING}")
def a16(spark, sf_dir) -> DataFrame:
    return quality.missingness(_holes(spark, sf_dir))


@query("k01_top_missing", f"WITH h AS ({_HOLES}) SELECT * FROM ({_MISSING}) ORDER BY pct_missing DESC, \"column\" LIMIT 3")
def k01(spark, sf_dir) -> DataFrame:
    """The three columns with most nulls (a top-k report)."""
    return quality.top_missing(a16(spark, sf_dir), 3)


@query("a17_missing_by_outcome", f"WITH h AS ({_HOLES}), s AS (SELECT low, avg((seg IS NULL)::INT) AS seg, avg((bal IS NULL)::INT) AS bal, avg((name IS NULL)::INT) AS name FROM h GROUP BY 1), u AS (SELECT 'seg' AS \"column\", seg AS v FROM s UNION ALL SELECT 'bal', bal FROM s UNION ALL SELECT 'name', name FROM s) SELECT \"column\", min(v) AS least, max(v) AS most, max(v) >= 0.99 AND min(v) < 0.5 AS leak FROM u GROUP BY 1")
def a17(spark, sf_dir) -> DataFrame:
    return quality.missing_by_outcome(_holes(spark, sf_dir), ["seg", "bal", "name"], "low")


@query("a18_numeric_summary", "SELECT 'l_quantity' AS \"column\", min(l_quantity)::DOUBLE AS minimum, median(l_quantity)::DOUBLE AS median, max(l_quantity)::DOUBLE AS maximum FROM lineitem UNION ALL SELECT 'l_extendedprice', min(l_extendedprice), median(l_extendedprice), max(l_extendedprice) FROM lineitem")
def a18(spark, sf_dir) -> DataFrame:
    return quality.numeric_summary(_t(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice"])


_CATEGORIES = "SELECT 'o_orderpriority' AS \"column\", o_orderpriority AS value, count(*) AS n FROM orders GROUP BY 2 UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY 2 UNION ALL SELECT 'o_custkey', o_custkey::VARCHAR, count(*) FROM orders GROUP BY 2"


@query("a18_category_counts", f"SELECT \"column\", value, n, (row_number() OVER (PARTITION BY \"column\" ORDER BY value))::INT AS by_value, (row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value))::INT AS by_count, row_number() OVER (PARTITION BY \"column\" ORDER BY n DESC, value) <= 5 AS in_top FROM ({_CATEGORIES})")
def a18_categories(spark, sf_dir) -> DataFrame:
    """Counts of categories in the order of their values and of their counts, the five commonest marked."""
    return quality.category_counts(_t(spark, sf_dir, "orders"), ["o_orderpriority", "o_orderstatus", "o_custkey"])


@query("u04_ordered_distinct", "SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY first, role))::INT AS place, role FROM (SELECT conv_id, role, min(turn) AS first FROM conversations GROUP BY 1, 2)")
def u04_ordered(spark, sf_dir) -> DataFrame:
    """The roles of a conversation in the order in which they first speak."""
    return quality.ordered_distinct(_t(spark, sf_dir, "conversations"), ["conv_id"], "role", "turn")


_SPLIT = """cnt AS (SELECT actual, count(*) AS c FROM audit_orders GROUP BY 1),
parted AS (SELECT o.*, CASE WHEN row_number() OVER (PARTITION BY o.actual ORDER BY md5(concat_ws('|', CAST(record_id AS VARCHAR), '42')), record_id) <= floor(0.2::DOUBLE * c) THEN 'test' ELSE 'train' END AS split FROM audit_orders o JOIN cnt USING (actual))"""


def _parted(spark, sf_dir) -> DataFrame:
    return split.quota_split(views.orders(spark, sf_dir), 0.2, ["actual"])


@query("a20_split_report", f"WITH {ORDERS_SQL}, {_SPLIT} SELECT split, count(*) AS rows, avg(actual) AS positive_rate FROM parted GROUP BY 1")
def a20(spark, sf_dir) -> DataFrame:
    return quality.split_report(_parted(spark, sf_dir), "split", "actual")


_ATTRITION = f"""WITH {ORDERS_SQL}, f AS (SELECT CASE WHEN NOT coalesce(r_name IN ('ASIA', 'EUROPE', 'AMERICA'), FALSE) THEN 1 WHEN seg IS NULL THEN 2 WHEN NOT price > 50000 THEN 3 ELSE 4 END AS number,
 CASE WHEN NOT coalesce(r_name IN ('ASIA', 'EUROPE', 'AMERICA'), FALSE) THEN r_name WHEN seg IS NULL THEN 'null' WHEN NOT price > 50000 THEN prio END AS category FROM audit_orders),
g AS (SELECT number, category, count(*) AS dropped FROM f GROUP BY 1, 2)
SELECT number, ['region', 'segment', 'price'][number] AS step, category, dropped, (SELECT sum(dropped) FROM g) - (SELECT sum(dropped) FROM g h WHERE h.number <= g.number) AS remaining FROM g WHERE number <= 3"""


@query("a28_attrition", _ATTRITION)
def a28(spark, sf_dir) -> DataFrame:
    rules = [("region", F.col("r_name").isin("ASIA", "EUROPE", "AMERICA"), F.col("r_name")), ("segment", F.col("seg").isNotNull(), F.col("seg")), ("price", F.col("price") > 50000, F.col("prio"))]
    return quality.attrition(views.orders(spark, sf_dir), rules)


QUERIES["w04_remaining_after_step"], ORACLE_SQL["w04_remaining_after_step"] = a28, _ATTRITION


@query("a29_category_di", f"WITH {ORDERS_SQL}, t AS (SELECT r_name AS category, count(*) AS n, avg(actual) AS rate FROM audit_orders GROUP BY 1) SELECT category, category IN ('ASIA', 'EUROPE') AS retained, n, rate, rate / (SELECT rate FROM t WHERE category = 'EUROPE') AS di_vs_named, rate / max(rate) OVER () AS di_vs_best FROM t")
def a29(spark, sf_dir) -> DataFrame:
    return quality.category_di(views.orders(spark, sf_dir), F.col("r_name"), F.col("actual") == 1, ["ASIA", "EUROPE"], "EUROPE")


# Proxies

_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
_ASSOC = f"""u AS (SELECT 'l_returnflag' AS attribute, l_returnflag AS value, f.feature, CASE f.feature {' '.join(f"WHEN '{f}' THEN {f}" for f in _FEATURES)} END AS x FROM lineitem, (VALUES {', '.join(f"('{f}')" for f in _FEATURES)}) f(feature)
 UNION ALL SELECT 'l_linestatus', l_linestatus, f.feature, CASE f.feature {' '.join(f"WHEN '{f}' THEN {f}" for f in _FEATURES)} END FROM lineitem, (VALUES {', '.join(f"('{f}')" for f in _FEATURES)}) f(feature)),
g AS (SELECT attribute, feature, value, count(*) AS n, avg(x) AS mean, var_pop(x) AS v FROM u GROUP BY 1, 2, 3), m AS (SELECT attribute, feature, sum(n * mean) / sum(n) AS grand FROM g GROUP BY 1, 2),
assoc AS (SELECT attribute, feature, count(*) AS groups, round(sqrt(sum(n * pow(mean - grand, 2)) / sum(n * v + n * pow(mean - grand, 2))), 9) AS r FROM g JOIN m USING (attribute, feature) GROUP BY 1, 2)"""


def _assoc(spark, sf_dir) -> DataFrame:
    return proxies.associations(_t(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], _FEATURES).withColumn("r", F.round("r", 9))


@query("a22_correlation_ratio", f"WITH {_ASSOC} SELECT * FROM assoc")
def a22(spark, sf_dir) -> DataFrame:
    return _assoc(spark, sf_dir)


@query("a21_binary_correlation", "SELECT f.feature, round(CASE f.feature WHEN 'l_quantity' THEN (SELECT corr(l_quantity, (l_linestatus = 'O')::INT) FROM lineitem) ELSE (SELECT corr(l_extendedprice, (l_linestatus = 'O')::INT) FROM lineitem) END, 9) AS r FROM (VALUES ('l_quantity'), ('l_extendedprice')) f(feature)")
def a21(spark, sf_dir) -> DataFrame:
    return proxies.binary_correlation(_t(spark, sf_dir, "lineitem"), "l_linestatus", ["l_quantity", "l_extendedprice"]).withColumn("r", F.round("r", 9))


@query("a23_strength", f"WITH {_ASSOC} SELECT attribute, feature, CASE WHEN r * 40 >= 0.5 THEN 'strong' WHEN r * 40 >= 0.3 THEN 'moderate' WHEN r * 40 >= 0.15 THEN 'weak' ELSE 'negligible' END AS strength FROM assoc")
def a23(spark, sf_dir) -> DataFrame:
    return _assoc(spark, sf_dir).select("attribute", "feature", proxies.strength(F.col("r") * 40).alias("strength"))


@query("a21_order_proxies", f"WITH {ORDERS_SQL}, g AS (SELECT prio AS value, count(*) AS n, avg(score) AS mean, var_pop(score) AS v FROM audit_orders GROUP BY 1), m AS (SELECT sum(n * mean) / sum(n) AS grand FROM g) SELECT 'prio' AS attribute, 'score' AS feature, round(sqrt(sum(n * pow(mean - grand, 2)) / sum(n * v + n * pow(mean - grand, 2))), 9) AS r FROM g, m HAVING sqrt(sum(n * pow(mean - grand, 2)) / sum(n * v + n * pow(mean - grand, 2))) >= 0.05")
def a21_orders(spark, sf_dir) -> DataFrame:
    table = proxies.associations(views.orders(spark, sf_dir), ["prio"], ["score"])
    return proxies.proxies(table, 0.05).select("attribute", "feature", F.round("r", 9).alias("r"))


@query("k02_top_proxies", f"WITH {_ASSOC}, k AS (SELECT attribute, feature, r, row_number() OVER (PARTITION BY attribute ORDER BY abs(r) DESC, feature) AS place FROM assoc) SELECT * FROM k WHERE place <= 2")
def k02(spark, sf_dir) -> DataFrame:
    """The two strongest features of each attribute (a top-k report)."""
    return proxies.top_proxies(_assoc(spark, sf_dir).drop("groups"), 2)


# Splits


@query("r01_stratified_split", f"WITH {ORDERS_SQL}, {_SPLIT} SELECT record_id, split FROM parted")
def r01(spark, sf_dir) -> DataFrame:
    return _parted(spark, sf_dir).select("record_id", "split")


@query("r02_provisional_label_split", f"WITH {ORDERS_SQL}, p AS (SELECT record_id, CASE WHEN price > (SELECT median(price) FROM audit_orders) THEN 1 ELSE 0 END AS high FROM audit_orders), c AS (SELECT high, count(*) AS c FROM p GROUP BY 1) SELECT record_id, high, CASE WHEN row_number() OVER (PARTITION BY high ORDER BY md5(concat_ws('|', CAST(record_id AS VARCHAR), '7')), record_id) <= floor(0.25::DOUBLE * c) THEN 'test' ELSE 'train' END AS split FROM p JOIN c USING (high)")
def r02(spark, sf_dir) -> DataFrame:
    from auditspark.operators.clean import median_target

    rows = median_target(views.orders(spark, sf_dir), "price", F.lit(True)).select("record_id", "high")
    return split.quota_split(rows, 0.25, ["high"], seed=7)


@query("r03_simple_sample", f"WITH {ORDERS_SQL} SELECT record_id FROM audit_orders ORDER BY md5(concat_ws('|', CAST(record_id AS VARCHAR), '42')), record_id LIMIT 500")
def r03(spark, sf_dir) -> DataFrame:
    """500 rows at random (a sampling operator)."""
    return split.sample(views.orders(spark, sf_dir).select("record_id"), 500)


@query("r04_class_sample", f"WITH {ORDERS_SQL}, q AS (SELECT least(300, count(*) FILTER (actual = 1)) AS p, least(1000 - least(300, count(*) FILTER (actual = 1)), count(*) FILTER (actual <> 1)) AS n FROM audit_orders), r AS (SELECT record_id, actual, row_number() OVER (PARTITION BY actual ORDER BY md5(concat_ws('|', CAST(record_id AS VARCHAR), '42')), record_id) AS k FROM audit_orders) SELECT record_id, actual FROM r, q WHERE k <= CASE WHEN actual = 1 THEN p ELSE n END")
def r04(spark, sf_dir) -> DataFrame:
    """1000 rows with 30 % positives (a sampling operator)."""
    return split.class_sample(views.orders(spark, sf_dir).select("record_id", "actual"), "actual", 1000, 0.3)


_FOLDS = "folded AS (SELECT *, CAST((row_number() OVER (PARTITION BY actual ORDER BY md5(concat_ws('|', CAST(record_id AS VARCHAR), '42')), record_id) - 1) % 5 AS INT) AS fold FROM audit_orders)"


def _folded(spark, sf_dir) -> DataFrame:
    return split.folds(views.orders(spark, sf_dir), 5, ["actual"])


@query("r05_folds", f"WITH {ORDERS_SQL}, {_FOLDS} SELECT record_id, fold FROM folded")
def r05(spark, sf_dir) -> DataFrame:
    return _folded(spark, sf_dir).select("record_id", "fold")


@query("r05_out_of_fold_predictions")
def r05_oof(spark, sf_dir) -> DataFrame:
    """Logistic scores of every order by the model that didn't see its fold; all five models share each scan."""
    rows = _folded(spark, sf_dir).select("record_id", "fold", "actual", "price", "balance")
    return fits.out_of_fold_logistic(rows, ["price", "balance"], "actual").select("record_id", "fold", "actual", "predicted", "score")


@query("r05_fold_gradients", f"WITH {ORDERS_SQL} SELECT model::INT AS model, parameter, 0.0::DOUBLE AS gradient FROM range(5) m(model), (VALUES ('intercept'), ('price'), ('balance')) p(parameter) WHERE (SELECT count(*) FROM audit_orders) > 0")
def r05_gradients(spark, sf_dir) -> DataFrame:
    """The gradients of the five models' losses, recomputed from the rows: 0 to seven digits at the best fit."""
    rows = written(_folded(spark, sf_dir).select("fold", "actual", "price", "balance"), "folded")
    found = fits.gradients(rows, ["price", "balance"], "actual", fits.logistic_fits(rows, ["price", "balance"], "actual", "fold"), "fold")
    return found.withColumn("gradient", F.abs(F.round("gradient", 7)))


def _two_slopes(rows: str, y: str, a: str, b: str, by: str = "") -> str:
    """SQL of the least-squares fit y ~ a + b over ``rows``, by the closed form of two features."""
    det = f"(var_pop({a}) * var_pop({b}) - pow(covar_pop({a}, {b}), 2))"
    sa = f"(covar_pop({a}, {y}) * var_pop({b}) - covar_pop({b}, {y}) * covar_pop({a}, {b})) / {det}"
    sb = f"(covar_pop({b}, {y}) * var_pop({a}) - covar_pop({a}, {y}) * covar_pop({a}, {b})) / {det}"
    group = f"{by}, " if by else ""
    return f"SELECT {group}{sa} AS sa, {sb} AS sb, avg({y}) - ({sa}) * avg({a}) - ({sb}) * avg({b}) AS icept FROM {rows}" + (f" GROUP BY {by}" if by else "")


_OTHERS = "others AS (SELECT k.fold AS model, f.price, f.balance, f.actual FROM (SELECT DISTINCT fold FROM folded) k, folded f WHERE f.fold <> k.fold)"


@query("r05_out_of_fold_linear", f"WITH {ORDERS_SQL}, {_FOLDS}, {_OTHERS}, fit AS ({_two_slopes('others', 'actual', 'price', 'balance', 'model')}) SELECT record_id, fold, icept + sa * price + sb * balance AS prediction FROM folded JOIN fit ON fold = model", rounded=("prediction",))
def r05_linear(spark, sf_dir) -> DataFrame:
    """The linear probability of every order by the least squares of the other folds: moments of one scan."""
    rows = _folded(spark, sf_dir).select("record_id", "fold", "actual", "price", "balance")
    return fits.out_of_fold_linear(rows, ["price", "balance"], "actual").select("record_id", "fold", "prediction")


# Features and models

_STAT_SQL = "SELECT '{c}' AS \"column\", (SELECT median({c}) FROM audit_orders WHERE record_id % 5 <> 0) AS median, avg({c}) AS mean, stddev_pop({c}) AS std FROM audit_orders WHERE record_id % 5 <> 0"


@query("m01_feature_statistics", f"WITH {ORDERS_SQL} {_STAT_SQL.format(c='price')} UNION ALL {_STAT_SQL.format(c='balance')}", rounded=('mean', 'std'))
def m01(spark, sf_dir) -> DataFrame:
    return models.feature_statistics(views.orders(spark, sf_dir).where("record_id % 5 <> 0"), ["price", "balance"])


@query("m01_standardised", f"WITH {ORDERS_SQL} SELECT record_id, (price - (SELECT avg(price) FROM audit_orders WHERE record_id % 5 <> 0)) / (SELECT stddev_pop(price) FROM audit_orders WHERE record_id % 5 <> 0) AS price FROM audit_orders", rounded=('price',))
def m01_scaled(spark, sf_dir) -> DataFrame:
    return models.standardised(views.orders(spark, sf_dir).select("record_id", "price"), F.col("record_id") % 5 != 0, ["price"])


@query("m01_modes", f"WITH {ORDERS_SQL}, u AS (SELECT 'seg' AS \"column\", seg AS v FROM audit_orders UNION ALL SELECT 'prio', prio FROM audit_orders), n AS (SELECT \"column\", v, count(*) AS n FROM u WHERE v IS NOT NULL GROUP BY 1, 2) SELECT \"column\", first(v ORDER BY n DESC, v) AS value FROM n GROUP BY 1")
def m01_modes(spark, sf_dir) -> DataFrame:
    return models.modes(views.orders(spark, sf_dir), ["seg", "prio"])


@query("m01_one_hot", f"WITH {ORDERS_SQL} SELECT record_id, coalesce((seg = 'BUILDING')::INT, 0) AS \"seg_BUILDING\", coalesce((seg = 'MACHINERY')::INT, 0) AS \"seg_MACHINERY\" FROM audit_orders")
def m01_one_hot(spark, sf_dir) -> DataFrame:
    return models.one_hot(views.orders(spark, sf_dir), "seg", ["AUTOMOBILE", "MACHINERY", "BUILDING"]).select("record_id", "seg_BUILDING", "seg_MACHINERY")


@query("m04_class_weights", f"WITH {ORDERS_SQL} SELECT actual, count(*) AS n, sum(count(*)) OVER () / (2.0 * count(*)) AS weight FROM audit_orders GROUP BY 1")
def m04_weights(spark, sf_dir) -> DataFrame:
    return models.class_weights(views.orders(spark, sf_dir), "actual")


def _held_out(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = views.orders(spark, sf_dir).select("record_id", "actual", "price", "balance")
    return rows.where("record_id % 5 <> 0"), rows.where("record_id % 5 = 0")


@query("m04_logistic_regression")
def m04(spark, sf_dir) -> DataFrame:
    """Metrics of a balanced logistic model on the orders that it didn't see."""
    return models.logistic_metrics(*_held_out(spark, sf_dir), ["price", "balance"], "actual")


@query("m04_fit_gradient", f"WITH {ORDERS_SQL} SELECT 0::INT AS model, parameter, 0.0::DOUBLE AS gradient FROM (VALUES ('intercept'), ('price'), ('balance')) p(parameter) WHERE (SELECT count(*) FROM audit_orders) > 0")
def m04_gradient(spark, sf_dir) -> DataFrame:
    """The gradient of the balanced model's loss, recomputed from the rows: 0 to seven digits at the best fit."""
    train, _ = _held_out(spark, sf_dir)
    train = written(train, "training")
    model = fits.logistic_fit(train, ["price", "balance"], "actual", balanced=True)
    return fits.gradients(train, ["price", "balance"], "actual", {0: model}, balanced=True).withColumn("gradient", F.abs(F.round("gradient", 7)))


@query("m04_single_class", f"WITH {ORDERS_SQL} SELECT count(*) AS n, 1.0::DOUBLE AS accuracy, 0.0::DOUBLE AS \"precision\", 0.0::DOUBLE AS recall, 0.0::DOUBLE AS f1, 0.5::DOUBLE AS auc FROM audit_orders WHERE record_id % 5 = 0")
def m04_single(spark, sf_dir) -> DataFrame:
    """Where training has one class only, no model is fitted and the fallback metrics are given."""
    train, test = _held_out(spark, sf_dir)
    return models.logistic_metrics(train.where("actual = 1"), test, ["price", "balance"], "actual")


_TREE_FEATURES = {"price": [50_000.0, 100_000.0, 150_000.0, 200_000.0, 300_000.0], "balance": [0.0, 2_500.0, 5_000.0, 7_500.0], "nation": [4.0, 9.0, 14.0, 19.0]}


def tree_sql(rows: str, cuts: dict[str, list[float]], y: str) -> str:
    """SQL of the importances of one tree of depth 2: the best cut of all rows, then of each side."""
    bins = ", ".join(f"({' + '.join(f'({f} > {e})::INT' for e in es)}) AS {f}" for f, es in cuts.items())
    long = " UNION ALL ".join(f"SELECT {{n}} AS node, {i} AS feature, {f} AS bin, y FROM {{src}}" for i, f in enumerate(cuts))
    gini = lambda w, p: f"CASE WHEN {w} > 0 THEN 2.0::DOUBLE * ({p}) * (({w}) - ({p})) / ({w}) ELSE 0 END"

    def best(name: str, source: str, node: str) -> str:
        return f"""{name}_l AS ({long.format(n=node, src=source)}),
{name}_c AS (SELECT node, feature, bin, count(*)::DOUBLE AS w, sum(y)::DOUBLE AS p FROM {name}_l GROUP BY 1, 2, 3),
{name}_u AS (SELECT node, feature, bin, sum(w) OVER (PARTITION BY node, feature ORDER BY bin) AS lw, sum(p) OVER (PARTITION BY node, feature ORDER BY bin) AS lp, sum(w) OVER (PARTITION BY node, feature) AS nw, sum(p) OVER (PARTITION BY node, feature) AS np FROM {name}_c),
{name}_g AS (SELECT node, feature, bin, round({gini('nw', 'np')} - {gini('lw', 'lp')} - {gini('nw - lw', 'np - lp')}, 9) AS gain FROM {name}_u WHERE nw > lw),
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY gain DESC, feature, bin) AS k FROM {name}_g WHERE gain > 0) WHERE k = 1)"""

    at = "CASE r.feature " + " ".join(f"WHEN {i} THEN {f}" for i, f in enumerate(cuts)) + " END"
    names = ", ".join(f"'{f}'" for f in cuts)
    return f"""binned AS (SELECT {y}::INT AS y, {bins} FROM {rows}), {best('root', 'binned', '1')},
sides AS (SELECT b.*, CASE WHEN {at} <= r.bin THEN 2 ELSE 3 END AS side FROM binned b, root r), {best('child', 'sides', 'side')},
gains AS (SELECT feature, gain FROM root UNION ALL SELECT feature, gain FROM child),
imp AS (SELECT f.name AS feature, coalesce(sum(gain), 0) / (SELECT sum(gain) FROM gains) AS importance FROM (SELECT unnest([{names}]) AS name, unnest(range({len(cuts)})) AS i) f LEFT JOIN gains ON gains.feature = f.i GROUP BY 1)"""


def _tree_rows(spark, sf_dir) -> DataFrame:
    orders, customers = _t(spark, sf_dir, "orders"), _t(spark, sf_dir, "customer")
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return rows.select(F.col("o_orderkey").alias("record_id"), (F.col("o_orderstatus") != "F").cast("int").alias("actual"), F.col("o_totalprice").alias("price"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"))


@query("m05_random_forest")
def m05(spark, sf_dir) -> DataFrame:
    """Feature importances of twenty trees of depth 4 on an order's status, which no feature determines."""
    rows = _tree_rows(spark, sf_dir)
    return forest.grown(rows, ["price", "balance", "nation"], "actual", "record_id").importances(spark)


_TREE_ORDERS = "(SELECT (o_orderstatus <> 'F')::INT AS actual, o_totalprice AS price, c_acctbal AS balance, c_nationkey AS nation FROM orders JOIN customer ON o_custkey = c_custkey)"


@query("m05_tree", f"WITH {tree_sql(_TREE_ORDERS, _TREE_FEATURES, 'actual')} SELECT feature, importance FROM imp", rounded=("importance",))
def m05_tree(spark, sf_dir) -> DataFrame:
    """Importances of one tree of depth 2 with given cut points."""
    return forest.grown(_tree_rows(spark, sf_dir), list(_TREE_FEATURES), "actual", "record_id", _TREE_FEATURES, trees=1, depth=2).importances(spark)


_LINE_CUTS = {"l_quantity": [10.0, 20.0, 30.0, 40.0], "l_extendedprice": [10_000.0, 30_000.0, 60_000.0], "l_discount": [0.02, 0.05, 0.08], "l_tax": [0.02, 0.05]}


@query("k03_importance_ranking", f"WITH {tree_sql('lineitem', _LINE_CUTS, chr(40) + 'l_returnflag = ' + chr(39) + 'R' + chr(39) + chr(41))} SELECT feature, importance, row_number() OVER (ORDER BY round(importance, 6) DESC, feature)::INT AS place FROM imp", rounded=("importance",))
def k03(spark, sf_dir) -> DataFrame:
    """Features of returned line items by importance in a tree of depth 2."""
    rows = _t(spark, sf_dir, "lineitem").select(F.concat_ws("-", "l_orderkey", "l_linenumber").alias("key"), (F.col("l_returnflag") == "R").cast("int").alias("y"), *_LINE_CUTS)
    found = forest.grown(rows, list(_LINE_CUTS), "y", "key", _LINE_CUTS, trees=1, depth=2).importances(spark)
    return found.withColumn("place", F.row_number().over(Window.orderBy(F.desc(F.round("importance", 6)), "feature")))  # one row a feature


_LINES = "lines AS (SELECT l_orderkey % 5 = 0 AS test, l_quantity AS a, l_discount AS b, l_extendedprice AS y FROM lineitem)"


@query("m06_linear_regression", f"WITH {_LINES}, fit AS ({_two_slopes('(SELECT * FROM lines WHERE NOT test)', 'y', 'a', 'b')}), p AS (SELECT y, y - (icept + sa * a + sb * b) AS e FROM lines, fit WHERE test) SELECT avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse, 1 - avg(e * e) / var_pop(y) AS r2 FROM p", rounded=("mae", "rmse", "r2"), digits=4)
def m06(spark, sf_dir) -> DataFrame:
    """Errors of a least-squares fit on the line items that it didn't see."""
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity", "l_discount", "l_extendedprice")
    model = fits.linear_fit(rows.where("l_orderkey % 5 <> 0"), ["l_quantity", "l_discount"], "l_extendedprice")
    tested = rows.where("l_orderkey % 5 = 0").withColumn("prediction", model.column(["l_quantity", "l_discount"]))
    return models.regression_metrics(tested, "l_extendedprice", "prediction")


@query("m06_coefficients", f"WITH {_LINES}, fit AS ({_two_slopes('lines', 'y', 'a', 'b')}) SELECT icept AS intercept, sa AS quantity, sb AS discount FROM fit", rounded=("intercept", "quantity", "discount"), digits=3)
def m06_coefficients(spark, sf_dir) -> DataFrame:
    model = fits.linear_fit(_t(spark, sf_dir, "lineitem"), ["l_quantity", "l_discount"], "l_extendedprice")
    return spark.createDataFrame([(model.intercept, *model.slopes)], "intercept double, quantity double, discount double")


@query("m06_regression_metrics", "SELECT avg(abs(l_extendedprice - l_quantity * 1000)) AS mae, sqrt(avg(pow(l_extendedprice - l_quantity * 1000, 2))) AS rmse, 1 - avg(pow(l_extendedprice - l_quantity * 1000, 2)) / var_pop(l_extendedprice) AS r2 FROM lineitem", rounded=('mae', 'rmse', 'r2'))
def m06_metrics(spark, sf_dir) -> DataFrame:
    return models.regression_metrics(_t(spark, sf_dir, "lineitem").withColumn("guess", F.col("l_quantity") * 1000), "l_extendedprice", "guess")


_CLASS = "count(*) AS n, avg((actual = predicted)::INT) AS accuracy, coalesce(count(*) FILTER (actual = 1 AND predicted = 1) / nullif(count(*) FILTER (predicted = 1), 0)::DOUBLE, 0) AS \"precision\", coalesce(count(*) FILTER (actual = 1 AND predicted = 1) / nullif(count(*) FILTER (actual = 1), 0)::DOUBLE, 0) AS recall, coalesce(2 * count(*) FILTER (actual = 1 AND predicted = 1) / nullif(count(*) FILTER (predicted = 1) + count(*) FILTER (actual = 1), 0)::DOUBLE, 0) AS f1"


@query("m07_classification_metrics", f"WITH {ORDERS_SQL} SELECT {_CLASS} FROM audit_orders")
def m07(spark, sf_dir) -> DataFrame:
    return models.classification_metrics(views.orders(spark, sf_dir))


@query("m10_model_comparison", f"WITH {ORDERS_SQL}, l AS (SELECT 'score' AS model, actual, predicted FROM audit_orders UNION ALL SELECT 'price', actual, CASE WHEN price > 150000 THEN 1 ELSE 0 END FROM audit_orders) SELECT model, {_CLASS} FROM l GROUP BY 1")
def m10(spark, sf_dir) -> DataFrame:
    pair = F.explode(F.array(F.struct(F.lit("score").alias("model"), F.col("predicted").alias("guess")), F.struct(F.lit("price").alias("model"), F.when(F.col("price") > 150000, 1).otherwise(0).alias("guess"))))
    long = views.orders(spark, sf_dir).select("actual", pair.alias("x")).select("actual", F.col("x.model").alias("model"), F.col("x.guess").alias("predicted"))
    return models.classification_metrics(long, ["model"])


_ROC = "s AS (SELECT score, CAST(count(*) FILTER (actual = 1) AS DOUBLE) AS pos, CAST(count(*) FILTER (actual <> 1) AS DOUBLE) AS neg FROM audit_orders GROUP BY 1), c AS (SELECT *, sum(pos) OVER (ORDER BY score DESC) AS cp, sum(neg) OVER (ORDER BY score DESC) AS cn, sum(pos) OVER () AS ap, sum(neg) OVER () AS an FROM s)"


@query("m08_auc", f"WITH {ORDERS_SQL}, {_ROC} SELECT sum(neg * (cp - pos / 2)) / (max(ap) * max(an)) AS auc FROM c", rounded=('auc',))
def m08(spark, sf_dir) -> DataFrame:
    return models.auc(views.orders(spark, sf_dir))


@query("m09_roc_curve", f"WITH {ORDERS_SQL}, {_ROC} SELECT score, cp / ap AS tpr, cn / an AS fpr FROM c")
def m09(spark, sf_dir) -> DataFrame:
    return models.roc_curve(views.orders(spark, sf_dir)).select("score", "tpr", "fpr")


@query("m09_confusion_matrix", f"WITH {ORDERS_SQL} SELECT actual, predicted, count(*) AS n FROM audit_orders GROUP BY 1, 2")
def m09_matrix(spark, sf_dir) -> DataFrame:
    return models.confusion_matrix(views.orders(spark, sf_dir))


@query("m09_score_histogram", f"WITH {ORDERS_SQL} SELECT actual, CAST(greatest(0, least(49, floor((score + 100000) / (700000 / 50)))) AS INT) AS bin, count(*) AS n FROM audit_orders GROUP BY 1, 2")
def m09_histogram(spark, sf_dir) -> DataFrame:
    return models.score_histogram(views.orders(spark, sf_dir), -100000, 600000)


# Resampling

CONTROL = "en x 1"


def _population(spark, sf_dir) -> DataFrame:
    rows = views.documents(spark, sf_dir)
    return rows.select("record_id", F.concat_ws(" x ", "lang", F.col("toxic").cast("string")).alias("cell"), F.when(F.col("predicted") == 1, 1).otherwise(0).alias("fav"))


def _pop_cells(spark, sf_dir) -> DataFrame:
    return _population(spark, sf_dir).groupBy("cell").agg(F.sum("fav").cast("long").alias("k"), F.count("*").alias("n"))


_POP_SQL = f"{DOCUMENTS_SQL}, pop AS (SELECT record_id, lang || ' x ' || toxic AS cell, predicted AS fav FROM audit_documents), pc AS (SELECT cell, sum(fav) AS k, count(*) AS n, sum(fav) / CAST(count(*) AS DOUBLE) AS rate FROM pop GROUP BY 1)"
_TRUTH = f"""refs AS (SELECT 'max_rate' AS convention, (SELECT cell FROM pc ORDER BY rate DESC, cell LIMIT 1) AS ref UNION ALL SELECT 'max_rate_floor15', (SELECT cell FROM pc ORDER BY n >= 15 DESC, rate DESC, cell LIMIT 1) UNION ALL SELECT 'control', '{CONTROL}'),
te AS (SELECT convention, a.cell, a.rate / nullif(b.rate, 0) AS exact, a.cell = ref AS is_ref FROM refs JOIN pc b ON b.cell = ref CROSS JOIN pc a),
truth AS (SELECT convention, cell, round(exact, 4) AS theta, is_ref, exact < 0.8 AND NOT is_ref AS violating, row_number() OVER (PARTITION BY convention ORDER BY exact, cell) = 1 AS is_worst FROM te)"""
CONVENTIONS = ("max_rate", "max_rate_floor15", "control")


@query("r07_population_truth", f"WITH {_POP_SQL}, {_TRUTH} SELECT * FROM truth")
def r07(spark, sf_dir) -> DataFrame:
    return resample.population_truth(written(_pop_cells(spark, sf_dir), "cells"), CONVENTIONS, CONTROL)


SIZES, DRAWS = (60, 120), 8
_DRAWS = f"""hd AS (SELECT draw, cell, fav, row_number() OVER (PARTITION BY draw ORDER BY md5(concat_ws('|', CAST(record_id AS VARCHAR), CAST(draw AS VARCHAR))), record_id) AS rk FROM pop, range({DRAWS}) d(draw)),
draws AS (SELECT m, g.draw, pc.cell, count(hd.cell) AS n, coalesce(sum(hd.fav), 0) AS k FROM (VALUES (60), (120)) s(m) CROSS JOIN range({DRAWS}) g(draw) CROSS JOIN pc LEFT JOIN hd ON hd.draw = g.draw AND hd.cell = pc.cell AND hd.rk <= m GROUP BY 1, 2, 3)"""


def _draws(spark, sf_dir) -> DataFrame:
    return resample.hash_draws(_population(spark, sf_dir), SIZES, DRAWS)


@query("r06_hash_draws", f"WITH {_POP_SQL}, {_DRAWS} SELECT CAST(m AS INT) AS m, CAST(draw AS INT) AS draw, cell, CAST(k AS BIGINT) AS k, n FROM draws")
def r06_hash(spark, sf_dir) -> DataFrame:
    return _draws(spark, sf_dir)


def _order_cells(spark, sf_dir) -> DataFrame:
    cells = audit.confusion_cells(views.orders(spark, sf_dir), ["r_name", "seg"])
    return cells.select(F.concat_ws(" x ", "r_name", F.coalesce("seg", F.lit("null"))).alias("cell"), F.col("sel").alias("k"), "n")


@query("r06_hypergeometric_draws")
def r06(spark, sf_dir) -> DataFrame:
    """2000 draws of five sizes from the order decisions' cells."""
    return resample.drawn_counts(_order_cells(spark, sf_dir), (500, 1000, 2196, 4000, 8000), 2000)


_CELLS_SQL = "cells AS (SELECT concat_ws(' x ', r_name, coalesce(seg, 'null')) AS cell, sum(predicted)::BIGINT AS k, count(*) AS n FROM audit_orders GROUP BY 1), sizes AS (SELECT unnest([500, 1000, 2196, 4000, 8000])::INT AS m)"


@query("r06_draw_totals", f"WITH {ORDERS_SQL}, {_CELLS_SQL} SELECT m, range::INT AS draw, least(m, (SELECT sum(n) FROM cells))::BIGINT AS rows, (SELECT count(*) FROM cells) AS cells, TRUE AS possible FROM sizes, range(2000)")
def r06_totals(spark, sf_dir) -> DataFrame:
    """Of every draw: its rows (exactly m, or all there are), its cells, and whether no cell gives more than it has."""
    return resample.draw_totals(r06(spark, sf_dir), _order_cells(spark, sf_dir))


@query("r06_draw_moments", f"WITH {ORDERS_SQL}, {_CELLS_SQL} SELECT m, cell, TRUE AS n_mean, TRUE AS k_mean, TRUE AS n_variance, TRUE AS k_variance, TRUE AS covariance FROM sizes, cells")
def r06_moments(spark, sf_dir) -> DataFrame:
    """Of every size and cell: whether means, variances and the covariance of the 2000 draws lie where those of sampling without replacement do."""
    return resample.draw_moments(r06(spark, sf_dir), _order_cells(spark, sf_dir))


_LO, _HI = _wilson("k", "nullif(n, 0)")
_ASSERT = f"""est AS (SELECT *, k / CAST(nullif(n, 0) AS DOUBLE) AS point, CASE WHEN n > 0 THEN {_LO} END AS lo, CASE WHEN n > 0 THEN {_HI} END AS hi FROM draws),
dt AS (SELECT m, draw, sum(k) / CAST(sum(n) AS DOUBLE) AS pooled, CAST(sum(n) AS DOUBLE) AS total, count(*) FILTER (n >= 1) AS c, sum(CAST(n AS DOUBLE) * n) AS sq FROM est GROUP BY 1, 2),
ds AS (SELECT m, draw, sum(n * pow(point - pooled, 2)) AS s FROM est JOIN dt USING (m, draw) WHERE n >= 1 GROUP BY 1, 2),
dr AS (SELECT m, draw, pooled, greatest(1e-4, least(0.99, coalesce((s - pooled * (1 - pooled) * (c - 1)) / nullif(pooled * (1 - pooled) * (total - sq / total), 0), 1e-4))) AS rho FROM dt JOIN ds USING (m, draw)),
both_ AS (SELECT est.*, p.policy, CASE WHEN p.policy = 'eb' THEN CASE WHEN n >= 1 THEN (k + pooled * (1 - rho) / rho) / (n + (1 - rho) / rho) END ELSE point END AS e FROM est JOIN dr USING (m, draw) CROSS JOIN (VALUES ('floor15'), ('floor30'), ('point'), ('wilson'), ('eb')) p(policy)),
pick AS (SELECT m, draw, policy, convention, first(struct_pack(cell := cell, e := e, lo := lo, hi := hi) ORDER BY CASE convention WHEN 'control' THEN (cell = '{CONTROL}')::INT WHEN 'max_rate' THEN (n >= 1)::INT ELSE CASE WHEN n >= 15 THEN 2 WHEN n >= 1 THEN 1 ELSE 0 END END DESC, e DESC NULLS LAST, cell) AS r
 FROM both_, (VALUES ('max_rate'), ('max_rate_floor15'), ('control')) v(convention) GROUP BY 1, 2, 3, 4),
av AS (SELECT m, draw, convention, policy, b.cell, n, b.cell = r.cell AS is_sample_ref, n >= CASE policy WHEN 'floor15' THEN 15 WHEN 'floor30' THEN 30 ELSE 1 END AS reported, b.e / nullif(r.e, 0) AS d0, CASE WHEN policy = 'wilson' THEN b.lo / nullif(r.hi, 0) END AS di_lo, CASE WHEN policy = 'wilson' THEN b.hi / nullif(r.lo, 0) END AS di_hi FROM both_ b JOIN pick USING (m, draw, policy)),
aw AS (SELECT *, CASE WHEN reported THEN d0 END AS di, coalesce(reported AND CASE WHEN policy = 'wilson' THEN di_lo >= 0.8 ELSE d0 >= 0.8 END, FALSE) AS clear, coalesce(reported AND CASE WHEN policy = 'wilson' THEN di_hi < 0.8 ELSE d0 < 0.8 END, FALSE) AS violate FROM av),
asserts AS (SELECT *, CASE WHEN policy = 'wilson' THEN clear OR violate ELSE reported END AND NOT is_sample_ref AS asserted FROM aw)"""


@query("r08_policy_assertions", f"WITH {_POP_SQL}, {_DRAWS}, {_ASSERT} SELECT CAST(m AS INT) AS m, CAST(draw AS INT) AS draw, convention, policy, cell, reported, di, di_lo, di_hi, clear, violate, asserted FROM asserts", rounded=('di', 'di_lo', 'di_hi'))
def r08(spark, sf_dir) -> DataFrame:
    return resample.assertions(_draws(spark, sf_dir), CONVENTIONS, CONTROL).drop("n", "is_sample_ref")


_EVENTS = """ev AS (SELECT m, convention, policy, draw, coalesce(bool_or(asserted AND theta <> 1.0 AND (di - 1) * (theta - 1) < 0), FALSE) AS sign_inversion, coalesce(bool_or(clear AND violating), FALSE) AS false_clearance, coalesce(bool_or(clear AND is_worst), FALSE) AS false_clearance_worst,
 coalesce(bool_or(violate AND NOT violating AND NOT is_ref), FALSE) AS false_alarm, first(is_worst ORDER BY di, cell) FILTER (CASE WHEN policy = 'wilson' THEN violate ELSE asserted END) AS named, count(*) FILTER (NOT reported) AS suppressed,
 CASE WHEN policy = 'wilson' THEN count(*) FILTER (reported AND NOT is_sample_ref AND di_lo <= theta AND theta <= di_hi) / CAST(greatest(1, count(*) FILTER (reported AND NOT is_sample_ref)) AS DOUBLE) END AS coverage, CASE WHEN policy = 'wilson' THEN count(*) FILTER (reported AND NOT (clear OR violate)) END AS indeterminate
 FROM asserts JOIN truth USING (convention, cell) GROUP BY 1, 2, 3, 4),
events_ AS (SELECT CAST(m AS INT) AS m, convention, policy, CAST(draw AS INT) AS draw, sign_inversion, false_clearance, false_clearance_worst, false_alarm, coalesce(NOT named, FALSE) AS worst_wrong, named IS NULL AS worst_abstain, suppressed, coverage, indeterminate FROM ev)"""


@query("r09_audit_errors", f"WITH {_POP_SQL}, {_TRUTH}, {_DRAWS}, {_ASSERT}, {_EVENTS} SELECT * FROM events_", rounded=('coverage',))
def r09(spark, sf_dir) -> DataFrame:
    return resample.draw_events(resample.assertions(_draws(spark, sf_dir), CONVENTIONS, CONTROL), r07(spark, sf_dir))


_FC = _wilson("count(*) FILTER (false_clearance)", "count(*)")


@query("r10_study_grid", f"WITH {_POP_SQL}, {_TRUTH}, {_DRAWS}, {_ASSERT}, {_EVENTS} SELECT m, convention, policy, {', '.join(f'avg({e}::INT) AS {e}' for e in resample.EVENTS)}, {_FC[0]} AS fc_low, {_FC[1]} AS fc_high, avg(suppressed) AS mean_suppressed, avg(coverage) AS coverage, avg(indeterminate) AS mean_indeterminate FROM events_ GROUP BY 1, 2, 3", rounded=('coverage', 'mean_suppressed', 'mean_indeterminate', 'sign_inversion', 'false_clearance', 'false_clearance_worst', 'false_alarm', 'worst_wrong', 'worst_abstain'))
def r10(spark, sf_dir) -> DataFrame:
    return resample.study(r09(spark, sf_dir))


@query("r10_hypergeometric_study")
def r10_scale(spark, sf_dir) -> DataFrame:
    """The whole grid at 300 draws a size, from cell counts only."""
    cells = written(_pop_cells(spark, sf_dir), "cells")
    draws = resample.drawn_counts(cells, (60, 120, 240), 300)
    return resample.study(resample.draw_events(resample.assertions(draws, CONVENTIONS, CONTROL), resample.population_truth(cells, CONVENTIONS, CONTROL)))


@query("f06_positive_rate_guard", f"WITH {ORDERS_SQL} SELECT avg(actual) AS positive_rate, avg(actual) >= 0.05 AS usable FROM audit_orders")
def f06(spark, sf_dir) -> DataFrame:
    return views.orders(spark, sf_dir).agg(F.avg("actual").alias("positive_rate")).withColumn("usable", F.col("positive_rate") >= 0.05)


@query("w05_running_spend", """WITH e AS (SELECT event_id, user_id, ts, TRY_CAST(value AS DECIMAL(38, 6)) AS value FROM events WHERE value <> 0),
s AS (SELECT event_id, value, coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY ts NULLS FIRST, event_id NULLS FIRST, value NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM e)
SELECT event_id, spent::DOUBLE AS spent, spent + value > 500 AS over_cap FROM s""")
def w05(spark, sf_dir) -> DataFrame:
    """What each user had spent before a call, and whether the call passes the cap; ledger entries of 0 are skipped.

    Amounts are added as decimals of six places: in doubles, whether a sum of exactly 500 passes the cap hangs on the order
    of additions. An amount that isn't finite adds nothing, and whether its own call passes is null.
    """
    amount = F.col("value").try_cast("decimal(38,6)").alias("value")
    calls = _t(spark, sf_dir, "events").where("value <> 0").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), amount)
    rows = running.sums_before(calls, "user_id", "at", ["event_id", "value"], "value", "spent")
    return rows.select("event_id", F.col("spent").cast("double").alias("spent"), (F.col("spent") + F.col("value") > 500).alias("over_cap"))


@query("s10_saved_transformer", """WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity::DOUBLE AS q, l_extendedprice::DOUBLE AS p FROM lineitem),
b AS (SELECT quantile_cont(q, 0.25) AS q1, quantile_cont(q, 0.75) AS q3, quantile_cont(p, 0.25) AS p1, quantile_cont(p, 0.75) AS p3 FROM t WHERE l_orderkey % 5 <> 0),
c AS (SELECT l_orderkey, l_linenumber, greatest(q1 - 1.5 * (q3 - q1), least(q3 + 1.5 * (q3 - q1), q)) AS q, greatest(p1 - 1.5 * (p3 - p1), least(p3 + 1.5 * (p3 - p1), p)) AS p FROM t, b),
m AS (SELECT avg(q) AS mq, stddev_samp(q) AS sq, avg(p) AS mp, stddev_samp(p) AS sp FROM c WHERE l_orderkey % 5 <> 0)
SELECT l_orderkey, l_linenumber, (q - mq) / sq AS quantity, (p - mp) / sp AS price FROM c, m WHERE l_orderkey % 5 = 0""", rounded=("quantity", "price"))
def s10(spark, sf_dir) -> DataFrame:
    """A fitted scaler and its winsorising bounds saved, loaded again and applied to rows that they didn't see."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    from auditspark.operators import clean
    from auditspark.sources import tables
    from auditspark.sources.workspace import folder

    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").cast("double").alias("q"), F.col("l_extendedprice").cast("double").alias("p"))
    train, path = rows.where("l_orderkey % 5 <> 0"), folder(spark, "fitted")
    bounds = written(clean.iqr_bounds(train, ["q", "p"]), "bounds")
    stages = [VectorAssembler(inputCols=["q", "p"], outputCol="raw"), StandardScaler(inputCol="raw", outputCol="scaled", withMean=True)]
    tables.write_fitted(Pipeline(stages=stages).fit(clean.winsorised(train, bounds, ["q", "p"])), bounds, path)
    model, saved = tables.read_fitted(spark, path)
    found = model.transform(clean.winsorised(rows.where("l_orderkey % 5 = 0"), saved, ["q", "p"])).withColumn("x", vector_to_array("scaled"))
    return found.select("l_orderkey", "l_linenumber", F.col("x")[0].alias("quantity"), F.col("x")[1].alias("price"))
