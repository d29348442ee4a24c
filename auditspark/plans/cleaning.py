"""Queries: scans, cleaning, filters, joins by record id, harmonisation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.functions import scalars as S
from auditspark.operators import audit, clean
from auditspark.plans import audits, views
from auditspark.plans.views import ORDERS_SQL
from auditspark.sources import tables

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str):
    def add(f):
        QUERIES[name], ORACLE_SQL[name] = f, sql
        return f

    return add


def _t(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _projected(name: str, table: str, key: str, sql: dict[str, str], spark_columns, where: str = ""):
    """A query that adds derived columns to a key."""

    def run(spark, sf_dir) -> DataFrame:
        df = _t(spark, sf_dir, table)
        return df.select(key, *[c.alias(n) for n, c in spark_columns().items()])

    query(name, f"SELECT {key}, {', '.join(f'{e} AS {n}' for n, e in sql.items())} FROM {table} {where}")(run)


@query("s01_required_scan", "SELECT c_custkey, c_mktsegment, c_acctbal FROM customer")
def s01(spark, sf_dir) -> DataFrame:
    need = ["c_custkey", "c_mktsegment", "c_acctbal"]
    return tables.required(_t(spark, sf_dir, "customer"), need).select(*need)


@query("s02_optional_scan", "SELECT o_orderkey, o_orderstatus FROM orders")
def s02(spark, sf_dir) -> DataFrame:
    return tables.optional(_t(spark, sf_dir, "orders"), ["o_orderkey", "interest_rate", "o_orderstatus", "loan_term"])


@query("s03_predictions_scan", f"WITH {ORDERS_SQL} SELECT record_id, score, CAST(actual AS INT) AS actual, CAST(predicted AS INT) AS predicted, seg, r_name FROM audit_orders")
def s03(spark, sf_dir) -> DataFrame:
    return tables.predictions(views.orders(spark, sf_dir), ["seg", "r_name", "age_62_plus"])


_projected("p01_normal_category", "documents", "doc_id", {"c": "nullif(nullif(nullif(nullif(translate(lower(trim(substr(text, 1, 6))), '- ', '__'), ''), 'nan'), 'none'), 'null')"}, lambda: {"c": S.normal_category(F.substring("text", 1, 6))})
_projected("p02_number", "events", "event_id", {"x": "TRY_CAST(CASE WHEN event_id % 3 = 0 THEN 'nan' WHEN event_id % 3 = 1 THEN 'n/a' ELSE CAST(user_id AS VARCHAR) END AS DOUBLE)".replace("'nan'", "'x'")}, lambda: {"x": S.number(F.when(F.col("event_id") % 3 == 0, "nan").when(F.col("event_id") % 3 == 1, "n/a").otherwise(F.col("user_id").cast("string")))})
_projected("p03_percent", "lineitem", "l_orderkey", {"l_linenumber": "l_linenumber", "rate": "CAST(round(l_discount * 100) AS INT) + 0.5"}, lambda: {"l_linenumber": F.col("l_linenumber"), "rate": S.percent(F.concat(F.round(F.col("l_discount") * 100).cast("int").cast("string"), F.lit(".5%")))})
_RANGES = {"20%-<30%": 25.0, "30%-<36%": 33.0, "50%-60%": 55.0, ">60%": 65.0}
_projected(
    "p04_range_midpoint", "events", "event_id", {"ratio": "CASE event_id % 5 WHEN 0 THEN 25.0 WHEN 1 THEN 33.0 WHEN 2 THEN 55.0 WHEN 3 THEN 65.0 ELSE user_id END::DOUBLE"},
    lambda: {"ratio": (lambda c: F.coalesce(S.recoded(c, _RANGES), S.number(c)))(F.coalesce(F.try_element_at(F.array(*map(F.lit, _RANGES)), (F.col("event_id") % 5 + 1).cast("int")), F.col("user_id").cast("string")))},
)
_projected("p06_recode_keeps_null", "orders", "o_orderkey", {"flag": "CASE lower(trim(o_orderstatus)) WHEN 'f' THEN 1 WHEN 'o' THEN 0 END"}, lambda: {"flag": S.recoded(F.lower(F.trim("o_orderstatus")), {"f": 1, "o": 0})})
_projected("p07_ordinal_recode", "orders", "o_orderkey", {"grade": "6 - CAST(substr(o_orderpriority, 1, 1) AS INT)"}, lambda: {"grade": S.recoded(F.col("o_orderpriority"), {"1-URGENT": 5, "2-HIGH": 4, "3-MEDIUM": 3, "4-NOT SPECIFIED": 2, "5-LOW": 1})})
_projected("p08_target_by_code", "orders", "o_orderkey", {"target": "CASE WHEN nullif(o_orderstatus, 'P') = 'O' THEN 1 ELSE 0 END"}, lambda: {"target": F.coalesce(F.nullif("o_orderstatus", F.lit("P")) == "O", F.lit(False)).cast("int")})
_projected("p09_target_by_set", "orders", "o_orderkey", {"target": "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END"}, lambda: {"target": F.coalesce(S.normal_category(F.col("o_orderpriority")).isin("1_urgent", "2_high"), F.lit(False)).cast("int")})
_projected("p11_left_closed_bins", "customer", "c_custkey", {"level": "CASE WHEN c_acctbal >= -1e9 AND c_acctbal < 0 THEN 'debt' WHEN c_acctbal >= 0 AND c_acctbal < 5000 THEN 'low' WHEN c_acctbal >= 5000 AND c_acctbal < 1e9 THEN 'high' END"}, lambda: {"level": S.bins(F.col("c_acctbal"), [-1e9, 0, 5000, 1e9], ["debt", "low", "high"])})
_projected("p12_right_closed_bins", "part", "p_partkey", {"level": "CASE WHEN p_size > 0 AND p_size <= 10 THEN 'small' WHEN p_size > 10 AND p_size <= 30 THEN 'middle' WHEN p_size > 30 AND p_size <= 50 THEN 'large' END"}, lambda: {"level": S.bins(F.col("p_size"), [0, 10, 30, 50], ["small", "middle", "large"], right=True)})
_projected("p13_threshold_flags", "part", "p_partkey", {"big": "CASE WHEN p_size >= 40 THEN 1 ELSE 0 END", "dear": "CASE WHEN p_retailprice >= 1500 THEN 1 ELSE 0 END"}, lambda: {"big": (F.col("p_size") >= 40).cast("int"), "dear": (F.col("p_retailprice") >= 1500).cast("int")})
_projected("p14_fill_unknown", "customer", "c_custkey", {"seg": "coalesce(nullif(c_mktsegment, 'FURNITURE'), 'Unknown')"}, lambda: {"seg": F.coalesce(F.nullif("c_mktsegment", F.lit("FURNITURE")), F.lit("Unknown"))})
_projected("p17_round_to_even", "lineitem", "l_orderkey", {"l_linenumber": "l_linenumber", "q": "round_even(l_quantity / 2, 0)"}, lambda: {"l_linenumber": F.col("l_linenumber"), "q": F.bround(F.col("l_quantity") / 2)})
_projected("p19_seeded_attribute", "customer", "c_custkey", {"gender": "CASE WHEN ('0x' || substr(md5(concat_ws('|', CAST(c_custkey AS VARCHAR), '42')), 1, 8))::BIGINT / 4294967296.0 > 0.5 THEN 'Male' ELSE 'Female' END"}, lambda: {"gender": F.when(S.key_uniform(F.col("c_custkey"), 42) > 0.5, "Male").otherwise("Female")})
_projected(
    "p20_one_hot_decode", "orders", "o_orderkey", {"prio": "CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH', '3-MEDIUM') THEN o_orderpriority ELSE 'other' END"},
    lambda: {"prio": clean.one_hot_decoded({p: (F.col("o_orderpriority") == p).cast("int") for p in ("1-URGENT", "2-HIGH", "3-MEDIUM")}, "other")},
)
_projected("x14_title_tokens", "benchmark", "item_id", {"tokens": "array_to_string(list_sort(list_distinct(list_filter(string_split(trim(regexp_replace(lower(regexp_replace(text, '[{}]', '', 'g')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> ''))), ' ')"}, lambda: {"tokens": F.array_join(F.array_sort(S.title_tokens(F.col("text"))), " ")})
_projected("x15_folded_text", "benchmark", "item_id", {"folded": "trim(regexp_replace(lower(text), '[\\s-]+', ' ', 'g'))"}, lambda: {"folded": S.folded(F.col("text"))})
_projected("x16_shortened", "documents", "doc_id", {"short": "CASE WHEN length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) > 220 THEN rtrim(substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 217)) || '...' ELSE trim(regexp_replace(text, '\\s+', ' ', 'g')) END"}, lambda: {"short": S.shortened(F.col("text"))})
_projected("x17_first_line", "documents", "doc_id", {"line": "list_filter(string_split(text, chr(10)), lambda l: trim(l) <> '')[1]"}, lambda: {"line": F.try_element_at(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != ""), F.lit(1))})
_projected("x18_vocabulary", "conversations", "conv_id", {"turn": "turn", "hit": "contains(lower(text), 'unable to') OR contains(lower(text), 'sorry') OR contains(lower(text), 'the ')"}, lambda: {"turn": F.col("turn"), "hit": S.any_contained(F.lower("text"), ["unable to", "sorry", "the "])})


@query("p05_recode_drop_unmapped", "SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'A' WHEN 'AUTOMOBILE' THEN 'A' WHEN 'MACHINERY' THEN 'B' END AS grp FROM customer WHERE c_mktsegment IN ('BUILDING', 'AUTOMOBILE', 'MACHINERY')")
def p05(spark, sf_dir) -> DataFrame:
    dim = spark.createDataFrame([("BUILDING", "A"), ("AUTOMOBILE", "A"), ("MACHINERY", "B")], "c_mktsegment string, grp string")
    return _t(spark, sf_dir, "customer").join(dim, "c_mktsegment").select("c_custkey", "grp")


QUERIES["j03_dimension_lookup"], ORACLE_SQL["j03_dimension_lookup"] = p05, ORACLE_SQL["p05_recode_drop_unmapped"]


@query("p10_median_target", "SELECT o_orderkey, CASE WHEN o_totalprice > (SELECT median(o_totalprice) FROM orders WHERE o_orderkey % 5 <> 0) THEN 1 ELSE 0 END AS high FROM orders")
def p10(spark, sf_dir) -> DataFrame:
    return clean.median_target(_t(spark, sf_dir, "orders"), "o_totalprice", F.col("o_orderkey") % 5 != 0).select("o_orderkey", "high")


_BAD = "nullif(c_mktsegment, 'FURNITURE') AS seg, c_acctbal AS bal FROM customer"


def _checked(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "customer").select("c_custkey", F.nullif("c_mktsegment", F.lit("FURNITURE")).alias("seg"), F.col("c_acctbal").alias("bal"))


_RULES = ({"seg": ["BUILDING", "MACHINERY"]}, {"bal": (0.0, 5000.0)})


@query("p15_p16_validated", f"SELECT c_custkey, CASE WHEN seg IN ('BUILDING', 'MACHINERY') THEN seg END AS seg, CASE WHEN bal BETWEEN 0 AND 5000 THEN bal END AS bal FROM (SELECT c_custkey, {_BAD})")
def p15(spark, sf_dir) -> DataFrame:
    return clean.validated(_checked(spark, sf_dir), *_RULES)


@query("p16_validity_report", f"WITH s AS (SELECT c_custkey, {_BAD}) SELECT 'seg' AS \"column\", count(*) FILTER (seg NOT IN ('BUILDING', 'MACHINERY')) AS invalid, string_agg(DISTINCT seg, ',' ORDER BY seg) FILTER (seg NOT IN ('BUILDING', 'MACHINERY')) AS \"values\" FROM s UNION ALL SELECT 'bal', count(*) FILTER (bal NOT BETWEEN 0 AND 5000), '' FROM s")
def p16(spark, sf_dir) -> DataFrame:
    return clean.validity_report(_checked(spark, sf_dir), *_RULES)


@query("p16_invalid_values", f"WITH s AS (SELECT c_custkey, {_BAD}) SELECT 'seg' AS \"column\", seg AS value, count(*) AS n FROM s WHERE seg NOT IN ('BUILDING', 'MACHINERY') GROUP BY 2 UNION ALL SELECT 'bal', NULL, count(*) FROM s WHERE bal NOT BETWEEN 0 AND 5000 HAVING count(*) > 0")
def p16_values(spark, sf_dir) -> DataFrame:
    """Every invalid value and its rows, however many there are."""
    return clean.invalid_values(_checked(spark, sf_dir), *_RULES)


@query("p18_winsorised", """WITH b AS (SELECT quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.75) AS q3 FROM lineitem WHERE l_orderkey % 5 <> 0)
SELECT l_orderkey, l_linenumber, greatest(q1 - 0.5 * (q3 - q1), least(q3 + 0.5 * (q3 - q1), l_extendedprice)) AS l_extendedprice FROM lineitem, b""".replace("0.5 * (q3", "1.5 * (q3"))
def p18(spark, sf_dir) -> DataFrame:
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return clean.winsorised(rows, clean.iqr_bounds(rows.where("l_orderkey % 5 <> 0"), ["l_extendedprice"]), ["l_extendedprice"])


@query("p21_leaked_columns", f"WITH {ORDERS_SQL} SELECT * EXCLUDE (actual, score) FROM audit_orders")
def p21(spark, sf_dir) -> DataFrame:
    return views.orders(spark, sf_dir).drop("actual", "score")


@query("p24_minimal_projection", f"WITH {ORDERS_SQL} SELECT actual, predicted, r_name, seg FROM audit_orders")
def p24(spark, sf_dir) -> DataFrame:
    return views.orders(spark, sf_dir).select("actual", "predicted", "r_name", "seg")


@query("p23_feature_columns", f"WITH {ORDERS_SQL} SELECT 'price' AS feature, round(avg(price), 6) AS mean FROM audit_orders UNION ALL SELECT 'balance', round(avg(balance), 6) FROM audit_orders")
def p23(spark, sf_dir) -> DataFrame:
    rows = views.orders(spark, sf_dir)
    names = clean.feature_columns(rows, ["record_id", "actual", "predicted", "score"])
    return rows.agg(*[F.round(F.avg(n), 6).alias(n) for n in names]).unpivot([], names, "feature", "mean")


for _name, _where in {"f01_membership": "o_orderstatus IN ('F', 'O')", "f04_range": "o_totalprice > 1000 AND o_totalprice < 200000"}.items():
    query(_name, f"SELECT o_orderkey FROM orders WHERE {_where}")(lambda spark, sf_dir, w=_where: _t(spark, sf_dir, "orders").where(w).select("o_orderkey"))


@query("f02_not_null", f"WITH {ORDERS_SQL} SELECT record_id, seg FROM audit_orders WHERE seg IS NOT NULL")
def f02(spark, sf_dir) -> DataFrame:
    return views.orders(spark, sf_dir).na.drop(subset=["seg", "r_name"]).select("record_id", "seg")


@query("f03_all_nonzero", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_discount <> 0 AND l_tax <> 0")
def f03(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").where(clean.all_nonzero(["l_discount", "l_tax"])).select("l_orderkey", "l_linenumber")


_HALVES = f"WITH {ORDERS_SQL}, x AS (SELECT record_id, price FROM audit_orders), y AS (SELECT record_id, actual FROM audit_orders WHERE record_id % 7 <> 0)"


def _halves(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    rows = views.orders(spark, sf_dir)
    return rows.select("record_id", "price"), rows.where("record_id % 7 <> 0").select("record_id", "actual")


@query("j01_zip_join", f"{_HALVES} SELECT * FROM x JOIN y USING (record_id)")
def j01(spark, sf_dir) -> DataFrame:
    return clean.zipped(*_halves(spark, sf_dir))


@query("j02_reconciliation", f"{_HALVES} SELECT (SELECT count(*) FROM x) AS left_rows, (SELECT count(*) FROM y) AS right_rows, (SELECT count(*) FROM x JOIN y USING (record_id)) AS matched, (SELECT count(*) FROM y ANTI JOIN x USING (record_id)) AS only_right, (SELECT count(*) FROM x ANTI JOIN y USING (record_id)) AS only_left")
def j02(spark, sf_dir) -> DataFrame:
    return clean.zip_report(*_halves(spark, sf_dir))


@query("m02_quality_gates", f"WITH {ORDERS_SQL} SELECT count(*) FILTER (price IS NULL) AS nulls, count(*) FILTER (actual NOT IN (0, 1)) AS not_binary, count(*) - (SELECT count(*) FROM orders) AS lost_rows FROM audit_orders")
def m02(spark, sf_dir) -> DataFrame:
    gates = views.orders(spark, sf_dir).agg(F.count_if(F.col("price").isNull()).alias("nulls"), F.count_if(~F.col("actual").isin(0, 1)).alias("not_binary"), F.count("*").alias("rows"))
    return gates.crossJoin(_t(spark, sf_dir, "orders").agg(F.count("*").alias("all"))).select("nulls", "not_binary", (F.col("rows") - F.col("all")).alias("lost_rows"))


@query("m03_label_encoding", "WITH d AS (SELECT c_mktsegment, row_number() OVER (ORDER BY c_mktsegment) - 1 AS code FROM (SELECT DISTINCT c_mktsegment FROM customer)) SELECT c_custkey, CAST(code AS INT) AS code, c_mktsegment AS back FROM customer JOIN d USING (c_mktsegment)")
def m03(spark, sf_dir) -> DataFrame:
    from pyspark.ml.feature import IndexToString, StringIndexer

    rows = _t(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    model = StringIndexer(inputCol="c_mktsegment", outputCol="i", stringOrderType="alphabetAsc").fit(rows)
    return IndexToString(inputCol="i", outputCol="back", labels=model.labels).transform(model.transform(rows)).select("c_custkey", F.col("i").cast("int").alias("code"), "back")


@query("m11_feature_names", "SELECT 'price' AS feature UNION ALL SELECT 'seg_' || v FROM (SELECT DISTINCT c_mktsegment AS v FROM customer) WHERE v > (SELECT min(c_mktsegment) FROM customer)")
def m11(spark, sf_dir) -> DataFrame:
    cats = _t(spark, sf_dir, "customer").agg(F.array_sort(F.collect_set("c_mktsegment")).alias("v"))
    return cats.select(F.explode(F.concat(F.array(F.lit("price")), F.transform(F.slice("v", 2, 1_000_000), lambda x: F.concat(F.lit("seg_"), x)))).alias("feature"))


# Metric tables of two naming styles

_M = audits.ORACLE_SQL["a07_attribute_metrics"]
_HARMONISED = f"""one AS (SELECT attribute AS "Attribute", privileged AS "PrivilegedValue", di AS "DisparateImpact", dpd AS "DemographicParityDiff", eod AS "EqualOpportunityDiff", aod AS "AverageOddsDiff", theil AS "TheilIndex", bias_flag AS "BiasFlag" FROM ({_M})),
two AS (SELECT "Attribute", "PrivilegedValue", "DisparateImpact", "DemographicParityDiff", "EqualOpportunityDiff", NULL::DOUBLE AS "AverageOddsDiff", "TheilIndex", coalesce("DisparateImpact" < 0.8, FALSE) AS "BiasFlag" FROM one)"""


def _two_styles(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    m = audits.a07(spark, sf_dir)
    camel = m.select(F.col("attribute").alias("Attribute"), F.col("privileged").alias("PrivilegedValue"), F.col("di").alias("DisparateImpact"), F.col("dpd").alias("DemographicParityDiff"), F.col("eod").alias("EqualOpportunityDiff"), F.col("aod").alias("AverageOddsDiff"), F.col("theil").alias("TheilIndex"), F.col("bias_flag").alias("BiasFlag"))
    snake = m.select("attribute", F.col("privileged").alias("privileged_value"), F.col("di").cast("string").alias("disparate_impact"), F.col("dpd").alias("demographic_parity_difference"), F.col("eod").alias("equal_opportunity_difference"), F.col("theil").alias("theil_index"))
    return camel, snake


@query("s06_harmonised_table", f"WITH {_HARMONISED} SELECT * FROM two")
def s06(spark, sf_dir) -> DataFrame:
    return clean.harmonised(_two_styles(spark, sf_dir)[1])


QUERIES["p22_renamed_columns"], ORACLE_SQL["p22_renamed_columns"] = s06, ORACLE_SQL["s06_harmonised_table"]


def _union(spark, sf_dir) -> DataFrame:
    camel, snake = _two_styles(spark, sf_dir)
    return clean.harmonised(camel).withColumn("Dataset", F.lit("mortgage")).unionByName(clean.harmonised(snake).withColumn("Dataset", F.lit("p2p_loans")))


@query("u01_consolidated", f"WITH {_HARMONISED} SELECT *, 'mortgage' AS \"Dataset\" FROM one UNION ALL SELECT *, 'p2p_loans' FROM two")
def u01(spark, sf_dir) -> DataFrame:
    return _union(spark, sf_dir)


@query("u02_display_labels", f"WITH {_HARMONISED} SELECT 'Mortgage: ' || CASE \"Attribute\" WHEN 'r_name' THEN 'R Name' WHEN 'seg' THEN 'Seg' ELSE 'Prio' END AS label, \"DisparateImpact\" AS di FROM one UNION ALL SELECT 'P2p Loans: ' || CASE \"Attribute\" WHEN 'r_name' THEN 'R Name' WHEN 'seg' THEN 'Seg' ELSE 'Prio' END, \"DisparateImpact\" FROM two")
def u02(spark, sf_dir) -> DataFrame:
    nice = lambda c: F.initcap(F.replace(F.col(c), F.lit("_"), F.lit(" ")))
    return _union(spark, sf_dir).select(F.concat_ws(": ", nice("Dataset"), nice("Attribute")).alias("label"), F.col("DisparateImpact").alias("di"))


@query("u03_train_and_test", f"WITH {ORDERS_SQL} SELECT record_id, record_id % 5 = 0 AS test FROM audit_orders")
def u03(spark, sf_dir) -> DataFrame:
    rows = views.orders(spark, sf_dir).select("record_id")
    return rows.where("record_id % 5 = 0").withColumn("test", F.lit(True)).unionByName(rows.where("record_id % 5 <> 0").withColumn("test", F.lit(False)))


@query("u04_except_both_ways", "SELECT o_custkey AS key, 'only orders' AS side FROM (SELECT o_custkey FROM orders WHERE o_totalprice > 250000 EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0) UNION ALL SELECT c_custkey, 'only customer' FROM (SELECT c_custkey FROM customer WHERE c_acctbal > 0 EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 250000)")
def u04(spark, sf_dir) -> DataFrame:
    a = _t(spark, sf_dir, "orders").where("o_totalprice > 250000").select(F.col("o_custkey").alias("key"))
    b = _t(spark, sf_dir, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("key"))
    return a.subtract(b).withColumn("side", F.lit("only orders")).unionByName(b.subtract(a).withColumn("side", F.lit("only customer")))


@query("j12_dangling_keys", "SELECT c_custkey AS key, 'never used' AS problem FROM customer ANTI JOIN orders ON c_custkey = o_custkey UNION ALL SELECT DISTINCT o_custkey, 'undefined' FROM (SELECT * FROM orders) o ANTI JOIN (SELECT * FROM customer WHERE c_custkey % 10 <> 0) c ON o_custkey = c_custkey")
def j12(spark, sf_dir) -> DataFrame:
    used = _t(spark, sf_dir, "orders").select(F.col("o_custkey").alias("key")).distinct()
    customers = _t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("key"))
    undefined = used.join(customers.where("key % 10 <> 0"), "key", "left_anti").withColumn("problem", F.lit("undefined"))
    return customers.join(used, "key", "left_anti").withColumn("problem", F.lit("never used")).unionByName(undefined)


@query("j04_lookup_with_fallback", f"""WITH m AS ({_M}), k AS (SELECT r_name || '_original' AS name FROM region UNION ALL SELECT 'r_name_original' UNION ALL SELECT 'seg' UNION ALL SELECT 'prio_original')
SELECT name, coalesce(a.di, b.di) AS di FROM k LEFT JOIN m a ON a.attribute = name LEFT JOIN m b ON b.attribute = regexp_replace(name, '_original$', '')""")
def j04(spark, sf_dir) -> DataFrame:
    names = _t(spark, sf_dir, "region").select(F.concat("r_name", F.lit("_original")).alias("name")).unionByName(spark.createDataFrame([("r_name_original",), ("seg",), ("prio_original",)], "name string"))
    keys = names.select("name", F.posexplode(F.array(F.col("name"), F.regexp_replace("name", "_original$", ""))).alias("priority", "attribute"))
    found = keys.join(audits.a07(spark, sf_dir).select("attribute", "di"), "attribute", "left")
    return found.groupBy("name").agg(F.min_by("di", F.when(F.col("di").isNotNull(), F.col("priority"))).alias("di"))


@query("j08_metric_deltas", f"WITH m AS ({_M}), x AS ({audits.ORACLE_SQL['a08_majority_privileged']}) SELECT m.attribute, x.di - m.di AS di, x.dpd - m.dpd AS dpd FROM m JOIN x ON m.attribute = x.attribute")
def j08(spark, sf_dir) -> DataFrame:
    long = lambda df, v: df.select("attribute", "di", "dpd").unpivot(["attribute"], ["di", "dpd"], "metric", v)
    both = long(audits.a07(spark, sf_dir), "ours").join(long(audits.a08(spark, sf_dir), "theirs"), ["attribute", "metric"])
    return both.withColumn("delta", F.col("theirs") - F.col("ours")).groupBy("attribute").pivot("metric", ["di", "dpd"]).agg(F.first("delta"))


@query("a30_bias_matrix", f"WITH {_HARMONISED}, u AS (SELECT 'mortgage' AS d, * FROM one UNION ALL SELECT 'p2p_loans', * FROM two) SELECT d AS \"Dataset\", coalesce(max(\"BiasFlag\"::INT) FILTER (\"Attribute\" = 'r_name'), 0) AS r_name, coalesce(max(\"BiasFlag\"::INT) FILTER (\"Attribute\" = 'seg'), 0) AS seg, coalesce(max(\"BiasFlag\"::INT) FILTER (\"Attribute\" = 'prio'), 0) AS prio FROM u GROUP BY 1")
def a30(spark, sf_dir) -> DataFrame:
    return _union(spark, sf_dir).groupBy("Dataset").pivot("Attribute", ["r_name", "seg", "prio"]).agg(F.max(F.col("BiasFlag").cast("int"))).na.fill(0)


@query("s07_result_sink", f"SELECT * FROM ({_M})")
def s07(spark, sf_dir) -> DataFrame:
    """The metric table written as Parquet and read back."""
    from auditspark.sources.workspace import folder

    path = folder(spark, "metrics")
    metrics = audits.a07(spark, sf_dir)
    tables.write_table(metrics, path)
    return spark.read.schema(metrics.schema).parquet(path)


@query("s08_summary_sink", f"SELECT attribute, di, theil, bias_flag FROM ({_M})")
def s08(spark, sf_dir) -> DataFrame:
    """The summary written as JSON and read back."""
    from auditspark.sources.workspace import folder

    path = folder(spark, "summary")
    tables.write_summary(audits.a07(spark, sf_dir), path)
    back = spark.read.schema("attribute string, metrics struct<DisparateImpact:double,TheilIndex:double,BiasFlag:boolean>").json(path)
    return back.select("attribute", F.col("metrics.DisparateImpact").alias("di"), F.col("metrics.TheilIndex").alias("theil"), F.col("metrics.BiasFlag").alias("bias_flag"))


@query("s09_split_sink", f"WITH {ORDERS_SQL} SELECT CASE WHEN record_id % 5 = 0 THEN 'test' ELSE 'train' END AS split, count(*) AS n FROM audit_orders GROUP BY 1")
def s09(spark, sf_dir) -> DataFrame:
    """The split table written by split and counted from its partitions."""
    from auditspark.sources.workspace import folder

    path = folder(spark, "split")
    tables.write_split(views.orders(spark, sf_dir).withColumn("split", F.when(F.col("record_id") % 5 == 0, "test").otherwise("train")), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"))
