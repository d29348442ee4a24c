"""Queries: record analytics and evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.functions import scalars as S
from auditspark.operators import diagnose, evidence, frequent
from auditspark.operators import records as R
from auditspark.plans import audits, views
from auditspark.plans.studies import query as _query
from auditspark.plans.views import RECORDS_SQL

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, rounded: tuple[str, ...] = (), digits: int = 6):
    """As in the studies, into this module's tables."""
    from auditspark.plans import studies

    def add(f):
        _query(name, sql, rounded, digits)(f)
        QUERIES[name] = studies.QUERIES.pop(name)
        if sql:
            ORACLE_SQL[name] = studies.ORACLE_SQL.pop(name)
        return f

    return add


def _t(spark, sf_dir, name) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_NORM = "CASE WHEN contains(upper({0}), 'CRITICAL') THEN 'CRITICAL' WHEN contains(upper({0}), 'HIGH') THEN 'HIGH' WHEN contains(upper({0}), 'MODERATE') THEN 'MODERATE' WHEN contains(upper({0}), 'LOW') THEN 'LOW' WHEN trim({0}) <> '' THEN trim(upper({0})) ELSE 'UNKNOWN' END"
_SEV = _NORM.format("coalesce(severity, '')")
_BASE = "base AS (SELECT dataset, attribute, first(upper(severity) ORDER BY record_id) AS baseline FROM audit_records WHERE cycle = 1 GROUP BY 1, 2)"
_AGREES = f"WITH {RECORDS_SQL}, {_BASE}, j AS (SELECT r.*, baseline, {_NORM.format('severity')} AS got, {_NORM.format('coalesce(baseline, chr(0))')} AS want FROM audit_records r LEFT JOIN base USING (dataset, attribute))"


def _base(spark, sf_dir) -> DataFrame:
    first = F.min_by(F.upper("severity"), "record_id")
    return views.records(spark, sf_dir).where("cycle = 1").groupBy("dataset", "attribute").agg(first.alias("baseline"))


def _with_base(spark, sf_dir) -> DataFrame:
    return R.with_baseline(views.records(spark, sf_dir), _base(spark, sf_dir))


@query("x03_severity_label", f"WITH {RECORDS_SQL} SELECT record_id, {_SEV} AS label FROM audit_records")
def x03(spark, sf_dir) -> DataFrame:
    return views.records(spark, sf_dir).select("record_id", S.severity_label(F.col("severity")).alias("label"))


@query("s05_baseline_scan", f"WITH {RECORDS_SQL}, {_BASE} SELECT * FROM base")
def s05(spark, sf_dir) -> DataFrame:
    return _base(spark, sf_dir)


@query("j05_baseline_join", f"{_AGREES} SELECT record_id, baseline, CASE WHEN baseline IS NOT NULL THEN got = want END AS agrees FROM j")
def j05(spark, sf_dir) -> DataFrame:
    return _with_base(spark, sf_dir).select("record_id", "baseline", "agrees")


QUERIES["j07_comparison"], ORACLE_SQL["j07_comparison"] = QUERIES["j05_baseline_join"], ORACLE_SQL["j05_baseline_join"]


@query("j06_result_by_attribute", f"WITH {RECORDS_SQL}, {_BASE}, r AS (SELECT dataset, attribute, count(*) AS answers FROM audit_records WHERE cycle = 3 GROUP BY 1, 2) SELECT dataset, attribute, baseline, coalesce(answers, 0) AS answers FROM base LEFT JOIN r USING (dataset, attribute)")
def j06(spark, sf_dir) -> DataFrame:
    answers = views.records(spark, sf_dir).where("cycle = 3").groupBy("dataset", "attribute").agg(F.count("*").alias("answers"))
    return _base(spark, sf_dir).join(answers, ["dataset", "attribute"], "left").na.fill({"answers": 0})


@query("w07_stability", f"WITH {RECORDS_SQL}, s AS (SELECT DISTINCT dataset, attribute, cycle, {_SEV} AS s FROM audit_records) SELECT dataset, attribute, string_agg(cycle || ':' || s, ',' ORDER BY cycle, s) AS severities, count(DISTINCT s) AS \"distinct\", count(DISTINCT s) <= 1 AS stable FROM s GROUP BY 1, 2")
def w07(spark, sf_dir) -> DataFrame:
    return R.stability(views.records(spark, sf_dir))


@query("l17_stability_and_agreement", f"{_AGREES} SELECT dataset, attribute, count(DISTINCT got) <= 1 AS stable, avg(CASE WHEN baseline IS NOT NULL THEN (got = want)::INT END) AS agreement FROM j GROUP BY 1, 2", rounded=("agreement",))
def l17(spark, sf_dir) -> DataFrame:
    agreement = _with_base(spark, sf_dir).groupBy("dataset", "attribute").agg(F.avg(F.col("agrees").cast("int")).alias("agreement"))
    return R.stability(views.records(spark, sf_dir)).select("dataset", "attribute", "stable").join(agreement, ["dataset", "attribute"])


_RANK = "list_position(['LOW', 'MODERATE', 'HIGH', 'CRITICAL'], {})"


@query("l18_direction", f"{_AGREES}, k AS (SELECT dataset, coalesce({_RANK.format('got')}, 0) AS g, coalesce({_RANK.format('want')}, 0) AS w FROM j WHERE baseline IS NOT NULL) SELECT dataset, count(*) FILTER (g = w) AS matches, count(*) FILTER (g > w) AS over, count(*) FILTER (g < w) AS under FROM k GROUP BY 1")
def l18(spark, sf_dir) -> DataFrame:
    return R.direction(_with_base(spark, sf_dir))


@query("w09_majority_severity", f"WITH {RECORDS_SQL}, n AS (SELECT dataset, attribute, {_SEV} AS s, count(*) AS n FROM audit_records GROUP BY 1, 2, 3) SELECT dataset, attribute, first(s ORDER BY n DESC, s) AS majority, CASE WHEN first(s ORDER BY n DESC, s) = 'HIGH' THEN 'Yes' WHEN bool_or(s = 'HIGH') THEN 'Partial' ELSE 'No' END AS high FROM n GROUP BY 1, 2")
def w09(spark, sf_dir) -> DataFrame:
    m = R.majority_severity(views.records(spark, sf_dir))
    return m.select("dataset", "attribute", "majority", F.when(F.col("majority") == "HIGH", "Yes").when(F.array_contains("seen", "HIGH"), "Partial").otherwise("No").alias("high"))


_PRICES = [("mortgage", 2.5, 10.0), ("credit", 0.5, 1.5), ("lending", 0.0, 0.0)]
_COST = f"WITH {RECORDS_SQL}, p(dataset, ip, op) AS (VALUES ('mortgage', 2.5, 10.0), ('credit', 0.5, 1.5), ('lending', 0.0, 0.0)), c AS (SELECT *, (input_tokens * ip + output_tokens * op)::DOUBLE / 1e6 AS cost FROM audit_records JOIN p USING (dataset))"


def _costs(spark, sf_dir) -> DataFrame:
    return R.token_cost(views.records(spark, sf_dir), spark.createDataFrame(_PRICES, "dataset string, input_price double, output_price double"))


@query("x11_token_cost", f"{_COST} SELECT record_id, cost FROM c", rounded=("cost",))
def x11(spark, sf_dir) -> DataFrame:
    return _costs(spark, sf_dir).select("record_id", "cost")


@query("x11_call_estimate", f"WITH {RECORDS_SQL}, p(dataset, ip, op) AS (VALUES ('mortgage', 2.5, 10.0), ('credit', 0.5, 1.5), ('lending', 0.0, 0.0)) SELECT record_id, ((greatest(1, length(text) // 4)::DOUBLE / 1e6 * ip + 1200 / 1e6 * op) * 1.15)::DOUBLE AS estimate FROM audit_records JOIN p USING (dataset)", rounded=("estimate",), digits=10)
def x11_estimate(spark, sf_dir) -> DataFrame:
    """What a call would cost at most, from the length of its prompt."""
    rows = views.records(spark, sf_dir).join(spark.createDataFrame(_PRICES, "dataset string, input_price double, output_price double"), "dataset")
    return rows.select("record_id", R.estimated_cost(F.col("text"), F.col("input_price"), F.col("output_price")).alias("estimate"))


@query("l20_usage", f"{_COST} SELECT cycle, count(*) AS calls, sum(input_tokens) AS input_tokens, sum(output_tokens) AS output_tokens, sum(cost) AS cost, sum(cost) / count(*) AS cost_per_call, avg(seconds)::DOUBLE AS latency FROM c GROUP BY 1", rounded=("cost", "cost_per_call", "latency"), digits=10)
def l20(spark, sf_dir) -> DataFrame:
    return R.usage(_costs(spark, sf_dir))


@query("l21_cycle_spread", f"WITH {RECORDS_SQL}, m AS (SELECT dataset, cycle, avg(total_score) AS mean FROM audit_records GROUP BY 1, 2) SELECT dataset, max(mean) - min(mean) AS spread, max(mean) FILTER (cycle <> 4) - min(mean) FILTER (cycle <> 4) AS spread_without FROM m GROUP BY 1", rounded=("spread", "spread_without"))
def l21(spark, sf_dir) -> DataFrame:
    return R.cycle_spread(views.records(spark, sf_dir))


@query("l22_dip", f"WITH {RECORDS_SQL}, d AS (SELECT 'completeness' AS subscore, avg(completeness) FILTER (cycle <> 4) - avg(completeness) FILTER (cycle = 4) AS drop_ FROM audit_records UNION ALL SELECT 'agreement', avg(agreement) FILTER (cycle <> 4) - avg(agreement) FILTER (cycle = 4) FROM audit_records) SELECT subscore, drop_ AS \"drop\", drop_ / sum(drop_) OVER () AS share FROM d", rounded=("share",))
def l22(spark, sf_dir) -> DataFrame:
    return R.dip(views.records(spark, sf_dir), ["completeness", "agreement"])


@query("f07_content_and_zero", f"WITH {RECORDS_SQL} SELECT severity <> '' AS has_content, total_score = 0 AS zero, count(*) AS n FROM audit_records GROUP BY 1, 2")
def f07(spark, sf_dir) -> DataFrame:
    return views.records(spark, sf_dir).groupBy((F.col("severity") != "").alias("has_content"), (F.col("total_score") == 0).alias("zero")).agg(F.count("*").alias("n"))


@query("l23_empty_against_content", f"WITH {RECORDS_SQL} SELECT dataset, avg(total_score) FILTER (severity <> '') AS content_mean, avg(total_score) FILTER (severity = '') AS empty_mean, count(*) FILTER (severity = '') AS empty FROM audit_records GROUP BY 1", rounded=("content_mean", "empty_mean"))
def l23(spark, sf_dir) -> DataFrame:
    full = F.col("severity") != ""
    return views.records(spark, sf_dir).groupBy("dataset").agg(F.avg(F.when(full, F.col("total_score"))).alias("content_mean"), F.avg(F.when(~full, F.col("total_score"))).alias("empty_mean"), F.count_if(~full).alias("empty"))


@query("l24_score_pivot", f"WITH {RECORDS_SQL} SELECT dataset, attribute, avg(total_score) FILTER (cycle = 1) AS c1, avg(total_score) FILTER (cycle = 2) AS c2, avg(total_score) FILTER (cycle = 3) AS c3, avg(total_score) FILTER (cycle = 4) AS c4 FROM audit_records GROUP BY 1, 2", rounded=("c1", "c2", "c3", "c4"))
def l24(spark, sf_dir) -> DataFrame:
    wide = views.records(spark, sf_dir).groupBy("dataset", "attribute").pivot("cycle", [1, 2, 3, 4]).agg(F.avg("total_score"))
    return wide.withColumnsRenamed({str(k): f"c{k}" for k in (1, 2, 3, 4)})


@query("l24_pivot_mean", f"WITH {RECORDS_SQL}, c AS (SELECT dataset, attribute, cycle, avg(total_score) AS m FROM audit_records GROUP BY 1, 2, 3) SELECT dataset, attribute, avg(m) AS mean FROM c GROUP BY 1, 2", rounded=("mean",), digits=1)
def l24_mean(spark, sf_dir) -> DataFrame:
    """The mean over a row of the pivot: of its cycles, as far as there are any."""
    cycles = [F.col(f"c{k}") for k in (1, 2, 3, 4)]
    held = F.filter(F.array(*cycles), lambda x: x.isNotNull())
    return l24(spark, sf_dir).select("dataset", "attribute", (F.aggregate(held, F.lit(0.0), lambda s, x: s + x) / F.size(held)).alias("mean"))


@query("l24_cycle_statistics", f"WITH {RECORDS_SQL} SELECT cycle, avg(total_score) AS mean, stddev_samp(total_score) AS std, count(total_score) AS n FROM audit_records GROUP BY 1", rounded=("mean", "std"), digits=2)
def l24_cycles(spark, sf_dir) -> DataFrame:
    """Mean, sample deviation and number of scores of each cycle."""
    return views.records(spark, sf_dir).groupBy("cycle").agg(F.avg("total_score").alias("mean"), F.stddev_samp("total_score").alias("std"), F.count("total_score").alias("n"))


@query("l25_subscore_share", f"WITH {RECORDS_SQL} SELECT cycle, avg(completeness) / 40 AS completeness, avg(agreement) / 20 AS agreement FROM audit_records GROUP BY 1", rounded=("completeness", "agreement"))
def l25(spark, sf_dir) -> DataFrame:
    return views.records(spark, sf_dir).groupBy("cycle").agg((F.avg("completeness") / 40).alias("completeness"), (F.avg("agreement") / 20).alias("agreement"))


@query("w06_cycle_gain", f"WITH {RECORDS_SQL} SELECT dataset, attribute, first(total_score ORDER BY cycle DESC, record_id DESC) - first(total_score ORDER BY cycle, record_id) AS gain FROM audit_records GROUP BY 1, 2")
def w06(spark, sf_dir) -> DataFrame:
    return R.gain(views.records(spark, sf_dir))


@query("l16_hybrid_score", f"WITH {RECORDS_SQL} SELECT record_id, 0.45 * total_score + 0.45 * completeness + 0.10 * agreement AS hybrid FROM audit_records", rounded=("hybrid",))
def l16(spark, sf_dir) -> DataFrame:
    return views.records(spark, sf_dir).select("record_id", R.hybrid(F.col("total_score"), F.col("completeness"), F.col("agreement")).alias("hybrid"))


def _results(spark, sf_dir) -> DataFrame:
    """Records with a result struct made of the whole text: its thirds as narrative fields, its sentences as sources."""
    third = F.floor((F.length("text") + 2) / 3).cast("int")
    part = lambda k: F.substr(F.col("text"), third * k + 1, third)
    result = F.struct(F.col("attribute"), F.col("severity"), part(0).alias("what_is_wrong"), part(1).alias("why_is_wrong"), part(2).alias("how_to_fix"), F.split("text", r"\. ").alias("supporting_research"))
    return views.records(spark, sf_dir).select("record_id", "dataset", "attribute", "cycle", "text", "severity", "total_score", result.alias("result"))


_PARTS = f"""{RECORDS_SQL}, p AS (SELECT record_id, dataset, attribute, cycle, text, severity, substr(text, 1, (length(text) + 2) // 3) AS w1, substr(text, (length(text) + 2) // 3 + 1, (length(text) + 2) // 3) AS w2, substr(text, 2 * ((length(text) + 2) // 3) + 1) AS w3, string_split(text, '. ') AS src FROM audit_records),
ref AS (SELECT *, list_bool_or([{', '.join(f"contains(lower(text), '{x.replace(chr(39), chr(39) * 2)}')" for x in R.REFUSALS)}]) AS phrase, attribute = '' OR severity = '' OR w1 = '' OR w2 = '' OR w3 = '' AS missing,
 length(w1) < 40 OR length(w2) < 40 OR length(w3) < 40 AS brief, trim(upper(severity)) <> '' AND trim(upper(severity)) NOT IN ('CRITICAL', 'HIGH', 'MODERATE', 'LOW') AS odd FROM p)"""


@query("l07_refusals", f"WITH {_PARTS} SELECT record_id, phrase OR missing OR brief OR odd AS refused FROM ref")
def l07(spark, sf_dir) -> DataFrame:
    return _results(spark, sf_dir).select("record_id", R.refused(F.col("result"), F.col("text")).alias("refused"))


@query("l08_refusal_kinds", f"WITH {_PARTS} SELECT record_id, CASE WHEN phrase OR missing OR brief OR odd THEN CASE WHEN phrase OR missing OR odd THEN 'genuine' WHEN brief THEN 'brevity_only' ELSE 'genuine' END END AS kind FROM ref")
def l08(spark, sf_dir) -> DataFrame:
    return _results(spark, sf_dir).select("record_id", R.refusal_kind(R.refused(F.col("result"), F.col("text")), F.col("result"), F.col("text")).alias("kind"))


@query("l01_completeness", f"WITH {_PARTS} SELECT record_id, (CASE WHEN attribute <> '' THEN 4 ELSE 0 END + CASE WHEN length(w1) >= 100 THEN 8 ELSE 0 END + CASE WHEN w1 <> '' AND w2 <> '' AND w3 <> '' AND severity <> '' THEN 8 ELSE 0 END + CASE WHEN length(w2) >= 100 THEN 5 ELSE 0 END + CASE WHEN len(src) >= 2 THEN 5 ELSE 0 END)::DOUBLE AS points FROM p")
def l01(spark, sf_dir) -> DataFrame:
    return _results(spark, sf_dir).select("record_id", R.completeness(F.col("result")).alias("points"))


_ONE = "(CASE WHEN attribute <> '' THEN 4 ELSE 0 END + CASE WHEN length(w1) >= 100 THEN 8 ELSE 0 END + CASE WHEN w1 <> '' AND w2 <> '' AND w3 <> '' AND severity <> '' THEN 8 ELSE 0 END + CASE WHEN length(w2) >= 100 THEN 5 ELSE 0 END + CASE WHEN len(src) >= 2 THEN 5 ELSE 0 END)"
_NAMED = " OR ".join(f"contains(replace(replace(lower(w3), '-', ''), '_', ''), '{x}')" for x in R.ALGORITHMS)


@query("l06_total_scores", f"""WITH {_PARTS}, {_BASE}, s AS (SELECT record_id, least(40.0::DOUBLE, {_ONE} + 10.0) AS completeness, CASE WHEN {_SEV} = coalesce({_NORM.format("baseline")}, 'UNKNOWN') THEN 20.0::DOUBLE ELSE 0.0::DOUBLE END AS severity_agreement,
CASE WHEN baseline IS NULL THEN 10.0 ELSE 15.0 * (contains(lower(w2), 'representation bias')::INT + contains(lower(w2), 'the')::INT) / 2 END::DOUBLE AS cause_alignment, CASE WHEN {_NAMED} THEN 15.0::DOUBLE ELSE 0.0::DOUBLE END AS mitigation, CASE WHEN len(src) >= 1 THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END AS grounding
FROM p LEFT JOIN base USING (dataset, attribute)) SELECT *, completeness + severity_agreement + cause_alignment + mitigation + grounding AS total FROM s""")
def l06(spark, sf_dir) -> DataFrame:
    """Subscores L1-L5 and their total for each record."""
    base = _base(spark, sf_dir).select("dataset", "attribute", F.col("baseline").alias("severity"), F.array(F.lit("representation_bias"), F.lit("the")).alias("labels"))
    return R.scored(_results(spark, sf_dir).drop("severity"), base).select("record_id", "completeness", "severity_agreement", "cause_alignment", "mitigation", "grounding", "total")


@query("l02_severity_agreement", f"WITH {RECORDS_SQL}, {_BASE} SELECT record_id, CASE WHEN {_SEV} = {_NORM.format('baseline')} THEN 20.0::DOUBLE ELSE 0.0::DOUBLE END AS points FROM audit_records r JOIN base USING (dataset, attribute)")
def l02(spark, sf_dir) -> DataFrame:
    return l06(spark, sf_dir).join(_with_base(spark, sf_dir).where("baseline IS NOT NULL").select("record_id"), "record_id").select("record_id", F.col("severity_agreement").alias("points"))


@query("l03_cause_alignment", f"WITH {_PARTS}, {_BASE} SELECT record_id, CASE WHEN base.baseline IS NULL THEN 10.0 ELSE 15.0 * (contains(lower(w2), 'representation bias')::INT + contains(lower(w2), 'the')::INT) / 2 END::DOUBLE AS points FROM p LEFT JOIN base USING (dataset, attribute)")
def l03(spark, sf_dir) -> DataFrame:
    return l06(spark, sf_dir).select("record_id", F.col("cause_alignment").alias("points"))


@query("l04_mitigation", f"WITH {_PARTS} SELECT record_id, list_bool_or([{', '.join(f'contains(replace(replace(lower(w3), chr(45), chr(0)), chr(95), chr(0)), {chr(39)}{x}{chr(39)})'.replace('chr(0)', chr(39) * 2) for x in R.ALGORITHMS)}]) AS named FROM p")
def l04(spark, sf_dir) -> DataFrame:
    return _results(spark, sf_dir).select("record_id", R.names_algorithm(F.col("result.how_to_fix")).alias("named"))


@query("l05_grounding", f"WITH {_PARTS} SELECT record_id, CASE WHEN len(src) >= 1 THEN 10.0::DOUBLE ELSE 0.0::DOUBLE END AS points FROM p")
def l05(spark, sf_dir) -> DataFrame:
    return l06(spark, sf_dir).select("record_id", F.col("grounding").alias("points"))


@query("u05_attribute_coverage", f"WITH {RECORDS_SQL}, g AS (SELECT dataset, cycle, list(DISTINCT attribute) AS l FROM audit_records GROUP BY 1, 2) SELECT dataset, cycle, list_has_all(l, ['sex', 'race']) AS covered FROM g")
def u05(spark, sf_dir) -> DataFrame:
    g = views.records(spark, sf_dir).groupBy("dataset", "cycle").agg(F.collect_set("attribute").alias("l"))
    return g.select("dataset", "cycle", R.covers(F.array(F.lit("sex"), F.lit("race")), F.col("l")).alias("covered"))


@query("u06_shared_keys", f"WITH {RECORDS_SQL}, o AS (SELECT * FROM audit_records WHERE cycle = 1 AND dataset <> 'credit'), n AS (SELECT * FROM audit_records WHERE cycle = 2) SELECT 'old' AS run, count(*) AS n, sum(total_score) AS score FROM o WHERE dataset IN (SELECT dataset FROM n) UNION ALL SELECT 'new', count(*), sum(total_score) FROM n WHERE dataset IN (SELECT dataset FROM o)")
def u06(spark, sf_dir) -> DataFrame:
    rows = views.records(spark, sf_dir)
    old, new = rows.where("cycle = 1 AND dataset <> 'credit'"), rows.where("cycle = 2")
    one = lambda a, b, tag: a.join(b.select("dataset").distinct(), "dataset", "left_semi").agg(F.lit(tag).alias("run"), F.count("*").alias("n"), F.sum("total_score").alias("score"))
    return one(old, new, "old").unionByName(one(new, old, "new"))


@query("j13_paired_models", f"WITH {RECORDS_SQL}, m AS (SELECT dataset, attribute, cycle, record_id // 1000 % 2 AS model, avg(total_score) AS s FROM audit_records GROUP BY 1, 2, 3, 4) SELECT dataset, attribute, cycle, a.s AS even, b.s AS odd FROM (SELECT * FROM m WHERE model = 0) a JOIN (SELECT * FROM m WHERE model = 1) b USING (dataset, attribute, cycle)", rounded=("even", "odd"))
def j13(spark, sf_dir) -> DataFrame:
    keys = ["dataset", "attribute", "cycle"]
    m = views.records(spark, sf_dir).groupBy(*keys, (F.floor(F.col("record_id") / 1000) % 2).alias("model")).agg(F.avg("total_score").alias("s"))
    return m.where("model = 0").select(*keys, F.col("s").alias("even")).join(m.where("model = 1").select(*keys, F.col("s").alias("odd")), keys)


@query("j14_usage_overlay", f"WITH {RECORDS_SQL} SELECT record_id, coalesce(CASE WHEN cycle <> 2 THEN input_tokens END, CASE WHEN record_id % 3 = 0 THEN 7 END) AS input_tokens FROM audit_records")
def j14(spark, sf_dir) -> DataFrame:
    rows = views.records(spark, sf_dir)
    holes = rows.select("record_id", F.when(F.col("cycle") != 2, F.col("input_tokens")).alias("input_tokens"))
    return evidence.overlaid(holes, rows.where("record_id % 3 = 0").select("record_id", F.lit(7).cast("long").alias("input_tokens")), "record_id", ["input_tokens"])


@query("l10_metric_values", f"WITH {RECORDS_SQL}, q AS (SELECT record_id, completeness, list_transform(regexp_extract_all(text || ' 0.81 ' || CAST(CAST(completeness AS INT) AS VARCHAR) || '.0 77.7', '-?\\d+\\.\\d+'), lambda x: x::DOUBLE) AS v FROM audit_records) SELECT record_id, len(list_filter(v, lambda q: NOT (abs(q - completeness) <= 5e-4 OR list_bool_or(list_transform([{', '.join(map(str, R.ANCHORS))}], lambda a: abs(q - a) <= 5e-4))))) AS foreign_values FROM q")
def l10(spark, sf_dir) -> DataFrame:
    text = F.concat(F.col("text"), F.lit(" 0.81 "), F.col("completeness").cast("int").cast("string"), F.lit(".0 77.7"))
    return views.records(spark, sf_dir).select("record_id", F.size(R.foreign_values(text, F.array("completeness"))).cast("long").alias("foreign_values"))


_GRAMS = "CASE WHEN len({w}) >= 3 THEN list_transform(range(1, len({w}) - 1), lambda k: array_to_string({w}[k:k + 2], ' ')) ELSE [] END"
_WORDS = "list_filter(regexp_split_to_array(trim(lower({})), '\\s+'), lambda w: w <> '')"


@query("l09_unknown_citations", f"WITH {RECORDS_SQL}, t AS (SELECT DISTINCT unnest({_GRAMS.format(w='w')}) AS g FROM (SELECT {_WORDS.format('text')} AS w FROM benchmark)), c AS (SELECT doc_id, {_WORDS.format('text')} AS w FROM documents), h AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, unnest({_GRAMS.format(w='w')}) AS g FROM c) SEMI JOIN t USING (g)) SELECT doc_id AS id FROM documents ANTI JOIN h USING (doc_id)")
def l09(spark, sf_dir) -> DataFrame:
    cites = _t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("citation"))
    return R.unknown_citations(cites, _t(spark, sf_dir, "benchmark").select(F.col("text").alias("title"))).select("id")


_TT = "list_distinct(list_filter(string_split(trim(regexp_replace(lower(regexp_replace({}, '[{{}}]', '', 'g')), '[^a-z0-9]+', ' ', 'g')), ' '), lambda w: w <> ''))"


_TITLE = "regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1)"


@query("j11_similar_titles", f"WITH l AS (SELECT item_id AS a, {_TT.format('text')} AS ta FROM benchmark), r AS (SELECT page_id AS b, {_TT.format(_TITLE)} AS tb FROM pages), x AS (SELECT a, b, len(list_intersect(ta, tb)) / CAST(least(len(ta), len(tb)) AS DOUBLE) AS similarity FROM l, r WHERE len(ta) > 0 AND len(tb) > 0) SELECT * FROM x WHERE similarity >= 0.2")
def j11(spark, sf_dir) -> DataFrame:
    left = _t(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("title"))
    right = _t(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), evidence.html_title(F.col("html")).alias("title"))
    return evidence.similar_titles(left, right, 0.2)


@query("j10_citation_evidence", "SELECT page_id AS id, EXISTS (SELECT 1 FROM benchmark b WHERE contains(lower(html), lower(substr(trim(b.text), 1, 40)))) AS verified FROM pages")
def j10(spark, sf_dir) -> DataFrame:
    keys = _t(spark, sf_dir, "benchmark").select(F.substring(F.trim("text"), 1, 40).alias("key"))
    return evidence.verified_citations(_t(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("html").alias("reference")), keys)


@query("l13_verification_rate", "SELECT page_id % 10 AS use_case, avg((EXISTS (SELECT 1 FROM benchmark b WHERE contains(lower(html), lower(substr(trim(b.text), 1, 40)))))::INT) AS rate FROM pages GROUP BY 1", rounded=("rate",))
def l13(spark, sf_dir) -> DataFrame:
    return j10(spark, sf_dir).groupBy((F.col("id") % 10).alias("use_case")).agg(F.avg(F.col("verified").cast("int")).alias("rate"))


_PAPERS = "papers AS (SELECT lang AS attr, CASE WHEN doc_id % 4 <> 0 THEN 'p' || (doc_id // 2) END AS paper_id, substr(text, 1, 30) || doc_id AS title, 1990 + doc_id % 35 AS year, n_chars % 97 AS citations FROM documents)"


@query("k05_ranked_evidence", f"""WITH {_PAPERS}, one AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY attr, coalesce(paper_id, lower(title)) ORDER BY citations DESC, year DESC, title) AS n FROM papers) WHERE n = 1),
pl AS (SELECT attr, paper_id, title, citations >= 60 AS cited, row_number() OVER (PARTITION BY attr ORDER BY CASE WHEN citations >= 60 THEN 0 ELSE 1 END, CASE WHEN citations >= 60 THEN -citations ELSE -year END, CASE WHEN citations >= 60 THEN -year ELSE -citations END, title) AS place FROM one)
SELECT attr, place, paper_id, title, cited FROM pl WHERE place <= 8""")
def k05(spark, sf_dir) -> DataFrame:
    """The eight best sources of each attribute (a top-k report)."""
    d = _t(spark, sf_dir, "documents")
    papers = d.select(F.col("lang").alias("attr"), F.when(F.col("doc_id") % 4 != 0, F.concat(F.lit("p"), F.floor(F.col("doc_id") / 2).cast("string"))).alias("paper_id"), F.concat(F.substring("text", 1, 30), F.col("doc_id").cast("string")).alias("title"), (1990 + F.col("doc_id") % 35).alias("year"), (F.col("n_chars") % 97).alias("citations"))
    return evidence.ranked(papers, ["attr"], 60, 8)


@query("k06_recurrent_failures", "SELECT lower(trim(s)) AS failure, count(*) AS n FROM (SELECT unnest(string_split(text, '. ')) AS s FROM conversations) GROUP BY 1 HAVING count(*) >= 2 ORDER BY n DESC, failure LIMIT 10")
def k06(spark, sf_dir) -> DataFrame:
    """The ten commonest recurrent statements (a top-k report)."""
    said = _t(spark, sf_dir, "conversations").select(F.explode(F.split("text", r"\. ")).alias("s"))
    return frequent.commonest(said.select(F.lower(F.trim("s")).alias("failure")), "failure", 10)


@query("k07_best_run", f"WITH {RECORDS_SQL}, r AS (SELECT dataset, attribute, avg(total_score) FILTER (cycle = 4) AS final, avg(total_score) FILTER (cycle = 3) AS validation FROM audit_records GROUP BY 1, 2), b AS (SELECT dataset, first(attribute ORDER BY final DESC, attribute) AS best, max(final) AS final, first(validation ORDER BY final DESC, attribute) AS v FROM r WHERE final IS NOT NULL GROUP BY 1) SELECT dataset, best, final, coalesce(v >= final, FALSE) AS promoted FROM b", rounded=("final",))
def k07(spark, sf_dir) -> DataFrame:
    on = lambda c: F.avg(F.when(F.col("cycle") == c, F.col("total_score")))
    runs = views.records(spark, sf_dir).groupBy("dataset", "attribute").agg(on(4).alias("final"), on(3).alias("validation")).where("final IS NOT NULL")
    order = F.struct(-F.col("final"), F.col("attribute"))
    return runs.groupBy("dataset").agg(F.min_by("attribute", order).alias("best"), F.max("final").alias("final"), F.min_by("validation", order).alias("v")).select("dataset", "best", "final", F.coalesce(F.col("v") >= F.col("final"), F.lit(False)).alias("promoted"))


@query("x10_cause_labels", f"WITH {RECORDS_SQL}, c AS (SELECT record_id, lower(text || CASE record_id % 3 WHEN 0 THEN ' Unequal odds and Proxy discrimination' WHEN 1 THEN ' historical / label bias' ELSE '' END) AS t FROM audit_records) SELECT record_id, array_to_string(list_sort(list_filter([{', '.join(f'CASE WHEN contains(t, {chr(39)}{p}{chr(39)}) THEN {chr(39)}{v}{chr(39)} END' for p, v in diagnose.CAUSE_LABELS.items())}], lambda x: x IS NOT NULL)), ',') AS labels FROM c")
def x10(spark, sf_dir) -> DataFrame:
    more = F.element_at(F.array(F.lit(" Unequal odds and Proxy discrimination"), F.lit(" historical / label bias"), F.lit("")), (F.col("record_id") % 3 + 1).cast("int"))
    return views.records(spark, sf_dir).select("record_id", F.array_join(diagnose.cause_labels(F.concat("text", more)), ",").alias("labels"))


_RAW = "'Sure: ```json' || chr(10) || '{\"severity\": \"' || severity || '\", \"n\": ' || output_tokens || '}' || chr(10) || '``` done'"


@query("x12_fenced_json", f"WITH {RECORDS_SQL}, j AS (SELECT record_id, regexp_extract(regexp_replace(regexp_replace({_RAW}, '```(?:json)?', '', 'g'), '[\\x00-\\x1f]+', ' ', 'g'), '(\\{{.*\\}})', 1) AS json FROM audit_records) SELECT record_id, json_extract_string(json, '$.severity') AS severity, CAST(json_extract_string(json, '$.n') AS BIGINT) AS n FROM j")
def x12(spark, sf_dir) -> DataFrame:
    raw = F.concat(F.lit('Sure: ```json\n{"severity": "'), F.col("severity"), F.lit('", "n": '), F.col("output_tokens").cast("string"), F.lit("}\n``` done"))
    got = F.from_json(R.fenced_json(raw), "severity string, n long")
    return views.records(spark, sf_dir).select("record_id", got.alias("j")).select("record_id", "j.severity", "j.n")


@query("x13_markdown_sections", f"WITH {RECORDS_SQL} SELECT record_id, 1 AS number, attribute AS title, {_SEV.replace('severity', 'nullif(regexp_extract(severity, chr(94) || chr(91) || chr(65) || chr(45) || chr(90) || chr(97) || chr(45) || chr(122) || chr(93) || chr(42)), chr(0))')} AS severity FROM audit_records")
def x13(spark, sf_dir) -> DataFrame:
    page = F.concat(F.lit("# Report\n---\n## "), F.col("attribute"), F.lit("\n**Severity:** "), F.col("severity"), F.lit("\nwords"))
    return R.sections(views.records(spark, sf_dir).select("record_id", page.alias("page")), "record_id", "page")


@query("x13_several_sections", f"WITH {RECORDS_SQL}, u AS (SELECT record_id, attribute, dataset, {_SEV.replace('severity', 'nullif(regexp_extract(severity, chr(94) || chr(91) || chr(65) || chr(45) || chr(90) || chr(97) || chr(45) || chr(122) || chr(93) || chr(42)), chr(0))')} AS sev FROM audit_records) SELECT record_id, 1 AS number, attribute AS title, sev AS severity FROM u UNION ALL SELECT record_id, 2, dataset || ' as a whole', 'HIGH' FROM u UNION ALL SELECT record_id, 3, 'Notes', 'UNKNOWN' FROM u")
def x13_several(spark, sf_dir) -> DataFrame:
    """Pages with a section for the attribute, one for the data set and one without a severity."""
    page = F.concat(F.lit("# Report\n---\n## "), F.col("attribute"), F.lit("\n**Severity:** "), F.col("severity"), F.lit("\nwords\n\n---\n## "), F.col("dataset"), F.lit(" as a whole\nSeverity: High\n- more\n---\n## Notes\nnothing else"))
    return R.sections(views.records(spark, sf_dir).select("record_id", page.alias("page")), "record_id", "page")


@query("x21_numeric_leaves", f"WITH m AS ({audits.ORACLE_SQL['a07_attribute_metrics']}), b AS ({audits.ORACLE_SQL['a12_group_breakdown']}), u AS (SELECT attribute, di AS v FROM m UNION ALL SELECT attribute, dpd FROM m UNION ALL SELECT attribute, eod FROM m UNION ALL SELECT attribute, aod FROM m UNION ALL SELECT attribute, n FROM b UNION ALL SELECT attribute, selection_rate FROM b) SELECT attribute, v AS value FROM u WHERE v IS NOT NULL")
def x21(spark, sf_dir) -> DataFrame:
    rows = R.context_payload(audits.a07(spark, sf_dir), audits.a12(spark, sf_dir))
    return rows.select("attribute", F.explode(R.numeric_leaves(F.col("metrics"), ["di", "dpd", "eod", "aod"], F.col("groups"), ["n", "selection_rate"])).alias("value"))


@query("x22_full_text", f"WITH {_PARTS} SELECT record_id, lower(concat_ws(' ', attribute, severity, w1, w2, w3, array_to_string(src, ' '))) AS full_text FROM p")
def x22(spark, sf_dir) -> DataFrame:
    """Attribute, severity, all narrative fields and all sources of a record in one lower-case text."""
    return _results(spark, sf_dir).select("record_id", R.full_text(F.col("result")).alias("full_text"))


@query("x23_citation_line", "SELECT doc_id, array_to_string([source, lang], ', ') || ' | ' || n_chars || ' | ' || 'corpus' || ' | ' || n_chars || ' citations | ' || CASE WHEN length(trim(regexp_replace(text, '\\s+', ' ', 'g'))) > 220 THEN rtrim(substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 217)) || '...' ELSE trim(regexp_replace(text, '\\s+', ' ', 'g')) END AS line FROM documents")
def x23(spark, sf_dir) -> DataFrame:
    return _t(spark, sf_dir, "documents").select("doc_id", evidence.citation_line(F.array("source", "lang"), F.col("n_chars"), F.lit("corpus"), F.col("n_chars"), F.col("text")).alias("line"))


@query("x24_flattened_evidence", "SELECT conv_id, turn, role FROM conversations")
def x24(spark, sf_dir) -> DataFrame:
    """Turns nested twice by conversation and role, and flattened again."""
    by_role = _t(spark, sf_dir, "conversations").groupBy("conv_id", "role").agg(F.collect_list("turn").alias("turns"))
    nested = by_role.groupBy("conv_id").agg(F.collect_list(F.transform("turns", lambda t: F.struct(t.alias("turn"), F.col("role").alias("role")))).alias("all"))
    return nested.select("conv_id", F.inline(F.flatten("all")))


@query("x09_formatted", f"SELECT attribute, coalesce(printf('%.4f', di), '--') AS di FROM ({audits.ORACLE_SQL['a07_attribute_metrics']})")
def x09(spark, sf_dir) -> DataFrame:
    return audits.a07(spark, sf_dir).select("attribute", F.coalesce(F.format_string("%.4f", "di"), F.lit("--")).alias("di"))


@query("l26_bibliography_checks", """WITH e AS (SELECT 'k' || (doc_id // 3) AS key, CASE doc_id % 2 WHEN 0 THEN 'article' ELSE 'book' END AS type, CASE WHEN doc_id % 5 <> 0 THEN substr(text, 1, 20) END AS title, CASE WHEN doc_id % 7 = 0 THEN 'TODO year' ELSE source END AS year FROM documents)
SELECT key, 'duplicate key' AS problem FROM e GROUP BY 1 HAVING count(*) > 1 UNION ALL SELECT key, 'missing title' FROM e WHERE trim(coalesce(title, '')) = '' UNION ALL SELECT key, 'missing publisher' FROM e WHERE type = 'book' UNION ALL SELECT key, 'placeholder' FROM e WHERE regexp_matches(coalesce(title, ''), '(?i)\\b(todo|tbd|xxx|placeholder)\\b') OR regexp_matches(year, '(?i)\\b(todo|tbd|xxx|placeholder)\\b')""")
def l26(spark, sf_dir) -> DataFrame:
    d, i = _t(spark, sf_dir, "documents"), F.col("doc_id")
    fields = F.map_from_arrays(F.array(F.lit("title"), F.lit("year")), F.array(F.coalesce(F.when(i % 5 != 0, F.substring("text", 1, 20)), F.lit("")), F.when(i % 7 == 0, "TODO year").otherwise(F.col("source"))))
    entries = d.select(F.concat(F.lit("k"), F.floor(i / 3).cast("string")).alias("key"), F.when(i % 2 == 0, "article").otherwise("book").alias("type"), fields.alias("fields"))
    return evidence.bibliography_problems(entries, {"article": ["title"], "book": ["title", "publisher"]})
