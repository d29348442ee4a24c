"""Queries: gates, criteria and scores of whole audits, strategies, literature searches, bibliography status."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.operators import diagnose, evidence, scoring
from auditspark.operators import records as R
from auditspark.plans import audits as plans_audits
from auditspark.plans import records as plans_records
from auditspark.plans import views
from auditspark.plans.records import _BASE, _NORM, _PARTS, _TITLE, _TT
from auditspark.plans.views import RECORDS_SQL

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

#: What the derived audits say besides their texts: reasons and remedies by number of the conversation.
_WHY = ("", " Proxy discrimination and unequal odds; selection rate 0.1234 of each loan applicant.", " Representation bias: the borrower and the lender, a small sample, not causal, an approval decision.")
_FIX = (" Apply Re-weighing until the gap is below 5 %.", " Use the Threshold-Optimizer–sweep with target 0.85, and report how the gap between the groups moved in the end.", " Equalized-odds post-processing.", " Reduce the gap by equalized odds.", "")
_SUMMARY = ("As an AI language model I cannot determine this.", "The regulator and the auditor see residual confounding.", "")
_SPEC_WHY = ("", "Statistical power is limited.")
_LABELS = {"sex": ["representation_bias", "unequal_odds"], "race": ["proxy_discrimination"], "age": []}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def _quoted(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _pick(n, values):
    return F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))


def _entries(spark, sf_dir) -> DataFrame:
    """Assistant turns as entries of their conversation's audit: whole texts by thirds, reasons and remedies added."""
    third = F.floor((F.length("text") + 2) / 3).cast("int")
    part = lambda k: F.substr(F.col("text"), third * k + 1, third)
    audit, position = F.floor(F.col("record_id") / 1000), F.col("record_id") % 1000
    why = F.concat(part(1), _pick((audit + F.floor(position / 2)) % 3, _WHY))
    fix = F.concat(part(2), _pick(F.when(position % 4 == 3, audit).otherwise(audit + audit % 2) % 5, _FIX))
    sources = F.when(F.col("record_id") % 7 == 1, F.array().cast("array<string>")).otherwise(F.split("text", r"\. "))
    result = F.struct("attribute", "severity", part(0).alias("what_is_wrong"), why.alias("why_is_wrong"), fix.alias("how_to_fix"), sources.alias("supporting_research"))
    return views.records(spark, sf_dir).select(audit.alias("audit"), position.alias("position"), result.alias("result"))


def _audits(spark, sf_dir) -> DataFrame:
    """One row a conversation, with a summary, and a specification for two of three."""
    c = F.col("audit")
    some = lambda n, what: F.slice(F.array(*[F.lit(f"{what} {k}") for k in range(6)]), 1, n.cast("int"))
    spec = F.struct(F.lit("plan").alias("name"), some(c % 6, "metric").alias("core_metrics"), some(c % 5, "element").alias("required_response_elements"), _pick(c % 2, _SPEC_WHY).alias("why_this_spec"), some(c % 4, "source").alias("supporting_research"))
    rows = views.records(spark, sf_dir).select(F.floor(F.col("record_id") / 1000).alias("audit"), "dataset").distinct()
    return rows.select("audit", "dataset", _pick(c % 3, _SUMMARY).alias("summary"), F.when(c % 3 != 0, spec).alias("spec"))


def _baseline(spark, sf_dir) -> DataFrame:
    labels = F.create_map(*[x for a, v in _LABELS.items() for x in (F.lit(a), F.array(*map(F.lit, v)).cast("array<string>"))])
    return plans_records._base(spark, sf_dir).select("dataset", "attribute", F.col("baseline").alias("severity"), labels[F.col("attribute")].alias("labels"))


_ENTRIES = f"""{RECORDS_SQL}, third AS (SELECT *, (length(text) + 2) // 3 AS t, record_id // 1000 AS audit, record_id % 1000 AS position FROM audit_records),
entries AS (SELECT audit, position, record_id, dataset, attribute, severity, substr(text, 1, t) AS what, substr(text, t + 1, t) || {_quoted(_WHY)}[(audit + position // 2) % 3 + 1] AS why,
 substr(text, 2 * t + 1) || {_quoted(_FIX)}[(CASE WHEN position % 4 = 3 THEN audit ELSE audit + audit % 2 END) % 5 + 1] AS fix, CASE WHEN record_id % 7 = 1 THEN [] ELSE string_split(text, '. ') END AS src FROM third),
audits AS (SELECT DISTINCT audit, dataset, {_quoted(_SUMMARY)}[audit % 3 + 1] AS summary, CASE WHEN audit % 3 <> 0 THEN {_quoted(_SPEC_WHY)}[audit % 2 + 1] END AS spec_why FROM third)"""


def _any(text: str, words) -> str:
    return "(" + " OR ".join("contains({}, '{}')".format(text, w.replace("'", "''")) for w in words) + ")"


_TEXT = "lower(concat_ws(' ', what, why, fix, array_to_string(src, ' ')))"
_TARGETED = f"regexp_matches(fix, '{scoring.TARGET}')"
_FOLDED = "regexp_replace(lower(fix), '[\\s\\-‐-―]+', ' ', 'g')"
_COUNTED = lambda groups: " + ".join(f"bool_or({_any('text', words)})::INT" for words in groups)
_GATES = f"""{_ENTRIES}, said AS (SELECT audit, {_TEXT} AS text, what <> '' AND why <> '' AND fix <> '' AND len(src) > 0 AS g2, len(src) >= 1 AS g3, {_any(_FOLDED, scoring.VOCABULARY)} AS g4, {_TARGETED} AS g5,
 {_any(_TEXT, scoring.CONTEXT)} AS h2, {_any(_TEXT, scoring.METRICS)} OR regexp_matches({_TEXT}, '\\d\\.\\d{{3,}}') OR len(src) > 0 AS h3, {_TARGETED} AND length(fix) > 80 AS h4 FROM entries
 UNION ALL SELECT audit, lower(concat_ws(' ', summary, coalesce(spec_why, ''))), NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM audits),
gates AS (SELECT audit, NOT bool_or({_any('text', scoring.FORBIDDEN)}) AS g1, coalesce(bool_and(g2), TRUE) AS g2, coalesce(bool_and(g3), TRUE) AS g3, coalesce(bool_and(g4), TRUE) AS g4, coalesce(bool_and(g5), TRUE) AS g5,
 {_COUNTED([[w] for w in scoring.STAKEHOLDERS])} >= 2 AS h1, coalesce(bool_and(h2), TRUE) AS h2, coalesce(bool_and(h3), TRUE) AS h3, coalesce(bool_and(h4), TRUE) AS h4, {_COUNTED(scoring.LIMITS.values())} >= 2 AS h5 FROM said GROUP BY 1)"""


def _gates(spark, sf_dir) -> DataFrame:
    return scoring.gates(_entries(spark, sf_dir), _audits(spark, sf_dir), "audit")


@query("l11_guardrail_gates", f"WITH {_GATES} SELECT audit, g1, g2, g3, g4, g5 FROM gates")
def l11(spark, sf_dir) -> DataFrame:
    return _gates(spark, sf_dir).select("audit", *scoring.GATES)


@query("l12_criteria", f"WITH {_GATES} SELECT audit, h1, h2, h3, h4, h5 FROM gates")
def l12(spark, sf_dir) -> DataFrame:
    return _gates(spark, sf_dir).select("audit", *scoring.CRITERIA)


_PASSED = lambda names: " + ".join(f"sum({n}::INT)::BIGINT" for n in names)


@query("l14_gate_counts", f"WITH {_GATES} SELECT dataset, count(*) AS audits, {_PASSED(scoring.GATES)} AS gates_passed, {_PASSED(scoring.CRITERIA)} AS criteria_passed FROM gates JOIN audits USING (audit) GROUP BY 1")
def l14(spark, sf_dir) -> DataFrame:
    return scoring.gate_counts(_gates(spark, sf_dir).join(_audits(spark, sf_dir).select("audit", "dataset"), "audit"), "dataset")


_BROKEN = f"""{_ENTRIES}, broken AS (SELECT audit, position, attribute, unnest([CASE WHEN what = '' THEN 'missing field what_is_wrong' END, CASE WHEN why = '' THEN 'missing field why_is_wrong' END, CASE WHEN fix = '' THEN 'missing field how_to_fix' END,
 CASE WHEN len(src) = 0 THEN 'missing field supporting_research' END, {', '.join(f"CASE WHEN contains(lower(fix), '{p}') THEN 'forbidden pattern ''{p}''' END" for p in scoring.FORBIDDEN)}, CASE WHEN len(src) < 1 THEN 'insufficient supporting_research' END,
 CASE WHEN NOT {_any('lower(fix)', scoring.KEYWORDS)} THEN 'mitigation lacks required algorithm keyword' END, CASE WHEN NOT {_any('lower(fix)', scoring.MEASURABLE)} THEN 'mitigation not measurable' END]) AS v FROM entries)"""


@query("l15_violations", f"WITH {_BROKEN} SELECT audit, position, attribute || ': ' || v AS violation FROM broken WHERE v IS NOT NULL")
def l15_violations(spark, sf_dir) -> DataFrame:
    return scoring.violations(_entries(spark, sf_dir), "audit")


@query("l15_compliance", f"WITH {_BROKEN} SELECT audit, count(v) AS n_violations, greatest(0.0::DOUBLE, 100.0 - 10.0 * count(v)::DOUBLE) AS compliance FROM broken GROUP BY 1")
def l15(spark, sf_dir) -> DataFrame:
    return scoring.compliance(_entries(spark, sf_dir), _audits(spark, sf_dir), "audit")


@query("l16_rubric_score", f"WITH {RECORDS_SQL} SELECT record_id, round({' + '.join(f'coalesce(nullif((output_tokens + {k}) % 6, 0) * {w}::DOUBLE, 0)' for k, w in enumerate(scoring.RUBRIC.values()))}, 3) AS weighted FROM audit_records")
def l16_rubric(spark, sf_dir) -> DataFrame:
    """Judge's scores of 1 to 5 by dimension, some missing, weighted."""
    score = lambda k: F.nullif(((F.col("output_tokens") + k) % 6).cast("double"), F.lit(0.0))
    scores = F.create_map(*[x for k, d in enumerate(scoring.RUBRIC) for x in (F.lit(d), score(k))])
    return views.records(spark, sf_dir).select("record_id", scoring.rubric_score(scores).alias("weighted"))


_EXPECTED = "CASE attribute " + " ".join(f"WHEN '{a}' THEN {_quoted(v)}::VARCHAR[]" for a, v in _LABELS.items()) + " END"
_PLAIN_FIX = "replace(replace(lower(fix), '-', ''), '_', '')"
_SINGLE = "(CASE WHEN attribute <> '' THEN 4 ELSE 0 END + CASE WHEN length(what) >= 100 THEN 8 ELSE 0 END + CASE WHEN what <> '' AND why <> '' AND fix <> '' AND severity <> '' THEN 8 ELSE 0 END + CASE WHEN length(why) >= 100 THEN 5 ELSE 0 END + CASE WHEN len(src) >= 2 THEN 5 ELSE 0 END)"


@query("l06_audit_scores", f"""WITH {_ENTRIES}, {_BASE}, want AS (SELECT dataset, attribute, {_NORM.format('baseline')} AS want, {_EXPECTED} AS labels FROM base),
expected AS (SELECT dataset, count(*) AS n_base, sum(len(labels)) AS n_labels FROM want GROUP BY 1),
f AS (SELECT audit, attribute, arg_max({_NORM.format('severity')}, position) AS got, arg_max(lower(why), position) AS why, arg_max({_any(_PLAIN_FIX, R.ALGORITHMS)}, position) AS named, arg_max(len(src) > 0, position) AS cited FROM entries GROUP BY 1, 2),
first AS (SELECT audit, arg_min({_SINGLE}, position) AS points FROM entries GROUP BY 1),
own AS (SELECT audit, count(*) AS n, sum(named::INT) AS named, sum(cited::INT) AS cited FROM f GROUP BY 1),
met AS (SELECT a.audit, count(f.attribute) AS covered, sum((coalesce(f.got, 'UNKNOWN') = want)::INT) AS same, sum(len(list_filter(labels, lambda x: contains(coalesce(f.why, ''), replace(x, '_', ' '))))) AS hits FROM audits a JOIN want USING (dataset) LEFT JOIN f ON f.audit = a.audit AND f.attribute = want.attribute GROUP BY 1),
parts AS (SELECT audit, least(40.0::DOUBLE, CASE WHEN audit % 3 <> 0 THEN 4 + CASE WHEN audit % 6 >= 4 THEN 8 ELSE 0 END + CASE WHEN audit % 5 >= 4 THEN 8 ELSE 0 END + CASE WHEN spec_why <> '' THEN 5 ELSE 0 END + CASE WHEN audit % 4 >= 2 THEN 5 ELSE 0 END ELSE points END + CASE WHEN coalesce(covered, 0) = coalesce(n_base, 0) THEN 10 ELSE 0 END) AS completeness,
 coalesce(20.0::DOUBLE * same / n_base, 0) AS severity_agreement, CASE WHEN n_base IS NULL THEN 0.0::DOUBLE WHEN n_labels = 0 THEN 10.0::DOUBLE ELSE 15.0::DOUBLE * hits / n_labels END AS cause_alignment, 15.0::DOUBLE * named / n AS mitigation,
 10.0::DOUBLE * cited / n + CASE WHEN audit % 3 <> 0 AND audit % 4 >= 2 THEN 5 ELSE 0 END AS grounding FROM audits LEFT JOIN expected USING (dataset) LEFT JOIN met USING (audit) JOIN own USING (audit) JOIN first USING (audit)),
total AS (SELECT *, completeness + severity_agreement + cause_alignment + mitigation + grounding AS total FROM parts)
SELECT audit, {', '.join(f'round({c}, 2) AS {c}' for c in ('completeness', 'severity_agreement', 'cause_alignment', 'mitigation', 'grounding', 'total'))},
 printf('Total score: %.1f/100. Completeness=%.1f, Severity agreement=%.1f, Cause alignment=%.1f, Mitigation specificity=%.1f, Research grounding=%.1f.', total, completeness, severity_agreement, cause_alignment, mitigation, grounding) AS summary FROM total""")
def l06_audits(spark, sf_dir) -> DataFrame:
    """Subscores L1-L5, total and summary of whole audits."""
    return scoring.audit_scores(_entries(spark, sf_dir), _audits(spark, sf_dir), _baseline(spark, sf_dir), "audit")


_QUOTED = "text || CASE WHEN record_id % 3 = 0 THEN ' 0.81 77.7' ELSE ' 0.8' END"


@query("l19_strategy_rates", f"""WITH {_PARTS}, {_BASE}, k AS (SELECT r.record_id, phrase OR missing OR brief OR odd AS refused, CASE WHEN phrase OR missing OR odd THEN 'genuine' WHEN brief THEN 'brevity_only' END AS kind FROM ref r),
q AS (SELECT record_id, cycle, total_score, severity, baseline, kind, refused_ AS refused, len(list_filter(list_transform(regexp_extract_all({_QUOTED}, '-?\\d+\\.\\d+'), lambda x: x::DOUBLE), lambda x: NOT list_bool_or(list_transform([{', '.join(map(str, R.ANCHORS))}], lambda a: abs(x - a) <= 5e-4)))) AS n_flags
 FROM audit_records JOIN (SELECT record_id, refused AS refused_, kind FROM k) USING (record_id) LEFT JOIN base USING (dataset, attribute)),
g AS (SELECT cycle, count(*) AS n, avg(total_score) AS mean, min(total_score) AS least, max(total_score) AS most, count(*) FILTER (refused) AS refusals, count(*) FILTER (kind = 'genuine') AS genuine, count(*) FILTER (kind = 'brevity_only') AS brevity_only,
 count(*) FILTER (n_flags > 0) AS hallucinated, sum(n_flags)::BIGINT AS flags, count(*) FILTER (trim(severity) <> '' AND {_NORM.format('severity')} = {_NORM.format('baseline')} AND baseline IS NOT NULL) AS agreeing FROM q GROUP BY 1)
SELECT cycle, n, round(mean, 6) AS mean, least, most, refusals, genuine, brevity_only, hallucinated, flags, round(refusals / n, 4) AS refusal_rate, round(genuine / n, 4) AS genuine_rate, round(hallucinated / n, 4) AS hallucination_rate, round(agreeing / n, 4) AS agreement_rate FROM g""")
def l19(spark, sf_dir) -> DataFrame:
    said, result = F.concat("text", F.when(F.col("record_id") % 3 == 0, " 0.81 77.7").otherwise(" 0.8")), F.col("result")
    refused = R.refused(result, F.col("text"))
    rows = plans_records._results(spark, sf_dir).join(plans_records._base(spark, sf_dir), ["dataset", "attribute"], "left")
    scores = F.col("total_score")
    rows = rows.select("cycle", "severity", "baseline", scores, refused.alias("refused"), R.refusal_kind(refused, result, F.col("text")).alias("kind"), F.size(R.foreign_values(said, F.array().cast("array<double>"))).cast("long").alias("n_flags"))
    return scoring.strategy_rates(rows).withColumn("mean", F.round("mean", 6))


_CAUSE_TEXTS = ("Historical / label bias; a strong proxy", "imbalance of groups", "")
_FIX_TEXTS = ("Reweighing", "ThresholdOptimizer or equalized odds", "Prejudice Remover", "Disparate Impact Remover", "")
_SEEDS = {"se": ["10.1/a", "10.1/b"], "ace": ["10.1/b", "10.1/c"], "age": ["10.1/d"]}
_GENERAL = ("10.1/a", "10.1/z")


def _asked(text: str, rules) -> str:
    return ", ".join(f"CASE WHEN {_any(text, words)} THEN '{s}' END" for words, s in rules)


@query("x19_query_selection", f"""WITH {RECORDS_SQL}, t AS (SELECT record_id, dataset, attribute, lower({_quoted(_CAUSE_TEXTS)}[record_id % 3 + 1]) AS c, lower({_quoted(_FIX_TEXTS)}[record_id % 5 + 1]) AS f FROM audit_records),
q AS (SELECT record_id, unnest([dataset || ' fairness ' || attribute || ' bias mitigation', attribute || ' proxy discrimination machine learning fairness', {_asked('c', scoring.CAUSE_SEARCHES)}, {_asked('f', scoring.FIX_SEARCHES)}]) AS query FROM t) SELECT * FROM q WHERE query IS NOT NULL""")
def x19(spark, sf_dir) -> DataFrame:
    n = F.col("record_id")
    asked = scoring.searches(F.col("dataset"), F.col("attribute"), _pick(n % 3, _CAUSE_TEXTS), _pick(n % 5, _FIX_TEXTS))
    return views.records(spark, sf_dir).select("record_id", F.explode(asked).alias("query"))


@query("x19_default_queries", f"""WITH {RECORDS_SQL}, a AS (SELECT dataset, array_to_string(list_sort(list(DISTINCT attribute))[1:3], ', ') AS named FROM audit_records GROUP BY 1),
q AS (SELECT dataset, unnest([{', '.join(repr(x) for x in scoring.DEFAULT_SEARCHES)}, dataset || ' fairness bias mitigation ' || named]) AS query, unnest([1, 2, 3, 4]) AS place FROM a) SELECT dataset, place::INT AS place, query FROM q""")
def x19_defaults(spark, sf_dir) -> DataFrame:
    """The searches that every data set starts with, in order and each once."""
    from auditspark.operators import quality

    sets = views.records(spark, sf_dir).groupBy("dataset").agg(F.array_sort(F.collect_set("attribute")).alias("attributes"))  # few attributes
    asked = sets.select("dataset", F.posexplode(scoring.default_searches(F.col("dataset"), F.col("attributes"))).alias("at", "query"))
    return quality.ordered_distinct(asked, ["dataset"], "query", "at")


@query("x19_seed_selection", f"""WITH {RECORDS_SQL}, t AS (SELECT record_id, unnest(list_concat({', '.join(f"CASE WHEN contains(attribute, '{k}') THEN {_quoted(v)} ELSE [] END" for k, v in _SEEDS.items())}, {_quoted(_GENERAL)})) AS doi FROM audit_records) SELECT DISTINCT record_id, doi FROM t""")
def x19_seeds(spark, sf_dir) -> DataFrame:
    return views.records(spark, sf_dir).select("record_id", F.explode(scoring.seeds(F.col("attribute"), _SEEDS, _GENERAL)).alias("doi"))


@query("x20_context_payload", f"""WITH m AS ({plans_audits.ORACLE_SQL['a07_attribute_metrics']}), b AS ({plans_audits.ORACLE_SQL['a12_group_breakdown']})
SELECT m.attribute, m.di, m.dpd, b."group", b.n, b.selection_rate FROM m LEFT JOIN b USING (attribute)""")
def x20(spark, sf_dir) -> DataFrame:
    """The nested context of each attribute as JSON, read back into one row a group."""
    rows = R.context_payload(plans_audits.a07(spark, sf_dir), plans_audits.a12(spark, sf_dir)).select("attribute", "payload")
    back = F.from_json("payload", "struct<attribute:string,metrics:struct<di:double,dpd:double>,groups:array<struct<`group`:string,n:bigint,selection_rate:double>>>")
    return rows.select(back.alias("p")).select("p.attribute", "p.metrics.di", "p.metrics.dpd", F.explode_outer("p.groups").alias("g")).select("attribute", "di", "dpd", "g.*")


@query("l26_resolution_status", f"""WITH p AS (SELECT page_id AS i, {_TITLE} AS title, '10.5/' || page_id AS doi FROM pages WHERE html IS NOT NULL),
e AS (SELECT 'p' || i AS key, title, CASE WHEN i % 4 <> 3 THEN doi ELSE '' END AS doi, i % 11 = 0 AS attested, i FROM p),
r AS (SELECT doi, CASE i % 3 WHEN 0 THEN title || ' extended' WHEN 1 THEN title ELSE 'Another work about cooking' END AS title FROM p WHERE i % 5 <> 0),
s AS (SELECT *, CASE WHEN attested THEN 'attested' WHEN i % 12 = 0 AND doi <> '' THEN 'cached' END AS status FROM e),
f AS (SELECT array_to_string({_TT.format('title')}, ' ') AS tokens, first(title ORDER BY doi, title) AS title FROM r GROUP BY 1 HAVING array_to_string({_TT.format('any_value(title)')}, ' ') <> ''),
j AS (SELECT s.key, s.status, s.title, CASE WHEN s.doi <> '' THEN r.title ELSE f.title END AS found FROM s LEFT JOIN r ON s.doi = r.doi LEFT JOIN f ON array_to_string({_TT.format('s.title')}, ' ') = f.tokens),
k AS (SELECT key, status, found, {_TT.format('title')} AS a, {_TT.format('found')} AS b FROM j),
l AS (SELECT key, status, found, CASE WHEN len(a) = 0 OR len(b) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(a, b))::DOUBLE / least(len(a), len(b)) END AS sim FROM k)
SELECT key, coalesce(status, CASE WHEN found IS NULL THEN 'unresolved' WHEN sim < 0.72 THEN 'title_mismatch' ELSE 'verified' END) AS status, CASE WHEN status IS NULL AND found IS NOT NULL THEN round(sim, 3) END AS similarity FROM l""")
def l26_status(spark, sf_dir) -> DataFrame:
    """Pages as bibliography entries, their titles looked up in a registry of altered ones and in a cache."""
    i = F.col("page_id")
    p = spark.read.parquet(f"{sf_dir}/pages.parquet").where("html IS NOT NULL").select("page_id", evidence.html_title(F.col("html")).alias("title"), F.concat(F.lit("10.5/"), i.cast("string")).alias("doi"))
    key = F.concat(F.lit("p"), i.cast("string")).alias("key")
    entries = p.select(key, F.when(i % 4 != 3, F.col("doi")).alias("doi"), "title", F.when(i % 11 == 0, "release of the data").alias("note"))
    registry = p.where("page_id % 5 <> 0").select("doi", F.when(i % 3 == 0, F.concat("title", F.lit(" extended"))).when(i % 3 == 1, F.col("title")).otherwise("Another work about cooking").alias("title"))
    cache = p.where("page_id % 6 = 0").select(key, "doi", (i % 12 == 0).alias("verified"))
    return evidence.resolution_status(entries, cache, registry)


@query("s04_record_scan", f"WITH {RECORDS_SQL} SELECT dataset, attribute, cycle, count(*) AS n, sum(length(text))::BIGINT AS chars FROM audit_records GROUP BY 1, 2, 3")
def s04(spark, sf_dir) -> DataFrame:
    """Records written as JSON by data set and read back by glob."""
    from auditspark.sources import tables
    from auditspark.sources.workspace import folder

    path = folder(spark, "records")
    rows = plans_records._results(spark, sf_dir).select("dataset", "attribute", "cycle", F.struct(F.lit("x").alias("attribute"), F.col("text").alias("what_is_wrong")).alias("result"))
    rows.withColumn("part", F.col("dataset")).write.partitionBy("part").json(path)
    back = tables.read_records(spark, f"{path}/*/*.json", one_a_file=False)
    return back.groupBy("dataset", "attribute", F.col("cycle").cast("long").alias("cycle")).agg(F.count("*").alias("n"), F.sum(F.length("result.what_is_wrong")).alias("chars"))


@query("s11_retained_evidence", """WITH o AS (SELECT DISTINCT lang || doc_id % 50 AS attr FROM documents WHERE doc_id % 3 <> 0), n AS (SELECT lang || doc_id % 50 AS attr, count(*) FILTER (n_chars % 2 = 0) AS live FROM documents GROUP BY 1)
SELECT attr, o.attr IS NOT NULL AND live = 0 AS kept_old FROM n LEFT JOIN o USING (attr)""")
def s11(spark, sf_dir) -> DataFrame:
    """Which keys keep their old evidence: those whose new harvest holds seeds only."""
    from auditspark.sources import tables

    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat("lang", (F.col("doc_id") % 50).cast("string")).alias("attr"), "doc_id", "n_chars")
    live = F.when(F.col("n_chars") % 2 == 0, "api").otherwise("doi_seed")
    papers = lambda df, source: df.groupBy("attr").agg(F.transform(F.collect_set(source), lambda s: F.struct(s.alias("source"))).alias("papers"))
    return tables.retained(papers(d.where("doc_id % 3 <> 0"), F.lit("api")), papers(d, live), "attr").select("attr", "kept_old")


_MERGED = "(SELECT coalesce(o.attr, n.attr) AS attr, CASE WHEN o.src IS NOT NULL AND coalesce(n.src, 'doi_seed') = 'doi_seed' THEN o.src ELSE n.src END AS src FROM {old} o FULL JOIN {new} n ON o.attr = n.attr)"


@query("s11_merged_evidence", f"""WITH d AS (SELECT lang || doc_id % 50 AS attr, doc_id, CASE WHEN n_chars % 2 = 0 THEN 'api' ELSE 'doi_seed' END AS s FROM documents),
t0 AS (SELECT DISTINCT attr, 'first' AS src FROM d WHERE doc_id % 3 <> 0), h1 AS (SELECT attr, string_agg(DISTINCT s, ',' ORDER BY s) AS src FROM d WHERE doc_id % 4 = 1 GROUP BY 1), h2 AS (SELECT attr, string_agg(DISTINCT s || doc_id % 2, ',' ORDER BY s || doc_id % 2) AS src FROM d WHERE doc_id % 7 = 2 AND s = 'api' GROUP BY 1),
t1 AS {_MERGED.format(old='t0', new='h1')}, t2 AS {_MERGED.format(old='t1', new='h2')} SELECT attr, src AS sources, 2::BIGINT AS version FROM t2""")
def s11_merged(spark, sf_dir) -> DataFrame:
    """Evidence written, two harvests merged (each sent twice), and the table read back with its version."""
    from auditspark.sources import tables
    from auditspark.sources.workspace import folder

    d = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.concat("lang", (F.col("doc_id") % 50).cast("string")).alias("attr"), "doc_id", F.when(F.col("n_chars") % 2 == 0, "api").otherwise("doi_seed").alias("s")).where("attr IS NOT NULL")
    papers = lambda df, source: df.groupBy("attr").agg(F.transform(F.array_sort(F.collect_set(source)), lambda s: F.struct(s.alias("source"))).alias("papers"))
    table = tables.EvidenceTable(spark, folder(spark, "evidence"))
    table.create(papers(d.where("doc_id % 3 <> 0"), F.lit("first")), "start")
    harvests = {"first": papers(d.where("doc_id % 4 = 1"), F.col("s")), "second": papers(d.where("doc_id % 7 = 2 AND s = 'api'"), F.concat("s", (F.col("doc_id") % 2).cast("string")))}
    for batch in ("first", "first", "second", "first", "second"):
        table.merge(harvests[batch], batch)
    return table.read().select("attr", F.array_join(F.transform("papers", lambda p: p["source"]), ",").alias("sources"), F.lit(table.version()).cast("long").alias("version"))


@query("d02_cause_labels", f"WITH {plans_audits._CAUSES} SELECT attribute, array_to_string(list_sort(list_filter(causes, lambda x: x <> 'none_detected')), ',') AS labels FROM causes")
def d02_labels(spark, sf_dir) -> DataFrame:
    """Labels found in the text of the causes, as an audit would state them."""
    stated = {label: phrase for phrase, label in diagnose.CAUSE_LABELS.items()}
    phrases = F.create_map(*[x for k, v in stated.items() for x in (F.lit(k), F.lit(v.capitalize()))])
    text = F.array_join(F.transform("causes", lambda c: F.coalesce(F.try_element_at(phrases, c), F.lit(""))), "; ")
    return plans_audits._causes(spark, sf_dir).select("attribute", F.array_join(diagnose.cause_labels(text), ",").alias("labels"))
