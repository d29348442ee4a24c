"""Gates and scores of whole audits that answer for several attributes.

``entries`` has one row an answered attribute: the audit's key, ``position`` (its order in the audit) and the struct
``result`` of ``records``. ``audits`` has one row an audit: key, ``dataset``, ``summary`` and the struct ``spec`` (name,
core_metrics, required_response_elements, why_this_spec, supporting_research), null for answers of a single attribute.
Terms are sought in each entry's and each audit's own text; everything is summed by key, so no audit is collected.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark.functions.scalars import any_contained, severity_label
from auditspark.operators.records import ALGORITHMS, NARRATIVE, completeness, names_algorithm

#: Terms, patterns and numbers of the gates.
FORBIDDEN = ("cannot determine", "insufficient information", "as an ai language model")
REQUIRED = ("what_is_wrong", "why_is_wrong", "how_to_fix", "supporting_research")
KEYWORDS = ("reweighing", "thresholdoptimizer", "equalized odds", "postprocessing", "counterfactual")
VARIANTS = ("re weighing", "reweighting", "disparate impact remover", "disparate impact removal", "prejudice remover", "equalised odds", "eq odds", "calibrated equalized odds", "exponentiated gradient", "threshold optimizer", "threshold sweep", "post processing")
MEASURABLE = ("%", "kpi", "target", "threshold", "reduce", "increase")
TARGET = r"\d+(?:\.\d+)?\s*%|\b0?\.\d+\b|\b\d+(?:\.\d+)?\s*(?:pp|percentage points)\b"
STAKEHOLDERS = ("applicant", "borrower", "loan officer", "underwriter", "compliance", "regulator", "lender", "auditor", "examiner")
CONTEXT = ("decision", "approval", "denial", "reject", "threshold", "underwriting", "credit", "loan", "mortgage", "application", "adverse action", "pricing")
METRICS = ("disparate impact", "demographic parity", "equal opportunity", "average odds", "theil", "selection rate", "di ", "eod", "aod")
LIMITS = {
    "small_sample_or_power": ("small sample", "sample size", "statistical power", "power is inadequate", "only six", "only 6", "few records", "n =", "n=", "underpowered", "one label change", "sensitivity", "unreliable", "insufficient", "degenerate", "trivial classifier", "near-trivial"),
    "non_causal": ("not causal", "non-causal", "no causal", "causal linkage", "correlation", "cannot conclude", "does not establish", "association"),
    "proxy_or_confound": ("proxy", "confound", "unobserved", "residual", "omitted variable"),
}
RUBRIC = {"clarity": 0.2, "actionability": 0.3, "evidence_quality": 0.2, "consistency": 0.15, "non_contradiction": 0.15}
VOCABULARY = tuple(sorted({*KEYWORDS, *ALGORITHMS, *VARIANTS}))
LONG_FIX = 80
GATES = ("g1", "g2", "g3", "g4", "g5")
CRITERIA = ("h1", "h2", "h3", "h4", "h5")


def _field(r: Column, name: str) -> Column:
    return F.coalesce(r[name], F.lit(""))


def _sources(r: Column) -> Column:
    return F.coalesce(F.size(r["supporting_research"]), F.lit(0))


def _filled(r: Column, name: str) -> Column:
    return _sources(r) > 0 if name == "supporting_research" else _field(r, name) != ""


def entry_text(r: Column) -> Column:
    """Narrative fields and sources of an entry in lower case."""
    return F.lower(F.concat_ws(" ", *[_field(r, f) for f in NARRATIVE], r["supporting_research"]))


def hyphens_folded(text: Column) -> Column:
    """Lower case; runs of white space and of hyphens and dashes as one space."""
    return F.regexp_replace(F.lower(text), "(?U)[\\s\\-‐-―]+", " ")


def entry_gates(r: Column, least_sources: int = 1) -> dict[str, Column]:
    """The gates and criteria that every entry has to pass by itself."""
    text, fix = entry_text(r), _field(r, "how_to_fix")
    return {
        "g2": reduce(Column.__and__, [_filled(r, f) for f in REQUIRED]),
        "g3": _sources(r) >= least_sources,
        "g4": any_contained(hyphens_folded(fix), VOCABULARY),
        "g5": fix.rlike(TARGET),
        "h2": any_contained(text, CONTEXT),
        "h3": any_contained(text, METRICS) | text.rlike(r"\d\.\d{3,}") | (_sources(r) > 0),
        "h4": fix.rlike(TARGET) & (F.length(fix) > LONG_FIX),
    }


def gates(entries: DataFrame, audits: DataFrame, key: str, least_sources: int = 1) -> DataFrame:
    """(key, g1 to g5, h1 to h5) for each audit.

    g1 no refusal pattern, g2 all fields, g3 enough sources, g4 a named algorithm, g5 a measurable target; h1 two
    stakeholder roles, h2 decision terms, h3 metric, number or source, h4 target and more than 80 characters, h5 two kinds
    of limits. An audit without entries passes what entries have to pass.
    """
    own = entry_gates(F.col("result"), least_sources)
    rows = entries.select(key, entry_text(F.col("result")).alias("text"), *[c.alias(n) for n, c in own.items()])
    said = F.lower(F.concat_ws(" ", F.coalesce("summary", F.lit("")), F.coalesce(F.col("spec.why_this_spec"), F.lit(""))))
    rows = rows.unionByName(audits.select(key, said.alias("text"), *[F.lit(None).cast("boolean").alias(n) for n in own]))
    seen = lambda words: F.coalesce(F.bool_or(any_contained(F.col("text"), words)), F.lit(False))
    count = lambda groups: sum((seen(words).cast("int") for words in groups), F.lit(0))
    every = {n: F.coalesce(F.bool_and(n), F.lit(True)) for n in own}
    whole = {"g1": ~seen(FORBIDDEN), "h1": count([[w] for w in STAKEHOLDERS]) >= 2, "h5": count(LIMITS.values()) >= 2}
    return rows.groupBy(key).agg(*[(every | whole)[n].alias(n) for n in GATES + CRITERIA])


def gate_counts(table: DataFrame, by: str) -> DataFrame:
    """(by, audits, gates_passed, criteria_passed) of a ``gates`` table."""
    passed = lambda names: sum((F.sum(F.col(n).cast("long")) for n in names), F.lit(0))
    return table.groupBy(by).agg(F.count("*").alias("audits"), passed(GATES).alias("gates_passed"), passed(CRITERIA).alias("criteria_passed"))


def _violations(r: Column, least_sources: int) -> Column:
    fix = F.lower(_field(r, "how_to_fix"))
    found = [F.when(~_filled(r, f), F.lit(f"missing field {f}")) for f in REQUIRED]
    found += [F.when(F.contains(fix, F.lit(p)), F.lit(f"forbidden pattern '{p}'")) for p in FORBIDDEN]
    found += [
        F.when(_sources(r) < least_sources, F.lit("insufficient supporting_research")),
        F.when(~any_contained(fix, KEYWORDS), F.lit("mitigation lacks required algorithm keyword")),
        F.when(~any_contained(fix, MEASURABLE), F.lit("mitigation not measurable")),
    ]
    return F.array_compact(F.array(*found))


def violations(entries: DataFrame, key: str, least_sources: int = 1) -> DataFrame:
    """(key, position, violation): one row for each rule that an entry breaks, named by its attribute."""
    r = F.col("result")
    return entries.select(key, "position", F.coalesce(r["attribute"], F.lit("unknown")).alias("a"), F.explode(_violations(r, least_sources)).alias("v")).select(key, "position", F.concat_ws(": ", "a", "v").alias("violation"))


def compliance(entries: DataFrame, audits: DataFrame, key: str, least_sources: int = 1) -> DataFrame:
    """(key, n_violations, compliance): 100 less 10 a violation, 0 at least."""
    rows = entries.select(key, F.size(_violations(F.col("result"), least_sources)).cast("long").alias("n")).unionByName(audits.select(key, F.lit(0).cast("long").alias("n")))
    n = F.sum("n")
    return rows.groupBy(key).agg(n.alias("n_violations"), F.greatest(F.lit(0.0), 100.0 - 10.0 * n).alias("compliance"))


def rubric_score(scores: Column, weights: Mapping[str, float] = RUBRIC) -> Column:
    """Weighted sum of a map of judge's scores; dimensions without a score count nothing."""
    return F.bround(sum((F.coalesce(F.try_element_at(scores, F.lit(d)).cast("double") * w, F.lit(0.0)) for d, w in weights.items()), F.lit(0.0)), 3)


def spec_points(s: Column) -> Column:
    """Points of an audit's specification, 30 at most: name 4, four metrics 8, four response elements 8, reason 5, two sources 5."""
    point = lambda cond, n: F.when(F.coalesce(cond, F.lit(False)), float(n)).otherwise(0.0)
    return point(s["name"] != "", 4) + point(F.size(s["core_metrics"]) >= 4, 8) + point(F.size(s["required_response_elements"]) >= 4, 8) + point(s["why_this_spec"] != "", 5) + point(F.size(s["supporting_research"]) >= 2, 5)


def summary_text(total: Column, parts: Mapping[str, Column]) -> Column:
    one = lambda c: F.format_string("%.1f", F.bround(c, 1))
    named = [F.concat(F.lit(f"{name}="), one(c)) for name, c in parts.items()]
    return F.concat(F.lit("Total score: "), one(total), F.lit("/100. "), F.array_join(F.array(*named), ", "), F.lit("."))


def audit_scores(entries: DataFrame, audits: DataFrame, baseline: DataFrame, key: str) -> DataFrame:
    """(key, completeness, severity_agreement, cause_alignment, mitigation, grounding, total, summary) of each audit.

    ``baseline`` has dataset, attribute (once a dataset), severity and labels (array). Of entries with one attribute the
    last counts; an expected attribute without entry has the severity UNKNOWN. Without a baseline severity and causes
    score 0, with one without labels causes score 10. With a specification the total may reach 105.
    """
    r = F.col("result")
    base = baseline.select("dataset", "attribute", severity_label(F.col("severity")).alias("want"), F.coalesce("labels", F.array().cast("array<string>")).alias("labels"))
    unknown = F.col("want") == "UNKNOWN"
    expected = base.groupBy("dataset").agg(F.count("*").alias("n_base"), F.sum(F.size("labels")).alias("n_labels"), F.count_if(unknown).alias("n_unknown"))
    rows = entries.join(audits.select(key, "dataset"), key).withColumn("attribute", r["attribute"]).join(base, ["dataset", "attribute"], "left")
    why = F.lower(_field(r, "why_is_wrong"))
    hits = F.coalesce(F.size(F.filter("labels", lambda x: F.contains(why, F.replace(x, F.lit("_"), F.lit(" "))))), F.lit(0))
    facts = F.struct(
        F.col("want").isNotNull().cast("int").alias("based"), F.coalesce((severity_label(r["severity"]) == F.col("want")).cast("int"), F.lit(0)).alias("match"), F.coalesce(unknown.cast("int"), F.lit(0)).alias("unknown"),
        hits.alias("hits"), names_algorithm(r["how_to_fix"]).cast("int").alias("named"), (_sources(r) > 0).cast("int").alias("cited"),
    )
    last = rows.select(key, "attribute", "position", facts.alias("f"), completeness(r).alias("c")).groupBy(key, "attribute").agg(F.max_by("f", "position").alias("f"), F.min(F.struct("position", "c")).alias("first"))
    answered = F.col("attribute").isNotNull()
    total = lambda name: F.sum(F.when(answered, F.col(f"f.{name}")))
    got = last.groupBy(key).agg(F.count_if(answered).alias("n"), F.min("first")["c"].alias("first"), *[total(x).alias(x) for x in ("based", "match", "unknown", "hits", "named", "cited")])
    t = audits.select(key, "dataset", "spec").join(expected, "dataset", "left").join(got, key, "left").na.fill(0, ["n_base", "n_labels", "n_unknown", "n", "first", "based", "match", "unknown", "hits", "named", "cited"])
    c, share = F.col, lambda points, a, b: F.coalesce(F.try_divide(points * a, b.cast("double")), F.lit(0.0))
    parts = {
        "completeness": F.least(F.lit(40.0), F.when(c("spec").isNotNull(), spec_points(c("spec"))).otherwise(c("first")) + F.when(c("based") == c("n_base"), 10.0).otherwise(0.0)),
        "severity_agreement": share(F.lit(20.0), c("match") + c("n_unknown") - c("unknown"), c("n_base")),
        "cause_alignment": F.when(c("n_base") == 0, 0.0).when(c("n_labels") == 0, 10.0).otherwise(share(F.lit(15.0), c("hits"), c("n_labels"))),
        "mitigation": share(F.lit(15.0), c("named"), c("n")),
        "grounding": share(F.lit(10.0), c("cited"), c("n")) + F.when(F.coalesce(F.size("spec.supporting_research") >= 2, F.lit(False)), 5.0).otherwise(0.0),
    }
    titles = {"Completeness": "completeness", "Severity agreement": "severity_agreement", "Cause alignment": "cause_alignment", "Mitigation specificity": "mitigation", "Research grounding": "grounding"}
    scored = t.select(key, *[p.alias(name) for name, p in parts.items()]).withColumn("total", sum((c(name) for name in parts), F.lit(0.0)))
    text = summary_text(c("total"), {title: c(name) for title, name in titles.items()})
    return scored.withColumn("summary", text).withColumns({name: F.bround(name, 2) for name in (*parts, "total")})


def strategy_rates(records: DataFrame) -> DataFrame:
    """Per cycle: n, scores, refusals by kind, records with foreign values and their number, agreement with the baseline.

    ``records`` has cycle, total_score, refused, kind, n_flags, severity and baseline; a record without a severity or
    without a baseline does not agree.
    """
    same = (F.trim(F.coalesce("severity", F.lit(""))) != "") & F.col("baseline").isNotNull() & (severity_label(F.col("severity")) == severity_label(F.col("baseline")))
    g = records.groupBy("cycle").agg(
        F.count("*").alias("n"), F.avg("total_score").alias("mean"), F.min("total_score").alias("least"), F.max("total_score").alias("most"),
        F.count_if("refused").alias("refusals"), F.count_if(F.col("kind") == "genuine").alias("genuine"), F.count_if(F.col("kind") == "brevity_only").alias("brevity_only"),
        F.count_if(F.col("n_flags") > 0).alias("hallucinated"), F.sum("n_flags").alias("flags"), F.count_if(same).alias("agreeing"),
    )
    rates = {"refusal_rate": "refusals", "genuine_rate": "genuine", "hallucination_rate": "hallucinated", "agreement_rate": "agreeing"}
    return g.withColumns({rate: F.bround(F.col(of) / F.col("n"), 4) for rate, of in rates.items()}).drop("agreeing")


#: Phrases of a cause or remedy text and the search they ask for.
CAUSE_SEARCHES = (
    (("historical / label bias", "historical bias"), "historical label bias fairness machine learning mitigation"),
    (("proxy discrimination", "proxy"), "proxy discrimination fairness machine learning mitigation"),
    (("representation bias", "imbalance"), "subgroup sample size reliability fairness machine learning"),
)
FIX_SEARCHES = (
    (("reweigh",), "reweighing fairness machine learning"),
    (("thresholdoptimizer", "equalized odds"), "equalized odds postprocessing fairness machine learning"),
    (("prejudice remover",), "prejudice remover fair classification"),
    (("disparate impact remover",), "disparate impact remover preprocessing fairness"),
)


def searches(dataset: Column, attribute: Column, causes: Column, fixes: Column) -> Column:
    """The literature searches for an attribute: two general ones, then one for each kind of cause and remedy named."""
    low = lambda x: F.lower(F.coalesce(x, F.lit("")))
    general = [F.concat(dataset, F.lit(" fairness "), attribute, F.lit(" bias mitigation")), F.concat(attribute, F.lit(" proxy discrimination machine learning fairness"))]
    asked = [F.when(any_contained(low(text), words), F.lit(s)) for text, rules in ((causes, CAUSE_SEARCHES), (fixes, FIX_SEARCHES)) for words, s in rules]
    return F.array_compact(F.array(*general, *asked))


def seeds(attribute: Column, topics: Mapping[str, Sequence[str]], general: Sequence[str]) -> Column:
    """Seed sources for an attribute: those of every topic that its name contains, then the general ones, each once."""
    own = [F.when(F.contains(F.lower(attribute), F.lit(topic)), F.array(*map(F.lit, ids))).otherwise(F.array().cast("array<string>")) for topic, ids in topics.items()]
    return F.array_distinct(F.concat(*own, F.array(*map(F.lit, general))))


#: General literature searches that any data set starts with.
DEFAULT_SEARCHES = (
    "algorithmic fairness bias detection mitigation machine learning",
    "AIF360 fairlearn bias mitigation demographic parity equal opportunity",
    "proxy discrimination machine learning fairness sample size subgroup reliability",
)


def default_searches(dataset: Column, attributes: Column) -> Column:
    """The general searches and one for the data set with its first three attributes."""
    named = F.when(F.size(attributes) > 0, F.array_join(F.slice(attributes, 1, 3), ", ")).otherwise("protected attributes")
    return F.array(*map(F.lit, DEFAULT_SEARCHES), F.concat(dataset, F.lit(" fairness bias mitigation "), named))
