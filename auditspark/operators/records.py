"""Analytics over tables of machine-written audit records.

A record row has dataset, attribute, cycle and a struct ``result`` (attribute, severity, what_is_wrong, why_is_wrong,
how_to_fix, supporting_research); scores, flags and usage are further columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.functions.scalars import SEVERITIES, any_contained, ratio, severity_label

#: Refusal phrases, required fields, algorithm names, anchors that any text may quote.
REFUSALS = ("i cannot", "i can't", "i'm not able", "unable to", "i refuse", "i won't", "not appropriate", "as an ai", "i'm sorry, but", "i apologize, but")
REQUIRED = ("attribute", "severity", "what_is_wrong", "why_is_wrong", "how_to_fix")
NARRATIVE = ("what_is_wrong", "why_is_wrong", "how_to_fix")
ALGORITHMS = ("reweighing", "disparateimpactremover", "prejudiceremover", "eqoddspostprocessing", "calibratedeqoddspostprocessing", "exponentiatedgradient", "gridsearch", "thresholdoptimizer", "equalized odds")
ANCHORS = (0.0, 0.05, 0.1, 0.2, 0.25, 0.5, 0.8, 0.9, 1.0, 1.25)
TOLERANCE, BRIEF = 5e-4, 40


def _no(x: Column) -> Column:
    return F.coalesce(x, F.lit(False))


def _text(r: Column, field: str) -> Column:
    return F.coalesce(r[field], F.lit(""))


def completeness(r: Column) -> Column:
    """Points of a single-attribute result, 30 at most: named attribute 4, long finding 8, all fields 8, long reason 5, two sources 5."""
    point = lambda cond, n: F.when(_no(cond), float(n)).otherwise(0.0)
    filled = F.lit(True)
    for f in ("what_is_wrong", "why_is_wrong", "how_to_fix", "severity"):
        filled = filled & (_text(r, f) != "")
    return point(_text(r, "attribute") != "", 4) + point(F.length(_text(r, "what_is_wrong")) >= 100, 8) + point(filled, 8) + point(F.length(_text(r, "why_is_wrong")) >= 100, 5) + point(F.size(r["supporting_research"]) >= 2, 5)


def full_text(r: Column) -> Column:
    """Attribute, severity, narrative fields and sources of a result in one lower-case text."""
    return F.lower(F.concat_ws(" ", r["attribute"], r["severity"], *[r[f] for f in NARRATIVE], r["supporting_research"]))


def covers(expected: Column, got: Column) -> Column:
    """Whether every expected attribute was answered."""
    return F.size(F.array_except(expected, got)) == 0


def names_algorithm(text: Column) -> Column:
    plain = F.replace(F.replace(F.lower(F.coalesce(text, F.lit(""))), F.lit("-"), F.lit("")), F.lit("_"), F.lit(""))
    return any_contained(plain, ALGORITHMS)


def label_share(labels: Column, why: Column) -> Column:
    """15 times the share of the cause labels that the reason mentions; 10 without labels."""
    low = F.lower(F.coalesce(why, F.lit("")))
    hits = F.size(F.filter(labels, lambda x: F.contains(low, F.replace(x, F.lit("_"), F.lit(" ")))))
    return F.when(F.size(labels) > 0, 15.0 * hits / F.size(labels)).otherwise(10.0)


def scored(records: DataFrame, baseline: DataFrame) -> DataFrame:
    """Subscores and total of each record against its baseline (dataset, attribute, severity, labels array)."""
    base = baseline.select("dataset", "attribute", F.col("severity").alias("base_severity"), "labels")
    rows = records.join(base, ["dataset", "attribute"], "left")
    r = F.col("result")
    return rows.withColumns({
        "completeness": F.least(F.lit(40.0), completeness(r) + F.when(_no(r["attribute"] == F.col("attribute")), 10.0).otherwise(0.0)),
        "severity_agreement": F.when(_no(severity_label(r["severity"]) == severity_label(F.col("base_severity"))), 20.0).otherwise(0.0),
        "cause_alignment": label_share(F.coalesce("labels", F.array().cast("array<string>")), r["why_is_wrong"]),
        "mitigation": F.when(names_algorithm(r["how_to_fix"]), 15.0).otherwise(0.0),
        "grounding": F.when(_no(F.size(r["supporting_research"]) >= 1), 10.0).otherwise(0.0),
    }).withColumn("total", F.col("completeness") + F.col("severity_agreement") + F.col("cause_alignment") + F.col("mitigation") + F.col("grounding"))


def refused(r: Column, raw: Column) -> Column:
    """Null, a refusal phrase, a missing field, a narrative under 40 characters, or no valid severity."""
    out = r.isNull() | any_contained(F.lower(F.coalesce(raw, F.lit(""))), REFUSALS)
    for f in REQUIRED:
        out = out | (_text(r, f) == "")
    for f in NARRATIVE:
        out = out | (F.length(_text(r, f)) < BRIEF)
    sev = F.trim(F.upper(_text(r, "severity")))
    return _no(out | ((sev != "") & ~sev.isin(*SEVERITIES)))


def refusal_kind(flagged: Column, r: Column, blob: Column) -> Column:
    """genuine or brevity_only, null where not flagged."""
    missing = F.lit(False)
    for f in REQUIRED:
        missing = missing | (_text(r, f) == "")
    brief = F.lit(False)
    for f in NARRATIVE:
        brief = brief | (F.length(_text(r, f)) < BRIEF)
    sev = F.trim(F.upper(_text(r, "severity")))
    return F.when(_no(flagged), F.when(r.isNull() | any_contained(F.lower(blob), REFUSALS) | missing | ((sev != "") & ~sev.isin(*SEVERITIES)), "genuine").when(brief, "brevity_only").otherwise("genuine"))


def grams(text: Column, n: int = 3) -> Column:
    """The runs of n words of a text, empty for shorter ones: the words zipped with themselves, moved by one each time."""
    words = F.filter(F.split(F.lower(F.trim(text)), r"\s+"), lambda w: w != "")
    runs = words
    for k in range(1, n):
        runs = F.zip_with(runs, F.slice(words, k + 1, 1 << 30), lambda a, b: F.concat(a, F.lit(" "), b))
    return F.array_compact(runs)


def unknown_citations(citations: DataFrame, titles: DataFrame, n: int = 3) -> DataFrame:
    """Citations (id, citation) without any n-gram of a known title (title): an anti-join on exploded grams."""
    known = titles.select(F.explode(grams(F.col("title"), n)).alias("gram")).distinct()
    hit = citations.select("id", F.explode(grams(F.col("citation"), n)).alias("gram")).join(known, "gram", "left_semi").select("id").distinct()
    return citations.join(hit, "id", "left_anti")


def foreign_values(text: Column, known: Column) -> Column:
    """Decimal numbers of a text that are within tolerance of no known value and of no anchor."""
    quoted = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"-?\d+\.\d+"), F.lit(0)), lambda x: x.cast("double"))
    allowed = F.concat(known, F.array(*map(F.lit, ANCHORS)))
    return F.filter(quoted, lambda q: ~F.exists(allowed, lambda v: F.abs(q - v) <= TOLERANCE))


def numeric_leaves(metrics: Column, fields: Sequence[str], groups: Column, group_fields: Sequence[str]) -> Column:
    """All numbers of a nested context: the metrics' fields and those of every group."""
    own = F.array(*[metrics[f].cast("double") for f in fields])
    return F.array_compact(F.concat(own, F.flatten(F.transform(groups, lambda g: F.array(*[g[f].cast("double") for f in group_fields])))))


def context_payload(metrics: DataFrame, breakdown: DataFrame) -> DataFrame:
    """(attribute, payload): metrics and the array of group rows as one JSON document an attribute."""
    groups = breakdown.groupBy("attribute").agg(F.array_sort(F.collect_list(F.struct("group", "n", "selection_rate"))).alias("groups"))
    rows = metrics.join(groups, "attribute", "left")
    return rows.select("attribute", F.struct("di", "dpd", "eod", "aod").alias("metrics"), "groups", F.to_json(F.struct("attribute", F.struct("di", "dpd").alias("metrics"), "groups")).alias("payload"))


def with_baseline(records: DataFrame, base: DataFrame) -> DataFrame:
    """Records with the severity of cycle 1 of their dataset and attribute, and whether they agree with it."""
    rows = records.join(base, ["dataset", "attribute"], "left")
    return rows.withColumn("agrees", F.when(F.col("baseline").isNotNull(), severity_label(F.col("severity")) == severity_label(F.col("baseline"))))


def stability(records: DataFrame) -> DataFrame:
    """Per (dataset, attribute): severities by cycle, how many distinct ones, stable or not."""
    s = records.select("dataset", "attribute", "cycle", severity_label(F.col("severity")).alias("s"))
    g = s.groupBy("dataset", "attribute").agg(F.array_sort(F.collect_set(F.struct("cycle", "s"))).alias("by_cycle"), F.countDistinct("s").alias("distinct"))
    return g.select("dataset", "attribute", F.array_join(F.transform("by_cycle", lambda x: F.concat_ws(":", x["cycle"].cast("string"), x["s"])), ",").alias("severities"), "distinct", (F.col("distinct") <= 1).alias("stable"))


def rank_of(label: Column) -> Column:
    """1 for LOW up to 4 for CRITICAL, 0 for others."""
    return F.array_position(F.array(*[F.lit(s) for s in reversed(SEVERITIES)]), label)


def direction(rows: DataFrame) -> DataFrame:
    """(dataset, matches, over, under) of ``with_baseline`` rows."""
    got, base = rank_of(severity_label(F.col("severity"))), rank_of(severity_label(F.col("baseline")))
    return rows.where("baseline IS NOT NULL").groupBy("dataset").agg(F.count_if(got == base).alias("matches"), F.count_if(got > base).alias("over"), F.count_if(got < base).alias("under"))


def majority_severity(records: DataFrame) -> DataFrame:
    """(dataset, attribute, majority): the commonest severity, the smallest label of equals."""
    n = records.groupBy("dataset", "attribute", severity_label(F.col("severity")).alias("s")).agg(F.count("*").alias("n"))
    return n.groupBy("dataset", "attribute").agg(F.min_by("s", F.struct(-F.col("n"), F.col("s"))).alias("majority"), F.collect_set("s").alias("seen"))


def strategies(records: DataFrame) -> DataFrame:
    """Per cycle: n, mean, least and largest score, refusal rate."""
    return records.groupBy("cycle").agg(F.count("*").alias("n"), F.avg("total_score").alias("mean"), F.min("total_score").alias("least"), F.max("total_score").alias("most"), F.avg(F.col("refused").cast("int")).alias("refusal_rate"))


def token_cost(records: DataFrame, prices: DataFrame) -> DataFrame:
    """Adds cost: tokens times the price per million of the record's dataset (a price dimension)."""
    return records.join(prices, "dataset").withColumn("cost", (F.col("input_tokens") * F.col("input_price") + F.col("output_tokens") * F.col("output_price")) / 1e6)


def usage(records: DataFrame) -> DataFrame:
    return records.groupBy("cycle").agg(F.count("*").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), F.sum("cost").alias("cost"), ratio(F.sum("cost"), F.count("*")).alias("cost_per_call"), F.avg("seconds").alias("latency"))


def cycle_spread(records: DataFrame, without: int = 4) -> DataFrame:
    """Largest less smallest cycle mean by dataset, with all cycles and without one."""
    m = records.groupBy("dataset", "cycle").agg(F.avg("total_score").alias("mean"))
    rest = F.when(F.col("cycle") != without, F.col("mean"))
    return m.groupBy("dataset").agg((F.max("mean") - F.min("mean")).alias("spread"), (F.max(rest) - F.min(rest)).alias("spread_without"))


def dip(records: DataFrame, subscores: Sequence[str], cycle: int = 4) -> DataFrame:
    """(subscore, drop, share): how much each subscore lost in one cycle against the others."""
    long = records.select("cycle", *subscores).unpivot(["cycle"], list(subscores), "subscore", "v")
    d = long.groupBy("subscore").agg((F.avg(F.when(F.col("cycle") != cycle, F.col("v"))) - F.avg(F.when(F.col("cycle") == cycle, F.col("v")))).alias("drop"))
    return d.withColumn("share", ratio(F.col("drop"), F.sum("drop").over(Window.partitionBy(F.lit(0)))))


def gain(records: DataFrame) -> DataFrame:
    """Last less first score of each run."""
    order = F.struct("cycle", "record_id")
    return records.groupBy("dataset", "attribute").agg((F.max_by("total_score", order) - F.min_by("total_score", order)).alias("gain"))


def compliance(records: DataFrame, gates: dict[str, Column]) -> DataFrame:
    """(record_id, violations, compliance): 100 less 10 for each gate that fails, 0 at least."""
    failed = F.array_compact(F.array(*[F.when(~_no(ok), F.lit(name)) for name, ok in gates.items()]))
    return records.select("record_id", F.array_join(failed, ",").alias("violations"), F.greatest(F.lit(0), 100 - 10 * F.size(failed)).alias("compliance"))


def hybrid(deterministic: Column, judge: Column, compliant: Column) -> Column:
    return 0.45 * deterministic + 0.45 * judge + 0.10 * compliant


def fenced_json(raw: Column) -> Column:
    """The text between the first { and the last } without code fences and control characters; null without braces."""
    t = F.regexp_replace(F.regexp_replace(F.coalesce(raw, F.lit("")), r"```(?:json)?", ""), r"[\x00-\x1f]+", " ")
    return F.nullif(F.regexp_extract(t, r"(\{.*\})", 1), F.lit(""))


def sections(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, number, title, severity) of Markdown sections that start with ``## `` after a rule."""
    parts = df.select(key, F.posexplode(F.split(F.col(text), "\n---\n## ")).alias("number", "part")).where("number > 0")
    return parts.select(key, "number", F.trim(F.substring_index("part", "\n", 1)).alias("title"), severity_label(F.regexp_extract("part", r"Severity:\**[ \t]*([A-Za-z]+)", 1)).alias("severity"))


#: Characters of a token, tokens of an answer, and the margin of an estimate before a call.
CHARS_A_TOKEN, ANSWER_TOKENS, MARGIN = 4, 1200, 1.15


def estimated_cost(prompt: Column, input_price: Column, output_price: Column, answer_tokens: int = ANSWER_TOKENS) -> Column:
    """The cost of a call before it is made: tokens from the prompt's length (at least one), with a margin."""
    tokens = F.greatest(F.lit(1), F.floor(F.length(prompt) / CHARS_A_TOKEN))
    return (tokens / 1e6 * input_price + answer_tokens / 1e6 * output_price) * MARGIN
