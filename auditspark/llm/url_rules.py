"""Operator 9: URL filtering with mined association rules, by DataFrame functions only.

Each url becomes a set of tokens (suffixes of its host, path steps, file ending, query names; digits as ``#``). A list of
given rules judges first; the urls that one fits are labelled by its verdict, the others carry no label. From the labelled
urls FP-growth mines token combinations that go with ``block``; rules below the confidence or support limit go, and so do
rules whose tokens contain those of a rule that is no less sure. No combination is left out for its size or rank. The
kept rules judge the urls without a label by an inverted index keyed by the rules' rarest tokens: up to ``MOST_LITERAL``
rules as a map literal that every url looks up without a join, more of them by a join of distinct token sets.

Cases: a null url or one without ``://`` has an empty host and path, fits no rule and is allowed; repeated rows are
judged alike; an empty table gives none; without any blocked url no rule is mined and all others are allowed.
"""

from __future__ import annotations

import string

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark.llm.shared import written

#: Limits of mined rules: share of all labelled urls, share of a rule's labelled urls that are blocked.
SUPPORT, CONFIDENCE = 0.01, 0.9
#: Most given rules, and most mined rules of a map literal.
MOST_RULES, MOST_LITERAL = 1000, 1000
#: Given rules: (host, path, verdict).
GIVEN = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to the path, query or fragment; A-Z in lower case."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Distinct tokens of a url."""
    plain = lambda c: F.regexp_replace(F.lower(c), "[0-9]+", "#")
    labels = F.split(host, r"\.")
    n = F.size(labels)
    hosts = F.when(host != "", F.transform(F.sequence(F.lit(1), n), lambda k: F.concat(F.lit("h:"), F.array_join(F.slice(labels, k, n), "."))))
    steps = F.transform(F.filter(F.split(path, "/"), lambda s: s != ""), lambda s: F.concat(F.lit("p:"), plain(s)))
    ending = F.regexp_extract(path, r"\.([A-Za-z0-9]{1,5})$", 1)
    query = F.regexp_extract(F.coalesce(url, F.lit("")), r"\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda s: s != ""), lambda s: F.concat(F.lit("q:"), plain(F.substring_index(s, "=", 1))))
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(hosts, none), steps, F.when(ending != "", F.array(F.concat(F.lit("e:"), F.lower(ending)))).otherwise(none), names))


def given_rule(host: Column, path: Column, rules=GIVEN) -> Column:
    """struct(length, rule, verdict) of the longest given rule that fits, or null. At most ``MOST_RULES`` rules."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} given rules")
    fits = [
        F.when(((host == h) | host.endswith("." + h)) & path.startswith(p), F.struct(F.lit(len(h + p)).alias("length"), F.lit(h + p).alias("rule"), F.lit(v).alias("verdict")))
        for h, p, v in rules
    ]
    return F.array_max(F.array(*fits))


def _anchored(sets: DataFrame, uses: DataFrame) -> DataFrame:
    """(items, ..., anchor): the sets with their rarest token by (token, uses)."""
    tokens = sets.select("items", F.explode("items").alias("token")).join(uses, "token")
    return sets.join(tokens.groupBy("items").agg(F.min_by("token", F.struct("uses", "token")).alias("anchor")), "items")


def _within(inner: str, outer: str) -> Column:
    return F.size(F.array_except(inner, outer)) == 0


def _chosen(parts: Column) -> Column:
    """All ways to take one element of each array."""
    start = F.array(F.array().cast("array<string>"))
    return F.aggregate(parts, start, lambda done, part: F.flatten(F.transform(done, lambda d: F.transform(part, lambda x: F.array_append(d, x)))))


def mined_rules(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Rules (items, sure, often, anchor) for ``blocked`` from rows (tokens, blocked), written to the shared folder.

    Two cuts keep FP-growth small and lose no rule, since a rule that contains one no less sure is needless anyway: a token
    that only blocked rows have is a rule by itself and leaves the rows that are mined; tokens that occur in exactly the
    same rows are mined as one and the rules found are given for each of them. Only blocked rows are mined, so the tree
    grows with them alone; how often each combination occurs among all labelled rows is counted exactly afterwards, by a
    join of distinct token sets on its rarest token.
    """
    spark = labelled.sparkSession
    none = spark.createDataFrame([], "items array<string>, sure double, often double, anchor string")
    total = labelled.agg(F.count("*").alias("n"), F.count_if("blocked").alias("blocked")).first()
    if not total["blocked"]:
        return none
    least = support * total["n"]
    kinds = written(labelled.groupBy(F.array_sort("tokens").alias("tokens")).agg(F.count("*").alias("n"), F.count_if("blocked").alias("blocked")), "token-sets")
    exploded = kinds.select(F.explode("tokens").alias("anchor"), "tokens", "n", "blocked")
    where = F.struct(F.bit_xor(F.xxhash64("tokens")).alias("x"), F.sum(F.xxhash64("tokens", F.lit(1)).cast("decimal(38,0)")).alias("s"), F.count("*").alias("sets"))
    uses = written(exploded.groupBy(F.col("anchor").alias("token")).agg(F.sum("n").alias("uses"), F.sum("blocked").alias("freq"), where.alias("where")), "tokens")
    often = uses.where(F.col("freq") >= least)
    alone = often.where("freq = uses").select(F.array("token").alias("items"), F.lit(1.0).alias("sure"), (F.col("freq") / total["n"]).alias("often"), F.col("token").alias("anchor"))
    classes = written(often.where("freq < uses").groupBy("where").agg(F.min("token").alias("token"), F.collect_list("token").alias("members")).drop("where"), "token-classes")
    row = kinds.where("blocked > 0").select(F.xxhash64("tokens").alias("h"), "tokens", "blocked", F.explode("tokens").alias("token")).join(classes.select("token"), "token")
    rows = row.groupBy("h", "tokens", "blocked").agg(F.collect_list("token").alias("items"))
    rows = written(rows.select("items", F.explode(F.sequence(F.lit(1), F.col("blocked").cast("int")))).select("items"), "blocked-rows")
    held = rows.count()
    if not held or held < least:
        return written(alone, "rules")
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, least / held)).fit(rows)
    # FP-growth's share is of the rows with tokens only, and rounded up: sets below the support go here
    found = written(model.freqItemsets.where(F.col("freq") >= least).select(F.array_sort("items").alias("items"), "freq"), "itemsets")
    anchored = written(_anchored(found, uses.select("token", "uses")), "anchored")
    counts = anchored.select("items", "anchor").join(exploded, "anchor").where(_within("items", "tokens")).groupBy("items").agg(F.sum("n").alias("n"))
    sure = anchored.join(counts, "items").select("items", (F.col("freq") / F.col("n")).alias("sure"), (F.col("freq") / total["n"]).alias("often"), "anchor")
    sure = written(sure.where(F.col("sure") >= confidence), "sure-rules")
    # a rule that contains a smaller one no less sure adds nothing
    small = sure.select(F.col("items").alias("part"), F.col("sure").alias("part_sure"), "anchor")
    large = sure.select("items", "sure", F.explode("items").alias("anchor"))
    needless = large.join(small, "anchor").where((F.size("part") < F.size("items")) & (F.col("part_sure") >= F.col("sure")) & _within("part", "items"))
    kept = sure.join(needless.select("items").distinct(), "items", "left_anti")
    each = kept.select("items", "sure", "often", F.explode("items").alias("token")).join(classes, "token").groupBy("items", "sure", "often").agg(F.collect_list("members").alias("parts"))
    each = written(each.select(F.explode(_chosen(F.col("parts"))).alias("items"), "sure", "often").withColumn("items", F.array_sort("items")), "expanded")
    return written(_anchored(each, uses.select("token", "uses")).select("items", "sure", "often", "anchor").unionByName(alone), "rules")


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> list[tuple[list[str], float, float]]:
    """The rules as a list of (tokens, confidence, support), the surest first."""
    return [(r["items"], r["sure"], r["often"]) for r in mined_rules(labelled, support, confidence).orderBy(F.desc("sure"), F.desc("often"), "items").collect()]


def _rule(sure: Column, often: Column, items: Column) -> Column:
    """A rule as a struct; the greatest is the surest."""
    return F.struct(sure.alias("sure"), often.alias("often"), items.alias("tokens"))


def _index(rules: list) -> Column:
    """Inverted index as a map literal: a rule's rarest token -> its rules."""
    by: dict[str, list[Column]] = {}
    for r in rules:
        by.setdefault(r["anchor"], []).append(_rule(F.lit(r["sure"]), F.lit(r["often"]), F.array(*map(F.lit, r["items"]))))
    return F.create_map(*[x for t, found in sorted(by.items()) for x in (F.lit(t), F.array(*found))])


def _fired(index: Column, tokens: Column) -> Column:
    """The rules of the index whose tokens are all there."""
    found = F.flatten(F.filter(F.transform(tokens, lambda t: F.try_element_at(index, t)), lambda r: r.isNotNull()))
    return F.filter(found, lambda r: F.size(F.array_except(r["tokens"], tokens)) == 0)


def with_mined(rows: DataFrame, rules: DataFrame, literal: int = MOST_LITERAL) -> DataFrame:
    """Rows (tokens, given, ...) with ``mined``, the surest rule that fits a row without a given one, or null."""
    free = F.col("given").isNull() & (F.size("tokens") > 0)
    if rules.count() <= literal:
        listed = rules.orderBy("items").collect()
        best = F.array_max(_fired(_index(listed), F.col("tokens"))) if listed else F.lit(None).cast("struct<sure:double,often:double,tokens:array<string>>")
        return rows.withColumn("mined", F.when(free, best))
    kinds = rows.where(free).select("tokens").distinct().select("tokens", F.explode("tokens").alias("anchor"))
    best = kinds.join(rules, "anchor").where(_within("items", "tokens")).groupBy("tokens").agg(F.max(_rule(F.col("sure"), F.col("often"), F.col("items"))).alias("best"))
    return rows.join(best, "tokens", "left").withColumn("mined", F.when(free, F.col("best"))).drop("best")


def judged(df: DataFrame, id_col: str = "page_id", url_col: str = "url", given=GIVEN, support: float = SUPPORT, confidence: float = CONFIDENCE, literal: int = MOST_LITERAL) -> DataFrame:
    """(id, host, path, rule, verdict, mined) of every row; ``mined`` holds the tokens of the mined rule that decided."""
    rows = df.select(df[id_col].alias("id"), df[url_col].cast("string").alias("url"))
    rows = rows.select("id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"))
    rows = rows.select("id", "host", "path", tokens_of(F.col("url"), F.col("host"), F.col("path")).alias("tokens"), given_rule(F.col("host"), F.col("path"), given).alias("given"))
    rules = mined_rules(rows.where("given IS NOT NULL").select("tokens", (F.col("given.verdict") == "block").alias("blocked")), support, confidence)
    rows = with_mined(rows, rules, literal)
    verdict = F.coalesce("given.verdict", F.when(F.col("mined").isNotNull(), F.lit("block")), F.lit("allow"))
    return rows.select(F.col("id").alias(id_col), "host", "path", F.col("given.rule").alias("rule"), verdict.alias("verdict"), F.col("mined.tokens").alias("mined"))


def op9_url_rules(spark, sf_dir: str) -> DataFrame:
    """Every page's url judged by the given and the mined rules."""
    return judged(spark.read.parquet(f"{sf_dir}/pages.parquet"))
