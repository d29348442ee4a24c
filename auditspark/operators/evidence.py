"""Evidence tables: similarity of titles, citations found in evidence, ranked sources, bibliography checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.functions.scalars import shortened, title_tokens
from auditspark.operators import grams, setjoin


def similar_titles(left: DataFrame, right: DataFrame, least: float = 0.72) -> DataFrame:
    """Pairs (a, b, similarity) of titles (id, title) whose shared tokens make up ``least`` of the shorter one.

    Titles with equal tokens are one set in the join (see ``setjoin``), which finds pairs of sets; ids come back last.
    """
    l, r = (setjoin.token_sets(df, title_tokens(F.col("title"))) for df in (left, right))  # noqa: E741
    pairs = setjoin.similar_sets(l, r, least)
    ids = lambda df, x, k: df.select(F.col("id").alias(x), F.col("set").alias(k))
    return pairs.join(ids(l, "a", "l"), "l").join(ids(r, "b", "r"), "r").select("a", "b", "similarity")


def html_title(html: Column) -> Column:
    """The text of a page's first title element, empty without one."""
    return F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)


def ranked(papers: DataFrame, key: list[str], min_citations: int, most: int) -> DataFrame:
    """The best sources of each key: cited ones by citations and year, then others by year and citations; duplicates go.

    ``papers`` has paper_id, title, year, citations.
    """
    same = F.coalesce("paper_id", F.lower("title"))
    first = Window.partitionBy(*key, "same").orderBy(F.desc_nulls_last("citations"), F.desc_nulls_last("year"), "title")
    one = papers.withColumn("same", same).withColumn("n", F.row_number().over(first)).where("n = 1")
    cited = F.coalesce(F.col("citations") >= min_citations, F.lit(False))
    order = [F.when(cited, 0).otherwise(1), F.when(cited, -F.col("citations")).otherwise(-F.col("year")), F.when(cited, -F.col("year")).otherwise(-F.col("citations")), F.col("title")]
    place = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return one.withColumn("place", place).where(F.col("place") <= most).select(*key, "place", "paper_id", "title", cited.alias("cited"))


def citation_line(authors: Column, year: Column, venue: Column, citations: Column, abstract: Column) -> Column:
    """First three authors, year, venue, citations and the shortened abstract."""
    return F.concat_ws(" | ", F.array_join(F.slice(authors, 1, 3), ", "), F.coalesce(year.cast("string"), F.lit("n.d.")), venue, F.concat(citations.cast("string"), F.lit(" citations")), shortened(abstract))


def verified_citations(references: DataFrame, evidence: DataFrame, least_chars: int = 4) -> DataFrame:
    """References (id, reference) with ``verified``: they contain a key (author surname or title start) of the evidence.

    Case doesn't matter; a key may be any letters of any script and begin and end inside words. Keys of fewer than
    ``least_chars`` characters aren't looked for. See ``grams`` for the search; a reference's text is read where it lies.
    """
    keys = evidence.select(F.lower("key").alias("key")).where(F.length("key") >= max(1, least_chars)).distinct()
    hit = grams.holding(references.select("id", F.lower("reference").alias("text")), keys).withColumn("hit", F.lit(True))
    return references.select("id").join(hit, "id", "left").select("id", F.coalesce("hit", F.lit(False)).alias("verified"))


def bibliography_problems(entries: DataFrame, required: dict[str, list[str]]) -> DataFrame:
    """(key, problem): duplicate keys, missing required fields by type, placeholder values. ``fields`` is a map."""
    dup = entries.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key", F.lit("duplicate key").alias("problem"))
    need = F.create_map(*[x for t, fs in required.items() for x in (F.lit(t), F.array(*map(F.lit, fs)))])
    missing = entries.select("key", F.explode(F.filter(F.coalesce(F.try_element_at(need, F.col("type")), F.array().cast("array<string>")), lambda f: F.coalesce(F.trim(F.try_element_at(F.col("fields"), f)), F.lit("")) == "")).alias("f"))
    holes = entries.where(F.exists(F.map_values("fields"), lambda v: v.rlike(r"(?i)\b(todo|tbd|xxx|placeholder)\b"))).select("key", F.lit("placeholder").alias("problem"))
    return dup.unionByName(missing.select("key", F.concat(F.lit("missing "), "f").alias("problem"))).unionByName(holes)


def overlaid(records: DataFrame, side: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Fields of a record filled from a second source where they are null; the record wins."""
    extra = side.select(key, *[F.col(f).alias(f"side_{f}") for f in fields])
    return records.join(extra, key, "left").withColumns({f: F.coalesce(F.col(f), F.col(f"side_{f}")) for f in fields}).drop(*[f"side_{f}" for f in fields])


def resolution_status(entries: DataFrame, cache: DataFrame, registry: DataFrame, least: float = 0.72) -> DataFrame:
    """(key, status, similarity) of bibliography entries (key, doi, title, note).

    attested (with a note), cached (verified before under the same identifier, so not looked up again), verified,
    title_mismatch (shared tokens below ``least`` of the shorter title) or unresolved. ``cache`` has key, doi, verified;
    ``registry`` has doi and title; an entry without a doi is looked up by its title's tokens. A missing doi counts as
    empty; of several cached rows or registered works with one key any verified one, and the one with the smallest doi and
    title, count.
    """
    folded = lambda x: F.array_join(title_tokens(x), " ")
    known = cache.where("verified").select(F.col("key").alias("known_key"), F.coalesce("doi", F.lit("")).alias("known_doi")).distinct()
    rows = entries.select("key", F.coalesce("doi", F.lit("")).alias("doi"), F.coalesce("title", F.lit("")).alias("title"), (F.coalesce(F.trim("note"), F.lit("")) != "").alias("attested"))
    rows = rows.join(known, (F.col("key") == F.col("known_key")) & (F.col("doi") == F.col("known_doi")), "left")
    skipped = F.when(F.col("attested"), "attested").when(F.col("known_key").isNotNull(), "cached")
    rows = rows.select("key", "doi", "title", skipped.alias("status"))
    by_doi = registry.where("doi <> ''").groupBy("doi").agg(F.min("title").alias("found"), F.lit(True).alias("hit"))
    by_title = registry.select(folded(F.col("title")).alias("tokens"), F.struct("doi", "title").alias("r")).where("tokens <> ''").groupBy("tokens").agg(F.min("r")["title"].alias("found"), F.lit(True).alias("hit"))
    todo = rows.where("status IS NULL").drop("status")
    found = todo.where("doi <> ''").join(by_doi, "doi", "left").select("key", "title", "found", "hit")
    found = found.unionByName(todo.where("doi = ''").withColumn("tokens", folded(F.col("title"))).join(by_title, "tokens", "left").select("key", "title", "found", "hit"))
    mine, theirs = title_tokens(F.col("title")), title_tokens(F.col("found"))
    likeness = F.coalesce(F.try_divide(F.size(F.array_intersect(mine, theirs)).cast("double"), F.least(F.size(mine), F.size(theirs)).cast("double")), F.lit(0.0))
    s = F.when(F.col("hit"), likeness)
    judged = found.select("key", F.when(s.isNull(), "unresolved").when(s < least, "title_mismatch").otherwise("verified").alias("status"), F.bround(s, 3).alias("similarity"))
    return judged.unionByName(rows.where("status IS NOT NULL").select("key", "status", F.lit(None).cast("double").alias("similarity")))
