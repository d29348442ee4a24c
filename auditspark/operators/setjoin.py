"""Similarity join of token sets by overlap coefficient, with prefix, length and position filters.

Two sets match if they share ``least`` of the smaller one's tokens. All tokens have one global order, the rarest first. If
the smaller set has n tokens and must share t of them, one shared token is among its first n - t + 1, so these are looked up
in the other side's full entries: one equi-join of short prefixes against entries for each direction. A pair survives at a
shared token only if the other set is no smaller and enough tokens follow on either side; the first shared token of a match
always passes. Ids and positions are all that is shuffled; the tokens of candidates are fetched by set id afterwards.

Equal sets are one set (its id is a digest), so rows with equal titles are compared once. A word with many entries is split:
both sides' entries go to blocks of ``BLOCK``, each block of one side meeting each block of the other, so no task holds a
word's entries as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark.sources.workspace import written

#: Entries of a word that meet in one task, on either side.
BLOCK = 5000


def token_sets(rows: DataFrame, tokens: Column) -> DataFrame:
    """(id, set, t): the rows' distinct tokens in order and the digest that names their set; rows without tokens are left out."""
    t = F.sort_array(F.array_distinct(F.filter(tokens, lambda w: w.isNotNull())))
    return rows.select("id", t.alias("t")).where(F.size("t") > 0).select("id", F.sha2(F.to_json("t"), 256).alias("set"), "t")


def ordered(left: DataFrame, right: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Each side's distinct sets (set, n, words), words being (f, w, l, r): frequency in all, the word, and its entries by side."""
    distinct = [side.groupBy("set").agg(F.first("t").alias("t")) for side in (left, right)]
    words = [d.select("set", F.explode("t").alias("w")) for d in distinct]
    both = words[0].select("w", F.lit(1).alias("l"), F.lit(0).alias("r")).unionAll(words[1].select("w", F.lit(0).alias("l"), F.lit(1).alias("r")))
    freq = written(both.groupBy("w").agg(F.sum("l").alias("l"), F.sum("r").alias("r")), "word-counts")
    out = []
    for side in words:
        word = F.struct((F.col("l") + F.col("r")).alias("f"), "w", "l", "r")
        out.append(written(side.join(freq, "w").groupBy("set").agg(F.sort_array(F.collect_list(word)).alias("words")).select("set", F.size("words").alias("n"), "words"), "ordered-sets"))
    return out[0], out[1]


def _needed(n: Column, least: float) -> Column:
    """Tokens that a set of n must share with a larger one."""
    return F.greatest(F.lit(1), F.ceil(least * n - 1e-9))


def candidates(smaller: DataFrame, larger: DataFrame, least: float, sides: tuple[str, str] = ("l", "r"), strict: bool = False) -> DataFrame:
    """(s, x) pairs of set ids that share a token at which all filters pass; ``strict``: equal sizes are the other direction's.

    ``sides`` name the counts of the smaller and the larger sets' entries in their words.
    """
    mine, theirs = sides
    blocks = lambda side: F.greatest(F.lit(1), F.ceil(F.col(f"word.{side}") / BLOCK)).cast("int")
    each = lambda df: df.select("set", "n", F.posexplode("words").alias("at", "word"))
    every = lambda side: F.explode(F.sequence(F.lit(0), blocks(side) - 1))
    own = lambda side: F.pmod(F.xxhash64("set"), blocks(side)).cast("int")
    short = each(smaller).where(F.col("at") <= F.col("n") - _needed(F.col("n"), least)).where(F.col(f"word.{theirs}") > 0)
    short = short.select(F.col("set").alias("s"), F.col("n").alias("n_s"), F.col("at").alias("at_s"), "word", own(mine).alias("mine"), every(theirs).alias("theirs"))
    full = each(larger).where(F.col(f"word.{mine}") > 0)
    full = full.select(F.col("set").alias("x"), F.col("n").alias("n_x"), F.col("at").alias("at_x"), "word", own(theirs).alias("theirs"), every(mine).alias("mine"))
    short, full = (df.withColumn("w", F.col("word.w")).drop("word") for df in (short, full))
    sizes = F.col("n_s") < F.col("n_x") if strict else F.col("n_s") <= F.col("n_x")
    enough = 1 + F.least(F.col("n_s") - 1 - F.col("at_s"), F.col("n_x") - 1 - F.col("at_x")) >= _needed(F.col("n_s"), least)
    return short.join(full, ["w", "mine", "theirs"]).where(sizes & enough).select("s", "x").distinct()


def similar_sets(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """(l, r, similarity) of the sets of two sides, given as (id, set, t)."""
    a, b = ordered(left, right)
    pairs = candidates(a, b, least).select(F.col("s").alias("l"), F.col("x").alias("r"))
    pairs = pairs.unionByName(candidates(b, a, least, ("r", "l"), strict=True).select(F.col("x").alias("l"), F.col("s").alias("r")))
    words = lambda df, k: df.select(F.col("set").alias(k), F.transform("words", lambda x: x["w"]).alias(f"t_{k}"))
    both = pairs.join(words(a, "l"), "l").join(words(b, "r"), "r")
    shared = F.size(F.array_intersect("t_l", "t_r")) / F.least(F.size("t_l"), F.size("t_r"))
    return both.select("l", "r", shared.alias("similarity")).where(F.col("similarity") >= least)
