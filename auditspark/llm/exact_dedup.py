"""Operator 6: exact duplicates, with frequent digests split from the rest.

1. Every text is normalised and digested once; (id, digest) is written to the shared folder.
2. Each task runs a Misra-Gries summary with ``counters`` counters over its digests. Any digest with more than
   1 / (counters + 1) of all rows keeps a count in the sum of the summaries, so the ``counters`` largest sums hold them all.
3. These candidates are counted exactly and their winners (smallest id) found; at most ``counters`` rows, so they are
   broadcast, and rows with these digests are settled where they lie, without a shuffle.
4. The other digests, each with few rows, are grouped and joined by an ordinary shuffle.

Cases: a null text counts as empty, and empty texts are equal to each other; ids that repeat stay separate rows; a null
id is never preferred to another, and rows of a group of null ids only keep a null; an empty table gives an empty one.
Columns beside id and text are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark.llm.shared import lean, written

#: Counters of a summary, and the most rows that are broadcast.
COUNTERS = 512


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+", " ")


def digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, digest): SHA-256 of the normalised text in UTF-8, lowercase hex."""
    return df.select(df[id_col].alias("id"), F.sha2(normalised(df[text_col].cast("string")), 256).alias("digest"))


def summaries(keys: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """(digest, low) of the Misra-Gries summary of each task; ``low`` is at most the digest's true count there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: Counter = Counter()
        for b in batches:
            kept.update(Counter(b.column(0).to_pylist()))
            if len(kept) > counters:  # as many decrements at once as leave the allowed number of counters
                cut = sorted(kept.values(), reverse=True)[counters]
                kept = Counter({k: v - cut for k, v in kept.items() if v > cut})
        yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array(list(kept.values()), pa.int64())], names=["digest", "low"])

    return keys.select("digest").mapInArrow(lean(run), "digest string, low long")


def frequent(keys: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """At most ``counters`` rows (digest, keep_id, group_size), exact, with every digest that is frequent."""
    candidates = summaries(keys, counters).groupBy("digest").agg(F.sum("low").alias("low")).orderBy(F.desc("low"), "digest").limit(counters).where("low > 1").select("digest")
    return keys.join(F.broadcast(candidates), "digest").groupBy("digest").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))


def exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", counters: int = COUNTERS) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256) of every row."""
    keys = written(digests(df, id_col, text_col), "digests")
    winners = written(frequent(keys, counters), "winners")
    hot = keys.join(F.broadcast(winners), "digest")
    rest = keys.join(F.broadcast(winners.select("digest")), "digest", "left_anti")
    groups = rest.groupBy("digest").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    settled = hot.unionByName(rest.join(groups, "digest"))
    return settled.select(F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.col("digest").alias("text_sha256"))


def op6_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Exact duplicates of the whole documents table."""
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
       doc_id = min(doc_id) OVER g AS kept, text_sha256
FROM (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
WINDOW g AS (PARTITION BY text_sha256)
"""
