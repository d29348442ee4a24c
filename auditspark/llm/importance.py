"""Operator 13: importance resampling towards a target, by hashed n-gram features.

1. Each text is lower-cased (A-Z only) and an untrained Regex Split of the tokenizers library returns its words with
   their offsets. Windows over the words' offset pairs in the row of joined words are the features; the CRC-32 of a
   feature's bytes names its bucket. Each row's histogram of buckets is written once; everything later reads that table.
2. Corpus and target histograms are summed in the tasks and then by bucket, so at most tasks x ``buckets`` rows are shuffled
   and ``buckets`` rows (a parameter) meet in the driver: the gain of each bucket.
3. Each task sums gains over its rows' histograms. Noise from the id's digest makes the draw of the highest scores a
   weighted draw without replacement.
4. Ranks need no global sort: rows are counted by score (whole numbers, so at most some ten thousand of them), the running
   sum of that table gives each score's first rank and the score at which the draw ends, and only rows at or above it are
   numbered, by id inside their score.

Cases: a null text has no words, as an empty one; a very long text is cut where no word can reach across and read in
pieces; equal scores go to the smaller id, null ids last; rows that repeat stay separate, each counting and each drawn by
itself; an empty table gives an empty one and an empty target gives gains against nothing. Other columns never matter.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.llm.shared import id_text, slices, written

#: Words of a text after ASCII lower-casing: digits, letters and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Features whose bucket a Python worker keeps.
CACHED_FEATURES = 500_000
#: Characters that the splitter gets at once; longer texts are cut at the next character that no word holds.
PIECE = 200_000


class Features:
    """Words and bucket histograms of texts, for one setting; a worker keeps buckets of features it has seen."""

    def __init__(self, grams: int, buckets: int):
        from tokenizers import Regex, pre_tokenizers

        self.split = pre_tokenizers.Split(Regex(WORD), "removed", invert=True).pre_tokenize_str
        self.between = re.compile(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]")
        self.grams, self.buckets = grams, buckets
        self.known: dict[str, int] = {}

    def pieces(self, text: str) -> Iterator[str]:
        at = 0
        while len(text) - at > PIECE:
            cut = self.between.search(text, at + PIECE)
            if not cut:
                break
            yield text[at : cut.start()]
            at = cut.end()
        yield text[at:]

    def words(self, text: str) -> list[str]:
        """The words of a text, which the splitter finds with their offsets."""
        lowered = text.encode("utf-8", "replace").lower().decode()
        return [word for piece in self.pieces(lowered) for word, _ in self.split(piece)]

    def windows(self, words: Sequence[str]) -> Iterator[str]:
        """Every run of 1 to ``grams`` words: slices of the joined words from one word's start to a later one's end."""
        yield from words
        if self.grams > 1 and len(words) > 1:
            row = " ".join(words)
            ends = np.cumsum([len(w) + 1 for w in words]) - 1
            starts, stops = (ends - [len(w) for w in words]).tolist(), ends.tolist()
            for n in range(2, self.grams + 1):
                for start, stop in zip(starts, stops[n - 1 :], strict=False):
                    yield row[start:stop]

    def bucket(self, feature: str) -> int:
        if len(self.known) >= CACHED_FEATURES:
            self.known.clear()
        found = self.known[feature] = zlib.crc32(feature.encode()) % self.buckets
        return found

    def histogram(self, words: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """(buckets, counts) of all features of a text."""
        known, bucket = self.known.get, self.bucket
        found = [b if (b := known(f)) is not None else bucket(f) for f in self.windows(words)]
        return np.unique(np.array(found, np.int32), return_counts=True)


_features: dict[tuple[int, int], Features] = {}


def features(grams: int, buckets: int) -> Features:
    """The worker's features for a setting."""
    if (grams, buckets) not in _features:
        _features[grams, buckets] = Features(grams, buckets)
    return _features[grams, buckets]


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*parts, np.empty(0, np.int64)]), pa.int32()))


def histograms(df: DataFrame, id_col: str, text_col: str, grams: int, buckets: int) -> DataFrame:
    """(id, n_words, n_features, buckets array<int>, counts array<int>) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = features(grams, buckets)
        for b in slices(batches):
            words, found = [], []
            for text in b.column(1).to_pylist():
                row = own.words(text)
                words.append(len(row))
                found.append(own.histogram(row))
            total = [int(counts.sum()) for _, counts in found]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words, pa.int64()), pa.array(total, pa.int64()), _lists([f[0] for f in found]), _lists([f[1] for f in found])], names=["id", "n_words", "n_features", "buckets", "counts"])

    rows = id_text(df, id_col, text_col)
    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_features long, buckets array<int>, counts array<int>")


def bucket_totals(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n): the sum of all rows' histograms, summed in each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for b in batches:
            at, n = (b.column(k).flatten().to_numpy(zero_copy_only=False) for k in (0, 1))
            np.add.at(total, at, n)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], names=["bucket", "n"])

    return rows.select("buckets", "counts").mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """floor(1000 ln((t+1)(S+buckets) / ((s+1)(T+buckets)))) of each bucket; ``buckets`` rows a side reach the driver."""
    sides = []
    for rows in (corpus, target):
        counts = np.zeros(buckets, np.float64)
        for bucket, n in bucket_totals(rows, buckets).collect():
            counts[bucket] = n
        sides.append(counts)
    s, t = sides
    return np.floor(1000 * np.log((t + 1) * (s.sum() + buckets) / ((s + 1) * (t.sum() + buckets)))).astype(np.int64)


def weights(rows: DataFrame, gains: np.ndarray) -> DataFrame:
    """(id, n_words, n_features, weight): the floored mean of the gains over a row's features, 0 without any."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, n = (b.column(k).flatten().to_numpy(zero_copy_only=False).astype(np.int64) for k in (3, 4))
            row = np.repeat(np.arange(b.num_rows), b.column(3).value_lengths().to_numpy(zero_copy_only=False))
            total = np.zeros(b.num_rows, np.int64)
            np.add.at(total, row, gains[at] * n)
            size = b.column(2).to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(total // np.maximum(size, 1), pa.int64())], names=["id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def noise(id_: Column, seed: str) -> Column:
    """floor(-1000 ln(-ln u)), with u from the first eight hex digits of the id's digest."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(id_.cast("string"), F.lit("null"))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.ln(-F.ln((h + 0.5) / 4294967296.0)))


def ranked(rows: DataFrame, eligible: Column, percent: int) -> DataFrame:
    """Adds ``rank`` (1, 2, ...) to the floor(percent * N / 100) eligible rows with the highest scores; else null.

    Ties go to the smaller id. ``rows`` has id and score and should lie in a table, since it is read twice.
    """
    fit = rows.where(eligible)
    counts = fit.groupBy("score").agg(F.count("*").alias("n"))
    every = Window.partitionBy(F.lit(0))
    above = F.coalesce(F.sum("n").over(every.orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = counts.select("score", above.alias("above"), F.floor(F.sum("n").over(every) * percent / 100).alias("drawn")).where("above < drawn")
    firsts = written(firsts, "scores")
    inside = F.row_number().over(Window.partitionBy("score").orderBy(F.asc_nulls_last("id"), "row"))
    taken = fit.join(F.broadcast(firsts), "score").withColumn("rank", F.col("above") + inside).where("rank <= drawn").select("row", "rank")
    return rows.join(taken, "row", "left")


def resampled(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_id: str = "item_id", target_text: str = "text", grams: int = 2, buckets: int = 10_000, seed: str = "2024", least_words: int = 20, percent: int = 10) -> DataFrame:
    """(id, n_features, weight, score, rank) of every row; ``rank`` is null for rows that aren't drawn."""
    corpus = written(histograms(df, id_col, text_col, grams, buckets), "histograms")
    goal = written(histograms(target, target_id, target_text, grams, buckets), "target-histograms")
    rows = weights(corpus, bucket_gains(corpus, goal, buckets))
    rows = written(rows.withColumns({"score": F.col("weight") + noise(F.col("id"), seed), "row": F.monotonically_increasing_id()}), "weights")
    return ranked(rows, F.col("n_words") >= least_words, percent).select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")


def op13_importance(spark, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn towards the benchmark texts by single words."""
    table = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    out = resampled(table("documents"), table("benchmark"), grams=1)
    return out.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("n_features", "weight", "score", "rank")])
