"""Operator 11: alignment of two tokenizers' tokens by the bytes that they cover.

1. Side A encodes a space and the text with a byte-level vocabulary, side B the text with a piece vocabulary (which adds the
   space). Where both sides' bytes join to a space and the text, the byte offsets of their tokens can be compared.
2. A batch of documents is aligned at once by two pandas ``merge_asof`` joins keyed by document: each A token's start finds
   the B token that covers it, and each B token's start the covering A token. The union of both directions holds every
   overlapping pair of tokens, since of two overlapping tokens one starts inside the other. Equal ends cut groups.
3. The distinct id pairs of each document, with their counts, are written as a table. Tasks sum them, then they are grouped:
   (pair, count, whether it is its B id's highest).
4. The most frequent pairs, at most ``HOT_PAIRS`` by a threshold from counts by power of two, go to all tasks, which settle
   nearly all links where they lie; links of the other pairs, each with few occurrences, are shuffled to their counts.

Cases: texts that are null or empty, or whose bytes one side changes (white space that the piece vocabulary folds, its space
mark, and so on), have no tokens: zeros and an empty digest. Repeated rows and ids stay separate rows, each counting. An
empty table gives an empty one. Other columns never matter. Texts go in batches of about ``BATCH`` bytes; a longer text is a
batch of its own, so memory follows the longest text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.llm.byte_tokens import byte_tokens
from auditspark.llm.piece_codec import codec
from auditspark.llm.shared import by_length, id_text, written

#: Bytes of text aligned at once.
BATCH = 500_000
#: Pairs that go to every task, at most.
HOT_PAIRS = 500_000
#: Distinct pairs that a task sums before it passes them on.
SUMMED_PAIRS = 2_000_000


def byte_characters() -> dict[str, int]:
    """The characters by which byte-level vocabularies write bytes: printable Latin-1 stands for itself, the rest follows 255."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(others)}


class Batch(NamedTuple):
    """Tokens of some documents on both sides in one row each, their links and the tokens that end a group."""

    kept: np.ndarray  # by document: whether it has tokens
    a: np.ndarray  # ids
    b: np.ndarray
    a_doc: np.ndarray  # document of each token
    b_doc: np.ndarray
    link_a: np.ndarray  # positions in ``a`` and ``b`` of every overlapping pair
    link_b: np.ndarray
    a_last: np.ndarray  # whether a token ends where one of the other side does
    b_last: np.ndarray
    starts: tuple[np.ndarray, np.ndarray]  # by side: the byte at which a token starts, counted through the batch


class Aligner:
    def __init__(self, a_path: str, b_path: str):
        self.left, self.right = byte_tokens(a_path), codec(b_path)
        byte_of = byte_characters()
        a = [b""] * self.left.library.get_vocab_size()
        for token, i in self.left.library.get_vocab().items():
            a[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
        sp = self.right.sp
        b = [self.right.piece_bytes.get(i, sp.id_to_piece(i).encode()) for i in range(sp.get_piece_size())]
        self.bytes = tuple(pa.array(x, pa.large_binary()) for x in (a, b))
        self.sizes = tuple(np.array(list(map(len, x)), np.int64) for x in (a, b))
        #: Bits of an A id in a pair's key.
        self.bits = (len(a) - 1).bit_length()
        inner = lambda ids, end: [f"{i}," for i in range(len(ids))] + [f"{i}{end}" for i in range(len(ids))]
        #: Decimal ids with what follows them: A ids inside and at the end of their side of a group, then B ids.
        self.decimals = pa.array(inner(a, "|") + inner(b, ";"), pa.large_string())

    @staticmethod
    def _joined(values: pa.Array) -> tuple[memoryview, np.ndarray]:
        """The bytes of all values in a row, and where each begins."""
        _, offsets, data = values.buffers()
        return memoryview(data or b"").cast("B"), np.frombuffer(offsets, np.int64, len(values) + 1)

    def batch(self, texts: list[str]) -> Batch:
        """Both sides' tokens of texts, aligned."""
        wanted = [(" " + t).encode() if t else b"" for t in texts]
        a_ids = [np.frombuffer(x, np.uint32) for x in self.left.encode(texts, spaced=True)]
        b_ids = [np.fromiter(chain.from_iterable([u[0] for u in self.right.encoded(t)]), np.int64) for t in texts]
        kept = np.array([bool(t) for t in texts], bool)
        sides = []
        for ids, table in zip((a_ids, b_ids), self.bytes, strict=True):
            ends = np.cumsum([0, *map(len, ids)])
            data, offsets = self._joined(table.take(pa.array(np.concatenate([*ids, np.empty(0, np.int64)]), pa.int64())))
            for k, text in enumerate(wanted):
                if kept[k] and data[offsets[ends[k]] : offsets[ends[k + 1]]] != text:
                    kept[k] = False
        for ids, sizes in zip((a_ids, b_ids), self.sizes, strict=True):
            own = [x if keep else x[:0] for x, keep in zip(ids, kept, strict=True)]
            row = np.concatenate([*own, np.empty(0, np.int64)]).astype(np.int64)
            stop = np.cumsum(sizes[row])
            sides.append((row, np.repeat(np.arange(len(texts)), list(map(len, own))), stop - sizes[row], stop))
        (a, a_doc, a_start, a_stop), (b, b_doc, b_start, b_stop) = sides
        left = pd.DataFrame({"start": a_start, "doc": a_doc, "token": np.arange(len(a))})
        right = pd.DataFrame({"start": b_start, "doc": b_doc, "token": np.arange(len(b))})
        under = pd.merge_asof(left[["start", "doc"]], right, on="start", by="doc")["token"].to_numpy(np.int64) if len(a) else b[:0]
        over = pd.merge_asof(right[["start", "doc"]], left, on="start", by="doc")["token"].to_numpy(np.int64) if len(b) else a[:0]
        new = np.flatnonzero(a_start[over] != b_start)  # equal starts are already in the first direction
        ends = lambda own, other: other[np.minimum(np.searchsorted(other, own), len(other) - 1)] == own if len(own) else np.empty(0, bool)
        return Batch(kept, a, b, a_doc, b_doc, np.concatenate([np.arange(len(a)), over[new]]), np.concatenate([under, new]), ends(a_stop, b_stop), ends(b_stop, a_stop), (a_start, b_start))

    def digests(self, x: Batch) -> list[str]:
        """By document: SHA-256 of its groups in decimals, '' without tokens."""
        n = len(x.kept)
        a_group, b_group = (np.cumsum(last) - last for last in (x.a_last, x.b_last))
        groups = int(x.a_last.sum()) + 1
        a_until = np.cumsum(np.bincount(a_group, minlength=groups))
        b_before = np.concatenate([[0], np.cumsum(np.bincount(b_group, minlength=groups))])
        row = np.empty(len(x.a) + len(x.b), np.int64)
        row[np.arange(len(x.a)) + b_before[a_group]] = x.a + x.a_last * len(self.sizes[0])
        row[np.arange(len(x.b)) + a_until[b_group]] = x.b + x.b_last * len(self.sizes[1]) + 2 * len(self.sizes[0])
        data, offsets = self._joined(self.decimals.take(pa.array(row)))
        ends = offsets[np.cumsum([0, *(np.bincount(x.a_doc, minlength=n) + np.bincount(x.b_doc, minlength=n))])]
        return [hashlib.sha256(data[start : stop - 1]).hexdigest() if stop > start else "" for start, stop in zip(ends, ends[1:])]

    def pairs(self, x: Batch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, key, count) of the distinct id pairs of each document; a key is the B id and then the A id."""
        at = 2 * self.bits
        key = (x.b[x.link_b] << self.bits) | x.a[x.link_a]
        found, n = np.unique((x.a_doc[x.link_a] << at) | key, return_counts=True)
        return found >> at, found & ((1 << at) - 1), n


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(a_path: str, b_path: str) -> Aligner:
    """The worker's aligner for two vocabulary files."""
    if (a_path, b_path) not in _aligners:
        _aligners[a_path, b_path] = Aligner(a_path, b_path)
    return _aligners[a_path, b_path]


def _lists(values: np.ndarray, sizes: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values, kind))


def alignments(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, a_ids, b_ids, a_starts, links array<struct<a,b>>, group_ends) of every row.

    ``links`` are positions in the two lists of ids, ``a_starts`` the bytes at which A tokens start in a space and the
    text, ``group_ends`` the positions of the A tokens that end a group.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for b in by_length(batches, BATCH, 512):
            x = own.batch(b.column(1).to_pylist())
            n = b.num_rows
            of = lambda doc: np.bincount(doc, minlength=n)
            a_first, b_first, byte = (np.concatenate([[0], np.cumsum(v)]) for v in (of(x.a_doc), of(x.b_doc), np.bincount(x.a_doc, own.sizes[0][x.a], minlength=n).astype(np.int64)))
            order = np.lexsort((x.link_b, x.link_a))
            doc = x.a_doc[x.link_a[order]]
            links = pa.StructArray.from_arrays([pa.array(x.link_a[order] - a_first[doc], pa.int32()), pa.array(x.link_b[order] - b_first[doc], pa.int32())], ["a", "b"])
            last = np.flatnonzero(x.a_last)
            yield pa.RecordBatch.from_arrays([
                b.column(0), _lists(x.a, of(x.a_doc), pa.int32()), _lists(x.b, of(x.b_doc), pa.int32()), _lists(x.starts[0] - byte[x.a_doc], of(x.a_doc), pa.int32()),
                pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(of(doc))]), pa.int32()), links), _lists(last - a_first[x.a_doc[last]], of(x.a_doc[last]), pa.int32()),
            ], names=[id_col, "a_ids", "b_ids", "a_starts", "links", "group_ends"])

    rows = id_text(df, id_col, text_col)
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"`{id_col}` {kind}, a_ids array<int>, b_ids array<int>, a_starts array<int>, links array<struct<a:int,b:int>>, group_ends array<int>")


def document_pairs(df: DataFrame, a_path: str, b_path: str, id_col: str, text_col: str) -> DataFrame:
    """(row, id, n_a, n_b, n_groups, n_links, groups_sha256, keys, counts) of every row; ``row`` is a number of its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(a_path, b_path)
        for b in by_length(batches, BATCH, 512):
            x = own.batch(b.column(1).to_pylist())
            n = b.num_rows
            of = lambda doc: np.bincount(doc, minlength=n)
            doc, keys, counts = own.pairs(x)
            numbers = [of(x.a_doc), of(x.b_doc), of(x.a_doc[x.a_last]), of(x.a_doc[x.link_a])]
            yield pa.RecordBatch.from_arrays(
                [b.column(2), b.column(0), *[pa.array(v, pa.int64()) for v in numbers], pa.array(own.digests(x), pa.string()), _lists(keys, of(doc), pa.int64()), _lists(counts, of(doc), pa.int32())],
                names=["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "keys", "counts"],
            )

    rows = id_text(df, id_col, text_col).withColumn("row", F.monotonically_increasing_id())
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"row long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, keys array<long>, counts array<int>")


def pair_counts(rows: DataFrame, bits: int) -> DataFrame:
    """(key, n, best) of every id pair of the corpus; ``best``: no pair with the same B id has more links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def summed(parts: list) -> tuple[np.ndarray, np.ndarray]:
            keys, place = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
            n = np.zeros(len(keys), np.int64)
            np.add.at(n, place, np.concatenate([p[1] for p in parts]))
            return keys, n

        out = lambda part: pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), pa.array(part[1], pa.int64())], names=["key", "n"])
        held, waiting = [], 0
        for b in batches:
            held.append(tuple(b.column(k).flatten().to_numpy(zero_copy_only=False) for k in (0, 1)))
            waiting += len(held[-1][0])
            if waiting > SUMMED_PAIRS:
                held, waiting = [summed(held)], 0
                if len(held[0][0]) > SUMMED_PAIRS:
                    yield out(held.pop())
        if held:
            yield out(summed(held))

    counts = written(rows.select("keys", "counts").mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")), "pair-counts")
    top = counts.groupBy(F.shiftright("key", bits).alias("b")).agg(F.max("n").alias("most"))
    # One row for each B id at most: no more than the vocabulary holds.
    joined = counts.withColumn("b", F.shiftright("key", bits)).join(F.broadcast(top), "b")
    return joined.select("key", "n", (F.col("n") == F.col("most")).alias("best"))


def hot_pairs(pairs: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """(the pairs with the largest counts, the others): at most ``most`` of them, cut at a power of two."""
    level = F.floor(F.log2("n"))
    levels = sorted(pairs.groupBy(level.alias("level")).count().collect(), reverse=True)  # 63 rows at most
    least, held = 64, 0
    for power, n in levels:
        held += n
        if held > most:
            break
        least = power
    return pairs.where(level >= least), pairs.where(level < least)


def settled(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """The rows without their pairs: sums over links of hot pairs, and the other pairs as (key, n) lists."""
    table = hot.orderBy("key").toArrow()
    columns = tuple(table[c].to_numpy() for c in ("key", "n", "best"))
    order = np.argsort(columns[0])
    shared = rows.sparkSession.sparkContext.broadcast(tuple(c[order] for c in columns))
    keep = [c for c in rows.columns if c not in ("keys", "counts")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hot_key, hot_n, hot_best = shared.value
        for b in batches:
            lists = b.column("keys")
            doc = np.repeat(np.arange(b.num_rows), lists.value_lengths().to_numpy(zero_copy_only=False))
            keys, counts = lists.flatten().to_numpy(zero_copy_only=False), b.column("counts").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            place = np.minimum(np.searchsorted(hot_key, keys), max(len(hot_key) - 1, 0))
            found = hot_key[place] == keys if len(hot_key) else np.zeros(len(keys), bool)
            total, best = np.zeros(b.num_rows, np.int64), np.zeros(b.num_rows, np.int64)
            np.add.at(total, doc[found], counts[found] * hot_n[place[found]])
            np.add.at(best, doc[found], counts[found] * hot_best[place[found]])
            cold = pa.StructArray.from_arrays([pa.array(keys[~found], pa.int64()), pa.array(counts[~found], pa.int64())], ["key", "links"])
            sizes = np.concatenate([[0], np.cumsum(np.bincount(doc[~found], minlength=b.num_rows))])
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(best, pa.int64()), pa.array(total, pa.int64()), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), cold)], names=[*keep, "n_best", "count_sum", "cold"])

    kept = ", ".join(f"{c} {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.mapInArrow(run, f"{kept}, n_best long, count_sum long, cold array<struct<key:long,links:long>>")


def aligned(df: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT_PAIRS) -> DataFrame:
    """(id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row."""
    rows = written(document_pairs(df, a_path, b_path, id_col, text_col), "document-pairs")
    often, rare = hot_pairs(written(pair_counts(rows, aligner(a_path, b_path).bits), "pairs"), hot)
    part = written(settled(rows, often), "settled")
    cold = part.select("row", F.inline("cold")).join(rare, "key")
    more = cold.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("links")).otherwise(0)).alias("more_best"), F.sum(F.col("links") * F.col("n")).alias("more_sum"))
    both = part.drop("cold").join(more, "row", "left")
    plus = lambda c, x: (F.col(c) + F.coalesce(x, F.lit(0))).alias(c)
    return both.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", plus("n_best", "more_best"), plus("count_sum", "more_sum"), "groups_sha256")


def op11_alignment(spark, sf_dir: str) -> DataFrame:
    """Every document's tokens of the byte-level and the piece vocabulary, aligned."""
    from auditspark.llm.shared import tokenizer_path

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return aligned(docs, tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")).withColumn("doc_id", F.col("doc_id").cast("long"))
