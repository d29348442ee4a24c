"""Which texts hold at least one of many keys, exactly, by an index of byte grams.

A gram of 8 bytes (4 or 1 for very short keys) is a number. Of the grams in each window of a text the one with the smallest
mixed value is selected; if a key covers a whole window, the text selects the same gram there. So the selected grams of a key
all occur among the text's, and windows as wide as the key's length class allows keep few of them.

1. Tasks select the grams of keys and of texts. A bitmap of ``BITS`` bits (a fixed size) of the keys' grams goes to all tasks,
   so texts give rows only for grams that a key has; with very many keys the bitmap fills up and lets more through.
2. Each key goes by the one of its grams that fewest texts have; a key with a gram that no text has can't occur.
3. (text id, gram) meets (gram, key): only ids, grams and keys are shuffled. Texts with candidates are read again, and a
   candidate counts if the text holds it as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.sources.workspace import written

#: Length classes of keys: least bytes, bytes of a gram, grams of a window. A key of the least length covers one window.
CLASSES = ((32, 8, 25), (16, 8, 9), (8, 8, 1), (4, 4, 1), (1, 1, 1))
#: Bits of the keys' bitmap, as a power of two.
BITS = 22


def selected(data: bytes, gram: int, window: int) -> np.ndarray:
    """The mixed values of the grams that are smallest in a window, each once."""
    n = len(data) - gram + 1
    if n < window:
        return np.empty(0, np.uint64)
    b = np.frombuffer(data, np.uint8).astype(np.uint64)
    value = np.zeros(n, np.uint64)
    for k in range(gram):
        value |= b[k : k + n] << np.uint64(8 * k)
    least, span = (value + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), 1
    while span < window:  # minima of windows twice as wide, until they are wide enough
        step = min(span, window - span)
        least, span = np.minimum(least[: len(least) - step], least[step:]), span + step
    return np.unique(least)


def class_of(size: int) -> int:
    """The number of the length class of a key of ``size`` bytes."""
    return next(k for k, (least, _, _) in enumerate(CLASSES) if size >= least)


def _marked(values: np.ndarray, number: int) -> np.ndarray:
    """Values of different classes never meet: the class is in the last bits."""
    return (values & ~np.uint64(7)) | np.uint64(number)


def key_grams(keys: DataFrame) -> DataFrame:
    """(key, class, gram) of every selected gram of every key (a column ``key`` of texts that aren't empty)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for key in b.column(0).to_pylist():
                data = key.encode()
                number = class_of(len(data))
                rows.append((key, number, _marked(selected(data, *CLASSES[number][1:]), number)))
            sizes = [len(g) for *_, g in rows]
            grams = np.concatenate([*[g for *_, g in rows], np.empty(0, np.uint64)]).view(np.int64)
            key = b.column(0).take(pa.array(np.repeat(np.arange(len(rows)), sizes)))
            yield pa.RecordBatch.from_arrays([key, pa.array(np.repeat([n for _, n, _ in rows], sizes), pa.int32()), pa.array(grams)], names=["key", "class", "gram"])

    return keys.select("key").mapInArrow(run, "key string, class int, gram long")


def text_grams(texts: DataFrame, numbers: list[int], bitmap: np.ndarray) -> DataFrame:
    """(id, gram) of the selected grams of every text (id, text) that the bitmap holds, for the given length classes."""
    shared = texts.sparkSession.sparkContext.broadcast(bitmap)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, shift = np.unpackbits(shared.value).astype(bool), np.uint64(64 - BITS)
        for b in batches:
            found = []
            for text in b.column(1).to_pylist():
                data = (text or "").encode()
                own = np.concatenate([_marked(selected(data, *CLASSES[k][1:]), k) for k in numbers])
                found.append(own[bits[own >> shift]])
            rows = pa.array(np.repeat(np.arange(len(found)), [len(f) for f in found]))
            yield pa.RecordBatch.from_arrays([b.column(0).take(rows), pa.array(np.concatenate([*found, np.empty(0, np.uint64)]).view(np.int64))], names=["id", "gram"])

    return texts.select("id", "text").mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, gram long")


def candidates(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """(id, key): every text that may hold a key, by the key's rarest gram."""
    grams = written(key_grams(keys), "key-grams")
    held = grams.select(F.shiftrightunsigned("gram", 64 - BITS).cast("int").alias("bit")).distinct().toArrow()["bit"].to_numpy()  # 2 ^ BITS at most
    bitmap = np.zeros(1 << BITS, bool)
    bitmap[held] = True
    numbers = sorted(r["class"] for r in grams.select("class").distinct().collect())
    if not numbers:
        return texts.select("id").crossJoin(keys.select("key")).limit(0)
    found = written(text_grams(texts, numbers, np.packbits(bitmap)), "text-grams")
    counts = found.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = grams.join(counts, "gram", "left").select("key", "gram", F.coalesce("n", F.lit(0)).alias("n")).groupBy("key").agg(F.min(F.struct("n", "gram")).alias("best"))
    rarest = rarest.where("best.n > 0").select("key", F.col("best.gram").alias("gram"))
    return found.join(rarest, "gram").select("id", "key").distinct()


def holding(texts: DataFrame, keys: DataFrame) -> DataFrame:
    """The ids, each once, of texts (id, text) that hold one of the keys; null texts hold none."""
    by_text = written(candidates(texts, keys), "candidates").groupBy("id").agg(F.collect_list("key").alias("keys"))
    return texts.join(by_text, "id").where(F.exists("keys", lambda k: F.contains(F.col("text"), k))).select("id").distinct()
