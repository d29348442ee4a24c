"""Operator 10: packing documents into token sequences by a grouping genetic algorithm.

1. Every text is encoded once; a document longer than a sequence is cut, its remainder first and then whole sequences.
   Pieces go to the shared folder. Whole ones are sequences by themselves.
2. The others are dealt round robin into shards of about ``SHARD`` pieces, a bounded row each. On every shard several
   islands evolve packings: an individual is a set of bins; crossover injects whole well-filled bins of one parent into
   the other, removes bins that hold the same pieces and refits the displaced pieces; mutation empties the least-filled
   bins. Refitting first exchanges pieces: wherever a displaced piece fills a bin better than one of its pieces, they
   change places, so what is left over is small and best-fits more easily, largest first. Between epochs each island's elite migrates to the next island of its shard (a shuffle).
   A shard that has reached its lower bound rests: no packing has fewer bins (see ``least_bins``).
3. Each shard's best packing gives sequence numbers and offsets.

Random choices depend on shard, island and epoch only, so a repeated task gives the same packing.

Cases: a null text counts as empty; an empty text is its end token alone; repeated rows are packed each; other columns
are ignored; an empty table gives none.
"""

from __future__ import annotations

import random
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditspark.llm.byte_tokens import byte_tokens, forget
from auditspark.llm.shared import id_text, lean, slices, tokenizer_path, written

#: Tokens of a sequence, and the id that ends a document.
LENGTH, END = 1024, 2
#: Pieces a shard, islands a shard, individuals an island, epochs, children an epoch.
SHARD, ISLANDS, POPULATION, EPOCHS, CHILDREN = 8192, 2, 4, 3, 6
#: Most tasks of an epoch.
MOST_TASKS = 10_000
_GENOMES = "shard long, island int, sizes array<int>, genomes array<array<int>>"


def pieces(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, end: int = END) -> DataFrame:
    """(id, piece, start, length, ids_crc32): every document's tokens and the end token, cut to ``length``, the short piece first."""
    last = np.array([end], np.uint32).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = byte_tokens(vocabulary)
        for b in slices(batches):
            rows: list[tuple] = []
            for k, ids in enumerate(own.encode(b.column(1).to_pylist())):
                ids += last
                n, start, number = len(ids) // 4, 0, 0
                while start < n:
                    size = (n - start) % length or length
                    rows.append((k, number, start, size, zlib.crc32(ids[4 * start : 4 * (start + size)])))
                    start += size
                    number += 1
            at, *cols = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *(pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True))], names=["id", "piece", "start", "length", "ids_crc32"])

    rows = id_text(df, id_col, text_col)
    return rows.mapInArrow(lean(run, "packing", forget), f"id {rows.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long")


class Bins:
    """A packing under construction: members and free space of bins, found by free space in constant time."""

    def __init__(self, room: int):
        self.room, self.members, self.free = room, [], []
        self.by_free: list[list[int]] = [[] for _ in range(room + 1)]
        self.mask = 0  # bit f: some bin has f free

    def add_bin(self, members: list[int], free: int) -> None:
        self.by_free[free].append(len(self.members))
        self.mask |= 1 << free
        self.members.append(members)
        self.free.append(free)

    def best_fit(self, item: int, size: int) -> None:
        """Into the bin with the least free space that suffices, or a new one."""
        fits = self.mask >> size
        if not fits:
            self.add_bin([item], self.room - size)
            return
        free = size + (fits & -fits).bit_length() - 1
        k = self.by_free[free].pop()
        if not self.by_free[free]:
            self.mask ^= 1 << free
        self.members[k].append(item)
        self.free[k] = free - size
        self.by_free[free - size].append(k)
        self.mask |= 1 << (free - size)


def least_bins(sizes: list[int], room: int) -> int:
    """A lower bound of the number of bins. For every limit up to half a bin: items larger than the room less the limit
    share no bin with one of at least the limit; others above half a bin need a bin each; what items from the limit up
    to half a bin don't find room for beside those needs further bins."""
    counts = np.bincount(sizes, minlength=room + 1)
    above = np.append(np.cumsum(counts[::-1])[::-1], 0)  # items of at least a size
    tokens = np.append(np.cumsum((counts * np.arange(room + 1))[::-1])[::-1], 0)
    half, best = room // 2 + 1, 0
    for limit in range(room // 2 + 1):
        alone = int(above[room - limit + 1])
        big = int(above[half]) - alone
        left = int(tokens[limit] - tokens[half]) - (big * room - int(tokens[half] - tokens[room - limit + 1]))
        best = max(best, alone + big + max(0, -(-left // room)))
    return best


def fitness(bins: Bins) -> tuple[int, int]:
    """To be least: the number of bins, then minus the sum of squared fills (well-filled bins beside a nearly empty one)."""
    return len(bins.members), -sum((bins.room - f) ** 2 for f in bins.free)


def best_fit_all(sizes: list[int], order: list[int], room: int) -> Bins:
    bins = Bins(room)
    for k in order:
        bins.best_fit(k, sizes[k])
    return bins


def exchanged(members: list[int], free: int, sizes: list[int], pool: list[tuple[int, int]]) -> tuple[list[int], int]:
    """A bin and its free space after its items have changed places with larger ones of the sorted pool (size, item) that fit."""
    members = list(members)
    for at, k in enumerate(members):
        place = bisect_right(pool, (sizes[k] + free, len(sizes))) - 1
        if place >= 0 and pool[place][0] > sizes[k]:
            size, members[at] = pool.pop(place)
            insort(pool, (sizes[k], k))
            free -= size - sizes[k]
            if not free:
                break
    return members, free


def rebuilt(bins: Bins, kept: Iterator[int], injected: list[list[int]], sizes: list[int], displaced: list[int]) -> Bins:
    """The kept bins, after exchanges with the displaced items, and the injected ones; best fit for what is displaced then, largest first."""
    out = Bins(bins.room)
    for members in injected:
        out.add_bin(list(members), bins.room - sum(sizes[k] for k in members))
    pool = sorted((sizes[k], k) for k in displaced)
    for k in kept:
        out.add_bin(*(exchanged(bins.members[k], bins.free[k], sizes, pool) if bins.free[k] else (list(bins.members[k]), 0)))
    for size, k in reversed(pool):
        out.best_fit(k, size)
    return out


def crossover(one: Bins, two: Bins, sizes: list[int], rng: random.Random, share: float = 0.15) -> Bins:
    """Well-filled bins of ``two`` injected into ``one``; its bins with the same items go, their other items are refitted."""
    n = max(1, int(len(two.members) * share))
    order = sorted(range(len(two.members)), key=lambda k: (two.free[k], rng.random()))
    injected = [two.members[k] for k in rng.sample(order[: 2 * n], min(n, len(order)))]
    taken = {k for members in injected for k in members}
    hit = [any(k in taken for k in members) for members in one.members]
    displaced = [k for members, h in zip(one.members, hit, strict=True) if h for k in members if k not in taken]
    return rebuilt(one, (k for k, h in enumerate(hit) if not h), injected, sizes, displaced)


def mutated(bins: Bins, sizes: list[int], rng: random.Random, share: float = 0.03) -> Bins:
    """The least-filled bins and some others emptied and refitted."""
    n = max(2, int(len(bins.members) * share))
    emptied = set(sorted(range(len(bins.members)), key=lambda k: -bins.free[k])[:n]) | {rng.randrange(len(bins.members)) for _ in range(n)}
    displaced = [k for b in emptied for k in bins.members[b]]
    return rebuilt(bins, (k for k in range(len(bins.members)) if k not in emptied), [], sizes, displaced)


def _genome(bins: Bins, n: int) -> np.ndarray:
    out = np.empty(n, np.int32)
    for b, members in enumerate(bins.members):
        out[members] = b
    return out


def _bins(genome: np.ndarray, sizes: list[int], room: int) -> Bins:
    members: list[list[int]] = [[] for _ in range(int(max(genome)) + 1)]
    for k, b in enumerate(genome):
        members[b].append(k)
    out = Bins(room)
    for m in members:
        out.add_bin(m, room - sum(sizes[k] for k in m))
    return out


def evolve(sizes: list[int], genomes: list[np.ndarray], room: int, seed: str, population: int = POPULATION, children: int = CHILDREN) -> list[np.ndarray]:
    """One epoch of one island; the best individual comes first. Without genomes the island is founded."""
    rng, n = random.Random(seed), len(sizes)
    bound = least_bins(sizes, room)
    alive = [_bins(g, sizes, room) for g in genomes]
    if not alive:
        alive.append(best_fit_all(sizes, sorted(range(n), key=lambda k: -sizes[k]), room))
        while len(alive) < population and len(alive[0].members) > bound:
            blur = [s * rng.uniform(0.8, 1.25) for s in sizes]
            alive.append(best_fit_all(sizes, sorted(range(n), key=lambda k: -blur[k]), room))
    alive.sort(key=fitness)
    for _ in range(children):
        if len(alive[0].members) <= bound:
            break
        one, two = (min(rng.choices(alive, k=2), key=fitness) for _ in range(2))
        child = crossover(one, two, sizes, rng)
        if rng.random() < 0.5:
            child = mutated(child, sizes, rng)
        alive = sorted([*alive, child], key=fitness)[:population]
    return [_genome(b, n) for b in alive]


def _epoch(state: DataFrame, room: int, number: int) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [evolve([int(s) for s in r.sizes], [np.asarray(g) for g in r.genomes], room, f"{r.shard}/{r.island}/{number}") for r in b.itertuples()]
            yield b.assign(genomes=[[g.tolist() for g in gs] for gs in out])

    return state.mapInPandas(lean(run, "packing", forget), _GENOMES)


def packed(items: DataFrame, room: int = LENGTH, shard_items: int = SHARD, islands: int = ISLANDS, epochs: int = EPOCHS) -> DataFrame:
    """``items`` (a written table with a ``length`` of at most ``room``) with sequence_id and offset."""
    row = F.struct(*items.columns)
    full = items.where(F.col("length") >= room).withColumns({"sequence_id": -1 - F.monotonically_increasing_id(), "offset": F.lit(0).cast("long")})
    rest = items.where(F.col("length") < room)
    n = max(1, -(-rest.count() // shard_items))
    dealt = rest.select(row.alias("item"), F.pmod(F.monotonically_increasing_id(), F.lit(n)).alias("shard"))
    shards = written(dealt.groupBy("shard").agg(F.collect_list("item").alias("items")), "shards")
    sizes = F.transform("items", lambda x: x["length"].cast("int"))
    state = shards.select("shard", sizes.alias("sizes"), F.explode(F.sequence(F.lit(0), F.lit(islands - 1))).alias("island"))
    state = state.select("shard", "island", "sizes", F.array().cast("array<array<int>>").alias("genomes")).repartition(min(n * islands, MOST_TASKS), "shard", "island")
    for number in range(epochs):
        if number:  # each island gets the elite of the one before
            elites = state.select("shard", ((F.col("island") + 1) % islands).alias("island"), F.slice("genomes", 1, 1).alias("elite"))
            state = state.join(elites, ["shard", "island"]).select("shard", "island", "sizes", F.array_distinct(F.concat("genomes", "elite")).alias("genomes"))
        state = written(_epoch(state, room, number), "islands")
    bins = F.array_max(F.col("genomes")[0])
    best = state.groupBy("shard").agg(F.min_by(F.col("genomes")[0], F.struct(bins, "island")).alias("genome"))
    placed = shards.join(best, "shard").select("shard", F.explode(F.arrays_zip("items", "genome")).alias("x")).select("shard", "x.items", F.col("x.genome").alias("bin"))
    # A sequence's pieces are few (at most ``room``), so a window over them is small.
    order = [F.col("items")[c] for c in items.columns]
    from pyspark.sql import Window

    before = Window.partitionBy("shard", "bin").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.select("items.*", (F.col("shard") * (1 << 32) + F.col("bin")).alias("sequence_id"), F.coalesce(F.sum("items.length").over(before), F.lit(0)).alias("offset"))
    return placed.unionByName(full)


def packed_documents(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, piece, start, length, ids_crc32, sequence_id, offset) of every piece of every document."""
    return packed(written(pieces(df, vocabulary, id_col, text_col), "pieces")).withColumnRenamed("id", id_col)


def op10_packing(spark, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens."""
    return packed_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), tokenizer_path("byte_bpe_50k.json"))
