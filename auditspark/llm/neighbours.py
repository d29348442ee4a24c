"""Operator 12: approximate nearest neighbours by a hierarchical k-means tree and best-bin-first search.

1. Of equal vectors only the k + 1 smallest ids can ever be among k results with ties to smaller ids, so the others are set
   aside before anything else, without loss; a large group of copies is cut down in the map tasks (a window's limit).
2. One more coordinate makes all vectors equally long, so the largest inner product is the nearest point. A tree of k-means
   with ``BRANCH`` children a node is fitted on at most ``SAMPLE`` vectors (a parameter); every vector goes down the tree to
   a leaf. The tree has at most ``SAMPLE / LEAST_IN_LEAF`` leaves and goes to every task.
3. A query walks the tree best-bin-first: a priority queue of nodes by distance to the query; a leaf that is taken from it
   is visited. For at most ``PROBES`` sampled queries the exact neighbours are found against all rows, in blocks, and the
   number of visits is widened until the share of them that lies in visited leaves reaches ``recall``; all queries then
   visit so many leaves, and more while the visited leaves hold fewer than k + 1 rows.
4. Neighbouring leaves form shards of about ``SHARD_ROWS`` rows; a leaf with more is several shards, split by id. A query
   goes to a shard once, with its leaves there; shards that many queries visit are repeated for parts of ``PART_ROWS``
   queries. So a task holds a bounded block of either side. It returns k candidates a query at most, and the best are ranked.

Products of blocks find candidates with a small margin; those are scored anew, component by component in order, so that
equal vectors have equal scores wherever they lie.

Cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, nor do vectors of another
length than the table's commonest (the shortest of equals) or rows without an id; a query's id is never its own neighbour;
a repeated id asks once (with its smallest vector) but every row of it is a candidate for others; with fewer candidates
than k all are returned; without queries, or in an empty table, there are no rows. Other columns never matter.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.llm.shared import small_batches, written

#: Vectors that the tree is fitted on, at most; children of a node; sampled queries whose exact neighbours set the visits.
SAMPLE, BRANCH, PROBES = 20_000, 8, 256
#: Rows that a leaf should hold, and the fewest sampled vectors in one (so the tree stays bounded where rows don't).
LEAF_ROWS, LEAST_IN_LEAF = 256, 5
#: Rows of a shard, and queries that one task compares with it.
SHARD_ROWS, PART_ROWS = 4096, 4096
#: Share of the probes' neighbours that must lie in visited leaves.
RECALL = 0.96


class Tree:
    """A k-means tree: ``centres`` of the nodes, the children of node n are first[n] to first[n] + count[n] - 1."""

    def __init__(self, points: np.ndarray, in_leaf: int, branch: int = BRANCH, seed: int = 1):
        rng = np.random.default_rng(seed)
        centres, first, count = [points.mean(0)], [0], [0]
        todo = [(0, points)]
        while todo:
            node, own = todo.pop()
            parts = self._parts(own, min(branch, math.ceil(len(own) / in_leaf)), rng) if len(own) > in_leaf else []
            if len(parts) > 1:
                first[node], count[node] = len(centres), len(parts)
                todo += [(len(centres) + k, p) for k, p in enumerate(parts)]
                centres += [p.mean(0) for p in parts]
                first += [0] * len(parts)
                count += [0] * len(parts)
        self.centres, self.first, self.count = np.array(centres), np.array(first), np.array(count)
        self.squares = (self.centres**2).sum(1)
        self.leaf = np.full(len(centres), -1)  # leaves in depth-first order, so that neighbours in number are neighbours in space
        n, stack = 0, [0]
        while stack:
            node = stack.pop()
            if count[node]:
                stack += range(first[node] + count[node] - 1, first[node] - 1, -1)
            else:
                self.leaf[node], n = n, n + 1
        self.leaves = n

    @staticmethod
    def _parts(points: np.ndarray, k: int, rng: np.random.Generator) -> list[np.ndarray]:
        """The points by nearest of k centres, after some rounds of k-means; empty parts are left out."""
        centres, near = points[[rng.integers(len(points))]], None
        for _ in range(k - 1):  # the next centre far from the others, at random
            near = ((points - centres[-1]) ** 2).sum(1) if near is None else np.minimum(near, ((points - centres[-1]) ** 2).sum(1))
            if not near.sum() > 0:
                break
            centres = np.vstack([centres, points[rng.choice(len(points), p=near / near.sum())]])
        for _ in range(8):
            own = ((centres**2).sum(1) - 2 * points @ centres.T).argmin(1)
            centres = np.array([points[own == c].mean(0) for c in np.unique(own)])
        own = ((centres**2).sum(1) - 2 * points @ centres.T).argmin(1)
        return [points[own == c] for c in np.unique(own)]

    def down(self, points: np.ndarray) -> np.ndarray:
        """The leaf of each point: from the root, always to the nearest child."""
        node = np.zeros(len(points), np.int64)
        while True:
            open_ = np.flatnonzero(self.count[node])
            if not len(open_):
                return self.leaf[node]
            order = open_[np.argsort(node[open_], kind="stable")]
            for rows in np.split(order, np.flatnonzero(np.diff(node[order])) + 1):
                a = self.first[node[rows[0]]]
                b = a + self.count[node[rows[0]]]
                node[rows] = a + (self.squares[a:b] - 2 * points[rows] @ self.centres[a:b].T).argmin(1)

    def walk(self, distances: np.ndarray) -> Iterator[int]:
        """Leaves in best-bin-first order, given a query's distances to all nodes."""
        queue = [(0.0, 0)]
        while queue:
            node = heapq.heappop(queue)[1]
            if self.count[node]:
                for child in range(self.first[node], self.first[node] + self.count[node]):
                    heapq.heappush(queue, (distances[child], child))
            else:
                yield int(self.leaf[node])

    def distances(self, queries: np.ndarray) -> np.ndarray:
        """Squared distances to all nodes, up to a constant of the query."""
        return self.squares - 2 * queries @ self.centres.T


def longer(vectors: np.ndarray, length: float) -> np.ndarray:
    """The vectors with one more coordinate, which gives all the same length."""
    return np.hstack([vectors, np.sqrt(np.maximum(length**2 - (vectors**2).sum(1), 0))[:, None]])


def aimed(queries: np.ndarray, length: float) -> np.ndarray:
    """Queries at the vectors' length, whose further coordinate is 0: the order of inner products stays the same."""
    return np.hstack([queries * (length / np.sqrt((queries**2).sum(1)))[:, None], np.zeros((len(queries), 1))])


def matrix(column: pa.Array) -> np.ndarray:
    flat = (column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column).flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64, copy=False).reshape(len(column), -1)


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(id, v array<double>) of the rows that take part."""
    small_batches(df.sparkSession)
    rows = df.select(df[id_col].alias("id"), df[vector_col].cast("array<double>").alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    fine = F.forall("v", lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(fine)
    most = rows.groupBy(F.size("v").alias("n")).agg(F.count("*").alias("rows")).orderBy(F.desc("rows"), "n").first()
    return rows.where(F.size("v") == (most["n"] if most else 0))


def sampled(rows: DataFrame, total: int, most: int, seed: str) -> pa.Table:
    """At most ``most`` of the rows, by a hash of their ids: a share of the rows first, so that no task gathers more than its part."""
    key = F.xxhash64(F.col("id"), F.lit(seed))
    share = min(1.0, 1.3 * most / max(total, 1) + 50 / max(total, 1))
    return rows.where(F.pmod(key, F.lit(1 << 40)) < int(share * (1 << 40))).orderBy(key, "id").limit(most).select("id", "v").toArrow()


class Index:
    """The tree, the shards of its leaves, and the number of visits: all bounded by ``SAMPLE``; goes to the tasks."""

    def __init__(self, tree: Tree, length: float):
        self.tree, self.length, self.visits = tree, length, 1

    def place(self, rows_in_leaf: dict[int, int]) -> None:
        """Shards: whole leaves in a row up to SHARD_ROWS rows, or one leaf in blocks. ``first`` and ``blocks`` by leaf."""
        total = sum(rows_in_leaf.values())
        fair = total / max(1, math.ceil(total / SHARD_ROWS))
        self.rows = np.array([rows_in_leaf.get(k, 0) for k in range(self.tree.leaves)], np.int64)
        self.blocks = np.maximum(1, -(-self.rows // SHARD_ROWS))
        self.first = np.zeros(self.tree.leaves, np.int64)
        shard, held = 0, 0
        for leaf, n in enumerate(self.rows):
            if held and (held + n / 2 > fair or self.blocks[leaf] > 1):
                shard, held = shard + 1, 0
            self.first[leaf] = shard
            if self.blocks[leaf] > 1:
                shard += int(self.blocks[leaf])
            else:
                held += n

    def visited(self, distances: np.ndarray, k: int) -> list[int]:
        leaves, rows = [], 0
        for leaf in self.tree.walk(distances):
            if len(leaves) >= self.visits and rows > k:
                break
            leaves.append(leaf)
            rows += self.rows[leaf]
        return leaves

    def calibrate(self, probes: np.ndarray, neighbours: list[list[int]], recall: float) -> None:
        """Widens the visits until ``recall`` of the neighbours (their leaves, by probe) lie in visited leaves."""
        at = []
        for distances, leaves in zip(self.tree.distances(aimed(probes, self.length)), neighbours, strict=True):
            place = {leaf: k for k, leaf in enumerate(self.tree.walk(distances))}
            at += [place[leaf] for leaf in leaves]
        at = np.array(at)
        while self.visits < self.tree.leaves and len(at) and (at < self.visits).mean() < recall:
            self.visits += 1


def in_leaves(rows: DataFrame, tree: Tree, length: float) -> DataFrame:
    """(id, v, leaf) of every row."""
    shared = rows.sparkSession.sparkContext.broadcast(tree)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                leaf = shared.value.down(longer(matrix(b.column(1)), length))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(leaf, pa.int32())], names=["id", "v", "leaf"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, v array<double>, leaf int")


def exact(rows: DataFrame, probes: pa.Table, k: int) -> DataFrame:
    """(probe, leaf) of the exact neighbours of a bounded list of probes (id, v): blocks of all rows against all probes."""
    shared = rows.sparkSession.sparkContext.broadcast((probes["id"].to_pylist(), matrix(probes["v"])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, wanted = shared.value
        kept = [np.empty((len(ids), 0)), np.empty((len(ids), 0), np.int64)]
        for b in batches:
            if b.num_rows:
                place = {x: i for i, x in enumerate(ids)}
                scores = wanted @ matrix(b.column(1)).T
                for j, x in enumerate(b.column(0).to_pylist()):
                    if x in place:
                        scores[place[x], j] = -np.inf
                scores = np.hstack([kept[0], scores])
                leaves = np.hstack([kept[1], np.broadcast_to(b.column(2).to_numpy(), (len(ids), b.num_rows))])
                best = np.argsort(-scores, axis=1, kind="stable")[:, :k]
                kept = [np.take_along_axis(scores, best, 1), np.take_along_axis(leaves, best, 1)]
        probe, score, leaf = np.repeat(np.arange(len(ids)), kept[0].shape[1]), kept[0].ravel(), kept[1].ravel()
        real = score > -np.inf
        yield pa.RecordBatch.from_arrays([pa.array(probe[real], pa.int32()), pa.array(score[real], pa.float64()), pa.array(leaf[real], pa.int32())], names=["probe", "score", "leaf"])

    found = rows.mapInArrow(run, "probe int, score double, leaf int")
    return found.withColumn("n", F.row_number().over(Window.partitionBy("probe").orderBy(F.desc("score"), "leaf"))).where(F.col("n") <= k).select("probe", "leaf")


def routed(queries: DataFrame, index: Index, k: int) -> DataFrame:
    """(shard, id, v, leaves) of every shard that a query visits."""
    shared = queries.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                shards, rows, leaves = [], [], []
                for row, distances in enumerate(own.tree.distances(aimed(matrix(b.column(1)), own.length))):
                    by: dict[int, list[int]] = {}
                    for leaf in own.visited(distances, k):
                        for shard in range(own.first[leaf], own.first[leaf] + own.blocks[leaf]):
                            by.setdefault(shard, []).append(leaf)
                    shards += by
                    rows += [row] * len(by)
                    leaves += by.values()
                picked = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(shards, pa.int64()), b.column(0).take(picked), b.column(1).take(picked), pa.array(leaves, pa.list_(pa.int32()))], names=["shard", "id", "v", "leaves"])

    return queries.mapInArrow(run, f"shard long, id {queries.schema['id'].dataType.simpleString()}, v array<double>, leaves array<int>")


def in_shards(rows: DataFrame, index: Index) -> DataFrame:
    """(shard, id, v, leaf): a leaf's first shard from its number, and one of its blocks by id."""
    first, blocks = (F.array(*[F.lit(int(x)) for x in column])[F.col("leaf")] for column in (index.first, index.blocks))
    if index.tree.leaves > 64:  # too long to write out in the plan
        table = rows.sparkSession.createDataFrame([(k, int(a), int(b)) for k, (a, b) in enumerate(zip(index.first, index.blocks, strict=True))], "leaf int, first long, blocks long")
        rows = rows.join(F.broadcast(table), "leaf")
        first, blocks = F.col("first"), F.col("blocks")
    return rows.select((first + F.pmod(F.xxhash64("id"), blocks)).alias("shard"), "id", "v", "leaf")


def _best_in_shard(rows: pa.Table, queries: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query row, candidate row, score): at most k for each query, from the leaves that it visits."""
    x, q, leaf = matrix(rows["v"]), matrix(queries["v"]), rows["leaf"].to_numpy()
    ids, asking = (pa.chunked_array(t["id"].chunks).combine_chunks().dictionary_encode() for t in (rows, queries))
    names = {v: i for i, v in enumerate(ids.dictionary.to_pylist())}
    own = ids.indices.to_numpy()
    self_ = np.array([names.get(v, -1) for v in asking.to_pylist()])
    wanted = queries["leaves"].combine_chunks()
    q_of, l_of = np.repeat(np.arange(len(q)), wanted.value_lengths().to_numpy()), wanted.flatten().to_numpy()
    margin = 1e-9 * np.sqrt((q**2).sum(1) * (x**2).sum(1).max())
    pool = [(np.empty(0, np.int64), np.empty(0, np.int64))]
    for number in np.unique(leaf):
        here, there = np.flatnonzero(leaf == number), q_of[l_of == number]
        for at in range(0, len(there), 1024):
            some = there[at : at + 1024]
            s = q[some] @ x[here].T
            s[self_[some, None] == own[None, here]] = -np.inf
            least = np.partition(s, -k, 1)[:, -k] - margin[some] if len(here) > k else np.full(len(some), -np.finfo(float).max)
            a, b = np.nonzero((s >= least[:, None]) & (s > -np.inf))
            pool.append((some[a], here[b]))
    a, b = (np.concatenate(x) for x in zip(*pool, strict=True))
    score = np.zeros(len(a))
    for d in range(x.shape[1]):
        score += q[a, d] * x[b, d]
    rank = pa.compute.sort_indices(pa.table({"q": a, "s": -score, "id": ids.take(pa.array(b)).dictionary_decode()}), [("q", "ascending"), ("s", "ascending"), ("id", "ascending")]).to_numpy()
    a, b, score = a[rank], b[rank], score[rank]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    keep = place < k
    return a[keep], b[keep], score[keep]


def nearest(df: DataFrame, asked: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", recall: float = RECALL) -> DataFrame:
    """(query_id, rank, id, score): the ``k`` rows with the largest inner products for each row that is ``asked`` about."""
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    everything = usable(df.withColumn(id_col, df[id_col]), id_col, vector_col)
    copy = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    rows = written(everything.withColumn("copy", copy).where(F.col("copy") <= k + 1).select("id", "v"), "vectors")
    queries = usable(df.where(asked), id_col, vector_col).groupBy("id").agg(F.min("v").alias("v"))
    total, square = rows.agg(F.count("*"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))).first()
    dimension = F.size("v") == (len(rows.first().v) if total else 0)
    queries = written(queries.where(dimension), "queries")
    if not total or queries.isEmpty():
        return spark.createDataFrame([], f"query_id {kind}, rank int, `{id_col}` {kind}, score double")
    length = math.sqrt(square)
    fit = longer(matrix(sampled(rows, total, SAMPLE, "tree")["v"]), length)
    index = Index(Tree(fit, max(LEAST_IN_LEAF, math.ceil(LEAF_ROWS * len(fit) / total))), length)
    rows = written(in_leaves(rows, index.tree, length), "leaves")
    index.place({r.leaf: r.n for r in rows.groupBy("leaf").agg(F.count("*").alias("n")).collect()})  # one row a leaf
    probes = sampled(queries, queries.count(), PROBES, "probe")
    neighbours: list[list[int]] = [[] for _ in range(probes.num_rows)]
    for r in exact(rows, probes, k).collect():  # k rows a probe
        neighbours[r.probe].append(r.leaf)
    index.calibrate(matrix(probes["v"]), neighbours, recall)
    visits = written(routed(queries, index, k), "visits")
    parts = visits.groupBy("shard").agg(F.ceil(F.count("*") / PART_ROWS).alias("parts"))
    left = in_shards(rows, index).join(parts, "shard").select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).drop("parts")
    right = visits.join(parts, "shard").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts"))).drop("parts")
    left, right = (side.select(*[F.col(c).alias(c) for c in side.columns]) for side in (left, right))

    def search(block: pa.Table, asking: pa.Table) -> pa.Table:
        names = ["query_id", "id", "score"]
        if not block.num_rows or not asking.num_rows:
            return pa.table([asking["id"].slice(0, 0), asking["id"].slice(0, 0), pa.array([], pa.float64())], names)
        a, b, score = _best_in_shard(block, asking, k)
        return pa.table([asking["id"].take(pa.array(a)), block["id"].take(pa.array(b)), pa.array(score)], names)

    found = left.groupBy("shard", "part").cogroup(right.groupBy("shard", "part")).applyInArrow(search, f"query_id {kind}, id {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def op12_neighbours(spark, sf_dir: str) -> DataFrame:
    """The 20 nearest of every vector whose id is divisible by 20, among all others."""
    out = nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0)
    return out.select(F.col("query_id").cast("long").alias("query_id"), F.col("rank").cast("int").alias("rank"), F.col("vec_id").cast("long").alias("vec_id"), "score")
