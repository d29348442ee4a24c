"""Trees and forests by binned histograms: every level of all trees is one aggregation.

Features are cut at given edges, so a row is a few small numbers. A tree's weights and positives of rows with equal
numbers are added up in one scan and written, at most as many as the numbers have combinations, however many rows there
are. For each level those are summed by (tree, node, feature, bin), a window over these few sums finds each node's best cut
by Gini impurity, and the cuts (at most 2 ^ depth a tree) are all that the driver sees. A tree's bootstrap weights are
Poisson numbers from the digest of (row, tree); the features a node may use come from a digest of (tree, node, feature).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditspark.functions.scalars import ratio
from auditspark.operators import running
from auditspark.sources.workspace import written

#: Chances of a Poisson number of mean 1 to be at most 0, 1, 2, ...
POISSON = (0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119, 0.9999897508033253)
_DIGITS = [f"{int(u * 2**32):08x}" for u in POISSON]


def edges(df: DataFrame, features: Sequence[str], bins: int = 32) -> dict[str, list[float]]:
    """Approximate quantiles of each feature, as cut points."""
    return {f: running.quantiles(df.select(F.col(f).cast("double").alias(f)), f, bins).get((), []) for f in features}


class Forest:
    """Cuts of all trees by (tree, node): (feature number, bin); node n has children 2n and 2n + 1; rows at or below go left."""

    def __init__(self, features: Sequence[str], cuts: dict[str, list[float]]):
        self.features, self.cuts = list(features), cuts
        self.splits: dict[tuple[int, int], tuple[int, int]] = {}
        #: (tree, node, feature) to the weighted decrease of impurity; (tree, node) to the share of positives.
        self.gains: dict[tuple[int, int, str], float] = {}
        self.shares: dict[tuple[int, int], float] = {}

    def bins(self) -> list[Column]:
        return [running.ranges(F.col(f).cast("double"), self.cuts[f]) for f in self.features]

    def node(self, tree: int, bins: Column) -> Column:
        """The node of a tree that a row is in: its cuts as comparisons."""

        def below(n: int) -> Column:
            if (tree, n) not in self.splits:
                return F.lit(n)
            feature, cut = self.splits[tree, n]
            return F.when(bins[feature] <= cut, below(2 * n)).otherwise(below(2 * n + 1))

        return below(1)

    def score(self, trees: int) -> Column:
        """The mean of the trees' shares of positives."""
        bins = F.array(*self.bins())
        total = F.lit(0.0)
        for t in range(trees):
            here, out = self.node(t, bins), None
            for (tree, n), share in sorted(self.shares.items()):
                if tree == t:
                    out = F.when(here == n, share) if out is None else out.when(here == n, share)
            total = total + out
        return total / trees

    def importances(self, spark) -> DataFrame:
        """(feature, importance): each tree's decreases of impurity as shares of 1, averaged over trees that have any."""
        trees: dict[int, dict[str, float]] = {}
        for (tree, _, feature), gain in self.gains.items():
            own = trees.setdefault(tree, {})
            own[feature] = own.get(feature, 0.0) + gain
        totals = {t: sum(own.values()) for t, own in trees.items()}
        used = [t for t in trees if totals[t] > 0]
        rows = [(f, sum(trees[t].get(f, 0.0) / totals[t] for t in used) / max(1, len(used))) for f in self.features]
        return spark.createDataFrame(sorted(rows, key=lambda r: (-r[1], r[0])), "feature string, importance double")


def _weighted(rows: DataFrame, trees: int, seed: int) -> DataFrame:
    """(tree, w, p, bins) of the rows' ``bins`` that a tree draws, equal ones added up: weights and weighted positives.

    A row's digests are taken once, not for every level; what levels read grows with the different bins, not with the rows.
    """
    n = len(rows.schema["bins"].dataType.names)
    if trees == 1:
        drawn = rows.select(F.lit(0).alias("tree"), F.lit(1.0).alias("w"), "y", "bins.*")
    else:
        spread = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # a small file is one task
        drawn = spread.select("row", "y", "bins.*", F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
        # A digest's first eight hexadecimal digits are in the order of the numbers that they stand for.
        digits = F.substring(F.md5(F.concat_ws("|", "row", "tree", F.lit(seed))), 1, 8)
        drawn = drawn.withColumn("digits", digits).where(F.col("digits") > _DIGITS[0]).withColumn("w", running.ranges(F.col("digits"), _DIGITS).cast("double"))
    names = [f"b{k}" for k in range(n)]
    added = drawn.groupBy("tree", *names).agg(F.sum("w").alias("w"), F.sum(F.col("w") * F.col("y")).alias("p"))
    return added.select("tree", "w", "p", F.array(*names).alias("bins"))


def _placed(rows: DataFrame, forest: Forest, level: int) -> DataFrame:
    """(tree, node, w, p, bins) of the rows in nodes of a level: a join with each earlier level's cuts, at most 2 ^ level a tree."""
    out = rows.withColumn("node", F.lit(1))
    for earlier in range(level):
        cuts = [(t, n, f, b) for (t, n), (f, b) in forest.splits.items() if n >> earlier == 1]
        table = rows.sparkSession.createDataFrame(cuts, "tree int, node int, feature int, cut int")
        out = out.join(F.broadcast(table), ["tree", "node"]).withColumn("node", 2 * F.col("node") + (F.col("bins")[F.col("feature")] > F.col("cut")).cast("int")).drop("feature", "cut")
    return out.select("tree", "node", "w", "p", "bins")


def grown(df: DataFrame, features: Sequence[str], target: str, key: str, cuts: dict[str, list[float]] | None = None, trees: int = 20, depth: int = 4, tried: int | None = None, seed: int = 42) -> Forest:
    """A forest of classifiers; one tree uses all rows and features as they are.

    ``tried``: features that a node may use (the square root of all, unless given). Null features are in the first bin; rows
    without a target take no part.
    """
    cuts = cuts or edges(df, features)
    forest = Forest(features, cuts)
    tried = tried or (len(features) if trees == 1 else max(1, round(len(features) ** 0.5)))
    bins = F.struct(*[c.alias(f"b{k}") for k, c in enumerate(forest.bins())])
    rows = df.where(F.col(target).isNotNull()).select(F.col(key).cast("string").alias("row"), F.col(target).cast("double").alias("y"), bins.alias("bins"))
    rows = written(_weighted(rows, trees, seed), "weighted")
    for level in range(depth + 1):
        cells = _placed(rows, forest, level).select("tree", "node", "w", "p", F.posexplode("bins").alias("feature", "bin"))
        cells = cells.groupBy("tree", "node", "feature", "bin").agg(F.sum("w").alias("w"), F.sum("p").alias("p"))
        node = Window.partitionBy("tree", "node", "feature")
        upto = node.orderBy("bin")
        cells = cells.withColumns({"lw": F.sum("w").over(upto), "lp": F.sum("p").over(upto), "nw": F.sum("w").over(node), "np": F.sum("p").over(node)})
        gini = lambda w, p: F.when(w > 0, 2 * p * (w - p) / w).otherwise(0.0)
        rw, rp = F.col("nw") - F.col("lw"), F.col("np") - F.col("lp")
        gain = gini(F.col("nw"), F.col("np")) - gini(F.col("lw"), F.col("lp")) - gini(rw, rp)
        chance = F.md5(F.concat_ws("|", "tree", "node", "feature", F.lit(seed)))
        allowed = F.dense_rank().over(Window.partitionBy("tree", "node").orderBy(chance)) <= tried
        cells = cells.withColumns({"gain": F.when(rw > 0, F.round(gain, 9)), "allowed": allowed})
        best = F.max_by(F.struct("feature", "bin", "gain"), F.when((F.col("gain") > 0) & F.col("allowed"), F.struct(F.col("gain"), -F.col("feature"), -F.col("bin"))))
        for r in cells.groupBy("tree", "node").agg(best.alias("best"), ratio(F.max("np"), F.max("nw")).alias("share")).select("tree", "node", "best.*", "share").collect():
            forest.shares[r.tree, r.node] = r.share
            if r.feature is not None and level < depth:
                forest.splits[r.tree, r.node] = r.feature, r.bin
                forest.gains[r.tree, r.node, features[r.feature]] = r.gain
        if not any(n >= 1 << level for _, n in forest.splits):
            break
    return forest
