"""Operator 5: toxicity by weak supervision.

Voters are words of a small lexicon, words and word beginnings that go with label 1 among the labelled rows (a beginning
may vote once or only where several words of a text have it), and a few patterns. A generative model with a hidden class
estimates by EM how often each voter fires in either class (the given label is one more voter, with an accuracy of its
own) and how voters are correlated: given the class each voter depends on one other voter, along the tree of greatest
conditional mutual information, so voters that say the same count once. Its posterior labels train a logistic regression
on the voters' votes, which scores every text.

Fitting takes at most ``SAMPLE`` labelled rows (those with the smallest id hashes); everything else covers all rows.

Cases: a null text counts as empty; a text without any vote gets the score of the intercept; without labelled rows of
both classes the lexicon alone votes with fixed weights; repeated rows get equal scores; texts of any length are read
whole; other columns are ignored, whatever their names; an empty table gives an empty one.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditspark.llm.shared import id_text, lean, sampled_ids, slices

#: Most labelled rows of a fit, most voters, least labelled-1 rows in which a mined voter fires.
SAMPLE, VOTERS, LEAST_ROWS = 20_000, 400, 5
#: The same for repeated beginnings where few rows have label 1; it grows by one for each hundred, up to ``LEAST_ROWS``.
LEAST_REPEATED = 3
#: From this score on a text counts as toxic.
THRESHOLD = 0.3
#: Lengths of word beginnings.
BEGINNINGS = (4, 5)
#: Insults of four languages.
LEXICON = (
    "idiot moron stupid loser trash scum clown pathetic worthless disgusting dumb fool jerk imbecile garbage filth "
    "trottel dummkopf arschloch abschaum vollidiot widerlich idiote imbécile connard crétin ordure débile "
    "idiota estúpido imbécil basura asqueroso payaso"
).split()
PATTERNS = {"marks": re.compile(r"!{3,}"), "shouting": re.compile(r"(?:\b[A-Z]{4,}\b\W+){3}"), "masked": re.compile(r"\b[A-Za-z][*@#$]{2,}[A-Za-z]*")}
_WORD = re.compile(r"[^\W\d_]+")


def learnable(doc_id: Column) -> Column:
    """Rows from which labels may be learned: three quarters, by the id's checksum."""
    return F.crc32(doc_id.cast("string")) % 4 != 2


def features(word: str) -> list[str]:
    return [f"w:{word}", *(f"b:{word[:n]}" for n in BEGINNINGS if len(word) > n)]


def features_of(words: set[str]) -> set[str]:
    """All features of a text's words; r: and s: stand for beginnings of at least two and three different words."""
    counts = Counter(f for w in words for f in features(w))
    return counts.keys() | {f"{kind}:{f[2:]}" for f, n in counts.items() if n > 1 for kind in ("r" if n == 2 else "rs")}


def votes_of(text: str, known: dict[str, tuple[int, ...]], patterns: list[tuple[int, re.Pattern]]) -> set[int]:
    """Numbers of the voters that fire. ``known`` maps words to voters and fills itself."""
    hits = Counter(chain.from_iterable(filter(None, map(known.__getitem__, set(_WORD.findall(text.lower()))))))
    fired = {k for k, n in hits.items() if n >= known.least[k]} if hits else set()
    fired.update(k for k, p in patterns if p.search(text))
    return fired


class _Known(dict):
    """Voters by word; forgets all when full."""

    def __init__(self, voters: list[str]):
        super().__init__()
        self.at: dict[str, list[int]] = {}  # voters by word or beginning
        self.least = [{"r": 2, "s": 3}.get(v[0], 1) for v in voters]
        for k, v in enumerate(voters):
            self.at.setdefault(f"b{v[1:]}" if v[0] in "rs" else v, []).append(k)

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 200_000:
            self.clear()
        value = self[word] = tuple(k for f in features(word) for k in self.at.get(f, ()))
        return value


def _panel(voters: list[str]) -> tuple[_Known, list[tuple[int, re.Pattern]]]:
    return _Known(voters), [(k, PATTERNS[v[2:]]) for k, v in enumerate(voters) if v.startswith("p:")]


def mined_voters(sample: DataFrame, most: int = VOTERS) -> list[str]:
    """Lexicon, patterns and the ``most`` features that tell the classes of (text, label) apart best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: tuple[Counter, Counter] = (Counter(), Counter())
        for b in slices(batches):
            for text, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                counts[label].update(features_of(set(_WORD.findall(text.lower()))))
        names = list(counts[0].keys() | counts[1].keys())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([counts[1][f] for f in names], pa.int64()), pa.array([counts[0][f] for f in names], pa.int64())], names=["feature", "ones", "zeros"])

    total = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count("*").alias("n")).collect()}
    n1, n0 = total.get(1, 0), total.get(0, 0)
    fixed = [f"w:{w}" for w in LEXICON] + [f"p:{p}" for p in PATTERNS]
    if not n1 or not n0:
        return fixed
    counts = sample.select("text", "label").mapInArrow(lean(run), "feature string, ones long, zeros long").groupBy("feature").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
    odds = F.log((F.col("ones") + 0.5) / (n1 + 1)) - F.log((F.col("zeros") + 0.5) / (n0 + 1))
    repeated = F.substring("feature", 1, 2).isin("r:", "s:")
    least = F.when(repeated, min(LEAST_ROWS, LEAST_REPEATED + n1 // 100)).otherwise(LEAST_ROWS)
    found = counts.where((F.col("ones") >= least) & (odds > 1.5)).orderBy(F.desc(odds * F.sqrt("ones")), "feature").limit(most)
    return fixed + [r["feature"] for r in found.collect() if r["feature"] not in fixed]


def dependency_tree(both: list[np.ndarray], sizes: list[float]) -> np.ndarray:
    """Each voter's parent (its own number at the root) in the tree of greatest mutual information given the class.

    ``both`` holds for either class how often each pair of voters fires together, ``sizes`` the rows of the classes.
    """
    information = np.zeros(both[0].shape)
    for together, n in zip(both, sizes, strict=True):
        alone = np.diag(together)
        for x in (0, 1):
            for y in (0, 1):
                one, two = (alone if x else n - alone)[:, None], (alone if y else n - alone)[None, :]
                cell = together if x and y else alone[:, None] - together if x else alone[None, :] - together if y else n - alone[:, None] - alone[None, :] + together
                information += np.clip(cell, 0, None) * np.log((np.clip(cell, 0, None) + 1e-9) * n / (one * two + 1e-9) + 1e-12)
    parent = np.zeros(len(information), int)
    nearest = information[0].copy()
    nearest[0] = -np.inf
    for _ in range(len(information) - 1):
        k = int(nearest.argmax())
        nearest[k] = -np.inf
        closer = (information[k] > nearest) & (nearest > -np.inf)
        parent[closer], nearest[closer] = k, information[k][closer]
    return parent


def label_model(fires: np.ndarray, labels: np.ndarray, rounds: int = 25) -> np.ndarray:
    """Posterior of class 1 for each row, from votes (rows x voters) and given labels.

    Rates given class and parent are smoothed by ``2`` rows at the rate given the class alone.
    """
    n, q = len(labels), np.where(labels == 1, 0.9, 0.1)
    said, voters = (labels == 1).astype(float), np.arange(fires.shape[1])
    parent = None
    for step in range(rounds):
        ones, prior = q.sum(), np.clip(q.mean(), 1e-3, 1 - 1e-3)
        both, sizes = [fires.T @ (fires * (1 - q)[:, None]), fires.T @ (fires * q[:, None])], [n - ones, ones]
        if parent is None or step < 3:
            parent = dependency_tree(both, sizes)
            case = (2 * fires[:, parent] + fires).astype(np.int8)
        logs = []
        for together, size in zip(both, sizes, strict=True):
            alone = np.diag(together)
            rate = (alone + 0.5) / (size + 1)
            of_parent = alone[parent]
            on = (together[parent, voters] + 2 * rate) / (of_parent + 2)
            off = (alone - together[parent, voters] + 2 * rate) / (size - of_parent + 2)
            root = parent == voters
            on[root], off[root] = rate[root], rate[root]
            on, off = np.clip(on, 1e-6, 1 - 1e-6), np.clip(off, 1e-6, 1 - 1e-6)
            logs.append(np.log([1 - off, off, 1 - on, on]))
        odds = logs[1] - logs[0]
        hit, false = np.clip((said @ q + 4) / (ones + 5), 0.6, 0.995), np.clip((said @ (1 - q) + 0.5) / (n - ones + 5), 0.005, 0.4)
        logit = math.log(prior / (1 - prior)) + sum(np.where(case == k, odds[k], 0.0).sum(1) for k in range(4))
        logit = logit + np.where(said > 0, math.log(hit / false), math.log((1 - hit) / (1 - false)))
        new = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        if np.abs(new - q).max() < 1e-4:
            return new
        q = new
    return q


def logistic(fires: np.ndarray, target: np.ndarray, ridge: float = 0.05, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Weights and intercept of a ridge logistic regression on soft targets, by Newton steps."""
    x = np.hstack([fires, np.ones((len(fires), 1))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty), x.T @ (p - target) + penalty * w)
        w = w - step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-6:
            break
    return w[:-1], float(w[-1])


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", most: int = SAMPLE) -> tuple[list[str], list[float], float]:
    """(voters, weights, intercept) from labelled rows that may be learned from."""
    given = labels.where(learnable(F.col(id_col)) & F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("id")).agg(F.max(label_col).cast("int").alias("label"))
    ids = given.join(sampled_ids(given, "id", most), "id")
    sample = id_text(docs, id_col, text_col).join(F.broadcast(ids), "id").select("text", "label").persist()
    voters = mined_voters(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        panel = _panel(voters)
        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([sorted(votes_of(t, *panel)) for t in b.column(0).to_pylist()], pa.list_(pa.int32()))], names=["label", "fired"])

    votes = sample.mapInArrow(lean(run), "label int, fired array<int>").collect()
    sample.unpersist()
    labels_ = np.array([r["label"] for r in votes])
    if not len(votes) or labels_.min() == labels_.max():
        return voters, [4.0 if v.startswith("w:") else 0.5 for v in voters], -3.0
    fires = np.zeros((len(votes), len(voters)))
    for k, r in enumerate(votes):
        fires[k, r["fired"]] = 1
    order = np.lexsort((*fires.T[:1], labels_))  # sums then don't depend on the order in which rows came
    weights, intercept = logistic(fires[order], label_model(fires[order], labels_[order]))
    return voters, [round(float(w), 6) for w in weights], round(intercept, 6)


def scored(df: DataFrame, model: tuple[list[str], list[float], float], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of every row."""
    used = [(v, w) for v, w in zip(model[0], model[1], strict=True) if abs(w) > 1e-3]
    voters, weights, intercept = [v for v, _ in used], [w for _, w in used], model[2]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        panel = _panel(voters)
        for b in slices(batches):
            scores = [1 / (1 + math.exp(-max(-30.0, min(30.0, intercept + sum(weights[k] for k in sorted(votes_of(t, *panel))))))) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(scores, pa.float64())], names=["id", "score"])

    rows = id_text(df, id_col, text_col)
    return rows.mapInArrow(lean(run), f"id {rows.schema['id'].dataType.simpleString()}, score double")


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, held_out, score, predicted) of every row."""
    out = scored(docs, fit(docs, labels, id_col, text_col), id_col, text_col)
    return out.select(F.col("id").alias(id_col), F.coalesce(~learnable(F.col("id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def op5_toxicity(spark, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels table."""
    return toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
