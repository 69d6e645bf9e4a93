"""Exact attributions of tree ensembles: how much each feature of a row moves the prediction away from the mean.

The values are Shapley values of the path-dependent expectation: where a feature
is unknown, a split sends a row both ways in proportion to the training rows
that went there. For one leaf only the features on its path matter, and each of
them is known to lead there or not, so a leaf has a small table: for every
pattern of features that lead there, what each feature adds. A row's
attributions are the sum of its leaves' entries, computed for Arrow batches of
rows at once. They add up to the prediction minus the mean, exactly.

Tables are made for leaves with up to ``TABLE_FEATURES`` features on their path;
for others the patterns that a batch of rows has are worked out. Rows on the same side of every
threshold have the same attributions: each such cell is worked out once a task.

Defined cases: rows with an unknown feature have null attributions and prediction;
an empty table gives an empty result; other columns are kept as asked.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.ml.linalg import DenseVector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trekframe.sources.shared import removed, scratch, ship


#: Features on a path up to which a leaf has a table of all patterns.
TABLE_FEATURES = 8


@dataclass
class Tree:
    """Nodes by number, the root first; feature -1 marks a leaf."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        at = np.zeros(len(x), np.int64)
        rows = np.arange(len(x))
        while (inner := self.feature[at] >= 0).any():
            goes_left = x[rows, np.maximum(self.feature[at], 0)] <= self.threshold[at]
            at = np.where(inner, np.where(goes_left, self.left[at], self.right[at]), at)
        return self.value[at]


@dataclass
class Forest:
    """Trees whose mean is the prediction, and the features' importances, as Spark's forests give them (a vector of sum 1)."""

    trees: list[Tree]
    featureImportances: DenseVector


def model_trees(model) -> list[tuple[float, Tree]]:
    """(weight, tree) of a fitted forest or boosted ensemble over numeric features; some kilobytes, whatever it was fitted to."""
    if isinstance(model, Forest):
        return [(1 / len(model.trees), t) for t in model.trees]
    from pyspark.sql import SparkSession

    spark = SparkSession.active()
    path = f"{scratch(spark)}/model-{uuid.uuid4().hex}"
    model.write().save(path)
    found: dict[int, dict[int, dict]] = {}
    for row in spark.read.parquet(f"{path}/data").toLocalIterator():
        found.setdefault(row["treeID"], {})[row["nodeData"]["id"]] = row["nodeData"]
    removed(spark, path)
    trees = []
    for k in sorted(found):
        nodes = [found[k][i] for i in range(len(found[k]))]
        leaf = [n["leftChild"] < 0 for n in nodes]
        trees.append(
            Tree(
                np.array([-1 if end else n["split"]["featureIndex"] for n, end in zip(nodes, leaf)]),
                np.array([0.0 if end else n["split"]["leftCategoriesOrThreshold"][0] for n, end in zip(nodes, leaf)]),
                np.array([n["leftChild"] for n in nodes]),
                np.array([n["rightChild"] for n in nodes]),
                np.array([n["prediction"] for n in nodes]),
                np.array([float(n["impurityStats"][0]) for n in nodes]),  # rows, also where one of the fit stands for several
            )
        )
    weights = list(model.treeWeights)
    scale = 1.0 if hasattr(model, "getMaxIter") else 1.0 / sum(weights)  # a forest's prediction is a mean, a boosted one's a sum
    return [(w * scale, t) for w, t in zip(weights, trees)]


@dataclass
class Leaf:
    value: float
    features: list[int]
    #: For each feature: (node, whether the path goes left there).
    steps: list[list[tuple[int, bool]]]
    #: For each feature the share of rows that get here when it is unknown.
    unknown: list[float]
    #: By pattern of features that lead here (bits): what each adds; None where too many features make the table large.
    table: np.ndarray | None

    def adds(self, pattern: np.ndarray) -> np.ndarray:
        if self.table is not None:
            return self.table[pattern]
        distinct, at = np.unique(pattern, return_inverse=True)
        return _shapley(self.value, self.unknown, distinct)[at]


def leaves(tree: Tree) -> list[Leaf]:
    found, todo = [], [(0, [])]
    while todo:
        node, path = todo.pop()
        if tree.feature[node] >= 0:
            todo += [(tree.left[node], [*path, (node, True)]), (tree.right[node], [*path, (node, False)])]
            continue
        features = sorted({int(tree.feature[n]) for n, _ in path})
        steps = [[(n, goes_left) for n, goes_left in path if tree.feature[n] == f] for f in features]
        after = lambda n, goes_left: tree.left[n] if goes_left else tree.right[n]
        unknown = [float(np.prod([tree.cover[after(*s)] / tree.cover[s[0]] for s in mine])) for mine in steps]
        value, few = float(tree.value[node]), len(features) <= TABLE_FEATURES
        found.append(Leaf(value, features, steps, unknown, _shapley(value, unknown, np.arange(1 << len(features))) if few else None))
    return found


def _shapley(value: float, unknown: list[float], pattern: np.ndarray) -> np.ndarray:
    """For each pattern of features that lead to the leaf (bits) the Shapley values of a product game: a known feature counts 1 or 0, an unknown one its share."""
    d = len(unknown)
    patterns = (pattern[:, None] >> np.arange(d)) & 1
    out = np.zeros(patterns.shape)
    for j in range(d):
        sums = np.zeros(patterns.shape)  # by the number of known others
        sums[:, 0] = 1
        for k in range(d):
            if k != j:
                more = sums * unknown[k]
                more[:, 1:] += sums[:, :-1] * patterns[:, k : k + 1]
                sums = more
        weights = np.array([factorial(s) * factorial(d - 1 - s) / factorial(d) for s in range(d)])
        out[:, j] = value * (patterns[:, j] - unknown[j]) * (sums @ weights)
    return out


def mean_prediction(trees: list[tuple[float, Tree]]) -> float:
    """The prediction when nothing is known: of the training rows, as the trees weigh them."""
    return float(sum(w * (t.value * t.cover)[t.feature < 0].sum() / t.cover[0] for w, t in trees))


def attribute(trees: list[tuple[float, Tree, list[Leaf]]], x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Attributions (rows by features) and predictions of a matrix of rows."""
    out, predictions = np.zeros(x.shape), np.zeros(len(x))
    for weight, tree, found in trees:
        inner = np.flatnonzero(tree.feature >= 0)
        place = {n: i for i, n in enumerate(inner.tolist())}
        goes_left = (x[:, tree.feature[inner]] <= tree.threshold[inner]).T
        for leaf in found:
            pattern = np.zeros(len(x), np.int64)
            for j, steps in enumerate(leaf.steps):
                leads = np.ones(len(x), bool)
                for node, left in steps:
                    leads &= goes_left[place[node]] == left
                pattern |= leads.astype(np.int64) << j
            if leaf.features:
                out[:, leaf.features] += weight * leaf.adds(pattern)
            predictions += weight * leaf.value * (pattern == (1 << len(leaf.features)) - 1)
    return out, predictions


class Cells:
    """Answers by cell of the ensemble: rows that lie on the same side of every threshold get the same ones, so each cell is worked out once.

    A cell's number mixes the places of a row's values between the thresholds of
    each feature. At most ``most`` cells are remembered, then it starts afresh;
    where the numbers pass 64 bits nothing is remembered.
    """

    def __init__(self, trees: list[Tree], width: int, answer, most: int = 200_000):
        self.edges = [np.unique(np.concatenate([np.zeros(0), *(t.threshold[t.feature == j] for t in trees)])) for j in range(width)]
        self.sizes = [len(e) + 1 for e in self.edges]
        self.fits = math.prod(self.sizes) < 1 << 62
        self.answer, self.most = answer, most
        self._codes, self._known = np.zeros(0, np.int64), None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        if not self.fits or not len(x):
            return self.answer(x)
        code = np.zeros(len(x), np.int64)
        for j, edges in enumerate(self.edges):  # an unknown value lies beyond all thresholds
            code = code * self.sizes[j] + np.searchsorted(edges, x[:, j], side="left")
        distinct, first, back = np.unique(code, return_index=True, return_inverse=True)
        new = ~np.isin(distinct, self._codes, assume_unique=True)
        if new.any():
            if self._known is None or len(self._codes) + new.sum() > self.most:
                self._codes, self._known = distinct, self.answer(x[first])
            else:
                codes, known = np.concatenate([self._codes, distinct[new]]), np.concatenate([self._known, self.answer(x[first[new]])])
                order = np.argsort(codes)
                self._codes, self._known = codes[order], known[order]
        return self._known[np.searchsorted(self._codes, distinct)[back]]


def tree_attributions(model, rows: DataFrame, columns: list[str], keep: list[str] | None = None) -> DataFrame:
    """The kept columns of rows, prediction, base (the mean prediction) and phi_<column> for each column that the model was fitted to, in the same order."""
    ship(rows.sparkSession)
    keep = keep or []
    trees = model_trees(model)
    base = mean_prediction(trees)
    shared = rows.sparkSession.sparkContext.broadcast([(w, t, leaves(t)) for w, t in trees])
    names = ["prediction", "base", *(f"phi_{c}" for c in columns)]

    def run(batches):
        cells = Cells([t for _, t, _ in shared.value], len(columns), lambda x: np.column_stack(attribute(shared.value, x)))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[len(keep) :]], 1)
            known = ~np.isnan(x).any(axis=1)
            found = cells(x)
            phi, prediction = found[:, :-1], found[:, -1]
            column = lambda v: pa.array(v, pa.float64(), mask=~known)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], column(prediction), pa.array([base] * len(x), pa.float64()), *(column(phi[:, j]) for j in range(len(columns)))], names=[*keep, *names])

    schema = ", ".join([*(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep), *(f"`{n}` double" for n in names)])
    return rows.select(*keep, *[F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(columns)]).mapInArrow(run, schema)


def attribution_importance(attributions: DataFrame, columns: list[str]) -> DataFrame:
    """feature, importance (mean size of its attributions), rank; one pass, a row a feature."""
    sums = attributions.agg(*[F.avg(F.abs(f"phi_{c}")).alias(c) for c in columns])
    rows = sums.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("importance")) for c in columns])))
    return rows.withColumn("rank", F.expr("row_number() over (order by importance desc, feature)"))  # a row a feature


def importance_bars(importance: DataFrame, top: int = 15, width: int = 50) -> DataFrame:
    """rank and line: the report's text bars of the most important features, the longest bar a value of 0.5 or more."""
    bar = F.repeat(F.lit("#"), F.least(F.lit(width), F.floor(F.col("importance") * 100)).cast("int"))
    return importance.where(F.col("rank") <= top).select("rank", F.format_string(f"%2d. %-30s %-{width}s %.4f", F.col("rank"), F.col("feature"), bar, F.col("importance")).alias("line"))


def attribution_examples(attributions: DataFrame, columns: list[str], keys: list[str], rows: int = 5, top: int = 5) -> DataFrame:
    """The keys, feature, phi and place of the features that move the first rows (by keys) most."""
    first = attributions.where("prediction is not null").orderBy(*keys).limit(rows)
    parts = F.array(*[F.struct((-F.abs(f"phi_{c}")).alias("size"), F.lit(c).alias("feature"), F.col(f"phi_{c}").alias("phi")) for c in columns])
    sorted_ = first.select(*keys, F.slice(F.sort_array(parts), 1, top).alias("parts")).select(*keys, F.posexplode("parts").alias("place", "part"))
    return sorted_.select(*keys, (F.col("place") + 1).alias("place"), "part.feature", "part.phi")
