"""Feature importance with forests.

A forest's split looks at how many rows lie on each side of a threshold, and at
their mean: rows in the same cell between the candidate thresholds of all
features are one to it. Where the cells are few, as with features of few values,
one pass draws every row's weight in every tree and adds up weights and targets
by tree and cell, Spark adds these up, and each tree grows from its cells, by the
rules of Spark's forest. Otherwise Spark's own forest passes over the rows once a
level and visits every tree for each.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import GBTRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trekframe.operators import attributions
from trekframe.operators.augment import numbered
from trekframe.sources.shared import materialised, ship


#: Bins of a feature, as in Spark's forest.
BINS = 32
#: Distinct values up to which a feature's bins come from exact counts.
FEW_VALUES = 10_000
#: Cells up to which a forest grows from cells, where they are no more than the rows; and cells times trees: a task holds two numbers of each, 128 MB at most.
CELLS = 80_000
CELL_SUMS = 8_000_000
#: Rows whose weights a task draws at once.
DRAWN = 10_000


def fit_forest(df: DataFrame, columns: list[str], target: str, trees: int = 50, depth: int = 5, seed: int = 42, boosted: bool = False):
    """A forest, or a boosted ensemble, over rows whose features and target are known; and these rows.

    The forest is an ``attributions.Forest`` where the cells are few, and else Spark's model; both have
    featureImportances and serve the operators here. A boosted ensemble has no random weights: rows of equal
    features count as one of their mean and number, which leaves every split's gain as it is.
    """
    known = df.dropna(subset=[*columns, target]).select(*[F.col(c).cast("double").alias(c) for c in [*columns, target]], *[c for c in df.columns if c not in columns and c != target])
    if not boosted and (edges := candidate_thresholds(known, columns, min(CELLS, CELL_SUMS // trees))) is not None:
        return forest_of_cells(known, columns, target, edges, trees, depth, seed), known
    fitted, common = known, {"featuresCol": "_features", "labelCol": target, "predictionCol": "_prediction", "maxDepth": depth, "seed": seed}
    if boosted:
        n, distinct = known.agg(F.count("*").alias("n"), F.approx_count_distinct(F.struct(*columns)).alias("distinct")).first()
        if 2 * distinct <= n:
            fitted, common["weightCol"] = materialised(known.groupBy(*columns).agg(F.avg(target).alias(target), F.count("*").cast("double").alias("_rows"))), "_rows"
    rows = VectorAssembler(inputCols=columns, outputCol="_features").transform(fitted)
    model = (GBTRegressor(maxIter=trees, **common) if boosted else RandomForestRegressor(numTrees=trees, **common)).fit(rows)
    return model, known


def candidate_thresholds(known: DataFrame, columns: list[str], most: int) -> list[np.ndarray] | None:
    """Each feature's thresholds, ascending; None if there are no rows, or more cells between them than most or than rows.

    Of few values all are counted, and thresholds lie halfway between two of them: between any two if
    these are at most BINS, else where Spark's forest puts them. Of many values they are quantiles.
    """
    rows, *about = known.agg(F.count("*").alias("_n"), *[F.approx_count_distinct(c).alias(f"_{j}") for j, c in enumerate(columns)]).first()
    most = min(most, rows)
    if not rows or not columns or math.prod(min(n, BINS) for n in about) > 2 * most:  # the numbers are right to some percent
        return None
    few = [c for c, n in zip(columns, about) if n <= FEW_VALUES]
    counts: dict[str, list] = {c: [] for c in columns}
    if few:
        pairs = F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("value")) for c in few])
        for r in known.select(F.inline(pairs)).groupBy("feature", "value").count().collect():  # some thousand a feature
            counts[r["feature"]].append((r["value"], r["count"]))
    many = [c for c in columns if c not in few]
    quantiles = known.agg(*[F.percentile_approx(c, [i / BINS for i in range(1, BINS)]).alias(f"_{j}") for j, c in enumerate(many)]).first() if many else []
    edges = {c: halfway(*np.array(sorted(counts[c])).T) for c in few} | {c: np.unique(q) for c, q in zip(many, quantiles)}
    found = [edges[c] for c in columns]
    return found if math.prod(len(e) + 1 for e in found) <= most else None


def halfway(values: np.ndarray, counts: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Thresholds between values in ascending order, at most bins - 1, by the rule of Spark's forest: of two neighbours the one whose count up to there is nearer to the next multiple of a bin's share ends the bin."""
    between = values[:-1] / 2 + values[1:] / 2
    between = np.where(np.isfinite(between), between, values[:-1])
    if len(values) <= bins:
        return between
    stride, upto, kept = counts.sum() / bins, np.cumsum(counts), []
    goal = stride
    for i in range(1, len(values)):
        if abs(upto[i - 1] - goal) < abs(upto[i] - goal):
            kept.append(i - 1)
            goal += stride
    return between[kept]


def forest_of_cells(known: DataFrame, columns: list[str], target: str, edges: list[np.ndarray], trees: int, depth: int, seed: int) -> attributions.Forest:
    """A forest over the cells between the features' thresholds.

    Every row gets a Poisson weight of mean 1 in every tree, by seed and partition, and every split looks at a third of
    the features, rounded up (at all where there is one tree), as in Spark's.
    """
    ship(known.sparkSession)
    sizes = [len(e) + 1 for e in edges]
    cells, each = math.prod(sizes), len(columns) if trees == 1 else math.ceil(len(columns) / 3)

    def drawn(batches):
        rng = np.random.default_rng([seed, TaskContext.get().partitionId()])
        weights, sums = np.zeros((cells, trees)), np.zeros((cells, trees))
        for batch in batches:
            for part in (batch.slice(i, DRAWN) for i in range(0, batch.num_rows, DRAWN)):
                *x, y = [c.to_numpy(zero_copy_only=False) for c in part.columns]
                cell = np.ravel_multi_index([np.searchsorted(e, v, side="left") for e, v in zip(edges, x)], sizes)
                order = np.argsort(cell, kind="stable")
                cell, y = cell[order], y[order]
                first = np.r_[0, np.flatnonzero(np.diff(cell)) + 1]
                w = rng.poisson(1.0, (len(y), trees)).astype(float)
                weights[cell[first]] += np.add.reduceat(w, first, axis=0)
                w *= y[:, None]
                sums[cell[first]] += np.add.reduceat(w, first, axis=0)
        for t in range(trees):
            at = np.flatnonzero(weights[:, t])
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), t)), pa.array(at), pa.array(weights[at, t]), pa.array(sums[at, t])], names=["tree", "cell", "w", "s"])

    def grown(key, found):
        found = found.sort_values("cell")
        codes = np.stack(np.unravel_index(found["cell"].to_numpy(), sizes))
        tree, gains = grow(codes, found["w"].to_numpy(), found["s"].to_numpy(), edges, each, depth, np.random.default_rng([seed, trees, int(key[0])]))
        return pd.DataFrame({"tree": key[0], **{n: [list(getattr(tree, n))] for n in NODE}, "gains": [list(gains)]})

    sums = known.select(*columns, target).mapInArrow(drawn, "tree long, cell long, w double, s double").groupBy("tree", "cell").agg(F.sum("w").alias("w"), F.sum("s").alias("s"))
    schema = "tree long, feature array<long>, threshold array<double>, left array<long>, right array<long>, value array<double>, cover array<double>, gains array<double>"
    nodes = {r["tree"]: r for r in sums.groupBy("tree").applyInPandas(grown, schema).collect()}  # the model: some dozen nodes a tree
    forest, importances = [], np.zeros(len(columns))
    for t in range(trees):
        if t not in nodes:  # of a few rows none may have a weight
            forest.append(attributions.Tree(np.array([-1]), np.zeros(1), np.array([-1]), np.array([-1]), np.zeros(1), np.ones(1)))
            continue
        forest.append(attributions.Tree(*[np.array(nodes[t][n]) for n in NODE]))
        gains = np.array(nodes[t]["gains"])
        importances += gains / gains.sum() if gains.sum() > 0 else 0
    return attributions.Forest(forest, Vectors.dense(importances / importances.sum() if importances.sum() > 0 else importances))


#: What a node holds.
NODE = ("feature", "threshold", "left", "right", "value", "cover")


def grow(codes: np.ndarray, w: np.ndarray, s: np.ndarray, edges: list[np.ndarray], each: int, depth: int, rng) -> tuple[attributions.Tree, np.ndarray]:
    """A regression tree over cells (codes: features by cells) of weight w and target sum s, and what each feature gains in it.

    A node splits where the variance falls most, by one of each features drawn for it, and is a leaf if it falls nowhere.
    """
    nodes: list[list] = []  # feature, threshold, left, right, value, cover
    gains = np.zeros(len(edges))
    todo = [(np.arange(len(w)), 0, -1, 0)]
    while todo:
        mine, level, parent, side = todo.pop()
        total, mean = w[mine].sum(), s[mine].sum() / w[mine].sum()
        if parent >= 0:
            nodes[parent][side] = len(nodes)
        nodes.append([-1, 0.0, -1, -1, mean, total])
        if level == depth:
            continue
        best = (np.finfo(float).eps * mean**2, -1, -1)  # what the squares of the targets resolve
        usable = [j for j in rng.choice(len(edges), each, replace=False) if len(edges[j])]
        for j in usable:
            left = np.cumsum(np.bincount(codes[j, mine], w[mine], len(edges[j]) + 1))[:-1]
            below = np.cumsum(np.bincount(codes[j, mine], s[mine], len(edges[j]) + 1))[:-1]
            right, above = total - left, mean * total - below
            with np.errstate(divide="ignore", invalid="ignore"):
                gain = np.where((left > 0) & (right > 0), left * right / total**2 * (below / left - above / right) ** 2, 0)
            if gain.max() > best[0]:
                best = (gain.max(), j, int(gain.argmax()))
        gain, j, k = best
        if j >= 0:
            gains[j] += gain * total
            nodes[-1][:2] = [j, edges[j][k]]
            goes_left = codes[j, mine] <= k
            todo += [(mine[~goes_left], level + 1, len(nodes) - 1, 3), (mine[goes_left], level + 1, len(nodes) - 1, 2)]
    return attributions.Tree(*[np.array(v) for v in zip(*nodes)]), gains


#: Rows of a block inside which values are shuffled; sides of the loss.
SHUFFLED = 20_000
METRICS = ("mse", "mae", "r2")


def factorised(df: DataFrame, column: str) -> DataFrame:
    """df with a text column replaced by the number of its value in sorted order; null stays null."""
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("_value")).distinct()
    codes = numbered(values, "_value").select("_value", F.col("place").cast("double").alias("_code"))
    return df.join(codes, df[column] == codes["_value"], "left").select(*[F.col("_code").alias(c) if c == column else df[c] for c in df.columns])


def permutation_importance(df: DataFrame, columns: list[str], target: str, id_col: str, repeats: int = 5, seed: int = 42, model=None, metric: str = "mse", block: int = SHUFFLED) -> DataFrame:
    """feature, importance and deviation: mean and deviation over the repeats of how much the metric worsens when a feature's values are shuffled.

    metric: mse, mae or r2 (whose fall counts). All features and repeats are
    scored in one job: rows fall into random blocks of about ``block`` rows, as
    many as the table needs, and each block is shuffled and scored where it lies,
    with trees as numpy arrays, each cell between their thresholds once a task.
    The blocks' sums are added up by Spark. model: a
    fitted forest or boosted ensemble over the columns; a forest of 50 trees if
    none is given. No rows, or columns without a feature, give no result.
    """
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {', '.join(METRICS)}")
    if model is None:
        model, rows = fit_forest(df, columns, target, seed=seed)
    else:
        rows = df.dropna(subset=[*columns, target])
    spark = df.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(attributions.model_trees(model))

    def score(batches):
        cells = attributions.Cells([t for _, t in shared.value], len(columns), lambda m: sum(w * t.predict(m) for w, t in shared.value))

        def scored(key, parts):
            x, y = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.lexsort((np.concatenate([p[2] for p in parts]), np.concatenate([p[3] for p in parts])))
            x, y = x[order], y[order]
            rng = np.random.default_rng([seed, key])

            def row(feature, repeat, prediction):
                error = y - prediction
                return feature, repeat, len(y), float((error**2).sum()), float(np.abs(error).sum()), float(y.sum()), float((y**2).sum())

            out = [row(-1, 0, cells(x))]
            for j in range(x.shape[1]):
                for k in range(repeats):
                    mixed = x.copy()
                    mixed[:, j] = rng.permutation(x[:, j])
                    out.append(row(j, k, cells(mixed)))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=["j", "k", "n", "sse", "sae", "sum_y", "sum_yy"])

        held, key = [], None
        for batch in batches:
            c = [v.to_numpy(zero_copy_only=False) for v in batch.columns]
            cuts = np.r_[0, np.flatnonzero(np.diff(c[0])) + 1, len(c[0])]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if b > a:
                    if held and c[0][a] != key:
                        yield scored(key, held)
                        held = []
                    key = int(c[0][a])
                    held.append((np.stack([v[a:b] for v in c[4:]], 1), c[3][a:b], c[1][a:b], c[2][a:b]))
        if held:
            yield scored(key, held)

    blocks = max(1, -(-rows.count() // block))
    h = F.xxhash64(F.lit(seed), F.col(id_col))
    placed = rows.select(F.pmod(h, F.lit(blocks)).cast("long").alias("block"), h.alias("h"), F.xxhash64(F.col(id_col)).alias("tie"), F.col(target).cast("double").alias("y"), *[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)])
    sums = placed.repartition("block").sortWithinPartitions("block", "h").mapInArrow(score, "j long, k long, n long, sse double, sae double, sum_y double, sum_yy double")
    sums = sums.groupBy("j", "k").agg(*[F.sum(c).alias(c) for c in ("n", "sse", "sae", "sum_y", "sum_yy")])
    value = {"mse": F.col("sse") / F.col("n"), "mae": F.col("sae") / F.col("n"), "r2": 1 - F.try_divide(F.col("sse"), F.col("sum_yy") - F.col("sum_y") ** 2 / F.col("n"))}[metric]
    values = sums.select("j", "k", value.alias("v"))
    base = values.where("j < 0").select(F.col("v").alias("base"))
    worse = (F.col("base") - F.col("v")) if metric == "r2" else (F.col("v") - F.col("base"))
    names = F.array(*[F.lit(c) for c in columns])
    out = values.where("j >= 0").crossJoin(F.broadcast(base))  # one row
    return out.groupBy("j").agg(F.avg(worse).alias("importance"), F.stddev_pop(worse).alias("deviation")).select(F.get(names, F.col("j").cast("int")).alias("feature"), "importance", "deviation")


def forest_importance(df: DataFrame, columns: list[str], target: str) -> list[tuple[str, float]]:
    """(feature, the forest's importance times the feature's deviation), largest first: the stand-in for tree explanations."""
    model, rows = fit_forest(df, columns, target, trees=100)
    sds = rows.agg(*[F.stddev_pop(c).alias(c) for c in columns]).first()
    return sorted(((c, float(i) * sds[c]) for c, i in zip(columns, model.featureImportances.toArray())), key=lambda x: -x[1])
