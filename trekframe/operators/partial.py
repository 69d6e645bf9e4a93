"""Partial correlation given any set of columns, and the causal skeleton that follows from it.

One pass takes the table's moments by pattern of known columns: how many rows
have the pattern, their sums and sums of products about the columns' means.
The complete cases of any columns are the patterns in which all of them are
known, so every correlation, whatever it is given, comes from sums of these few
rows: the covariance that the columns given leave of both, without reading the
table again. A table of k columns has 2 ** k patterns at most, each of some k * k / 2
numbers; meant for up to about 15 columns with unknown values (any number without).

Defined cases: null and NaN are unknown; with fewer rows than columns given and
three, or where the columns given leave nothing of one, the correlation is 0.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns above which the skeleton takes the first FEW only.
MANY, FEW = 20, 15
#: Neighbours of a pair from which conditioning sets are drawn.
NEIGHBOURS = 3


@dataclass
class Moments:
    columns: list[str]
    #: By pattern: which columns are known, rows, sums, sums of products.
    known: np.ndarray
    n: np.ndarray
    sums: np.ndarray
    products: np.ndarray

    def covariance(self, chosen: list[str]) -> tuple[int, np.ndarray]:
        """Complete cases of the chosen columns, and their covariances."""
        at = [self.columns.index(c) for c in chosen]
        ok = self.known[:, at].all(axis=1)
        n = int(self.n[ok].sum())
        if not n:
            return 0, np.zeros((len(at), len(at)))
        s = self.sums[ok][:, at].sum(axis=0)
        return n, self.products[ok][:, at][:, :, at].sum(axis=0) / n - np.outer(s, s) / n**2

    def partial(self, x: str, y: str, given: list[str] | tuple[str, ...] = ()) -> tuple[float, int]:
        """Correlation of x and y given other columns, and its complete cases."""
        n, cov = self.covariance([x, y, *given])
        scale = np.sqrt(np.diag(cov))
        if n < len(given) + 3 or not (scale > 0).all():
            return 0.0, n
        r = cov / np.outer(scale, scale)
        # What the columns given leave of x and y; they may depend on each other.
        left = r[:2, :2] - r[:2, 2:] @ np.linalg.pinv(r[2:, 2:], rcond=1e-10, hermitian=True) @ r[2:, :2]
        if min(left[0, 0], left[1, 1]) < 1e-9:
            return 0.0, n
        return float(np.clip(left[0, 1] / np.sqrt(left[0, 0] * left[1, 1]), -1, 1)), n


def moments(df: DataFrame, columns: list[str]) -> Moments:
    values = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None)).alias(f"x{i}") for i, c in enumerate(columns)])
    k = range(len(columns))
    means = values.agg(*[F.coalesce(F.avg(f"x{i}"), F.lit(0.0)).alias(f"m{i}") for i in k])
    # One row; the small side of a nested-loop join without pairs.
    x = lambda i: F.coalesce(F.col(f"x{i}") - F.col(f"m{i}"), F.lit(0.0))
    pattern = F.array(*[F.col(f"x{i}").isNotNull() for i in k])
    pairs = [(i, j) for i in k for j in k if i <= j]
    rows = values.crossJoin(F.broadcast(means)).groupBy(pattern.alias("pattern")).agg(F.count("*").alias("n"), *[F.sum(x(i)).alias(f"s{i}") for i in k], *[F.sum(x(i) * x(j)).alias(f"p{i}_{j}") for i, j in pairs]).collect()
    products = np.zeros((len(rows), len(columns), len(columns)))
    for a, r in enumerate(rows):
        for i, j in pairs:
            products[a, i, j] = products[a, j, i] = r[f"p{i}_{j}"]
    return Moments(columns, np.array([r["pattern"] for r in rows], bool).reshape(len(rows), len(columns)), np.array([r["n"] for r in rows]), np.array([[r[f"s{i}"] for i in k] for r in rows]).reshape(len(rows), len(columns)), products)


def partial_correlations(df: DataFrame, statements: list[tuple[str, str, list[str]]]) -> DataFrame:
    """x, y, given, r, n for each statement (x, y, columns given)."""
    columns = list(dict.fromkeys(c for x, y, given in statements for c in (x, y, *given)))
    m = moments(df, columns)
    return df.sparkSession.createDataFrame([(x, y, list(given), *m.partial(x, y, given)) for x, y, given in statements], "x string, y string, given array<string>, r double, n long")  # a row a statement


def pc_skeleton(df: DataFrame, columns: list[str], most_given: int = 1, limit: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Edges (a, b, r) that stay, and what separated the other pairs (a, b, given, r).

    From the complete graph, pairs go that are independent (|r| below the limit)
    given none, then one, up to ``most_given`` of their neighbours, of which the
    first ``NEIGHBOURS`` by name take part. Of more than ``MANY`` columns the
    first ``FEW`` are taken.
    """
    nodes = columns[:FEW] if len(columns) > MANY else list(columns)
    m = moments(df, nodes)
    near = {c: {o for o in nodes if o != c} for c in nodes}
    separated = []
    for size in range(most_given + 1):
        for x in nodes:
            for y in sorted(near[x], key=nodes.index):
                around = sorted((near[x] | near[y]) - {x, y})[:NEIGHBOURS]
                for given in combinations(around, size):
                    r, _ = m.partial(x, y, given)
                    if abs(r) < limit:
                        near[x].discard(y)
                        near[y].discard(x)
                        separated.append((*sorted((x, y), key=nodes.index), list(given), r))
                        break
    edges = [(a, b, m.partial(a, b)[0]) for a, b in combinations(nodes, 2) if b in near[a]]
    spark = df.sparkSession
    return spark.createDataFrame(edges, "a string, b string, r double"), spark.createDataFrame(separated, "a string, b string, given array<string>, r double")  # a row a pair of columns
