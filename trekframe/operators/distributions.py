"""Distribution tests that need a solver: each works on a bounded summary of the rows (distinct-value sums, a fixed histogram, or a stated sample)."""

from __future__ import annotations

import math
from functools import lru_cache
from statistics import NormalDist

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trekframe.operators.stats import dagostino, dagostino_of, jarque_bera, jarque_bera_of, long_form, with_upto
from trekframe.sources.shared import materialised, ship

#: Values that the Shapiro-Wilk test takes at most, as its tables allow; bins of the histogram behind densities.
SHAPIRO_MOST, BINS = 5000, 4096
_NORMAL = NormalDist()


def log_normal_cdf(z: Column) -> Column:
    """Log of the normal distribution function, in Arrow batches over small tables."""

    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: math.log(max(1e-300, 0.5 * math.erfc(-x / math.sqrt(2)))))

    return run(z)


def anderson_darling(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, n, statistic, critical (5 %), is_normal; sums over distinct values with their ranks."""
    values = long_form(df, columns)
    moments = values.groupBy("feature").agg(F.count("*").alias("n"), F.avg("value").alias("m"), F.stddev_samp("value").alias("s"))
    counts = values.groupBy("feature", "value").agg(F.count("*").alias("c"))
    return anderson_darling_of(with_upto(counts, "value", "c", ("feature",)), moments)


def anderson_darling_of(ranked: DataFrame, moments: DataFrame) -> DataFrame:
    """The test on distinct values (feature, value, c, upto) and moments (feature, n, m, s)."""
    rows = ranked.withColumnRenamed("upto", "hi").withColumn("lo", F.col("hi") - F.col("c")).join(F.broadcast(moments), "feature")  # one row a column of the list
    rows = rows.withColumn("z", (F.col("value") - F.col("m")) / F.col("s"))
    up, hi, lo = F.col("hi").cast("double") ** 2 - F.col("lo").cast("double") ** 2, F.col("hi").cast("double"), F.col("lo").cast("double")
    down = (2.0 * F.col("n") + 1) * F.col("c") - (hi * (hi + 1) - lo * (lo + 1))
    total = F.sum(up * log_normal_cdf(F.col("z")) + down * log_normal_cdf(-F.col("z")))
    stat = rows.groupBy("feature", "n").agg(total.alias("t")).withColumn("statistic", -F.col("n") - F.col("t") / F.col("n"))
    critical = 0.787 / (1 + 4.0 / F.col("n") - 25.0 / (F.col("n") * F.col("n")))
    return stat.select("feature", "n", "statistic", critical.alias("critical"), (F.col("statistic") < critical).alias("is_normal"))


def shapiro_w(x: np.ndarray) -> tuple[float, float]:
    """Shapiro-Wilk W and its p by Royston's approximation, for 12 values or more (fewer: p is nan)."""
    x = np.sort(np.asarray(x, float))
    n = len(x)
    if n < 3 or x[0] == x[-1]:
        return float("nan"), float("nan")
    m = np.array([_NORMAL.inv_cdf((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    u, mm = 1 / math.sqrt(n), float(m @ m)
    a = m / math.sqrt(mm)
    last = a[-1] + np.polyval([-2.706056, 4.434685, -2.07119, -0.147981, 0.221157, 0], u)
    if n > 5:
        second = a[-2] + np.polyval([-3.582633, 5.682633, -1.752461, -0.293762, 0.042981, 0], u)
        phi = (mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * second**2)
        a = m / math.sqrt(phi)
        a[[-1, -2, 0, 1]] = last, second, -last, -second
    else:
        phi = (mm - 2 * m[-1] ** 2) / (1 - 2 * last**2)
        a = m / math.sqrt(phi)
        a[[-1, 0]] = last, -last
    w = float((a @ x) ** 2 / ((x - x.mean()) ** 2).sum())
    if n < 12:
        return w, float("nan")
    log_n = math.log(n)
    mu, sigma = np.polyval([0.0038915, -0.083751, -0.31082, -1.5861], log_n), math.exp(np.polyval([0.0030302, -0.082676, -0.4803], log_n))
    return w, 1 - _NORMAL.cdf((math.log(1 - w) - mu) / sigma)


def shapiro_wilk(df: DataFrame, columns: list[str], id_col: str) -> DataFrame:
    """feature, n, statistic, p over at most SHAPIRO_MOST values of each column, chosen by the hash of the id."""
    return shapiro_wilk_of(shapiro_sample(df, columns, id_col))


def shapiro_sample(df: DataFrame, columns: list[str], id_col: str) -> DataFrame:
    """feature, value: at most SHAPIRO_MOST values of each column, those with the smallest hashes of the id."""
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns]))
    rows = df.select(F.xxhash64(id_col).alias("h"), pairs).where("value is not null")
    # The smallest hashes of each column: partial top-k by a threshold on the hash, then an exact cut.
    share = rows.groupBy("feature").agg(F.count("*").alias("n")).withColumn("limit", F.least(F.lit(1.0), 1.2 * SHAPIRO_MOST / F.col("n") + 0.001))
    near = rows.join(F.broadcast(share), "feature").where((F.col("h") / 2.0**64 + 0.5) <= F.col("limit"))
    ranked = near.withColumn("k", F.row_number().over(Window.partitionBy("feature").orderBy("h", "value"))).where(F.col("k") <= SHAPIRO_MOST)
    return ranked.select("feature", "value")


def shapiro_wilk_of(sample: DataFrame) -> DataFrame:
    """The test on feature, value."""
    ship(sample.sparkSession)

    def test(part: pd.DataFrame) -> pd.DataFrame:
        w, p = shapiro_w(part["value"].to_numpy())
        return pd.DataFrame({"feature": [part["feature"].iloc[0]], "n": [len(part)], "statistic": [w], "p": [p]})

    return sample.groupBy("feature").applyInPandas(test, "feature string, n long, statistic double, p double")


def normal_votes(df: DataFrame, columns: list[str], id_col: str, alpha: float = 0.05) -> DataFrame:
    """feature, votes, normal: at least half of the tests that give an answer call it normal."""
    return _votes(shapiro_wilk(df, columns, id_col), anderson_darling(df, columns), jarque_bera(df, columns), dagostino(df, columns), alpha)


def _votes(shapiro: DataFrame, anderson: DataFrame, jarque: DataFrame, k_squared: DataFrame, alpha: float) -> DataFrame:
    answers = (
        shapiro.where("not isnan(p)").select("feature", (F.col("p") > alpha).alias("ok"))
        .unionByName(anderson.select("feature", F.col("is_normal").alias("ok")))
        .unionByName(jarque.select("feature", (F.col("p") > alpha).alias("ok")))
        .unionByName(k_squared.where("p is not null and not isnan(p)").select("feature", (F.col("p") > alpha).alias("ok")))
    )
    share = F.avg(F.col("ok").cast("int"))
    return answers.groupBy("feature").agg(F.count("*").alias("votes"), (share >= 0.5).alias("normal"))


def fine_histogram(df: DataFrame, columns: list[str], bins: int = BINS) -> DataFrame:
    """feature, x (bin centre), n: a histogram of fixed size for each column."""
    values = long_form(df, columns)
    span = values.groupBy("feature").agg(F.min("value").alias("a"), F.max("value").alias("b"))
    rows = values.join(F.broadcast(span), "feature")  # one row a column of the list
    width = (F.col("b") - F.col("a")) / bins
    at = F.when(width > 0, F.least(F.lit(bins - 1), F.floor((F.col("value") - F.col("a")) / width))).otherwise(0)
    return rows.groupBy("feature", "a", "b", at.alias("bin")).agg(F.count("*").alias("n")).select("feature", (F.col("a") + (F.col("bin") + 0.5) * width).alias("x"), "n")


def _peaks(density: np.ndarray, prominence: float) -> list[int]:
    """Local maxima that stand out by a share of the largest value."""
    found = []
    for i in range(1, len(density) - 1):
        if density[i - 1] < density[i] >= density[i + 1]:
            left = np.flatnonzero(density[:i] > density[i])
            right = np.flatnonzero(density[i + 1 :] > density[i])
            low = density[(left[-1] if len(left) else 0) : i + 1].min()
            high = density[i : (i + 2 + right[0] if len(right) else len(density))].min()
            if density[i] - max(low, high) >= prominence * density.max():
                found.append(i)
    return found


def kde_peaks(df: DataFrame, columns: list[str], points: int = 200, prominence: float = 0.01) -> DataFrame:
    """feature, n_peaks, peaks: maxima of a Gaussian kernel density on a grid, from the fixed histogram."""
    ship(df.sparkSession)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x, n = part["x"].to_numpy(), part["n"].to_numpy(float)
        mean = (x * n).sum() / n.sum()
        sd = math.sqrt(max(1e-300, (n * (x - mean) ** 2).sum() / n.sum()))
        grid, h = np.linspace(x.min(), x.max(), points), 1.06 * sd * n.sum() ** -0.2
        density = (np.exp(-0.5 * ((grid[:, None] - x[None, :]) / h) ** 2) * n).sum(axis=1)
        at = _peaks(density, prominence)
        return pd.DataFrame({"feature": [part["feature"].iloc[0]], "n_peaks": [len(at)], "peaks": [[float(grid[i]) for i in at]]})

    return fine_histogram(df, columns).groupBy("feature").applyInPandas(run, "feature string, n_peaks long, peaks array<double>")


def mixture_bic(df: DataFrame, columns: list[str], most: int = 5) -> DataFrame:
    """feature, k, bic for one to five normal components fitted to the fixed histogram by EM from quantile starts."""
    ship(df.sparkSession)

    def run(part: pd.DataFrame) -> pd.DataFrame:
        x, n = part["x"].to_numpy(), part["n"].to_numpy(float)
        order = np.argsort(x)
        x, n = x[order], n[order]
        total, out = n.sum(), []
        mean = (x * n).sum() / total
        var = max(1e-12, (n * (x - mean) ** 2).sum() / total)
        for k in range(1, max(1, min(most, int(total) // 10 - 1)) + 1):
            mu = np.interp((np.arange(k) + 0.5) / k, np.cumsum(n) / total, x)
            s2, w = np.full(k, var / k), np.full(k, 1 / k)
            for _ in range(200):
                logs = np.log(w) - 0.5 * np.log(2 * np.pi * s2) - 0.5 * (x[:, None] - mu) ** 2 / s2
                top = logs.max(axis=1, keepdims=True)
                each = top[:, 0] + np.log(np.exp(logs - top).sum(axis=1))
                r = np.exp(logs - each[:, None]) * n[:, None]
                size = np.maximum(r.sum(axis=0), 1e-12)
                w, mu = size / total, (r * x[:, None]).sum(axis=0) / size
                s2 = np.maximum((r * (x[:, None] - mu) ** 2).sum(axis=0) / size, 1e-6 * var)
            out.append((part["feature"].iloc[0], k, float(-2 * (each * n).sum() + (3 * k - 1) * math.log(total))))
        return pd.DataFrame(out, columns=["feature", "k", "bic"])

    return fine_histogram(df, columns).groupBy("feature").applyInPandas(run, "feature string, k long, bic double")


def box_cox(df: DataFrame, column: str, low: float = -2.0, high: float = 2.0, steps: int = 41) -> DataFrame:
    """One row: the lambda of a grid with the largest likelihood over positive values, and that likelihood; one pass for all."""
    x = F.col(column).cast("double")
    grid = [low + (high - low) * i / (steps - 1) for i in range(steps)]
    y = lambda g: F.ln(x) if abs(g) < 1e-9 else (F.pow(x, F.lit(g)) - 1) / g
    one = df.where(x > 0).agg(F.count("*").alias("n"), F.sum(F.ln(x)).alias("logs"), *[F.var_pop(y(g)).alias(f"v{i}") for i, g in enumerate(grid)])
    llf = lambda i, g: -F.col("n") / 2.0 * F.ln(F.col(f"v{i}")) + (g - 1) * F.col("logs")
    best = F.array_max(F.array(*[F.struct(llf(i, g).alias("llf"), F.lit(g).alias("lambda")) for i, g in enumerate(grid)]))
    return one.select("n", best.alias("b")).select("n", "b.lambda", "b.llf")


def qq_points(df: DataFrame, column: str) -> DataFrame:
    """value, c, rank (of the last of equal values) and p: order-statistic positions for quantile plots, one row a distinct value."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("double").alias("value")).agg(F.count("*").alias("c"))
    rows = with_upto(counts, "value", "c")
    n, upto = F.col("_n"), F.col("upto")
    rows = rows.join(F.broadcast(rows.agg(F.sum("c").alias("_n"))))  # one row
    return rows.select("value", "c", upto.alias("rank"), ((upto - (F.col("c") - 1) / 2.0 - 0.3175) / (n + 0.365)).alias("p"))


def permutation_p(df: DataFrame, x: str, y: str, id_col: str, permutations: int = 100, block_rows: int = 10_000, seed: int = 42) -> DataFrame:
    """One row: r, n, p: the share of shuffles with at least as large a correlation; seeded.

    Rows are dealt at random into blocks of about so many; a block is shuffled
    once for each permutation where it is, and only its sums of products leave
    it. All rows take part, and each travels once.
    """
    rows = df.select(F.col(id_col).alias("id"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    rows = materialised(rows)
    real = rows.agg(F.corr("x", "y").alias("r"), F.count("*").alias("n"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.stddev_pop("x").alias("sx"), F.stddev_pop("y").alias("sy"))
    blocks = max(1, rows.count() // block_rows)

    def shuffle(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values(["h", "id"])
        a, b = (block.x - block.mx).to_numpy(), (block.y - block.my).to_numpy()
        rng = np.random.default_rng([seed, int(block.b.iloc[0])])
        return pd.DataFrame({"k": range(permutations), "product": [float(a @ rng.permutation(b)) for _ in range(permutations)]})

    ship(df.sparkSession)
    h = F.xxhash64(F.lit(seed), "id")
    dealt = rows.join(F.broadcast(real.select("mx", "my"))).withColumns({"h": h, "b": F.pmod(h, F.lit(blocks))})  # one row
    sums = dealt.groupBy("b").applyInPandas(shuffle, "k int, product double").groupBy("k").agg(F.sum("product").alias("product"))
    found = sums.join(F.broadcast(real)).withColumn("rb", F.col("product") / (F.col("n") * F.col("sx") * F.col("sy")))
    return found.groupBy("r", "n").agg(F.avg((F.abs("rb") >= F.abs("r")).cast("double")).alias("p"))


# ---- modes

#: Points of the distribution function that the dip test keeps of a column; all of them where it has no more values.
DIP_POINTS = 100_000
#: Samples, and values of each, from which the dip's p comes.
DIP_SAMPLES, DIP_SAMPLE = 500, 400


def _hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of the points that the largest convex function below them touches; x increases."""
    kept: list[int] = []
    xs, ys = x.tolist(), y.tolist()
    for i in range(len(xs)):
        while len(kept) > 1 and (ys[kept[-1]] - ys[kept[-2]]) * (xs[i] - xs[kept[-1]]) >= (ys[i] - ys[kept[-1]]) * (xs[kept[-1]] - xs[kept[-2]]):
            kept.pop()
        kept.append(i)
    return np.array(kept, np.int64)


def dip(x: np.ndarray, upto: np.ndarray) -> float:
    """Hartigan's dip: how far the distribution function of values x (increasing), of which upto lie up to each, is from the nearest unimodal one.

    The convex minorant of the function's lower corners and the concave majorant
    of its upper ones meet around a modal interval that narrows until their
    distance inside it is no more than what was found outside.
    """
    n = float(upto[-1])
    top, bottom = np.asarray(upto, float), np.r_[0.0, np.asarray(upto, float)[:-1]]
    low, high, found = 0, len(x) - 1, 1.0
    while low < high:
        part = slice(low, high + 1)
        below, above = _hull(x[part], bottom[part]) + low, _hull(x[part], -top[part]) + low
        minorant = lambda at, below=below: np.interp(x[at], x[below], bottom[below])
        majorant = lambda at, above=above: np.interp(x[at], x[above], top[above])
        gap_below, gap_above = majorant(below) - bottom[below], top[above] - minorant(above)
        if gap_below.max() > gap_above.max():
            left = below[gap_below.argmax()]
            right = above[above >= left].min()
        else:
            right = above[gap_above.argmax()]
            left = below[below <= right].max()
        gap = max(gap_below.max(), gap_above.max())
        if gap <= found:
            break
        outside = [found]
        if left > low:
            at = np.arange(low, left + 1)
            outside.append(float((top[at] - minorant(at)).max()))
        if right < high:
            at = np.arange(right, high + 1)
            outside.append(float((majorant(at) - bottom[at]).max()))
        found = max(outside)
        if (left, right) == (low, high):
            break
        low, high = left, right
    return found / (2 * n)


@lru_cache(maxsize=4)
def dip_null(size: int = DIP_SAMPLE, samples: int = DIP_SAMPLES, seed: int = 42) -> np.ndarray:
    """Sorted dips of uniform samples, times the root of their size: the unimodal case that is hardest to tell from two modes."""
    rng = np.random.default_rng(seed)
    return np.sort([dip(np.sort(rng.random(size)), np.arange(1, size + 1)) for _ in range(samples)]) * math.sqrt(size)


def dip_test(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, n, dip, p: Hartigan's test of one mode.

    Distinct values are counted and their running sums taken in ranges; of each
    column about ``DIP_POINTS`` corners of its distribution function go to one
    task, evenly by rank, which moves the dip by half of their share at most. p is
    the share of seeded uniform samples with a larger dip, scaled by the root of
    n (at most ``DIP_SAMPLE``'s own n below it). Columns with fewer than ten
    values have no row.
    """
    ship(df.sparkSession)
    counts = long_form(df, columns).groupBy("feature", "value").agg(F.count("*").alias("c"))
    rows = with_upto(counts, "value", "c", ("feature",))
    totals = rows.groupBy("feature").agg(F.max("upto").alias("n"))
    step = lambda v: F.floor(v * F.lit(float(DIP_POINTS)) / F.col("n"))
    kept = rows.join(totals, "feature").where((F.col("n") >= 10) & ((F.col("n") <= DIP_POINTS) | (step(F.col("upto")) > step(F.col("upto") - F.col("c")))))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("value")
        n = int(part["n"].iloc[0])
        found = dip(part["value"].to_numpy(), part["upto"].to_numpy())
        null = dip_null(min(n, DIP_SAMPLE))
        p = float((null >= found * math.sqrt(n)).mean())
        return pd.DataFrame({"feature": [part["feature"].iloc[0]], "n": [n], "dip": [found], "p": [p]})

    return kept.select("feature", "value", "upto", "n").groupBy("feature").applyInPandas(run, "feature string, n long, dip double, p double")


def mode_votes(df: DataFrame, columns: list[str], alpha: float = 0.05) -> DataFrame:
    """feature, votes, multimodal, n_modes: dip test, mixtures and density peaks; at least half of those that answer decide, n_modes is the median of theirs."""
    dips = dip_test(df, columns).select("feature", (F.col("p") < alpha).alias("many"), F.when(F.col("p") < alpha, 2).otherwise(1).alias("modes"))
    best = mixture_bic(df, columns).groupBy("feature").agg(F.min_by("k", F.struct("bic", "k")).alias("modes"))
    peaks = kde_peaks(df, columns).select("feature", F.greatest(F.lit(1), "n_peaks").alias("modes"))
    long = lambda d: d.select("feature", (F.col("modes") > 1).alias("many"), F.col("modes").cast("long"))
    spans = long_form(df, columns).groupBy("feature").agg(F.count("*").alias("_n"), F.stddev_pop("value").alias("_s"))
    several = spans.where("_n >= 10 and _s >= 1e-10")  # others get no answer of the density and no mixture of several
    return mode_consensus(dips.select("feature", "many", F.col("modes").cast("long")).unionByName(long(best).join(spans.where("_n >= 10").select("feature"), "feature")).unionByName(long(peaks).join(several.select("feature"), "feature")))


def mode_consensus(answers: DataFrame) -> DataFrame:
    """feature, votes, multimodal, n_modes from answers (feature, many, modes) of the single methods."""
    median = F.percentile(F.when(F.col("many"), F.col("modes")), F.lit(0.5))  # of three answers
    return answers.groupBy("feature").agg(F.count("*").alias("votes"), (F.avg(F.col("many").cast("int")) >= 0.5).alias("multimodal"), F.floor(F.coalesce(median, F.lit(1.0))).alias("n_modes"))


def decide(facts: DataFrame) -> DataFrame:
    """feature, kind, confidence from one row a feature: n, zeros (share), skewness, normal, lognormal, multimodal, n_modes."""
    kind = lambda name, sure: F.struct(F.lit(name).alias("kind"), F.lit(sure).alias("confidence"))
    pick = (
        F.when(F.col("n") < 3, kind("unknown", 0.0))
        .when(F.col("zeros") > 0.3, kind("zero_inflated", 0.9))
        .when(F.col("normal"), kind("normal", 0.9))
        .when(F.col("lognormal"), kind("lognormal", 0.85))
        .when(F.col("multimodal") & (F.col("n_modes") == 2), kind("bimodal", 0.85))
        .when(F.col("multimodal"), kind("multimodal", 0.85))
        .when(F.abs("skewness") < 0.5, kind("uniform", 0.7))
        .when(F.col("skewness") > 1, kind("right_skewed", 0.8))
        .when(F.col("skewness") < -1, kind("left_skewed", 0.8))
        .otherwise(kind("unknown", 0.5))
    )
    return facts.select("feature", pick.alias("c")).select("feature", "c.kind", "c.confidence")


def distribution_facts(df: DataFrame, columns: list[str], id_col: str, alpha: float = 0.05) -> DataFrame:
    """What ``decide`` needs of each column: moments from one pass, the normality tests' vote on the values and on their logarithms, the modes' vote."""
    values = long_form(df, columns)
    moments = values.groupBy("feature").agg(F.count("*").alias("n"), F.avg((F.col("value") == 0).cast("double")).alias("zeros"), F.skewness("value").alias("skewness"), F.kurtosis("value").alias("kurtosis"), F.min("value").alias("low"))
    logs = df.select(id_col, *[F.when(F.col(c) > 0, F.ln(F.col(c).cast("double"))).alias(c) for c in columns])
    votes = lambda d, name: normal_votes(d, columns, id_col, alpha).select("feature", F.col("normal").alias(name))
    rows = moments.join(votes(df, "normal"), "feature", "left").join(votes(logs, "log_normal"), "feature", "left").join(mode_votes(df, columns, alpha).drop("votes"), "feature", "left")
    lognormal = (F.col("low") > 0) & (F.col("skewness") > 0.5) & F.coalesce("log_normal", F.lit(False))
    return rows.select("feature", "n", "zeros", "skewness", "kurtosis", F.coalesce("normal", F.lit(False)).alias("normal"), lognormal.alias("lognormal"), F.coalesce("multimodal", F.lit(False)).alias("multimodal"), F.coalesce("n_modes", F.lit(1)).alias("n_modes"))


# ---- transformations


def yeo_johnson_column(x: Column, g: float) -> Column:
    """The Yeo-Johnson transformation with a given lambda."""
    up = F.ln(x + 1) if abs(g) < 1e-9 else (F.pow(x + 1, F.lit(g)) - 1) / g
    down = -F.ln(1 - x) if abs(g - 2) < 1e-9 else -(F.pow(1 - x, F.lit(2 - g)) - 1) / (2 - g)
    return F.when(x >= 0, up).otherwise(down)


def lambda_variances(counts: DataFrame, grid: list[float]) -> DataFrame:
    """feature, tag (b: Box-Cox over positive values, y: Yeo-Johnson), k, v: variance under each lambda of the grid; counts: feature, value, c.

    A task keeps number, mean and sum of squares of each, whatever its rows are.
    """

    def changed(x: np.ndarray, tag: str, g: float) -> np.ndarray:
        power = lambda v, e: np.log(v) if abs(e) < 1e-9 else (v**e - 1) / e
        if tag == "b":
            return power(x, g)
        up = x >= 0
        out = np.empty_like(x)
        out[up], out[~up] = power(x[up] + 1, g), -power(1 - x[~up], 2 - g)
        return out

    def sums(batches):
        held: dict[tuple[str, str, int], tuple[float, float, float]] = {}
        for batch in batches:
            names = batch.column(0).dictionary_encode()
            codes = names.indices.to_numpy(zero_copy_only=False)
            values, counted = (c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns[1:])
            for code, name in enumerate(names.dictionary.to_pylist()):
                for tag, mine in (("b", (codes == code) & (values > 0)), ("y", codes == code)):
                    x, c = values[mine], counted[mine]
                    if not len(x):
                        continue
                    n = c.sum()
                    with np.errstate(all="ignore"):
                        for k, g in enumerate(grid):
                            t = changed(x, tag, g)
                            mean = t[0] if t.min() == t.max() else (c * t).sum() / n
                            square = (c * (t - mean) ** 2).sum()
                            n0, mean0, square0 = held.get((name, tag, k), (0.0, mean, 0.0))
                            away = mean - mean0
                            held[name, tag, k] = n0 + n, mean0 + away * n / (n0 + n), square0 + square + away * away * n0 * n / (n0 + n)
        rows = [(*key, *v) for key, v in held.items()]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in zip(*rows)], names=["feature", "tag", "k", "n", "mean", "square"])

    parts = counts.select("feature", "value", "c").mapInArrow(sums, "feature string, tag string, k long, n double, mean double, square double")
    w = Window.partitionBy("feature", "tag", "k")  # a row a task
    away = F.when(F.min("mean").over(w) == F.max("mean").over(w), 0.0).otherwise(F.col("mean") - F.sum(F.col("n") * F.col("mean")).over(w) / F.sum("n").over(w))
    parts = parts.withColumn("square", F.col("square") + F.col("n") * away * away)
    return parts.groupBy("feature", "tag", "k").agg((F.sum("square") / F.sum("n")).alias("v"))


def counted_moments(counts: DataFrame) -> DataFrame:
    """feature, n, m, s (sample deviation), skew, kurt (excess) of counted values: feature, value, c; null where a constant has none."""
    c, v = F.col("c"), F.col("value")
    means = counts.groupBy("feature").agg(F.sum("c").alias("n"), (F.sum(c * v) / F.sum("c")).alias("m"), (F.min("value") < F.max("value")).alias("varied"))
    away = v - F.col("m")
    sums = counts.join(F.broadcast(means), "feature").groupBy("feature", "n", "m", "varied").agg(*[F.sum(c * F.pow(away, F.lit(float(p)))).alias(f"m{p}") for p in (2, 3, 4)])  # one row a column of the list
    n, m2 = F.col("n").cast("double"), F.when(F.col("varied"), F.col("m2"))
    return sums.select("feature", "n", "m", F.sqrt(F.try_divide(m2, n - 1)).alias("s"), (F.sqrt(n) * F.try_divide(F.col("m3"), F.pow(m2, F.lit(1.5)))).alias("skew"), (n * F.try_divide(F.col("m4"), m2 * m2) - 3).alias("kurt"))


def recommend_transformations(df: DataFrame, columns: list[str], id_col: str, low: float = -2.0, high: float = 2.0, steps: int = 41) -> DataFrame:
    """feature, transformation, lambda, priority, achieves: the candidates of each column and whether they make it normal by the tests' vote; the first row of a feature (place 1) is the advice.

    Candidates: none; log, square root and Box-Cox (positive columns; the square
    root also with zeros), Yeo-Johnson. Lambdas are the best of a grid, all from
    one pass over the distinct values and their counts, on which the tests work
    too: every candidate rises with the value, so ranks and the sample of rows
    are the column's own. Those that achieve normality come first, then by priority.
    """
    ship(df.sparkSession)
    grid = [low + (high - low) * i / (steps - 1) for i in range(steps)]
    cox = lambda x, g: F.ln(x) if abs(g) < 1e-9 else (F.pow(x, F.lit(g)) - 1) / g
    counts = materialised(long_form(df, columns).groupBy("feature", "value").agg(F.count("*").alias("c")))
    c, x = F.col("c"), F.col("value")
    facts = counts.groupBy("feature").agg(F.sum("c").alias("n"), F.min("value").alias("low"), F.sum(c * F.when(x > 0, F.ln(x))).alias("l"), F.sum(c * F.signum(x) * F.ln(F.abs(x) + 1)).alias("s"))
    one = {r.feature: r for r in facts.collect()}  # some numbers a column
    spread = {(r.feature, r.tag, r.k): r.v for r in lambda_variances(counts, grid).collect()}

    def best(name: str, tag: str, jacobian: float) -> float:
        n = one[name].n
        scored = [(-n / 2 * math.log(v) + (g - 1) * jacobian, -abs(g - 1), g) for k, g in enumerate(grid) if (v := spread.get((name, tag, k))) and v > 0]
        return max(scored)[2] if scored else 1.0

    candidates = []
    for name in columns:
        if name not in one:
            continue
        candidates.append((name, "none", None, 0, x))
        if one[name].low > 0:
            g = best(name, "b", one[name].l)
            candidates += [(name, "log", None, 1, F.ln(x)), (name, "box_cox", g, 3, cox(x, g))]
        if one[name].low >= 0:
            candidates.append((name, "sqrt", None, 2, F.sqrt(x)))
        g = best(name, "y", one[name].s)
        candidates.append((name, "yeo_johnson", g, 4, yeo_johnson_column(x, g)))
    names = [f"t{k}" for k in range(len(candidates))]
    spark = df.sparkSession
    schema = "name string, feature string, transformation string, lambda double, priority int"
    listed = spark.createDataFrame([(n, *c[:4]) for n, c in zip(names, candidates)], schema)  # a few rows a column
    if not candidates:
        return listed.select("feature", "transformation", "lambda", "priority", F.lit(False).alias("achieves"), F.lit(1).alias("place"))
    each = F.coalesce(*[F.when(F.col("feature") == name, F.array(*[F.struct(F.lit(n).alias("feature"), v.alias("value")) for n, (mine, *_, v) in zip(names, candidates) if mine == name])) for name in one])
    changed = lambda rows, *more: rows.select(*more, F.inline(each)).where("value is not null and not isnan(value)")
    moments = materialised(counted_moments(changed(counts, "c")))  # a row a candidate
    shape = moments.select("feature", "n", F.col("skew").alias("s"), F.col("kurt").alias("k"))
    ranked = changed(with_upto(counts, "value", "c", ("feature",)), "c", "upto")
    votes = _votes(shapiro_wilk_of(changed(shapiro_sample(df, list(one), id_col))), anderson_darling_of(ranked, moments.select("feature", "n", "m", "s")), jarque_bera_of(shape), dagostino_of(shape), 0.05)
    votes = votes.select(F.col("feature").alias("name"), "normal")
    rows = listed.join(votes, "name", "left").withColumn("achieves", F.coalesce("normal", F.lit(False)))
    place = F.row_number().over(Window.partitionBy("feature").orderBy(F.desc("achieves"), "priority"))
    return rows.select("feature", "transformation", "lambda", "priority", "achieves", place.alias("place"))


# ---- what plots show


def density_curves(df: DataFrame, column: str, points: int = 200) -> DataFrame:
    """x, kde, normal: on an even grid over the values a Gaussian kernel density of Scott's width, from the fine histogram, and the normal density of their mean and deviation."""
    known = df.select(F.col(column).cast("double").alias(column)).where(f"`{column}` is not null and not isnan(`{column}`)")
    fine = fine_histogram(known, [column])
    span = known.agg(F.min(column).alias("a"), F.max(column).alias("b"), F.count("*").alias("n"), F.avg(column).alias("m"), F.stddev_samp(column).alias("s"), F.stddev_pop(column).alias("p"))  # one row
    grid = span.select("*", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("i")).withColumn("at", F.col("a") + (F.col("b") - F.col("a")) * F.col("i") / (points - 1)).withColumn("h", F.col("s") * F.pow("n", F.lit(-0.2)))
    u = (F.col("at") - F.col("x")) / F.col("h")
    kernels = F.sum(F.col("fine_n") * F.exp(-0.5 * u * u)) / (F.max("n") * F.max("h") * math.sqrt(2 * math.pi))
    z = (F.col("at") - F.col("m")) / F.col("p")
    rows = grid.crossJoin(F.broadcast(fine.select("x", F.col("n").alias("fine_n"))))  # a grid of a few hundred by some thousand bins
    return rows.groupBy("at").agg(kernels.alias("kde"), (F.exp(-0.5 * F.max(z) * F.max(z)) / (F.max("p") * math.sqrt(2 * math.pi))).alias("normal")).withColumnRenamed("at", "x")


def qq_fit(df: DataFrame, column: str) -> DataFrame:
    """One row: n, slope, intercept and R2 of the values against normal quantiles of their order-statistic medians."""
    ship(df.sparkSession)
    rows = qq_points(df, column).withColumn("q", normal_quantile(F.col("p")))
    n, x, y = F.sum("c"), F.sum(F.col("c") * F.col("q")), F.sum(F.col("c") * F.col("value"))
    xx, yy, xy = (F.sum(F.col("c") * a * b) for a, b in ((F.col("q"), F.col("q")), (F.col("value"), F.col("value")), (F.col("q"), F.col("value"))))
    sums = rows.agg(n.alias("n"), x.alias("x"), y.alias("y"), xx.alias("xx"), yy.alias("yy"), xy.alias("xy"))
    cov, vx, vy = F.expr("n * xy - x * y"), F.expr("n * xx - x * x"), F.expr("n * yy - y * y")
    return sums.select("n", F.try_divide(cov, vx).alias("slope"), F.try_divide(F.col("y") - F.try_divide(cov, vx) * F.col("x"), F.col("n")).alias("intercept"), F.try_divide(cov * cov, vx * vy).alias("r2"))


def pp_points(df: DataFrame, column: str) -> DataFrame:
    """value, empirical (rank / (n + 1) of the last of equal values), theoretical (normal share below), gap; one row a distinct value."""
    ship(df.sparkSession)
    known = df.select(F.col(column).cast("double").alias("value")).where("value is not null and not isnan(value)")
    moments = known.agg(F.count("*").alias("_n"), F.avg("value").alias("_m"), F.stddev_pop("value").alias("_s"))
    counts = known.groupBy("value").agg(F.count("*").alias("c"))
    rows = with_upto(counts, "value", "c").join(F.broadcast(moments))  # one row
    theoretical = F.exp(log_normal_cdf((F.col("value") - F.col("_m")) / F.col("_s")))
    rows = rows.select("value", (F.col("upto") / (F.col("_n") + 1)).alias("empirical"), theoretical.alias("theoretical"))
    return rows.withColumn("gap", F.abs(F.col("empirical") - F.col("theoretical")))


def normal_quantile(p: Column) -> Column:
    """Inverse of the normal distribution function, in Arrow batches over small tables."""

    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        return v.map(lambda x: _NORMAL.inv_cdf(min(1 - 1e-16, max(1e-300, x))))

    return run(p)
