"""Statistics over features: profiles, correlation, variance, distribution tests, causal structure."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trekframe.operators.quantiles import quantiles, with_upto
from trekframe.sources.shared import materialised, ship


def long_form(df: DataFrame, columns: list[str], name: str = "feature") -> DataFrame:
    """feature, value of numeric columns, known values only."""
    pairs = F.inline(F.array(*[F.struct(F.lit(c).alias(name), F.col(c).cast("double").alias("value")) for c in columns]))
    return df.select(pairs).where("value is not null and not isnan(value)")


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, n, mean, std, min, q1, median, q3, max, and bias-corrected skewness and kurtosis."""
    n, g1, g2 = F.col("n"), F.col("_g1"), F.col("_g2")
    values = long_form(df, columns)
    rows = values.groupBy("feature").agg(
        F.count("*").alias("n"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
        F.skewness("value").alias("_g1"),
        F.kurtosis("value").alias("_g2"),
    )
    rows = rows.join(quantiles(values, ["feature"], [0.25, 0.5, 0.75]).withColumnRenamed("q", "_q"), "feature")
    skew = F.when(n > 2, F.sqrt(n * (n - 1)) / (n - 2) * g1)
    kurt = F.when(n > 3, (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * g2 + 6))
    return rows.select("feature", "n", "mean", "std", "min", F.col("_q")[0].alias("q1"), F.col("_q")[1].alias("median"), F.col("_q")[2].alias("q3"), "max", skew.alias("skewness"), kurt.alias("kurtosis"))


def categorical_profile(df: DataFrame, column: str) -> DataFrame:
    """One row: distinct values, the mode (smallest on a tie), its count and share."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    best = counts.agg(F.count("*").alias("n_unique"), F.sum("n").alias("total"), F.max("n").alias("top"))
    return best.join(counts, F.col("n") == F.col("top")).groupBy("n_unique", "total", "top").agg(F.min("v").alias("mode")).select("n_unique", "mode", F.col("top").alias("mode_count"), F.round(100.0 * F.col("top") / F.col("total"), 4).alias("mode_pct"))


def gini(counts: DataFrame, column: str) -> DataFrame:
    """One row: the Gini coefficient of a small column of counts."""
    order = Window.orderBy(column)  # categories, not rows: a handful
    x = counts.select(F.col(column).cast("double").alias("x"), F.row_number().over(order).alias("i"))
    total, n = F.sum("x"), F.count("*")
    return x.agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 2 * F.sum(F.col("i") * F.col("x")) / (n * total) - (n + 1) / n)).alias("gini"))


def seasonal_balance(df: DataFrame, season: str = "T_season") -> DataFrame:
    """season, n, pct and status against an even share, for the four seasons, also those without rows."""
    seasons = df.sparkSession.createDataFrame([(s,) for s in ("winter", "spring", "summer", "autumn")], "season string")
    counts = df.groupBy(F.col(season).alias("season")).agg(F.count("*").alias("c"))
    rows = seasons.join(counts, "season", "left").select("season", F.coalesce("c", F.lit(0)).alias("n"))
    pct = 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy())
    return rows.select("season", "n", F.round(pct, 4).alias("pct"), F.when(pct < 22, "LOW").when(pct > 28, "HIGH").otherwise("OK").alias("status"))


def rare_combinations(df: DataFrame, factors: list[str], least_pct: float = 0.02) -> DataFrame:
    """Observed combinations below a share (percent): factors, n, pct, expected, deficit and the advised way to add rows."""
    known = df.dropna(subset=factors)
    levels = known.agg(F.count("*").alias("total"), *[F.count_distinct(f).alias(f"_{f}") for f in factors])
    cells = math.prod([F.col(f"_{f}") for f in factors], start=F.lit(1))
    rows = known.groupBy(*factors).agg(F.count("*").alias("n")).join(F.broadcast(levels))  # one row
    expected = F.col("total") / cells
    deficit = F.greatest(F.lit(0), (expected - F.col("n")).cast("int"))
    pct = 100.0 * F.col("n") / F.col("total")
    return rows.where(pct < least_pct).select(*factors, "n", F.round(pct, 6).alias("pct"), F.round(expected, 6).alias("expected"), deficit.alias("deficit"), F.when(deficit > 100, "VAE").otherwise("SMOTE").alias("action"))


# ---- correlation


def pearson_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b (a before b in columns), r over rows where both are known, and their number: one pass for all pairs."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    both = lambda a, b: F.col(a).isNotNull() & F.col(b).isNotNull()
    one = df.agg(*[F.struct(F.corr(F.when(both(a, b), F.col(a).cast("double")), F.when(both(a, b), F.col(b).cast("double"))).alias("r"), F.count_if(both(a, b)).alias("n")).alias(f"p{k}") for k, (a, b) in enumerate(pairs)])
    rows = one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{k}.r").alias("r"), F.col(f"p{k}.n").alias("n")) for k, (a, b) in enumerate(pairs)])))
    return rows.withColumn("r", F.when(~F.isnan("r"), F.col("r")))


def average_rank(df: DataFrame, column: str, by: list[str] | None = None) -> Column:
    """Average rank of a column's value: its rank plus half the number of ties."""
    parts = by or []
    return F.rank().over(Window.partitionBy(*parts).orderBy(column)) + (F.count("*").over(Window.partitionBy(*parts, column)) - 1) / 2.0


def spearman_pairs(df: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r, n: correlation of average ranks over rows where both are known.

    All pairs are ranked together, by pair: ranks come from counts of distinct
    values (running sums over values, not rows), so hot values cost one row.
    """
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    rows = df.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(a).cast("double").alias("x"), F.col(b).cast("double").alias("y")) for a, b in pairs]))).where("x is not null and y is not null")
    counts = materialised(rows.groupBy("a", "b", "x", "y").agg(F.count("*").alias("c")))

    def ranks(v: str) -> DataFrame:
        values = counts.groupBy("a", "b", v).agg(F.sum("c").alias("k"))
        return with_upto(values, v, "k", ("a", "b")).select("a", "b", v, (F.col("upto") - (F.col("k") - 1) / 2.0).alias(f"r{v}"))

    ranked = counts.join(ranks("x"), ["a", "b", "x"]).join(ranks("y"), ["a", "b", "y"])
    n, sx, sy = F.sum("c"), F.sum(F.col("c") * F.col("rx")), F.sum(F.col("c") * F.col("ry"))
    cov = F.sum(F.col("c") * F.col("rx") * F.col("ry")) - sx * sy / n
    vx, vy = F.sum(F.col("c") * F.col("rx") ** 2) - sx * sx / n, F.sum(F.col("c") * F.col("ry") ** 2) - sy * sy / n
    return ranked.groupBy("a", "b").agg(F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy)).alias("r"), n.alias("n"))


def _betacf(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (Lentz's method)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 300):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 + num * d, 1 + num / c
            d, c = 1 / (d if abs(d) > tiny else tiny), c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-14:
            break
    return h


def beta_cdf(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _betacf(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _betacf(b, a, 1 - x) / b


def t_two_sided(t: float, df: float) -> float:
    return beta_cdf(df / 2, 0.5, df / (df + t * t))


def f_upper(f: float, d1: float, d2: float) -> float:
    return beta_cdf(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_upper(x: float, k: float) -> float:
    """Upper tail of chi-squared by series or continued fraction of the incomplete gamma function."""
    a, x = k / 2, x / 2
    if x <= 0:
        return 1.0
    if x < a + 1:
        term = total = 1 / a
        for n in range(1, 1000):
            term *= x / (a + n)
            total += term
            if term < total * 1e-15:
                break
        return 1 - total * math.exp(-x + a * math.log(x) - math.lgamma(a))
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - a)
        b += 2
        d, c = 1 / (an * d + b), b + an / c
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * math.exp(-x + a * math.log(x) - math.lgamma(a))


def with_p(pairs: DataFrame) -> DataFrame:
    """pairs (r, n) with the two-sided p of r; 1 where n is 2 or less."""
    ship(pairs.sparkSession)

    def one(r: float, n: float) -> float | None:
        if r is None or r != r:
            return None
        return 1.0 if n <= 2 else 0.0 if abs(r) >= 1 else t_two_sided(abs(r) * math.sqrt((n - 2) / (1 - r * r)), n - 2)

    @F.pandas_udf("double")
    def p(r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([one(*x) for x in zip(r, n)], dtype="float64")

    return pairs.withColumn("p", p(F.col("r"), F.col("n").cast("double")))


def with_upper_p(rows: DataFrame, statistic: str, df1: str, df2: str | None = None, name: str = "p") -> DataFrame:
    """rows with the upper tail of their statistic: of F with df1 and df2 degrees of freedom, or without df2 of chi-squared with df1. For result tables of a few rows."""
    ship(rows.sparkSession)

    def tail(x, a, b) -> float | None:
        if x is None or x != x or a < 1:
            return None
        return chi2_upper(x, a) if df2 is None else f_upper(x, a, b)

    @F.pandas_udf("double")
    def p(x: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([tail(*v) for v in zip(x, a, b)], dtype="float64")

    columns = (statistic, df1, df2 or df1)
    return rows.withColumn(name, p(*[F.col(c).cast("double") for c in columns]))


def significant(ranking: DataFrame, p_limit: float = 0.05) -> DataFrame:
    """The features whose values differ by group: those of a variance ranking with p below the limit, the largest F first."""
    return with_upper_p(ranking, "f", "df1", "df2").where(F.col("p") < p_limit).orderBy(F.col("f").desc())


def significant_pairs(pairs: DataFrame, p_limit: float = 0.05, r_limit: float = 0.3) -> DataFrame:
    return with_p(pairs).where((F.col("p") < p_limit) & (F.abs("r") >= r_limit))


def cramers_v(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row: chi-squared of the full table of two categories (Yates' correction for two by two), degrees of freedom, n and Cramer's V. Null is a category."""
    cells = df.select(F.coalesce(F.col(a).cast("string"), F.lit("missing")).alias("x"), F.coalesce(F.col(b).cast("string"), F.lit("missing")).alias("y")).groupBy("x", "y").agg(F.count("*").alias("o"))
    rows, cols = cells.groupBy("x").agg(F.sum("o").alias("rx")), cells.groupBy("y").agg(F.sum("o").alias("cy"))
    size = cells.agg(F.sum("o").alias("n"), F.count_distinct("x").alias("nx"), F.count_distinct("y").alias("ny"))
    grid = rows.crossJoin(cols).join(cells, ["x", "y"], "left").join(F.broadcast(size))  # levels of two categories
    e = F.col("rx") * F.col("cy") / F.col("n")
    gap = F.abs(F.coalesce("o", F.lit(0)) - e)
    gap = gap - F.when((F.col("nx") == 2) & (F.col("ny") == 2), F.least(F.lit(0.5), gap)).otherwise(0.0)
    found = grid.groupBy("n", "nx", "ny").agg(F.sum(gap * gap / e).alias("chi2"))
    small = F.least("nx", "ny") - 1
    return found.select("chi2", ((F.col("nx") - 1) * (F.col("ny") - 1)).alias("df"), "n", F.when(small > 0, F.sqrt(F.col("chi2") / (F.col("n") * small))).otherwise(0.0).alias("v"))


def normalised_mutual_information(df: DataFrame, x: str, y: str, bins: int = 10) -> DataFrame:
    """One row: mutual information of two numeric columns in equal-width bins over the larger entropy (base 2)."""
    known = df.select(F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")).where("x is not null and y is not null")
    span = known.agg(F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1"), F.count("*").alias("n"))
    put = lambda v, a, b: F.least(F.lit(bins - 1), F.when(F.col(b) > F.col(a), F.floor((F.col(v) - F.col(a)) / (F.col(b) - F.col(a)) * bins)).otherwise(0))
    cells = known.join(F.broadcast(span)).groupBy(put("x", "x0", "x1").alias("i"), put("y", "y0", "y1").alias("j"), "n").agg(F.count("*").alias("c"))  # one row
    entropy = lambda keys: cells.groupBy(*keys, "n").agg(F.sum("c").alias("c")).agg((-F.sum(F.col("c") / F.col("n") * F.log2(F.col("c") / F.col("n")))).alias("h"))
    hx, hy, hxy = (entropy(k).withColumnRenamed("h", name) for k, name in ((["i"], "hx"), (["j"], "hy"), (["i", "j"], "hxy")))
    mi = F.col("hx") + F.col("hy") - F.col("hxy")
    return hx.crossJoin(hy).crossJoin(hxy).select(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.greatest("hx", "hy") > 0, mi / F.greatest("hx", "hy")).otherwise(0.0))).alias("nmi"))


def both_ways(pairs: DataFrame) -> DataFrame:
    """Pairs in both orders: a, b, r."""
    return pairs.select("a", "b", "r").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "r"))


def partial_r(rxy: Column, rxz: Column, ryz: Column) -> Column:
    return (rxy - rxz * ryz) / F.sqrt((1 - rxz * rxz) * (1 - ryz * ryz))


def confounders(pairs: DataFrame, top: int = 10, limit: float = 0.3) -> DataFrame:
    """For the strongest pairs, each other feature that correlates with both: partial r, mediation and what to do."""
    strongest = pairs.where(F.col("r").isNotNull()).orderBy(F.abs("r").desc(), "a", "b").limit(top)
    every = both_ways(pairs)
    rows = (
        strongest.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("r").alias("rxy"))
        .join(every.select(F.col("a").alias("x"), F.col("b").alias("z"), F.col("r").alias("rxz")), "x")
        .join(every.select(F.col("a").alias("y"), F.col("b").alias("z"), F.col("r").alias("ryz")), ["y", "z"])
        .where((F.abs("rxz") > limit) & (F.abs("ryz") > limit))
    )
    part = partial_r(F.col("rxy"), F.col("rxz"), F.col("ryz"))
    med = F.abs(F.col("rxy") - part) / (F.abs("rxy") + 1e-6)
    return rows.select("x", "y", "z", F.round("rxy", 6).alias("rxy"), F.round(part, 6).alias("partial"), F.round(med, 6).alias("mediation"), F.when(med > 0.5, "investigate").when(F.abs(part) < 0.1, "control").otherwise("monitor").alias("action"))


def mean_abs_r(pairs: DataFrame) -> DataFrame:
    """feature, importance: mean |r| with the others and itself."""
    return both_ways(pairs).groupBy(F.col("a").alias("feature")).agg(((F.sum(F.abs("r")) + 1) / (F.count("r") + 1)).alias("importance"))


def redundant_features(pairs: DataFrame, limit: float = 0.9) -> DataFrame:
    """feature: of each pair with |r| above the limit the one with the lower mean |r|, the second on a tie."""
    mean = mean_abs_r(pairs)
    rows = pairs.where(F.abs("r") > limit).join(mean.select(F.col("feature").alias("a"), F.col("importance").alias("ia")), "a").join(mean.select(F.col("feature").alias("b"), F.col("importance").alias("ib")), "b")
    return rows.select(F.when(F.col("ia") < F.col("ib"), F.col("a")).otherwise(F.col("b")).alias("feature")).distinct()


# ---- variance


def anova(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row: F, degrees of freedom and eta squared of a value by group; groups of one and null groups are left out."""
    groups = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group).agg(F.count("*").alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v")).where("n >= 2")
    n, k = F.sum("n"), F.count("*")
    within = F.sum(F.col("n") * F.col("v"))
    between = F.sum(F.col("n") * F.col("m") ** 2) - F.sum(F.col("n") * F.col("m")) ** 2 / n
    return groups.agg((between / (k - 1) / (within / (n - k))).alias("f"), (k - 1).alias("df1"), (n - k).alias("df2"), (between / (between + within)).alias("eta2"))


def kruskal(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row: Kruskal-Wallis H with the tie correction; ranks come from counts of distinct values."""
    known = df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(F.col(value).alias("v"), F.col(group).alias("g")).agg(F.count("*").alias("c"))
    values = known.groupBy("v").agg(F.sum("c").alias("k"))
    ranks = with_upto(values, "v", "k").select("v", "k", (F.col("upto") - (F.col("k") - 1) / 2.0).alias("rank"))
    size = ranks.agg(F.sum("k").cast("double").alias("n"), F.sum(F.col("k") * 1.0 * F.col("k") * F.col("k") - F.col("k")).alias("ties"))
    sums = known.join(ranks, "v").groupBy("g").agg(F.sum("c").alias("m"), F.sum(F.col("c") * F.col("rank")).alias("s"))
    total = sums.agg(F.sum(F.col("s") * F.col("s") / F.col("m")).alias("q"), F.count("*").alias("k")).join(F.broadcast(size))  # one row
    n = F.col("n")
    return total.select(((12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))).alias("h"), (F.col("k") - 1).alias("df"))


def brown_forsythe(df: DataFrame, value: str, group: str) -> DataFrame:
    """One row: ANOVA of the distances from the group medians."""
    known = df.where(F.col(value).isNotNull() & F.col(group).isNotNull())
    medians = quantiles(known, [group], [0.5], value).select(group, F.col("q")[0].alias("_median"))
    return anova(known.join(medians, group).withColumn("_distance", F.abs(F.col(value) - F.col("_median"))), "_distance", group)


# ---- distributions


def shape(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, n, s, k: how many values, their skewness and excess kurtosis."""
    return long_form(df, columns).groupBy("feature").agg(F.count("*").alias("n"), F.skewness("value").alias("s"), F.kurtosis("value").alias("k"))


def jarque_bera(df: DataFrame, columns: list[str]) -> DataFrame:
    return jarque_bera_of(shape(df, columns))


def jarque_bera_of(rows: DataFrame) -> DataFrame:
    """The test on feature, n, s, k."""
    jb = F.col("n") / 6.0 * (F.col("s") ** 2 + F.col("k") ** 2 / 4)
    return rows.select("feature", "n", jb.alias("statistic"), F.exp(-jb / 2).alias("p"))


def dagostino(df: DataFrame, columns: list[str]) -> DataFrame:
    """D'Agostino-Pearson K squared from skewness and kurtosis, and its p."""
    return dagostino_of(shape(df, columns))


def dagostino_of(rows: DataFrame) -> DataFrame:
    """The test on feature, n, s, k."""
    rows = rows.withColumn("n", F.col("n").cast("double")).where("n >= 8")
    n = F.col("n")
    y = F.col("s") * F.sqrt((n + 1) * (n + 3) / (6 * (n - 2)))
    beta2 = 3 * (n * n + 27 * n - 70) * (n + 1) * (n + 3) / ((n - 2) * (n + 5) * (n + 7) * (n + 9))
    w2 = F.sqrt(2 * (beta2 - 1)) - 1
    alpha = F.sqrt(2 / (w2 - 1))
    z1 = F.ln(y / alpha + F.sqrt((y / alpha) ** 2 + 1)) / F.sqrt(0.5 * F.ln(w2))
    e, var = 3 * (n - 1) / (n + 1), 24 * n * (n - 2) * (n - 3) / ((n + 1) ** 2 * (n + 3) * (n + 5))
    x = (F.col("k") + 3 - e) / F.sqrt(var)
    sb = 6 * (n * n - 5 * n + 2) / ((n + 7) * (n + 9)) * F.sqrt(6 * (n + 3) * (n + 5) / (n * (n - 2) * (n - 3)))
    a = 6 + 8 / sb * (2 / sb + F.sqrt(1 + 4 / (sb * sb)))
    ratio = (1 - 2 / a) / (1 + x * F.sqrt(2 / (a - 4)))
    z2 = (1 - 2 / (9 * a) - F.signum(ratio) * F.pow(F.abs(ratio), 1 / 3.0)) / F.sqrt(2 / (9 * a))
    k2 = z1 * z1 + z2 * z2
    return rows.select("feature", F.col("n").cast("long").alias("n"), k2.alias("statistic"), F.exp(-k2 / 2).alias("p"))


def histogram(df: DataFrame, column: str, bins: int = 30) -> DataFrame:
    """bin, n, density over equal-width bins of the known values, the maximum in the last."""
    known = df.select(F.col(column).cast("double").alias("v")).where("v is not null")
    span = known.agg(F.min("v").alias("a"), F.max("v").alias("b"), F.count("*").alias("total"))
    put = F.least(F.lit(bins - 1), F.floor((F.col("v") - F.col("a")) / (F.col("b") - F.col("a")) * bins))
    rows = known.join(F.broadcast(span)).groupBy(put.alias("bin"), "a", "b", "total").agg(F.count("*").alias("n"))  # one row
    return rows.select("bin", "n", (F.col("n") * bins / (F.col("total") * (F.col("b") - F.col("a")))).alias("density"))


def box(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, q1, median, q3, iqr."""
    q = quantiles(long_form(df, columns), ["feature"], [0.25, 0.5, 0.75])
    return q.select("feature", F.col("q")[0].alias("q1"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q3"), (F.col("q")[2] - F.col("q")[0]).alias("iqr"))


def ecdf(df: DataFrame, column: str) -> DataFrame:
    """value, share of known values up to it: running sums over distinct values."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("c"))
    rows = with_upto(counts, "value", "c")
    total = rows.agg(F.sum("c").alias("_total"))
    return rows.join(F.broadcast(total)).select("value", (F.col("upto") / F.col("_total")).alias("share"))  # one row


def classify_distribution(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature, kind, confidence by shares of zeros, normality (Jarque-Bera at 5 %) and population skewness."""
    values = long_form(df, columns)
    rows = values.groupBy("feature").agg(F.count("*").alias("n"), F.avg((F.col("value") == 0).cast("double")).alias("zeros"), F.skewness("value").alias("s"), F.kurtosis("value").alias("k"), F.min("value").alias("low"), F.skewness(F.when(F.col("value") > 0, F.ln("value"))).alias("ls"), F.kurtosis(F.when(F.col("value") > 0, F.ln("value"))).alias("lk"))
    p = lambda s, k: F.exp(-F.col("n") / 12.0 * (F.col(s) ** 2 + F.col(k) ** 2 / 4))
    kind = lambda name, conf: F.struct(F.lit(name).alias("kind"), F.lit(conf).alias("confidence"))
    pick = (
        F.when(F.col("zeros") > 0.3, kind("zero_inflated", 0.9))
        .when(p("s", "k") > 0.05, kind("normal", 0.9))
        .when((F.col("low") > 0) & (F.col("s") > 0.5) & (p("ls", "lk") > 0.05), kind("lognormal", 0.85))
        .when(F.abs("s") < 0.5, kind("uniform", 0.7))
        .when(F.col("s") > 1, kind("right_skewed", 0.8))
        .when(F.col("s") < -1, kind("left_skewed", 0.8))
        .otherwise(kind("unknown", 0.5))
    )
    return rows.select("feature", pick.alias("c")).select("feature", "c.kind", "c.confidence")


# ---- causal structure


def skeleton(pairs: DataFrame, limit: float = 0.1) -> DataFrame:
    """a, b, r of the pairs that stay after removing those independent outright, or given one neighbour of either end."""
    edges = pairs.where(F.abs("r") >= limit).select("a", "b", "r")
    every, near = both_ways(pairs), both_ways(edges)
    given = (
        edges.join(every.select("a", F.col("b").alias("z"), F.col("r").alias("rxz")), "a")
        .join(every.select(F.col("a").alias("b"), F.col("b").alias("z"), F.col("r").alias("ryz")), ["b", "z"])
        .join(near.select(F.col("a").alias("z"), F.col("b").alias("_n")).groupBy("z").agg(F.collect_set("_n").alias("around")), "z")
        .where(F.array_contains("around", F.col("a")) | F.array_contains("around", F.col("b")))
        .where(F.abs(partial_r(F.col("r"), F.col("rxz"), F.col("ryz"))) < limit)
    )
    return edges.join(given.select("a", "b").distinct(), ["a", "b"], "left_anti")


def oriented(edges: DataFrame) -> DataFrame:
    """src, dst, direction: from the end with more neighbours to the other, both ways on a tie."""
    degree = edges.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("d"))
    rows = edges.join(degree.select(F.col("node").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("node").alias("b"), F.col("d").alias("db")), "b")
    turn = F.col("db") > F.col("da")
    return rows.select(F.when(turn, F.col("b")).otherwise(F.col("a")).alias("src"), F.when(turn, F.col("a")).otherwise(F.col("b")).alias("dst"), F.when(F.col("da") == F.col("db"), "<->").otherwise("->").alias("direction"))


def colliders(edges: DataFrame) -> DataFrame:
    """x, z, y: neighbours x and y of z that aren't neighbours."""
    near = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    wedges = near.select(F.col("b").alias("z"), F.col("a").alias("x")).join(near.select(F.col("b").alias("z"), F.col("a").alias("y")), "z").where("x < y")
    return wedges.join(near.select(F.col("a").alias("x"), F.col("b").alias("y")), ["x", "y"], "left_anti").select("x", "z", "y")


def independence_statements(pairs: DataFrame, limit: float = 0.1, top: int = 100) -> DataFrame:
    """x, y, given: for the strongest pairs, the single features given which they are independent."""
    strongest = pairs.where(F.col("r").isNotNull()).orderBy(F.abs("r").desc(), "a", "b").limit(top)
    every = both_ways(pairs)
    rows = (
        strongest.select(F.col("a").alias("x"), F.col("b").alias("y"), F.col("r").alias("rxy"))
        .join(every.select(F.col("a").alias("x"), F.col("b").alias("z"), F.col("r").alias("rxz")), "x")
        .join(every.select(F.col("a").alias("y"), F.col("b").alias("z"), F.col("r").alias("ryz")), ["y", "z"])
    )
    return rows.where(F.abs(partial_r(F.col("rxy"), F.col("rxz"), F.col("ryz"))) < limit).groupBy("x", "y").agg(F.array_sort(F.collect_set("z")).alias("given"))


def shared_neighbours(pairs: DataFrame, limit: float = 0.2, pair_limit: float = 0.3, top: int = 50) -> DataFrame:
    """x, y, z: features correlated with both ends of the strongest pairs."""
    strongest = pairs.where(F.abs("r") > pair_limit).orderBy(F.abs("r").desc(), "a", "b").limit(top)
    near = both_ways(pairs).where(F.abs("r") > limit)
    return (
        strongest.select(F.col("a").alias("x"), F.col("b").alias("y"))
        .join(near.select(F.col("a").alias("x"), F.col("b").alias("z")), "x")
        .join(near.select(F.col("a").alias("y"), F.col("b").alias("z")), ["y", "z"])
        .select("x", "y", "z")
    )


def column_profiles(df: DataFrame, order: str) -> DataFrame:
    """A row a column: type, known and distinct values, the first three in order, and of numbers least, greatest, mean and deviation."""
    numbers = ("double", "float", "int", "bigint", "smallint", "tinyint")
    out = []
    for name, kind in df.dtypes:
        c, number = F.col(name), kind in numbers or kind.startswith("decimal")
        value = lambda f: (f(c.cast("double")) if number else F.lit(None)).cast("double")  # noqa: E731, B023
        out.append(F.struct(F.lit(name).alias("column_name"), F.lit("number" if number else "text").alias("kind"), F.count("*").alias("n"), F.count(c).alias("known"), F.count_distinct(c).alias("n_unique"), value(F.min).alias("low"), value(F.max).alias("high"), value(F.avg).alias("mean"), value(F.stddev_samp).alias("std")))
    rows = df.agg(F.array(*out).alias("a")).select(F.inline("a"))
    first = df.orderBy(order).limit(3).withColumn("_k", F.row_number().over(Window.orderBy(order)))  # three rows
    shown = first.select("_k", F.inline(F.array(*[F.struct(F.lit(k).alias("column_name"), F.col(k).cast("string").alias("v")) for k in df.columns])))
    shown = shown.groupBy("column_name").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_k", "v"))), lambda x: x["v"]), "|").alias("first_values"))
    return rows.join(shown, "column_name", "left")


def markdown_report(profiles: DataFrame, title: str) -> DataFrame:
    """One row: a Markdown table of a few columns' profiles."""
    line = F.concat_ws(" | ", F.concat(F.lit("| "), "column_name"), "kind", F.col("known").cast("string"), F.concat(F.col("n_unique").cast("string"), F.lit(" |")))
    rows = F.array_sort(F.collect_list(F.struct("column_name", line.alias("line"))))
    head = f"# {title}\n\n| column | kind | known | distinct |\n|-|-|-|-|\n"
    return profiles.agg(F.concat(F.lit(head), F.array_join(F.transform(rows, lambda x: x["line"]), "\n")).alias("report"))


def strong_edges(pairs: DataFrame, limit: float = 0.3) -> DataFrame:
    """Edges of the quick skeleton: pairs whose |r| is above the limit, strongest first."""
    return pairs.where(F.abs("r") > limit).select("a", "b", "r").orderBy(F.abs("r").desc(), "a", "b")


def variance_ranking(df: DataFrame, columns: list[str], group: str, most_missing: float = 0.5) -> DataFrame:
    """feature, f, df1, df2, eta2 of every column known in at least half of the rows, by groups; the largest F first."""
    share = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns]).first()
    out = None
    for c in columns:
        if share[c] is not None and share[c] <= most_missing:
            one = anova(df, c, group).withColumn("feature", F.lit(c))
            out = one if out is None else out.unionByName(one)
    return out


def group_moments(df: DataFrame, value: str, group: str) -> DataFrame:
    """group, n, mean and population deviation of a column's known values, groups of two or more."""
    return df.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(F.col(group).alias("group")).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std")).where("n >= 2")


def yeo_johnson(df: DataFrame, column: str, grid: int = 41) -> DataFrame:
    """n, lambda in [-2, 4] of the largest log likelihood over a grid, and that; one pass over the rows."""
    table = F.array(*[F.lit(-2 + 6 * i / (grid - 1)) for i in range(grid)])
    x = F.col("x")
    rows = df.select(F.col(column).cast("double").alias("x")).where("x is not null").select("x", F.explode(table).alias("l"))
    l = F.col("l")  # noqa: E741
    y = F.when(x >= 0, F.when(F.abs(l) < 1e-9, F.log1p(x)).otherwise((F.pow(x + 1, l) - 1) / l)).otherwise(F.when(F.abs(l - 2) < 1e-9, -F.log1p(-x)).otherwise(-(F.pow(1 - x, 2 - l) - 1) / (2 - l)))
    found = rows.withColumn("y", y).groupBy("l").agg(F.count("*").alias("n"), (-F.count("*") / 2.0 * F.ln(F.var_pop("y")) + (l - 1) * F.sum(F.signum(x) * F.log1p(F.abs(x)))).alias("llf"))
    return found.agg(F.max_by(F.struct("n", F.col("l").alias("lambda"), "llf"), "llf").alias("b")).select("b.*")


def table_profile(df: DataFrame) -> DataFrame:
    """column_name, n, known, nulls, n_unique of every column: one pass."""
    one = df.agg(F.count("*").alias("n"), *[F.struct(F.count(c).alias("k"), F.count_distinct(c).alias("u")).alias(f"_{c}") for c in df.columns])
    rows = F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"_{c}.k").alias("known"), F.col(f"_{c}.u").alias("n_unique")) for c in df.columns]))
    return one.select("n", rows).withColumn("nulls", F.col("n") - F.col("known"))
