"""Attributions, permutation importance, exact quantiles, modes, partial correlation: against enumeration and plain numpy."""

import math
from functools import reduce
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from trekframe.operators import attributions, distributions, models, partial, quantiles, stats


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 4)).round(3)
    y = x[:, 0] * 3 + np.where(x[:, 1] > 0, x[:, 2], -x[:, 2]) * 2 + rng.normal(size=600) * 0.1
    data = [(i, *map(float, r), float(t), None if i % 50 else "odd") for i, (r, t) in enumerate(zip(x, y))]
    return spark.createDataFrame(data, "id long, a double, b double, c double, d double, y double, note string").repartition(4)


NAMES = ["a", "b", "c", "d"]


def expected(tree, x, known):
    """Prediction of one tree when only the known features are: a split on another goes both ways by cover."""

    def at(node):
        f = tree.feature[node]
        if f < 0:
            return tree.value[node]
        left, right = tree.left[node], tree.right[node]
        if f in known:
            return at(left if x[f] <= tree.threshold[node] else right)
        return (tree.cover[left] * at(left) + tree.cover[right] * at(right)) / tree.cover[node]

    return at(0)


@pytest.mark.parametrize("boosted", [False, True])
def test_attributions_equal_enumeration_and_add_up(spark, rows, boosted, monkeypatch):
    model, known = models.fit_forest(rows, NAMES, "y", trees=6, depth=4, boosted=boosted)
    trees = attributions.model_trees(model)
    got = {r.id: r for r in attributions.tree_attributions(model, known, NAMES, ["id"]).collect()}
    from pyspark.ml.feature import VectorAssembler

    spark_says = {r.id: r._prediction for r in model.transform(VectorAssembler(inputCols=NAMES, outputCol="_features").transform(known)).collect()}
    data = {r.id: [r[c] for c in NAMES] for r in known.collect()}
    for i in list(data)[:40]:
        for j in range(4):
            others = [k for k in range(4) if k != j]
            phi = 0.0
            for size in range(4):
                for s in combinations(others, size):
                    gain = sum(w * (expected(t, data[i], {*s, j}) - expected(t, data[i], set(s))) for w, t in trees)
                    phi += math.factorial(size) * math.factorial(3 - size) / math.factorial(4) * gain
            assert abs(got[i][f"phi_{NAMES[j]}"] - phi) < 1e-9
    for i, r in got.items():
        assert abs(r.prediction - spark_says[i]) < 1e-9
        assert abs(r.base + sum(r[f"phi_{c}"] for c in NAMES) - r.prediction) < 1e-9
    monkeypatch.setattr(attributions, "TABLE_FEATURES", 1)  # the way of trees with many features on a path
    again = {r.id: r for r in attributions.tree_attributions(model, known, NAMES, ["id"]).collect()}
    assert all(abs(again[i].phi_a - got[i].phi_a) < 1e-12 for i in got)


def test_attribution_reports(spark, rows):
    model, known = models.fit_forest(rows, NAMES, "y", trees=5)
    odd = known.withColumn("a", F.when(F.col("id") != 0, F.col("a")))
    found = attributions.tree_attributions(model, odd, NAMES, ["id"])
    assert [r.phi_a for r in found.where("id = 0").collect()] == [None] and found.count() == 600
    ranked = attributions.attribution_importance(found, NAMES).orderBy("rank").collect()
    sizes = {c: np.mean([abs(r[f"phi_{c}"]) for r in found.collect() if r[f"phi_{c}"] is not None]) for c in NAMES}
    assert [r.feature for r in ranked] == sorted(NAMES, key=lambda c: -sizes[c]) and abs(ranked[0].importance - max(sizes.values())) < 1e-9
    bars = attributions.importance_bars(attributions.attribution_importance(found, NAMES), top=2).orderBy("rank").collect()
    assert len(bars) == 2 and bars[0].line.startswith(" 1. a ") and bars[0].line.count("#") == 50
    examples = attributions.attribution_examples(found, NAMES, ["id"], rows=3, top=2).collect()
    assert {r.id for r in examples} == {1, 2, 3} and len(examples) == 6
    assert attributions.tree_attributions(model, known.limit(0), NAMES, ["id"]).count() == 0


def test_permutation_importance_against_numpy(spark, rows):
    model, known = models.fit_forest(rows, NAMES, "y", trees=10)
    trees = attributions.model_trees(model)
    data = known.collect()
    x, y = np.array([[r[c] for c in NAMES] for r in data]), np.array([r.y for r in data])
    predict = lambda m: sum(w * t.predict(m) for w, t in trees)
    measures = {"mse": lambda e: (e**2).mean(), "mae": lambda e: np.abs(e).mean(), "r2": lambda e: -(1 - (e**2).sum() / ((y - y.mean()) ** 2).sum())}
    rng = np.random.default_rng(0)
    for metric, measure in measures.items():
        got = {r.feature: r for r in models.permutation_importance(rows, NAMES, "y", "id", repeats=8, model=model, metric=metric).collect()}
        for j, c in enumerate(NAMES):
            rises = []
            for _ in range(60):
                m = x.copy()
                m[:, j] = rng.permutation(m[:, j])
                rises.append(measure(y - predict(m)) - measure(y - predict(x)))
            assert abs(got[c].importance - np.mean(rises)) < 4 * np.std(rises) / math.sqrt(8) + 1e-9, (metric, c)
            assert got[c].deviation < 4 * np.std(rises) + 1e-9
    many = {r.feature: r.importance for r in models.permutation_importance(rows, NAMES, "y", "id", repeats=4, model=model, block=40).collect()}
    assert max(many, key=many.get) == "a" and min(many, key=many.get) == "d"
    with pytest.raises(ValueError):
        models.permutation_importance(rows, NAMES, "y", "id", metric="rank", model=model)


def test_text_targets_become_numbers(spark):
    df = spark.createDataFrame([("b", 1), ("a", 2), (None, 3), ("b", 4)], "kind string, i int")
    assert {r.i: r.kind for r in models.factorised(df, "kind").collect()} == {1: 1.0, 2: 0.0, 3: None, 4: 1.0}


@pytest.mark.parametrize("range_rows, bins", [(None, 4096), (50, 8), (7, 1)])
def test_quantiles_equal_numpys(spark, range_rows, bins):
    rng = np.random.default_rng(1)
    groups = {"even": rng.normal(size=2000), "hot": np.r_[np.zeros(1500), rng.exponential(size=500)], "far": np.r_[1e300, -1e300, rng.normal(size=301)], "one": np.array([5.0]), "same": np.full(9, 2.5), "two": np.array([1.0, 2.0]), "ends": np.r_[np.inf, -np.inf, np.inf, 1.0, 2.0]}
    data = [(g, float(v)) for g, values in groups.items() for v in values] + [("even", None), ("even", float("nan")), ("none", None)]
    p = [0.0, 0.1, 0.25, 0.5, 0.999, 1.0]
    got = {r.g: r.q for r in quantiles.quantiles(spark.createDataFrame(data, "g string, value double").repartition(5), ["g"], p, bins=bins, range_rows=range_rows).collect()}
    assert set(got) == set(groups)
    for g, values in groups.items():
        with np.errstate(invalid="ignore"):
            want = np.quantile(values, p)
        for a, b in zip(got[g], want):
            assert a == b or abs(a - b) <= 1e-9 * max(1, abs(b)) or np.isnan(b), (g, got[g], want)


def test_quantiles_of_many_distinct_values_without_groups(spark):
    df = spark.range(0, 10_000_000, 1, 16).selectExpr("cast(id * 7 % 10000019 as double) as value")
    values = np.arange(10_000_000) * 7 % 10000019
    plan = quantiles.quantiles(df, [], [0.25, 0.5, 0.9])
    assert "percentile(" not in plan._jdf.queryExecution().optimizedPlan().toString()
    assert plan.first().q == np.quantile(values.astype(float), [0.25, 0.5, 0.9]).tolist()


def lattice_dip(values, steps=24):
    """The nearest unimodal distribution function on a lattice of heights, by trying all of them: convex up to a mode, concave after it."""
    x, c = np.unique(values, return_counts=True)
    top = np.cumsum(c) / len(values)
    bottom = np.r_[0, top[:-1]]
    heights = np.arange(steps + 1) / steps
    best = [1.0]

    def go(i, last, slope, falling, worst):
        if worst >= best[0]:
            return
        if i == len(x):
            best[0] = worst
            return
        for h in heights:
            off = max(worst, abs(top[i] - h), abs(bottom[i] - h))
            if i == 0:
                go(1, h, 0.0, False, off)
                continue
            s = (h - last) / (x[i] - x[i - 1])
            if s < -1e-12:
                continue
            if s >= slope - 1e-12 and not falling:
                go(i + 1, h, s, False, off)
            elif s <= slope + 1e-12:
                go(i + 1, h, s, True, off)

    go(0, 0, 0, False, 0)
    return best[0]


def test_dip_statistic():
    n = 20
    assert distributions.dip(np.arange(n, dtype=float), np.arange(1, n + 1)) == pytest.approx(1 / (2 * n))
    assert distributions.dip(np.array([0.0, 1.0]), np.array([50, 100])) == pytest.approx(0.25)
    rng = np.random.default_rng(2)
    for _ in range(12):
        values = rng.integers(0, 9, 6).astype(float)
        x, c = np.unique(values, return_counts=True)
        assert abs(distributions.dip(x, np.cumsum(c)) - lattice_dip(values)) <= 1.01 / 24, values
    x = np.sort(rng.normal(size=300))
    d = distributions.dip(x, np.arange(1, 301))
    assert distributions.dip(5 - 3 * x[::-1], np.arange(1, 301)) == pytest.approx(d)
    assert d < 0.03 < distributions.dip(np.sort(np.r_[x, x + 8]), np.arange(1, 601))


def test_modes_and_decisions(spark):
    rng = np.random.default_rng(7)
    n = 1200
    columns = {
        "one": rng.normal(50, 10, n), "two": np.r_[rng.normal(30, 4, n // 2), rng.normal(70, 4, n // 2)], "three": np.r_[rng.normal(10, 2, n // 3), rng.normal(40, 2, n // 3), rng.normal(70, 2, n // 3)],
        "log": np.exp(rng.normal(2, 0.5, n)), "flat": rng.random(n), "zeros": np.r_[np.zeros(n // 2), rng.normal(5, 1, n // 2)], "right": rng.exponential(1.0, n) ** 1.5,
    }
    df = spark.createDataFrame([(i, *(float(v[i]) for v in columns.values())) for i in range(n)], "id long, " + ", ".join(f"{c} double" for c in columns)).repartition(4)
    dips = {r.feature: r.p for r in distributions.dip_test(df, list(columns)).collect()}
    assert dips["two"] < 0.05 and dips["three"] < 0.05 and dips["one"] > 0.05 and dips["flat"] > 0.05
    votes = {r.feature: r for r in distributions.mode_votes(df, ["one", "two", "three"]).collect()}
    assert not votes["one"].multimodal and votes["two"].multimodal and votes["two"].n_modes == 2 and votes["three"].n_modes == 3 and votes["two"].votes == 3
    kinds = {r.feature: r.kind for r in distributions.decide(distributions.distribution_facts(df, list(columns), "id")).collect()}
    assert kinds["one"] == "normal" and kinds["two"] == "bimodal" and kinds["three"] == "multimodal" and kinds["log"] == "lognormal" and kinds["zeros"] == "zero_inflated"
    assert {r.feature: r.votes for r in distributions.normal_votes(df, ["one"], "id").collect()} == {"one": 4}
    thin = distributions.dip_test(df.withColumn("many", F.col("one")), ["many"]).first()
    assert thin.n == n
    assert distributions.dip_test(df.limit(5), ["one"]).count() == 0


def test_the_dip_of_a_thinned_column_is_close(spark, monkeypatch):
    df = spark.range(5000).selectExpr("cast(id * id % 4999 as double) as v")
    whole = distributions.dip_test(df, ["v"]).first()
    monkeypatch.setattr(distributions, "DIP_POINTS", 500)
    thin = distributions.dip_test(df, ["v"]).first()
    assert thin.n == whole.n == 5000 and abs(thin.dip - whole.dip) <= 0.5 / 500 + 1e-9


def test_transformation_advice(spark):
    rng = np.random.default_rng(9)
    df = spark.createDataFrame([(i, float(a), float(b), None) for i, (a, b) in enumerate(zip(np.exp(rng.normal(2, 0.6, 900)), rng.normal(0, 1, 900)))], "id long, skew double, fine double, unknown double")
    got = distributions.recommend_transformations(df, ["skew", "fine", "unknown"], "id").collect()
    first = {r.feature: r.transformation for r in got if r.place == 1}
    assert first == {"skew": "log", "fine": "none"}
    assert {r.transformation for r in got if r.feature == "fine"} == {"none", "yeo_johnson"}
    cox = next(r for r in got if r.feature == "skew" and r.transformation == "box_cox")
    assert abs(cox["lambda"]) <= 0.15 and cox.achieves


def test_quantile_and_share_plots(spark):
    from statistics import NormalDist

    rng = np.random.default_rng(4)
    x = np.round(rng.normal(10, 3, 400), 1)
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double")
    fit = distributions.qq_fit(df, "v").first()
    values, counts = np.unique(x, return_counts=True)
    rank = np.cumsum(counts) - (counts - 1) / 2
    q = np.repeat([NormalDist().inv_cdf((r - 0.3175) / 400.365) for r in rank], counts)
    slope, intercept = np.polyfit(q, np.sort(x), 1)
    assert fit.n == 400 and abs(fit.slope - slope) < 1e-8 and abs(fit.intercept - intercept) < 1e-8 and abs(fit.r2 - np.corrcoef(q, np.sort(x))[0, 1] ** 2) < 1e-9
    points = {r.value: r for r in distributions.pp_points(df, "v").collect()}
    normal = NormalDist(x.mean(), x.std())
    for v, upto in zip(values, np.cumsum(counts)):
        assert abs(points[v].theoretical - normal.cdf(v)) < 1e-9 and abs(points[v].empirical - upto / 401) < 1e-12 and abs(points[v].gap - abs(normal.cdf(v) - upto / 401)) < 1e-9


def residual_r(x, y, z):
    ok = ~np.isnan(np.column_stack([x, y, *z])).any(axis=1)
    x, y = x[ok], y[ok]
    if ok.sum() < len(z) + 3:
        return 0.0
    if z:
        whole = x.std(), y.std()
        m = np.column_stack([np.ones(ok.sum()), *[v[ok] for v in z]])
        x, y = x - m @ np.linalg.lstsq(m, x, rcond=None)[0], y - m @ np.linalg.lstsq(m, y, rcond=None)[0]
        if x.std() < 1e-6 * whole[0] or y.std() < 1e-6 * whole[1]:
            return 0.0  # nothing is left of one
    return float(np.corrcoef(x, y)[0, 1])


def test_partial_correlation_equals_residual_regression(spark):
    rng = np.random.default_rng(11)
    base = rng.normal(size=(500, 3))
    x = np.column_stack([base[:, 0], base[:, 0] + base[:, 1], base[:, 1] * 2 + base[:, 2], base[:, 2], base.sum(axis=1) + rng.normal(size=500), 1000 + rng.normal(size=500)])
    x[rng.random(x.shape) < 0.1] = np.nan
    names = list("abcdef")
    df = spark.createDataFrame([tuple(None if np.isnan(v) and i % 2 else float(v) for v in r) for i, r in enumerate(x)], ", ".join(f"{c} double" for c in names)).repartition(3)
    statements = [(p, q, list(z)) for p, q in combinations(names, 2) for k in range(4) for z in combinations([c for c in names if c not in (p, q)], k)]
    got = {(r.x, r.y, tuple(r.given)): r for r in partial.partial_correlations(df, statements).collect()}
    assert len(got) == len(statements)
    of = {c: x[:, i] for i, c in enumerate(names)}
    for p, q, z in statements:
        assert abs(got[p, q, tuple(z)].r - residual_r(of[p], of[q], [of[c] for c in z])) < 1e-8, (p, q, z)
    few = partial.partial_correlations(df.limit(3), [("a", "b", ["c"]), ("a", "b", [])]).collect()
    assert few[0].r == 0.0
    edges, separated = partial.pc_skeleton(df, names, most_given=2)
    plain = plain_skeleton(of, names, 2)
    assert {(r.a, r.b) for r in edges.collect()} == plain and {(r.a, r.b) for r in separated.collect()} == set(combinations(names, 2)) - plain


def plain_skeleton(of, names, most):
    near = {c: {o for o in names if o != c} for c in names}
    for size in range(most + 1):
        for p in names:
            for q in sorted(near[p]):
                for z in combinations(sorted((near[p] | near[q]) - {p, q})[:3], size):
                    if abs(residual_r(of[p], of[q], [of[c] for c in z])) < 0.1:
                        near[p].discard(q)
                        near[q].discard(p)
                        break
    return {(p, q) for p, q in combinations(names, 2) if q in near[p]}


def test_a_profile_has_the_same_quartiles_as_numpy(spark):
    df = spark.range(1, 102).selectExpr("cast(id * id as double) as v", "cast(null as double) as none")
    row = stats.numeric_profile(df, ["v", "none"]).collect()
    assert [r.feature for r in row] == ["v"] and [row[0].q1, row[0].median, row[0].q3] == np.quantile(np.arange(1, 102.0) ** 2, [0.25, 0.5, 0.75]).tolist()


@pytest.mark.parametrize("name", ["mode_consensus", "decided_kinds"])
def test_means_are_added_up_as_in_sql(spark, tmp_path, name):
    """Suppliers whose mean tax is 0.04 but for the order of summation, in a table with several suppliers of that kind, and one without a key."""
    import duckdb

    from trekframe.plans import registry

    con = duckdb.connect()
    con.execute("create view given as select * from '/root/testdata/sf0.1/lineitem.parquet' where l_suppkey in (170, 187, 311, 363, 417, 530)")
    con.execute(f"copy (select * from given union all select * replace (null as l_suppkey) from given where l_suppkey = 187) to '{tmp_path}/lineitem.parquet' (format parquet)")
    con.execute(f"create view lineitem as select * from '{tmp_path}/lineitem.parquet'")
    df = registry.QUERIES[name](spark, str(tmp_path))
    want = con.execute(f"select {', '.join(df.columns)} from ({registry.ORACLES[name]})").fetchall()
    assert len(want) == 7 and {tuple(r) for r in df.collect()} == set(want)


def test_means_are_added_up_by_row_group(spark, tmp_path):
    """Suppliers with rows in several row groups and files: each row group by itself, then their sums in order, where one running sum answers otherwise."""
    import pyarrow as pa
    import pyarrow.compute as pc
    import pyarrow.parquet as pq

    from trekframe.plans import model_queries
    from trekframe.sources.row_groups import with_row_group

    given = pq.read_table("/root/testdata/sf0.1/lineitem.parquet")
    parts = [part.filter(pc.is_in(part["l_suppkey"], pa.array([170, 187, 311, 363, 417, 530]))) for part in (given.slice(at, 122_880) for at in range(0, given.num_rows, 122_880))]
    for name, held in (("a b.parquet", parts[:3]), ("c.parquet", parts[3:])):
        with pq.ParquetWriter(f"{tmp_path}/{name}", given.schema) as out:
            for part in held:
                out.write_table(part)
    lines = spark.read.parquet(str(tmp_path))
    got = {(r.row_group, r.l_suppkey): r.n for r in with_row_group(lines).groupBy("row_group", "l_suppkey").agg(F.count("*").alias("n")).collect()}
    assert got == {(i, k): part["l_suppkey"].to_pylist().count(k) for i, part in enumerate(parts) for k in set(part["l_suppkey"].to_pylist())}

    def mean(groups):
        total = 0.0
        for group in groups:
            total += reduce(lambda a, v: a + v, group, 0.0)
        return total / sum(map(len, groups))

    values = {k: [part.filter(pc.equal(part["l_suppkey"], k))["l_tax"].to_pylist() for part in parts] for k in set(given["l_suppkey"].to_pylist()) & {170, 187, 311, 363, 417, 530}}
    want = {k: mean(groups) > 0.04 for k, groups in values.items()}
    assert want != {k: mean([sum(groups, [])]) > 0.04 for k, groups in values.items()}
    taxed = {(r.feature, r.many) for r in model_queries._answers(lines).collect()}
    votes = {k: model_queries.mean_by_row_group(with_row_group(lines), "l_suppkey", "l_tax").where(F.col("l_suppkey") == k).first().mean > 0.04 for k in want}
    assert votes == want and set(want.items()) <= taxed


@pytest.mark.parametrize("most", [30, 100_000])
def test_each_cell_between_thresholds_is_answered_once(most):
    rng = np.random.default_rng(5)
    whole = lambda v: np.array(v)
    trees = [attributions.Tree(whole([j, -1, (j + 1) % 3, -1, -1]), np.r_[rng.normal(), 0, rng.normal(), 0, 0], whole([1, -1, 3, -1, -1]), whole([2, -1, 4, -1, -1]), rng.normal(size=5), np.array([10.0, 4, 6, 2, 4])) for j in (0, 1, 2, 0)]
    asked = []
    direct = lambda x: sum(t.predict(x) for t in trees)
    cells = attributions.Cells(trees, 3, lambda x: (asked.append(len(x)), direct(x))[1], most)
    for _ in range(5):
        x = rng.normal(size=(2000, 3)).round(1)
        x[::97, 1] = np.nan
        x[0] = [trees[0].threshold[0], trees[1].threshold[0], trees[2].threshold[0]]
        assert (cells(x) == direct(x)).all()
    assert cells(np.zeros((0, 3))).shape == (0,)
    assert most < 100 or sum(asked) <= math.prod(cells.sizes)


def test_attributions_of_many_like_rows_ask_for_few(spark, rows, monkeypatch):
    """Rows in the same cell take one computation a task, not one each."""
    model, known = models.fit_forest(rows, NAMES, "y", trees=3, depth=3)
    trees = [(w, t, attributions.leaves(t)) for w, t in attributions.model_trees(model)]
    x = np.array([[r[c] for c in NAMES] for r in known.collect()])
    cells = attributions.Cells([t for _, t, _ in trees], 4, lambda m: np.column_stack(attributions.attribute(trees, m)))
    direct = np.column_stack(attributions.attribute(trees, x))
    assert (cells(x) == direct).all() and (cells(np.tile(x, (20, 1))) == np.tile(direct, (20, 1))).all() and len(cells._codes) <= len(x)


def test_lambdas_and_moments_of_counted_values(spark):
    def yeo(x, g):
        power = lambda v, e: np.log(v) if e == 0 else (v**e - 1) / e
        return np.where(x >= 0, power(np.where(x >= 0, x, 0) + 1, g), -power(1 - np.where(x < 0, x, 0), 2 - g))

    rng = np.random.default_rng(3)
    x = np.round(np.r_[rng.normal(3, 2, 400), 1e6 + rng.normal(0, 1, 300)], 1)
    values, c = np.unique(x, return_counts=True)
    counts = spark.createDataFrame([("a", float(v), int(n)) for v, n in zip(values, c)] + [("constant", 0.1, 7)], "feature string, value double, c long").repartition(5)
    got = {(r.feature, r.tag, r.k): r.v for r in distributions.lambda_variances(counts, [-1.0, 0.0, 2.0]).collect()}
    pos = x[x > 0]
    for k, t in enumerate((1 - 1 / pos, np.log(pos), (pos**2 - 1) / 2)):
        assert math.isclose(got["a", "b", k], t.var(), rel_tol=1e-9)
    for k, g in enumerate((-1.0, 0.0, 2.0)):
        assert math.isclose(got["a", "y", k], yeo(x, g).var(), rel_tol=1e-9)
    assert got["constant", "b", 0] == got["constant", "y", 2] == 0
    m = {r.feature: r for r in distributions.counted_moments(counts).collect()}
    z = (x - x.mean()) / x.std()
    want = (len(x), x.mean(), x.std(ddof=1), (z**3).mean(), (z**4).mean() - 3)
    assert all(math.isclose(a, b, rel_tol=1e-8) for a, b in zip((m["a"].n, m["a"].m, m["a"].s, m["a"].skew, m["a"].kurt), want))
    assert m["constant"].s == 0 or m["constant"].s is None


def test_advice_costs_distinct_values(spark):
    """Sixty copies of each row get the fits from the same distinct values."""
    seen = []
    real = distributions.lambda_variances
    df = spark.range(6000).select("id", ((F.col("id") % 100) + 1).cast("double").alias("v"))
    try:
        distributions.lambda_variances = lambda counts, grid: (seen.append(counts.count()), real(counts, grid))[1]
        rows = distributions.recommend_transformations(df, ["v"], "id").collect()
    finally:
        distributions.lambda_variances = real
    assert seen == [100] and {r.transformation for r in rows} == {"none", "log", "sqrt", "box_cox", "yeo_johnson"}


@pytest.fixture(scope="module")
def steps(spark):
    """Features of few values, one with more than a forest has bins, and rows less than the sample of which Spark takes thresholds."""
    rng = np.random.default_rng(8)
    x = np.stack([rng.integers(0, 12, 6000) / 4, rng.integers(-3, 4, 6000), rng.integers(0, 45, 6000) ** 2 / 10], 1).astype(float)
    y = 1000 + 5 * (x[:, 0] > 1) + x[:, 1] ** 2 + 0.01 * x[:, 2] + rng.normal(size=6000) * 3
    data = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y))] + [(-1, None, 1.0, 1.0, 1e9), (-2, 1.0, float("nan"), 1.0, 1e9), (-3, 1.0, 1.0, 1.0, None)]
    return spark.createDataFrame(data, "id long, p double, q double, r double, y double").repartition(4).cache()


STEPS = ["p", "q", "r"]


def spark_forest(steps, **options):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    rows = VectorAssembler(inputCols=STEPS, outputCol="x").transform(steps.dropna())
    return RandomForestRegressor(featuresCol="x", labelCol="y", maxDepth=5, seed=42, **options).fit(rows)


def test_forest_of_few_values_passes_over_the_rows_once(spark, steps, monkeypatch):
    """Spark's own fit, which visits every tree for every row and level, isn't needed; the forest is like Spark's."""
    theirs = spark_forest(steps, numTrees=200)
    each = np.array([t.featureImportances.toArray() for t in theirs.trees])

    def never(**_):
        raise AssertionError("Spark's forest was fitted to the rows")

    monkeypatch.setattr(models, "RandomForestRegressor", never)
    model, known = models.fit_forest(steps, STEPS, "y", trees=200)
    assert known.count() == 6000 and len(model.trees) == 200
    ours = model.featureImportances.toArray()
    assert abs(ours.sum() - 1) < 1e-9 and (abs(ours - each.mean(0)) < 5 * each.std(0) / 10).all()
    covers = np.array([t.cover[0] for t in model.trees])
    assert abs(covers.mean() - 6000) < 5 * math.sqrt(6000 / 200) and 0.75 < covers.std() / math.sqrt(6000) < 1.25
    trees, spark_trees = attributions.model_trees(model), attributions.model_trees(theirs)
    x = np.array([[r[c] for c in STEPS] for r in known.collect()])
    mine, them = (sum(w * t.predict(x) for w, t in m) for m in (trees, spark_trees))
    assert np.corrcoef(mine, them)[0, 1] > 0.99 and abs(mine - them).mean() < 0.3
    got = attributions.tree_attributions(model, known, STEPS, ["id"]).collect()
    assert all(abs(r.base + sum(r[f"phi_{c}"] for c in STEPS) - r.prediction) < 1e-9 for r in got) and len(got) == 6000
    again, _ = models.fit_forest(steps, STEPS, "y", trees=200)
    assert np.allclose(again.featureImportances.toArray(), ours) and all((a.feature == b.feature).all() for a, b in zip(again.trees, model.trees))
    sds = known.agg(*[F.stddev_pop(c).alias(c) for c in STEPS]).first()
    found = models.forest_importance(steps, STEPS, "y")
    assert {c for c, _ in found} == set(STEPS) and found == sorted(found, key=lambda v: -v[1])
    assert abs(sum(v / sds[c] for c, v in found) - 1) < 1e-9


def test_tree_of_cells_equals_sparks(spark, steps):
    """Without weights and with all features at every split the tree is Spark's: nodes, thresholds, means, counts, importances."""
    model = spark_forest(steps, numTrees=1, bootstrap=False, featureSubsetStrategy="all")
    known = np.array([[r[c] for c in [*STEPS, "y"]] for r in steps.dropna().collect()])
    edges = models.candidate_thresholds(steps.dropna(), STEPS, 80_000)
    assert [len(e) for e in edges] == [11, 6, 31]
    sizes = [len(e) + 1 for e in edges]
    cell = np.ravel_multi_index([np.searchsorted(e, known[:, j]) for j, e in enumerate(edges)], sizes)
    at, w = np.unique(cell, return_counts=True)
    tree, gains = models.grow(np.stack(np.unravel_index(at, sizes)), w.astype(float), np.bincount(cell, known[:, 3])[at], edges, 3, 5, np.random.default_rng(0))
    [(_, theirs)] = attributions.model_trees(model)
    nodes = lambda t: sorted(zip(t.feature.tolist(), t.threshold.round(9).tolist(), t.cover.tolist(), t.value.round(6).tolist()))
    assert nodes(tree) == nodes(theirs) and len(tree.cover) > 40
    assert np.allclose(tree.predict(known[:, :3]), theirs.predict(known[:, :3]))
    assert np.allclose(gains / gains.sum(), model.featureImportances.toArray())


def test_forests_of_constants_many_values_and_many_cells(spark, steps, monkeypatch):
    flat, _ = models.fit_forest(steps.withColumn("y", F.lit(0.1)).withColumn("p", F.lit(2.0)), STEPS, "y", trees=5)
    assert all(len(t.cover) == 1 and abs(t.value[0] - 0.1) < 1e-12 for t in flat.trees) and flat.featureImportances.toArray().sum() == 0
    monkeypatch.setattr(models, "FEW_VALUES", 20)
    edges = models.candidate_thresholds(steps.dropna(), STEPS, 80_000)
    assert [len(e) for e in edges[:2]] == [11, 6] and 25 < len(edges[2]) <= 31
    assert models.candidate_thresholds(steps.dropna(), STEPS, 1000) is None  # more cells than allowed
    assert models.candidate_thresholds(steps.dropna().limit(500), STEPS, 80_000) is None  # more cells than rows
    assert models.candidate_thresholds(steps.limit(0), STEPS, 80_000) is None


def test_boosted_trees_of_counted_rows_equal_those_of_all_rows(spark, steps, monkeypatch):
    """The fit sees each pair of features once; trees, row counts and importances are those of the rows."""
    from pyspark.ml.feature import VectorAssembler

    seen, real = [], models.GBTRegressor
    rows = VectorAssembler(inputCols=["p", "q"], outputCol="_features").transform(steps.dropna())
    theirs = real(maxIter=6, featuresCol="_features", labelCol="y", maxDepth=3, seed=42).fit(rows)

    class Counting(real):
        def fit(self, dataset):
            seen.append(dataset.count())
            return super().fit(dataset)

    monkeypatch.setattr(models, "GBTRegressor", Counting)
    model, known = models.fit_forest(steps, ["p", "q"], "y", trees=6, depth=3, boosted=True)
    assert seen == [84] and known.count() == 6000
    for (a, mine), (b, tree) in zip(attributions.model_trees(model), attributions.model_trees(theirs), strict=True):
        assert a == b and (mine.feature == tree.feature).all() and np.allclose(mine.threshold, tree.threshold)
        assert np.allclose(mine.cover, tree.cover) and mine.cover[0] == 6000 and np.allclose(mine.value, tree.value, atol=1e-6)
    assert np.allclose(model.featureImportances.toArray(), theirs.featureImportances.toArray())
