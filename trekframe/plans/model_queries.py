"""Queries of distribution tests, importance, and what addresses tell."""

from __future__ import annotations

from pyspark.sql import functions as F

from trekframe.operators import addresses, attributions, distributions, models
from trekframe.plans.analysis_queries import NUMERIC, rounded
from trekframe.plans.registry import query
from trekframe.sources.bridge import oracle, track_points
from trekframe.sources.row_groups import mean_by_row_group, with_row_group


@query()
def anderson_darling(spark, sf):
    return rounded(distributions.anderson_darling(track_points(spark, sf), NUMERIC))


@query()
def shapiro_wilk(spark, sf):
    return rounded(distributions.shapiro_wilk(track_points(spark, sf), NUMERIC, "event_id"))


@query()
def normality_votes(spark, sf):
    return distributions.normal_votes(track_points(spark, sf), NUMERIC, "event_id")


@query()
def dip_test(spark, sf):
    return rounded(distributions.dip_test(track_points(spark, sf), NUMERIC), 8)


@query()
def mode_votes(spark, sf):
    return distributions.mode_votes(track_points(spark, sf), NUMERIC)


@query()
def distribution_decisions(spark, sf):
    return distributions.decide(distributions.distribution_facts(track_points(spark, sf), NUMERIC, "event_id"))


_ANSWERS = """select l_suppkey as feature, many, case when many then modes else 1 end as modes from (
    select l_suppkey, count(distinct month(l_shipdate)) % 3 > 0 as many, 1 + count(distinct month(l_shipdate)) % 4 as modes from lineitem where l_quantity > 45 group by 1
    union all select l_suppkey, max(l_discount) > 3 * avg(l_discount), 2 from lineitem where l_quantity < 3 group by 1
    union all select l_suppkey, avg(l_tax) > 0.04, 1 + count(distinct l_returnflag) from lineitem group by 1) a"""
_FACTS = """select f.l_suppkey as feature, f.n, f.zeros, f.skewness, f.normal, f.lognormal, coalesce(m.multimodal, false) as multimodal, coalesce(m.n_modes, 1) as n_modes from (
    select l_suppkey, count(*) as n, avg(case when l_tax = 0 then 1.0 else 0.0 end) * 2.4 as zeros, (avg(l_quantity) - 25.5) / 2.0 as skewness, count(*) % 5 = 0 as normal, count(*) % 7 = 0 as lognormal from lineitem group by 1) f
    left join modes m on m.feature = f.l_suppkey"""


#: An answer of _ANSWERS that asks for a mean, its rest, and what is asked of both.
_OF_MEANS = {
    "l_discount": ("select l_suppkey, max(l_discount) > 3 * avg(l_discount), 2 from lineitem where l_quantity < 3 group by 1", "select l_suppkey, max(l_discount) as most, 2 as modes from lineitem where l_quantity < 3 group by 1", "most > 3 * mean"),
    "l_tax": ("select l_suppkey, avg(l_tax) > 0.04, 1 + count(distinct l_returnflag) from lineitem group by 1", "select l_suppkey, 1 + count(distinct l_returnflag) as modes from lineitem group by 1", "mean > 0.04"),
}


def _answers(lines):
    """The answers in Spark's SQL. Some means are 0.04 but for the order of summation, so they are added up as in the SQL, whose threads take a row group at a time: each of these is one running sum."""
    sql, numbered = _ANSWERS, with_row_group(lines)
    for column, (answer, rest, asked) in _OF_MEANS.items():
        assert answer in sql
        sql = sql.replace(answer, f"select r.l_suppkey, {asked}, modes from ({rest}) r join {{{column}}} m on r.l_suppkey <=> m.l_suppkey")
    means = {"l_discount": mean_by_row_group(numbered.where("l_quantity < 3"), "l_suppkey", "l_discount"), "l_tax": mean_by_row_group(numbered, "l_suppkey", "l_tax")}
    return lines.sparkSession.sql(sql.replace("from lineitem", "from {lineitem}"), lineitem=lines, **means)


@query(f"select feature, count(*) as votes, avg(many::int) >= 0.5 as multimodal, floor(coalesce(quantile_cont(case when many then modes end, 0.5), 1))::bigint as n_modes from ({_ANSWERS}) group by 1")
def mode_consensus(spark, sf):
    return distributions.mode_consensus(_answers(spark.read.parquet(f"{sf}/lineitem.parquet")))


@query(
    f"""with modes as (select feature, avg(many::int) >= 0.5 as multimodal, floor(coalesce(quantile_cont(case when many then modes end, 0.5), 1))::bigint as n_modes from ({_ANSWERS}) group by 1),
    k as (select feature, case when n < 3 then 'unknown:0.0' when zeros > 0.3 then 'zero_inflated:0.9' when normal then 'normal:0.9' when lognormal then 'lognormal:0.85' when multimodal and n_modes = 2 then 'bimodal:0.85'
      when multimodal then 'multimodal:0.85' when abs(skewness) < 0.5 then 'uniform:0.7' when skewness > 1 then 'right_skewed:0.8' when skewness < -1 then 'left_skewed:0.8' else 'unknown:0.5' end as c from ({_FACTS}))
    select feature, split_part(c, ':', 1) as kind, split_part(c, ':', 2)::double as confidence from k"""
)
def decided_kinds(spark, sf):
    lines = spark.read.parquet(f"{sf}/lineitem.parquet")
    modes = distributions.mode_consensus(_answers(lines))
    return distributions.decide(spark.sql(_FACTS.replace("from lineitem", "from {lineitem}").replace("join modes", "join {modes}"), lineitem=lines, modes=modes))


@query()
def transformation_advice(spark, sf):
    return rounded(distributions.recommend_transformations(spark.read.parquet(f"{sf}/lineitem.parquet"), ["l_quantity", "l_extendedprice", "l_tax"], "l_orderkey"))


@query()
def qq_fit(spark, sf):
    return rounded(distributions.qq_fit(track_points(spark, sf), "altitude"))


@query(
    """with s as (select min(value) as a, max(value) as b, count(value) as n, avg(value) as m, stddev_samp(value) as s, stddev_pop(value) as p from events), f as (select a + (least(4095, floor((value-a)/((b-a)/4096))) + 0.5) * ((b-a)/4096) as x, count(*) as c from events, s where value is not null group by 1),
    g as (select *, a + (b-a) * i / 199 as gx, s * pow(n, -0.2) as h from s, range(200) r(i))
    select round(gx, 6) as x, round(sum(c * exp(-0.5*((gx-x)/h)*((gx-x)/h))) / (max(n) * max(h) * sqrt(2*pi())), 8) as kde, round(exp(-0.5*((gx-max(m))/max(p))*((gx-max(m))/max(p))) / (max(p) * sqrt(2*pi())), 8) as normal from g, f group by gx"""
)
def density_curves(spark, sf):
    c = distributions.density_curves(spark.read.parquet(f"{sf}/events.parquet"), "value")
    return c.select(F.round("x", 6).alias("x"), F.round("kde", 8).alias("kde"), F.round("normal", 8).alias("normal"))


@query()
def pp_points(spark, sf):
    return rounded(distributions.pp_points(track_points(spark, sf), "temperature"), 8)


@query()
def kde_peaks(spark, sf):
    return distributions.kde_peaks(track_points(spark, sf), NUMERIC)


@query()
def mixture_bic(spark, sf):
    return rounded(distributions.mixture_bic(track_points(spark, sf), ["altitude", "temperature"]), 3)


@query(
    """with g as (select -2+4*i/40.0::double as l from range(41) t(i)), y as (select l, ln(value) as x, case when abs(l)<1e-9 then ln(value) else (pow(value,l)-1)/l end as y from events cross join g where value>0)
    select count(*) as n, round(l,6) as lambda, round(-count(*)/2.0*ln(var_pop(y))+(l-1)*sum(x),2) as llf from y group by l order by -count(*)/2.0*ln(var_pop(y))+(l-1)*sum(x) desc limit 1"""
)
def box_cox(spark, sf):
    r = distributions.box_cox(spark.read.parquet(f"{sf}/events.parquet"), "value")
    return r.select("n", F.round("lambda", 6).alias("lambda"), F.round("llf", 2).alias("llf"))


@query(oracle("c as (select temperature as value, count(*) as c from track_points where temperature is not null group by 1), u as (select value, c, cast(sum(c) over (order by value) as bigint) as rank, sum(c) over () as n from c) select value, c, rank, round((rank-(c-1)/2.0-0.3175)/(n+0.365)::double,8) as p from u"))
def qq_positions(spark, sf):
    return rounded(distributions.qq_points(track_points(spark, sf), "temperature"), 8)


@query()
def permutation_test(spark, sf):
    return rounded(distributions.permutation_p(track_points(spark, sf), "altitude", "temperature", "event_id"))


@query()
def permutation_importance(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet").withColumn("row_id", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return models.permutation_importance(rows, ["l_quantity", "l_discount", "l_tax"], "l_extendedprice", "row_id")


@query()
def forest_importance(spark, sf):
    return spark.createDataFrame(models.forest_importance(spark.read.parquet(f"{sf}/lineitem.parquet"), ["l_quantity", "l_discount", "l_tax"], "l_extendedprice"), "feature string, importance double")


_PRICED = ["l_quantity", "l_discount", "l_tax"]


def _attributed(spark, sf, boosted=False):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    model, known = models.fit_forest(rows, _PRICED, "l_extendedprice", trees=20 if boosted else 100, boosted=boosted)
    return attributions.tree_attributions(model, known, _PRICED, ["l_orderkey", "l_linenumber"])


@query()
def tree_attributions(spark, sf):
    return _attributed(spark, sf)


@query()
def attribution_importance(spark, sf):
    return attributions.attribution_importance(_attributed(spark, sf), _PRICED)


@query()
def attribution_bars(spark, sf):
    return attributions.importance_bars(attributions.attribution_importance(_attributed(spark, sf, boosted=True), _PRICED))


@query()
def attribution_examples(spark, sf):
    return attributions.attribution_examples(_attributed(spark, sf), _PRICED, ["l_orderkey", "l_linenumber"])


_CASE = " ".join(f"when regexp_matches(lower(text), '{'|'.join(w)}') then '{k}'" for k, w in addresses.TERRAIN_WORDS.items())


@query(f"select doc_id, case when text is null then null {_CASE} when doc_id%90>66 then 'tundra' when doc_id%90>60 then 'taiga' else 'grassland' end as terrain, array_to_string(list_filter([{', '.join(chr(39).join(('case when regexp_matches(lower(text), ', '|'.join(w), ') then ', k, ' end')) for k, w in addresses.OBJECT_WORDS.items())}], lambda x: x is not null), ',') as objects from documents")
def address_terrain(spark, sf):
    d = spark.read.parquet(f"{sf}/documents.parquet")
    return d.select("doc_id", addresses.terrain_of_address(F.col("text"), F.col("doc_id") % 90).alias("terrain"), F.array_join(addresses.objects_of_address(F.col("text")), ",").alias("objects"))
