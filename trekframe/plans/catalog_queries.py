"""Queries of the feature catalogue, map sources and pair tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from trekframe.operators import catalog, features, lookups, stats
from trekframe.plans.analysis_queries import _L, _lpairs
from trekframe.plans.registry import ORACLES, query
from trekframe.plans.track_queries import _PIXELS, _pixels
from trekframe.sources.bridge import oracle, point_objects, track_points

_ROWS = ", ".join(
    [f"('{k}','{'discrete' if isinstance(v[0], int) else 'continuous'}',{float(v[0])}::double,{float(v[1])}::double)" for k, v in catalog.RANGES.items()]
    + [f"('{k}','categorical',null,null)" for k in catalog.CATEGORICAL]
    + [f"('{k}','binary',0.0,1.0)" for k in catalog.FLAGS]
)
_CATALOG = "c as (select f as feature, case split_part(f,'_',1) " + " ".join(f"when '{k}' then '{v}'" for k, v in catalog.GROUPS.items()) + f" end as category, d as data_type, a as low, b as high from (values {_ROWS}) t(f,d,a,b))"


@query(f"with {_CATALOG} select * from c")
def feature_catalog(spark, sf):
    return catalog.feature_catalog(spark)


@query(f"with {_CATALOG} select category, data_type, count(*) as n from c group by grouping sets ((category),(data_type),())")
def catalog_summary(spark, sf):
    return catalog.catalog_summary(spark)


@query(
    oracle(
        "v as (select 'G_latitude' as f, round(latitude,6) as v, 45.0 as a, 75.0 as b from track_points union all select 'G_longitude', round(longitude,6), 15.0, 180.0 from track_points union all select 'M_temperature', round(temperature,1), -60.0, 50.0 from track_points union all select 'TR_altitude', round(altitude,1), -500.0, 7000.0 from track_points union all select 'TJ_step_frequency', round(frequency_steps,4), 0.5, 3.0 from track_points) select f as feature, count(v) as n, count_if(v<a-0.01*(b-a) or v>b+0.01*(b-a)) as outside, round(count_if(v<a-0.01*(b-a) or v>b+0.01*(b-a))/count(v)::double,6) as share, round(count_if(v<a-0.01*(b-a) or v>b+0.01*(b-a))/count(v)::double,6)<=0.01 as ok from v group by f"
    )
)
def catalog_violations(spark, sf):
    p = track_points(spark, sf)
    c = F.col
    cols = features.geographic(c("latitude"), c("longitude"), F.lit(None).cast("string")) | features.meteorological(c("temperature")) | features.terrain(c("terrain_type"), c("altitude"), c("terrain_confidence")) | {"TJ_step_frequency": F.round("frequency_steps", 4)}
    names = ("G_latitude", "G_longitude", "M_temperature", "TR_altitude", "TJ_step_frequency")
    return catalog.range_violations(p.select(*[cols[k].alias(k) for k in names]))


@query(
    f"with {_PIXELS}, s as (select px, case when r>50 and r<100 and g>120 and g<150 and b>200 and b<255 then 'google_maps' when r>200 and r<255 and g>120 and g<170 and b>0 and b<50 then 'yandex_maps' when r>100 and r<200 and g>100 and g<200 and b>100 and b<200 then 'openstreetmap' end as source from px) select px, source, case source when 'openstreetmap' then 1/3.0::double when 'google_maps' then 2/3.0::double when 'yandex_maps' then 2/3.0::double else 0.0::double end as confidence from s"
)
def map_source_of_colours(spark, sf):
    return _pixels(spark, sf).select("px", features.map_source_of_colour(F.col("r"), F.col("g"), F.col("b")).alias("m")).select("px", "m.source", "m.confidence")


_SERVER = ("nginx/1.2", "gws", "YandexBot", "Apache and gse", "")
_TYPE = ("text/html", "tile from maps.google.com via api.yandex.ru", "image; openstreetmap", "yandex.ru tile")


def _headers():
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (F.col("page_id") % n + 1).cast("int"))
    return features.map_source_of_headers(pick(_SERVER, len(_SERVER)), pick(_TYPE, len(_TYPE)))


def _first(scores: str) -> str:
    return f"(select *, row_number() over (partition by page_id order by n desc, list_position({list(features.URL_SIGNS)!r}, src)) as k from ({scores}))"


_HEADER_SCORES = " union all ".join(
    f"select page_id, '{k}' as src, " + "+".join([f"contains(s, '{w}')::int" for w in a] + [f"contains(c, '{w}')::int" for w in b]) + " as n from h" for k, (a, b) in features.HEADER_SIGNS.items()
)
_HEADER_TABLE = f"h as (select page_id, lower({list(_SERVER)!r}[page_id%{len(_SERVER)}+1]) as s, lower({list(_TYPE)!r}[page_id%{len(_TYPE)}+1]) as c from pages)"
_HEADER_SQL = f"with {_HEADER_TABLE} select page_id, case when n>0 then src end as source, least(1.0, n/2.0)::double as confidence from {_first(_HEADER_SCORES)} where k=1"


@query(_HEADER_SQL)
def map_source_of_headers(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet")
    return p.select("page_id", _headers().alias("m")).select("page_id", "m.source", "m.confidence")


_EVERY = f"select page_id, src, coalesce(u.c,0.0)+coalesce(g.c,0.0)+coalesce(x.c,0.0) as n from pages cross join (select unnest({list(features.URL_SIGNS)!r}) as src) " + " ".join(f"left join (select page_id, source as src, confidence as c from ({q})) {a} using (page_id, src)" for a, q in (("u", ORACLES["map_source_of_urls"]), ("g", ORACLES["map_source_of_pages"]), ("x", _HEADER_SQL)))


@query(f"select page_id, case when n>0 then src end as source, least(1.0, n/3.0)::double as confidence from {_first(_EVERY)} where k=1")
def map_source_combined(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet")
    return p.select("page_id", features.combined_source(features.map_source_of_url(F.col("url")), features.map_source_of_html(F.col("html")), _headers()).alias("m")).select("page_id", "m.source", "m.confidence")


@query(oracle("select track_id, point_index, 'https://maps.example.org/1.x?ll='||cast(region_key as varchar)||','||cast(point_index as varchar)||'&z=13&size=450,450&l=map&apikey=' as url from track_points"))
def static_map_urls(spark, sf):
    p = track_points(spark, sf)
    return p.select("track_id", "point_index", features.static_map_url("https://maps.example.org/1.x", F.col("point_index"), F.col("region_key")).alias("url"))


@query(
    f"{_L}, s as (select * from p order by abs(r) desc, a, b limit 100), k as (select s.a as x, s.b as y, u.b as z from s join e u on u.a=s.a join e v on v.a=s.b and v.b=u.b where abs((s.r-u.r*v.r)/sqrt((1-u.r*u.r)*(1-v.r*v.r)))<0.1) select x, y, array_to_string(list(distinct z order by z), ',') as given from k group by 1,2"
)
def independence_statements(spark, sf):
    return stats.independence_statements(_lpairs(spark, sf)).select("x", "y", F.array_join("given", ",").alias("given"))


@query(f"{_L}, s as (select * from p where abs(r)>0.3 order by abs(r) desc, a, b limit 50) select s.a as x, s.b as y, u.b as z from s join e u on u.a=s.a and abs(u.r)>0.2 join e v on v.a=s.b and v.b=u.b and abs(v.r)>0.2")
def shared_neighbours(spark, sf):
    return stats.shared_neighbours(_lpairs(spark, sf))


@query(" union all ".join(f"select '{c}' as column_name, count(*) as n, count({c}) as known, count(*)-count({c}) as nulls, count(distinct {c}) as n_unique from orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")))
def table_profile(spark, sf):
    return stats.table_profile(spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"))


@query(oracle("select terrain_type, count(*) as n, round(100.0*count(*)/sum(count(*)) over (),4) as pct from track_points where terrain_type is not null group by 1"))
def terrain_shares(spark, sf):
    from pyspark.sql import Window

    c = track_points(spark, sf).where("terrain_type is not null").groupBy("terrain_type").agg(F.count("*").alias("n"))
    return c.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


@query(oracle("select p.track_id, p.event_id, arg_min(obj_type, struct_pack(d := distance_m, o := obj_type)) as nearest, min(distance_m) as distance_m from track_points p join point_objects using (track_id, event_id) group by 1,2"))
def nearest_objects(spark, sf):
    o = features.collect_objects(point_objects(spark, sf))
    return track_points(spark, sf).select("track_id", "event_id").join(o, ["track_id", "event_id"]).select("track_id", "event_id", F.col("objects")[0]["obj_type"].alias("nearest"), F.col("objects")[0]["distance_m"].alias("distance_m"))


@query(oracle("k as (select round(latitude,6) as lat6, round(longitude,6) as lon6, max(altitude) as dem from track_points where latitude is not null group by 1,2) select track_id, point_index, coalesce(altitude, dem) as altitude from track_points left join k on round(latitude,6)=lat6 and round(longitude,6)=lon6"))
def elevation_lookup(spark, sf):
    p = track_points(spark, sf)
    dem = p.where("latitude is not null").groupBy(F.round("latitude", 6).alias("lat6"), F.round("longitude", 6).alias("lon6")).agg(F.max("altitude").alias("dem"))
    return lookups.with_lookup(p, dem, ["dem"]).select("track_id", "point_index", F.coalesce("altitude", "dem").alias("altitude"))


@query(oracle("select count(*) as n, round(100.0*count(terrain_type)/count(*),4) as terrain_pct, round(100.0*count(temperature)/count(*),4) as temperature_pct, cast(sum(c) as bigint) as objects from track_points left join (select track_id, event_id, count(*) as c from point_objects group by 1,2) using (track_id, event_id)"))
def enrichment_coverage(spark, sf):
    n = point_objects(spark, sf).groupBy("track_id", "event_id").agg(F.count("*").alias("c"))
    p = track_points(spark, sf).join(n, ["track_id", "event_id"], "left")
    share = lambda c: F.round(100.0 * F.count(c) / F.count("*"), 4)
    return p.agg(F.count("*").alias("n"), share("terrain_type").alias("terrain_pct"), share("temperature").alias("temperature_pct"), F.sum("c").alias("objects"))


@query("select conv_id, turn, role, before from (select *, lag(role) over (partition by conv_id order by turn) as before, row_number() over (partition by conv_id order by turn) as k from conversations) where k>1 and role is distinct from before")
def role_transitions(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = spark.read.parquet(f"{sf}/conversations.parquet").withColumns({"before": F.lag("role").over(w), "k": F.row_number().over(w)})
    return rows.where((F.col("k") > 1) & ~F.col("role").eqNullSafe(F.col("before"))).select("conv_id", "turn", "role", "before")
