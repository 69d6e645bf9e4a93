"""Queries over track points: validation, windows, geodesy, features, fusion."""

from __future__ import annotations

from pyspark.sql import functions as F

from trekframe.functions import geo
from trekframe.operators import augment, features, fusion, quality, tracks
from trekframe.plans.registry import ORACLES, query
from trekframe.sources.bridge import oracle, point_objects, track_points

HAV = "(2*{r}*asin(sqrt(least(1.0, pow(sin((radians({lat2})-radians({lat1}))/2),2)+cos(radians({lat1}))*cos(radians({lat2}))*pow(sin((radians({lon2})-radians({lon1}))/2),2)))) + 0*({lat1}+{lon1}+{lat2}+{lon2}))"  # least() passes over null


def hav(lat1="latitude", lon1="longitude", lat2="nlat", lon2="nlon", r="6371000.0"):
    return HAV.format(lat1=lat1, lon1=lon1, lat2=lat2, lon2=lon2, r=r)


W = "window w as (partition by track_id order by point_index)"
LEAD = f"nxt as (select *, lead(latitude) over w as nlat, lead(longitude) over w as nlon, lead(event_ts) over w as nts, lead(date) over w as ndate, row_number() over w - 1 as pos from track_points {W})"


@query(oracle("select * from track_points"))
def scan_track_points(spark, sf):
    return track_points(spark, sf)


@query(oracle("select * from point_objects"))
def scan_point_objects(spark, sf):
    return point_objects(spark, sf)


@query(
    oracle("""select count(*) as total, count_if(not latitude between 45 and 72) as bad_latitude, count_if(not longitude between 15 and 180) as bad_longitude,
    count_if(not altitude between -100 and 6000) as bad_altitude, count_if(latitude is null or longitude is null) as missing_coordinates,
    count(*)-count_if(not latitude between 45 and 72)-count_if(not longitude between 15 and 180)-count_if(not altitude between -100 and 6000) as valid,
    round(100.0*(count(*)-count_if(not latitude between 45 and 72)-count_if(not longitude between 15 and 180)-count_if(not altitude between -100 and 6000))/count(*),4) as valid_pct from track_points""")
)
def validate_ranges(spark, sf):
    return quality.validity(track_points(spark, sf))


@query(
    oracle("""select track_id, point_index, unnest(list_filter([case when not latitude between 45 and 72 then 'latitude' end, case when not longitude between 15 and 180 then 'longitude' end,
    case when not altitude between -100 and 6000 then 'altitude' end, case when latitude is null or longitude is null then 'missing' end], lambda x: x is not null)) as violation from track_points""")
)
def range_violations(spark, sf):
    return quality.violations(track_points(spark, sf)).select("track_id", "point_index", F.explode("violations").alias("violation"))


_MISSING = ("latitude", "longitude", "altitude", "temperature", "terrain_type", "terrain_confidence", "frequency_steps")


@query(
    oracle(
        "select column_name, nulls, round(100.0*nulls/n,4) as pct, case when nulls=0 then 'none' when 100.0*nulls/n<5 then 'interpolate' when 100.0*nulls/n<20 then 'impute' else 'drop or model' end as strategy from ("
        + " union all ".join(f"select '{c}' as column_name, count(*) as n, count_if({c} is null) as nulls from track_points" for c in _MISSING)
        + ")"
    )
)
def missing_values(spark, sf):
    return quality.missing_values(track_points(spark, sf), list(_MISSING))


@query(oracle("select track_id, event_id, latitude, longitude, count(*) over (partition by track_id, latitude, longitude) > 1 as is_duplicate from track_points"))
def duplicate_coordinates(spark, sf):
    return quality.duplicates(track_points(spark, sf), ["track_id", "latitude", "longitude"]).select("track_id", "event_id", "latitude", "longitude", "is_duplicate")


@query("select event_id, event_type, user_id, count(*) over (partition by event_type, user_id) > 1 as is_duplicate from events")
def duplicate_events(spark, sf):
    return quality.duplicates(spark.read.parquet(f"{sf}/events.parquet"), ["event_type", "user_id"]).select("event_id", "event_type", "user_id", "is_duplicate")


@query(oracle("select track_id, point_index from track_points where latitude between -90 and 90 and longitude between -180 and 180 and (altitude is null or altitude between -500 and 9000)"))
def within_world(spark, sf):
    return quality.within_bounds(track_points(spark, sf)).select("track_id", "point_index")


@query(oracle("select track_id, bool_and(not coalesce(not latitude between 41 and 81 or not longitude between 19 and 169, false)) as ok, count_if(not latitude between 41 and 81 or not longitude between 19 and 169) as n_bad from track_points group by 1"))
def region_errors(spark, sf):
    return quality.region_errors(track_points(spark, sf))


@query(oracle("select track_id, count(*) as n, count(*)>=2 and count_if(latitude is null or longitude is null)=0 as ok from track_points group by 1"))
def tracks_valid(spark, sf):
    return quality.track_ok(track_points(spark, sf))


@query(oracle(f"select track_id, count_if(step>100) as warnings, max(step) as max_step from (select track_id, abs(altitude-lag(altitude) over w) as step from track_points {W}) group by 1"))
def elevation_warnings(spark, sf):
    return quality.elevation_warnings(track_points(spark, sf))


def _anomalies(hours):
    return oracle(f""", {LEAD}, d as (select track_id, pos, {hav()}/1000 as km, {hours} as hours from nxt)
    select track_id, pos as position, 'gps_noise' as anomaly_type, round(km,6) as km, round(hours,6) as hours from d where hours>0 and km<0.01
    union all select track_id, pos, 'excessive_speed', round(km,6), round(hours,6) from d where hours>0 and km/hours>50""")


@query(_anomalies("datediff('day', date, ndate)*24.0"))
def gps_anomalies_by_day(spark, sf):
    return tracks.gps_anomalies(track_points(spark, sf)).withColumns({"km": F.round("km", 6), "hours": F.round("hours", 6)})


@query(_anomalies("(epoch_us(nts)-epoch_us(event_ts))/1e6/3600"))
def gps_anomalies_by_time(spark, sf):
    return tracks.gps_anomalies(track_points(spark, sf), clock="time").withColumns({"km": F.round("km", 6), "hours": F.round("hours", 6)})


@query(oracle(f", {LEAD} select track_id, point_index, coalesce(sqrt(pow(nlat-latitude,2)+pow(nlon-longitude,2))<1e-4, false) as noise from nxt"))
def planar_noise(spark, sf):
    return tracks.planar_noise(track_points(spark, sf)).select("track_id", "point_index", "noise")


_FAST = f"coalesce((epoch_us(nts)-epoch_us(event_ts))>0 and {hav()}/((epoch_us(nts)-epoch_us(event_ts))/1e6)*3.6>50, false)"


@query(oracle(f", {LEAD} select track_id, point_index from nxt where {_FAST}"))
def speed_violations(spark, sf):
    return tracks.speed_violations(track_points(spark, sf)).where("violation").select("track_id", "point_index")


_INTERPOLATED = """, p as (select *, last_value(case when not bad then pos end ignore nulls) over (partition by track_id order by pos rows between unbounded preceding and 1 preceding) as pp,
  last_value(case when not bad then latitude end ignore nulls) over (partition by track_id order by pos rows between unbounded preceding and 1 preceding) as plat,
  last_value(case when not bad then longitude end ignore nulls) over (partition by track_id order by pos rows between unbounded preceding and 1 preceding) as plon,
  first_value(case when not bad then pos end ignore nulls) over (partition by track_id order by pos rows between 1 following and unbounded following) as np,
  first_value(case when not bad then latitude end ignore nulls) over (partition by track_id order by pos rows between 1 following and unbounded following) as nlat2,
  first_value(case when not bad then longitude end ignore nulls) over (partition by track_id order by pos rows between 1 following and unbounded following) as nlon2 from f)
  select track_id, point_index, round(case when bad and pp is not null and np is not null then plat+(pos-pp)/(np-pp)::double*(nlat2-plat) else latitude end,8) as latitude,
  round(case when bad and pp is not null and np is not null then plon+(pos-pp)/(np-pp)::double*(nlon2-plon) else longitude end,8) as longitude, bad and pp is not null and np is not null as is_fixed from p"""


@query(oracle(f", {LEAD}, f as (select *, latitude is null or longitude is null as bad from nxt) {_INTERPOLATED}"))
def interpolate_missing(spark, sf):
    rows = tracks.interpolate_linear(track_points(spark, sf), F.col("latitude").isNull() | F.col("longitude").isNull())
    return rows.select("track_id", "point_index", F.round("latitude", 8).alias("latitude"), F.round("longitude", 8).alias("longitude"), "is_fixed")


@query(oracle(f", {LEAD}, f as (select * exclude (pos), row_number() over (partition by track_id order by point_index) as pos, {_FAST} as bad from nxt where latitude is not null and longitude is not null) {_INTERPOLATED}"))
def correct_fast_points(spark, sf):
    points = tracks.speed_violations(track_points(spark, sf)).where("latitude is not null and longitude is not null")
    rows = tracks.interpolate_linear(points, F.col("violation"))
    return rows.select("track_id", "point_index", F.round("latitude", 8).alias("latitude"), F.round("longitude", 8).alias("longitude"), "is_fixed")


@query(oracle(f"select track_id, point_index from (select *, {hav('latitude', 'longitude', 'plat', 'plon')} as d from (select *, lag(latitude) over w as plat, lag(longitude) over w as plon from track_points {W})) where d<1"))
def close_points(spark, sf):
    return tracks.close_points(track_points(spark, sf)).where("close").select("track_id", "point_index")


@query()
def repair_by_spline(spark, sf):
    rows = tracks.interpolate_spline(track_points(spark, sf).drop("date", "event_ts"), F.col("latitude").isNull())
    return rows.select("track_id", "point_index", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"))


@query(
    oracle("""v as (select track_id, point_index, altitude, row_number() over (partition by track_id order by point_index) as k from track_points where altitude is not null),
    r as (select track_id, point_index, k, altitude as x, 1e-4::double as p from v where k=1 union all
    select v.track_id, v.point_index, v.k, r.x+(r.p+1e-5)/(r.p+1e-5+1e-4)*(v.altitude-r.x), (1-(r.p+1e-5)/(r.p+1e-5+1e-4))*(r.p+1e-5) from r join v on v.track_id=r.track_id and v.k=r.k+1)
    select track_id, point_index, round(x,6) as value from r""", recursive=True)
)
def kalman_altitude(spark, sf):
    return tracks.kalman(track_points(spark, sf), "altitude").withColumn("value", F.round("value", 6))


@query(
    oracle("""s as (select track_id, list(altitude order by point_index) as v, list(point_index order by point_index) as ix from track_points where altitude is not null group by 1),
    e as (select track_id, v, len(v) as n, unnest(range(1, len(v)+1)) as i, unnest(ix) as point_index from s)
    select track_id, point_index, round(case when n<5 then v[i] when i=1 then (31*v[1]+9*v[2]-3*v[3]-5*v[4]+3*v[5])/35 when i=2 then (9*v[1]+13*v[2]+12*v[3]+6*v[4]-5*v[5])/35
    when i=n then (31*v[n]+9*v[n-1]-3*v[n-2]-5*v[n-3]+3*v[n-4])/35 when i=n-1 then (9*v[n]+13*v[n-1]+12*v[n-2]+6*v[n-3]-5*v[n-4])/35
    else (-3*v[i-2]+12*v[i-1]+17*v[i]+12*v[i+1]-3*v[i+2])/35 end, 6) as value from e""")
)
def savitzky_golay_altitude(spark, sf):
    return tracks.savitzky_golay(track_points(spark, sf), "altitude").withColumn("value", F.round("value", 6))


@query(
    oracle("""s as (select track_id, list(altitude order by point_index) as v, list(point_index order by point_index) as ix from track_points where altitude is not null group by 1),
    e as (select track_id, v, len(v) as n, unnest(range(0, len(v))) as i, unnest(ix) as point_index from s),
    k as (select k, exp(-0.5*k*k)/sum(exp(-0.5*k*k)) over () as w from range(-4,5) t(k)),
    j as (select track_id, point_index, w, v, n, ((i+k)%(2*n)+2*n)%(2*n) as m from e cross join k)
    select track_id, point_index, round(sum(w*v[1+case when m<n then m else 2*n-1-m end]),6) as value from j group by 1,2""")
)
def gaussian_altitude(spark, sf):
    return tracks.gaussian_smooth(track_points(spark, sf), "altitude").withColumn("value", F.round("value", 6))


@query(
    oracle("""v as (select track_id, point_index, latitude, longitude, row_number() over (partition by track_id order by point_index) as k from track_points where latitude is not null and longitude is not null),
    r as (select track_id, point_index, k, latitude as la, longitude as lo, true as kept from v where k=1 union all
    select v.track_id, v.point_index, v.k, case when abs(v.latitude-la)>1e-6 or abs(v.longitude-lo)>1e-6 then v.latitude else la end, case when abs(v.latitude-la)>1e-6 or abs(v.longitude-lo)>1e-6 then v.longitude else lo end,
    abs(v.latitude-la)>1e-6 or abs(v.longitude-lo)>1e-6 from r join v on v.track_id=r.track_id and v.k=r.k+1)
    select track_id, point_index from r where kept""", recursive=True)
)
def drop_near_last_kept(spark, sf):
    return tracks.drop_near_last_kept(track_points(spark, sf))


@query(
    oracle(f""", {LEAD}, c as (select *, altitude - last_value(altitude ignore nulls) over (partition by track_id order by point_index rows between unbounded preceding and 1 preceding) as climb, {hav()} as m from nxt)
    select track_id, count(*) as n_points, round((epoch_us(max(event_ts))-epoch_us(min(event_ts)))/1e6,2) as duration_s, min(altitude) as min_altitude, max(altitude) as max_altitude,
    round(coalesce(sum(case when climb>0 then climb end),0.0),2) as gain_m, round(coalesce(-sum(case when climb<0 then climb end),0.0),2) as loss_m, round(coalesce(sum(m),0.0),2) as length_m,
    round(coalesce(sum(m),0.0)/((epoch_us(max(event_ts))-epoch_us(min(event_ts)))/1e6)*3.6,2) as mean_kmh from c group by 1 having count(*)>=2""")
)
def track_statistics(spark, sf):
    return tracks.statistics(track_points(spark, sf))


_F = repr(geo.FLATTENING)


def _vincenty_sql(steps: int) -> str:
    """Common tables v0 .. from nxt, and the last's metres in table lengths."""
    parts = """{k}a as (select *, sqrt(pow(cos(u2)*sin(lam),2)+pow(cos(u1)*sin(u2)-sin(u1)*cos(u2)*cos(lam),2)) as ss, sin(u1)*sin(u2)+cos(u1)*cos(u2)*cos(lam) as cs from {k}),
    {k}b as (select *, atan2(ss,cs) as s, case when ss=0 then 0.0 else cos(u1)*cos(u2)*sin(lam)/ss end as sa from {k}a), {k}c as (select *, 1-sa*sa as c2, case when 1-sa*sa=0 then 0.0 else cs-2*sin(u1)*sin(u2)/(1-sa*sa) end as m from {k}b)"""
    out = f"v0 as (select track_id, atan((1-{_F}::double)*tan(radians(latitude))) as u1, atan((1-{_F}::double)*tan(radians(nlat))) as u2, radians(nlon)-radians(longitude) as away, radians(nlon)-radians(longitude) as lam from nxt where latitude is not null and longitude is not null and nlat is not null and nlon is not null)"
    for k in range(steps):
        out += ", " + parts.format(k=f"v{k}") + f", v{k + 1} as (select track_id, u1, u2, away, away+(1-c)*{_F}::double*sa*(s+c*ss*(m+c*cs*(2*m*m-1))) as lam from (select *, {_F}::double/16*c2*(4+{_F}::double*(4-3*c2)) as c from v{k}c))"
    k = f"v{steps}"
    ratio = repr((geo.R_EQUATOR**2 - geo.POLAR**2) / geo.POLAR**2)
    return out + ", " + parts.format(k=k) + f""", ab as (select *, 1+w/16384*(4096+w*(-768+w*(320-175*w))) as a, w/1024*(256+w*(-128+w*(74-47*w))) as b from (select *, c2*{ratio}::double as w from {k}c)),
    lengths as (select track_id, {geo.POLAR!r}::double*a*(s-b*ss*(m+b/4*(cs*(2*m*m-1)-b/6*m*(4*ss*ss-3)*(4*m*m-3)))) as d from ab)"""


def _direct_sql(source: str, out: str) -> str:
    """Common tables that move source's (rlat, rlon, az, dist) along the ellipsoid: out has its columns with mlat and mlon."""
    ratio = repr((geo.R_EQUATOR**2 - geo.POLAR**2) / geo.POLAR**2)
    sql = f"""{out}0 as (select *, radians(az) as a1, (1-{_F}::double)*tan(radians(rlat)) as tu from {source}), {out}1 as (select *, 1/sqrt(1+tu*tu) as cu, atan2(tu, cos(a1)) as s1 from {out}0), {out}2 as (select *, tu*cu as su, cu*sin(a1) as sa from {out}1),
    {out}3 as (select *, 1-sa*sa as c2, (1-sa*sa)*{ratio}::double as w from {out}2), {out}4 as (select *, dist/({geo.POLAR!r}::double*(1+w/16384*(4096+w*(-768+w*(320-175*w))))) as base, w/1024*(256+w*(-128+w*(74-47*w))) as bb from {out}3), {out}s0 as (select *, base as s from {out}4)"""
    for k in range(8):
        sql += f", {out}s{k + 1} as (select * replace (base+bb*sin(s)*(m+bb/4*(cos(s)*(2*m*m-1)-bb/6*m*(4*sin(s)*sin(s)-3)*(4*m*m-3))) as s) from (select * exclude (m), cos(2*s1+s) as m from (select *, 0 as m from {out}s{k})))".replace("* exclude (m), cos", "* exclude (m), cos")
    return sql.replace("(select * replace (base", "(select * exclude (m) replace (base") + f""", {out}e as (select *, cos(2*s1+s) as m, su*sin(s)-cu*cos(s)*cos(a1) as t, {_F}::double/16*c2*(4+{_F}::double*(4-3*c2)) as c from {out}s8),
    {out} as (select *, degrees(atan2(su*cos(s)+cu*sin(s)*cos(a1), (1-{_F}::double)*sqrt(sa*sa+t*t))) as mlat, degrees(radians(rlon)+atan2(sin(s)*sin(a1), cu*cos(s)-su*sin(s)*cos(a1))-(1-c)*{_F}::double*sa*(s+c*sin(s)*(m+c*cos(s)*(2*m*m-1)))) as mlon from {out}e)"""


@query(oracle(f", {LEAD}, {_vincenty_sql(12)} select track_id, count(*) as n_segments, round(sum(d),3) as total_m, round(avg(d),3) as mean_m, round(max(d),3) as max_m, round(min(d),3) as min_m from lengths group by 1"))
def segment_statistics(spark, sf):
    return tracks.segment_statistics(track_points(spark, sf))


@query(
    oracle(f"""select track_id, sum(greatest(climb,0.0)) as gain, sum(greatest(-climb,0.0)) as loss, round(max(case when d>0 then degrees(atan(abs(climb)/d)) end),4) as max_slope
    from (select track_id, altitude-palt as climb, {hav('latitude', 'longitude', 'plat', 'plon', '6378137.0')} as d from (select *, lag(latitude) over w as plat, lag(longitude) over w as plon, lag(altitude) over w as palt from track_points {W})) where climb is not null group by 1""")
)
def track_slopes(spark, sf):
    return tracks.slopes(track_points(spark, sf))


@query(oracle(f"select track_id, point_index, terrain_type as value from (select *, lag(terrain_type) over w as before, row_number() over w as k from track_points {W}) where k>1 and terrain_type is distinct from before"))
def terrain_transitions(spark, sf):
    return tracks.transitions(track_points(spark, sf))


@query(oracle(f"select track_id, point_index, case when k=1 then 1.4 when d>0 then 1/0.7::double else 0.0 end as steps from (select *, {hav('latitude', 'longitude', 'plat', 'plon')} as d from (select *, lag(latitude) over w as plat, lag(longitude) over w as plon, row_number() over w as k from track_points {W}))"))
def step_frequency(spark, sf):
    return tracks.step_frequency(track_points(spark, sf)).select("track_id", "point_index", "steps")


@query(
    oracle("""m as (select track_id, avg(cos(radians(latitude))*cos(radians(longitude))) as x, avg(cos(radians(latitude))*sin(radians(longitude))) as y, avg(sin(radians(latitude))) as z, avg(altitude) as altitude from track_points group by 1)
    select track_id, round(degrees(atan2(z, sqrt(x*x+y*y))),6) as latitude, round(degrees(atan2(y,x)),6) as longitude, round(altitude,6) as altitude from m""")
)
def track_centroids(spark, sf):
    return tracks.centroid(track_points(spark, sf)).select("track_id", *[F.round(c, 6).alias(c) for c in ("latitude", "longitude", "altitude")])


@query(oracle("select track_id, min(latitude) as lat_min, max(latitude) as lat_max, min(longitude) as lon_min, max(longitude) as lon_max, round(avg(latitude),6) as lat_mean, round(avg(longitude),6) as lon_mean, count(*) as n, round(1/cos(radians(avg(latitude))),6) as distortion from track_points group by 1"))
def track_extents(spark, sf):
    return tracks.extent(track_points(spark, sf))


_DENSIFIED = oracle("""k as (select *, lead(latitude) over w as nlat, lead(longitude) over w as nlon from track_points where latitude is not null and longitude is not null window w as (partition by track_id order by point_index)),
    g as (select *, 2*asin(sqrt(least(1.0,pow(sin((radians(nlat)-radians(latitude))/2),2)+cos(radians(latitude))*cos(radians(nlat))*pow(sin((radians(nlon)-radians(longitude))/2),2)))) as sg from k),
    i as (select *, unnest(range(0, case when nlat is null or sg<1e-6 then 1 else 9 end)) as k, nlat is null or sg<1e-6 as flat from g), f as (select *, sin((1-k/9.0::double)*sg)/sin(sg) as a, sin(k/9.0::double*sg)/sin(sg) as b from i),
    x as (select *, a*cos(radians(latitude))*cos(radians(longitude))+b*cos(radians(nlat))*cos(radians(nlon)) as x, a*cos(radians(latitude))*sin(radians(longitude))+b*cos(radians(nlat))*sin(radians(nlon)) as y, a*sin(radians(latitude))+b*sin(radians(nlat)) as z from f)
    select track_id, point_index, k, round(case when flat then latitude else degrees(atan2(z, sqrt(x*x+y*y))) end, 7) as latitude, round(case when flat then longitude else degrees(atan2(y,x)) end, 7) as longitude from x""")


def _densified(spark, sf):
    return tracks.densify(track_points(spark, sf)).select("track_id", "point_index", F.col("k").cast("long").alias("k"), F.round("latitude", 7).alias("latitude"), F.round("longitude", 7).alias("longitude"))


@query(_DENSIFIED)
def densified_positions(spark, sf):
    return _densified(spark, sf)


@query(_DENSIFIED)
def densified_tracks(spark, sf):
    return _densified(spark, sf)


# ---- geodesy on single points

_R = 6378137.0


@query(
    oracle(f"""select track_id, point_index, round({_R}*radians(longitude),3) as x, round({_R}*ln(tan(pi()/4+radians(latitude)/2)),3) as y, cast(floor((longitude+180)/6)+1 as int) as zone,
    round(pi()/180*6371000*cos(radians(latitude)),4) as metres_lon from track_points where latitude is not null""")
)
def mercator_points(spark, sf):
    p = track_points(spark, sf).where("latitude is not null")
    m = geo.web_mercator(F.col("latitude"), F.col("longitude"))
    return p.select("track_id", "point_index", F.round(m["x"], 3).alias("x"), F.round(m["y"], 3).alias("y"), geo.utm_zone(F.col("longitude")).alias("zone"), F.round(geo.metres_per_degree_longitude(F.col("latitude")), 4).alias("metres_lon"))


@query(oracle("select track_id, point_index, round(latitude,6) as latitude, round(longitude,6) as longitude from track_points where latitude is not null"))
def mercator_round_trip(spark, sf):
    p = track_points(spark, sf).where("latitude is not null")
    m = geo.web_mercator(F.col("latitude"), F.col("longitude"))
    back = geo.from_web_mercator(m["x"], m["y"])
    return p.select("track_id", "point_index", F.round(back["latitude"], 6).alias("latitude"), F.round(back["longitude"], 6).alias("longitude"))


@query(oracle("select track_id, point_index, round(latitude,6) as latitude, round(longitude,6) as longitude, cast(32600+floor((longitude+180)/6)+1 as int) as epsg from track_points where latitude is not null"))
def utm_round_trip(spark, sf):
    p = track_points(spark, sf).where("latitude is not null").withColumn("u", geo.utm(F.col("latitude"), F.col("longitude")))
    back = geo.from_utm(F.col("u.easting"), F.col("u.northing"), F.col("u.zone"), F.lit(True))
    return p.withColumn("b", back).select("track_id", "point_index", F.round("b.latitude", 6).alias("latitude"), F.round("b.longitude", 6).alias("longitude"), F.col("u.epsg").alias("epsg"))


@query(
    oracle(f""", {LEAD} select track_id, point_index, round({hav()},3) as metres, round(((degrees(atan2(sin(radians(nlon)-radians(longitude))*cos(radians(nlat)), cos(radians(latitude))*sin(radians(nlat))-sin(radians(latitude))*cos(radians(nlat))*cos(radians(nlon)-radians(longitude))))+360)%360),5) as bearing
    from nxt where nlat is not null and latitude is not null""")
)
def distances_and_bearings(spark, sf):
    w = tracks.in_order()
    p = track_points(spark, sf).withColumns({"nlat": F.lead("latitude").over(w), "nlon": F.lead("longitude").over(w)}).where("nlat is not null and latitude is not null")
    c = [F.col(x) for x in ("latitude", "longitude", "nlat", "nlon")]
    return p.select("track_id", "point_index", F.round(geo.haversine(*c), 3).alias("metres"), F.round(geo.bearing(*c), 5).alias("bearing"))


@query(
    oracle("""d as (select *, 1000.0/6371000 as a, radians(latitude) as p from track_points where latitude is not null), e as (select *, asin(sin(p)*cos(a)+cos(p)*sin(a)*cos(radians(90))) as q from d)
    select track_id, point_index, round(degrees(q),8) as latitude, round(longitude+degrees(atan2(sin(radians(90))*sin(a)*cos(p), cos(a)-sin(p)*sin(q))),8) as longitude from e""")
)
def destinations(spark, sf):
    p = track_points(spark, sf).where("latitude is not null").withColumn("d", geo.destination(F.col("latitude"), F.col("longitude"), F.lit(90.0), F.lit(1000.0)))
    return p.select("track_id", "point_index", F.round("d.latitude", 8).alias("latitude"), F.round("d.longitude", 8).alias("longitude"))


# ---- features


@query(
    oracle("""select track_id, point_index, month(date) as "T_month", case when month(date) in (12,1,2) then 'winter' when month(date)<=5 then 'spring' when month(date)<=8 then 'summer' else 'autumn' end as "T_season",
    isodow(date)-1 as "T_day_of_week", dayofyear(date) as "T_day_of_year", year(date) as "T_year", cast(month(date) in (12,1,2) as int) as "T_is_winter", cast(month(date) between 6 and 8 as int) as "T_is_expedition_month", quarter(date) as "T_quarter" from track_points""")
)
def temporal_features(spark, sf):
    return track_points(spark, sf).select("track_id", "point_index", *[v.alias(k) for k, v in features.temporal(F.col("date")).items()])


@query(
    oracle("""select track_id, point_index, round(latitude,6) as "G_latitude", round(longitude,6) as "G_longitude", coalesce(r_name,'Unknown') as "G_region", case when latitude<55 then 'southern' when latitude<60 then 'middle' when latitude>=60 then 'northern' end as "G_latitude_band",
    case when longitude<70 then 'western' else 'eastern' end as "G_longitude_band", cast(floor((longitude+180)/6)+1 as int) as "G_utm_zone", round((90-latitude)*111.32,2) as "G_distance_to_pole_km", round(sin(radians(latitude)),4) as "G_latitude_sin", round(sin(radians(longitude)),4) as "G_longitude_sin"
    from track_points left join region on region_key=r_regionkey""")
)
def geographic_features(spark, sf):
    p = track_points(spark, sf).join(spark.read.parquet(f"{sf}/region.parquet").withColumnRenamed("r_regionkey", "region_key"), "region_key", "left")
    return p.select("track_id", "point_index", *[v.alias(k) for k, v in features.geographic(F.col("latitude"), F.col("longitude"), F.col("r_name")).items()])


@query(
    oracle("""select track_id, point_index, round(temperature,1) as "M_temperature", case when temperature<-15 then 'very_cold' when temperature<-5 then 'cold' when temperature<5 then 'cool' when temperature<15 then 'warm' when temperature>=15 then 'hot' end as "M_temperature_class",
    cast(temperature<-5 as int) as "M_is_cold", cast(temperature<0 as int) as "M_is_freezing", cast(temperature>20 as int) as "M_is_hot" from track_points""")
)
def weather_features(spark, sf):
    return track_points(spark, sf).select("track_id", "point_index", *[v.alias(k) for k, v in features.meteorological(F.col("temperature")).items()])


@query(
    oracle("""select track_id, point_index, terrain_type as "TR_terrain_type", round(altitude,1) as "TR_altitude", case when altitude<500 then 'lowland' when altitude<2000 then 'midland' when altitude<5000 then 'highland' when altitude>=5000 then 'alpine' end as "TR_altitude_class",
    case when terrain_confidence<>0 then round(terrain_confidence,2) end as "TR_terrain_confidence", coalesce(cast(terrain_type in ('forest','taiga') as int),0) as "TR_is_forest", coalesce(cast(terrain_type='river' as int),0) as "TR_is_water",
    coalesce(cast(terrain_type='meadow' as int),0) as "TR_is_open", coalesce(cast(terrain_type='rocks' as int),0) as "TR_is_mountain", coalesce(cast(terrain_type='village' as int),0) as "TR_is_urban" from track_points""")
)
def terrain_features(spark, sf):
    return track_points(spark, sf).select("track_id", "point_index", *[v.alias(k) for k, v in features.terrain(F.col("terrain_type"), F.col("altitude"), F.col("terrain_confidence")).items()])


@query(
    oracle("""o as (select track_id, event_id, count(*) as n, count_if(distance_m<>0 and obj_type='shelter') as s, count_if(distance_m<>0 and obj_type='river') as w, count_if(distance_m<>0 and obj_type='peak') as l, min(case when distance_m<>0 then distance_m end) as d from point_objects group by 1,2)
    select track_id, point_index, coalesce(n,0) as "OBJ_count_nearby", coalesce(s,0) as "OBJ_shelter_count", coalesce(w,0) as "OBJ_water_count", coalesce(l,0) as "OBJ_landmark_count", cast(coalesce(s,0)>0 as int) as "OBJ_has_shelter", cast(coalesce(w,0)>0 as int) as "OBJ_has_water",
    cast(coalesce(l,0)>0 as int) as "OBJ_has_landmark", round(d,1) as "OBJ_nearest_distance_m", round(coalesce(n,0)/(pi()*0.25),2) as "OBJ_poi_density_per_km2" from track_points left join o using (track_id, event_id)""")
)
def surrounding_features(spark, sf):
    p = track_points(spark, sf).join(features.collect_objects(point_objects(spark, sf)), ["track_id", "event_id"], "left")
    return p.select("track_id", "point_index", *[v.alias(k) for k, v in features.surroundings(F.col("objects")).items()])


@query(
    oracle("""c as (select track_id, case when altitude>500 then 'mountain' when latitude>40 and latitude<60 then 'forest' else 'grassland' end as cls, count(*) as n, min(point_index) as f from track_points group by 1,2),
    b as (select *, row_number() over (partition by track_id order by n desc, f) as r, sum(n) over (partition by track_id) as total from c) select track_id, cls as dominant, n as n_dominant, cast(total as bigint) as total from b where r=1""")
)
def dominant_terrain(spark, sf):
    return features.classify_tracks(track_points(spark, sf))


@query(
    oracle("""m as (select *, month(date) as mo, month(date) in (12,1,2) as wi from track_points where latitude is not null)
    select track_id, point_index, round(case when latitude>66 then case when wi then -15.0 else -2.0 end when latitude>60 then case when wi then -8.0 else 12.0 end when latitude>45 then case when wi then -2.0 else 18.0 end else case when wi then 20.0 else 28.0 end end + (((longitude%30)+30)%30)/30*4.0-2.0, 6) as temperature,
    case when latitude>66 then 75 when latitude>60 then 70 when latitude>45 then 65 when mo between 6 and 8 then 70 else 55 end as humidity, 1013.0::double as pressure, case when latitude>66 then 6.0 when latitude>60 then 4.5 when latitude>45 then 3.5 else 2.5 end::double as wind_speed,
    case when latitude>66 then case when wi then '13d' else '01d' end when latitude>60 then case when wi then '13d' else '04d' end when latitude>45 then case when wi or mo=11 then '10d' else '04d' end else '01d' end as weather_code,
    case case when latitude>66 then case when wi then '13d' else '01d' end when latitude>60 then case when wi then '13d' else '04d' end when latitude>45 then case when wi or mo=11 then '10d' else '04d' end else '01d' end when '13d' then 'Snowy day' when '01d' then 'Sunny day' when '04d' then 'Overcast day' else 'Rainy day' end as weather_description,
    0.45::double as confidence from m""")
)
def estimated_weather(spark, sf):
    p = track_points(spark, sf).where("latitude is not null")
    w = features.estimated_weather(F.col("latitude"), F.col("longitude"), F.month("date"))
    return p.select("track_id", "point_index", *[(F.round(v, 6) if k == "temperature" else v).alias(k) for k, v in w.items()])


@query(oracle("select track_id, point_index, md5(concat_ws('|','geocode',printf('%.6f',latitude),printf('%.6f',longitude))) as geo_key, md5(concat_ws('|','weather',printf('%.6f',latitude),printf('%.6f',longitude),cast(date as varchar))) as weather_key from track_points where latitude is not null"))
def cache_keys(spark, sf):
    p = track_points(spark, sf).where("latitude is not null")
    c = F.col("latitude"), F.col("longitude")
    return p.select("track_id", "point_index", features.cache_key("geocode", *c).alias("geo_key"), features.cache_key("weather", *c, F.col("date")).alias("weather_key"))


@query(
    oracle("""select track_id, point_index, round(least(1.0, case when terrain_type is not null then 1.0 else 0.8 end + least(0.15, n*0.03) + case when r_name is not null then 0.05 else 0 end + case when temperature<>0 then 0.05 else 0 end), 6)::double as quality
    from track_points left join (select track_id, event_id, count(*) as c from point_objects group by 1,2) o using (track_id, event_id) left join region on region_key=r_regionkey cross join lateral (select coalesce(c,0) as n)""")
)
def enrichment_quality(spark, sf):
    n = point_objects(spark, sf).groupBy("track_id", "event_id").agg(F.count("*").alias("c"))
    p = track_points(spark, sf).join(n, ["track_id", "event_id"], "left").join(spark.read.parquet(f"{sf}/region.parquet").withColumnRenamed("r_regionkey", "region_key"), "region_key", "left")
    return p.select("track_id", "point_index", F.round(features.quality_score(F.col("terrain_type").isNotNull(), F.coalesce("c", F.lit(0)), F.col("r_name"), F.col("temperature")), 6).alias("quality"))


def _pixels(spark, sf):
    e = spark.read.parquet(f"{sf}/events.parquet")
    return e.select((F.col("event_id") % 20).alias("img"), F.col("event_id").alias("px"), *[((F.col("event_id") * k) % 256).cast("int").alias(c) for c, k in (("r", 37), ("g", 91), ("b", 53))])


_PIXELS = "px as (select event_id%20 as img, event_id as px, cast((event_id*37)%256 as int) as r, cast((event_id*91)%256 as int) as g, cast((event_id*53)%256 as int) as b from events)"
_RGB = """case when g>r and g>b then case when g>200 and r<100 and b<100 then 'grassland' when g>150 and r>80 and b<100 then 'forest' else 'meadow' end when b>r and b>g then 'water' when r>200 and g>200 and b>200 then 'glacier'
 when r>g and r>b and g<150 and b<150 then 'road_asphalt' when r=g and g=b then 'rocks' else 'unknown' end"""
_CONF = "case t when 'grassland' then 0.85 when 'forest' then 0.9 when 'meadow' then 0.75 when 'water' then 0.95 when 'glacier' then 0.8 when 'road_asphalt' then 0.7 when 'rocks' then 0.75 else 0.3 end::double"


@query(f"with {_PIXELS}, c as (select *, {_RGB} as t from px) select px, t as terrain, {_CONF} as confidence from c")
def pixel_terrain(spark, sf):
    return _pixels(spark, sf).withColumn("t", features.rgb_terrain(F.col("r"), F.col("g"), F.col("b"))).select("px", "t.terrain", "t.confidence")


@query(
    f"""with {_PIXELS}, c as (select *, {_RGB} as t from px), v as (select img, t, sum({_CONF}) as s from c group by 1,2), b as (select *, sum(s) over (partition by img) as total, row_number() over (partition by img order by s desc, t desc) as k from v),
    m as (select img, cast(sum(r)//count(*) as int) as mean_r, cast(sum(g)//count(*) as int) as mean_g, cast(sum(b)//count(*) as int) as mean_b from px group by 1) select img, t as terrain, round(s/total,6) as confidence, mean_r, mean_g, mean_b from b join m using (img) where k=1"""
)
def image_terrain(spark, sf):
    return features.region_colours(_pixels(spark, sf))


@query(f"with {_PIXELS} select img, px, cast(least(255,floor(r*1.2)) as int) as r, cast(least(255,floor(g*1.2)) as int) as g, cast(least(255,floor(b*1.2)) as int) as b from px")
def brighter_pixels(spark, sf):
    return augment.brightness(_pixels(spark, sf), 1.2)


@query(f"with {_PIXELS}, y as (select *, floor((r*299+g*587+b*114)/1000.0) as l from px) select img, px, " + ", ".join(f"cast(greatest(0,least(255,floor(l+1.1*({c}-l)))) as int) as {c}" for c in "rgb") + " from y")
def saturated_pixels(spark, sf):
    return augment.saturation(_pixels(spark, sf), 1.1)


@query(f"with {_PIXELS}, y as (select *, floor(avg(floor((r*299+g*587+b*114)/1000.0)) over (partition by img)+0.5) as l from px) select img, px, " + ", ".join(f"cast(greatest(0,least(255,floor(l+0.9*({c}-l)))) as int) as {c}" for c in "rgb") + " from y")
def flatter_pixels(spark, sf):
    return augment.contrast(_pixels(spark, sf), 0.9)


@query(f"with {_PIXELS} select img, px, " + ", ".join(f"cast(least(255,floor({c}*(1-60/255.0::double)+255*(60/255.0::double)+0.5)) as int) as {c}" for c in "rgb") + " from px")
def foggy_pixels(spark, sf):
    return augment.fog(_pixels(spark, sf), 0.3)


def _votes(spark, sf):
    p = track_points(spark, sf)
    kind = lambda k: F.when(F.col("event_id") % k == 0, None).when(F.col("event_id") % (k + 2) < 3, "forest").otherwise("meadow")
    return p.select("track_id", "point_index", fusion.votes(kind(5), (F.col("event_id") % 10) / 10.0, F.col("terrain_type"), kind(7), (F.col("event_id") % 9) / 10.0).alias("v"))


_VOTES = """v as (select track_id, point_index, case when event_id%5=0 then null when event_id%7<3 then 'forest' else 'meadow' end as o, (event_id%10)/10.0::double as oc, terrain_type as c, 0.9::double as cc,
  case when event_id%7=0 then null when event_id%9<3 then 'forest' else 'meadow' end as s, (event_id%9)/10.0::double as sc from track_points),
  n as (select *, (o is not null)::int+(c is not null)::int+(s is not null)::int as k, len(list_distinct([o,c,s])) as d, case when o=c or o=s then o when c=s then c end as maj,
  coalesce(case when o=c or o=s then oc end,0)*(o is not null)::int+coalesce(case when c=o or c=s then cc end,0)+coalesce(case when s=o or s=c then sc end,0) as ms, coalesce((o=c or o=s)::int,0)+coalesce((c=o or c=s)::int,0)+coalesce((s=o or s=c)::int,0) as mn,
  greatest(case when o is not null then oc end, case when c is not null then cc end, case when s is not null then sc end) as topc from v),
  t as (select *, case when o is not null and oc=topc then o when c is not null and cc=topc then c else s end as topk from n)"""


@query(
    oracle(
        f"""{_VOTES} select track_id, point_index, case when k=0 then 'unknown' when maj is not null then maj else topk end as terrain, round(case when k=0 then 0.0 when maj is not null then ms/mn else topc end,6) as confidence,
    case when k=0 then 'none' when k=1 then 'single' when d=1 then 'unanimous' when maj is not null then 'majority' else 'highest_confidence' end as method, case when d<2 then 'none' when d=2 and maj is not null then 'minor' else 'major' end as conflict from t"""
    )
)
def fused_terrain(spark, sf):
    r = _votes(spark, sf).withColumn("r", fusion.resolve(F.col("v")))
    return r.select("track_id", "point_index", "r.result.terrain", F.round("r.result.confidence", 6).alias("confidence"), "r.result.method", "r.conflict")


@query(
    oracle(
        f"""{_VOTES} select track_id, point_index, case when k=0 then 'unknown' when d=1 then coalesce(o,c,s) else coalesce(c,topk) end as csv, case when k=0 then 'unknown' when d=1 then coalesce(o,c,s) else coalesce(o,topk) end as osm,
    case when k=0 then 'unknown' when d=1 then coalesce(o,c,s) else topk end as confidence, case when k=0 then 'unknown' when d=1 then coalesce(o,c,s) else coalesce(maj,topk) end as average from t"""
    )
)
def fused_terrain_by_source(spark, sf):
    rows = _votes(spark, sf)
    return rows.select("track_id", "point_index", *[fusion.resolve(F.col("v"), s)["result"]["terrain"].alias(s) for s in ("csv", "osm", "confidence", "average")])


@query(oracle(f"{_VOTES} select c as csv, o as osm, count(*) as n from t where c is not null and o is not null and c<>o group by 1,2"))
def terrain_conflicts(spark, sf):
    one = lambda s: F.get(F.filter("v", lambda x: x["source"] == s), F.lit(0))["terrain"]
    return _votes(spark, sf).select(one("csv").alias("csv"), one("osm").alias("osm")).where("csv <> osm").groupBy("csv", "osm").agg(F.count("*").alias("n"))


@query(
    "with s as (select page_id, 'google_maps' as src, "
    + "+".join(f"regexp_matches(lower(url), '{p}')::int" for p in features.URL_SIGNS["google_maps"])
    + " as n from pages "
    + " ".join(f"union all select page_id, '{k}', " + "+".join(f"regexp_matches(lower(url), '{p}')::int" for p in v) + " from pages" for k, v in features.URL_SIGNS.items() if k != "google_maps")
    + "), b as (select *, row_number() over (partition by page_id order by n desc, list_position(['google_maps','yandex_maps','openstreetmap','stamen_terrain'], src)) as k from s) select page_id, case when n>0 then src end as source, least(1.0, n/3.0)::double as confidence from b where k=1"
)
def map_source_of_urls(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet")
    return p.select("page_id", features.map_source_of_url(F.col("url")).alias("m")).select("page_id", "m.source", "m.confidence")


@query(
    "with s as (select page_id, 'google_maps' as src, "
    + "+".join(f"((length(lower(html))-length(replace(lower(html), '{p}', '')))//{len(p)})" for p in features.PAGE_SIGNS["google_maps"])
    + " as n from pages "
    + " ".join(f"union all select page_id, '{k}', " + "+".join(f"((length(lower(html))-length(replace(lower(html), '{p}', '')))//{len(p)})" for p in v) + " from pages" for k, v in features.PAGE_SIGNS.items() if k != "google_maps")
    + "), b as (select *, row_number() over (partition by page_id order by n desc, list_position(['google_maps','yandex_maps','openstreetmap','stamen_terrain'], src)) as k from s) select page_id, case when n>0 then src end as source, least(1.0, n/5.0)::double as confidence from b where k=1"
)
def map_source_of_pages(spark, sf):
    p = spark.read.parquet(f"{sf}/pages.parquet")
    return p.select("page_id", features.map_source_of_html(F.col("html")).alias("m")).select("page_id", "m.source", "m.confidence")


_GROUPS = ("temporal_features", "geographic_features", "weather_features", "terrain_features", "surrounding_features")


def _record_sql() -> str:
    """The five groups' SQL side by side, the step frequency and the share of known features."""
    joined = f"({ORACLES[_GROUPS[0]]}) g0" + "".join(f" join ({ORACLES[g]}) g{i} using (track_id, point_index)" for i, g in enumerate(_GROUPS) if i)
    steps = oracle('select track_id, point_index, round(frequency_steps,4) as "TJ_step_frequency" from track_points')
    text = "t as (select track_id, point_index, columns(* exclude (track_id, point_index))::varchar from r)"
    known = "k as (select track_id, point_index, count(v) as known, count(*) as n from t unpivot include nulls (v for f in (columns(* exclude (track_id, point_index)))) group by 1, 2)"
    return f'with r as (select * from {joined} join ({steps}) s using (track_id, point_index)), {text}, {known} select r.*, round(known/n::double,3) as "Q_data_completeness" from r join k using (track_id, point_index)'


@query(_record_sql())
def feature_records(spark, sf):
    return features.feature_record(track_points(spark, sf), point_objects(spark, sf), spark.read.parquet(f"{sf}/region.parquet"))
