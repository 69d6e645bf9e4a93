"""Queries of look-ups over landed responses; the responses are made from the track points, one set of attempts a track and day."""

from __future__ import annotations

import uuid

from pyspark.sql import Observation
from pyspark.sql import functions as F

from trekframe.operators import connectors
from trekframe.plans.registry import query
from trekframe.sources import responses
from trekframe.sources.bridge import oracle, track_points
from trekframe.sources.shared import scratch

_SERVICES = ["first_service", "second_service"]
#: Keys, and what the services answer: by e, the key's smallest event, all attempts fail, the second or third answers, the line is broken, or nothing landed.
_KEYS = "select track_id || '|' || cast(date as varchar(10)) as key, min(event_id) as e from track_points group by 1"
_TRIES = """select key, e, s.service, a.attempt, case when (e + s.shift) % 5 = 0 then 429 when (e + s.shift) % 5 = 1 and a.attempt < 2 then 500 when (e + s.shift) % 5 = 2 and a.attempt < 3 then 429 else 200 end as status
    from k cross join (select 'first_service' as service, 0 as shift union all select 'second_service', 3) s cross join (select 1 as attempt union all select 2 union all select 3 union all select 4) a
    where (e + s.shift) % 11 <> 7"""
_BODY = """'{"main":{"temp":' || cast(e % 40 as varchar(5)) || '.5' || case when e % 3 = 0 then '}}' else ',"humidity":' || cast(e % 100 as varchar(5)) || '},"weather":[{"main":"Clouds","description":"layer ' || cast(e % 7 as varchar(5)) || '"}],"wind":{"speed":' || cast(e % 9 as varchar(5)) || '}}' end"""


def _landed(spark, sf):
    """Responses landed from the track points, read back, and the keys."""
    keys = spark.sql(_KEYS.replace("from track_points", "from {p}"), p=track_points(spark, sf))
    rows = spark.sql(_TRIES.replace("from k ", "from {k} "), k=keys)
    answered = F.when(F.col("status") == 200, F.expr(_BODY))
    line = F.when(F.expr("(e % 5 = 4) and attempt = 1"), F.lit("<html>busy"))
    path = f"{scratch(spark)}/landed-{uuid.uuid4().hex}"
    responses.land(rows.select("service", "key", "attempt", "status", answered.alias("body"), F.when(F.col("status") != 200, F.lit("refused")).alias("error"), line.alias("line")), path)
    return responses.landed(spark, path), keys


_OUTCOMES = f"""k as ({_KEYS}), t as ({_TRIES}), u as (select *, {_BODY} as body from t where not (e % 5 = 4 and attempt = 1) and attempt <= 3),
    o as (select service, key, min(case when status = 200 then body end) as body, coalesce(min(case when status = 200 then attempt end), max(attempt)) as attempts,
      case when bool_or(status = 200) then 200 else arg_max(status, attempt) end as status, case when not bool_or(status = 200) then 'refused' end as error from u group by 1, 2)"""
_RESOLVED = f"""{_OUTCOMES}, c as (select key, '{{"main":{{"temp":1.5}}}}' as body from k where e % 6 = 0),
    a as (select k.key, x.body as b1, x.attempts as a1, x.status as s1, x.error as e1, y.body as b2, y.attempts as a2, y.status as s2, y.error as e2 from k left join o x on x.key = k.key and x.service = 'first_service' left join o y on y.key = k.key and y.service = 'second_service' where k.key not in (select key from c)),
    r as (select key, body, 'cache' as source, 0::bigint as attempts, null::int as status, null as error from c union all
      select key, coalesce(b1, b2), case when b1 is not null then 'first_service' when b2 is not null then 'second_service' end, (coalesce(a1, 0) + case when b1 is null then coalesce(a2, 0) else 0 end)::bigint,
        case when b1 is null and b2 is null then coalesce(s2, s1) end, case when b1 is null and b2 is null then coalesce(e2, e1) end from a)"""


def _resolved(spark, sf):
    found, keys = _landed(spark, sf)
    cache = keys.where("e % 6 = 0").select("key", F.lit('{"main":{"temp":1.5}}').alias("body"))
    return connectors.resolve(keys, cache, connectors.outcomes(found), _SERVICES), cache


@query(oracle(f"{_OUTCOMES} select service, key, body, attempts, status, error from o"))
def landed_outcomes(spark, sf):
    return connectors.outcomes(_landed(spark, sf)[0])


@query(oracle(f"k as ({_KEYS}), t as ({_TRIES}) select service, count(*) as lines, count(case when e % 5 = 4 and attempt = 1 then 1 end) as malformed, count(case when status = 200 and not (e % 5 = 4 and attempt = 1) then 1 end) as answers from t where service = 'second_service' group by 1"))
def landed_service(spark, sf):
    rows = _landed(spark, sf)[0].where("service = 'second_service'")
    return rows.groupBy("service").agg(F.count("*").alias("lines"), F.count_if(F.col("error") == "malformed").alias("malformed"), F.count("status").alias("_s"), F.count_if(F.coalesce(F.col("status") == 200, F.lit(False))).alias("answers")).drop("_s")


@query(oracle(f"{_RESOLVED} select * from r"))
def resolved_lookups(spark, sf):
    return _resolved(spark, sf)[0]


@query(oracle(f"{_RESOLVED} select key, attempts, status, error from r where source is null"))
def failed_lookups(spark, sf):
    return connectors.failures(_resolved(spark, sf)[0])


@query(oracle(f"{_RESOLVED} select key, body from r where source is not null"))
def grown_cache(spark, sf):
    resolved, cache = _resolved(spark, sf)
    return connectors.grown_cache(cache, resolved)


def _weather(spark, sf):
    points = track_points(spark, sf).where("latitude is not null").withColumn("key", F.concat_ws("|", "track_id", F.col("date").cast("string")))
    return connectors.weather(points, _resolved(spark, sf)[0])


_ESTIMATE = """case when latitude>66 then case when wi then -15.0 else -2.0 end when latitude>60 then case when wi then -8.0 else 12.0 end when latitude>45 then case when wi then -2.0 else 18.0 end else case when wi then 20.0 else 28.0 end end + (((longitude%30)+30)%30)/30*4.0-2.0"""
_POINTS = f"""{_RESOLVED}, m as (select p.*, month(date) in (12,1,2) as wi, body, source from track_points p join r on r.key = track_id || '|' || cast(date as varchar(10)) where latitude is not null)"""


@query(
    oracle(f"""{_POINTS} select track_id, point_index, round(case when body is null then {_ESTIMATE} else (body->>'$.main.temp')::double end, 6) as temperature,
      case when body is null then case when latitude>66 then 75 when latitude>60 then 70 when latitude>45 then 65 when month(date) between 6 and 8 then 70 else 55 end else coalesce((body->>'$.main.humidity')::double, 50.0) end::double as humidity,
      case when body is null then case when latitude>66 then 6.0 when latitude>60 then 4.5 when latitude>45 then 3.5 else 2.5 end else coalesce((body->>'$.wind.speed')::double, 0.0) end::double as wind_speed,
      case when body is not null then coalesce(body->>'$.weather[0].description', 'No description') end as description, case when body is null then 0.45 else 0.85 end::double as confidence, coalesce(source, 'estimated') as source from m""")
)
def connected_weather(spark, sf):
    w = _weather(spark, sf)
    return w.select("track_id", "point_index", F.round("temperature", 6).alias("temperature"), "humidity", "wind_speed", F.when(F.col("source") != "estimated", F.col("weather_description")).alias("description"), "confidence", "source")


@query(
    oracle(f"""{_POINTS}, n as (select count(*) filter (coalesce(source, 'estimated') <> 'estimated') as processed, count(*) filter (source is null) as failed, count(*) filter (source = 'cache') as cache,
      count(*) filter (source in ('first_service', 'second_service')) as services, count(*) filter (source is null) as estimated from m)
      select *, printf('%.1f%%', 100.0 * processed / (processed + failed)) as success_rate from n""")
)
def run_counters(spark, sf):
    """The counts come with the rows as they are stored, from one job."""
    seen = Observation("weather")
    w = connectors.counted(_weather(spark, sf), seen, F.col("source") == "estimated")
    w.write.parquet(f"{scratch(spark)}/weather-{uuid.uuid4().hex}")
    return connectors.counters(spark, seen)


@query()
def weather_records(spark, sf):
    return connectors.weather_record(_weather(spark, sf), ["track_id", "point_index"])
