"""Track points and nearby objects derived from the events table, in SQL that Spark and DuckDB both run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TRACK_POINTS = """
with base as (
  select event_id, user_id, ts, value, event_type,
    row_number() over (partition by user_id order by ts, event_id) - 1 as pidx,
    case when event_id % 11 = 0 then 0 else (event_id*7919) % 2001 - 1000 end as dlat,
    case when event_id % 11 = 0 then 0 else (event_id*104729) % 2001 - 1000 end as dlon,
    (event_id*31) % 41 - 20 as dalt
  from events),
cum as (
  select *, cast(sum(dlat) over w as double)/100000.0 as slat,
            cast(sum(dlon) over w as double)/100000.0 as slon,
            cast(sum(dalt) over w as double) as salt
  from base
  window w as (partition by user_id order by pidx rows between unbounded preceding and current row))
select concat('TRACK_', cast(user_id as varchar(20))) as track_id,
  cast(pidx as int) as point_index,
  cast(ts as date) + cast((user_id*7) % 365 as int) as date,
  ts as event_ts,
  case when event_id % 401 = 0 then null
       else 50.0 + cast(user_id % 15 as double) + slat + case when event_id % 97 = 0 then 20.0 else 0.0 end end as latitude,
  30.0 + cast(user_id % 100 as double) + slon - case when event_id % 193 = 0 then 30.0 else 0.0 end as longitude,
  case when event_id % 37 = 0 then null
       else 400.0 + salt + case when event_id % 151 = 0 then 7000.0 else 0.0 end end as altitude,
  case when event_id % 29 = 0 then null else cast((event_id*13) % 55 as double) - 24.5 end as temperature,
  case event_id % 8 when 0 then 'forest' when 1 then 'taiga' when 2 then 'river' when 3 then 'meadow'
       when 4 then 'rocks' when 5 then 'village' when 6 then 'swamp' else null end as terrain_type,
  case when event_id % 5 = 0 then null else cast(event_id % 10 as double)/10.0 end as terrain_confidence,
  cast(event_id % 7 as double)/2.0 + 0.5 as frequency_steps,
  cast(user_id % 5 as int) as region_key,
  event_id
from cum
"""

POINT_OBJECTS = """
select concat('TRACK_', cast(e.user_id as varchar(20))) as track_id, e.event_id,
  case (e.event_id + k) % 4 when 0 then 'shelter' when 1 then 'river' when 2 then 'peak' else 'shop' end as obj_type,
  cast((e.event_id*17 + k*101) % 500 as double) as distance_m
from events e cross join (select 0 as k union all select 1 union all select 2) g
where k < e.event_id % 4
"""


def track_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track_id, point_index, date, event_ts, latitude, longitude, altitude, temperature, terrain_type, terrain_confidence, frequency_steps, region_key, event_id."""
    return spark.sql(TRACK_POINTS.replace("from events", "from {events}"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def point_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track_id, event_id, obj_type, distance_m."""
    return spark.sql(POINT_OBJECTS.replace("from events e", "from {events} e"), events=spark.read.parquet(f"{sf_dir}/events.parquet"))


def seconds(ts) -> F.Column:
    """Seconds since the epoch of a timestamp without zone, taken as UTC."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp")) / 1e6


def oracle(body: str, recursive: bool = False) -> str:
    """DuckDB SQL with the two relations in front; body is a query, or further common tables ("name as (...), ...") and a query."""
    body = body.strip().lstrip(",").strip()
    more = "" if body.lower().startswith("select") else ", "
    return f"with {'recursive ' * recursive}track_points as ({TRACK_POINTS}), point_objects as ({POINT_OBJECTS}) {more}{body}"
