"""Look-ups with a cache, services and an estimate, over landed responses.

A look-up is answered by the cache, else by the first service in order that
answered one of its allowed attempts, else by an estimate where there is one;
what nobody answered is a failure, with its attempts and last error, as a row.
All of it is joins on the key: services are asked once a key, whatever the
number of points, and each step only takes what the ones before left open.

Defined cases: null keys are asked of nobody and fail; repeated responses of one
attempt count once, an answer before an error; responses to keys that nobody
asked for are ignored; an empty table of responses leaves all to the estimate.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from trekframe.operators.features import estimated_weather

#: Attempts that a look-up is given at most.
ATTEMPTS = 3


def outcomes(responses: DataFrame, attempts: int = ATTEMPTS) -> DataFrame:
    """service, key, body (null where all attempts failed), attempts (made until the answer), status and error of the last.

    Only attempts up to the limit count; an answer has status 200 and a body.
    """
    rows = responses.where(F.col("key").isNotNull() & F.col("attempt").between(1, attempts))
    answered = (F.col("status") == 200) & F.col("body").isNotNull()
    first = F.min_by(F.when(answered, F.struct("attempt", "body")), F.when(answered, F.struct("attempt", "body")))
    last = F.max_by(F.struct("status", "error"), F.struct("attempt", F.when(answered, 1).otherwise(0).alias("answered"), "status", "error"))
    found = rows.groupBy("service", "key").agg(first.alias("first"), F.max("attempt").alias("made"), last.alias("last"))
    return found.select("service", "key", "first.body", F.coalesce("first.attempt", "made").alias("attempts"), F.when(F.col("first.body").isNull(), F.col("last.status")).otherwise(200).alias("status"), F.when(F.col("first.body").isNull(), F.col("last.error")).alias("error"))


def resolve(wanted: DataFrame, cache: DataFrame, found: DataFrame, services: list[str]) -> DataFrame:
    """key, body, source ("cache", a service, or null), attempts (of all services asked), status and error (of the last that failed) for each distinct key of wanted.

    cache: key, body. found: the outcomes of services; those later in the list
    are asked only for what the earlier ones failed at.
    """
    keys = wanted.select("key").distinct()
    kept = cache.where("body is not null").groupBy("key").agg(F.min("body").alias("body"))
    hits = keys.join(kept, "key").select("key", "body", F.lit("cache").alias("source"), F.lit(0).cast("long").alias("attempts"), F.lit(None).cast("int").alias("status"), F.lit(None).cast("string").alias("error"))
    open_ = keys.join(kept, "key", "left_anti")
    order = F.array_position(F.array(*[F.lit(s) for s in services]), F.col("service"))
    asked = open_.join(found.where(F.col("service").isin(services)).withColumn("order", order), "key", "left")
    best = F.min(F.when(F.col("body").isNotNull(), F.col("order")))
    by_key = asked.groupBy("key").agg(best.alias("best"), F.collect_list(F.struct("order", "service", "body", "attempts", "status", "error")).alias("tried"))  # a row a service
    used = F.filter("tried", lambda t: t["order"].isNotNull() & (F.col("best").isNull() | (t["order"] <= F.col("best"))))
    rows = by_key.withColumn("used", F.array_sort(used)).withColumn("last", F.get(F.col("used"), F.size("used") - 1))
    total = F.aggregate("used", F.lit(0).cast("long"), lambda n, t: n + t["attempts"])
    failed = F.col("best").isNull()
    misses = rows.select("key", F.when(~failed, F.col("last.body")).alias("body"), F.when(~failed, F.col("last.service")).alias("source"), total.alias("attempts"), F.when(failed, F.col("last.status")).alias("status"), F.when(failed, F.col("last.error")).alias("error"))
    return hits.unionByName(misses)


def failures(resolved: DataFrame) -> DataFrame:
    """key, attempts, status and error of what neither the cache nor a service answered."""
    return resolved.where("source is null").select("key", "attempts", "status", "error")


def grown_cache(cache: DataFrame, resolved: DataFrame) -> DataFrame:
    """The cache with the services' answers, as it is kept for the next run."""
    return cache.select("key", "body").unionByName(resolved.where("source is not null and source <> 'cache'").select("key", "body"))


_WEATHER = "main struct<temp:double,humidity:double,pressure:double>, weather array<struct<main:string,description:string>>, wind struct<speed:double>"


def weather(points: DataFrame, resolved: DataFrame) -> DataFrame:
    """points (with key, latitude, longitude, date; columns of the weather's names are replaced) with the weather's temperature, humidity, pressure, wind_speed, weather_code, weather_description, confidence and source.

    An answer's missing members have the service's defaults; where there is no
    answer, or it can't be read, the estimate stands in.
    """
    body = F.from_json("body", _WEATHER)
    answers = resolved.where("body is not null").select("key", body.alias("w"), F.col("source").alias("from"))
    rows = points.join(answers, "key", "left")
    estimate = estimated_weather(F.col("latitude"), F.col("longitude"), F.month("date"))
    sky = F.get(F.col("w.weather"), F.lit(0))
    read = F.col("w").isNotNull() & (F.col("w.main").isNotNull() | F.col("w.wind").isNotNull() | F.col("w.weather").isNotNull())
    given = {
        "temperature": F.coalesce("w.main.temp", F.lit(15.0)),
        "humidity": F.coalesce("w.main.humidity", F.lit(50.0)),
        "pressure": F.coalesce("w.main.pressure", F.lit(1013.0)),
        "wind_speed": F.coalesce("w.wind.speed", F.lit(0.0)),
        "weather_code": F.coalesce(sky["main"], F.lit("Unknown")),
        "weather_description": F.coalesce(sky["description"], F.lit("No description")),
        "confidence": F.lit(0.85),
    }
    pick = {k: F.when(read, v).otherwise(estimate[k].cast("string" if k.startswith("weather") else "double")) for k, v in given.items()}
    others = [c for c in points.columns if c not in pick and c != "source"]
    return rows.select(*others, *[v.alias(k) for k, v in pick.items()], F.when(read, F.col("from")).otherwise("estimated").alias("source"))


def weather_record(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The weather as it is handed on: temperature, humidity and pressure to one place, wind speed and confidence to two."""
    places = {"temperature": 1, "humidity": 1, "pressure": 1, "wind_speed": 2, "confidence": 2}
    return rows.select(*keys, *[F.round(c, places[c]).alias(c) if c in places else F.col(c) for c in ("temperature", "humidity", "pressure", "wind_speed", "weather_code", "weather_description", "confidence", "source")])


def counted(rows: DataFrame, observation: Observation, failed) -> DataFrame:
    """rows, while whose being written processed, failed, cached, asked and estimated rows are counted: no pass of their own.

    failed: a condition; rows have source.
    """
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    source = F.col("source")
    return rows.observe(observation, n(~failed).alias("processed"), n(failed).alias("failed"), n(source == "cache").alias("cache"), n(source == "estimated").alias("estimated"), n(source.isNotNull() & ~source.isin("cache", "estimated")).alias("services"))


def counters(spark: SparkSession, observation: Observation) -> DataFrame:
    """One row: the counts of a run that has ended, and its success rate as the report shows it."""
    got = observation.get
    total = got["processed"] + got["failed"]
    rate = f"{100 * got['processed'] / total:.1f}%" if total else "0.0%"
    names = ("processed", "failed", "cache", "services", "estimated")
    return spark.createDataFrame([(*(got[n] for n in names), rate)], ", ".join([*(f"{n} long" for n in names), "success_rate string"]))  # one row
