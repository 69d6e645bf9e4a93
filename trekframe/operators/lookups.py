"""Joins of points with small or spatial relations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trekframe.functions import geo


def with_lookup(points: DataFrame, table: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """points with columns of a table keyed by latitude and longitude to so many places (lat6, lon6); Spark broadcasts it if its size allows."""
    keyed = points.withColumns({"lat6": F.round("latitude", digits), "lon6": F.round("longitude", digits)})
    return keyed.join(table.select("lat6", "lon6", *columns), ["lat6", "lon6"], "left").drop("lat6", "lon6")


def first_known(*columns: Column) -> Column:
    """Cached value, else the service's, else the estimate."""
    return F.coalesce(*columns)


def hit_counts(wanted: DataFrame, cache: DataFrame, key: str) -> DataFrame:
    """One row: look-ups, hits, misses and the share of hits; cache has one row a key."""
    rows = wanted.join(cache.select(key, F.lit(True).alias("_hit")), key, "left")
    hits = F.count("_hit")
    return rows.agg(F.count("*").alias("lookups"), hits.alias("hits"), (F.count("*") - hits).alias("misses"), F.round(100.0 * hits / F.count("*"), 4).alias("hit_pct"))


def within_radius(points: DataFrame, places: DataFrame, metres: float, cell: float | None = None) -> DataFrame:
    """points' id, places' id and distance of pairs closer than a radius.

    Both sides fall into cells of latitude and longitude that are at least a
    radius wide, points also into the neighbouring cells: an equi-join on the
    cell, then the exact distance; nothing is compared across far cells.
    points: id, latitude, longitude; places: place_id, latitude, longitude.
    """
    size = cell or metres / 111000.0 * 1.01
    lat_cell = lambda c: F.floor(c / size)
    # A row's circle is cut into whole cells that get wider towards the poles, the first next to the last; around a pole one cell is all. Both sides compute them alike.
    edge = lambda row: F.greatest(F.abs(row), F.abs(row + 1)) * size
    cells = lambda row: F.when(edge(row) >= 89, 1).otherwise(F.greatest(F.lit(1), F.floor(360 * F.cos(F.radians(edge(row))) / size)))
    col = lambda lon, row: F.pmod(F.floor((lon + 180) * cells(row) / 360), cells(row))
    there = places.select("place_id", F.col("latitude").alias("plat"), F.col("longitude").alias("plon")).where("plat is not null and plon is not null")
    there = there.withColumn("row", lat_cell(F.col("plat"))).withColumn("col", col(F.col("plon"), F.col("row")))
    here = points.select("id", "latitude", "longitude").where("latitude is not null and longitude is not null")
    here = here.withColumn("row", F.explode(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: lat_cell(F.col("latitude")) + d)))
    here = here.withColumn("col", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(-1), F.lit(1)), lambda d: F.pmod(col(F.col("longitude"), F.col("row")) + d, cells(F.col("row")))))))
    d = geo.haversine(F.col("latitude"), F.col("longitude"), F.col("plat"), F.col("plon"))
    return here.join(there, ["row", "col"]).select("id", "place_id", d.alias("distance")).where(F.col("distance") < metres)


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, columns: list[str]) -> DataFrame:
    """left with the columns of the right row of equal keys whose time is the latest not after its own; one sort of both sides together."""
    a = left.select("*", F.col(left_time).alias("_t"), F.lit(1).alias("_side"), F.lit(None).cast(right.select(F.struct(*columns)).schema[0].dataType).alias("_r"))
    b = right.select(*keys, F.col(right_time).alias("_t"), F.lit(0).alias("_side"), F.struct(*columns).alias("_r"))
    w = Window.partitionBy(*keys).orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    rows = a.unionByName(b, allowMissingColumns=True).withColumn("_r", F.last("_r", ignorenulls=True).over(w)).where("_side = 1")
    return rows.select(*left.columns, *[F.col(f"_r.{c}").alias(c) for c in columns])
