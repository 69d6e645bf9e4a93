"""Validation of track points: ranges, missing values, duplicates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Regional limits of valid points.
LAT, LON, ALT = (45.0, 72.0), (15.0, 180.0), (-100.0, 6000.0)
#: Limits of the augmentation region.
REGION_LAT, REGION_LON = (41.0, 81.0), (19.0, 169.0)


def outside(c: Column, limits: tuple[float, float]) -> Column:
    """True where a value is known and out of range."""
    return F.coalesce(~c.between(*limits), F.lit(False))


def violations(points: DataFrame) -> DataFrame:
    """points with an array of the checks that each row fails."""
    return points.withColumn(
        "violations",
        F.array_compact(
            F.array(
                F.when(outside(F.col("latitude"), LAT), "latitude"),
                F.when(outside(F.col("longitude"), LON), "longitude"),
                F.when(outside(F.col("altitude"), ALT), "altitude"),
                F.when(F.col("latitude").isNull() | F.col("longitude").isNull(), "missing"),
            )
        ),
    )


def validity(points: DataFrame) -> DataFrame:
    """One row: counts of each violation, and the valid share, rows that fail two range checks counted twice."""
    count = F.count_if
    counts = points.agg(
        F.count("*").alias("total"),
        count(outside(F.col("latitude"), LAT)).alias("bad_latitude"),
        count(outside(F.col("longitude"), LON)).alias("bad_longitude"),
        count(outside(F.col("altitude"), ALT)).alias("bad_altitude"),
        count(F.col("latitude").isNull() | F.col("longitude").isNull()).alias("missing_coordinates"),
    )
    valid = F.col("total") - F.col("bad_latitude") - F.col("bad_longitude") - F.col("bad_altitude")
    return counts.withColumn("valid", valid).withColumn("valid_pct", F.round(100.0 * valid / F.col("total"), 4))


def missing_strategy(pct: Column) -> Column:
    return F.when(pct == 0, "none").when(pct < 5, "interpolate").when(pct < 20, "impute").otherwise("drop or model")


def missing_values(points: DataFrame, columns: list[str]) -> DataFrame:
    """column, nulls, pct, strategy: one pass for all columns."""
    one = points.agg(F.count("*").alias("n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    long = one.select("n", F.inline(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("nulls")) for c in columns])))
    pct = 100.0 * F.col("nulls") / F.col("n")
    return long.select("column_name", "nulls", F.round(pct, 4).alias("pct"), missing_strategy(pct).alias("strategy"))


def duplicates(points: DataFrame, keys: list[str], flag: str = "is_duplicate") -> DataFrame:
    """points with a flag on every row whose keys occur more than once; nulls are equal."""
    # Counted before they are joined: a window would bring all rows of a frequent key into one task.
    again = points.groupBy(*[F.col(k).alias(f"_{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("_n")).where("_n > 1")
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_{i}"))
    return points.join(again, same, "left").select(*points.columns, F.col("_n").isNotNull().alias(flag))


def within_bounds(points: DataFrame, lat: tuple[float, float] = (-90.0, 90.0), lon: tuple[float, float] = (-180.0, 180.0), ele: tuple[float, float] = (-500.0, 9000.0)) -> DataFrame:
    """Rows inside the bounds; unknown elevation passes."""
    return points.where(F.col("latitude").between(*lat) & F.col("longitude").between(*lon) & (F.col("altitude").isNull() | F.col("altitude").between(*ele)))


def route_checks(points: DataFrame, keys: list[str]) -> DataFrame:
    """One row over loaded routes: rows, rows out of range, columns with gaps, repeated rows, and points outside the world."""
    wrong = violations(points).agg(F.count_if(F.size("violations") > 0).alias("n_invalid"))
    gaps = missing_values(points, [c for c in points.columns if c not in keys]).agg(F.count_if(F.col("nulls") > 0).alias("n_columns_with_gaps"))
    again = duplicates(points, keys).agg(F.count("*").alias("n"), F.count_if("is_duplicate").alias("n_duplicates"))
    inside = within_bounds(points).agg(F.count("*").alias("n_inside"))
    one = again.crossJoin(wrong).crossJoin(gaps).crossJoin(inside)  # single rows
    return one.select("n", "n_invalid", "n_columns_with_gaps", "n_duplicates", (F.col("n") - F.col("n_inside")).alias("n_outside_world"))


def region_errors(points: DataFrame) -> DataFrame:
    """track_id, ok, n_bad: whether all of a track's points lie in the augmentation region."""
    bad = outside(F.col("latitude"), REGION_LAT) | outside(F.col("longitude"), REGION_LON)
    return points.groupBy("track_id").agg(F.bool_and(~bad).alias("ok"), F.count_if(bad).alias("n_bad"))


def track_ok(points: DataFrame) -> DataFrame:
    """track_id, n, ok: two points or more and none without coordinates."""
    return points.groupBy("track_id").agg(F.count("*").alias("n"), ((F.count("*") >= 2) & (F.count_if(F.col("latitude").isNull() | F.col("longitude").isNull()) == 0)).alias("ok"))


def elevation_warnings(points: DataFrame, limit: float = 100.0) -> DataFrame:
    """track_id, warnings, max_step: consecutive altitude steps above the limit."""
    w = Window.partitionBy("track_id").orderBy("point_index")
    step = F.abs(F.col("altitude") - F.lag("altitude").over(w))
    return points.withColumn("step", step).groupBy("track_id").agg(F.count_if(F.col("step") > limit).alias("warnings"), F.max("step").alias("max_step"))
