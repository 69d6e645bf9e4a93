"""Geodesy as SQL functions: expressions that the optimizer puts in place, and a table function."""

from __future__ import annotations

import math

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from trekframe.functions.geo import R_MEAN
from trekframe.sources.shared import ship

_HALF = "pow(sin((radians(lat2) - radians(lat1)) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin((radians(lon2) - radians(lon1)) / 2), 2)"
_POINTS = "lat1 double, lon1 double, lat2 double, lon2 double"
FUNCTIONS = {
    "haversine_m": (_POINTS, "double", f"2 * {R_MEAN} * asin(sqrt(least(1.0, {_HALF}) + 0 * ({_HALF})))"),
    "bearing_deg": (_POINTS, "double", "pmod(degrees(atan2(sin(radians(lon2) - radians(lon1)) * cos(radians(lat2)), cos(radians(lat1)) * sin(radians(lat2)) - sin(radians(lat1)) * cos(radians(lat2)) * cos(radians(lon2) - radians(lon1)))) + 360, 360)"),
    "utm_zone": ("lon double", "int", "cast(floor((lon + 180) / 6) + 1 as int)"),
}


class Between:
    """Rows k, latitude, longitude: n points on the straight line between two points in latitude and longitude, both ends included."""

    def eval(self, lat1: float, lon1: float, lat2: float, lon2: float, n: int):
        if None in (lat1, lon1, lat2, lon2) or any(map(math.isnan, (lat1, lon1, lat2, lon2))):
            return
        for k in range(n):
            f = k / (n - 1)
            yield k, lat1 + f * (lat2 - lat1), lon1 + f * (lon2 - lon1)


def register(spark: SparkSession) -> None:
    """Makes the functions known to the session's SQL."""
    ship(spark)
    for name, (arguments, result, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name}({arguments}) returns {result} return {body}")
    spark.udtf.register("points_between", udtf(Between, returnType="k int, latitude double, longitude double"))
