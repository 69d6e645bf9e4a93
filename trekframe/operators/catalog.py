"""What is known of each feature: kind and range; checks of records against it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Features with a range. Flags run from 0 to 1.
RANGES = {
    "T_month": (1, 12),
    "T_day_of_week": (0, 6),
    "T_day_of_year": (1, 366),
    "T_year": (2004, 2024),
    "T_quarter": (1, 4),
    "G_latitude": (45.0, 75.0),
    "G_longitude": (15.0, 180.0),
    "G_utm_zone": (32, 61),
    "G_distance_to_pole_km": (1665.0, 5000.0),
    "G_latitude_sin": (-1.0, 1.0),
    "G_longitude_sin": (-1.0, 1.0),
    "M_temperature": (-60.0, 50.0),
    "TR_terrain_confidence": (0.0, 1.0),
    "TR_altitude": (-500.0, 7000.0),
    "TJ_step_frequency": (0.5, 3.0),
    "OBJ_count_nearby": (0, 50),
    "OBJ_shelter_count": (0, 20),
    "OBJ_water_count": (0, 20),
    "OBJ_landmark_count": (0, 20),
    "OBJ_nearest_distance_m": (0.0, 500.0),
    "OBJ_poi_density_per_km2": (0.0, 200.0),
    "Q_data_completeness": (0.0, 1.0),
}
CATEGORICAL = ("T_season", "G_region", "G_latitude_band", "G_longitude_band", "M_temperature_class", "TR_terrain_type", "TR_altitude_class")
FLAGS = ("T_is_winter", "T_is_expedition_month", "M_is_cold", "M_is_freezing", "M_is_hot", "TR_is_forest", "TR_is_water", "TR_is_open", "TR_is_mountain", "TR_is_urban", "OBJ_has_shelter", "OBJ_has_water", "OBJ_has_landmark")
GROUPS = {"T": "temporal", "G": "geographic", "M": "meteorological", "TR": "terrain", "TJ": "trajectory", "OBJ": "environmental", "Q": "quality"}


def feature_catalog(spark: SparkSession) -> DataFrame:
    """feature, category, data_type, low, high of all 42 features."""
    kind = lambda v: "discrete" if isinstance(v[0], int) else "continuous"
    rows = [(k, kind(v), float(v[0]), float(v[1])) for k, v in RANGES.items()] + [(k, "categorical", None, None) for k in CATEGORICAL] + [(k, "binary", 0.0, 1.0) for k in FLAGS]
    df = spark.createDataFrame(rows, "feature string, data_type string, low double, high double")
    groups = F.create_map(*[F.lit(x) for kv in GROUPS.items() for x in kv])
    return df.select("feature", groups[F.split("feature", "_")[0]].alias("category"), "data_type", "low", "high")


def catalog_summary(spark: SparkSession) -> DataFrame:
    """category, data_type, n, with totals."""
    return feature_catalog(spark).groupingSets([["category"], ["data_type"], []], "category", "data_type").agg(F.count("*").alias("n"))


def range_violations(records: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """feature, n, outside, share, ok: values beyond a feature's range widened by a share of it; one pass for all features."""
    names = [k for k in RANGES if k in records.columns]
    pairs = F.inline(F.array(*[F.struct(F.lit(k).alias("feature"), F.col(k).cast("double").alias("value")) for k in names]))
    rows = records.select(pairs).where("value is not null").join(feature_catalog(records.sparkSession), "feature")
    room = tolerance * (F.col("high") - F.col("low"))
    out = F.count_if((F.col("value") < F.col("low") - room) | (F.col("value") > F.col("high") + room))
    return rows.groupBy("feature").agg(F.count("*").alias("n"), out.alias("outside")).withColumn("share", F.round(F.col("outside") / F.col("n"), 6)).withColumn("ok", F.col("share") <= tolerance)
