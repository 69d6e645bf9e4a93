"""The whole way of a track: validate, repair, enrich, store, extract features, analyse, augment, report."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trekframe.operators import augment, catalog, features, quality, stats, store, tracks
from trekframe.sources.shared import materialised

NUMERIC = ["G_latitude", "G_longitude", "M_temperature", "TR_altitude", "TR_terrain_confidence", "TJ_step_frequency", "OBJ_count_nearby"]


@dataclass
class Outcome:
    """Tables of a run; each is computed when it is used or written."""

    validity: DataFrame
    anomalies: DataFrame
    repaired: DataFrame
    records: DataFrame
    profile: DataFrame
    pairs: DataFrame
    confounders: DataFrame
    seasons: DataFrame
    catalogue: DataFrame
    variants: DataFrame

    def tables(self) -> dict[str, DataFrame]:
        return dict(vars(self))


def repair(points: DataFrame, max_kmh: float = 50.0) -> DataFrame:
    """Missing and too fast points between good ones, put on the line between these."""
    flagged = tracks.speed_violations(points, max_kmh)
    bad = F.col("violation") | F.col("latitude").isNull() | F.col("longitude").isNull()
    return tracks.interpolate_linear(flagged, bad).drop("violation")


def analyse(points: DataFrame, objects: DataFrame, regions: DataFrame | None = None, configs: list[tuple[str, str, float, float]] | None = None) -> Outcome:
    """All stages over all tracks at once; a bad track shows in the tables and stops nothing."""
    repaired = repair(points)
    known = repaired.where("latitude is not null and longitude is not null")
    weather = features.estimated_weather(F.col("latitude"), F.col("longitude"), F.month("date"))
    enriched = known.withColumn("temperature", F.coalesce("temperature", weather["temperature"])).withColumn("terrain_type", F.coalesce("terrain_type", features.classify_point(F.col("latitude"), F.col("altitude"))))
    records = materialised(features.feature_record(enriched, objects, regions))  # six tables come from it
    pairs = stats.pearson_pairs(records, NUMERIC)
    return Outcome(
        validity=quality.validity(points),
        anomalies=tracks.gps_anomalies(points, clock="time"),
        repaired=repaired,
        records=records,
        profile=stats.numeric_profile(records, NUMERIC),
        pairs=stats.with_p(pairs),
        confounders=stats.confounders(pairs),
        seasons=stats.seasonal_balance(records),
        catalogue=catalog.range_violations(records),
        variants=augment.variants(known, configs or [("shift", "e1", 1000.0, 90.0), ("rotate", "r15", 15.0, 0.0), ("days", "d7", 7, 0)]),
    )


def run(spark: SparkSession, points: DataFrame, objects: DataFrame, root: str, regions: DataFrame | None = None) -> dict[str, int]:
    """Stores tracks, points, variants and their lineage, and writes the tables of the analysis as Parquet and the small ones as CSV too; rows by table."""
    found = analyse(points, objects, regions)
    shelf = store.TrackStore(spark, f"{root}/store")
    shelf.add_tracks(points)
    shelf.add_points(points)
    shelf.add_tracks(found.variants.select("track_id", "date"))
    shelf.add_lineage(found.variants.select("original_track_id", F.col("track_id").alias("augmented_track_id"), "augmentation_type").distinct())
    counts = {}
    for name, table in found.tables().items():
        table.write.mode("overwrite").parquet(f"{root}/{name}")
        written = spark.read.parquet(f"{root}/{name}")
        counts[name] = written.count()
        if name in ("validity", "profile", "pairs", "confounders", "seasons", "catalogue"):
            written.write.mode("overwrite").option("header", True).csv(f"{root}/csv/{name}")
            written.write.mode("overwrite").json(f"{root}/json/{name}")
    return counts
