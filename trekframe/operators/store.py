"""Versioned Parquet tables: idempotent inserts, corrections, history, lineage.

Tables are folders of Parquet files under a root. Inserts append rows that the
table doesn't have (anti-joins on the key); updates write a new version of the
folder and then name it the current one, so readers see either.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trekframe.sources.shared import materialised


def new_rows(incoming: DataFrame, existing: DataFrame, keys: list[str]) -> DataFrame:
    """Incoming rows whose key the table lacks, one a key."""
    return incoming.join(existing.select(*keys), keys, "left_anti").dropDuplicates(keys)


def change_hash(fields) -> F.Column:
    """SHA-256 of a JSON text."""
    return F.sha2(F.coalesce(fields, F.lit("{}")).cast("binary"), 256)


def with_corrections(points: DataFrame, corrections: DataFrame) -> DataFrame:
    """points with is_corrected and version: each correction of a point raises its version; coordinates stay."""
    n = corrections.groupBy("track_id", "point_index").agg(F.count("*").alias("_n"))
    rows = points.join(n, ["track_id", "point_index"], "left")
    return rows.withColumns({"is_corrected": F.col("_n").isNotNull(), "version": 1 + F.coalesce("_n", F.lit(0))}).drop("_n")


def merge_metadata(left, right) -> F.Column:
    """Union of two string maps, the right one's values first."""
    return F.map_concat(F.map_filter(left, lambda k, v: ~F.map_contains_key(right, k)), right)


def latest(rows: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The row with the highest version of each key."""
    w = Window.partitionBy(*keys).orderBy(F.col(version).desc())
    return rows.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


class TrackStore:
    """Tables under a root folder that any Spark file system may hold."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _current(self, name: str) -> str | None:
        try:
            row = self.spark.read.json(f"{self.root}/_versions/{name}").agg(F.max_by("folder", "n").alias("folder")).first()
        except Exception as error:
            if "PATH_NOT_FOUND" in str(error):
                return None
            raise
        return row.folder

    def read(self, name: str) -> DataFrame | None:
        folder = self._current(name)
        return self.spark.read.parquet(f"{self.root}/{name}/{folder}") if folder else None

    def replace(self, name: str, rows: DataFrame) -> None:
        """Writes a new version, then names it."""
        folder, log = uuid.uuid4().hex, f"{self.root}/_versions/{name}"
        rows.write.parquet(f"{self.root}/{name}/{folder}")
        n = self.spark.read.json(log).count() if self._current(name) else 0
        self.spark.createDataFrame([(n, folder)], "n long, folder string").write.mode("append").json(log)

    def insert(self, name: str, rows: DataFrame, keys: list[str]) -> int:
        """Appends rows with new keys; how many."""
        folder = self._current(name)
        if folder is None:
            fresh = rows.dropDuplicates(keys)
            self.replace(name, fresh)
            return self.read(name).count()
        table = self.spark.read.parquet(f"{self.root}/{name}/{folder}")
        before = table.count()
        new_rows(rows, table, keys).write.mode("append").parquet(f"{self.root}/{name}/{folder}")
        return self.spark.read.parquet(f"{self.root}/{name}/{folder}").count() - before

    def add_points(self, points: DataFrame) -> int:
        return self.insert("points", points, ["track_id", "point_index"])

    def add_tracks(self, points: DataFrame) -> int:
        """Tracks that the store lacks, with a history row (version 1, create) for each."""
        tracks = points.groupBy("track_id").agg(F.min("date").alias("date_start"), F.max("date").alias("date_end"), F.count("*").alias("point_count")).withColumn("version", F.lit(1))
        added = self.insert("tracks", tracks, ["track_id"])
        self._log(tracks.select("track_id", F.lit(1).alias("version")), "create", "{}")
        return added

    def _log(self, tracks: DataFrame, change_type: str, fields: str) -> None:
        """History rows of (track_id, version): how the track changed, and the hash of what did."""
        rows = tracks.withColumns({"change_type": F.lit(change_type), "change_hash": change_hash(F.lit(fields))})
        self.insert("history", rows, ["track_id", "version", "change_type"])

    def history(self, track_id: str | None = None) -> DataFrame:
        """A track's history, or all, oldest version first."""
        rows = self.read("history")
        return (rows.where(F.col("track_id") == track_id) if track_id else rows).orderBy("track_id", "version")

    def add_anomalies(self, rows: DataFrame) -> int:
        """track_id, point_index, anomaly_type, ...: severity is medium unless it is given."""
        rows = rows.withColumn("severity", F.coalesce(F.col("severity"), F.lit("medium")) if "severity" in rows.columns else F.lit("medium"))
        return self.insert("anomalies", rows.withColumn("is_corrected", F.lit(False)), ["track_id", "point_index", "anomaly_type"])

    def add_maps(self, rows: DataFrame) -> int:
        """track_id, map_type, file_path, metadata (a string map), ...: active maps of version 1."""
        return self.insert("maps", rows.withColumns({"version": F.lit(1), "is_active": F.lit(True)}), ["track_id", "map_type", "file_path"])

    def maps(self, track_id: str | None = None) -> DataFrame:
        """Active maps, of a track or of all, by path from the last."""
        rows = self.read("maps").where("is_active")
        return (rows.where(F.col("track_id") == track_id) if track_id else rows).orderBy(F.col("track_id"), F.col("file_path").desc())

    def update_maps(self, changes: DataFrame) -> None:
        """changes: track_id, map_type, file_path and metadata to merge; the new values win, and the version goes up."""
        keys = ["track_id", "map_type", "file_path"]
        rows = self.read("maps").join(changes.select(*keys, F.col("metadata").alias("_new")), keys, "left")
        merged = rows.withColumns({"metadata": F.when(F.col("_new").isNull(), F.col("metadata")).otherwise(merge_metadata(F.col("metadata"), F.col("_new"))), "version": F.col("version") + F.col("_new").isNotNull().cast("int")})
        self.replace("maps", merged.drop("_new"))

    def add_external(self, rows: DataFrame) -> int:
        """platform, source_id, ...: one row a source, whatever the case of its platform's name."""
        rows = rows.withColumns({"platform": F.lower("platform"), "is_processed": F.lit(False)})
        return self.insert("external", rows, ["platform", "source_id"])

    def external(self, platform: str | None = None, is_processed: bool | None = None) -> DataFrame:
        rows = self.read("external")
        rows = rows if platform is None else rows.where(F.col("platform") == platform.lower())
        return rows if is_processed is None else rows.where(F.col("is_processed") == is_processed)

    def statistics(self) -> DataFrame:
        """name, n: rows of each table that the store has, and its corrected points."""
        out = None
        for name in ("points", "tracks", "corrections", "history", "anomalies", "augmentations", "maps", "external"):
            rows = self.read(name)
            if rows is None:
                continue
            found = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")]
            if name == "points" and "is_corrected" in rows.columns:
                found.append(rows.agg(F.count_if("is_corrected").alias("n")).select(F.lit("corrected_points").alias("name"), "n"))
            for one in found:
                out = one if out is None else out.unionByName(one)
        return out

    def append(self, name: str, rows: DataFrame) -> None:
        """Appends all rows, repeated ones too."""
        folder = self._current(name)
        if folder is None:
            self.replace(name, rows)
        else:
            rows.write.mode("append").parquet(f"{self.root}/{name}/{folder}")

    def correct(self, corrections: DataFrame, together: bool = False) -> None:
        """Appends corrections (track_id, point_index, correction_type, ...): each raises the version of its track, with a history row of that version, and of its point; the point's anomalies are marked.

        A track's corrections count in the order of points and kinds, from the
        version that the store has; corrections of tracks that it lacks are kept
        without a version. together: they are one change of each of their tracks,
        which raises its version by one, with one history row.
        """
        corrections = materialised(corrections)
        self.append("corrections", corrections)
        tracks = self.read("tracks")
        if tracks is not None:
            rows = corrections.join(tracks.select("track_id", F.col("version").alias("_from")), "track_id")
            if together:
                rows = rows.groupBy("track_id", "_from").agg(F.count("*").alias("corrections"), F.bit_xor(F.xxhash64("correction_type", "point_index")).alias("content"))
                place, fields = F.lit(1), F.to_json(F.struct("corrections", "content"))
            else:
                place, fields = F.row_number().over(Window.partitionBy("track_id").orderBy("point_index", "correction_type")), F.to_json(F.struct("correction_type", "point_index"))
            rows = materialised(rows.withColumn("version", (F.col("_from") + place).cast("int")))
            self.append("history", rows.select("track_id", "version", F.lit("correct").alias("change_type"), change_hash(fields).alias("change_hash")))
            raised = rows.groupBy("track_id").agg(F.max("version").alias("_version"))
            self.replace("tracks", tracks.join(raised, "track_id", "left").withColumn("version", F.coalesce("_version", "version")).drop("_version"))
        corrected = self.read("corrections")
        points = self.read("points")
        if points is not None:
            self.replace("points", with_corrections(points.drop("is_corrected", "version"), corrected))
        anomalies = self.read("anomalies")
        if anomalies is not None:
            keys = corrected.select("track_id", "point_index").distinct().withColumn("_hit", F.lit(True))
            marked = anomalies.drop("is_corrected").join(keys, ["track_id", "point_index"], "left").withColumn("is_corrected", F.col("_hit").isNotNull()).drop("_hit")
            self.replace("anomalies", marked)

    def add_lineage(self, edges: DataFrame) -> int:
        """original_track_id, augmented_track_id, ...: only between tracks that the store has."""
        tracks = self.read("tracks")
        known = edges.join(tracks.select(F.col("track_id").alias("original_track_id")), "original_track_id", "left_semi").join(tracks.select(F.col("track_id").alias("augmented_track_id")), "augmented_track_id", "left_semi")
        return self.insert("augmentations", known, ["original_track_id", "augmented_track_id"])
