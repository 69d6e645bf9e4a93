"""Track files as DataFrames: CSV, GPX, TCX, GeoJSON and KML in; GPX, TCX and CSV out.

Files are read whole, one row a file, and parsed by Spark's XML and JSON
functions: every file is one record, so parsing runs in parallel over files.
Where a table of documents is read back, they may be packed into few files.
"""

from __future__ import annotations

import os
import re
import uuid

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trekframe.sources.shared import materialised, ship

POINT_SCHEMA = "track_id string, point_index int, date date, latitude double, longitude double, altitude double, region string, terrain_type string, frequency_steps double, temperature double"
_GPX = "_creator string, metadata struct<time string>, trk array<struct<name string, desc string, type string, trkseg array<struct<trkpt array<struct<_lat double, _lon double, ele double, time string>>>>>>"
_TCX = "Activities struct<Activity array<struct<_Sport string, Lap array<struct<_StartTime string, Track array<struct<Trackpoint array<struct<Time string, Position struct<LatitudeDegrees double, LongitudeDegrees double>, AltitudeMeters double>>>>>>>>>"
_FEATURE = "type string, properties struct<name string, description string, activity_type string>, geometry struct<type string, coordinates string>"
_KML = "Document struct<Placemark array<struct<name string, LineString struct<coordinates string>, Point struct<coordinates string>>>>"
# The sport that TCX names for an activity.
SPORTS = {
    "run": "Running",
    "running": "Running",
    "hiking": "Walking",
    "hike": "Walking",
    "walk": "Walking",
    "walking": "Walking",
    "cycling": "Biking",
    "bike": "Biking",
    "bicycle": "Biking",
    "biking": "Biking",
    "swimming": "Swimming",
    "swim": "Swimming",
    "skiing": "Skiing",
    "ski": "Skiing",
    "mountaineering": "Walking",
    "climbing": "Walking",
}


def read_csv(spark: SparkSession, path: str, sample: int | None = None) -> DataFrame:
    """Route points with a fixed schema; one bad date fails the load; NaN becomes null."""
    rows = spark.read.schema(POINT_SCHEMA).option("header", True).option("dateFormat", "yyyy-MM-dd").option("mode", "FAILFAST").csv(path)
    rows = rows.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in rows.dtypes])
    return rows.limit(sample) if sample else rows


def parse_time(text: Column) -> Column:
    """Timestamps with or without fraction and offset, as UTC; null otherwise."""
    zone = F.when(text.rlike(r"(Z|[+-]\d{2}:?\d{2})$"), text).otherwise(F.concat(text, F.lit("Z")))
    return F.try_to_timestamp(F.regexp_replace(zone, r"([+-]\d{2})(\d{2})$", "$1:$2"))


def _files(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """value (a file's whole text) and file (its name); documents that were packed are given as such rows."""
    if isinstance(path, DataFrame):
        return path.select("value", "file")
    return spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))


def _numbered(rows: DataFrame, points: Column, lat: str, lon: str, ele: str, time: str, *meta: Column) -> DataFrame:
    """One row a point: file, meta, point_index, latitude, longitude, altitude, ts, error."""
    rows = rows.select("file", *meta, F.posexplode(points).alias("point_index", "p"))
    bad = F.coalesce(~(F.col(f"p.{lat}").between(-90, 90) & F.col(f"p.{lon}").between(-180, 180)), F.lit(True))
    names = [m._jc.toString().split(" AS ")[-1].strip("`") for m in meta]
    return rows.select("file", *names, "point_index", F.col(f"p.{lat}").alias("latitude"), F.col(f"p.{lon}").alias("longitude"), F.col(f"p.{ele}").alias("altitude"), parse_time(F.col(f"p.{time}")).alias("ts"), F.when(bad, "missing or out of range").alias("error"))


def read_gpx(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Points of all segments of all tracks of a file in order."""
    value = F.regexp_replace("value", r"\sxmlns(:\w+)?=\"[^\"]*\"", "")
    rows = _files(spark, path).select("file", F.from_xml(value, F.lit(_GPX)).alias("d"))
    points = F.flatten(F.flatten(F.transform("d.trk", lambda t: F.transform(t["trkseg"], lambda s: s["trkpt"]))))
    return _numbered(rows, points, "_lat", "_lon", "ele", "time", F.col("d._creator").alias("creator"), F.col("d.trk")[0]["name"].alias("name"))


def read_tcx(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Points of the first track of each lap."""
    value = F.regexp_replace("value", r"\sxmlns(:\w+)?=\"[^\"]*\"", "")
    rows = _files(spark, path).select("file", F.from_xml(value, F.lit(_TCX)).alias("d"))
    laps = F.flatten(F.transform("d.Activities.Activity", lambda a: a["Lap"]))
    points = F.flatten(F.transform(laps, lambda lap: lap["Track"][0]["Trackpoint"]))
    flat = F.transform(points, lambda p: F.struct(p["Position"]["LatitudeDegrees"].alias("lat"), p["Position"]["LongitudeDegrees"].alias("lon"), p["AltitudeMeters"].alias("ele"), p["Time"].alias("time")))
    return _numbered(rows, flat, "lat", "lon", "ele", "time", F.col("d.Activities.Activity")[0]["_Sport"].alias("sport"))


def read_geojson(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Points of the LineString and MultiLineString features of a file; others are left out."""
    features = F.coalesce(F.from_json(F.get_json_object("value", "$.features"), f"array<struct<{_fields(_FEATURE)}>>"), F.array(F.from_json("value", _FEATURE)))
    rows = _files(spark, path).select("file", F.filter(features, lambda f: f["geometry"]["type"].isin("LineString", "MultiLineString")).alias("f"))
    lines = lambda g: F.when(g["type"] == "LineString", F.array(F.from_json(g["coordinates"], "array<array<double>>"))).otherwise(F.from_json(g["coordinates"], "array<array<array<double>>>"))
    points = F.flatten(F.flatten(F.transform("f", lambda f: lines(f["geometry"]))))
    flat = F.transform(points, lambda c: F.struct(F.get(c, F.lit(1)).alias("lat"), F.get(c, F.lit(0)).alias("lon"), F.get(c, F.lit(2)).alias("ele"), F.lit(None).cast("string").alias("time")))
    return _numbered(rows, flat, "lat", "lon", "ele", "time", F.col("f")[0]["properties"]["name"].alias("name"))


def _fields(ddl: str) -> str:
    """Fields of a schema text as a struct's."""
    return re.sub(r"(^|, )(\w+) (string|struct)", r"\1\2:\3", ddl)


def read_kml(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Points of every placemark's coordinates."""
    value = F.regexp_replace("value", r"\sxmlns(:\w+)?=\"[^\"]*\"", "")
    rows = _files(spark, path).select("file", F.from_xml(value, F.lit(_KML)).alias("d"))
    texts = F.transform("d.Document.Placemark", lambda p: F.coalesce(p["LineString"]["coordinates"], p["Point"]["coordinates"], F.lit("")))
    tuples = F.filter(F.flatten(F.transform(texts, lambda t: F.split(F.trim(t), r"\s+"))), lambda t: t != "")
    part = lambda t, i: F.try_to_number(F.get(F.split(t, ","), F.lit(i)), F.lit("S999999999D999999999999")).cast("double")
    flat = F.transform(tuples, lambda t: F.struct(part(t, 1).alias("lat"), part(t, 0).alias("lon"), part(t, 2).alias("ele"), F.lit(None).cast("string").alias("time")))
    return _numbered(rows, flat, "lat", "lon", "ele", "time", F.element_at("d.Document.Placemark", -1)["name"].alias("name"))


READERS = {"gpx": read_gpx, "tcx": read_tcx, "json": read_geojson, "geojson": read_geojson, "kml": read_kml}


def read_tracks(spark: SparkSession, path: str) -> DataFrame:
    """Points of a file or glob by its extension; of an unknown one no point, but a row with the error."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind not in READERS:
        return spark.createDataFrame([(path, f"unknown track format: {kind}")], "file string, error string")
    return READERS[kind](spark, path)


#: Range of elevations where bounds name none.
ELEVATIONS = (-500.0, 9000.0)


def parse_tracks(spark: SparkSession, path: str | DataFrame, bounds: dict[str, tuple[float, float]] | None = None, tolerance: float = 1e-6, kind: str | None = None) -> DataFrame:
    """Points of a file or glob (of a kind, or by its extension) as a track is taken over: those within bounds (latitude, longitude, elevation; only if they are given), without points that repeat the last one kept. point_index is the file's.

    Unknown elevations are in bounds; rows with an error and no point stay.
    """
    from trekframe.operators.tracks import drop_near_last_kept

    rows = READERS[kind](spark, path) if kind else read_tracks(spark, path)
    if "latitude" not in rows.columns:
        return rows
    if bounds:
        lat, lon, ele = bounds.get("latitude", (-90.0, 90.0)), bounds.get("longitude", (-180.0, 180.0)), bounds.get("elevation", ELEVATIONS)
        inside = F.col("latitude").between(*lat) & F.col("longitude").between(*lon) & (F.col("altitude").isNull() | F.col("altitude").between(*ele))
        rows = rows.where(F.col("latitude").isNull() | F.col("longitude").isNull() | inside)
    kept = drop_near_last_kept(rows.withColumn("track_id", F.col("file")), tolerance).withColumnRenamed("track_id", "file")
    unknown = rows.where("latitude is null or longitude is null")
    return rows.join(kept, ["file", "point_index"]).unionByName(unknown)


def read_gpx_lenient(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Points of files that are hardly GPX: any element whose name holds "trkpt" and that has lat and lon, the first element whose name holds "name", elevations (an empty one is 0) and times as they are written.

    file, name, point_index, latitude, longitude, altitude, ts (text), error; a file without such points gives a row with an error.
    """
    point = r"(?is)<(?:\w+:)?\w*trkpt\w*\b([^>]*?)(?:/>|>(.*?)</(?:\w+:)?\w*trkpt\w*\s*>)"
    attribute = lambda tag: F.try_to_number(F.regexp_extract(F.col("p.a"), rf"\b{tag}\s*=\s*[\"']\s*([-+]?[0-9.]+)", 1), F.lit("S999999999D999999999999")).cast("double")
    inner = lambda tag: F.regexp_extract(F.col("p.b"), rf"(?is)<(?:\w+:)?\w*{tag}\w*\b[^>]*>([^<]*)<", 1)
    has = lambda tag: F.col("p.b").rlike(rf"(?is)<(?:\w+:)?\w*{tag}\w*\b")
    rows = _files(spark, path)
    name = F.nullif(F.regexp_extract("value", r"(?is)<(?:\w+:)?\w*name\w*\b[^>]*>([^<]*)<", 1), F.lit(""))
    pairs = F.arrays_zip(F.regexp_extract_all("value", F.lit(point), F.lit(1)).alias("a"), F.regexp_extract_all("value", F.lit(point), F.lit(2)).alias("b"))
    usable = F.filter(pairs, lambda x: x["a"].rlike(r"\blat\s*=\s*[\"'][^\"']") & x["a"].rlike(r"\blon\s*=\s*[\"'][^\"']"))
    points = rows.select("file", name.alias("name"), F.posexplode_outer(usable).alias("point_index", "p"))
    ele = F.when(has("ele"), F.coalesce(F.try_to_number(F.trim(inner("ele")), F.lit("S999999999D999999999999")).cast("double"), F.lit(0.0)))
    return points.select("file", "name", "point_index", attribute("lat").alias("latitude"), attribute("lon").alias("longitude"), ele.alias("altitude"), F.when(has("time"), inner("time")).alias("ts"), F.when(F.col("point_index").isNull(), "no points").alias("error"))


def _iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def _usable() -> Column:
    return F.coalesce(F.col("latitude").between(-90, 90) & F.col("longitude").between(-180, 180), F.lit(False))


def _ordered(points: DataFrame) -> DataFrame:
    """track_id, pts: points in order, of tracks whose coordinates are all in range."""
    tracks = points.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("point_index", "latitude", "longitude", "altitude", F.col("event_ts").alias("ts")))).alias("pts"), F.bool_and(_usable()).alias("usable"))
    return tracks.where("usable")


def gpx_documents(points: DataFrame) -> DataFrame:
    """track_id, doc: a GPX 1.1 document a track."""
    one = lambda p: F.concat(F.format_string('<trkpt lat="%.8f" lon="%.8f">', p["latitude"], p["longitude"]), F.when(p["altitude"].isNull(), "").otherwise(F.format_string("<ele>%.2f</ele>", p["altitude"])), F.coalesce(F.concat(F.lit("<time>"), _iso(p["ts"]), F.lit("</time>")), F.lit("")), F.lit("</trkpt>"))
    head = F.concat(F.lit('<gpx version="1.1" creator="trekframe" xmlns="http://www.topografix.com/GPX/1/1"><trk><name>'), F.col("track_id"), F.lit("</name><trkseg>"))
    return _ordered(points).select("track_id", F.concat(head, F.array_join(F.transform("pts", one), ""), F.lit("</trkseg></trk></gpx>")).alias("doc"))


def sport(activity: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in SPORTS.items() for x in kv]), F.lower(activity)), F.lit("Other"))


def tcx_documents(points: DataFrame, activity: str = "hiking") -> DataFrame:
    """track_id, doc: a TCX document a track."""
    one = lambda p: F.concat(F.lit("<Trackpoint><Time>"), _iso(p["ts"]), F.lit("</Time>"), F.format_string("<Position><LatitudeDegrees>%.8f</LatitudeDegrees><LongitudeDegrees>%.8f</LongitudeDegrees></Position>", p["latitude"], p["longitude"]), F.when(p["altitude"].isNull(), "").otherwise(F.format_string("<AltitudeMeters>%.2f</AltitudeMeters>", p["altitude"])), F.lit("</Trackpoint>"))
    start, end = F.col("pts")[0]["ts"], F.element_at("pts", -1)["ts"]
    total = F.unix_timestamp(end.cast("timestamp")) - F.unix_timestamp(start.cast("timestamp"))
    head = F.concat(F.lit('<TrainingCenterDatabase xmlns="http://www.garmin.com/xmlschemas/TrainingCenterDatabase/v2"><Activities><Activity Sport="'), sport(F.lit(activity)), F.lit('"><Lap StartTime="'), _iso(start), F.lit('"><TotalTimeSeconds>'), total.cast("string"), F.lit("</TotalTimeSeconds><DistanceMeters>0</DistanceMeters><Track>"))
    return _ordered(points).select("track_id", F.concat(head, F.array_join(F.transform("pts", one), ""), F.lit("</Track></Lap></Activity></Activities></TrainingCenterDatabase>")).alias("doc"))


def geojson_documents(points: DataFrame) -> DataFrame:
    """track_id, doc: a FeatureCollection with one LineString a track."""
    at = lambda p: F.array_compact(F.array(F.round(p["longitude"], 8), F.round(p["latitude"], 8), F.round(p["altitude"], 2)))
    geometry = F.struct(F.lit("LineString").alias("type"), F.transform("pts", at).alias("coordinates"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.col("track_id").alias("name")).alias("properties"), geometry.alias("geometry"))
    return _ordered(points).select("track_id", F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), F.array(feature).alias("features"))).alias("doc"))


def kml_documents(points: DataFrame) -> DataFrame:
    """track_id, doc: a KML document with one LineString a track; unknown altitudes are left out."""
    at = lambda p: F.concat(F.format_string("%.8f,%.8f", p["longitude"], p["latitude"]), F.when(p["altitude"].isNull(), "").otherwise(F.format_string(",%.2f", p["altitude"])))
    head = F.concat(F.lit('<kml xmlns="http://www.opengis.net/kml/2.2"><Document><Placemark><name>'), F.col("track_id"), F.lit("</name><LineString><coordinates>"))
    return _ordered(points).select("track_id", F.concat(head, F.array_join(F.transform("pts", at), " "), F.lit("</coordinates></LineString></Placemark></Document></kml>")).alias("doc"))


WRITERS = {"gpx": gpx_documents, "tcx": tcx_documents, "geojson": geojson_documents, "kml": kml_documents}


def export_tracks(points: DataFrame, path: str, formats: list[str]) -> DataFrame:
    """Writes every track in each format, a folder a format and a folder a track in it; track_id, format and whether it was written (tracks with coordinates out of range aren't, nor unknown formats)."""
    tracks, out = materialised(points.groupBy("track_id").agg(F.bool_and(_usable()).alias("usable"))), None
    for kind in formats:
        if kind in WRITERS:
            write_documents(WRITERS[kind](points), f"{path}/{kind}")
        rows = tracks.select("track_id", F.lit(kind).alias("format"), (F.col("usable") & F.lit(kind in WRITERS)).alias("ok"))
        out = rows if out is None else out.unionByName(rows)
    return out


#: What Spark writes as %XX in the name of a partition's folder.
_ESCAPED = re.compile(r"[\x01-\x1f\"#%'*/:=?\\\x7f{\[\]^]")


def write_documents(docs: DataFrame, path: str) -> None:
    """A text file tree with a folder a track; docs has a row a track.

    In a mounted file system tasks write the files themselves, each under another
    name first, so that a task may run twice: Hadoop's local one starts processes
    for the mode of every file, which takes longer than all else. The tree is that
    of Spark's writer, which does it in other file systems.
    """
    spark = docs.sparkSession
    top = spark._jvm.org.apache.hadoop.fs.Path(path)
    if top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getUri().getScheme() != "file":
        docs.select(F.col("doc").alias("value"), "track_id").write.partitionBy("track_id").text(path)
        return
    folder = top.toUri().getPath()
    os.makedirs(folder)
    ship(spark)

    def run(batches):
        part, n = f"part-{TaskContext.get().partitionId():05d}.txt", 0
        for batch in batches:
            for track, doc in zip(*(c.to_pylist() for c in batch.columns)):
                name = _ESCAPED.sub(lambda m: f"%{ord(m[0]):02X}", track) if track else "__HIVE_DEFAULT_PARTITION__"
                os.makedirs(f"{folder}/track_id={name}", exist_ok=True)
                held = f"{folder}/track_id={name}/.{part}-{uuid.uuid4().hex}"
                with open(held, "w", encoding="utf-8", newline="") as out:
                    out.write(f"{doc or ''}\n")
                os.replace(held, f"{folder}/track_id={name}/{part}")
                n += 1
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    docs.select("track_id", "doc").mapInArrow(run, "n long").agg(F.sum("n")).collect()
    open(f"{folder}/_SUCCESS", "w").close()


def pack_documents(docs: DataFrame, path: str) -> None:
    """All documents in few Parquet files, named as in the tree: a file system takes some milliseconds for every small file, whatever it holds."""
    spark = docs.sparkSession
    parts = max(2 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))  # so that all cores parse
    docs.select(F.col("doc").alias("value"), F.concat(F.lit("track_id="), "track_id").alias("file")).repartition(parts, "file").write.parquet(path)


def packed_documents(spark: SparkSession, path: str) -> DataFrame:
    """value and file of packed documents, as the readers take them in place of a path."""
    return spark.read.schema("value string, file string").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)
