"""The streaming speed check in many batches against the batch query, and that its state ends."""

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from trekframe.operators import tracks
from trekframe.sources.bridge import track_points
from trekframe.streaming import tracks as streams


def run(spark, tmp_path, frames, make, tag):
    """Rows of a stream that gets one file a batch."""
    folder = f"{tmp_path}/{tag}"
    import os

    os.makedirs(folder)
    schema = frames[0].schema
    for i, f in enumerate(frames):
        f.coalesce(1).write.parquet(f"{folder}/tmp{i}")
        part = next(x for x in os.listdir(f"{folder}/tmp{i}") if x.endswith(".parquet"))
        os.rename(f"{folder}/tmp{i}/{part}", f"{folder}/batch-{i:03d}.parquet")
        os.utime(f"{folder}/batch-{i:03d}.parquet", (1_700_000_000 + i, 1_700_000_000 + i))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "batch-*").parquet(folder)
    q = make(stream).writeStream.format("memory").queryName(f"out_{tag}").outputMode("append").option("checkpointLocation", f"{folder}-state").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return spark.table(f"out_{tag}").collect(), q


def ending(spark, points, days=60):
    """A point of another track far ahead, so that the watermark passes all others, and one more batch for the timers."""
    end = points.agg(F.max("event_ts").alias("t"))
    late = lambda k: end.select(F.lit("~end").alias("track_id"), F.lit(-k).cast("int").alias("point_index"), (F.col("t") + F.expr(f"make_interval(0, 0, 0, {days + k})")).alias("event_ts"), F.lit(1.0).alias("latitude"), F.lit(1.0).alias("longitude"), F.lit(-k).cast("long").alias("event_id"))
    return [late(1), late(40)]


def test_many_batches_equal_the_batch_query(spark, sf_dir, tmp_path):
    columns = ["track_id", "point_index", "event_ts", "latitude", "longitude", "event_id"]
    points = track_points(spark, sf_dir).withColumn("event_ts", F.col("event_ts").cast("timestamp")).select(columns)
    days = points.select("*", F.floor(F.unix_timestamp("event_ts") / 86400).alias("d")).cache()
    first = days.agg(F.min("d")).first()[0]
    n = days.agg(F.max("d")).first()[0] - first + 1
    step = max(1, -(-n // 3))
    # Every seventh point comes a batch late, still within the watermark's two days where batches are short enough.
    lateness = F.when((F.col("event_id") % 7 == 0) & F.lit(step <= 1), 1).otherwise(0)
    batch = F.floor((F.col("d") - first) / step) + lateness
    frames = [days.where(batch == i).select(columns) for i in range(-(-n // step) + 2)]
    frames = [f for f in frames if not f.isEmpty()] + ending(spark, points)
    got, q = run(spark, tmp_path, frames, streams.speed_violations, "ordered")
    want = {(r.track_id, r.event_id) for r in tracks.speed_violations(points.withColumn("event_ts", F.col("event_ts").cast("timestamp_ntz"))).where("violation").collect()}
    found = {(r.track_id, r.event_id) for r in got if r.track_id != "~end"}
    assert found == want and len(want) > 5, (len(found), len(want), sorted(want - found), sorted(found - want)[:3])
    # State: of all tracks, only the one that is still within its keep is left.
    assert q.lastProgress["stateOperators"][0]["numRowsTotal"] <= 6


def test_points_out_of_order_and_late(spark, tmp_path):
    at = lambda h: datetime(2024, 1, 1) + timedelta(hours=h)
    rows = lambda *r: spark.createDataFrame([("t", i, at(h), lat, 0.0) for i, h, lat in r], "track_id string, event_id long, event_ts timestamp, latitude double, longitude double")
    frames = [rows((1, 0, 0.0), (4, 3, 0.3)), rows((3, 2, 5.0), (2, 1, 0.1)), rows((9, 2000, 0.0)), rows((10, 2001, 0.0)), rows((11, 4000, 0.0), (5, 4, 9.0))]
    got, _ = run(spark, tmp_path, frames, lambda s: streams.speed_violations(s, late="6 hours"), "shuffled")
    assert {r.event_id for r in got} == {2, 3}, got  # 5 came behind the watermark
    eager, _ = run(spark, tmp_path, frames, lambda s: streams.fast_pairs(s, late="6 hours"), "eager")
    assert {r.event_id for r in eager} == set()  # 3 and 2 came after a later point and are left out
