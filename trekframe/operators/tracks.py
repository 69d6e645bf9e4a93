"""Operators over ordered tracks: windows partitioned by track and ordered by point."""

from __future__ import annotations

import math
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from trekframe.functions import geo
from trekframe.sources.bridge import seconds
from trekframe.sources.shared import ship


def in_order() -> WindowSpec:
    return Window.partitionBy("track_id").orderBy("point_index")


def before() -> WindowSpec:
    return in_order().rowsBetween(Window.unboundedPreceding, -1)


def after() -> WindowSpec:
    return in_order().rowsBetween(1, Window.unboundedFollowing)


def _step(points: DataFrame, ahead: bool = True, radius: float = geo.R_MEAN) -> DataFrame:
    """points with other_* of the next (or previous) point and the distance to it."""
    at = F.lead if ahead else F.lag
    rows = points.withColumns({f"other_{c}": at(c).over(in_order()) for c in ("latitude", "longitude", "altitude", "event_ts", "date") if c in points.columns})
    return rows.withColumn("distance", geo.haversine(F.col("latitude"), F.col("longitude"), F.col("other_latitude"), F.col("other_longitude"), radius))


def gps_anomalies(points: DataFrame, noise_km: float = 0.01, speed_kmh: float = 50.0, clock: str = "date") -> DataFrame:
    """track_id, position, anomaly_type, km, hours: close pairs (noise) and fast pairs, by whole days or by event time."""
    rows = _step(points).withColumn("position", F.row_number().over(in_order()) - 1)
    hours = F.datediff("other_date", "date") * 24.0 if clock == "date" else (seconds("other_event_ts") - seconds("event_ts")) / 3600
    rows = rows.withColumn("km", F.col("distance") / 1000).withColumn("hours", hours).where("hours > 0 and km is not null")
    kinds = F.array_compact(F.array(F.when(F.col("km") < noise_km, "gps_noise"), F.when(F.col("km") / F.col("hours") > speed_kmh, "excessive_speed")))
    return rows.select("track_id", "position", F.explode(kinds).alias("anomaly_type"), "km", "hours")


def planar_noise(points: DataFrame, degrees: float = 1e-4) -> DataFrame:
    """points with noise: the next point is closer than so many degrees in the plane."""
    rows = points.withColumns({"nlat": F.lead("latitude").over(in_order()), "nlon": F.lead("longitude").over(in_order())})
    d = F.sqrt(F.pow(F.col("nlat") - F.col("latitude"), 2) + F.pow(F.col("nlon") - F.col("longitude"), 2))
    return rows.withColumn("noise", F.coalesce(d < degrees, F.lit(False))).drop("nlat", "nlon")


def speed_violations(points: DataFrame, max_kmh: float = 50.0) -> DataFrame:
    """points with violation: the way to the next point is faster than max_kmh by event time."""
    rows = _step(points)
    dt = seconds("other_event_ts") - seconds("event_ts")
    fast = (dt > 0) & (F.col("distance") / dt * 3.6 > max_kmh)
    return rows.withColumn("violation", F.coalesce(fast, F.lit(False))).select(*points.columns, "violation")


def close_points(points: DataFrame, metres: float = 1.0) -> DataFrame:
    """points with close: nearer than so many metres to the point before."""
    rows = _step(points, ahead=False)
    return rows.withColumn("close", F.coalesce(F.col("distance") < metres, F.lit(False))).select(*points.columns, "close")


def interpolate_linear(points: DataFrame, flag: Column, columns: tuple[str, ...] = ("latitude", "longitude")) -> DataFrame:
    """Flagged rows between two unflagged ones get values on the line between them, by position; others stay."""
    rows = points.withColumns({"_bad": F.coalesce(flag, F.lit(False)), "_i": F.row_number().over(in_order())})
    good = F.when(~F.col("_bad"), F.struct("_i", *columns))
    rows = rows.withColumns({"_p": F.last(good, ignorenulls=True).over(before()), "_n": F.first(good, ignorenulls=True).over(after())})
    share = (F.col("_i") - F.col("_p._i")) / (F.col("_n._i") - F.col("_p._i"))
    fix = F.col("_bad") & F.col("_p").isNotNull() & F.col("_n").isNotNull()
    fixed = {c: F.when(fix, F.col(f"_p.{c}") + share * (F.col(f"_n.{c}") - F.col(f"_p.{c}"))).otherwise(F.col(c)) for c in columns}
    return rows.withColumns(fixed | {"is_fixed": fix}).drop("_bad", "_i", "_p", "_n")


def interpolate_spline(points: DataFrame, flag: Column) -> DataFrame:
    """Flagged coordinates from a not-a-knot cubic spline through the track's unflagged ones; tracks with fewer than four of those stay as they are."""
    import numpy as np
    import pandas as pd

    ship(points.sparkSession)
    rows = points.withColumn("_bad", F.coalesce(flag, F.lit(False)))

    def spline(x: np.ndarray, y: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The end moments follow from the next two (not-a-knot), which leaves a tridiagonal system: one sweep down, one up."""
        h, n = np.diff(x), len(x)
        low, mid, up = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy()
        rhs = 6 * (np.diff(y[1:]) / h[1:] - np.diff(y[:-1]) / h[:-1])
        mid[0] += h[0] * (h[0] + h[1]) / h[1]
        up[0] -= h[0] ** 2 / h[1]
        mid[-1] += h[-1] * (h[-1] + h[-2]) / h[-2]
        low[-1] -= h[-1] ** 2 / h[-2]
        for i in range(1, n - 2):
            share = low[i] / mid[i - 1]
            mid[i] -= share * up[i - 1]
            rhs[i] -= share * rhs[i - 1]
        m = np.zeros(n)
        m[n - 2] = rhs[-1] / mid[-1]
        for i in range(n - 4, -1, -1):
            m[i + 1] = (rhs[i] - up[i] * m[i + 2]) / mid[i]
        m[0] = ((h[0] + h[1]) * m[1] - h[0] * m[2]) / h[1]
        m[-1] = ((h[-1] + h[-2]) * m[-2] - h[-1] * m[-3]) / h[-2]
        k = np.clip(np.searchsorted(x, at) - 1, 0, n - 2)
        left, right = x[k + 1] - at, at - x[k]
        return (m[k] * left**3 + m[k + 1] * right**3) / (6 * h[k]) + (y[k] / h[k] - m[k] * h[k] / 6) * left + (y[k + 1] / h[k] - m[k + 1] * h[k] / 6) * right

    def fix(track: pd.DataFrame) -> pd.DataFrame:
        track = track.sort_values("point_index").reset_index(drop=True)
        for c in ("latitude", "longitude"):
            ok = np.flatnonzero(~track["_bad"].to_numpy() & track[c].notna().to_numpy())
            bad = np.flatnonzero(track["_bad"].to_numpy())
            if len(ok) >= 4 and len(bad):
                track.loc[bad, c] = spline(ok.astype(float), track[c].to_numpy(float)[ok], bad.astype(float))
        return track

    return rows.groupBy("track_id").applyInPandas(fix, rows.schema).drop("_bad")


def _series(points: DataFrame, column: str) -> DataFrame:
    """One row a track: its known values in order, with their point_index."""
    known = points.where(F.col(column).isNotNull())
    return known.groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("point_index", F.col(column).alias("v")))).alias("s"))


def _carried(rows: DataFrame, order: list[str], schema: str, make: Callable[[], Callable], filters: bool = False) -> DataFrame:
    """A sequential filter over tracks: rows sorted by track and order inside partitions go through it in Arrow batches of many tracks, and what it knows of a track is carried over to the next batch, so a track may have any length.

    rows: track_id, point_index, and values. make() gives a function of
    (whether a track begins, values...) for each row, with a state of its own;
    its result is the value of the row, or with ``filters`` whether it stays.
    """
    ship(rows.sparkSession)

    def run(batches):
        step, track, begun = make(), None, False
        for batch in batches:
            out = []
            for at, *values in zip(*(batch.column(i).to_pylist() for i in (0, *range(2, batch.num_columns)))):
                first = not begun or at != track
                track, begun = at, True
                out.append(step(first, *values))
            if filters:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["track_id", "point_index"]).filter(pa.array(out, pa.bool_()))
            else:
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.float64())], names=["track_id", "point_index", "value"])

    return rows.repartition("track_id").sortWithinPartitions("track_id", *order).mapInArrow(run, schema)


def kalman(points: DataFrame, column: str, q: float = 1e-5, r: float = 1e-4) -> DataFrame:
    """track_id, point_index, value: scalar random-walk Kalman filter of a column's known values, in linear time."""

    def make():
        x, p = 0.0, r

        def step(first: bool, v: float) -> float:
            nonlocal x, p
            if first:
                x, p = v, r
            else:
                gain = (p + q) / (p + q + r)
                x, p = x + gain * (v - x), (1 - gain) * (p + q)
            return x

        return step

    known = points.where(F.col(column).isNotNull()).select("track_id", "point_index", F.col(column).cast("double").alias("value"))
    kinds = {f.name: f.dataType.simpleString() for f in known.schema}
    return _carried(known, ["point_index"], f"track_id {kinds['track_id']}, point_index {kinds['point_index']}, value double", make)


def savitzky_golay(points: DataFrame, column: str) -> DataFrame:
    """track_id, point_index, value: five-point quadratic smoothing of known values, ends by the same fit; shorter tracks stay."""
    inner, edge0, edge1 = (-3, 12, 17, 12, -3), (31, 9, -3, -5, 3), (9, 13, 12, 6, -5)

    def at(v: Column, n: Column, i: Column) -> Column:
        mix = lambda w, first: sum((k / 35.0) * v[first + j] for j, k in enumerate(w))
        ends = F.when(i == 0, mix(edge0, F.lit(0))).when(i == 1, mix(edge1, F.lit(0))).when(i == n - 1, mix(edge0[::-1], n - 5)).when(i == n - 2, mix(edge1[::-1], n - 5))
        return F.when(n < 5, v[i]).otherwise(F.coalesce(ends, mix(inner, i - 2)))

    rows = _series(points, column).withColumn("v", F.transform("s", lambda x: x["v"]))
    n = F.size("v")
    out = F.transform("s", lambda x, i: F.struct(x["point_index"].alias("point_index"), at(F.col("v"), n, i).alias("value")))
    return rows.select("track_id", F.inline(out))


def gaussian_smooth(points: DataFrame, column: str, sigma: float = 1.0, radius: int = 4) -> DataFrame:
    """track_id, point_index, value: Gaussian smoothing with reflected ends."""
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    weights = [w / sum(weights) for w in weights]
    rows = _series(points, column).withColumn("v", F.transform("s", lambda x: x["v"]))
    n = F.size("v")

    def at(i: Column) -> Column:
        def tap(k: int) -> Column:
            j = F.pmod(i + k, 2 * n)
            return F.col("v")[F.when(j < n, j).otherwise(2 * n - 1 - j)]

        return sum(w * tap(k) for w, k in zip(weights, range(-radius, radius + 1)))

    return rows.select("track_id", F.inline(F.transform("s", lambda x, i: F.struct(x["point_index"].alias("point_index"), at(i).alias("value")))))


def drop_near_last_kept(points: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """track_id, point_index of points that differ from the last kept one in latitude or longitude by more than the tolerance, in linear time."""

    def make():
        lat = lon = 0.0

        def step(first: bool, a: float, b: float) -> bool:
            nonlocal lat, lon
            if first or abs(a - lat) > tolerance or abs(b - lon) > tolerance:
                lat, lon = a, b
                return True
            return False

        return step

    known = points.where("latitude is not null and longitude is not null").select("track_id", "point_index", F.col("latitude").cast("double"), F.col("longitude").cast("double"))
    kinds = {f.name: f.dataType.simpleString() for f in known.schema}
    return _carried(known, ["point_index", "latitude", "longitude"], f"track_id {kinds['track_id']}, point_index {kinds['point_index']}", make, filters=True)


def statistics(points: DataFrame) -> DataFrame:
    """One row a track of two points or more: duration, elevation range, gain and loss over known elevations, length and mean speed."""
    last_known = F.last("altitude", ignorenulls=True).over(before())
    rows = _step(points).withColumn("climb", F.col("altitude") - last_known)
    length = F.coalesce(F.sum("distance"), F.lit(0.0))
    seconds_ = seconds(F.max("event_ts")) - seconds(F.min("event_ts"))
    return (
        rows.groupBy("track_id")
        .agg(
            F.count("*").alias("n_points"),
            F.round(seconds_, 2).alias("duration_s"),
            F.min("altitude").alias("min_altitude"),
            F.max("altitude").alias("max_altitude"),
            F.round(F.coalesce(F.sum(F.when(F.col("climb") > 0, F.col("climb"))), F.lit(0.0)), 2).alias("gain_m"),
            F.round(F.coalesce(-F.sum(F.when(F.col("climb") < 0, F.col("climb"))), F.lit(0.0)), 2).alias("loss_m"),
            F.round(length, 2).alias("length_m"),
            F.round(F.when(seconds_ > 0, length / seconds_ * 3.6), 2).alias("mean_kmh"),
        )
        .where("n_points >= 2")
    )


def segment_statistics(points: DataFrame) -> DataFrame:
    """track_id, n_segments, total_m, mean_m, max_m, min_m by ellipsoidal distance."""
    rows = _step(points).withColumn("m", geo.vincenty_inverse(F.col("latitude"), F.col("longitude"), F.col("other_latitude"), F.col("other_longitude")))
    return rows.where("m is not null").groupBy("track_id").agg(F.count("*").alias("n_segments"), *[F.round(f("m"), 3).alias(n) for f, n in ((F.sum, "total_m"), (F.avg, "mean_m"), (F.max, "max_m"), (F.min, "min_m"))])


def slopes(points: DataFrame) -> DataFrame:
    """track_id, gain, loss, max_slope: slope in degrees over the equatorial-radius distance."""
    rows = _step(points, ahead=False, radius=geo.R_EQUATOR).withColumn("climb", F.col("altitude") - F.col("other_altitude"))
    slope = F.when(F.col("distance") > 0, F.degrees(F.atan(F.abs(F.col("climb")) / F.nullif(F.col("distance"), F.lit(0.0)))))
    return rows.groupBy("track_id").agg(F.sum(F.greatest("climb", F.lit(0.0))).alias("gain"), F.sum(F.greatest(-F.col("climb"), F.lit(0.0))).alias("loss"), F.round(F.max(slope), 4).alias("max_slope"))


def transitions(points: DataFrame, column: str = "terrain_type") -> DataFrame:
    """track_id, point_index, value: where a class differs from that of the point before."""
    last = F.lag(column).over(in_order())
    first = F.row_number().over(in_order()) == 1
    return points.withColumn("_t", ~F.col(column).eqNullSafe(last) & ~first).where("_t").select("track_id", "point_index", F.col(column).alias("value"))


def step_frequency(points: DataFrame) -> DataFrame:
    """points with steps: 1.4 for a track's first point, else 1/0.7 where the point moved, 0 where it didn't."""
    rows = _step(points, ahead=False)
    first = F.row_number().over(in_order()) == 1
    return rows.withColumn("steps", F.when(first, 1.4).when(F.col("distance") > 0, 1 / 0.7).otherwise(0.0)).select(*points.columns, "steps")


def elevation_profile(points: DataFrame) -> DataFrame:
    """track_id, lowest, highest and mean altitude, unknown ones as 0."""
    a = F.coalesce("altitude", F.lit(0.0))
    return points.groupBy("track_id").agg(F.min(a).alias("min_altitude"), F.max(a).alias("max_altitude"), F.avg(a).alias("avg_altitude"))


def count_mismatches(points: DataFrame, reference: DataFrame) -> DataFrame:
    """track_id, n, n_reference, error: tracks that are empty or whose number of points isn't the reference track's."""
    n = lambda df, name: df.groupBy("track_id").agg(F.count("*").alias(name))
    both = n(reference, "n_reference").join(n(points, "n"), "track_id", "full").na.fill(0, ["n", "n_reference"])
    error = F.when(F.col("n") == 0, "empty track").when(F.col("n") != F.col("n_reference"), "point count differs")
    return both.select("track_id", "n", "n_reference", error.alias("error")).where("error is not null")


def centroid(points: DataFrame) -> DataFrame:
    """track_id, latitude, longitude, altitude: mean direction of a track's points."""
    p, l = F.radians("latitude"), F.radians("longitude")  # noqa: E741
    m = points.groupBy("track_id").agg(F.avg(F.cos(p) * F.cos(l)).alias("x"), F.avg(F.cos(p) * F.sin(l)).alias("y"), F.avg(F.sin(p)).alias("z"), F.avg("altitude").alias("altitude"))
    return m.select("track_id", F.degrees(F.atan2("z", F.sqrt(F.col("x") ** 2 + F.col("y") ** 2))).alias("latitude"), F.degrees(F.atan2("y", "x")).alias("longitude"), "altitude")


def densify(points: DataFrame, per_segment: int = 10) -> DataFrame:
    """track_id, point_index, k, latitude, longitude: great-circle points on each segment without its last, then the track's last point."""
    known = points.where("latitude is not null and longitude is not null")
    rows = known.withColumns({"nlat": F.lead("latitude").over(in_order()), "nlon": F.lead("longitude").over(in_order())})
    rows = rows.select("track_id", "point_index", "latitude", "longitude", "nlat", geo.haversine(F.col("latitude"), F.col("longitude"), F.col("nlat"), F.col("nlon"), 1.0).alias("sigma"), *[f(F.radians(c)).alias(f"{f.__name__}_{c}") for c in ("latitude", "longitude", "nlat", "nlon") for f in (F.cos, F.sin)])
    # What a segment's points share is worked out once a segment, and each point by itself in compiled code.
    alone = F.col("nlat").isNull() | (F.col("sigma") < 1e-6)
    rows = rows.select("*", alone.alias("alone"), F.explode(F.sequence(F.lit(0), F.when(alone, 0).otherwise(per_segment - 2))).alias("k"))
    f, c = F.col("k") / F.lit(float(per_segment - 1)), F.col
    rows = rows.withColumns({"a": F.try_divide(F.sin((1 - f) * c("sigma")), F.sin("sigma")), "b": F.try_divide(F.sin(f * c("sigma")), F.sin("sigma"))})
    rows = rows.withColumns({
        "x": c("a") * c("cos_latitude") * c("cos_longitude") + c("b") * c("cos_nlat") * c("cos_nlon"),
        "y": c("a") * c("cos_latitude") * c("sin_longitude") + c("b") * c("cos_nlat") * c("sin_nlon"),
        "z": c("a") * c("sin_latitude") + c("b") * c("sin_nlat"),
    })
    there = {"latitude": F.degrees(F.atan2("z", F.sqrt(c("x") * c("x") + c("y") * c("y")))), "longitude": F.degrees(F.atan2("y", "x"))}
    return rows.select("track_id", "point_index", "k", *[F.when(c("alone"), c(n)).otherwise(v).alias(n) for n, v in there.items()])


def extent(points: DataFrame) -> DataFrame:
    """track_id, bounding box, mean centre, count, and the Mercator scale at the mean latitude."""
    agg = [F.min("latitude").alias("lat_min"), F.max("latitude").alias("lat_max"), F.min("longitude").alias("lon_min"), F.max("longitude").alias("lon_max")]
    return points.groupBy("track_id").agg(*agg, F.round(F.avg("latitude"), 6).alias("lat_mean"), F.round(F.avg("longitude"), 6).alias("lon_mean"), F.count("*").alias("n"), F.round(1 / F.cos(F.radians(F.avg("latitude"))), 6).alias("distortion"))
