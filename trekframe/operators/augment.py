"""Synthetic variants: geodetic transforms of tracks, neighbours in feature space, colours of map pixels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trekframe.functions import geo
from trekframe.operators import quality, tracks
from trekframe.sources.shared import materialised, ship

#: Largest rotation (degrees), shift (m), jitter (m) and days.
MOST_ROTATION, MOST_SHIFT, MOST_JITTER, MOST_DAYS = 45.0, 10000.0, 15.0, 30


def uniform(seed: int, *keys: Column) -> Column:
    """Repeatable number in [0, 1) from keys."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), *[k.cast("string") for k in keys]).cast("binary")), 1, 10), 16, 10).cast("double") / float(1 << 40)


def _inside(points: DataFrame) -> DataFrame:
    """Rows of tracks all of whose points lie in the augmentation region."""
    ok = quality.region_errors(points).where("ok").select("track_id")
    return points.join(ok, "track_id", "left_semi")


def shift(points: DataFrame, metres: float, azimuth: float) -> DataFrame:
    """points moved along an azimuth; tracks that leave the region are left out."""
    if abs(metres) > MOST_SHIFT:
        raise ValueError("shift too large")
    moved = points.withColumn("_p", geo.vincenty_direct(F.col("latitude"), F.col("longitude"), F.lit(azimuth), F.lit(float(metres))))
    return _inside(moved.withColumns({"latitude": F.col("_p.latitude"), "longitude": F.col("_p.longitude")}).drop("_p"))


def rotate(points: DataFrame, degrees: float) -> DataFrame:
    """points turned about their track's centroid; tracks that leave the region are left out."""
    if abs(degrees) > MOST_ROTATION:
        raise ValueError("rotation too large")
    centre = tracks.centroid(points).select("track_id", F.col("latitude").alias("_clat"), F.col("longitude").alias("_clon"))
    rows = points.join(centre, "track_id")
    c = (F.col("_clat"), F.col("_clon"), F.col("latitude"), F.col("longitude"))
    moved = geo.vincenty_direct(F.col("_clat"), F.col("_clon"), F.pmod(geo.bearing(*c) + degrees, F.lit(360.0)), geo.haversine(*c, geo.R_EQUATOR))
    rows = rows.withColumn("_p", moved).withColumns({"latitude": F.col("_p.latitude"), "longitude": F.col("_p.longitude")})
    return _inside(rows.select(*points.columns))


def jitter_elevation(points: DataFrame, metres: float = 10.0, seed: int = 42) -> DataFrame:
    """points with altitude plus noise from a three-point moving average with zeros beyond the ends; repeatable."""
    if metres > MOST_JITTER:
        raise ValueError("jitter too large")
    w = tracks.in_order()
    rows = points.withColumn("_u", (uniform(seed, F.col("track_id"), F.col("point_index")) * 2 - 1) * metres)
    smooth = (F.col("_u") + F.coalesce(F.lag("_u").over(w), F.lit(0.0)) + F.coalesce(F.lead("_u").over(w), F.lit(0.0))) / 3
    return rows.withColumn("altitude", F.col("altitude") + smooth).drop("_u")


def shift_days(points: DataFrame, days: int) -> DataFrame:
    if abs(days) > MOST_DAYS:
        raise ValueError("too many days")
    return points.withColumns({"event_ts": F.col("event_ts") + F.make_dt_interval(F.lit(days)), "date": F.date_add("date", days)})


def variants(points: DataFrame, configs: list[tuple[str, str, float, float]]) -> DataFrame:
    """Union of transformed copies, with new track ids {track}_SYN_{suffix}. configs: (kind, suffix, first, second parameter).

    Points are ordered by track once, for all copies: each copy's places and
    noise are columns of the point, whether a copy stays in the region is a
    window's answer, and then the copies are set out. The rows are those of
    ``shift``, ``rotate``, ``jitter_elevation`` and ``shift_days``.
    """
    limits = {"shift": ("shift", MOST_SHIFT), "rotate": ("rotation", MOST_ROTATION), "jitter": ("jitter", MOST_JITTER), "days": ("days", MOST_DAYS)}
    for kind, _, a, _ in configs:
        if (a if kind == "jitter" else abs(a)) > limits[kind][1]:
            raise ValueError(f"{limits[kind][0]} too large")
    if not configs:
        return None
    kinds, track, ordered = {c[0] for c in configs}, Window.partitionBy("track_id"), tracks.in_order()
    lat, lon = F.col("latitude"), F.col("longitude")
    noises = {i: (uniform(int(b), F.col("track_id"), F.col("point_index")) * 2 - 1) * a for i, (kind, _, a, b) in enumerate(configs) if kind == "jitter"}
    rows = points.withColumns({f"_u{i}": u for i, u in noises.items()})
    around = lambda c: (F.col(c) + F.coalesce(F.lag(c).over(ordered), F.lit(0.0)) + F.coalesce(F.lead(c).over(ordered), F.lit(0.0))) / 3
    rows = rows.withColumns({f"_smooth{i}": around(f"_u{i}") for i in noises})
    if "rotate" in kinds:
        p, l = F.radians(lat), F.radians(lon)  # noqa: E741
        rows = rows.withColumns({"_x": F.avg(F.cos(p) * F.cos(l)).over(track), "_y": F.avg(F.cos(p) * F.sin(l)).over(track), "_z": F.avg(F.sin(p)).over(track)})
        rows = rows.withColumns({"_clat": F.degrees(F.atan2("_z", F.sqrt(F.col("_x") ** 2 + F.col("_y") ** 2))), "_clon": F.degrees(F.atan2("_y", "_x"))})
        c = (F.col("_clat"), F.col("_clon"), lat, lon)
        rows = rows.withColumns({"_az": geo.bearing(*c), "_far": geo.haversine(*c, geo.R_EQUATOR)})
    moved = {i: geo.vincenty_direct(lat, lon, F.lit(float(b)), F.lit(float(a))) if kind == "shift" else geo.vincenty_direct(F.col("_clat"), F.col("_clon"), F.pmod(F.col("_az") + a, F.lit(360.0)), F.col("_far")) for i, (kind, _, a, b) in enumerate(configs) if kind in ("shift", "rotate")}
    rows = rows.withColumns({f"_p{i}": p for i, p in moved.items()})
    bad = lambda i: quality.outside(F.col(f"_p{i}.latitude"), quality.REGION_LAT) | quality.outside(F.col(f"_p{i}.longitude"), quality.REGION_LON)
    rows = rows.withColumns({f"_ok{i}": F.bool_and(~bad(i)).over(track) & F.col("track_id").isNotNull() for i in moved})
    touched = [c for c, by in (("latitude", {"shift", "rotate"}), ("longitude", {"shift", "rotate"}), ("altitude", {"jitter"}), ("event_ts", {"days"}), ("date", {"days"})) if kinds & by]

    def changed(i: int, kind: str, days: float, column: str) -> Column:
        own = F.col(column)
        if column in ("latitude", "longitude"):
            return F.col(f"_p{i}.{column}") if i in moved else own.cast("double")
        if column == "altitude":
            return own + F.col(f"_smooth{i}") if kind == "jitter" else own.cast("double")
        if kind != "days":
            return own
        return own + F.make_dt_interval(F.lit(int(days))) if column == "event_ts" else F.date_add(own, int(days))

    each = [F.struct(F.lit(suffix).alias("_suffix"), F.lit(kind).alias("augmentation_type"), (F.col(f"_ok{i}") if i in moved else F.lit(True)).alias("_kept"), *[changed(i, kind, a, c).alias(f"_new_{c}") for c in touched]) for i, (kind, suffix, a, _) in enumerate(configs)]
    rows = rows.select(*points.columns, F.inline(F.array(*each))).where("_kept")
    renamed = {c: F.col(f"_new_{c}") for c in touched} | {"track_id": F.concat("track_id", F.lit("_SYN_"), "_suffix")}
    return rows.select(*[renamed.get(c, F.col(c)).alias(c) for c in points.columns], F.col("track_id").alias("original_track_id"), "augmentation_type")


def balanced(points: DataFrame, stratum: Column, seed: int = 42) -> DataFrame:
    """track_id, stratum: from each stratum as many tracks as the smallest one has, by hash order."""
    rows = points.groupBy("track_id").agg(F.min(stratum).alias("stratum"))
    least = rows.groupBy("stratum").agg(F.count("*").alias("c")).agg(F.min("c").alias("least"))
    ranked = rows.withColumn("_r", F.row_number().over(Window.partitionBy("stratum").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "track_id").cast("binary")), "track_id")))
    return ranked.join(F.broadcast(least)).where("_r <= least").select("track_id", "stratum")  # one row


# Named variants of tracks: kind, parameters, suffix of the new track's name.
PRESETS = {
    "rotation_small": ("rotate", 10.0, 0.0, "ROT10"),
    "rotation_medium": ("rotate", 25.0, 0.0, "ROT25"),
    "shift_north": ("shift", 500.0, 0.0, "SHIFT_N500"),
    "shift_east": ("shift", 500.0, 90.0, "SHIFT_E500"),
    "shift_south": ("shift", 500.0, 180.0, "SHIFT_S500"),
    "elevation_light": ("jitter", 5.0, 42.0, "ELEV5"),
    "elevation_medium": ("jitter", 10.0, 42.0, "ELEV10"),
    "temporal_week": ("days", 7.0, 0.0, "TIME_P7D"),
    "temporal_month": ("days", 30.0, 0.0, "TIME_P30D"),
}
# Variants that are drawn from at random; the last two need times.
STRATEGIES = (
    ("rotate", 5.0, 0.0, "ROT5"),
    ("rotate", -5.0, 0.0, "ROTN5"),
    ("rotate", 10.0, 0.0, "ROT10"),
    ("shift", 200.0, 0.0, "SHIFT_N"),
    ("shift", 200.0, 90.0, "SHIFT_E"),
    ("shift", 200.0, 180.0, "SHIFT_S"),
    ("shift", 150.0, 45.0, "SHIFT_NE"),
    ("jitter", 3.0, 42.0, "ELEV3"),
    ("jitter", 5.0, 42.0, "ELEV5"),
    ("days", 7.0, 0.0, "TIME_P7D"),
    ("days", -7.0, 0.0, "TIME_N7D"),
)
# Variants a track in the named settings.
SETTINGS = {"minimal": 3, "standard": 5, "extensive": 10, "geodetic_only": 5, "visual_heavy": 7}
# Days by which seasonal variants are moved.
SEASON_DAYS = {"spring": (80, 100, 120), "summer": (170, 190, 210), "autumn": (260, 280, 300), "winter": (350, 10, 30)}


def preset_variants(points: DataFrame, names: list[str]) -> DataFrame:
    """Union of the named presets' variants."""
    return variants(points, [(kind, suffix, a, b) for kind, a, b, suffix in (PRESETS[n] for n in names)])


def drawn_strategies(points: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """track_id, place, kind, suffix: n strategies for each track, without replacement, in an order drawn for the track; those that move time only where all points have one."""
    table = F.array(*[F.struct(F.lit(kind).alias("kind"), F.lit(suffix).alias("suffix")) for kind, *_, suffix in STRATEGIES])
    rows = points.groupBy("track_id").agg((F.count("event_ts") == F.count("*")).alias("timed"))
    rows = rows.select("track_id", "timed", F.explode(table).alias("s")).where(F.col("timed") | (F.col("s.kind") != "days"))
    order = Window.partitionBy("track_id").orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), "track_id", "s.suffix").cast("binary")), "s.suffix")
    rows = rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)
    return rows.select("track_id", "place", F.col("s.kind").alias("kind"), F.format_string("%s_%03d", "s.suffix", "place").alias("suffix"))


def drawn_variants(points: DataFrame, n: int, seed: int = 42) -> DataFrame:
    """Every track in n drawn variants: each strategy is applied once, to the tracks that drew it."""
    drawn, out = drawn_strategies(points, n, seed), None
    for kind, a, b, suffix in STRATEGIES:
        mine = drawn.where(F.col("suffix").startswith(suffix + "_") & (F.col("kind") == kind)).select("track_id", F.col("suffix").alias("_suffix"))
        made = variants(points.join(mine.select("track_id"), "track_id", "left_semi"), [(kind, suffix, a, b)])
        made = made.join(mine.withColumnRenamed("track_id", "original_track_id"), "original_track_id").withColumn("track_id", F.concat("original_track_id", F.lit("_SYN_"), "_suffix")).drop("_suffix")
        out = made if out is None else out.unionByName(made)
    return out


def seasonal_variants(tracks_: DataFrame, per_season: int = 3) -> DataFrame:
    """Each track with each season's first per_season day offsets: track_id, variant_id, season, day_offset."""
    table = F.array(*[F.struct(F.lit(s).alias("season"), F.lit(i).alias("i"), F.lit(d).alias("day_offset")) for s, days in SEASON_DAYS.items() for i, d in enumerate(days[:per_season])])
    rows = tracks_.select("track_id", F.explode(table).alias("v"))
    return rows.select("track_id", F.concat_ws("_", "track_id", F.lit("season"), "v.season", F.col("v.i").cast("string")).alias("variant_id"), "v.season", "v.day_offset")


def keep_climb(original: DataFrame, jittered: DataFrame, tolerance: float = 0.1) -> DataFrame:
    """jittered, with altitudes of tracks drawn towards their first one where gain or loss left the original's by more than the tolerance; tracks that became steeper than 89 degrees are left out. Climbs go over known altitudes."""

    def climbs(points: DataFrame, tag: str) -> DataFrame:
        rows = points.where("altitude is not null and latitude is not null")
        rows = tracks._step(rows, ahead=False, radius=geo.R_EQUATOR).withColumn("_c", F.col("altitude") - F.col("other_altitude"))
        slope = F.when(F.col("distance") > 0, F.degrees(F.atan(F.abs("_c") / F.nullif(F.col("distance"), F.lit(0.0)))))
        return rows.groupBy("track_id").agg(F.sum(F.greatest("_c", F.lit(0.0))).alias(f"gain_{tag}"), F.sum(F.greatest(-F.col("_c"), F.lit(0.0))).alias(f"loss_{tag}"), F.max(slope).alias(f"slope_{tag}"), F.min_by("altitude", "point_index").alias(f"first_{tag}"))

    both = climbs(original, "a").join(climbs(jittered, "b"), "track_id")
    gain, loss = F.col("gain_b") / F.greatest("gain_a", F.lit(1.0)), F.col("loss_b") / F.greatest("loss_a", F.lit(1.0))
    kept = gain.between(1 - tolerance, 1 + tolerance) & loss.between(1 - tolerance, 1 + tolerance)
    scale = F.when(F.coalesce(kept, F.lit(True)), 1.0).otherwise((F.col("gain_a") + F.col("loss_a")) / F.nullif(F.col("gain_b") + F.col("loss_b"), F.lit(0.0)))
    plan = both.where(F.coalesce(F.col("slope_b"), F.lit(0.0)) <= 89).select("track_id", F.col("first_a").alias("_first"), scale.alias("_scale"))
    moved = F.when(F.col("_scale") == 1, F.col("altitude")).otherwise(F.col("_first") + (F.col("altitude") - F.col("_first")) * F.col("_scale"))
    return jittered.join(plan, "track_id").withColumn("altitude", moved).drop("_first", "_scale")


def correlation_gap(original: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, both correlations and whether they differ by less than 0.15."""
    from trekframe.operators import stats

    r = lambda df, name: stats.pearson_pairs(df, columns).select("a", "b", F.col("r").alias(name))
    return r(original, "r_original").join(r(synthetic, "r_synthetic"), ["a", "b"]).withColumn("ok", F.abs(F.col("r_original") - F.col("r_synthetic")) < 0.15)


def resampled(rows: DataFrame, id_col: str, n: int, seed: int = 42) -> DataFrame:
    """n draws with replacement: draw and id_col. Ids are numbered in order by range, so no task holds them all."""
    size = rows.count()
    marked = numbered(rows.select(id_col), id_col)
    if not size:
        return marked.select(F.lit(0).cast("long").alias("draw"), id_col).limit(0)
    draws = rows.sparkSession.range(n).select(F.col("id").alias("draw"), F.floor(uniform(seed, F.col("id")) * size).cast("long").alias("place"))
    return draws.join(marked, "place").select("draw", id_col)


def numbered(rows: DataFrame, id_col: str) -> DataFrame:
    """rows with place, 0 for the smallest id: numbers within id ranges, plus the sizes of the ranges before."""
    dealt = materialised(rows.repartitionByRange(id_col).withColumn("_p", F.spark_partition_id()))
    sizes = dealt.groupBy("_p").agg(F.count("*").alias("_n"))
    starts = sizes.withColumn("_start", F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n")).select("_p", "_start")  # a row a range
    place = F.row_number().over(Window.partitionBy("_p").orderBy(id_col)) - 1 + F.col("_start")
    return dealt.join(F.broadcast(starts), "_p").withColumn("place", place.cast("long")).drop("_p", "_start")


def standardised(df: DataFrame, columns: list[str]) -> DataFrame:
    """Columns as z-scores by population deviation; constant columns become 0."""
    stats = df.agg(*[F.struct(F.avg(c).alias("m"), F.stddev_pop(c).alias("s")).alias(f"_{c}") for c in columns])
    rows = df.join(F.broadcast(stats))  # one row
    z = lambda c: F.when(F.col(f"_{c}.s") > 0, (F.col(c) - F.col(f"_{c}.m")) / F.nullif(F.col(f"_{c}.s"), F.lit(0.0))).otherwise(0.0)
    return rows.select(*[z(c).alias(c) if c in columns else F.col(c) for c in df.columns])


def nearest(queries: DataFrame, base: DataFrame, id_col: str, vector: str, k: int = 5, block_rows: int = 50_000) -> DataFrame:
    """query_id, id, distance, rank: the k nearest rows of base for every query, itself left out.

    A stated set of queries meets base in blocks of about block_rows, 16 at least: a block keeps its k best
    of each query (a partial top-k), and these are ranked; the full product is
    never kept or shuffled.
    """
    import numpy as np
    import pyarrow as pa

    ship(queries.sparkSession)
    blocks = max(16, -(-base.count() // block_rows))
    q = queries.select(F.col(id_col).cast("long").alias("query_id"), F.col(vector).cast("array<double>").alias("v")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    r = base.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v")).withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "id": pa.array([], pa.int64()), "distance": pa.array([], pa.float64())})
        x, y = (np.stack(t.column("v").to_numpy(zero_copy_only=False)) for t in (left, right))
        ids, out = right.column("id").to_numpy(), []
        for at in range(0, len(x), 256):
            part = x[at : at + 256]
            d2 = np.stack([((row - y) ** 2).sum(axis=1) for row in part])
            for qid, row in zip(left.column("query_id").to_numpy()[at : at + 256], d2):
                row = np.where(ids == qid, np.inf, row)
                order = np.lexsort((ids, row))[: k]
                out += [(qid, ids[i], float(np.sqrt(row[i]))) for i in order if np.isfinite(row[i])]
        a, b, c = zip(*out) if out else ([], [], [])
        return pa.table({"query_id": pa.array(a, pa.int64()), "id": pa.array(b, pa.int64()), "distance": pa.array(c, pa.float64())})

    found = q.groupBy("b").cogroup(r.groupBy("b")).applyInArrow(best, "query_id long, id long, distance double")
    order = Window.partitionBy("query_id").orderBy(F.round("distance", 9), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def smote(df: DataFrame, id_col: str, vector: str, n: int, k: int = 5, seed: int = 42) -> DataFrame:
    """sample, base_id, neighbour_id, vec: n rows between a random row and one of its k nearest, apart in each dimension; repeatable."""
    order = F.xxhash64(F.lit(seed), F.col(id_col))
    base = df.orderBy(order, id_col).limit(n).select(F.col(id_col), F.col(vector))
    near = nearest(base, df, id_col, vector, k).withColumn("_pick", (uniform(seed + 1, F.col("query_id")) * k).cast("int") + 1).where("rank = _pick")
    x, y = df.select(F.col(id_col).alias("query_id"), F.col(vector).alias("_x")), df.select(F.col(id_col).alias("id"), F.col(vector).alias("_y"))
    mix = F.zip_with("_x", "_y", lambda a, b: F.struct(a.cast("double").alias("a"), b.cast("double").alias("b")))
    vec = F.transform(mix, lambda p, i: p["a"] + uniform(seed + 2, F.col("query_id"), i) * (p["b"] - p["a"]))
    return near.join(x, "query_id").join(y, "id").select(F.col("query_id").alias("base_id"), F.col("id").alias("neighbour_id"), vec.alias("vec"))


def inverse_distance(targets: DataFrame, known: DataFrame, id_col: str, vector: str, value: str, k: int = 5, power: float = 2.0) -> DataFrame:
    """query_id, value: mean of the k nearest known values weighted by 1 / distance ** power."""
    rows = nearest(targets, known, id_col, vector, k).join(known.select(F.col(id_col).alias("id"), F.col(value).cast("double").alias("_v")), "id")
    w = 1 / F.pow(F.greatest("distance", F.lit(1e-12)), F.lit(power))
    return rows.groupBy("query_id").agg((F.sum(w * F.col("_v")) / F.sum(w)).alias("value"))


def compare(original: DataFrame, synthetic: DataFrame, columns: list[str]) -> DataFrame:
    """feature, mean and deviation of both, and whether they differ by less than 20 and 30 percent."""

    def stats(df: DataFrame, tag: str) -> DataFrame:
        pairs = df.select(F.inline(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("v")) for c in columns])))
        return pairs.groupBy("feature").agg(F.avg("v").alias(f"mean_{tag}"), F.stddev_samp("v").alias(f"std_{tag}"))

    rows = stats(original, "a").join(stats(synthetic, "b"), "feature")
    off = lambda k: F.abs(F.col(f"{k}_b") - F.col(f"{k}_a")) / F.greatest(F.abs(F.col(f"{k}_a")), F.lit(1e-9))
    return rows.withColumns({"mean_ok": off("mean") < 0.2, "std_ok": off("std") < 0.3})


# ---- map pixels (img, r, g, b)


def _byte(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(c))).cast("int")


def brightness(pixels: DataFrame, factor: float) -> DataFrame:
    """Blend with black."""
    return pixels.withColumns({c: _byte(F.col(c) * factor) for c in "rgb"})


def contrast(pixels: DataFrame, factor: float) -> DataFrame:
    """Blend with the image's mean grey."""
    luma = F.floor((F.col("r") * 299 + F.col("g") * 587 + F.col("b") * 114) / 1000.0)
    means = pixels.groupBy("img").agg(F.floor(F.avg(luma) + 0.5).alias("_grey"))
    return pixels.join(means, "img").withColumns({c: _byte(F.col("_grey") + factor * (F.col(c) - F.col("_grey"))) for c in "rgb"}).drop("_grey")


def saturation(pixels: DataFrame, factor: float) -> DataFrame:
    """Blend with each pixel's own grey."""
    grey = F.floor((F.col("r") * 299 + F.col("g") * 587 + F.col("b") * 114) / 1000.0)
    return pixels.withColumn("_grey", grey).withColumns({c: _byte(F.col("_grey") + factor * (F.col(c) - F.col("_grey"))) for c in "rgb"}).drop("_grey")


def fog(pixels: DataFrame, intensity: float) -> DataFrame:
    """Blend with white by intensity; nothing below 0.05."""
    if intensity < 0.05:
        return pixels
    alpha = int(intensity * 200) / 255.0
    return pixels.withColumns({c: _byte(F.col(c) * (1 - alpha) + 255 * alpha + 0.5) for c in "rgb"})
