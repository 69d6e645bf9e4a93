"""The feature record of a point: time, place, weather, terrain, surroundings, movement."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trekframe.functions import geo

# Words by which terrain and object types are grouped.
FOREST = ("forest", "taiga", "deciduous_forest", "coniferous_forest")
WATER = ("water", "lake", "river", "stream", "pond")
OPEN = ("steppe", "tundra", "meadow", "grassland", "field", "farmland")
MOUNTAIN = ("rocks", "cliff", "stone", "mountain", "glacier", "snowfield", "ice")
URBAN = ("settlement", "village", "town", "building", "urban", "park", "road_asphalt", "road_gravel", "road_dirt", "trail", "path")
SHELTERS = ("shelter", "hut", "cabin", "refuge", "hospice")
WATER_OBJECTS = ("water_source", "spring", "well", "river", "stream", "lake", "pond")
LANDMARKS = ("peak", "summit", "pass", "col", "saddle", "ridge")

# Weather codes.
WEATHER_CODES = {
    "01d": "Sunny day",
    "01n": "Clear night",
    "02d": "Partly cloudy day",
    "02n": "Partly cloudy night",
    "03d": "Cloudy day",
    "03n": "Cloudy night",
    "04d": "Overcast day",
    "04n": "Overcast night",
    "09d": "Drizzle day",
    "09n": "Drizzle night",
    "10d": "Rainy day",
    "10n": "Rainy night",
    "11d": "Thunderstorm day",
    "11n": "Thunderstorm night",
    "13d": "Snowy day",
    "13n": "Snowy night",
    "50d": "Fog day",
    "50n": "Fog night",
}


def contains_any(text: Column, words: tuple[str, ...]) -> Column:
    return text.rlike("|".join(words))


def _flag(c: Column) -> Column:
    return c.cast("int")


def temporal(date: Column) -> dict[str, Column]:
    month = F.month(date)
    season = F.when(month.isin(12, 1, 2), "winter").when(month.isin(3, 4, 5), "spring").when(month.isin(6, 7, 8), "summer").when(month.isin(9, 10, 11), "autumn")
    return {
        "T_month": month,
        "T_season": season,
        "T_day_of_week": F.weekday(date),
        "T_day_of_year": F.dayofyear(date),
        "T_year": F.year(date),
        "T_is_winter": _flag(month.isin(12, 1, 2)),
        "T_is_expedition_month": _flag(month.between(6, 8)),
        "T_quarter": F.quarter(date),
    }


def geographic(lat: Column, lon: Column, region: Column) -> dict[str, Column]:
    return {
        "G_latitude": F.round(lat, 6),
        "G_longitude": F.round(lon, 6),
        "G_region": F.coalesce(region, F.lit("Unknown")),
        "G_latitude_band": F.when(lat < 55, "southern").when(lat < 60, "middle").when(lat >= 60, "northern"),
        "G_longitude_band": F.when(lon < 70, "western").when(lon >= 70, "eastern"),
        "G_utm_zone": geo.utm_zone(lon),
        "G_distance_to_pole_km": F.round((90 - lat) * 111.32, 2),
        "G_latitude_sin": F.round(F.sin(F.radians(lat)), 4),
        "G_longitude_sin": F.round(F.sin(F.radians(lon)), 4),
    }


def meteorological(t: Column) -> dict[str, Column]:
    return {
        "M_temperature": F.round(t, 1),
        "M_temperature_class": F.when(t < -15, "very_cold").when(t < -5, "cold").when(t < 5, "cool").when(t < 15, "warm").when(t >= 15, "hot"),
        "M_is_cold": _flag(t < -5),
        "M_is_freezing": _flag(t < 0),
        "M_is_hot": _flag(t > 20),
    }


def terrain(kind: Column, altitude: Column, confidence: Column) -> dict[str, Column]:
    low = F.lower(kind)
    groups = {"forest": FOREST, "water": WATER, "open": OPEN, "mountain": MOUNTAIN, "urban": URBAN}
    return {
        "TR_terrain_type": kind,
        "TR_altitude": F.round(altitude, 1),
        "TR_altitude_class": F.when(altitude < 500, "lowland").when(altitude < 2000, "midland").when(altitude < 5000, "highland").when(altitude >= 5000, "alpine"),
        "TR_terrain_confidence": F.when(confidence != 0, F.round(confidence, 2)),
        **{f"TR_is_{k}": F.coalesce(_flag(contains_any(low, words)), F.lit(0)) for k, words in groups.items()},
    }


def surroundings(objects: Column) -> dict[str, Column]:
    """From an array of structs obj_type, distance_m. Objects at distance 0 count in the number only."""
    objects = F.coalesce(objects, F.array().cast("array<struct<obj_type:string,distance_m:double>>"))
    real = F.filter(objects, lambda o: (o["obj_type"] != "") & (o["distance_m"] != 0))
    count = lambda words: F.size(F.filter(real, lambda o: contains_any(F.lower(o["obj_type"]), words)))
    return {
        "OBJ_count_nearby": F.size(objects),
        "OBJ_shelter_count": count(SHELTERS),
        "OBJ_water_count": count(WATER_OBJECTS),
        "OBJ_landmark_count": count(LANDMARKS),
        "OBJ_has_shelter": _flag(count(SHELTERS) > 0),
        "OBJ_has_water": _flag(count(WATER_OBJECTS) > 0),
        "OBJ_has_landmark": _flag(count(LANDMARKS) > 0),
        "OBJ_nearest_distance_m": F.round(F.array_min(F.transform(real, lambda o: o["distance_m"])), 1),
        "OBJ_poi_density_per_km2": F.round(F.size(objects) / F.lit(math.pi * 0.25), 2),
    }


def collect_objects(objects: DataFrame) -> DataFrame:
    """track_id, event_id, objects: the nearby objects of a point, nearest first; a point has a handful."""
    order = F.array_sort(F.collect_list(F.struct("distance_m", "obj_type")))
    return objects.groupBy("track_id", "event_id").agg(F.transform(order, lambda o: F.struct(o["obj_type"].alias("obj_type"), o["distance_m"].alias("distance_m"))).alias("objects"))


def feature_record(points: DataFrame, objects: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """track_id, point_index and the 41 features with their completeness."""
    rows = points.join(collect_objects(objects), ["track_id", "event_id"], "left")
    region = F.lit(None).cast("string")
    if regions is not None:
        rows = rows.join(regions.select(F.col("r_regionkey").alias("region_key"), F.col("r_name").alias("region")), "region_key", "left")
        region = F.col("region")
    c = F.col
    found = (
        temporal(c("date"))
        | geographic(c("latitude"), c("longitude"), region)
        | meteorological(c("temperature"))
        | terrain(c("terrain_type"), c("altitude"), c("terrain_confidence"))
        | surroundings(c("objects"))
        | {"TJ_step_frequency": F.round("frequency_steps", 4)}
    )
    known = sum((F.col(k).isNotNull().cast("int") for k in found), F.lit(0))
    return rows.select("track_id", "point_index", *[v.alias(k) for k, v in found.items()]).withColumn("Q_data_completeness", F.round(known / float(len(found)), 3))


def classify_point(lat: Column, elevation: Column) -> Column:
    return F.when(elevation > 500, "mountain").when((lat > 40) & (lat < 60), "forest").otherwise("grassland")


def classify_tracks(points: DataFrame) -> DataFrame:
    """track_id, dominant, n_dominant, total: the most frequent class of a track, the one met first on a tie."""
    rows = points.withColumn("cls", classify_point(F.col("latitude"), F.col("altitude")))
    counts = rows.groupBy("track_id", "cls").agg(F.count("*").alias("n"), F.min("point_index").alias("first"))
    best = F.max(F.struct("n", (-F.col("first")).alias("order"), "cls"))
    return counts.groupBy("track_id").agg(best.alias("b"), F.sum("n").alias("total")).select("track_id", F.col("b.cls").alias("dominant"), F.col("b.n").alias("n_dominant"), "total")


# What is known of a terrain class.
TERRAIN_PROPERTIES = {
    "mountain": {"min_elevation": 500.0, "slope_threshold": 10.0},
    "forest": {"vegetation_index": 0.7},
    "grassland": {"vegetation_index": 0.4},
    "urban": {"building_density": 0.5},
    "water": {"water_coverage": 0.8},
}


def terrain_properties(kind: Column) -> Column:
    """Map of a terrain class's properties, empty for others."""
    flat = lambda d: [x for k, v in d.items() for x in (F.lit(k), F.lit(v))]
    table = F.create_map(*[x for k, v in TERRAIN_PROPERTIES.items() for x in (F.lit(k), F.create_map(*flat(v)))])
    return F.coalesce(F.try_element_at(table, kind), F.create_map().cast("map<string,double>"))


def is_yandex_map(text: Column) -> Column:
    """A page, or its path, with the service's name in it, or with one of its drawings."""
    known = F.coalesce(text, F.lit(""))
    return known.contains('<svg class="ymaps-') | F.lower(known).contains("yandex")


def enriched_point(csv_terrain: Column, geocoded: Column, n_objects: Column, region: Column, temperature: Column) -> dict[str, Column]:
    """Terrain with its confidence (a route's own before a geocoded one), source and quality of a point; nothing found makes it unavailable with quality 0.2."""
    found = csv_terrain.isNotNull() | geocoded.isNotNull()
    return {
        "terrain": F.coalesce(csv_terrain, geocoded),
        "terrain_confidence": F.when(csv_terrain.isNotNull(), 0.9).when(geocoded.isNotNull(), 0.75),
        "source": F.when(csv_terrain.isNotNull(), "csv").when(geocoded.isNotNull(), "geocoder"),
        "available": found,
        "quality": F.when(found, quality_score(csv_terrain.isNotNull(), n_objects, region, temperature)).otherwise(0.2),
    }


def enriched_record(rows: DataFrame) -> DataFrame:
    """Enriched points as they are handed on: coordinates to six places, altitude and temperature to one, step frequency to three, confidence and quality to two; a temperature or step frequency of 0 counts as unknown."""
    known = lambda c: F.when(F.col(c) != 0, F.col(c))
    shown = {"latitude": F.round("latitude", 6), "longitude": F.round("longitude", 6), "altitude": F.round("altitude", 1), "temperature": F.round(known("temperature"), 1), "frequency_steps": F.round(known("frequency_steps"), 3), "terrain_confidence": F.round("terrain_confidence", 2), "quality": F.round("quality", 2)}
    return rows.withColumns({c: v for c, v in shown.items() if c in rows.columns})


def with_defaults(points: DataFrame) -> DataFrame:
    """points with the values that stand in for missing keys of a record."""
    return points.withColumns({"track_id": F.coalesce("track_id", F.lit("UNKNOWN")), "date": F.coalesce("date", F.lit("2004-01-01").cast("date")), "latitude": F.coalesce("latitude", F.lit(55.7558)), "longitude": F.coalesce("longitude", F.lit(37.6173))})


def estimated_weather(lat: Column, lon: Column, month: Column) -> dict[str, Column]:
    """Temperature, humidity, pressure, wind, code and description by latitude band, season and longitude."""
    winter, band = month.isin(12, 1, 2), lambda a, b, c, d: F.when(lat > 66, a).when(lat > 60, b).when(lat > 45, c).otherwise(d)
    by = lambda cold, warm: F.when(winter, cold).otherwise(warm)
    code = band(by("13d", "01d"), by("13d", "04d"), F.when(winter | (month == 11), "10d").otherwise("04d"), F.lit("01d"))
    return {
        "temperature": band(by(-15.0, -2.0), by(-8.0, 12.0), by(-2.0, 18.0), by(20.0, 28.0)) + F.pmod(lon, F.lit(30.0)) / 30 * 4.0 - 2.0,
        "humidity": band(F.lit(75), F.lit(70), F.lit(65), F.when(month.between(6, 8), 70).otherwise(55)),
        "pressure": F.lit(1013.0),
        "wind_speed": band(F.lit(6.0), F.lit(4.5), F.lit(3.5), F.lit(2.5)),
        "weather_code": code,
        "weather_description": weather_description(code),
        "confidence": F.lit(0.45),
    }


def weather_description(code: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in WEATHER_CODES.items() for x in pair])
    return F.coalesce(F.try_element_at(table, code), F.lit("Unknown"))


def cache_key(kind: str, *parts: Column) -> Column:
    """MD5 of kind and coordinates to six places (and whatever text follows), bar-separated."""
    shown = [F.format_string("%.6f", p) if i < 2 else p.cast("string") for i, p in enumerate(parts)]
    return F.md5(F.concat_ws("|", F.lit(kind), *shown).cast("binary"))


def quality_score(terrain_known: Column, n_objects: Column, region: Column, temperature: Column) -> Column:
    """Enrichment quality, at most 1; a temperature of exactly 0 earns nothing."""
    base = F.when(terrain_known, 1.0).otherwise(0.8)
    return F.least(F.lit(1.0), base + F.least(F.lit(0.15), n_objects * 0.03) + F.when(region.isNotNull(), 0.05).otherwise(0.0) + F.when(temperature != 0, 0.05).otherwise(0.0))


def rgb_terrain(r: Column, g: Column, b: Column) -> Column:
    """Struct terrain, confidence of a map colour."""
    kind = lambda name, conf: F.struct(F.lit(name).alias("terrain"), F.lit(conf).alias("confidence"))
    green = F.when((g > 200) & (r < 100) & (b < 100), kind("grassland", 0.85)).when((g > 150) & (r > 80) & (b < 100), kind("forest", 0.90)).otherwise(kind("meadow", 0.75))
    return (
        F.when((g > r) & (g > b), green)
        .when((b > r) & (b > g), kind("water", 0.95))
        .when((r > 200) & (g > 200) & (b > 200), kind("glacier", 0.80))
        .when((r > g) & (r > b) & (g < 150) & (b < 150), kind("road_asphalt", 0.70))
        .when((r == g) & (g == b), kind("rocks", 0.75))
        .otherwise(kind("unknown", 0.30))
    )


def region_colours(pixels: DataFrame) -> DataFrame:
    """img, terrain, confidence (share of the winner's votes, weighted by confidence) and mean colour of pixels (img, r, g, b)."""
    rows = pixels.withColumn("t", rgb_terrain(F.col("r"), F.col("g"), F.col("b")))
    votes = rows.groupBy("img", F.col("t.terrain").alias("terrain")).agg(F.sum("t.confidence").alias("votes"))
    best = votes.groupBy("img").agg(F.max(F.struct("votes", "terrain")).alias("b"), F.sum("votes").alias("total"))
    means = rows.groupBy("img").agg(*[F.floor(F.sum(c) / F.count("*")).cast("int").alias(f"mean_{c}") for c in "rgb"])
    return best.join(means, "img").select("img", F.col("b.terrain").alias("terrain"), F.round(F.col("b.votes") / F.col("total"), 6).alias("confidence"), "mean_r", "mean_g", "mean_b")


# Signs of map services in addresses and pages.
URL_SIGNS = {
    "google_maps": (r"maps\.google\.", r"google\.com/maps", "googlemaps", r"maps\.gstatic\.com", r"googleapis\.com.*maps"),
    "yandex_maps": (r"yandex\.", r"yandex\.ru/maps", r"yandex\.com/maps", r"api\.yandex\.com.*maps", r"maps\.yandex\.ru"),
    "openstreetmap": ("openstreetmap", r"osm\.org", "overpass-api", "nominatim", r"mapbox\.com"),
    "stamen_terrain": ("stamen", r"stamen\.com", r"tile\.stamen\.com", r"a\.tile\.openstreetmap"),
}
PAGE_SIGNS = {
    "google_maps": ("google.maps", "google-map", "maps javascript api", "#4285f4", "google.maps.map"),
    "yandex_maps": ("ymaps", "yandex.map", "yandex maps api", "#ff9900", "ymaps.map"),
    "openstreetmap": ("leaflet", "openstreetmap", "osm", "overpass", "nominatim", "l.map"),
    "stamen_terrain": ("stamen", "terrain", "toner", "stamen.com", "tile.stamen.com"),
}


def _best(scores: dict[str, Column], full: float) -> Column:
    """Struct source, confidence of the largest score, the first of them on a tie; null source where all are 0."""
    ranked = F.slice(F.array_sort(F.array(*[F.struct((-scores[k]).alias("minus"), F.lit(i).alias("i"), F.lit(k).alias("source")) for i, k in enumerate(scores)])), 1, 1)
    best = lambda r: F.struct(F.when(r["minus"] < 0, r["source"]).alias("source"), F.least(F.lit(1.0), -r["minus"] / full).alias("confidence"))
    return F.transform(ranked, best)[0]


def map_source_of_url(url: Column) -> Column:
    low = F.lower(url)
    return _best({k: sum((F.coalesce(low.rlike(p), F.lit(False)).cast("int") for p in signs), F.lit(0)) for k, signs in URL_SIGNS.items()}, 3.0)


def map_source_of_html(html: Column) -> Column:
    low = F.lower(F.coalesce(html, F.lit("")))
    count = lambda w: ((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / len(w)).cast("int")
    return _best({k: sum((count(w) for w in signs), F.lit(0)) for k, signs in PAGE_SIGNS.items()}, 5.0)


# Signs of map services in response headers (server, then content type).
HEADER_SIGNS = {
    "google_maps": (("gse", "gws"), ("maps.google.", "googleapis.com")),
    "yandex_maps": (("yandex", "yandexbot"), ("yandex.", "api.yandex.")),
    "openstreetmap": (("apache", "nginx"), ("leaflet", "openstreetmap")),
}


def map_source_of_headers(server: Column, content_type: Column) -> Column:
    s, c = F.lower(F.coalesce(server, F.lit(""))), F.lower(F.coalesce(content_type, F.lit("")))
    score = lambda a, b: sum((s.contains(w).cast("int") for w in a), F.lit(0)) + sum((c.contains(w).cast("int") for w in b), F.lit(0))
    return _best({k: score(*v) for k, v in HEADER_SIGNS.items()}, 2.0)


def map_source_of_colour(r: Column, g: Column, b: Column) -> Column:
    """By the dominant colour of a map image."""
    inside = lambda c, low, high: (c > low) & (c < high)
    return _best(
        {
            "google_maps": F.when(inside(r, 50, 100) & inside(g, 120, 150) & inside(b, 200, 255), 2).otherwise(0),
            "yandex_maps": F.when(inside(r, 200, 255) & inside(g, 120, 170) & inside(b, 0, 50), 2).otherwise(0),
            "openstreetmap": F.when(inside(r, 100, 200) & inside(g, 100, 200) & inside(b, 100, 200), 1).otherwise(0),
        },
        3.0,
    )


def combined_source(*detections: Column) -> Column:
    """Struct source, confidence: the source with the largest sum of confidences, that sum over the number of detections."""
    names = list(URL_SIGNS)
    of = lambda found, k: F.aggregate(F.filter(found, lambda d: d["source"] == k), F.lit(0.0), lambda a, d: a + d["confidence"])
    return F.transform(F.array(F.array(*detections)), lambda found: _best({k: of(found, k) for k in names}, float(len(detections))))[0]


def static_map_url(base: str, lat: Column, lon: Column, zoom: int = 13, width: int = 450, height: int = 450, key: str = "") -> Column:
    return F.concat(F.lit(f"{base}?ll="), lon.cast("string"), F.lit(","), lat.cast("string"), F.lit(f"&z={zoom}&size={width},{height}&l=map&apikey={key}"))
