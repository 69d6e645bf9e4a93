import datetime as dt
import math
import os
import re

import pytest
from pyspark.sql import functions as F

from trekframe.functions import geo
from trekframe.operators import augment, features, fusion, stats, store, tracks
from trekframe.sources import files
from trekframe.sources.bridge import track_points
from trekframe.streaming import tracks as streams

L = F.lit
MOSCOW, PETERSBURG = (55.7558, 37.6173), (59.9311, 30.3609)


def at(*points):
    """Coordinates of points as columns."""
    return [L(x) for p in points for x in p]


def one(spark, *columns):
    return spark.range(1).select(*columns).first()


def test_golden_distances(spark):
    others = (PETERSBURG, (55.7658, 37.6273), (55.7658, 37.6173))
    r = one(spark, *[geo.haversine(*at(MOSCOW, p)) for p in others], *[geo.vincenty_inverse(*at(MOSCOW, p)) for p in others], geo.bearing(*at(MOSCOW, PETERSBURG)), geo.vincenty_inverse(*at(MOSCOW, MOSCOW)), *[geo.vincenty_inverse(*at(MOSCOW, p), legacy=True) for p in others])
    want = (631739.950387, 1275.873485, 1111.949266, 633316.766811, 1278.165013, 1113.374735, 320.261808700550, 0.0, 641212.817562, 1288.067652, 1114.725510)
    assert all(abs(a - b) < 1e-5 for a, b in zip(r, want)), tuple(r)


def test_golden_positions(spark):
    r = one(spark, geo.destination(*at(MOSCOW), L(90.0), L(1000.0)), geo.web_mercator(*at(MOSCOW)), geo.vincenty_direct(L(55.7558), L(120.4356), L(90.0), L(1000.0)), geo.utm_zone(L(37.6173)))
    assert abs(r[0].latitude - 55.755798963178) < 1e-11 and abs(r[0].longitude - 37.633281653264) < 1e-11
    assert abs(r[1].x - 4187538.681018) < 1e-5 and abs(r[1].y - 7509955.142338) < 1e-5
    assert abs(r[2].latitude - 55.755798968032) < 1e-9 and abs(r[2].longitude - 120.451527214615) < 1e-9
    assert r[3] == 37


def test_utm_against_an_independent_point(spark):
    # On a central meridian the easting is 500 km and the northing the scaled meridian arc.
    r = one(spark, geo.utm(L(45.0), L(39.0)))[0]
    assert abs(r.easting - 500000) < 1e-6 and abs(r.northing - 0.9996 * 4984944.378) < 0.01 and r.epsg == 32637


def line(spark, values):
    return spark.createDataFrame([("t", i, float(v)) for i, v in enumerate(values)], "track_id string, point_index int, altitude double")


def test_kalman_golden(spark):
    got = [r.value for r in tracks.kalman(line(spark, [1, 2, 3, 10]), "altitude").orderBy("point_index").collect()]
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, (1.0, 1.523809523810, 2.090909090909, 4.671013633669)))


def test_smoothing_keeps_polynomials(spark):
    got = [r.value for r in tracks.savitzky_golay(line(spark, [x * x - 3 * x for x in range(9)]), "altitude").orderBy("point_index").collect()]
    assert all(abs(a - (x * x - 3 * x)) < 1e-9 for x, a in enumerate(got))
    flat = tracks.gaussian_smooth(line(spark, [7] * 12), "altitude").collect()
    assert all(abs(r.value - 7) < 1e-9 for r in flat)


def test_spline_meets_a_cubic(spark):
    rows = [("t", i, 0.001 * i**3 if i not in (3, 6) else 99.0, float(i)) for i in range(9)]
    df = spark.createDataFrame(rows, "track_id string, point_index int, latitude double, longitude double")
    got = {r.point_index: r.latitude for r in tracks.interpolate_spline(df, F.col("latitude") > 90).collect()}
    assert abs(got[3] - 0.027) < 1e-9 and abs(got[6] - 0.216) < 1e-9


def test_last_kept_is_not_the_previous_row(spark):
    df = spark.createDataFrame([("t", i, 50 + i * 6e-7, 30.0) for i in range(6)], "track_id string, point_index int, latitude double, longitude double")
    assert sorted(r.point_index for r in tracks.drop_near_last_kept(df).collect()) == [0, 2, 4]


def test_gini_and_tails(spark):
    df = spark.createDataFrame([(10,), (20,), (30,), (40,)], "n int")
    assert abs(stats.gini(df, "n").first().gini - 0.25) < 1e-12
    assert abs(stats.t_two_sided(2.0, 10) - 0.07338803477074) < 1e-9
    assert abs(stats.f_upper(3.0, 2, 20) - 1.3**-10) < 1e-12
    assert abs(stats.chi2_upper(3.0, 2) - math.exp(-1.5)) < 1e-12


def test_weather_quirks(spark):
    r = one(spark, *[features.weather_description(L(c)) for c in ("13d", "zz")])
    assert tuple(r) == ("Snowy day", "Unknown")


def test_fusion_strategies(spark):
    v = fusion.votes(L("forest"), L(0.85), L("taiga"), L("forest"), L(0.8))
    r = one(spark, *[fusion.resolve(v, s) for s in ("majority", "average", "csv", "osm", "confidence")])
    assert [x.result.terrain for x in r] == ["forest", "forest", "taiga", "forest", "taiga"]
    assert abs(r[0].result.confidence - 0.825) < 1e-12 and abs(r[1].result.confidence - 0.85) < 1e-12 and r[0].conflict == "minor"


GPX = """<?xml version="1.0"?><gpx version="1.1" creator="unit" xmlns="http://www.topografix.com/GPX/1/1"><trk><name>A</name><trkseg><trkpt lat="55.1" lon="37.2"><ele>100</ele><time>2026-01-15T10:00:00Z</time></trkpt></trkseg>
<trkseg><trkpt lat="55.2" lon="37.3"><ele>110</ele><time>2026-01-15T10:01:00.5Z</time></trkpt><trkpt lat="95" lon="37.3"/></trkseg></trk></gpx>"""
TCX = """<TrainingCenterDatabase xmlns="http://www.garmin.com/xmlschemas/TrainingCenterDatabase/v2"><Activities><Activity Sport="Running"><Lap StartTime="2026-01-15T10:00:00Z">
<Track><Trackpoint><Time>2026-01-15T10:00:00Z</Time><Position><LatitudeDegrees>55.1</LatitudeDegrees><LongitudeDegrees>37.2</LongitudeDegrees></Position><AltitudeMeters>5</AltitudeMeters></Trackpoint><Trackpoint><Time>2026-01-15T10:00:01Z</Time></Trackpoint></Track>
<Track><Trackpoint><Time>2026-01-15T10:00:02Z</Time></Trackpoint></Track></Lap></Activity></Activities></TrainingCenterDatabase>"""
GEOJSON = '{"type":"FeatureCollection","features":[{"type":"Feature","properties":{"name":"N"},"geometry":{"type":"LineString","coordinates":[[37.2,55.1,100],[37.3,55.2]]}},{"type":"Feature","properties":{},"geometry":{"type":"MultiLineString","coordinates":[[[37.4,55.3]],[[37.5,55.4,7.5]]]}},{"type":"Feature","properties":{},"geometry":{"type":"Point","coordinates":[1,2]}}]}'
KML = '<kml xmlns="http://www.opengis.net/kml/2.2"><Document><Placemark><name>a</name><LineString><coordinates>37.2,55.1,10 37.3,55.2</coordinates></LineString></Placemark><Placemark><name>b</name><Point><coordinates>37.5,55.5,1.5</coordinates></Point></Placemark></Document></kml>'


def test_track_files(spark, tmp_path):
    for name, text in (("a.gpx", GPX), ("a.tcx", TCX), ("a.geojson", GEOJSON), ("a.kml", KML)):
        (tmp_path / name).write_text(text)
    read = lambda name: sorted(files.read_tracks(spark, f"{tmp_path}/{name}").collect(), key=lambda r: r.point_index)
    gpx = read("a.gpx")
    assert [(r.latitude, r.longitude, r.altitude, r.error) for r in gpx] == [(55.1, 37.2, 100.0, None), (55.2, 37.3, 110.0, None), (95.0, 37.3, None, "missing or out of range")]
    assert gpx[1].ts == dt.datetime(2026, 1, 15, 10, 1, 0, 500000) and gpx[0].creator == "unit" and gpx[0].name == "A"
    tcx = read("a.tcx")
    assert [(r.latitude, r.altitude, r.error is None, r.sport) for r in tcx] == [(55.1, 5.0, True, "Running"), (None, None, False, "Running")]
    assert [(r.longitude, r.latitude, r.altitude) for r in read("a.geojson")] == [(37.2, 55.1, 100.0), (37.3, 55.2, None), (37.4, 55.3, None), (37.5, 55.4, 7.5)]
    assert [(r.longitude, r.latitude, r.altitude) for r in read("a.kml")] == [(37.2, 55.1, 10.0), (37.3, 55.2, None), (37.5, 55.5, 1.5)]
    assert files.read_tracks(spark, "x.txt").first().error == "unknown track format: txt"


def test_export_round_trip(spark, sf_dir, tmp_path):
    points = track_points(spark, sf_dir).where("track_id = 'TRACK_3'").where("latitude between -90 and 90 and longitude between -180 and 180")
    for r in files.gpx_documents(points).collect():
        (tmp_path / "t.gpx").write_text(r.doc)
    back = files.read_gpx(spark, f"{tmp_path}/t.gpx").collect()
    assert len(back) == points.count() > 0 and all(r.error is None for r in back)
    files.write_documents(files.tcx_documents(points), f"{tmp_path}/tcx")
    assert spark.read.text(f"{tmp_path}/tcx").count() == 1


def test_csv_scan(spark, tmp_path):
    (tmp_path / "r.csv").write_text("track_id,point_index,date,latitude,longitude,altitude,region,terrain_type,frequency_steps,temperature\na,0,2026-01-17,55.5,37.5,NaN,R,forest,1.5,-3\n")
    r = files.read_csv(spark, f"{tmp_path}/r.csv").first()
    assert r.altitude is None and r.date == dt.date(2026, 1, 17)


def test_store(spark, sf_dir, tmp_path):
    s = store.TrackStore(spark, str(tmp_path))
    points = track_points(spark, sf_dir).select("track_id", "point_index", "date", "latitude").limit(200)
    assert s.add_points(points) == 200 and s.add_points(points) == 0
    s.add_tracks(points)
    fix = points.limit(3).select("track_id", "point_index", F.lit("spline").alias("correction_type"))
    s.correct(fix)
    assert s.read("points").where("is_corrected and version = 2").count() == 3 and s.read("points").count() == 200
    ids = [r.track_id for r in s.read("tracks").limit(2).collect()]
    edges = spark.createDataFrame([(ids[0], ids[1]), (ids[0], "nowhere")], "original_track_id string, augmented_track_id string")
    assert s.add_lineage(edges) == 1 and s.add_lineage(edges) == 0
    m = one(spark, store.merge_metadata(F.create_map(L("a"), L("1"), L("b"), L("2")), F.create_map(L("b"), L("3"))))[0]
    assert m == {"a": "1", "b": "3"}


def test_augmentation_limits(spark, sf_dir):
    points = track_points(spark, sf_dir).where("latitude is not null")
    for call in (lambda: augment.shift(points, 20000, 0), lambda: augment.rotate(points, 90), lambda: augment.jitter_elevation(points, 99), lambda: augment.shift_days(points, 99)):
        with pytest.raises(ValueError):
            call()
    p = points.where("latitude between 50 and 60 and longitude between 30 and 100")
    moved = augment.shift(p, 1000.0, 45.0).select("event_id", F.col("latitude").alias("a"), F.col("longitude").alias("b"))
    d = p.join(moved, "event_id").select(geo.vincenty_inverse(F.col("latitude"), F.col("longitude"), F.col("a"), F.col("b")).alias("d")).agg(F.min("d"), F.max("d")).first()
    assert abs(d[0] - 1000) < 1e-3 and abs(d[1] - 1000) < 1e-3


def test_streams(spark, sf_dir, tmp_path):
    points = track_points(spark, sf_dir).withColumn("event_ts", F.col("event_ts").cast("timestamp"))
    points.repartition(2).write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema(points.schema).parquet(f"{tmp_path}/in")

    def drain(df, mode):
        q = df.writeStream.format("memory").queryName("out").outputMode(mode).option("checkpointLocation", f"{tmp_path}/{mode}-{len(df.columns)}-{df.columns[-1]}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table("out").collect()

    got = {(r.start, r.region_key): r.n for r in drain(streams.window_counts(stream()), "complete")}
    assert got == {(r.start, r.region_key): r.n for r in streams.window_counts(points).collect()}
    fast = {r.event_id for r in drain(streams.fast_pairs(stream()), "append")}
    known = points.where("latitude is not null and longitude is not null").withColumn("event_ts", F.col("event_ts").cast("timestamp_ntz"))
    from pyspark.sql import Window

    rows = tracks.speed_violations(known).withColumn("next", F.lead("event_id").over(Window.partitionBy("track_id").orderBy("point_index")))
    assert fast == {r.next for r in rows.where("violation").collect()}
    assert len(drain(streams.without_repeats(stream()), "append")) == points.count()


def test_distribution_tests_against_direct_sums(spark):
    import numpy as np

    from trekframe.operators import distributions

    rng = np.random.default_rng(5)
    x = np.round(rng.normal(50, 10, 400), 1)
    y = np.concatenate([rng.normal(30, 4, 200), rng.normal(70, 4, 200)])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y))], "id long, x double, y double")
    z = (np.sort(x) - x.mean()) / x.std(ddof=1)
    cdf = np.array([0.5 * math.erfc(-v / math.sqrt(2)) for v in z])
    i = np.arange(1, 401)
    a2 = -400 - ((2 * i - 1) * (np.log(cdf) + np.log(1 - cdf[::-1]))).mean()
    got = {r.feature: r for r in distributions.anderson_darling(df, ["x", "y"]).collect()}
    assert abs(got["x"].statistic - a2) < 1e-8 and got["x"].is_normal and not got["y"].is_normal
    w = {r.feature: r for r in distributions.shapiro_wilk(df, ["x", "y"], "id").collect()}
    assert w["x"].p > 0.05 > w["y"].p and w["x"].n == 400
    assert {r.feature: r.n_peaks for r in distributions.kde_peaks(df, ["x", "y"]).collect()}["y"] == 2
    bic = {(r.feature, r.k): r.bic for r in distributions.mixture_bic(df, ["x", "y"]).collect()}
    assert min(range(1, 6), key=lambda k: bic["y", k]) == 2 and bic["x", 1] < bic["x", 3]
    assert {r.feature: r.normal for r in distributions.normal_votes(df, ["x", "y"], "id").collect()} == {"x": True, "y": False}


def test_addresses(spark):
    from trekframe.operators import addresses

    r = one(spark, addresses.terrain_of_address(L("Лес у реки"), L(70)), addresses.terrain_of_address(L("x"), L(70)), addresses.objects_of_address(L("Приют под горой, mountain spring")), addresses.region_of_address(F.create_map(L("state"), L(""), L("country"), L("RU"))), addresses.terrain_name(L("Тайга")), addresses.texture(L("густо лес, скалы")))
    assert tuple(r)[:5] == ("forest", "tundra", ["mountain_peak", "spring", "shelter"], "RU", "taiga")
    assert tuple(r[5]) == (0.2, 0.9, 0.5, 0.8)


def test_track_pipeline(spark, sf_dir, tmp_path):
    from trekframe.plans import track_pipeline
    from trekframe.sources.bridge import point_objects

    points = track_points(spark, sf_dir)
    counts = track_pipeline.run(spark, points, point_objects(spark, sf_dir), str(tmp_path), spark.read.parquet(f"{sf_dir}/region.parquet"))
    assert counts["repaired"] == points.count() and counts["pairs"] == 21 and counts["seasons"] == 4 and counts["variants"] > 0
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv/profile").count() == counts["profile"] == 7
    shelf = store.TrackStore(spark, f"{tmp_path}/store")
    assert shelf.read("points").count() == points.count() and shelf.read("augmentations").count() > 0
    assert track_pipeline.repair(points).where("is_fixed").count() > 0


def test_running_sums_are_the_same_in_any_ranges(spark):
    df = spark.range(5000).select((F.col("id") * 7919 % 1000).cast("double").alias("v"), (F.col("id") % 3).alias("g")).groupBy("g", "v").agg(F.count("*").alias("c"))
    seen = lambda n: sorted(map(tuple, stats.with_upto(df, "v", "c", ("g",), range_rows=n).select("g", "v", "c", "upto").collect()))
    whole = seen(10_000)
    assert whole == seen(50)
    assert max(x[3] for x in whole) == spark.range(5000).where("id % 3 = 0").count()


def test_long_tracks_take_linear_time(spark):
    n = 50_000
    p = spark.range(n).select(F.lit("T").alias("track_id"), F.col("id").cast("int").alias("point_index"), F.sin(F.col("id") / 500.0).alias("latitude"), F.cos(F.col("id") / 500.0).alias("longitude"), (F.col("id") % 7).cast("double").alias("altitude"))
    broken = p.withColumn("latitude", F.when(F.col("point_index") % 10 != 5, F.col("latitude")))
    fixed = tracks.interpolate_spline(broken, F.col("latitude").isNull()).join(p.select("point_index", F.col("latitude").alias("truth")), "point_index")
    assert fixed.agg(F.max(F.abs(F.col("latitude") - F.col("truth")))).first()[0] < 1e-6
    assert tracks.kalman(p, "altitude").count() == n


def test_distances_that_do_not_converge_are_null(spark):
    r = one(spark, geo.vincenty_inverse(L(0.0), L(0.0), L(0.5), L(179.7)), geo.vincenty_inverse(L(0.0), L(0.0), L(0.0), L(90.0)), geo.vincenty_inverse(L(None), L(0.0), L(0.0), L(90.0)))
    assert r[0] is None and abs(r[1] - 10018754.171) < 0.01 and r[2] is None


def test_drawn_variants_carry_their_strategy(spark, sf_dir):
    p = track_points(spark, sf_dir).where("latitude between 43 and 79 and longitude between 21 and 167")
    drawn = {(r.track_id, r.suffix) for r in augment.drawn_strategies(p, 3).collect()}
    made = augment.drawn_variants(p, 3).select("original_track_id", "track_id").distinct().collect()
    assert made and all((r.original_track_id, r.track_id.split("_SYN_")[1]) in drawn for r in made)


def test_neighbours_across_the_date_line_and_around_a_pole(spark):
    from trekframe.operators import lookups

    points = spark.createDataFrame([(1, 10.0, 179.9995), (2, 89.9995, 0.0), (3, -89.9999, 12.0), (4, 50.0, 8.0)], "id long, latitude double, longitude double")
    places = spark.createDataFrame([(11, 10.0, -179.9995), (12, 89.9995, 180.0), (13, -89.9999, -150.0), (14, 50.0, 8.001), (15, 50.0, -172.0)], "place_id long, latitude double, longitude double")
    assert {(r.id, r.place_id) for r in lookups.within_radius(points, places, 200.0).collect()} == {(1, 11), (2, 12), (3, 13), (4, 14)}


def test_sequential_filters_carry_over_batches(spark):
    """One long track and many short ones, in Arrow batches of a few rows: as a plain loop gives them."""
    import numpy as np

    rng = np.random.default_rng(2)
    rows = [("long", i, float(v), float(lat), 1.0) for i, (v, lat) in enumerate(zip(rng.normal(size=20_000), rng.integers(0, 3, 20_000) * 5e-7))]
    rows += [(f"t{k}", i, float(k + i), None if i == 1 else float(i // 2), 2.0) for k in range(50) for i in range(5)] + [("gap", 0, None, 1.0, None)]
    df = spark.createDataFrame(rows, "track_id string, point_index int, v double, latitude double, longitude double").repartition(6)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "70")
    try:
        smooth = {(r.track_id, r.point_index): r.value for r in tracks.kalman(df, "v").collect()}
        kept = {(r.track_id, r.point_index) for r in tracks.drop_near_last_kept(df).collect()}
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    want, stay, last, x, p = {}, set(), {}, {}, {}
    for t, i, v, lat, lon in rows:
        if v is not None:
            if t not in x:
                x[t], p[t] = v, 1e-4
            else:
                g = (p[t] + 1e-5) / (p[t] + 1e-5 + 1e-4)
                x[t], p[t] = x[t] + g * (v - x[t]), (1 - g) * (p[t] + 1e-5)
            want[t, i] = x[t]
        if lat is not None and lon is not None and (t not in last or abs(lat - last[t][0]) > 1e-6 or abs(lon - last[t][1]) > 1e-6):
            last[t] = lat, lon
            stay.add((t, i))
    assert smooth == want and kept == stay
    assert tracks.kalman(df.limit(0), "v").count() == 0


def test_every_correction_raises_the_versions(spark, tmp_path):
    s = store.TrackStore(spark, str(tmp_path))
    points = spark.createDataFrame([("a", i, dt.date(2026, 1, 1)) for i in range(4)] + [("b", 0, dt.date(2026, 1, 1))], "track_id string, point_index int, date date")
    s.add_points(points)
    s.add_tracks(points)
    s.add_anomalies(points.where("point_index < 2").select("track_id", "point_index", F.lit("gps_noise").alias("anomaly_type")))
    fix = lambda *r: spark.createDataFrame(list(r), "track_id string, point_index int, correction_type string")
    s.correct(fix(("a", 1, "spline"), ("a", 3, "spline")))
    s.correct(fix(("a", 1, "spline"), ("nowhere", 0, "spline")))
    history = [(r.track_id, r.version, r.change_type) for r in s.history("a").collect()]
    assert history == [("a", 1, "create"), ("a", 2, "correct"), ("a", 3, "correct"), ("a", 4, "correct")]
    assert {r.track_id: r.version for r in s.read("tracks").collect()} == {"a": 4, "b": 1}
    assert {(r.point_index, r.version) for r in s.read("points").where("track_id = 'a'").collect()} == {(0, 1), (1, 3), (2, 1), (3, 2)}
    assert {(r.track_id, r.point_index): r.is_corrected for r in s.read("anomalies").collect()} == {("a", 0): False, ("a", 1): True, ("b", 0): False}


def test_terrain_names_and_unknown_distances(spark):
    from trekframe.operators import addresses

    assert len(addresses.TERRAIN_TYPES) == 37
    names = spark.createDataFrame([("Болото_верховое",), ("дорога",), ("meadow",), ("",), (None,)], "t string").select(addresses.terrain_name(F.col("t")).alias("n")).collect()
    assert [r.n for r in names] == ["bog", "road_asphalt", "meadow", None, None]
    d = spark.createDataFrame([(1.0, 2.0, None, 3.0)], "a double, b double, c double, d double").select(geo.haversine(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("d")).first()
    assert d.d is None


def test_lenient_reader_and_parsed_tracks(spark, tmp_path):
    odd = '<GPX><metadata><Name>Odd &amp; old</Name></metadata><x:TrkPt lat="55.5" lon=\'37.5\'><ele> </ele><Time>noon</Time></x:TrkPt><trkpt lat="55.6" lon="37.6"/><trkpt lon="1"/><trkpt lat="55.7" lon="-37.7"><name>p</name><ele>12.5</ele></trkpt></GPX>'
    (tmp_path / "odd.gpx").write_text(odd)
    (tmp_path / "none.gpx").write_text("<gpx></gpx>")
    rows = files.read_gpx_lenient(spark, f"{tmp_path}/*.gpx").orderBy("file", "point_index").collect()
    assert [(r.point_index, r.latitude, r.longitude, r.altitude, r.ts, r.error) for r in rows] == [(None, None, None, None, None, "no points"), (0, 55.5, 37.5, 0.0, "noon", None), (1, 55.6, 37.6, None, None, None), (2, 55.7, -37.7, 12.5, None, None)]
    point = lambda lat, lon, ele: f'<trkpt lat="{lat}" lon="{lon}"><ele>{ele}</ele></trkpt>'
    (tmp_path / "t.gpx").write_text("<gpx><trk><trkseg>" + "".join((point(55, 115, 1), point(55, 115, 2), point(55.1, 115, 9999), point(70, 115, 3), point(55, 115, 4), point(55.2, 115, 5))) + "</trkseg></trk></gpx>")
    indexes = lambda df: sorted(r.point_index for r in df.collect())
    assert indexes(files.parse_tracks(spark, f"{tmp_path}/t.gpx")) == [0, 2, 3, 4, 5]
    assert indexes(files.parse_tracks(spark, f"{tmp_path}/t.gpx", {"latitude": (52.0, 60.0), "longitude": (109.0, 134.0), "elevation": (-100.0, 6000.0)})) == [0, 5]
    assert [r.error for r in files.parse_tracks(spark, "a.fit").collect()] == ["unknown track format: fit"]


def test_records_are_rounded(spark):
    from trekframe.operators import features

    r = features.enriched_record(spark.createDataFrame([(55.12345678, 37.0, 120.26, 0.0, 1.23456, 0.456, None)], "latitude double, longitude double, altitude double, temperature double, frequency_steps double, quality double, other string")).first()
    assert tuple(r) == (55.123457, 37.0, 120.3, None, 1.235, 0.46, None)


def test_corrections_together_are_one_change_of_a_track(spark, tmp_path):
    s = store.TrackStore(spark, str(tmp_path))
    points = spark.createDataFrame([(t, i, dt.date(2026, 1, 1)) for t in "ab" for i in range(4)], "track_id string, point_index int, date date")
    s.add_points(points)
    s.add_tracks(points)
    fixes = spark.createDataFrame([("a", 1, "spline"), ("a", 3, "spline"), ("a", 3, "altitude")], "track_id string, point_index int, correction_type string")
    s.correct(fixes, together=True)
    s.correct(fixes.limit(1), together=True)
    assert [(r.version, r.change_type) for r in s.history("a").collect()] == [(1, "create"), (2, "correct"), (3, "correct")]
    assert {r.track_id: r.version for r in s.read("tracks").collect()} == {"a": 3, "b": 1}
    assert {r.name: r.n for r in s.statistics().collect()} == {"points": 8, "tracks": 2, "corrections": 4, "corrected_points": 2, "history": 4}


def test_densified_points_are_compiled_and_equal_the_great_circle(spark):
    data = [("a", 0, 50.0, 30.0), ("a", 1, 50.5, 31.0), ("a", 2, 50.5, 31.0), ("a", 3, None, 31.0), ("a", 4, -20.0, 179.0), ("b", 0, 1.0, 2.0)]
    points = spark.createDataFrame(data, "track_id string, point_index int, latitude double, longitude double")
    out = tracks.densify(points)
    assert "transform(" not in out._jdf.queryExecution().executedPlan().toString()
    got = {(r.track_id, r.point_index, r.k): (r.latitude, r.longitude) for r in out.collect()}
    ends = {0: (50.5, 31.0), 2: (-20.0, 179.0)}
    want = {("a", 1, 0): (50.5, 31.0), ("a", 4, 0): (-20.0, 179.0), ("b", 0, 0): (1.0, 2.0)}
    for i, lat, lon in ((0, 50.0, 30.0), (2, 50.5, 31.0)):
        path = one(spark, geo.slerp(L(lat), L(lon), L(ends[i][0]), L(ends[i][1]), 10))[0]
        want |= {("a", i, k): (p.latitude, p.longitude) for k, p in enumerate(path[:-1])}
    assert got.keys() == want.keys() and all(abs(a - b) < 1e-9 for k in want for a, b in zip(got[k], want[k]))


def test_densified_positions_hold_the_positions(spark, sf_dir):
    """The query gives every point with its coordinates, which Spark would otherwise leave unworked."""
    from trekframe.plans import track_queries

    out = track_queries.densified_positions(spark, sf_dir)
    assert out.columns == ["track_id", "point_index", "k", "latitude", "longitude"]
    assert "ATAN2" in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r.track_id, r.point_index, r.k): (r.latitude, r.longitude) for r in out.where("track_id = 'TRACK_1'").collect()}
    want = {(r.track_id, r.point_index, r.k): (r.latitude, r.longitude) for r in tracks.densify(track_points(spark, sf_dir).where("track_id = 'TRACK_1'")).collect()}
    assert got.keys() == want.keys() and any(k for _, _, k in got) and all(abs(a - b) <= 6e-8 for k in want for a, b in zip(got[k], want[k]))


def test_a_tree_of_documents_is_as_spark_writes_it(spark, tmp_path):
    """The same folders and texts, also for names that need escapes, without a process a file."""
    rows = [(name, f"<x>{i} \u00e9\r\n</x>") for i, name in enumerate(["TRACK_1", "a/b", "50% #1?", "x=[y]", " ", "\u00e9", *(f"t{i}" for i in range(200))])]
    docs = spark.createDataFrame(rows, "track_id string, doc string").repartition(4, "track_id")
    docs.select(F.col("doc").alias("value"), "track_id").write.partitionBy("track_id").text(f"{tmp_path}/want")
    started = lambda: int(re.search(r"processes (\d+)", open("/proc/stat").read())[1])
    files.write_documents(docs.limit(0), f"{tmp_path}/none")
    before = started()
    files.write_documents(docs, f"{tmp_path}/got")
    assert started() - before < len(rows)
    tree = lambda top: {os.path.basename(d): [open(f"{d}/{n}", newline="").read() for n in names if not n.startswith(".")] for d, _, names in os.walk(f"{tmp_path}/{top}") if d != f"{tmp_path}/{top}"}
    assert tree("got") == tree("want") and len(tree("got")) == len(rows)
    assert not [n for _, _, names in os.walk(f"{tmp_path}/got") for n in names if n.startswith(".")]
    with pytest.raises(FileExistsError):
        files.write_documents(docs, f"{tmp_path}/got")


@pytest.mark.parametrize("kind", ["gpx", "tcx", "geojson", "kml"])
def test_packed_documents_read_as_the_tree_does(spark, sf_dir, tmp_path, kind):
    docs = files.WRITERS[kind](track_points(spark, sf_dir).where("track_id in ('TRACK_1', 'TRACK_2', 'TRACK_3')"))
    files.write_documents(docs, f"{tmp_path}/tree")
    files.pack_documents(docs, f"{tmp_path}/packed")
    shown = lambda rows: sorted(map(str, rows.withColumn("file", F.regexp_extract("file", "track_id=([^/]+)", 1)).collect()))
    want = shown(files.READERS[kind](spark, f"{tmp_path}/tree/*"))
    assert want and shown(files.READERS[kind](spark, files.packed_documents(spark, f"{tmp_path}/packed"))) == want


def test_variants_read_points_once(spark, sf_dir):
    """One pass gives the rows that each transformation gives by itself."""
    p = track_points(spark, sf_dir)
    made = augment.variants(p, [("shift", "s", 1000.0, 90.0), ("rotate", "r", 15.0, 0.0), ("jitter", "j", 10.0, 42), ("days", "d", 7, 0)])
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parquet") == 1
    alone = {"shift": augment.shift(p, 1000.0, 90.0), "rotate": augment.rotate(p, 15.0), "jitter": augment.jitter_elevation(p, 10.0, 42), "days": augment.shift_days(p, 7)}
    shown = lambda df, name: df.select(name, "point_index", "event_ts", "date", *[F.round(c, 6).alias(c) for c in ("latitude", "longitude", "altitude")])
    for kind, one_ in alone.items():
        got = sorted(map(repr, map(tuple, shown(made.where(F.col("augmentation_type") == kind), "original_track_id").collect())))
        want = sorted(map(repr, map(tuple, shown(one_, "track_id").collect())))
        assert want and got == want
    assert made.columns == [*p.columns, "original_track_id", "augmentation_type"]
