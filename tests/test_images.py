"""Image pipelines against plain loops over small images."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from trekframe.operators import images
from trekframe.operators.images import PRESETS, Settings


@pytest.fixture(scope="module")
def grid(spark):
    rng = np.random.default_rng(6)
    pixels = {i: rng.integers(0, 256, (9, 12, 3)) for i in range(3)}
    rows = [(i, x, y, *map(int, p[y, x])) for i, p in pixels.items() for y in range(9) for x in range(12)]
    return pixels, spark.createDataFrame(rows, "img int, x int, y int, r int, g int, b int").repartition(4)


def arrays(df, names, shape=(9, 12)):
    out = {}
    for r in df.collect():
        out.setdefault((r.img, r.name), np.full((*shape, 3), -1))[r.y, r.x] = (r.r, r.g, r.b)
    assert {n for _, n in out} == set(names) and all((v >= 0).all() for v in out.values())
    return out


def grey(p):
    return np.floor((p * [299, 587, 114]).sum(axis=2) / 1000.0)


def byte(p):
    return np.clip(np.floor(p), 0, 255)


def turned(rgb, degrees):
    """Hue turned in steps of 8 bits, a pixel at a time."""
    r, g, b = (int(v) for v in rgb)
    top, low = max(r, g, b), min(r, g, b)
    if top == low:
        return rgb
    span = top - low
    rc, gc, bc = (top - r) / span, (top - g) / span, (top - b) / span
    h = bc - gc if r == top else 2 + rc - bc if g == top else 4 + gc - rc
    h = int(math.fmod(h / 6 + 1, 1) * 255)
    s = int(span / top * 255)
    h = (h + int(degrees / 360 * 256)) % 256
    if s == 0:
        return [top] * 3
    at, fs = h * 6.0 / 255.0, s / 255.0
    f = at - math.floor(at)
    near = lambda v: int(math.floor(v + 0.5))
    p, q, t = near(top * (1 - fs)), near(top * (1 - fs * f)), near(top * (1 - fs * (1 - f)))
    return [(top, t, p), (q, top, p), (p, top, t), (p, q, top), (t, p, top), (top, p, q)][math.floor(at) % 6]


def blurred(p, radius):
    k = images.blur_kernel(radius)
    n = len(k) // 2
    for axis in (1, 0):
        padded = np.pad(p, [(n, n) if a == axis else (0, 0) for a in range(3)], mode="edge")
        p = byte(sum(w * np.take(padded, np.arange(i, i + p.shape[axis]), axis=axis) for i, w in enumerate(k)) + 0.5)
    return p


def plain(p, s):
    if abs(s.brightness - 1) > 0.01:
        p = byte(p * s.brightness)
    if abs(s.contrast - 1) > 0.01:
        mean = math.floor(grey(p).mean() + 0.5)
        p = byte(mean + s.contrast * (p - mean))
    if abs(s.saturation - 1) > 0.01:
        own = grey(p)[..., None]
        p = byte(own + s.saturation * (p - own))
    if abs(s.hue_shift) > 0.1:
        p = np.array([[turned(v, s.hue_shift) for v in line] for line in p], float)
    if s.blur_radius > 0.1:
        p = blurred(p, s.blur_radius)
    if s.weather_effect == "fog":
        a = int(s.weather_intensity * 200) / 255
        p = byte(p * (1 - a) + 255 * a + 0.5)
    return p


def test_all_still_presets_at_once(spark, grid):
    pixels, df = grid
    still = {n: s for n, s in PRESETS.items() if s.weather_effect in (None, "fog")} | {"all": Settings(0.8, 1.1, 1.2, -12.0, 1.7, 0.0, 80, "FOG", 0.9), "none": Settings()}
    assert len(PRESETS) == 11
    got = arrays(images.augmented(df, still), still)
    for (i, n), p in got.items():
        s = still[n] if n != "all" else Settings(0.8, 1.1, 1.2, -12.0, 1.7, 0.0, 80, "fog", 0.9)
        assert (p == plain(pixels[i].astype(float), s)).all(), n
    assert (got[0, "none"] == pixels[0]).all() and (got[0, "compressed"] == pixels[0]).all()


def test_one_scan_for_the_settings_and_one_for_the_greys(spark, grid, tmp_path):
    grid[1].write.parquet(f"{tmp_path}/grid")
    plan = images.augmented(spark.read.parquet(f"{tmp_path}/grid"), {n: s for n, s in PRESETS.items() if not s.weather_effect and not s.blur_radius})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 2


def test_blur_kernel_is_a_gaussians():
    for radius in (0.3, 1.0, 1.5, 2.0):
        k = images.blur_kernel(radius)
        n = len(k) // 2
        assert sum(k) == pytest.approx(1) and k == pytest.approx(k[::-1]) and sum(w * (i - n) ** 2 for i, w in enumerate(k)) == pytest.approx(radius**2)
    assert images.blur_kernel(0) == [1.0]


def test_noise_is_normal_and_repeats(spark, grid):
    flat = spark.range(0, 10_000).select(F.lit(0).alias("img"), (F.col("id") % 100).alias("x"), F.floor(F.col("id") / 100).alias("y"), *[F.lit(128).alias(c) for c in "rgb"])
    noisy = images.augmented(flat, {"n": Settings(noise_intensity=0.04)})
    values = np.array([[r.r, r.g, r.b] for r in noisy.orderBy("x", "y").collect()], float)
    assert abs(values.mean() - 127.5) < 0.3 and abs(values.std() - 0.04 * 255) < 0.2 and abs(np.corrcoef(values.T)[0, 1]) < 0.03
    assert (values == np.array([[r.r, r.g, r.b] for r in images.augmented(flat.repartition(7), {"n": Settings(noise_intensity=0.04)}).orderBy("x", "y").collect()])).all()


@pytest.mark.parametrize("effect, colour, light", [("rain", (200, 200, 255), 1 - 0.5 * 0.2), ("snow", (255, 255, 255), 1 + 0.5 * 0.15)])
def test_rain_and_snow_lie_over_the_image(spark, grid, effect, colour, light):
    pixels, df = grid
    s = {"w": Settings(weather_effect=effect, weather_intensity=0.5)}
    sizes = spark.createDataFrame([(i, "w", effect, 0.5, 12, 9) for i in pixels], "img int, name string, weather string, intensity double, width long, height long")
    marks = {(r.img, r.x, r.y): r.alpha for r in images.drawn(sizes, 42).collect()}
    assert marks and all(0 <= x < 12 and 0 <= y < 9 for _, x, y in marks) and all((50 if effect == "rain" else 150) <= a <= 255 for a in marks.values())
    for (i, _), p in arrays(images.augmented(df, s), s).items():
        for y in range(9):
            for x in range(12):
                want = byte(pixels[i][y, x] * light)
                if (i, x, y) in marks:
                    a = marks[i, x, y] / 255
                    want = byte(want * (1 - a) + np.array(colour) * a + 0.5)
                assert (p[y, x] == want).all()


def test_limits_random_settings_and_no_rows(spark, grid):
    for bad in ({"brightness": 1.5}, {"contrast": 0.5}, {"saturation": 2}, {"hue_shift": 20}, {"blur_radius": 3}, {"noise_intensity": 0.1}, {"jpeg_quality": 10}, {"weather_intensity": 1.5}, {"weather_effect": "hail"}):
        with pytest.raises(ValueError):
            Settings(**bad)
    drawn = images.random_settings([f"r{i}" for i in range(200)])
    assert drawn == images.random_settings([f"r{i}" for i in range(200)]) and len({s.brightness for s in drawn.values()}) == 200
    assert 30 < sum(s.weather_effect is not None for s in drawn.values()) < 90
    assert all(s.weather_effect is None for s in images.random_settings(list("abc"), weather=False).values())
    assert images.augmented(grid[1].limit(0), PRESETS).count() == 0 == images.sidecars(grid[1].limit(0), PRESETS).count()
    holes = grid[1].withColumn("r", F.when(F.col("x") != 3, F.col("r")))
    assert images.augmented(holes, {"light": PRESETS["light"]}).where("r is null").count() == 27


def test_sidecars(spark, grid):
    import json

    rows = images.sidecars(grid[1], PRESETS).where("img = 1").collect()
    assert len(rows) == 11 and {(r.width, r.height) for r in rows} == {(12, 9)}
    foggy = next(r for r in rows if r.name == "foggy")
    assert foggy.output == "1_AUG_FOGGY" and json.loads(foggy.json) == {"brightness": 1.1, "contrast": 0.9, "saturation": 1.0, "hue_shift": 0.0, "blur_radius": 0.0, "noise_intensity": 0.0, "jpeg_quality": None, "weather_effect": "fog", "weather_intensity": 0.4}


def test_greys_are_joined_without_sorting_pixels(spark):
    i = F.col("id")
    pixels = spark.range(200_000).select((i % 2).alias("img"), (i % 500).alias("x"), F.floor(i / 500).alias("y"), *[((i * k) % 256).cast("int").alias(c) for c, k in zip("rgb", (37, 91, 53))])
    key = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "100k")  # pixels are beyond it, the table of images isn't
    try:
        plan = images.augmented(pixels, {"dark": PRESETS["dark"]})._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(key, before)
    assert "SortMergeJoin" not in plan and "Exchange hashpartitioning" not in plan
