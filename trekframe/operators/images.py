"""Map images as tables of pixels (img, x, y, r, g, b), and pipelines of changes over images and settings in one plan.

A pipeline takes every pixel once, sets it out for each of the given settings,
and applies the steps of all settings as expressions that the settings' numbers
drive, in the order brightness, contrast, saturation, hue, blur, noise, weather.
Only what looks beyond a pixel moves rows: the mean grey behind contrast is one
aggregate by image for all settings together, kept as a table of a row an image, blur is two windows over rows and
columns of the blurred settings, rain and snow are joined as drawn pixels. JPEG
quality is kept in the sidecar; its loss isn't simulated.

Chance comes from hashes of the seed, the image, the setting and the place, so
reruns agree. Defined cases: settings out of range raise ValueError; an image is
the grid up to its largest x and y, and at its edge blur repeats the last pixel;
unknown colours stay unknown, and after blur those next to them too; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trekframe.sources.shared import materialised

# The ranges of the settings.
LIMITS = {"brightness": (0.7, 1.3), "contrast": (0.8, 1.2), "saturation": (0.8, 1.2), "hue_shift": (-15.0, 15.0), "blur_radius": (0.0, 2.0), "noise_intensity": (0.0, 0.05), "jpeg_quality": (70, 95), "weather_intensity": (0.0, 1.0)}
WEATHERS = ("fog", "rain", "snow")


@dataclass(frozen=True)
class Settings:
    brightness: float = 1.0
    contrast: float = 1.0
    saturation: float = 1.0
    hue_shift: float = 0.0
    blur_radius: float = 0.0
    noise_intensity: float = 0.0
    jpeg_quality: int | None = None
    weather_effect: str | None = None
    weather_intensity: float = 0.0

    def __post_init__(self):
        for name, (low, high) in LIMITS.items():
            value = getattr(self, name)
            if value is not None and not low <= value <= high:
                raise ValueError(f"{name} {value} outside [{low}, {high}]")
        if self.weather_effect is not None and self.weather_effect.lower() not in WEATHERS:
            raise ValueError(f"unknown weather: {self.weather_effect}")


# The named settings.
PRESETS = {
    "light": Settings(brightness=1.1, contrast=1.05, saturation=1.05),
    "dark": Settings(brightness=0.85, contrast=0.95, saturation=0.95),
    "high_contrast": Settings(brightness=1.0, contrast=1.2, saturation=1.1),
    "low_saturation": Settings(brightness=1.0, contrast=1.0, saturation=0.8),
    "warm_tone": Settings(brightness=1.05, saturation=1.1, hue_shift=5.0),
    "cool_tone": Settings(brightness=0.95, saturation=1.05, hue_shift=-5.0),
    "foggy": Settings(brightness=1.1, contrast=0.9, weather_effect="fog", weather_intensity=0.4),
    "rainy": Settings(brightness=0.9, contrast=0.95, weather_effect="rain", weather_intensity=0.5),
    "snowy": Settings(brightness=1.15, contrast=0.95, weather_effect="snow", weather_intensity=0.5),
    "compressed": Settings(jpeg_quality=75),
    "slightly_blurred": Settings(blur_radius=1.0),
}


def uniform(*parts: Column) -> Column:
    """A number between 0 and 1 from the MD5 of the parts."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]).cast("binary")), 1, 12), 16, 10)
    return (h.cast("long") + 0.5) / float(1 << 48)


def _byte(c: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), F.floor(c))).cast("int")


def _grey(r: Column, g: Column, b: Column) -> Column:
    return F.floor((r * 299 + g * 587 + b * 114) / 1000.0)


def _bound(value: Column, fn) -> Column:
    """fn(value) with value named once, so that what is built on it doesn't repeat it."""
    return F.transform(F.array(value), fn)[0]


def hue_shifted(r: Column, g: Column, b: Column, degrees: Column) -> Column:
    """Struct r, g, b with the hue turned, in steps of 8 bits for hue, saturation and value."""

    def turned(c: Column) -> Column:
        """top, hue (turned) and saturation of c (r, g, b, degrees)."""
        top, low = F.greatest(c["r"], c["g"], c["b"]), F.least(c["r"], c["g"], c["b"])
        span = (top - low).cast("double")
        part = lambda x: F.try_divide(top - x, span)
        sector = F.when(c["r"] == top, part(c["b"]) - part(c["g"])).when(c["g"] == top, 2.0 + part(c["r"]) - part(c["b"])).otherwise(4.0 + part(c["g"]) - part(c["r"]))
        turn = sector / 6.0 + 1.0
        hue = F.when(top == low, 0).otherwise(F.floor((turn - F.floor(turn)) * 255.0))
        sat = F.when(top == low, 0).otherwise(F.floor(F.try_divide(span, top) * 255.0))
        shift = F.when(c["degrees"] >= 0, F.floor(c["degrees"] / 360.0 * 256)).otherwise(F.ceil(c["degrees"] / 360.0 * 256))
        return F.struct(top.cast("int").alias("v"), (F.pmod(hue + shift, F.lit(256)) * 6.0 / 255.0).alias("at"), (sat / 255.0).alias("fs"))

    def coloured(h: Column) -> Column:
        v, at, fs = h["v"], h["at"], h["fs"]
        f, sector = at - F.floor(at), F.pmod(F.floor(at), F.lit(6))
        near = lambda x: F.floor(x + 0.5).cast("int")
        p, q, t = near(v * (1.0 - fs)), near(v * (1.0 - fs * f)), near(v * (1.0 - fs * (1.0 - f)))
        pick = lambda *six: F.when(fs == 0, v).otherwise(F.element_at(F.array(*six), (sector + 1).cast("int")))
        return F.struct(pick(v, q, p, p, t, v).alias("r"), pick(t, v, v, q, p, p).alias("g"), pick(p, p, t, v, v, q).alias("b"))

    return _bound(_bound(F.struct(r.alias("r"), g.alias("g"), b.alias("b"), degrees.alias("degrees")), turned), coloured)


def blur_kernel(radius: float, passes: int = 3) -> list[float]:
    """Weights of the neighbours at -k .. k: the box of fractional width whose passes have a Gaussian's variance, all passes in one."""
    if radius <= 0:
        return [1.0]
    var = radius * radius / passes
    whole = math.floor((math.sqrt(12 * var + 1) - 1) / 2)
    part = (2 * whole + 1) * (whole * (whole + 1) - 3 * var) / (6 * (var - (whole + 1) ** 2))
    width = 2 * (whole + part) + 1
    box = [part / width, *[1 / width] * (2 * whole + 1), part / width]
    out = [1.0]
    for _ in range(passes):
        out = [sum(out[i - j] * box[j] for j in range(len(box)) if 0 <= i - j < len(out)) for i in range(len(out) + len(box) - 1)]
    return out


def blurred(pixels: DataFrame, keys: list[str], radius: float) -> DataFrame:
    """Pixels of images (keys) blurred along rows, then along columns, each rounded to 8 bits."""
    kernel = blur_kernel(radius)
    reach = len(kernel) // 2
    for line, along in (("y", "x"), ("x", "y")):
        w = Window.partitionBy(*keys, line).orderBy(along)
        whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        side = lambda c, k, w=w, whole=whole: F.col(c) if not k else F.coalesce(F.lead(c, k).over(w), F.last(c).over(whole)) if k > 0 else F.coalesce(F.lag(c, -k).over(w), F.first(c).over(whole))
        total = {c: sum(side(c, k) * kernel[k + reach] for k in range(-reach, reach + 1)) + 0.5 for c in "rgb"}
        pixels = pixels.select(*[F.when(total[c].isNotNull(), _byte(total[c])).alias(c) if c in total else F.col(c) for c in pixels.columns])
    return pixels


def drawn(images: DataFrame, seed: int) -> DataFrame:
    """Pixels that rain and snow draw: img, name, x, y, alpha, of marks on each other the last.

    images: img, name, weather, intensity, width, height. A streak falls 10 to 30
    pixels and drifts by up to two; a flake is a disc of radius 1 to 3.
    """
    rain = F.col("weather") == "rain"
    count = F.floor(F.col("intensity") * F.when(rain, 500).otherwise(800)).cast("int")
    marks = images.where(count > 0).select("*", F.explode(F.sequence(F.lit(1), count)).alias("k"))
    u = lambda tag: uniform(F.lit(seed), F.col("img"), F.col("name"), F.lit(tag), F.col("k"))
    between = lambda tag, a, b: F.floor(u(tag) * (b - a + 1)) + a
    marks = marks.select(
        "img", "name", "k", "width", "height", rain.alias("rain"),
        between("x", F.lit(0), F.col("width")).alias("x0"), between("y", F.lit(0), F.col("height")).alias("y0"),
        F.when(rain, between("size", F.lit(10), F.lit(30))).otherwise(between("size", F.lit(1), F.lit(3))).cast("int").alias("size"),
        F.when(rain, between("alpha", F.lit(50), F.lit(150))).otherwise(between("alpha", F.lit(150), F.lit(255))).cast("int").alias("alpha"),
        between("drift", F.lit(-2), F.lit(2)).alias("drift"),
    )
    streak = F.transform(F.sequence(F.lit(0), F.col("size")), lambda d: F.struct((F.col("x0") + F.floor(F.col("drift") * d / F.col("size") + 0.5)).cast("long").alias("x"), (F.col("y0") + d).cast("long").alias("y")))
    side = F.sequence(-F.col("size"), F.col("size"))
    flake = F.flatten(F.transform(side, lambda dy: F.transform(F.filter(side, lambda dx: dx * dx + dy * dy <= F.col("size") * F.col("size")), lambda dx: F.struct((F.col("x0") + dx).cast("long").alias("x"), (F.col("y0") + dy).cast("long").alias("y")))))
    spots = marks.select("img", "name", "k", "alpha", "width", "height", F.explode(F.when(F.col("rain"), streak).otherwise(flake)).alias("at")).select("img", "name", "k", "alpha", "width", "height", "at.x", "at.y")
    inside = spots.where((F.col("x") >= 0) & (F.col("y") >= 0) & (F.col("x") < F.col("width")) & (F.col("y") < F.col("height")))
    return inside.groupBy("img", "name", "x", "y").agg(F.max_by("alpha", "k").alias("alpha"))


def _over(c: Column, colour: int, alpha: Column) -> Column:
    """c with a colour laid over it."""
    a = alpha / 255.0
    return _byte(c * (1 - a) + colour * a + 0.5)


def augmented(pixels: DataFrame, settings: dict[str, Settings], seed: int = 42) -> DataFrame:
    """img, name, x, y, r, g, b of every image under every named setting."""
    columns = [f for f in Settings.__dataclass_fields__ if f != "jpeg_quality"]
    value = lambda s, f: F.lit(getattr(s, f)).cast("string" if f == "weather_effect" else "double")
    seen = {f"seen_{c}": F.col(c).isNotNull() for c in "rgb"}  # the steps don't tell unknown from white
    off = lambda c, least, neutral=0.0: F.abs(F.col(c) - neutral) > least
    channels = lambda d, fn: d.withColumns({c: fn(F.col(c)) for c in "rgb"})
    bright = lambda c, factor: _byte(c * factor)

    def factor_of(s: Settings) -> float:
        return s.brightness if abs(s.brightness - 1.0) > 0.01 else 1.0

    contrasted = {n: s for n, s in settings.items() if abs(s.contrast - 1.0) > 0.01}
    facts = [F.max(F.col("x") + 1).cast("long").alias("width"), F.max(F.col("y") + 1).cast("long").alias("height")]
    greys = [F.floor(F.avg(_grey(*[bright(F.col(c), factor_of(s)) for c in "rgb"])) + 0.5).alias(f"grey_{i}") for i, s in enumerate(contrasted.values())]
    weathers = {n: s for n, s in settings.items() if s.weather_effect and s.weather_effect.lower() != "fog" and s.weather_intensity > 0.05}
    # One aggregate for all settings, as a table: Spark knows its size then, and needn't shuffle and sort all pixels by image.
    images = materialised(pixels.groupBy("img").agg(*facts, *greys)) if contrasted or weathers else None
    rows = pixels.join(images.drop("width", "height"), "img", "left") if contrasted else pixels
    places = {n: i for i, n in enumerate(contrasted)}
    grey = lambda n: (F.col(f"grey_{places[n]}") if n in places else F.lit(None).cast("long")).alias("grey")
    listed = F.array(*[F.struct(F.lit(n).alias("name"), *[value(s, f).alias(f) for f in columns], grey(n)) for n, s in settings.items()])
    rows = rows.select("img", F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), "r", "g", "b", *[v.alias(n) for n, v in seen.items()], F.inline(listed))
    rows = channels(rows, lambda c: F.when(off("brightness", 0.01, 1.0), bright(c, F.col("brightness"))).otherwise(c.cast("int")))
    if contrasted:
        rows = channels(rows, lambda c: F.when(F.col("grey").isNotNull(), _byte(F.col("grey") + F.col("contrast") * (c - F.col("grey")))).otherwise(c))
    rows = rows.withColumn("own", _grey(F.col("r"), F.col("g"), F.col("b")))
    rows = channels(rows, lambda c: F.when(off("saturation", 0.01, 1.0), _byte(F.col("own") + F.col("saturation") * (c - F.col("own")))).otherwise(c)).drop("own")
    turned = rows.withColumn("turned", F.when(off("hue_shift", 0.1), hue_shifted(F.col("r"), F.col("g"), F.col("b"), F.col("hue_shift"))))
    rows = turned.withColumns({c: F.coalesce(F.col(f"turned.{c}"), F.col(c)) for c in "rgb"}).drop("turned")
    radii = sorted({s.blur_radius for s in settings.values() if s.blur_radius > 0.1})
    if radii:
        kept = ["img", "name", "x", "y", *"rgb", *seen]  # settings aren't sorted along, a name tells them
        parts = rows.where(F.col("blur_radius") <= 0.1).select(*kept)
        for radius in radii:
            parts = parts.unionByName(blurred(rows.where(F.col("blur_radius") == radius).select(*kept), ["img", "name"], radius))
        rows = parts.withColumns({n: F.col(n) & v for n, v in seen.items()})
        rows = rows.withColumns({f: F.coalesce(*[F.when(F.col("name") == n, value(s, f)) for n, s in settings.items()]) for f in ("noise_intensity", "weather_effect", "weather_intensity")})
    u = lambda c, tag: uniform(F.lit(seed), F.col("img"), F.col("name"), F.col("x"), F.col("y"), F.lit(c), F.lit(tag))
    normal = lambda c: F.sqrt(-2.0 * F.ln(u(c, 1))) * F.cos(2.0 * math.pi * u(c, 2))
    rows = rows.withColumns({c: F.when(F.col("noise_intensity") > 0.001, _byte(F.col(c) + normal(c) * F.col("noise_intensity") * 255)).otherwise(F.col(c)) for c in "rgb"})
    effect = F.when(F.col("weather_intensity") > 0.05, F.lower("weather_effect"))
    rows = rows.withColumn("weather", effect)
    light = F.when(F.col("weather") == "rain", 1.0 - F.col("weather_intensity") * 0.2).when(F.col("weather") == "snow", 1.0 + F.col("weather_intensity") * 0.15)
    rows = channels(rows, lambda c: F.when(F.col("weather") == "fog", _over(c, 255, F.floor(F.col("weather_intensity") * 200))).when(light.isNotNull(), bright(c, light)).otherwise(c))
    if weathers:
        asked = images.select("img", "width", "height", F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s.weather_effect.lower()).alias("weather"), F.lit(float(s.weather_intensity)).alias("intensity")) for n, s in weathers.items()])))
        rows = rows.join(drawn(asked, seed), ["img", "name", "x", "y"], "left")
        over = {c: F.when(F.col("alpha").isNull(), F.col(c)).otherwise(_over(F.col(c), colour, F.col("alpha"))) for c, colour in zip("rgb", (200, 200, 255))}
        white = {c: _over(F.col(c), 255, F.col("alpha")) for c in "rgb"}
        rows = rows.withColumns({c: F.when((F.col("weather") == "snow") & F.col("alpha").isNotNull(), white[c]).otherwise(over[c]) for c in "rgb"})
    return rows.select("img", "name", "x", "y", *[F.when(F.col(f"seen_{c}"), F.col(c)).alias(c) for c in "rgb"])


def random_settings(names: list[str], seed: int = 42, weather: bool = True) -> dict[str, Settings]:
    """Settings drawn from the ranges, by name; three in ten with weather of intensity 0.2 to 0.6."""
    import random

    out = {}
    for name in names:
        rng = random.Random(f"{seed}|{name}")
        drawn_ = {k: rng.uniform(*LIMITS[k]) for k in ("brightness", "contrast", "saturation", "hue_shift", "blur_radius", "noise_intensity")}
        quality = rng.randint(*LIMITS["jpeg_quality"])
        with_weather = weather and rng.random() < 0.3
        effect = {"weather_effect": rng.choice(WEATHERS), "weather_intensity": rng.uniform(0.2, 0.6)} if with_weather else {}
        out[name] = Settings(**drawn_, jpeg_quality=quality, **effect)
    return out


def sidecars(images: DataFrame, settings: dict[str, Settings]) -> DataFrame:
    """img, name, output (the changed image's file name), width, height and the settings, as a struct and as JSON, for every image and setting.

    images: pixels (img, x, y), or any rows with img.
    """
    spec = ", ".join(f"{f}: {'string' if f == 'weather_effect' else 'int' if f == 'jpeg_quality' else 'double'}" for f in Settings.__dataclass_fields__)
    each = F.array(*[F.struct(F.lit(n).alias("name"), F.struct(*[F.lit(v).cast("string" if f == "weather_effect" else "int" if f == "jpeg_quality" else "double").alias(f) for f, v in asdict(s).items()]).cast(f"struct<{spec}>").alias("params")) for n, s in settings.items()])
    sizes = images.groupBy("img").agg(F.max(F.col("x") + 1).cast("long").alias("width"), F.max(F.col("y") + 1).cast("long").alias("height"))
    rows = sizes.select("img", "width", "height", F.inline(each))
    output = F.concat(F.col("img").cast("string"), F.lit("_AUG_"), F.upper("name"))
    return rows.select("img", "name", output.alias("output"), "width", "height", "params", F.to_json("params", {"ignoreNullFields": "false"}).alias("json"))


def augmentation_records(metadata: DataFrame, sidecar: DataFrame) -> DataFrame:
    """img, augmentations (what a map's metadata listed before, then the new outputs in order) and their count; metadata: img, augmentations array<string>."""
    new = sidecar.groupBy("img").agg(F.array_sort(F.collect_list("output")).alias("new"))  # one a setting
    none = F.array().cast("array<string>")
    rows = metadata.join(new, "img", "full").withColumn("augmentations", F.concat(F.coalesce("augmentations", none), F.coalesce("new", none)))
    return rows.select("img", "augmentations", F.size("augmentations").alias("augmentation_count"))
