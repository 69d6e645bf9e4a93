"""Queries of pipelines over map images; the images are grids of pixels made from the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from trekframe.operators import images
from trekframe.plans.registry import query

_WIDE = 25
_GRID = f"px as (select event_id % 20 as img, (event_id // 20) % {_WIDE} as x, event_id // {20 * _WIDE} as y, cast((event_id * 37) % 256 as int) as r, cast((event_id * 91) % 256 as int) as g, cast((event_id * 53) % 256 as int) as b from events)"


def _grid(spark, sf):
    e, i = spark.read.parquet(f"{sf}/events.parquet"), F.floor(F.col("event_id") / 20)
    return e.select((F.col("event_id") % 20).alias("img"), (i % _WIDE).alias("x"), F.floor(i / _WIDE).alias("y"), *[((F.col("event_id") * k) % 256).cast("int").alias(c) for c, k in (("r", 37), ("g", 91), ("b", 53))])


_STILL = {n: s for n, s in images.PRESETS.items() if s.weather_effect in (None, "fog")}
_SETTINGS = "s(name, bri, con, sat, hue, blur, fog) as (values " + ", ".join(f"('{n}', {s.brightness}::double, {s.contrast}::double, {s.saturation}::double, {s.hue_shift}::double, {s.blur_radius}::double, {int(s.weather_intensity * 200)})" for n, s in _STILL.items()) + ")"
_BYTE = lambda e: f"cast(greatest(0, least(255, floor({e}))) as int)"
_ALL = lambda fn: ", ".join(f"{fn(c)} as {c}" for c in "rgb")
_KEYS = "img, name, x, y, con, sat, hue, blur, fog"


def _blur_sql(source: str, line: str, along: str) -> str:
    kernel = images.blur_kernel(1.0)
    k = len(kernel) // 2
    at = lambda c, d: c if not d else f"coalesce(lead({c}, {d}) over w, last_value({c}) over u)" if d > 0 else f"coalesce(lag({c}, {-d}) over w, first_value({c}) over u)"
    total = lambda c: "(" + " + ".join(f"{at(c, d)} * {kernel[d + k]!r}::double" for d in range(-k, k + 1)) + " + 0.5)"
    return f"select {_KEYS}, {_ALL(lambda c: f'case when blur > 0.1 then {_BYTE(total(c))} else {c} end')} from {source} window w as (partition by img, name, {line} order by {along}), u as (partition by img, name, {line} order by {along} rows between unbounded preceding and unbounded following)"


_HUE = """t1 as (select *, greatest(r, g, b) as v, least(r, g, b) as lo from d), t2 as (select *, (v - lo)::double as span, case when hue >= 0 then floor(hue / 360.0::double * 256) else ceil(hue / 360.0::double * 256) end as turn from t1),
    t3 as (select *, (case when v = lo then 0 when r = v then (v - b) / span - (v - g) / span when g = v then 2.0 + (v - r) / span - (v - b) / span else 4.0 + (v - g) / span - (v - r) / span end) / 6.0 + 1.0 as a from t2),
    t4 as (select *, case when v = lo then 0 else floor((a - floor(a)) * 255.0::double) end as h, case when v = lo then 0 else floor(span / v * 255.0::double) end as sa from t3),
    t5 as (select *, ((h + turn + 256) % 256) * 6.0::double / 255.0::double as k, sa / 255.0::double as fs from t4),
    t6 as (select *, floor(v * (1.0 - fs) + 0.5) as p, floor(v * (1.0 - fs * (k - floor(k))) + 0.5) as q, floor(v * (1.0 - fs * (1.0 - (k - floor(k)))) + 0.5) as t, (floor(k) % 6)::int as o from t5),
    e as (select """ + _KEYS + """, """ + ", ".join(f"case when abs(hue) > 0.1 then cast(case when sa = 0 then v else ([{six}])[o + 1] end as int) else {c} end as {c}" for c, six in (("r", "v,q,p,p,t,v"), ("g", "t,v,v,q,p,p"), ("b", "p,p,t,v,v,q"))) + """ from t6)"""


@query(
    f"""with {_GRID}, {_SETTINGS}, a as (select {_KEYS}, {_ALL(lambda c: f'case when abs(bri - 1) > 0.01 then {_BYTE(f"{c} * bri")} else {c} end')} from px cross join s),
    m as (select *, floor(avg(floor((r * 299 + g * 587 + b * 114) / 1000.0::double)) over (partition by img, name) + 0.5) as grey from a),
    c as (select {_KEYS}, {_ALL(lambda c: f'case when abs(con - 1) > 0.01 then {_BYTE(f"grey + con * ({c} - grey)")} else {c} end')} from m),
    n as (select *, floor((r * 299 + g * 587 + b * 114) / 1000.0::double) as own from c),
    d as (select {_KEYS}, {_ALL(lambda c: f'case when abs(sat - 1) > 0.01 then {_BYTE(f"own + sat * ({c} - own)")} else {c} end')} from n),
    {_HUE}, f as ({_blur_sql('e', 'y', 'x')}), g as ({_blur_sql('f', 'x', 'y')})
    select img, name, x, y, {_ALL(lambda c: f'case when fog > 10 then {_BYTE(f"{c} * (1 - fog / 255.0::double) + 255 * (fog / 255.0::double) + 0.5")} else {c} end')} from g"""
)
def augmented_maps(spark, sf):
    return images.augmented(_grid(spark, sf), _STILL)


_U = lambda tag: f"((('0x' || substr(md5(concat_ws('|', 42, img, name, '{tag}', k)), 1, 12))::bigint + 0.5::double) / 281474976710656.0::double)"
_BETWEEN = lambda tag, a, b: f"(floor({_U(tag)} * ({b} - {a} + 1)) + {a})"
_FALLING = {n: s for n, s in images.PRESETS.items() if s.weather_effect in ("rain", "snow")}


@query(
    f"""with {_GRID}, z as (select img, max(x) + 1 as width, max(y) + 1 as height from px group by 1), s(name, rain, count) as (values ('rainy', true, 250), ('snowy', false, 400)),
    m as (select *, unnest(range(1, count + 1)) as k from z cross join s),
    q as (select img, name, k, rain, width, height, {_BETWEEN('x', '0', 'width')} as x0, {_BETWEEN('y', '0', 'height')} as y0, (case when rain then {_BETWEEN('size', '10', '30')} else {_BETWEEN('size', '1', '3')} end)::int as size,
      (case when rain then {_BETWEEN('alpha', '50', '150')} else {_BETWEEN('alpha', '150', '255')} end)::int as alpha, {_BETWEEN('drift', '-2', '2')} as drift from m),
    p as (select *, x0 + floor(drift * i / size + 0.5) as x, y0 + i as y from (select *, unnest(range(0, size + 1)) as i from q where rain)
      union all select img, name, k, rain, width, height, x0, y0, size, alpha, drift, j, x0 + i, y0 + j from (select *, unnest(range(-size, size + 1)) as j from (select *, unnest(range(-size, size + 1)) as i from q where not rain)) where i * i + j * j <= size * size)
    select img, name, x::bigint as x, y::bigint as y, arg_max(alpha, k) as alpha from p where x >= 0 and y >= 0 and x < width and y < height group by all"""
)
def weather_marks(spark, sf):
    sizes = _grid(spark, sf).groupBy("img").agg((F.max("x") + 1).alias("width"), (F.max("y") + 1).alias("height"))
    each = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(s.weather_effect).alias("weather"), F.lit(s.weather_intensity).alias("intensity")) for n, s in _FALLING.items()])
    return images.drawn(sizes.select("img", "width", "height", F.inline(each)), 42)


@query()
def weathered_maps(spark, sf):
    return images.augmented(_grid(spark, sf), _FALLING | {"noisy": images.Settings(noise_intensity=0.03)})


@query(
    f"""with {_GRID}, z as (select img, max(x) + 1 as width, max(y) + 1 as height from px group by 1), s(name, bri, hue, jpeg, weather) as (values {", ".join(f"('{n}', {s.brightness}::double, {s.hue_shift}::double, {s.jpeg_quality or 'null::int'}, {repr(s.weather_effect) if s.weather_effect else 'null'})" for n, s in images.PRESETS.items())})
    select img, name, img || '_AUG_' || upper(name) as output, width, height, bri as brightness, hue as hue_shift, jpeg as jpeg_quality, weather as weather_effect from z cross join s"""
)
def map_sidecars(spark, sf):
    rows = images.sidecars(_grid(spark, sf), images.PRESETS)
    return rows.select("img", "name", "output", "width", "height", *[F.col(f"params.{c}").alias(c) for c in ("brightness", "hue_shift", "jpeg_quality", "weather_effect")])


@query(
    f"with {_GRID}, old as (select distinct img, 'before_' || img as o from px where img % 3 = 0), n as (select distinct img, unnest([{', '.join(repr(n.upper()) for n in images.PRESETS)}]) as o from px), a as (select img, 0 as k, o from old union all select img, 1, img || '_AUG_' || o from n) select img, string_agg(o, ',' order by k, o) as augmentations, count(*)::int as augmentation_count from a group by 1"
)
def map_augmentation_records(spark, sf):
    grid = _grid(spark, sf)
    before = grid.where("img % 3 = 0").select("img").distinct().select("img", F.array(F.concat(F.lit("before_"), F.col("img").cast("string"))).alias("augmentations"))
    return images.augmentation_records(before, images.sidecars(grid, images.PRESETS)).withColumn("augmentations", F.array_join("augmentations", ","))
