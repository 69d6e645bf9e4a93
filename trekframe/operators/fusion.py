"""Terrain from several sources: votes, conflicts and their resolution."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SOURCES = ("osm", "csv", "satellite")
CSV_CONFIDENCE = 0.9


def votes(osm: Column, osm_confidence: Column, csv: Column, satellite: Column, satellite_confidence: Column) -> Column:
    """Array of structs source, terrain, confidence of the sources that have an opinion."""
    one = lambda source, kind, conf: F.when(kind.isNotNull(), F.struct(F.lit(source).alias("source"), kind.alias("terrain"), conf.cast("double").alias("confidence")))
    return F.array_compact(F.array(one("osm", osm, osm_confidence), one("csv", csv, F.lit(CSV_CONFIDENCE)), one("satellite", satellite, satellite_confidence)))


def log_conflicts(rows, path: str) -> None:
    """Appends rows whose csv and osm terrain differ to a log of JSON lines."""
    rows.where("csv is not null and osm is not null and csv <> osm").write.mode("append").json(path)


def _mean(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x["confidence"]) / F.size(v)


def resolve(v: Column, strategy: str = "majority") -> Column:
    """Struct terrain, confidence, method, conflict (none, minor or major) of an array of votes.

    Without votes unknown and 0; one vote is taken as it is; agreeing votes give
    their mean confidence; else by strategy: majority (mean of the majority,
    else the most confident, the first on a tie), csv, osm, confidence, or
    average (the majority's type with the mean of all).
    """
    kinds = F.array_distinct(F.transform(v, lambda x: x["terrain"]))
    same = lambda x: F.filter(v, lambda y: y["terrain"] == x["terrain"])
    major = F.get(F.filter(v, lambda x: F.size(same(x)) >= 2), F.lit(0))
    top = F.aggregate(F.slice(v, 2, 2), v[0], lambda a, x: F.when(x["confidence"] > a["confidence"], x).otherwise(a))
    of = lambda source: F.get(F.filter(v, lambda x: x["source"] == source), F.lit(0))
    out = lambda kind, conf, method: F.struct(kind.alias("terrain"), conf.cast("double").alias("confidence"), F.lit(method).alias("method"))
    by_top = out(top["terrain"], top["confidence"], "highest_confidence")
    by_source = lambda s: F.when(of(s).isNotNull(), out(of(s)["terrain"], of(s)["confidence"], f"{s}_priority")).otherwise(by_top)
    chosen = {
        "majority": F.when(major.isNotNull(), out(major["terrain"], _mean(same(major)), "majority")).otherwise(by_top),
        "average": F.when(major.isNotNull(), out(major["terrain"], _mean(v), "average")).otherwise(out(top["terrain"], _mean(v), "average")),
        "csv": by_source("csv"),
        "osm": by_source("osm"),
        "confidence": by_top,
    }[strategy]
    simple = F.when(F.size(v) == 0, out(F.lit("unknown"), F.lit(0.0), "none")).when(F.size(v) == 1, out(v[0]["terrain"], v[0]["confidence"], "single")).when(F.size(kinds) == 1, out(v[0]["terrain"], _mean(v), "unanimous"))
    conflict = F.when(F.size(kinds) < 2, "none").when((F.size(kinds) == 2) & major.isNotNull(), "minor").otherwise("major")
    return F.struct(F.coalesce(simple, chosen).alias("result"), conflict.alias("conflict"))
