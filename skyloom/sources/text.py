"""Scans of node grids, route files, parameters, weather and vector layers."""

from __future__ import annotations

import ast

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import label_prefix


def xyz(spark: SparkSession, path: str, labelled: bool = True) -> DataFrame:
    """x y z slowness [... label]: comments, blank, short and non-numeric lines are skipped."""
    t = spark.read.text(path).select(F.trim("value").alias("raw"))
    p = t.where("raw <> '' AND NOT startswith(raw, '#')").select("raw", F.split("raw", r"[\s,]+").alias("p")).where(F.size("p") >= (5 if labelled else 4))
    cols = [F.col("p")[i].try_cast("double").alias(c) for i, c in enumerate(("x", "y", "z", "slowness"))]
    out = p.select(*cols, *([F.element_at("p", -1).alias("label")] if labelled else []), "raw").where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND slowness IS NOT NULL")
    return out.withColumn("label_prefix", label_prefix(F.col("label"))) if labelled else out


def route_nodes(spark: SparkSession, path: str) -> DataFrame:
    """Route CSV files; pair, direction, type and rank come from the file stem DB01_to_DK04_forward_main_01."""
    d = spark.read.option("header", True).csv(path).withColumn("stem", F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", ""))
    rx = r"^([A-Za-z]+\d+_to_[A-Za-z]+\d+)_(forward|backward)_([a-z_]+?)_(\d+)$"
    part = lambda i: F.nullif(F.regexp_extract("stem", rx, i), F.lit(""))
    return d.withColumns({"route_id": F.col("stem"), "file_pair": part(1), "file_direction": part(2), "file_type": part(3), "file_rank": part(4).try_cast("int")})


def weather(spark: SparkSession, path: str, variables: list[str]) -> DataFrame:
    """Hourly JSON with parallel arrays to one row per location and hour."""
    fields = ", ".join(f"{v}: array<double>" for v in variables)
    d = spark.read.schema(f"latitude double, longitude double, elevation double, timezone string, hourly struct<time: array<string>, {fields}>").option("multiLine", True).json(path)
    rows = d.select("latitude", "longitude", "elevation", "timezone", F.posexplode(F.arrays_zip("hourly.time", *[f"hourly.{v}" for v in variables])).alias("hour", "h"))
    return rows.select("latitude", "longitude", "elevation", "timezone", "hour", F.try_to_timestamp(F.col("h.time")).alias("time"), *[F.col(f"h.{v}").alias(v) for v in variables])


def geojson(spark: SparkSession, path: str) -> DataFrame:
    """Features of a GeoJSON file: geometry type, coordinates as JSON text, properties as a map."""
    schema = "features array<struct<geometry: struct<type: string, coordinates: string>, properties: map<string, string>>>"
    d = spark.read.schema(schema).option("multiLine", True).json(path)
    return d.select(F.posexplode("features").alias("feature_id", "f")).select("feature_id", F.col("f.geometry.type").alias("geom_type"), F.col("f.geometry.coordinates").alias("coordinates"), F.col("f.properties").alias("properties"))


def kml(spark: SparkSession, path: str) -> DataFrame:
    """Placemark points and outer rings: name, seq, lon, lat, z (missing as 0)."""
    schema = "name string, Point struct<coordinates: string>, LineString struct<coordinates: string>, Polygon struct<outerBoundaryIs: struct<LinearRing: struct<coordinates: string>>>"
    d = spark.read.format("xml").option("rowTag", "Placemark").schema(schema).load(path)
    c = F.coalesce("Point.coordinates", "LineString.coordinates", "Polygon.outerBoundaryIs.LinearRing.coordinates")
    p = d.select("name", F.posexplode(F.split(F.trim(c), r"\s+")).alias("seq", "c")).withColumn("c", F.split("c", ","))
    at = lambda i: F.get("c", F.lit(i)).try_cast("double")
    return p.select("name", "seq", at(0).alias("lon"), at(1).alias("lat"), F.coalesce(at(2), F.lit(0.0)).alias("z")).where("lon IS NOT NULL AND lat IS NOT NULL")


def parameters(text: str, defaults: dict | None = None) -> dict:
    """KEY = value lines over defaults: literals, yes/no words, else text.  Never executed."""
    out = dict(defaults or {})
    for line in text.splitlines():
        quote, cut = "", len(line)
        for i, ch in enumerate(line):
            if quote:
                quote = "" if ch == quote else quote
            elif ch in "'\"":
                quote = ch
            elif ch == "#":
                cut = i
                break
        key, eq, value = line[:cut].partition("=")
        if not eq or not key.strip():
            continue
        value = value.strip()
        word = value.lower()
        if word in ("yes", "true", "on"):
            out[key.strip()] = True
        elif word in ("no", "false", "off"):
            out[key.strip()] = False
        elif word in ("none", "null", ""):
            out[key.strip()] = None
        else:
            try:
                out[key.strip()] = ast.literal_eval(value)
            except (ValueError, SyntaxError):
                out[key.strip()] = value
    return out


def rank_selection(text: str) -> list[int] | None:
    """"all" as None, "1-3,7" as [1, 2, 3, 7]."""
    if text.strip().lower() == "all":
        return None
    out: set[int] = set()
    for part in filter(None, map(str.strip, text.split(","))):
        a, dash, b = part.partition("-")
        out.update(range(int(a), int(b if dash else a) + 1))
    return sorted(out)


def write_xyz(df: DataFrame, path: str, columns: list[str], digits: int = 8) -> None:
    """Space-separated text with fixed decimals, as many files as partitions."""
    kinds = dict(df.dtypes)
    parts = [F.format_string(f"%.{digits}f", c) if kinds[c] in ("double", "float") else F.col(c).cast("string") for c in columns]
    df.select(F.concat_ws(" ", *parts).alias("value")).write.text(path)


def path_geojson(paths: DataFrame) -> DataFrame:
    """(route, seq, x, y) to one LineString feature per route, as JSON text."""
    g = paths.groupBy("route").agg(F.transform(F.array_sort(F.collect_list(F.struct("seq", "x", "y"))), lambda p: F.array(p["x"], p["y"])).alias("coordinates"))
    return g.select("route", F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct("route").alias("properties"), F.struct(F.lit("LineString").alias("type"), "coordinates").alias("geometry"))).alias("json"))
