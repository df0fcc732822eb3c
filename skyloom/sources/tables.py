"""Scans of model, plan, route, building and cell tables, their discovery, and the files that results go to."""

from __future__ import annotations

import math
from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.classes import valid_place
from ..functions.columns import label_prefix


def _fields(spark: SparkSession, path: str | list[str], least: int) -> DataFrame:
    """Lines as `p`, their fields: comments, blank and short lines are skipped; fields part at white space or commas."""
    t = spark.read.text(path).select(F.trim(F.regexp_replace("value", r"[\s,]+", " ")).alias("raw"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_name").alias("file_name"))
    return t.where("raw <> '' AND NOT startswith(raw, '#')").select("raw", "file", "file_name", F.split("raw", " ").alias("p")).where(F.size("p") >= least)


def _number(i: int) -> Column:
    return F.get("p", F.lit(i)).try_cast("double")


def cost_model(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z, slowness, density, label of lines with 4 or more fields.  The fifth field is the density if it is a number in more than half
    of the lines that have one, else the label; a label is the last field that is no number."""
    p = _fields(spark, path, 4)
    share = p.agg(F.avg(F.when(F.size("p") >= 5, _number(4).isNotNull().cast("int")))).first()[0]
    density = _number(4) if (share or 0) > 0.5 else F.lit(None).cast("double")
    label = F.when((F.size("p") >= 5) & F.element_at("p", -1).try_cast("double").isNull(), F.element_at("p", -1))
    return p.select(_number(0).alias("x"), _number(1).alias("y"), _number(2).alias("z"), _number(3).alias("slowness"), density.alias("density"), label.alias("label")).where("x IS NOT NULL AND y IS NOT NULL AND slowness IS NOT NULL")


def plane_model(spark: SparkSession, path: str) -> DataFrame:
    """lon, lat, z, slowness; of lines with one place the last stays."""
    p = _fields(spark, path, 4).withColumn("at", F.monotonically_increasing_id())
    d = p.select(*[_number(i).alias(c) for i, c in enumerate(("lon", "lat", "z", "slowness"))], "at").where("lon IS NOT NULL AND lat IS NOT NULL AND slowness IS NOT NULL")
    return d.groupBy("lon", "lat").agg(F.max_by(F.struct("z", "slowness"), "at").alias("v")).select("lon", "lat", "v.z", "v.slowness")


def node_model(spark: SparkSession, path: str, default: str = "NODE") -> DataFrame:
    """x, y, z, slowness, label, label_prefix of lines with 4 to 6 fields: the fifth is the label, else `default`; the sixth the prefix, else the label's."""
    p = _fields(spark, path, 4).where(F.size("p") <= 6)
    d = p.select(*[_number(i).alias(c) for i, c in enumerate(("x", "y", "z", "slowness"))], F.coalesce(F.get("p", F.lit(4)), F.lit(default)).alias("label"), F.get("p", F.lit(5)).alias("given"))
    return d.where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND slowness IS NOT NULL").select("x", "y", "z", "slowness", "label", F.coalesce(F.upper("given"), label_prefix(F.col("label"))).alias("label_prefix"))


def sniffed(spark: SparkSession, path: str, names: Sequence[str] = ("x", "y", "z", "slowness", "label")) -> DataFrame:
    """A table with or without a header, separated by comma, semicolon, tab or white space: decided on its first line, read in one scan."""
    first = spark.read.text(path).where("trim(value) <> '' AND NOT startswith(trim(value), '#')").limit(1).collect()
    if not first:
        return spark.createDataFrame([], ", ".join(f"`{n}` string" for n in names))
    line = first[0]["value"].strip()
    sep = next((s for s in (",", ";", "\t") if s in line), r"\s+")
    import re

    parts = [p.strip().strip('"') for p in re.split(sep, line)]

    def number(text: str) -> bool:
        try:
            return math.isfinite(float(text))
        except ValueError:
            return False

    header = not any(map(number, parts))
    columns = parts if header else [*names[:len(parts)], *(f"c{i}" for i in range(len(names), len(parts)))]
    t = spark.read.text(path).select(F.trim("value").alias("raw")).where("raw <> '' AND NOT startswith(raw, '#')")
    t = t.where(F.col("raw") != line) if header else t
    p = t.select(F.split("raw", sep).alias("p"))
    return p.select(*[F.trim(F.get("p", F.lit(i)), F.lit('" ')).alias(c) for i, c in enumerate(columns)])


def planning_model(spark: SparkSession, path: str, defaults: dict[str, object], sep: str = " ") -> DataFrame:
    """A table with a header; columns of `defaults` that it lacks are added, and their missing values filled."""
    d = spark.read.option("header", True).option("sep", sep).option("inferSchema", True).csv(path)
    for name, value in defaults.items():
        d = d.withColumn(name, F.coalesce(F.col(name), F.lit(value)) if name in d.columns else F.lit(value))
    return d


def route_files(spark: SparkSession, folder: str, include: str = "*.csv", exclude: Sequence[str] = ()) -> DataFrame:
    """Rows of the route files of a folder (with `file_name`) whose names fit `include` and hold none of the `exclude` words."""
    d = spark.read.option("header", True).option("pathGlobFilter", include).option("recursiveFileLookup", True).csv(folder).withColumn("file_name", F.col("_metadata.file_name"))
    for word in exclude:
        d = d.where(~F.lower("file_name").contains(word.lower()))
    return d


def padded(spark: SparkSession, path: str) -> DataFrame:
    """x, y, z, value of lines with 2, 3 or 4 fields: two are a place (z and value 0), three a place and its value, four all."""
    p = _fields(spark, path, 2)
    z = F.when(F.size("p") >= 4, _number(2)).otherwise(0.0)
    value = F.when(F.size("p") >= 4, _number(3)).when(F.size("p") == 3, _number(2)).otherwise(0.0)
    return p.select(_number(0).alias("x"), _number(1).alias("y"), z.alias("z"), value.alias("value")).where("x IS NOT NULL AND y IS NOT NULL AND z IS NOT NULL AND value IS NOT NULL")


def plans(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """name, lon, lat, z of plan files or folders of them, united: 2, 3 or 4 fields (lon lat, lon lat z, lon lat z name); a missing z is 0, a
    missing name the file's stem."""
    p = _fields(spark, paths, 2)
    stem = F.regexp_replace("file_name", r"\.[^.]*$", "")
    name = F.when(F.size("p") >= 4, F.array_join(F.slice("p", 4, F.size("p")), " ")).otherwise(stem)
    return p.select(name.alias("name"), _number(0).alias("lon"), _number(1).alias("lat"), F.coalesce(_number(2), F.lit(0.0)).alias("z"), "file").where("lon IS NOT NULL AND lat IS NOT NULL")


#: Names of columns that hold geometry or heights, in order of preference.
GEOMETRY, HEIGHT = ("geometry", "geom", "wkb_geometry", "wkb"), ("height", "height_m", "building_height", "var", "h")


def buildings(spark: SparkSession, path: str, box: tuple[float, float, float, float] | None = None, x: str = "lon", y: str = "lat") -> DataFrame:
    """Parquet buildings: only the place, the geometry column and the height column (found in the schema, named `height`) are read, and only row
    groups that meet the box (west, south, east, north)."""
    d = spark.read.parquet(path)
    low = {c.lower(): c for c in d.columns}
    geometry, height = (next((low[n] for n in names if n in low), None) for names in (GEOMETRY, HEIGHT))
    d = d.select(x, y, *([F.col(geometry).alias("geometry")] if geometry else []), (F.col(height).cast("double") if height else F.lit(None).cast("double")).alias("height"))
    return d if box is None else d.where((F.col(x) >= box[0]) & (F.col(x) <= box[2]) & (F.col(y) >= box[1]) & (F.col(y) <= box[3]))


def degree_tiles(spark: SparkSession, west: float, south: float, east: float, north: float, step: int = 5) -> DataFrame:
    """Tiles of `step` degrees that cover a box: tile_name from west, north, east and south, and the bounds."""
    low, high = (lambda v: math.floor(v / step) * step), (lambda v: math.ceil(v / step) * step)
    starts = lambda a, b: F.sequence(F.lit(low(a)), F.lit(high(b) - step), F.lit(step)) if high(b) > low(a) else F.array().cast("array<int>")
    d = spark.range(1).select(F.explode(starts(west, east)).alias("lon_min")).withColumn("lat_min", F.explode(starts(south, north)))
    d = d.withColumns({"lon_max": F.col("lon_min") + step, "lat_max": F.col("lat_min") + step})
    said = lambda c, minus, plus: F.concat(F.when(F.col(c) < 0, minus).otherwise(plus), F.abs(c).cast("string"))
    name = F.concat_ws("_", said("lon_min", "w", "e"), said("lat_max", "s", "n"), said("lon_max", "w", "e"), said("lat_min", "s", "n"))
    return d.select(name.alias("tile_name"), "lon_min", "lat_min", "lon_max", "lat_max")


def map_tiles(spark: SparkSession, west: float, south: float, east: float, north: float, zoom: int) -> DataFrame:
    """Slippy-map tiles (zoom, tx, ty) that meet a box; rows count from the north."""
    from ..functions.columns import tile_of

    d = spark.range(1).select(*[t.alias(n) for (t, n) in zip((*tile_of(F.lit(west), F.lit(north), zoom), *tile_of(F.lit(east), F.lit(south), zoom)), ("x0", "y0", "x1", "y1"))])
    last = (1 << zoom) - 1
    span = lambda a, b: F.explode(F.sequence(F.greatest(F.lit(0).cast("long"), F.least(a, b)), F.least(F.lit(last).cast("long"), F.greatest(a, b))))
    return d.select(F.lit(zoom).alias("zoom"), span("x0", "x1").alias("tx"), "y0", "y1").select("zoom", "tx", span("y0", "y1").alias("ty"))


#: Columns of a cell tower table without a header.
CELL = ("radio", "mcc", "net", "area", "cell", "unit", "lon", "lat", "range", "samples", "changeable", "created", "updated", "averageSignal")


def cell_towers(spark: SparkSession, path: str, code: int | None = None) -> DataFrame:
    """A cell tower CSV, plain or gzip, with or without its header; rows out of range or of another country code go."""
    d = spark.read.schema(", ".join(f"`{c}` string" for c in CELL)).csv(path).where(F.lower(F.trim("radio")) != "radio")
    d = d.withColumns({c: F.col(c).try_cast("double") for c in CELL[1:]})
    return d.where(valid_place(F.col("lon"), F.col("lat"), F.col("mcc"), code))


def united_buildings(parts: dict[str, DataFrame], key: str = "geometry") -> DataFrame:
    """Rows of all parts with `source`, one of each geometry (that of the first source by name; without geometry all stay)."""
    every = None
    for name, d in sorted(parts.items()):
        d = d.withColumn("source", F.lit(name))
        every = d if every is None else every.unionByName(d, allowMissingColumns=True)
    best = every.where(F.col(key).isNotNull()).groupBy(key).agg(F.min_by(F.struct(*[c for c in every.columns if c != key]), "source").alias("v")).select(key, "v.*")
    return best.select(*every.columns).unionByName(every.where(F.col(key).isNull()))


def file_table(spark: SparkSession, folder: str) -> DataFrame:
    """path, name, bytes and modified of all files below a folder, from the listing: no content is read."""
    d = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path", "length", F.col("modificationTime").alias("modified"))
    return d.select("path", F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"), "modified")


def scored(files: DataFrame, words: dict[str, int], suffixes: Sequence[str] = ()) -> DataFrame:
    """`files` with `score`, the sum of the points of the words in a name (fewer are better), of the suffixes asked for."""
    low = F.lower("name")
    points = sum((F.when(low.contains(w.lower()), p).otherwise(0) for w, p in words.items()), F.lit(0))
    d = files.withColumn("score", points)
    return d.where(F.concat(*[F.when(low.endswith(s.lower()), "y").otherwise("") for s in suffixes]) != "") if suffixes else d


def best_file(files: DataFrame) -> str | None:
    """The path of the least score, ties to the least path."""
    return files.agg(F.min(F.struct("score", "path")).alias("m")).first()["m"]["path"] if files.limit(1).count() else None


def classified(files: DataFrame, rules: Sequence[tuple[str, str]], otherwise: str = "other") -> DataFrame:
    """`files` with `category`, by the first rule (regular expression over the path, in lower case) that fits."""
    out = None
    for pattern, name in rules:
        hit = F.lower("path").rlike(pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return files.withColumn("category", F.lit(otherwise) if out is None else out.otherwise(otherwise))


def profile(df: DataFrame) -> DataFrame:
    """One row per column: rows, missing, distinct (estimated), and least, mean and greatest of numbers."""
    kinds = dict(df.dtypes)
    numeric = lambda c: kinds[c] in ("double", "float", "int", "bigint", "smallint", "tinyint") or kinds[c].startswith("decimal")
    nothing = F.lit(None).cast("double")
    parts = []
    for c in df.columns:
        v = F.col(f"`{c}`")
        n = v.cast("double")
        parts.append(F.struct(F.lit(c).alias("column"), F.lit(kinds[c]).alias("type"), F.count("*").alias("n"), F.count_if(v.isNull()).alias("missing"),
                              *[(f(n) if numeric(c) else nothing).alias(k) for k, f in (("least", F.min), ("mean", F.avg), ("greatest", F.max))]))
    return df.agg(F.array(*parts).alias("all")).select(F.inline("all"))


def forecast_requests(points: DataFrame, hours: int, now: datetime, start: datetime | None = None, most: int = 50) -> DataFrame:
    """`points` (id, lon, lat) with `call`, at most `most` points a call in order of id, and the window [first, last] in whole hours: from `start`, or
    from the hour that `now` lies in."""
    first = (start or now).replace(minute=0, second=0, microsecond=0)
    from ..operators.model import numbered

    n = numbered(points, ["id"], "__n")
    d = points.join(n, "id").withColumn("call", F.floor(F.col("__n") / most).cast("long")).drop("__n")
    return d.withColumns({"first": F.lit(first), "last": F.lit(first + timedelta(hours=hours))})


def request_box(ring: list[tuple[float, float]], padding: float = 0.0) -> list[float]:
    """North, west, south, east of a ring of (lon, lat), padded and kept on the globe."""
    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    return [min(90.0, max(ys) + padding), max(-180.0, min(xs) - padding), max(-90.0, min(ys) - padding), min(180.0, max(xs) + padding)]


def sub_boxes(spark: SparkSession, west: float, south: float, east: float, north: float, step: float) -> DataFrame:
    """A box as boxes of `step` degrees at most: west, south, east, north."""
    across, up = (max(1, math.ceil((b - a) / step - 1e-9)) for a, b in ((west, east), (south, north)))
    d = spark.range(across * up).select((F.col("id") % across).alias("i"), F.floor(F.col("id") / across).alias("j"))
    return d.select((west + F.col("i") * step).alias("west"), (south + F.col("j") * step).alias("south"), F.least(F.lit(east), west + (F.col("i") + 1) * step).alias("east"), F.least(F.lit(north), south + (F.col("j") + 1) * step).alias("north"))


def polygon_samples(spark: SparkSession, ring: list[tuple[float, float]], step: float, digits: int = 6) -> DataFrame:
    """Distinct rounded points (x, y): of a grid of `step` from the ring's corner those inside or on it, its corners, and its centroid."""
    from ..operators.spatial import in_polygon

    xs, ys = [p[0] for p in ring], [p[1] for p in ring]
    nx, ny = (int((max(v) - min(v)) / step + 1e-9) + 1 for v in (xs, ys))
    g = spark.range(nx * ny).select((min(xs) + F.col("id") % nx * step).alias("x"), (min(ys) + F.floor(F.col("id") / nx) * step).alias("y"))
    g = g.where(in_polygon(F.col("x"), F.col("y"), [(float(a), float(b)) for a, b in ring]))
    twice = sum(a * d - c * b for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1]))
    cx = sum((a + c) * (a * d - c * b) for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1])) / (3 * twice) if twice else sum(xs) / len(xs)
    cy = sum((b + d) * (a * d - c * b) for (a, b), (c, d) in zip(ring, ring[1:] + ring[:1])) / (3 * twice) if twice else sum(ys) / len(ys)
    extra = spark.createDataFrame([(float(a), float(b)) for a, b in [*ring, (cx, cy)]], "x double, y double")
    return g.union(extra).select(F.round("x", digits).alias("x"), F.round("y", digits).alias("y")).distinct()


def vertices(features: DataFrame, key: str = "feature_id", parts: str = "parts") -> DataFrame:
    """(key, part, seq, x, y) of array<array<struct<x, y>>>."""
    d = features.select(key, F.posexplode(parts).alias("part", "__p"))
    return d.select(key, "part", F.posexplode("__p").alias("seq", "__v")).select(key, "part", "seq", "__v.x", "__v.y")


# --- sinks

def write_vertices(rows: DataFrame, path: str, key: str = "feature_id") -> None:
    """x y lines in order of key, part and place, with a line of NaN after each part, by range of the key."""
    after = rows.groupBy(key, "part").agg((F.max("seq") + 1).alias("seq")).withColumns({"x": F.lit(float("nan")), "y": F.lit(float("nan"))})
    every = rows.select(key, "part", "seq", "x", "y").unionByName(after.select(key, "part", "seq", "x", "y")).repartitionByRange(key).sortWithinPartitions(key, "part", "seq")
    every.select(F.concat_ws(" ", F.col("x").cast("string"), F.col("y").cast("string")).alias("value")).write.text(path)


def write_summary(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, null fields included."""
    df.write.option("ignoreNullFields", "false").json(path)


def write_groups(df: DataFrame, path: str, group: str) -> None:
    """A folder per value of a column (null included), each group written by as many tasks as AQE gives it."""
    df.repartition(F.col(group)).write.partitionBy(group).option("header", True).csv(path)


def write_voxels(voxels: DataFrame, path: str, burned: Column) -> None:
    """all, flyable and burned subsets as Parquet, and a summary with their counts."""
    b = F.coalesce(burned, F.lit(False))
    d = voxels.withColumn("burned", b)
    d.write.parquet(f"{path}/all")
    back = voxels.sparkSession.read.schema(d.schema).parquet(f"{path}/all")
    back.where("NOT burned").write.parquet(f"{path}/flyable")
    back.where("burned").write.parquet(f"{path}/burned")
    write_summary(back.agg(F.count("*").alias("total"), F.count_if("burned").alias("burned"), F.count_if(~F.col("burned")).alias("flyable")), f"{path}/summary")


def add_manifest(rows: DataFrame, path: str) -> None:
    """Append category, type, src, dst and status to a manifest; other columns are left out."""
    rows.select("category", "type", "src", "dst", "status").write.mode("append").option("header", True).csv(path)


def path_kml(paths: DataFrame) -> DataFrame:
    """(route, seq, lon, lat, z) to one Placemark per route, as KML text."""
    at = F.concat_ws(",", F.format_string("%.8f", "lon"), F.format_string("%.8f", "lat"), F.format_string("%.3f", F.coalesce("z", F.lit(0.0))))
    g = paths.groupBy("route").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", at.alias("c")))), lambda p: p["c"]), " ").alias("c"))
    name = F.replace(F.replace(F.replace(F.col("route").cast("string"), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
    return g.select("route", F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><kml xmlns="http://www.opengis.net/kml/2.2"><Document><Placemark><name>'), name, F.lit("</name><LineString><coordinates>"), "c", F.lit("</coordinates></LineString></Placemark></Document></kml>")).alias("kml"))
