"""Geometry as column expressions: circles on the globe, rings held in arrays, clipped and sampled lines, cells on a line.

A ring is an array<struct<x, y>> without its closing vertex.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Mean earth radius, and the WGS-84 ellipsoid.
EARTH_KM = 6371.0088
WGS84_A, WGS84_F = 6378137.0, 1 / 298.257223563


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` over a value that is computed once."""
    return F.element_at(F.transform(F.array(value), body), 1)


def destination(lon: Column, lat: Column, bearing: Column, km: Column) -> tuple[Column, Column]:
    """Longitude (in -180..180) and latitude at a distance and bearing (degrees) on a sphere."""
    a, b, d = F.radians(lat), F.radians(bearing), km / EARTH_KM
    up = F.sin(a) * F.cos(d) + F.cos(a) * F.sin(d) * F.cos(b)
    east = F.radians(lon) + F.atan2(F.sin(b) * F.sin(d) * F.cos(a), F.cos(d) - F.sin(a) * up)
    return (F.degrees(east) + 540) % 360 - 180, F.degrees(F.asin(up))


def circles(df: DataFrame, lon: str, lat: str, km: str, n: int) -> DataFrame:
    """`df` with the n vertices of each circle and the first again: vertex, vertex_lon, vertex_lat."""
    d = df.withColumn("vertex", F.explode(F.sequence(F.lit(0), F.lit(n))))
    x, y = destination(F.col(lon), F.col(lat), F.col("vertex") % n * (360.0 / n), F.col(km))
    return d.withColumns({"vertex_lon": x, "vertex_lat": y})


def haversine(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    """Metres on a sphere: an approximation of `geodesic` to about half a percent."""
    h = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return 2000 * EARTH_KM * F.asin(F.sqrt(F.least(F.lit(1.0), h)))


def geodesic(lon1: Column, lat1: Column, lon2: Column, lat2: Column, rounds: int = 50) -> Column:
    """Metres on WGS-84 by Vincenty's inverse iteration, inside the JVM; null where it does not settle (near antipodes)."""
    f, a = WGS84_F, WGS84_A
    b = a * (1 - f)
    reduced = lambda lat: F.atan((1 - f) * F.tan(F.radians(lat)))

    def angles(p: Column, lam: Column, then: Callable[[Column], Column]) -> Column:
        """`then` over the sine, cosine and size of the arc, and the terms that hang on its azimuth."""
        s = F.hypot(p["c2"] * F.sin(lam), p["c1"] * p["s2"] - p["s1"] * p["c2"] * F.cos(lam))
        c = p["s1"] * p["s2"] + p["c1"] * p["c2"] * F.cos(lam)

        def azimuth(q: Column) -> Column:
            sin_a = F.when(q["s"] > 0, p["c1"] * p["c2"] * F.sin(lam) / q["s"]).otherwise(0.0)
            return let(sin_a, lambda z: let(1 - z * z, lambda w: let(F.struct(
                q["s"].alias("s"), q["c"].alias("c"), F.atan2(q["s"], q["c"]).alias("arc"), z.alias("sin_a"), w.alias("w"),
                F.when(w > 1e-15, q["c"] - 2 * p["s1"] * p["s2"] / w).otherwise(0.0).alias("m")), then)))

        return let(F.struct(s.alias("s"), c.alias("c")), azimuth)

    def step(p: Column, state: Column) -> Column:
        def moved(t: Column) -> Column:
            k = f / 16 * t["w"] * (4 + f * (4 - 3 * t["w"]))
            new = p["l"] + (1 - k) * f * t["sin_a"] * (t["arc"] + k * t["s"] * (t["m"] + k * t["c"] * (2 * t["m"] * t["m"] - 1)))
            return F.struct(new.alias("lam"), F.abs(new - state["lam"]).alias("change"))

        return F.when(state["change"] < 1e-12, state).otherwise(angles(p, state["lam"], moved))

    def length(t: Column) -> Column:
        u = t["w"] * ((a * a - b * b) / (b * b))
        big = 1 + u / 16384 * (4096 + u * (u * (320 - 175 * u) - 768))
        small = u / 1024 * (256 + u * (u * (74 - 47 * u) - 128))
        m2 = 2 * t["m"] * t["m"] - 1
        off = small * t["s"] * (t["m"] + small / 4 * (t["c"] * m2 - small / 6 * t["m"] * (4 * t["s"] * t["s"] - 3) * (4 * t["m"] * t["m"] - 3)))
        return b * big * (t["arc"] - off)

    def whole(p: Column) -> Column:
        begin = F.struct(p["l"].alias("lam"), F.lit(1.0).alias("change"))
        end = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), begin, lambda state, _: step(p, state))
        return let(end, lambda e: F.when(e["change"] < 1e-12, angles(p, e["lam"], length)))

    one, two = reduced(lat1), reduced(lat2)
    apart = F.radians((lon2 - lon1 + 540) % 360 - 180)
    return let(F.struct(F.sin(one).alias("s1"), F.cos(one).alias("c1"), F.sin(two).alias("s2"), F.cos(two).alias("c2"), apart.alias("l")), whole)


def sides(ring: Column) -> Column:
    """The sides of a ring as array<struct<a, b>>; of fewer than three vertices none."""
    turned = F.concat(F.slice(ring, 2, F.greatest(F.size(ring) - 1, F.lit(0))), F.slice(ring, 1, 1))
    pairs = F.zip_with(ring, turned, lambda a, b: F.struct(a.alias("a"), b.alias("b")))
    return F.when(F.size(ring) >= 3, pairs).otherwise(F.slice(pairs, 1, 0))


def ring_area(ring: Column) -> Column:
    """Shoelace area."""
    return F.abs(F.aggregate(sides(ring), F.lit(0.0), lambda t, s: t + s["a"]["x"] * s["b"]["y"] - s["b"]["x"] * s["a"]["y"])) / 2


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Even-odd test against a ring column; a point on a left or lower side is inside, on a right or upper side outside."""
    def crosses(s: Column) -> Column:
        at = (s["b"]["x"] - s["a"]["x"]) * (y - s["a"]["y"]) / (s["b"]["y"] - s["a"]["y"]) + s["a"]["x"]
        return F.when((s["a"]["y"] > y) != (s["b"]["y"] > y), F.when(x < at, 1).otherwise(0)).otherwise(0)

    return F.aggregate(sides(ring), F.lit(0), lambda n, s: n + crosses(s)) % 2 == 1


def rasterised(shapes: DataFrame, size: float, value: str = "value", order: str = "draw_order", ring: str = "ring") -> DataFrame:
    """Cells (ix, iy, value) whose centres lie in a ring; the last drawn shape wins.  A shape meets only cells of its own box."""
    xs, ys = F.transform(ring, lambda p: p["x"]), F.transform(ring, lambda p: p["y"])
    cells = lambda v: F.sequence(F.floor(F.array_min(v) / size), F.floor(F.array_max(v) / size))
    d = shapes.where(F.size(ring) >= 3).select(ring, value, order, F.explode(cells(xs)).alias("ix"), ys.alias("ys"))
    d = d.select(ring, value, order, "ix", F.explode(cells(F.col("ys"))).alias("iy"))
    inside = d.where(in_ring((F.col("ix") + 0.5) * size, (F.col("iy") + 0.5) * size, F.col(ring)))
    return inside.groupBy("ix", "iy").agg(F.max_by(value, order).alias(value))


def clipped(x1: Column, y1: Column, x2: Column, y2: Column, ring: list[tuple[float, float]]) -> Column:
    """The part of a segment inside a convex ring (counter-clockwise) as struct<lo, hi> of 0..1; null if none."""
    lo, hi, out = F.lit(0.0), F.lit(1.0), F.lit(False)
    for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1]):
        d1 = (bx - ax) * (y1 - ay) - (by - ay) * (x1 - ax)
        d2 = (bx - ax) * (y2 - ay) - (by - ay) * (x2 - ax)
        lo = F.greatest(lo, F.when((d1 < 0) & (d2 >= 0), d1 / (d1 - d2)).otherwise(0.0))
        hi = F.least(hi, F.when((d1 >= 0) & (d2 < 0), d1 / (d1 - d2)).otherwise(1.0))
        out = out | ((d1 < 0) & (d2 < 0))
    return F.when(~out & (lo <= hi), F.struct(lo.alias("lo"), hi.alias("hi")))


def sampled(df: DataFrame, step: float, x1: str = "x1", y1: str = "y1", x2: str = "x2", y2: str = "y2") -> DataFrame:
    """`df` with a point every `step` from the start of each segment, and always its end: sample, sx, sy."""
    d = df.withColumn("__l", F.hypot(F.col(x2) - F.col(x1), F.col(y2) - F.col(y1))).where("__l IS NOT NULL")
    d = d.withColumn("sample", F.explode(F.sequence(F.lit(0), F.ceil(F.col("__l") / step).cast("int"))))
    t = F.when(F.col("__l") > 0, F.least(F.lit(1.0), F.col("sample") * step / F.col("__l"))).otherwise(0.0)
    return d.withColumns({"sx": F.col(x1) + t * (F.col(x2) - F.col(x1)), "sy": F.col(y1) + t * (F.col(y2) - F.col(y1))}).drop("__l")


def line_cells(df: DataFrame, x1: str = "x1", y1: str = "y1", x2: str = "x2", y2: str = "y2") -> DataFrame:
    """`df` with the integer cells of a digital line between two cells, a cell for each unit of the longer axis: place, cx, cy."""
    n = F.greatest(F.abs(F.col(x2) - F.col(x1)), F.abs(F.col(y2) - F.col(y1))).cast("long")
    d = df.withColumn("__n", n).where("__n IS NOT NULL").withColumn("place", F.explode(F.sequence(F.lit(0).cast("long"), "__n")))
    at = lambda a, b: F.floor(F.col(a) + F.when(F.col("__n") > 0, F.col("place") * (F.col(b) - F.col(a)) / F.col("__n")).otherwise(0.0) + 0.5).cast("long")
    return d.withColumns({"cx": at(x1, x2), "cy": at(y1, y2)}).drop("__n")


def coverage(cells: DataFrame, stations: DataFrame, key: str = "id") -> DataFrame:
    """(key, support): the best weight * exp(-dist / reach) of stations (x, y, weight, reach) that reach a cell, else 0.

    A station meets cells in squares of its own size class (the next power of two), so wide and narrow ones need no common square.
    Of stations of one place and reach the heaviest stands for all, and all cells of a place share its support.
    """
    s = stations.where("reach > 0").groupBy("x", "y", "reach").agg(F.max("weight").alias("weight")).select(F.col("x").alias("rx"), F.col("y").alias("ry"), "weight", "reach", F.ceil(F.log2("reach")).cast("int").alias("__c"))
    classes = s.agg(F.collect_set("__c").alias("classes")).first()["classes"]  # one per power of two
    side = lambda v: F.floor(F.col(v) / F.pow(F.lit(2.0), F.col("__c"))).cast("long")
    around = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    r = s.withColumn("__o", F.explode(around)).withColumns({"__x": side("rx") + F.col("__o.i"), "__y": side("ry") + F.col("__o.j")}).drop("__o")
    c = cells.select("x", "y").distinct().withColumn("__c", F.explode(F.array(*map(F.lit, classes)).cast("array<int>"))).withColumns({"__x": side("x"), "__y": side("y")})
    d = F.hypot(F.col("x") - F.col("rx"), F.col("y") - F.col("ry"))
    best = c.join(r, ["__c", "__x", "__y"]).withColumn("d", d).where("d <= reach").groupBy("x", "y").agg(F.max(F.col("weight") * F.exp(-F.col("d") / F.col("reach"))).alias("support"))
    return cells.select(key, "x", "y").join(best, ["x", "y"], "left").select(key, F.coalesce("support", F.lit(0.0)).alias("support"))


def box(x0: float, y0: float, x1: float, y1: float) -> list[tuple[float, float]]:
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]
