"""Spatial joins as equi-joins on grid cells, so that a distance predicate never becomes a nested loop."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import clean
from .graph import components, cut, written


def cell(x: Column, size: float) -> Column:
    return F.floor(x / size).cast("long")


def radius_join(left: DataFrame, right: DataFrame, radius: float, lx: str = "x", ly: str = "y", rx: str = "rx", ry: str = "ry") -> DataFrame:
    """All pairs within `radius`, with `dist`.  The right side goes to its cell and the 8 around it."""
    offsets = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)])
    r = right.withColumn("__o", F.explode(offsets)).withColumns({"__cx": cell(F.col(rx), radius) + F.col("__o.i"), "__cy": cell(F.col(ry), radius) + F.col("__o.j")}).drop("__o")
    l = left.withColumns({"__cx": cell(F.col(lx), radius), "__cy": cell(F.col(ly), radius)})
    d = F.sqrt(F.pow(F.col(lx) - F.col(rx), 2) + F.pow(F.col(ly) - F.col(ry), 2))
    return l.join(r, ["__cx", "__cy"]).withColumn("dist", d).where(F.col("dist") <= radius).drop("__cx", "__cy")


def within_pairs(points: DataFrame, radius: float, key: str = "id") -> DataFrame:
    """Unordered pairs (a, b, dist), a < b, of points (key, x, y) within `radius`."""
    a = points.select(F.col(key).alias("a"), "x", "y")
    b = points.select(F.col(key).alias("b"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    return radius_join(a, b, radius).where("a < b").select("a", "b", "dist")


def _packed(points: DataFrame, radius: float) -> DataFrame:
    """Places (key, x, y, ...) that are finite, with cells (__cx, __cy) so small that all places of a cell are within `radius`."""
    side = radius / math.sqrt(2) * (1 - 1e-6)
    return finite(points).where("x IS NOT NULL AND y IS NOT NULL").withColumns({"__cx": cell(F.col("x"), side), "__cy": cell(F.col("y"), side)})


def _spread(cells: DataFrame, half: bool = False) -> DataFrame:
    """Rows of (__cx, __cy, ...) at each of the 25 cells that may hold a place within the radius; `half`: one of each two directions, without their own."""
    around = [(i, j) for i in range(-2, 3) for j in range(-2, 3) if not half or (i, j) > (0, 0)]
    d = cells.withColumn("__o", F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i, j in around])))
    return d.withColumns({"__cx": F.col("__cx") + F.col("__o.i"), "__cy": F.col("__cy") + F.col("__o.j")}).drop("__o")


def _apart(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt(F.pow(ax - bx, 2) + F.pow(ay - by, 2))


def _joined_cells(packed: DataFrame, radius: float, key: str) -> DataFrame:
    """(__cx, __cy, places, component): the cells of `packed` (distinct places in an array) and the least key that links within `radius` reach."""
    cells = written(packed.groupBy("__cx", "__cy").agg(F.min(key).alias("__least"), F.collect_set(F.struct("x", "y")).alias("places")))
    other = _spread(cells.select("__cx", "__cy", F.col("__least").alias("dst"), F.col("places").alias("__there")), half=True)
    meet = F.exists("places", lambda p: F.exists("__there", lambda q: _apart(p["x"], p["y"], q["x"], q["y"]) <= radius))
    links = cells.join(other, ["__cx", "__cy"]).where(meet).select(F.col("__least").alias("src"), "dst")
    found = written(components(cells.select(F.col("__least").alias("node")), links))
    return cells.join(found, cells["__least"] == found["node"]).select("__cx", "__cy", "places", "component")


def linked(points: DataFrame, radius: float, key: str = "id") -> DataFrame:
    """(key, component): the least key reachable from each point (key, x, y) by links of `radius` at most.

    All links, but not all pairs: points of a small cell are one node, and two cells are linked once.  Places that are not finite are alone.
    """
    if not radius > 0:
        return points.select(key, F.col(key).alias("component"))
    packed = _packed(points.select(key, "x", "y"), radius)
    inside = packed.join(_joined_cells(packed, radius, key), ["__cx", "__cy"]).select(key, "component")
    return points.select(key).join(inside, key, "left").select(key, F.coalesce("component", key).alias("component"))


def density_clusters(points: DataFrame, radius: float, least_weight: float) -> DataFrame:
    """Weighted DBSCAN of points (node, x, y, weight; weights not below 0) as `graph.dbscan` has it: node, cluster, is_core.

    No pairs are made: a cell that weighs `least_weight` has only core points; the others add up what the cells around them hold.
    """
    packed = written(_packed(points.select("node", "x", "y", F.col("weight").cast("double").alias("weight")), radius))
    if packed.where("weight < 0").limit(1).count():
        raise ValueError("weights below 0")
    places = packed.groupBy("__cx", "__cy", "x", "y").agg(F.sum("weight").alias("weight"))
    cells = written(places.groupBy("__cx", "__cy").agg(F.sum("weight").alias("__w"), F.collect_list(F.struct("x", "y", "weight")).alias("places")))
    heavy = F.coalesce(F.col("__w") >= least_weight, F.lit(False))
    d = written(packed.join(cells.select("__cx", "__cy", heavy.alias("__heavy")), ["__cx", "__cy"]))
    near = lambda q: _apart(F.col("x"), F.col("y"), q["x"], q["y"]) <= radius
    here = F.aggregate("places", F.lit(0.0), lambda t, q: t + F.when(near(q), F.coalesce(q["weight"], F.lit(0.0))).otherwise(0.0))
    around = d.where("NOT __heavy").join(_spread(cells.select("__cx", "__cy", "places")), ["__cx", "__cy"]).groupBy("node").agg(F.sum(here).alias("around"))
    flagged = d.join(around, "node", "left").withColumn("is_core", F.col("__heavy") | F.coalesce(F.col("around") >= least_weight, F.lit(False)))
    flagged = written(flagged.select("node", "x", "y", "__cx", "__cy", "is_core"))
    joined = written(_joined_cells(flagged.where("is_core"), radius, "node"))
    core = flagged.where("is_core").join(joined.select("__cx", "__cy", "component"), ["__cx", "__cy"]).select("node", F.col("component").alias("cluster"))
    border = flagged.where("NOT is_core").join(_spread(joined), ["__cx", "__cy"]).where(F.exists("places", near)).groupBy("node").agg(F.min("component").alias("cluster"))
    of = core.union(border)
    alone = F.coalesce(F.col("weight") >= least_weight, F.lit(False))  # a place that is not finite has itself
    lone = points.join(packed.select("node"), "node", "left_anti").select("node", F.when(alone, F.col("node")).alias("cluster"), alone.alias("is_core"))
    return flagged.select("node", "is_core").join(of, "node", "left").select("node", "cluster", "is_core").union(lone)


def finite(d: DataFrame) -> DataFrame:
    """`d` with x and y null where they are NaN or infinite."""
    return d.withColumns({c: F.when(F.abs(clean(F.col(c))) < float("inf"), F.col(c)) for c in ("x", "y")})


def nearest(points: DataFrame, sites: DataFrame, reach: float, key: str = "id", site: str = "site") -> DataFrame:
    """The nearest site of each point (ties to the least site): key, site, dist; null and no distance if there are no sites.

    Rounds of radius joins with doubling reach; points that found a site within a round's reach are done.  Each
    round's points are checkpointed, so a round does not repeat the ones before it.  Coordinates that are null, NaN or infinite are nowhere:
    such sites are no one's nearest, such points have none.
    """
    points, sites = finite(points.select(key, "x", "y")), finite(sites.select(site, "x", "y"))
    sites = sites.where("x IS NOT NULL AND y IS NOT NULL").groupBy(F.col("x").alias("rx"), F.col("y").alias("ry")).agg(F.min(site).alias(site))
    nowhere = lambda d: d.select(key, F.lit(None).cast(dict(sites.dtypes)[site]).alias(site), F.lit(None).cast("double").alias("dist"))
    placed = points.select(key, "x", "y").where("x IS NOT NULL AND y IS NOT NULL")
    out = nowhere(points.where("x IS NULL OR y IS NULL"))
    if not sites.limit(1).count():
        return out.unionByName(nowhere(placed))
    left = cut(placed)
    while left.limit(1).count():
        hit = radius_join(left, sites, reach).groupBy(key).agg(F.min(F.struct("dist", site)).alias("m")).select(key, F.col(f"m.{site}").alias(site), F.col("m.dist").alias("dist"))
        hit = cut(hit)
        out, left, reach = out.unionByName(hit), cut(left.join(hit.select(key), key, "left_anti")), reach * 2
    return out


def nearest_of_few(points: DataFrame, sites: DataFrame, key: str = "id", site: str = "site", limit: int = 10_000, reach: float = 1.0) -> DataFrame:
    """As `nearest`; up to `limit` sites are broadcast as one array, more go through the grid."""
    points, sites = finite(points.select(key, "x", "y")), finite(sites.select(site, "x", "y")).where("x IS NOT NULL AND y IS NOT NULL")
    if sites.limit(limit + 1).count() > limit:
        return nearest(points, sites, reach, key, site)
    one = sites.agg(F.sort_array(F.collect_list(F.struct(F.col(site).alias("s"), "x", "y"))).alias("__sites"))
    d = lambda s: F.sqrt(F.pow(F.col("x") - s["x"], 2) + F.pow(F.col("y") - s["y"], 2))
    best = F.array_min(F.transform("__sites", lambda s: F.struct(d(s).alias("dist"), s["s"].alias("s"))))
    best = F.when(F.col("x").isNotNull() & F.col("y").isNotNull(), best)
    return points.crossJoin(F.broadcast(one)).select(key, best.alias("m")).select(key, F.col("m.s").alias(site), F.col("m.dist").alias("dist"))


def knn(points: DataFrame, k: int, radius: float, key: str = "id") -> DataFrame:
    """Up to k neighbours within `radius`, nearest first: (key, neighbour, dist, rank)."""
    b = points.select(F.col(key).alias("neighbour"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    near = radius_join(points.select(key, "x", "y"), b, radius).where(F.col(key) != F.col("neighbour"))
    return near.withColumn("rank", F.expr(f"row_number() OVER (PARTITION BY {key} ORDER BY dist, neighbour)")).where(F.col("rank") <= k).select(key, "neighbour", "dist", "rank")


def in_polygon(x: Column, y: Column, ring: list[tuple[float, float]], covers: bool = True) -> Column:
    """Ray casting over the edges of a closed ring; points on an edge count if `covers`."""
    crossings, on_edge = F.lit(0), F.lit(False)
    for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
        if (x1, y1) == (x2, y2):
            continue
        if y1 != y2:
            at = (x2 - x1) * (y - y1) / (y2 - y1) + x1
            crossings = crossings + F.when(((F.lit(y1) > y) != (F.lit(y2) > y)) & (x < at), 1).otherwise(0)
        cross = (x - x1) * (y2 - y1) - (y - y1) * (x2 - x1)
        on_edge = on_edge | ((F.abs(cross) <= 1e-12) & x.between(min(x1, x2), max(x1, x2)) & y.between(min(y1, y2), max(y1, y2)))
    inside = crossings % 2 == 1
    return (inside | on_edge) if covers else (inside & ~on_edge)


def overlap_join(left: DataFrame, right: DataFrame, key: str, lo: str, hi: str, base: str, top: str) -> DataFrame:
    """Pairs with one key whose intervals overlap strictly: touching faces do not collide."""
    return left.join(right, key).where((F.col(lo) < F.col(top)) & (F.col(base) < F.col(hi)))


def point_segment_distance(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    dx, dy = x2 - x1, y2 - y1
    n = dx * dx + dy * dy
    t = F.when(n > 0, F.least(F.lit(1.0), F.greatest(F.lit(0.0), ((px - x1) * dx + (py - y1) * dy) / n))).otherwise(0.0)
    return F.hypot(px - (x1 + t * dx), py - (y1 + t * dy))
