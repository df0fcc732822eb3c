"""Operators on node models: joins with hits, facilities, paths and shapes, reports, and the layers built from them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from . import geometry, quantiles, selection, spatial
from .graph import cut
from .quantiles import percentile, percentiles


# --- joins

def density_map(model: DataFrame, hits: DataFrame, key: str, counts: list[str], lists: list[str], threshold: float = 10.0) -> DataFrame:
    """Every model node with its hits: counts 0 and lists empty where there are none, `is_nofly`, and `density_hit_count`, 0 on no-fly nodes."""
    out = model.join(hits.select(key, *counts, *lists), key, "left").fillna(0, counts).fillna("", lists)
    out = out.withColumn("is_nofly", F.coalesce(C.clean(F.col("slowness")) >= threshold, F.lit(False)))
    return out.withColumn("density_hit_count", F.when(F.col("is_nofly"), 0.0).otherwise(F.col("hit_count").cast("double")))


def numbered(df: DataFrame, columns: list[str], to: str) -> DataFrame:
    """The distinct values of `columns` numbered from 0 in their order, whatever their count: places inside range partitions plus the
    sizes of the partitions before, one number each on the driver."""
    s = df.select(*columns).distinct().repartitionByRange(*columns).sortWithinPartitions(*columns).withColumn("__p", F.spark_partition_id())
    s = cut(s)
    before, total = {}, 0
    for r in sorted(s.groupBy("__p").count().collect()):
        before[r["__p"]], total = total, total + r["count"]
    place = F.row_number().over(_window(["__p"], columns)) - 1
    base = F.create_map(*[F.lit(x).cast("long") for kv in before.items() for x in kv]) if before else F.create_map()
    return s.withColumn(to, (F.element_at(base, F.col("__p").cast("long")) + place).cast("long") if before else F.lit(None).cast("long")).drop("__p")


def _window(by: list[str], order: list):
    from pyspark.sql import Window

    return Window.partitionBy(*by).orderBy(*order)


def with_xy_id(df: DataFrame, columns: list[str] = ["ix", "iy"], to: str = "xy_id") -> DataFrame:
    """`df` with the number of its cell among all cells in order."""
    return df.join(numbered(df, columns, to), columns, "left")


def join_xy(left: DataFrame, right: DataFrame, digits: int = 8, x: str = "x", y: str = "y") -> DataFrame:
    """Left join on coordinates, equal if they agree to `digits` places (as whole numbers, never as doubles)."""
    whole = lambda c: F.round(F.col(c) * 10.0**digits).cast("long")
    r = right.withColumns({"__kx": whole(x), "__ky": whole(y)}).drop(x, y)
    return left.withColumns({"__kx": whole(x), "__ky": whole(y)}).join(r, ["__kx", "__ky"], "left").drop("__kx", "__ky")


def lookup(value: Column, table: dict, default=None) -> Column:
    """The table's entry for a value (a few at most: it is written into the plan), else the default."""
    if len(table) > 1000:
        raise ValueError("join a table of this size")
    found = F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), value) if table else F.lit(None)
    return F.coalesce(found, F.lit(default)) if default is not None else found


def near_path(nodes: DataFrame, path: DataFrame, buffer: float, key: str = "id") -> DataFrame:
    """Keys of nodes (key, x, y) within `buffer` of any point of the path (x, y)."""
    p = path.select(F.col("x").alias("rx"), F.col("y").alias("ry")).distinct()
    return spatial.radius_join(nodes.select(key, "x", "y"), p, buffer).select(key).distinct()


def clearances(segments: DataFrame, blocked: DataFrame, step: float, key: str = "seg") -> DataFrame:
    """(key, clearance): the least distance of the segment's samples (every `step`, and its end) to a blocked point, infinite if none is."""
    s = geometry.sampled(segments, step).select(key, F.col("sx").alias("x"), F.col("sy").alias("y"))
    places = s.select("x", "y").distinct().withColumn("id", F.struct("x", "y"))
    near = spatial.nearest(places, blocked.select(F.col("id").alias("site"), "x", "y"), step).select("id", "dist")
    got = s.withColumn("id", F.struct("x", "y")).join(near, "id", "left")
    return got.groupBy(key).agg(F.coalesce(F.min("dist"), F.lit(float("inf"))).alias("clearance"))


def in_buffer(points: DataFrame, shapes: DataFrame, buffer: float, key: str = "id", size: float | None = None) -> DataFrame:
    """Keys of points inside any ring (array<struct<x, y>>) of `shapes`, or within `buffer` of it.  Places and rings that are
    not equal to others meet on squares; all points of a place share its answer."""
    size = size or max(buffer * 4, 1.0)
    side = lambda c: F.floor(c / size).cast("long")
    xs, ys = F.transform("ring", lambda p: p["x"]), F.transform("ring", lambda p: p["y"])
    span = lambda v: F.explode(F.sequence(side(F.array_min(v) - buffer), side(F.array_max(v) + buffer)))
    s = shapes.where(F.size("ring") > 0).select("ring").distinct().withColumn("__x", span(xs)).withColumn("__y", span(ys)).select("ring", "__x", "__y")
    p = points.select("x", "y").distinct().withColumns({"__x": side(F.col("x")), "__y": side(F.col("y"))})
    far = F.array_min(F.transform(geometry.sides(F.col("ring")), lambda e: spatial.point_segment_distance(F.col("x"), F.col("y"), e["a"]["x"], e["a"]["y"], e["b"]["x"], e["b"]["y"])))
    hit = p.join(s, ["__x", "__y"]).where((far <= buffer) | geometry.in_ring(F.col("x"), F.col("y"), F.col("ring"))).select("x", "y").distinct()
    return points.join(hit, ["x", "y"], "left_semi").select(key).distinct()


def od_pairs(starts: DataFrame, goals: DataFrame, most_metres: float, ordered: bool = True, skip_same_prefix: bool = False, key: str = "id") -> DataFrame:
    """(origin, goal, dist): pairs of different facilities (key, prefix, x, y) within `most_metres`, met on squares of that size.

    `ordered`: both directions where both are asked for; else one of each two, the smaller key first.  Repeated facilities give one pair.
    """
    a = starts.select(F.col(key).alias("origin"), F.col("prefix").alias("__pa"), "x", "y")
    b = goals.select(F.col(key).alias("goal"), F.col("prefix").alias("__pb"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    p = spatial.radius_join(a, b, most_metres).where("origin <> goal")
    p = p.where(~F.col("__pa").eqNullSafe(F.col("__pb"))) if skip_same_prefix else p
    if not ordered:
        p = p.withColumns({"origin": F.least("origin", "goal"), "goal": F.greatest("origin", "goal")})
    return p.groupBy("origin", "goal").agg(F.min("dist").alias("dist"))


def access(facilities: DataFrame, cells: DataFrame, radius: float, flyable: Column, least: int = 1, key: str = "site") -> DataFrame:
    """Facilities with `nearby`, `nearby_flyable`, `nearest_flyable`, `accessible` and `reason`: cells (x, y) within `radius`, and the nearest
    flyable one at any distance."""
    f = facilities.select(key, "x", "y")
    c = cells.select(F.col("x").alias("rx"), F.col("y").alias("ry"), F.coalesce(flyable, F.lit(False)).alias("__fly"))
    near = spatial.radius_join(f, c, radius).groupBy(key).agg(F.count("*").alias("nearby"), F.count_if("__fly").alias("nearby_flyable"))
    at = c.where("__fly").select(F.monotonically_increasing_id().alias("cell"), F.col("rx").alias("x"), F.col("ry").alias("y"))
    best = spatial.nearest(f, at, radius, key, "cell").select(key, F.col("dist").alias("nearest_flyable"))
    out = facilities.join(near, key, "left").fillna(0, ["nearby", "nearby_flyable"]).join(best, key, "left")
    return out.withColumn("accessible", F.col("nearby_flyable") >= least).withColumn("reason", F.when(F.col("accessible"), "").otherwise("no_fly_covered"))


# --- filters

def excluded(df: DataFrame, prefixes: list[str] = (), labels: list[str] = (), flag: str | None = None, prefix: str = "label_prefix", label: str = "label") -> DataFrame:
    """`df` without rows of the prefixes, of the labels, or whose flag is true; missing values pass."""
    ok = F.lit(True)
    if prefixes:
        ok = ok & ~F.coalesce(F.upper(prefix).isin([p.upper() for p in prefixes]), F.lit(False))
    if labels:
        ok = ok & ~F.coalesce(F.col(label).isin(list(labels)), F.lit(False))
    return df.where(ok if flag is None else ok & ~F.coalesce(F.col(flag), F.lit(False)))


def relabelled(df: DataFrame, blocked: Column, prefix: str = "label_prefix", mark: str = "NOFLY") -> DataFrame:
    """`df` with the prefix of blocked rows replaced, the old one kept as `<prefix>_before`."""
    return df.withColumn(f"{prefix}_before", F.col(prefix)).withColumn(prefix, F.when(F.coalesce(blocked, F.lit(True)), mark).otherwise(F.col(prefix)))


def validated(path: DataFrame, model: DataFrame, blocked: Column, key: str = "id") -> DataFrame:
    """`path` itself; raises if any of its nodes is blocked or not in the model."""
    state = model.select(key, F.coalesce(blocked, F.lit(True)).alias("__no"))
    bad = path.select(key).join(state, key, "left").where("__no OR __no IS NULL").select(key).distinct()
    some = [r[0] for r in bad.orderBy(key).limit(10).collect()]
    if some:
        raise ValueError(f"path over blocked or unknown nodes, the first of them {some}")
    return path


def isolated(nodes: DataFrame, pairs: DataFrame, active: Column, special: Column, key: str = "id") -> DataFrame:
    """`nodes` with `active`: false as well for special nodes none of whose neighbours (pairs a, b) is active."""
    n = nodes.withColumn("__on", F.coalesce(active, F.lit(False)))
    both = pairs.select("a", "b").union(pairs.select("b", "a")).toDF("a", "b")
    live = both.join(n.where("__on").select(F.col(key).alias("b")), "b", "left_semi").select(F.col("a").alias(key)).distinct().withColumn("__near", F.lit(True))
    return n.join(live, key, "left").withColumn("active", F.col("__on") & (F.col("__near").isNotNull() | ~F.coalesce(special, F.lit(False)))).drop("__on", "__near")


# --- aggregations

def area_cells(df: DataFrame, size: float, origin: tuple[float, float] | None = None) -> DataFrame:
    """`df` with area_ix, area_iy and area_id: squares of `size` (1 at least) from the least x and y, or from `origin`."""
    g = max(float(size), 1.0)
    low = df.agg(F.min("x").alias("__x0"), F.min("y").alias("__y0"))
    d = df.crossJoin(F.broadcast(low)) if origin is None else df.withColumns({"__x0": F.lit(origin[0]), "__y0": F.lit(origin[1])})  # one row
    at = lambda c, c0: F.floor((F.col(c) - F.col(c0)) / g).cast("long")
    d = d.withColumns({"area_ix": at("x", "__x0"), "area_iy": at("y", "__y0")}).drop("__x0", "__y0")
    return d.withColumn("area_id", F.concat_ws("_", "area_ix", "area_iy"))


def availability(layers: DataFrame, rows: DataFrame, layer: str = "layer", kind: str = "geom_type", source: str = "source") -> DataFrame:
    """One row per layer, also where it has no rows: n_features, n_points, n_lines, n_polygons, sources, status."""
    like = lambda word: F.count_if(F.lower(kind).contains(word))
    got = rows.groupBy(layer).agg(F.count("*").alias("n_features"), like("point").alias("n_points"), like("line").alias("n_lines"), like("polygon").alias("n_polygons"),
                                  F.array_join(F.array_sort(F.collect_set(source)), ";").alias("sources"))
    out = layers.select(layer).distinct().join(got, layer, "left").fillna(0, ["n_features", "n_points", "n_lines", "n_polygons"]).fillna("", ["sources"])
    return out.withColumn("status", F.when(F.col("n_features") > 0, "available").otherwise("empty"))


def height_report(buildings: DataFrame, by: str, height: str = "height", area: str = "area") -> DataFrame:
    """Per source: counts, rows with and without a positive height, and of those with one least, mean, median, greatest and volume."""
    h = F.when(C.clean(F.col(height)) > 0, C.clean(F.col(height)))
    a = C.clean(F.col(area))
    return buildings.groupBy(by).agg(F.count("*").alias("n"), F.count(h).alias("n_valid"), (F.count("*") - F.count(h)).alias("n_missing"), F.min(h).alias("least"), F.avg(h).alias("mean"),
                                     F.percentile(h, 0.5).alias("median"), F.max(h).alias("greatest"), F.coalesce(F.sum(a), F.lit(0.0)).alias("area"), F.coalesce(F.sum(h * a), F.lit(0.0)).alias("volume"))


def cost_summary(df: DataFrame, columns: list[str], hard: Column) -> DataFrame:
    """One wide row: rows, hard no-fly rows, and least, mean and greatest of each column over the finite values of the others."""
    open_ = ~F.coalesce(hard, F.lit(True))
    stat = lambda f, c: f(F.when(open_, C.clean(F.col(c))))
    return df.agg(F.count("*").alias("n"), F.count_if(~open_).alias("n_hard"), *[stat(f, c).alias(f"{c}_{n}") for c in columns for n, f in (("min", F.min), ("mean", F.avg), ("max", F.max))])


def path_statistics(nodes: DataFrame, kind: str = "kind") -> DataFrame:
    """Per kind of facility: how many, how many accessible and blocked, percent blocked, distances to flyable cells, reasons joined."""
    blocked = F.count_if(~F.col("accessible"))
    return nodes.groupBy(kind).agg(F.count("*").alias("n"), F.count_if("accessible").alias("n_accessible"), blocked.alias("n_blocked"), (100.0 * blocked / F.count("*")).alias("blocked_percent"),
                                   F.min("nearest_flyable").alias("nearest_min"), F.avg("nearest_flyable").alias("nearest_mean"), F.max("nearest_flyable").alias("nearest_max"),
                                   F.array_join(F.array_sort(F.collect_set(F.nullif("reason", F.lit("")))), ";").alias("notes"))


def cell_buildings(rows: DataFrame, cell: str = "xy_id", building: str = "building", height: str = "height", volume: str = "volume") -> DataFrame:
    """Per cell the greatest height, the summed volume and the number of buildings that meet it."""
    return rows.groupBy(cell).agg(F.max(height).alias("height_max"), F.sum(volume).alias("volume_sum"), F.countDistinct(building).alias("n_buildings"))


def burn_counts(voxels: DataFrame, flags: dict[str, Column], label: Column) -> DataFrame:
    """Rows (counter, n): all voxels, those of each flag, those of any, those of none, and those of each label."""
    any_ = F.lit(False)
    for f in flags.values():
        any_ = any_ | F.coalesce(f, F.lit(False))
    one = voxels.agg(F.count("*").alias("total"), *[F.count_if(F.coalesce(f, F.lit(False))).alias(f"burn_{n}") for n, f in flags.items()], F.count_if(any_).alias("burned"), F.count_if(~any_).alias("flyable"))
    wide = one.unpivot([], one.columns, "counter", "n")
    return wide.unionByName(voxels.groupBy(F.concat(F.lit("label_"), F.coalesce(label, F.lit("none"))).alias("counter")).agg(F.count("*").alias("n")))


def neighbour_spacing(points: DataFrame, reach: float, key: str = "id") -> DataFrame:
    """One row: the median distance of a point to its nearest other point (of those that have one within `reach`)."""
    b = points.select(F.col(key).alias("__b"), F.col("x").alias("rx"), F.col("y").alias("ry"))
    near = spatial.radius_join(points.select(key, "x", "y"), b, reach).where(F.col(key) != F.col("__b")).groupBy(key).agg(F.min("dist").alias("d"))
    near = cut(near)
    return percentile(near, F.col("d"), 0.5, "spacing").crossJoin(F.broadcast(near.agg(F.count("*").alias("n"))))  # one row


def colour_bounds(df: DataFrame, column: str, classes: int = 10, digits: int = 3) -> DataFrame:
    """One row: the ascending distinct rounded quantiles that cut a column into at most `classes` classes."""
    return percentiles(df, C.clean(F.col(column)), [i / classes for i in range(classes + 1)]).select(F.array_sort(F.array_distinct(F.transform(F.coalesce("q", F.array().cast("array<double>")), lambda v: F.round(v, digits)))).alias("bounds"))


def path_metrics(path: DataFrame, route: str, order: list[str], cost: Column) -> DataFrame:
    """(route, nodes, distance, cost): summed lengths of the steps (x, y, z) and of step length times the mean of both ends' cost rate."""
    w = _window([route], order)
    d = F.sqrt(sum((F.pow(F.col(c) - F.lag(c).over(w), 2) for c in ("x", "y", "z")), F.lit(0.0)))
    p = path.withColumn("__c", cost.cast("double")).withColumn("__d", F.coalesce(d, F.lit(0.0))).withColumn("__m", F.coalesce((F.col("__c") + F.lag("__c").over(w)) / 2, F.lit(0.0)))
    return p.groupBy(route).agg(F.count("*").alias("nodes"), F.sum("__d").alias("distance"), F.sum(F.col("__d") * F.col("__m")).alias("cost"))


# --- ordered rows

def cumulative(path: DataFrame, route: str, order: list[str], lon: str = "lon", lat: str = "lat", slowness: str = "slowness") -> DataFrame:
    """`path` with distance_m and time_s so far, in metres on a plane about each route's mean place."""
    every = path.groupBy(route).agg(F.avg(lon).alias("__lon"), F.avg(lat).alias("__lat"))
    p = path.join(every, route)
    x, y = C.local_metres(F.col(lon), F.col(lat), F.col("__lon"), F.col("__lat"))
    w = _window([route], order)
    p = p.withColumns({"__x": x, "__y": y})
    p = p.withColumn("__d", F.coalesce(F.hypot(F.col("__x") - F.lag("__x").over(w), F.col("__y") - F.lag("__y").over(w)), F.lit(0.0)))
    p = p.withColumn("__t", F.col("__d") * F.coalesce((F.col(slowness) + F.lag(slowness).over(w)) / 2, F.lit(0.0)))
    upto = w.rowsBetween(-(1 << 63), 0)
    return p.withColumns({"distance_m": F.sum("__d").over(upto), "time_s": F.sum("__t").over(upto)}).drop("__lon", "__lat", "__x", "__y", "__d", "__t")


def route_points(edges: DataFrame, route: str, seq: str) -> DataFrame:
    """(route, place, x, y): of edges (x1, y1, x2, y2) in order, the first one's start and then every end."""
    first = edges.groupBy(route).agg(F.min_by(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")), seq).alias("p")).select(route, F.lit(0).cast("long").alias("place"), "p.x", "p.y")
    ends = edges.withColumn("place", F.row_number().over(_window([route], [seq])).cast("long"))
    return first.unionByName(ends.select(route, "place", F.col("x2").alias("x"), F.col("y2").alias("y")))


def ranked_pairs(paths: DataFrame, cost: str = "cost", key: str = "path") -> DataFrame:
    """`paths` (a, b, cost) with `pair`, the same for both directions, and `rank` in it by cost, then key."""
    pair = F.concat_ws("_to_", F.least("a", "b").cast("string"), F.greatest("a", "b").cast("string"))
    p = paths.withColumn("pair", pair)
    return p.withColumn("rank", F.row_number().over(_window(["pair"], [cost, key])))


def means_along(path: DataFrame, model: DataFrame, columns: list[str], route: str, node: str) -> DataFrame:
    """Per route the mean of each model column over its nodes; missing values don't count."""
    return path.select(route, node).join(model.select(node, *columns), node, "left").groupBy(route).agg(*[F.avg(C.clean(F.col(c))).alias(c) for c in columns])


def closeness(points: DataFrame, reference: DataFrame, reach: float, route: str = "route") -> DataFrame:
    """(route, mean_m, max_m): how far the route's points (x, y) are from the nearest reference point."""
    p = points.select(route, "x", "y").withColumn("id", F.struct("x", "y"))
    near = spatial.nearest(p.select("id", "x", "y").distinct(), reference.select(F.struct("x", "y").alias("site"), "x", "y").distinct(), reach).select("id", "dist")
    return p.join(near, "id").groupBy(route).agg(F.avg("dist").alias("mean_m"), F.max("dist").alias("max_m"))


# --- choosing

def union_all(*parts: DataFrame) -> DataFrame:
    """All rows by column name; a column that a part lacks is null there."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def spread_representatives(df: DataFrame, cluster: str, apart: float, key: str = "id") -> DataFrame:
    """One row per cluster at most, `apart` from those taken before: clusters by falling summed hits, in each the row with the most hits, then
    nearest the weighted centre, then the smallest key.  Rows stream through one task in that order, which holds what it has taken."""
    w = F.greatest(F.col("hits"), F.lit(1)).cast("double")
    centre = df.groupBy(cluster).agg((F.sum(F.col("x") * w) / F.sum(w)).alias("__cx"), (F.sum(F.col("y") * w) / F.sum(w)).alias("__cy"), F.sum("hits").alias("__sum"))
    far = F.round(F.hypot(F.col("x") - F.col("__cx"), F.col("y") - F.col("__cy")), 6)
    d = df.join(centre, cluster).withColumn("__far", far)
    ordered = d.coalesce(1).sortWithinPartitions(F.col("__sum").desc(), cluster, F.col("hits").desc(), "__far", key).drop("__cx", "__cy", "__sum", "__far")

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done, now, xs, ys = False, None, [], []
        for pdf in batches:
            keep = []
            for i, (c, x, y) in enumerate(zip(pdf[cluster], pdf["x"], pdf["y"])):
                if now is None or c != now:
                    now, done = c, False
                if not done and (not xs or np.hypot(np.array(xs) - x, np.array(ys) - y).min() >= apart):
                    done = True
                    xs.append(x), ys.append(y), keep.append(i)
            yield pdf.iloc[keep]

    return ordered.mapInPandas(take, df.schema)


def candidate_pool(nodes: DataFrame, least_hits: int = 2, least_degree: int = 2, prefixes: tuple = ("DB", "DK", "RA"), percentile: float = 0.9, most_noise: int = 20) -> DataFrame:
    """Nodes (id, hits, degree, pairs, cluster, label_prefix) fit to be candidates, with `score`: those of clusters, and of the rest
    (cluster below 0) the most hit from a percentile up."""
    fit = excluded(nodes.where((F.col("hits") >= least_hits) & (F.col("degree") >= least_degree)), list(prefixes))
    noise = fit.where("cluster < 0")
    bar = quantiles.percentile(noise, F.col("hits"), percentile, "__bar")
    top = noise.crossJoin(F.broadcast(bar)).where("hits >= __bar").drop("__bar").orderBy(F.col("hits").desc(), F.col("degree").desc(), F.col("pairs").desc(), "id").limit(most_noise)  # one row
    pool = fit.where("cluster >= 0").unionByName(top).withColumn("in_cluster", F.col("cluster") >= 0)
    return selection.candidate_score(pool, {"hits": 0.60, "degree": 0.20, "pairs": 0.15}, "in_cluster", 0.05).drop("in_cluster")


def balanced(pool: DataFrame, areas: DataFrame, apart: float = 300.0, relaxed: float | None = None, most_pool: int = 1_000_000) -> DataFrame:
    """Candidates (id, area, x, y, score, hits) by turns of the areas (area, quota, density), densest first: in a turn each area below its quota
    gives its best candidate that is `apart` from all chosen before, or failing that `relaxed`; until a turn chooses none.

    Adds kind (primary in the first turn, extra later), area_rank and turn_rank.  Each choice depends on all before it, so one task makes
    them, over a pool whose size is checked.
    """
    relaxed = apart * 0.6 if relaxed is None else relaxed
    if pool.limit(most_pool + 1).count() > most_pool:
        raise ValueError(f"a pool of more than {most_pool} candidates")
    joined = pool.join(areas.select("area", "quota", "density"), "area").withColumn("__one", F.lit(1))

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["density", "area", "score", "hits", "id"], ascending=[False, True, False, False, True], kind="stable").reset_index(drop=True)
        groups = [(g.index.to_numpy(), int(g["quota"].iloc[0])) for _, g in pdf.groupby("area", sort=False)]
        x, y = pdf["x"].to_numpy(float), pdf["y"].to_numpy(float)
        gap = np.full(len(pdf), np.inf)  # to the nearest chosen one
        free = np.ones(len(pdf), bool)
        taken, rank, kind, n = [], [], [], [0] * len(groups)
        turn, moved = 0, True
        while moved:
            moved = False
            for k, (rows, quota) in enumerate(groups):
                if n[k] >= quota:
                    continue
                for least in (apart, relaxed):
                    good = rows[free[rows] & (gap[rows] >= least)]
                    if len(good):
                        i = int(good[0])
                        free[i] = False
                        gap = np.minimum(gap, np.hypot(x - x[i], y - y[i]))
                        n[k] += 1
                        taken.append(i), rank.append(n[k]), kind.append("extra" if turn else "primary")
                        moved = True
                        break
            turn += 1
        out = pdf.iloc[taken].drop(columns="__one")
        return out.assign(kind=kind, area_rank=rank, turn_rank=range(1, len(taken) + 1))

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in joined.schema.fields if f.name != "__one")
    return joined.groupBy("__one").applyInPandas(choose, f"{fields}, kind string, area_rank int, turn_rank int")


# --- layers

def circle_risk(nodes: DataFrame, circles: DataFrame, decay: float, key: str = "id") -> DataFrame:
    """(key, risk, hard) over circles (x, y, radius): 1 and hard inside, beyond exp(-((d - radius) / decay)^2), the greatest of all.

    Circles farther than `reach` add less than 1e-16 and count as nothing.
    """
    wide = circles.agg(F.max("radius")).first()[0]
    if wide is None:
        return nodes.select(key, F.lit(0.0).alias("risk"), F.lit(False).alias("hard"))
    reach = float(wide) + 6.1 * decay
    c = circles.select(F.col("x").alias("rx"), F.col("y").alias("ry"), "radius")
    near = spatial.radius_join(nodes.select(key, "x", "y"), c, reach)
    got = near.groupBy(key).agg(F.max(F.when(F.col("dist") <= F.col("radius"), 1.0).otherwise(F.exp(-F.pow((F.col("dist") - F.col("radius")) / decay, 2)))).alias("risk"), F.bool_or(F.col("dist") <= F.col("radius")).alias("hard"))
    return nodes.select(key).join(got, key, "left").fillna({"risk": 0.0, "hard": False})


def mixed_model(nodes: DataFrame, slowness: str, high_rise: Column, threshold: float = 10.0, open_: float = 1.0, shut: float = 10.0) -> DataFrame:
    """`nodes` with `mixed_class` (existing_nofly, highrise or flyable; the first that holds) and binary `mixed_slowness`."""
    old = F.coalesce(C.clean(F.col(slowness)) >= threshold, F.lit(True))
    kind = F.when(old, "existing_nofly").when(F.coalesce(high_rise, F.lit(False)), "highrise").otherwise("flyable")
    return nodes.withColumn("mixed_class", kind).withColumn("mixed_slowness", F.when(F.col("mixed_class") == "flyable", open_).otherwise(shut))


def controlled(nodes: DataFrame, ring: list[tuple[float, float]], slowness: str, threshold: float = 10.0, shut: float = 10.0) -> DataFrame:
    """`nodes` with all inside the ring shut: `in_control`, `newly_forced` (flyable before) and the new slowness."""
    inside = F.coalesce(spatial.in_polygon(F.col("x"), F.col("y"), ring), F.lit(False))
    d = nodes.withColumn("in_control", inside).withColumn("newly_forced", F.col("in_control") & F.coalesce(C.clean(F.col(slowness)) < threshold, F.lit(False)))
    return d.withColumn(slowness, F.when(F.col("in_control"), shut).otherwise(F.col(slowness)))


def objective_table(nodes: DataFrame, prefixes: list[str], hits: DataFrame | None = None, key: str = "id") -> DataFrame:
    """Nodes of the objective prefixes (case doesn't matter), one per label (the smallest key), with their hits (0 where none)."""
    n = nodes.where(F.upper("label_prefix").isin([p.upper() for p in prefixes]))
    n = n.withColumn("__rn", F.row_number().over(_window(["label"], [key]))).where("__rn = 1").drop("__rn")
    return n if hits is None else n.join(hits.select(key, "hits"), key, "left").fillna(0, ["hits"])


def master_nodes(nodes: DataFrame, flz: bool = True, key: str = "id") -> DataFrame:
    """(node_id, name, role, x, y, hits): facilities by prefix, and flyable candidates as TN_major or TN_minor.

    Rows in a restricted area go; of rows that share a number (`key`) the first (`row`) that has a role stays.  Names are the candidate's or objective's, else the
    label (not for candidates), else the role and number.  Sorted order is role, name, number.
    """
    p = F.upper(F.coalesce("label_prefix", F.lit("")))
    said = lambda c: F.nullif(F.trim(F.coalesce(c, F.lit(""))), F.lit(""))
    fly = F.coalesce(F.col("flyable"), F.lit(False))
    tn = F.when(F.lower(F.trim(F.coalesce("candidate_type", F.lit("TN")))) == "major", "TN_major").otherwise("TN_minor")
    facility = F.when(p == "DB", "DB").when(p == "DK", "DK")
    role = (facility.when(p == "FLZ", "FLZ") if flz else facility).when(F.coalesce("is_candidate", F.lit(False)) & fly, tn)
    d = nodes.withColumn("role", role).where(F.col("role").isNotNull() & ~F.coalesce("in_ra", F.lit(False)))
    d = d.withColumn("__rn", F.row_number().over(_window([key], ["row"]))).where("__rn = 1")
    number = F.col(key).cast("string")
    name = F.when(F.col("role").startswith("TN"), F.coalesce(said("candidate_id"), F.concat(F.lit("TN_"), number))).otherwise(F.coalesce(said("objective_label"), said("label"), F.concat_ws("_", "role", number)))
    return d.select(F.col(key).alias("node_id"), name.alias("name"), "role", "x", "y", F.coalesce(F.col("hits").cast("double"), F.lit(0.0)).alias("hits"))


def route_summary(paths: DataFrame, nodes: DataFrame, edges: DataFrame, route: str, seq: str, node: str = "node_id") -> DataFrame:
    """Per route: nodes and names joined in order, length, least clearance of its edges (u < v, length, clearance), and how many are known."""
    p = paths.select(route, seq, node).join(nodes.select(node, "name"), node, "left")
    listed = F.array_sort(F.collect_list(F.struct(seq, F.col(node).cast("string").alias("n"), F.coalesce("name", F.lit("")).alias("name"))))
    lists = p.groupBy(route).agg(F.transform(listed, lambda s: s["n"]).alias("ns"), F.transform(listed, lambda s: s["name"]).alias("names"))
    step = paths.withColumn("__to", F.lead(node).over(_window([route], [seq]))).where("__to IS NOT NULL").select(route, F.least(node, "__to").alias("u"), F.greatest(node, "__to").alias("v"))
    sums = step.join(edges.select("u", "v", "length", "clearance"), ["u", "v"], "left").groupBy(route).agg(F.sum("length").alias("length_m"), F.min("clearance").alias("least_clearance"), F.count("length").alias("known_edges"))
    return lists.select(route, F.array_join("ns", ";").alias("node_ids"), F.array_join("names", ";").alias("node_names")).join(sums, route, "left").fillna(0, ["known_edges"])


# --- reports

def layer_extents(voxels: DataFrame, layers: dict[str, Column], z: str = "z", ground: str = "ground") -> DataFrame:
    """Per layer flag: rows, distinct columns (xy_id), and least, median and greatest height above sea and above ground."""
    rows = [voxels.where(F.coalesce(f, F.lit(False))).agg(F.lit(n).alias("layer"), F.count("*").alias("n"), F.countDistinct("xy_id").alias("n_columns"),
                                                          *[g(v).alias(f"{k}_{m}") for k, v in (("msl", F.col(z)), ("agl", F.col(z) - F.col(ground))) for m, g in (("min", F.min), ("p50", lambda c: F.percentile(c, 0.5)), ("max", F.max))])
            for n, f in layers.items()]
    return union_all(*rows)


def area_stats(ring: list[tuple[float, float]], spark) -> DataFrame:
    """One row: the area of a ring on a plane in square metres, square kilometres and hectares."""
    d = spark.range(1).select(F.array(*[F.struct(F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y")) for x, y in ring]).alias("ring"))
    a = geometry.ring_area(F.col("ring"))
    return d.select(a.alias("m2"), (a / 1e6).alias("km2"), (a / 1e4).alias("ha"))


def display_classes(df: DataFrame, flags: dict[str, Column]) -> DataFrame:
    """Rows (class, before, after, removed): cells of each flag, cells that show it when the first flag that holds wins, and the rest."""
    shown, out = None, []
    for n, f in flags.items():
        f = F.coalesce(f, F.lit(False))
        shown = F.when(f, n) if shown is None else shown.when(f, n)
        out.append((n, f))
    one = df.withColumn("__shown", shown).agg(*[x for n, f in out for x in (F.count_if(f).alias(f"b_{n}"), F.count_if(F.col("__shown") == n).alias(f"a_{n}"))])
    rows = F.array(*[F.struct(F.lit(n).alias("class"), F.col(f"b_{n}").alias("before"), F.col(f"a_{n}").alias("after"), (F.col(f"b_{n}") - F.col(f"a_{n}")).alias("removed")) for n, _ in out])
    return one.select(F.inline(rows))


def route_prefixes(asked: list[str] = ("DB", "DK"), excluded_: list[str] = ("RA",), flz: bool = False) -> tuple[list[str], list[str]]:
    """(prefixes that may end a route, prefixes that may not): FLZ is an endpoint only if allowed, and otherwise excluded."""
    shut = list(excluded_)
    if "FLZ" in asked and not flz and "FLZ" not in shut:
        shut.append("FLZ")
    return [p for p in dict.fromkeys(asked) if p not in shut and (flz or p != "FLZ")], shut
