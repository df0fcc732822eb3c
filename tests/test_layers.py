"""Geometry, voxel, network and solver operators on hand-made cases and against plain versions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions import columns as C
from skyloom.operators import geometry, network, routes, search, voxel


def _vincenty(lon1, lat1, lon2, lat2):
    a, f = 6378137.0, 1 / 298.257223563
    b, gap = (1 - f) * a, math.radians(lon2 - lon1)
    u, v = (math.atan((1 - f) * math.tan(math.radians(x))) for x in (lat1, lat2))
    lam = gap
    for _ in range(200):
        s = math.hypot(math.cos(v) * math.sin(lam), math.cos(u) * math.sin(v) - math.sin(u) * math.cos(v) * math.cos(lam))
        if s == 0:
            return 0.0
        c = math.sin(u) * math.sin(v) + math.cos(u) * math.cos(v) * math.cos(lam)
        arc, z = math.atan2(s, c), math.cos(u) * math.cos(v) * math.sin(lam) / s
        w = 1 - z * z
        m = c - 2 * math.sin(u) * math.sin(v) / w if w else 0.0
        k = f / 16 * w * (4 + f * (4 - 3 * w))
        lam = gap + (1 - k) * f * z * (arc + k * s * (m + k * c * (2 * m * m - 1)))
    e = w * (a * a - b * b) / (b * b)
    big, small = 1 + e / 16384 * (4096 + e * (-768 + e * (320 - 175 * e))), e / 1024 * (256 + e * (-128 + e * (74 - 47 * e)))
    return b * big * (arc - small * s * (m + small / 4 * (c * (2 * m * m - 1) - small / 6 * m * (4 * s * s - 3) * (4 * m * m - 3))))


def test_geodesic(spark):
    rows = [(105.8, 21.0, 105.85, 21.05), (0.0, 0.0, 0.0, 0.0), (0.0, 0.0, 1.0, 0.0), (0.0, 0.0, 0.0, 1.0), (179.5, 10.0, -179.5, 10.0), (10.0, 50.0, 100.0, -30.0)]
    d = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = [r.m for r in d.select(geometry.geodesic(F.col("a"), F.col("b"), F.col("c"), F.col("d")).alias("m")).collect()]
    want = [_vincenty(*r) if abs(r[2] - r[0]) < 180 else _vincenty(r[0], r[1], r[2] + 360, r[3]) for r in rows]
    assert got == pytest.approx(want, abs=1e-4)
    assert got[2] == pytest.approx(111319.4908, abs=1e-3) and got[3] == pytest.approx(110574.3886, abs=1e-3)  # a degree of the equator, and the first of a meridian
    far = spark.range(1).select(geometry.geodesic(F.lit(0.0), F.lit(0.0), F.lit(179.9), F.lit(0.2)).alias("m"), geometry.geodesic(F.lit(None).cast("double"), F.lit(0.0), F.lit(1.0), F.lit(1.0)).alias("n")).first()
    assert far.m is None and far.n is None


def test_circle_is_closed_and_at_its_radius(spark):
    d = geometry.circles(spark.createDataFrame([(179.99, 10.0, 40.0)], "lon double, lat double, km double"), "lon", "lat", "km", 8)
    d = d.withColumn("m", geometry.haversine(F.col("lon"), F.col("lat"), F.col("vertex_lon"), F.col("vertex_lat")))
    rows = d.orderBy("vertex").collect()
    assert len(rows) == 9 and rows[0].vertex_lon == rows[8].vertex_lon and all(-180 <= r.vertex_lon <= 180 for r in rows)
    assert [r.m for r in rows] == pytest.approx([40_000.0] * 9, rel=1e-9)


def test_rings(spark):
    square, line = [(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(0.0, 0.0), (4.0, 0.0)]
    d = spark.createDataFrame([(1, square, 5, 1), (2, [(2.0, 2.0), (8.0, 2.0), (2.0, 8.0)], 7, 2), (3, line, 9, 3), (4, [], 9, 4)], "id int, ring array<struct<x:double,y:double>>, value int, draw_order int")
    assert [r.a for r in d.select("id", geometry.ring_area(F.col("ring")).alias("a")).orderBy("id").collect()] == [16.0, 18.0, 0.0, 0.0]
    cells = {(r.ix, r.iy): r.value for r in geometry.rasterised(d, 2.0).collect()}
    assert cells[0, 0] == 5 and cells[1, 1] == 7 and cells[2, 1] == 7 and (3, 3) not in cells and 9 not in cells.values()


def test_clipped_lines(spark):
    rows = [(-1.0, 0.5, 2.0, 0.5), (0.2, 0.2, 0.4, 0.4), (2.0, 0.0, 2.0, 1.0), (-1.0, 1.0, 1.0, 3.0), (0.0, -1.0, 0.0, 2.0)]
    d = spark.createDataFrame(rows, "a double, b double, c double, d double")
    got = [r.p for r in d.select(geometry.clipped(*map(F.col, "abcd"), geometry.box(0.0, 0.0, 1.0, 1.0)).alias("p")).collect()]
    assert got[0].lo == pytest.approx(1 / 3) and got[0].hi == pytest.approx(2 / 3) and tuple(got[1]) == (0.0, 1.0)
    assert got[2] is None and got[3] is None and got[4].lo == pytest.approx(1 / 3) and got[4].hi == pytest.approx(2 / 3)


def test_samples_and_cells_of_a_line(spark):
    d = spark.createDataFrame([(1, 0.0, 0.0, 25.0, 0.0), (2, 3.0, 3.0, 3.0, 3.0), (3, None, 0.0, 1.0, 1.0)], "id int, x1 double, y1 double, x2 double, y2 double")
    assert [(r.id, r.sx) for r in geometry.sampled(d, 10.0).orderBy("id", "sample").collect()] == [(1, 0.0), (1, 10.0), (1, 20.0), (1, 25.0), (2, 3.0)]
    e = spark.createDataFrame([(1, 0, 0, 4, 2), (2, 1, 1, 1, 1)], "id int, x1 long, y1 long, x2 long, y2 long")
    cells = [(r.id, r.cx, r.cy) for r in geometry.line_cells(e).orderBy("id", "place").collect()]
    assert cells == [(1, 0, 0), (1, 1, 1), (1, 2, 1), (1, 3, 2), (1, 4, 2), (2, 1, 1)]


def test_coverage_without_stations(spark):
    cells = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 0.0)], "id int, x double, y double")
    s = spark.createDataFrame([(0.0, 0.0, 1.0, 0.0)], "x double, y double, weight double, reach double")
    assert {(r.id, r.support) for r in geometry.coverage(cells, s).collect()} == {(1, 0.0), (2, 0.0)}


def test_height_references(spark):
    d = spark.createDataFrame([(12.0, 500.0), (520.0, 500.0), (None, 5.0), (-3.0, None), (120.0, 130.0)], "h double, t double")
    got = lambda mode: [tuple(r.v) for r in d.select(voxel.height_reference(F.col("h"), F.col("t"), mode).alias("v")).collect()]
    assert got("AUTO") == [(12.0, False), (20.0, True), (0.0, False), (0.0, False), (120.0, False)]
    assert [x for x, _ in got("MSL_TOP")] == [0.0, 20.0, 0.0, 0.0, 0.0] and [x for x, _ in got("AGL")] == [12.0, 520.0, 0.0, 0.0, 120.0]


def test_powerline_starts_above_burned_terrain(spark):
    v = spark.createDataFrame([(1, 0, 0.0, 10.0), (1, 1, 10.0, 20.0), (1, 2, 20.0, 30.0)], "xy_id int, iz int, z_bot double, z_top double")
    f = spark.createDataFrame([(1, 7, "line", 0.0, 17.0), (1, 8, "pole", 0.0, 14.0), (1, 9, "mast", 0.0, 99.0)], "xy_id int, feature int, kind string, terrain double, height double")
    t = spark.createDataFrame([(1, 10.0)], "xy_id int, terrain_top double")
    assert {tuple(r) for r in voxel.powerline_burn(v, f, t, 3.0, 1.0).collect()} == {(1, 1, 1, 1, 2)}  # the line's top touches 20


def test_mosaic_and_fill(spark):
    t = spark.createDataFrame([(0, 0, 1, None), (0, 0, 2, 5.0), (0, 0, 3, 6.0), (1, 0, 1, float("nan"))], "ix int, iy int, tile int, v double")
    assert {tuple(r) for r in voxel.mosaic(t, "tile").collect()} == {(0, 0, 5.0), (1, 0, None)}
    d = spark.createDataFrame([(1, None, None)], "id int, a double, b double")
    r = voxel.filled(d, ["a", "b"], "z", 3.0).first()
    assert (r.z, r.z_source) == (3.0, "constant")


def test_combined_layer_without_density(spark):
    a = spark.createDataFrame([(0, 0, 0.0)], "ix int, iy int, v double")
    b = spark.createDataFrame([(1, 0, 4.0)], "ix int, iy int, v double")
    assert {tuple(r) for r in voxel.combined(a, b, "sum").collect()} == {(0, 0, 0.0), (1, 0, 1.0)}
    assert voxel.combined(a.limit(0), b.limit(0)).count() == 0


def test_few_outer_nodes_are_topped_up(spark):
    n = spark.createDataFrame([(1, 50.0, 50.0, "TN"), (2, 60.0, 60.0, "TN"), (3, 40.0, 50.0, "DB"), (4, 99.0, 50.0, "DB"), (5, None, 1.0, "TN")], "id int, x double, y double, role string")
    got = {r.id: r.is_outer for r in network.outer_zone(n, geometry.box(0.0, 0.0, 100.0, 100.0), ["TN"], 5.0, 2).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False}


def test_weather_column_wins(spark):
    d = spark.createDataFrame([(0.4, 99.0), (None, 99.0)], "weather_risk double, wind_speed_mps double")
    assert [r.k for r in C.weather_risk(d, "k").collect()] == [0.4, 0.0]
    assert [r.k for r in C.weather_risk(d.drop("weather_risk"), "k").collect()] == [1.0, 1.0]
    assert [r.k for r in C.weather_risk(d.select(F.lit(1).alias("o")), "k").collect()] == [0.0, 0.0]


def test_route_without_clusters(spark):
    d = spark.createDataFrame([("a", 1, None), ("a", 2, -1), ("b", 1, 4), ("b", 2, 3), ("b", 3, 4)], "r string, s int, c int")
    got = {x.r: tuple(x)[1:] for x in routes.cluster_sequence(d, "r", "s", "c").collect()}
    assert got == {"a": (2, 0, "", ""), "b": (3, 2, "3;4", "3:0.333;4:0.667")}


def _grid_graph(n, blocked=()):
    at = {i * n + j: (float(j), float(i)) for i in range(n) for j in range(n)}
    near = {u: [(v, 1.0) for v, (vx, vy) in at.items() if abs(vx - x) + abs(vy - y) == 1] for u, (x, y) in at.items()}
    return search.Graph(near, at, frozenset(blocked))


def _turns(g, path):
    way = [math.atan2(g.at[b][1] - g.at[a][1], g.at[b][0] - g.at[a][0]) for a, b in zip(path, path[1:])]
    return sum(a != b for a, b in zip(way, way[1:]))


def test_turns_cost():
    g = _grid_graph(4)
    path, cost = search.turning(g, 0, 15, 10.0)
    assert _turns(g, path) == 1 and cost == 16.0
    assert search.turning(g, 5, 5, 1.0) == ([5], 0.0)
    assert search.turning(_grid_graph(3, {4}), 4, 0)[0] == []


def test_alternatives_are_cheapest_first():
    g = _grid_graph(3)
    found = search.alternatives(g, 0, 8, 6)
    every = [p for p, _ in found]
    assert len(found) == 6 and len(set(map(tuple, every))) == 6 and all(c == 4.0 for _, c in found)  # all six shortest ways


def test_lanes_lock_inner_nodes():
    g = _grid_graph(3)
    got = search.lanes(g, 0, 8)
    assert [n for n, _, _ in got] == ["forward_main", "forward_backup_01", "backward_main", "backward_backup_01"]
    assert not set(got[0][1][1:-1]) & set(got[1][1][1:-1]) and got[2][1][0] == 8 and got[2][1][-1] == 0


def test_smooth_route_avoids_a_slow_middle():
    hill = lambda x, y: 1 + 20 * np.exp(-((x - 5) ** 2 + y**2) / 2)
    line, value = search.smooth_route(hill, (0, 0), (10, 0), middles=3, particles=30, rounds=60)
    straight = 10 * hill(np.linspace(0, 10, 200), np.zeros(200)).mean()
    assert value < straight * 0.7 and tuple(line[0]) == (0, 0) and tuple(line[-1]) == (10, 0)
