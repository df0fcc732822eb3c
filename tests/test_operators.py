"""Operators on hand-made edge cases, and all registered queries against their SQL."""

import math
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions import columns as C
from skyloom.operators import graph, grid, routes, search, selection, spatial
from skyloom.plans import registry
from skyloom.sources import text

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _norm(v):
    v = float(v) if type(v).__name__ == "Decimal" else v
    return None if isinstance(v, float) and math.isnan(v) else round(v, 4) + 0.0 if isinstance(v, float) else v


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    df = registry.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = con.sql(registry.ORACLES[name])
    at = [rel.columns.index(c) for c in cols]
    assert sorted(rel.columns) == cols
    got = sorted(str(tuple(map(_norm, r))) for r in df.select(*cols).collect())
    assert got == sorted(str(tuple(_norm(r[i]) for i in at)) for r in rel.fetchall())


def test_missing_slowness_is_no_fly(spark):
    d = spark.createDataFrame([(1, None), (2, float("nan")), (3, 0.5), (4, 0.1)], "id int, s double")
    assert [r.n for r in d.select("id", C.no_fly(F.col("s"), 0.3).alias("n")).orderBy("id").collect()] == [True, True, True, False]


def test_degenerate_norms(spark):
    d = spark.createDataFrame([(1.0,), (1.0,), (None,)], "v double")
    assert {r.n for r in C.robust_norm(d, "v", "n").collect()} == {0.0}


def test_nearest_with_ties_and_without_sites(spark):
    p = spark.createDataFrame([(1, 0.0, 0.0), (2, 50.0, 0.0)], "id long, x double, y double")
    s = spark.createDataFrame([(8, 1.0, 0.0), (7, -1.0, 0.0)], "site long, x double, y double")
    assert {(r.id, r.site, r.dist) for r in spatial.nearest(p, s, 2.0).collect()} == {(1, 7, 1.0), (2, 8, 49.0)}
    assert {(r.id, r.site, r.dist) for r in spatial.nearest(p, s.limit(0), 2.0).collect()} == {(1, None, None), (2, None, None)}


def test_touching_faces_do_not_collide(spark):
    a = spark.createDataFrame([(1, 0.0, 10.0)], "k int, lo double, hi double")
    b = spark.createDataFrame([(1, 10.0, 20.0), (1, 9.0, 20.0)], "k int, base double, top double")
    assert spatial.overlap_join(a, b, "k", "lo", "hi", "base", "top").count() == 1


def test_route_of_one_node_and_self_loop(spark):
    d = spark.createDataFrame([("a", 1, 5), ("b", 1, 6), ("b", 2, 6), ("b", 3, 7)], "r string, s int, n int")
    assert [(r.r, r.from_node, r.to_node) for r in routes.edges(d, "r", ["s"], "n").collect()] == [("b", 6, 7)]


def test_search_agrees_with_relaxation(spark):
    rows = [(i, (i * 7 + k) % 30, float(1 + (i * k) % 5)) for i in range(30) for k in (1, 2, 3) if i != (i * 7 + k) % 30]
    e = spark.createDataFrame(rows, "src long, dst long, cost double").groupBy("src", "dst").agg(F.min("cost").alias("cost"))
    far = {r.node: r.dist for r in graph.distances(e, 0).collect()}
    pairs = spark.range(30).select(F.col("id").alias("pair_id"), F.lit(0).cast("long").alias("start"), F.col("id").alias("goal"))
    got = {r.pair_id: r.total_cost for r in graph.solve(pairs, e, "dijkstra").collect() if r.success}
    assert got == far


def test_utm_known_point(spark):
    e, n = spark.range(1).select(*C.utm(F.lit(105.0), F.lit(0.0))).first()
    assert abs(e - 500000) < 1e-6 and abs(n) < 1e-6


def test_blur_keeps_mass(spark):
    d = spark.createDataFrame([(0, 0, 4.0)], "ix int, iy int, v double")
    assert abs(grid.blurred(d, "v", 1.0).agg(F.sum("v")).first()[0] - 4.0) < 1e-9


def test_scans(spark, tmp_path):
    (tmp_path / "m.xyz").write_text("# c\n1 2 3 0.5 DB_01\n\n1 2\nx 2 3 4 N\n5,6,7,0.1,FLZ2\n")
    rows = text.xyz(spark, str(tmp_path / "m.xyz")).orderBy("x").collect()
    assert [(r.x, r.slowness, r.label_prefix) for r in rows] == [(1.0, 0.5, "DB_"), (5.0, 0.1, "FLZ")]
    assert text.parameters("A = 3 # n\nB='x#y'\nC = yes\nD = foo\n", {"E": 1}) == {"A": 3, "B": "x#y", "C": True, "D": "foo", "E": 1}
    assert text.rank_selection("1-3, 7") == [1, 2, 3, 7] and text.rank_selection("all") is None


def _lattice(n=8, blocked=()):
    at = {i * n + j: (j * 10.0, i * 10.0) for i in range(n) for j in range(n)}
    near = {u: [(v, search.Graph({}, at).distance(u, v)) for v in at if v != u and search.Graph({}, at).distance(u, v) < 15] for u in at}
    return search.Graph(near, at, frozenset(blocked))


def test_best_first_is_cheapest_and_avoids_blocked():
    g = _lattice(blocked=[27, 28, 35])
    path, cost = search.astar(g, 0, 63)
    plain = {u: [(v, c) for v, c in vs if v not in g.blocked] for u, vs in g.near.items() if u not in g.blocked}
    assert not set(path) & g.blocked and math.isclose(cost, graph.dijkstra(plain, 0, 63)[1])
    assert search.astar(g, 0, 27) == ([], math.inf) and search.astar(g, 5, 5) == ([5], 0)


def test_sight_smoothing():
    assert search.theta(_lattice(), 0, 7)[0] == [0, 7]
    g = _lattice(blocked=[27, 28])
    path, cost = search.theta(g, 24, 31, clearance=4.0)
    assert all(search.in_sight(g, a, b, 4.0) or b in dict(g.near[a]) for a, b in zip(path, path[1:])) and cost <= search.astar(g, 24, 31)[1] + 1e-9


def test_replanning_and_ranks():
    g = _lattice()
    path, _ = search.replanned(g, 0, 63, [(2, frozenset([27, 36]))])
    assert path[0] == 0 and path[-1] == 63 and not {27, 36} & set(path[3:])
    ranks = search.ranked(g, 0, 63, 3)
    assert len(ranks) > 1 and ranks[0][1] <= ranks[1][1] and len({tuple(p) for p, _ in ranks}) == len(ranks)


def test_colony_and_swarm():
    g = _lattice(5)
    path, cost = search.colony(g, 0, 24)
    assert path[0] == 0 and path[-1] == 24 and cost < 2 * search.astar(g, 0, 24)[1]
    x, loss = search.swarm(lambda p: float(((p - 3) ** 2).sum()), [0, 0], [10, 10])
    assert loss < 1e-3 and np.allclose(x, 3, atol=0.1)


def test_marching():
    t = search.marched(np.ones((9, 9)), (4, 4))
    assert math.isclose(t[4, 8], 4.0) and abs(t[0, 0] - math.hypot(4, 4)) < 1.0
    assert search.descended(t, (4, 8))[0] == (4, 4)
    wall = np.ones((5, 5))
    wall[:, 2] = math.inf
    assert search.descended(search.marched(wall, (2, 0)), (2, 4)) == []


def test_separation(spark):
    rows = [(i, "a" if i % 3 else "b", i * 7 % 50 * 1.0, i * 11 % 50 * 1.0, float(i * 13 % 29)) for i in range(60)]
    d = spark.createDataFrame(rows, "id long, area string, x double, y double, score double")
    want = []
    for a in "ab":
        taken = []
        for r in sorted((r for r in rows if r[1] == a), key=lambda r: (-r[4], r[0])):
            if len(taken) < 5 and all(math.hypot(r[2] - t[2], r[3] - t[3]) >= 12 for t in taken):
                taken.append(r)
        want += [(a, k + 1, r[0]) for k, r in enumerate(taken)]
    got = [(r.area, r["rank"], r.id) for r in selection.separated(d, "area", 5, 12.0).collect()]
    assert sorted(got) == sorted(want) and selection.share_count(200, 10, 5, 15) == 15
    assert selection.separated(d.limit(0), "area", 5, 12.0).count() == 0


def test_hops_reach_the_end_of_a_long_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(70)] + [(70, 0)], "src long, dst long")
    assert {(r.node, r.hops) for r in graph.hops(edges, 0).collect()} == {(k, k) for k in range(71)}
