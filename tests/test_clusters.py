"""Links within a radius and density clusters against all pairs."""

import math
import random

import pytest

from skyloom.operators import graph, spatial

NOWHERE = [(900, None, 1.0), (901, float("nan"), 2.0), (902, 3.0, float("inf"))]


def _places(seed):
    rnd = random.Random(seed)
    rows = [(k, rnd.gauss(0, 40), rnd.gauss(0, 40)) for k in range(250)]
    return rows + [(300 + k, *rows[k % 3][1:]) for k in range(30)] + [(400 + k, 200.0 + 8 * k, 200.0) for k in range(60)]  # copies, a chain of touching links


def _within(rows, radius):
    return [(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and math.sqrt((a[1] - b[1]) ** 2 + (a[2] - b[2]) ** 2) <= radius]


def _least(ids, pairs):
    root = {k: k for k in ids}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a, b in pairs:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return {k: find(k) for k in ids}


@pytest.mark.parametrize("radius", [3.0, 8.0])
def test_linked(spark, radius):
    rows = _places(5)
    got = {r.id: r.component for r in spatial.linked(spark.createDataFrame(rows + NOWHERE, "id long, x double, y double"), radius).collect()}
    assert got == _least([r[0] for r in rows], _within(rows, radius)) | {k: k for k in (900, 901, 902)}


def test_many_copies_make_no_pairs(spark):
    """All pairs of the copies would be 4.5 billion."""
    d = spark.range(300_000).selectExpr("id", "CAST(id % 3 AS double) * 0.1 AS x", "0D AS y")
    assert {tuple(r) for r in spatial.linked(d, 8.0).groupBy("component").count().collect()} == {(0, 300_000)}
    e = spatial.density_clusters(d.selectExpr("id AS node", "x", "y", "1D AS weight"), 14.0, 5.0)
    assert {tuple(r) for r in e.groupBy("cluster", "is_core").count().collect()} == {(0, True, 300_000)}


@pytest.mark.parametrize("least", [1.0, 4.0, 9.0])
def test_density_clusters(spark, least):
    rows = _places(6)
    weight = {k: 1.0 + k % 3 for k, *_ in rows + NOWHERE}
    pairs = _within(rows, 7.0)
    around = dict(weight)
    for a, b in pairs:
        around[a] += weight[b]
        around[b] += weight[a]
    core = {k for k in around if around[k] >= least}
    cluster = _least(core, [p for p in pairs if core.issuperset(p)])
    want = {k: (cluster[k], True) if k in core else (min((cluster[o] for p in pairs if k in p for o in p if o in core), default=None), False) for k in around}
    d = spark.createDataFrame([(*r, weight[r[0]]) for r in rows + NOWHERE], "node long, x double, y double, weight double")
    assert {r.node: (r.cluster, r.is_core) for r in spatial.density_clusters(d, 7.0, least).collect()} == want
    n = d.select("node", "weight")
    old = graph.dbscan(n, spark.createDataFrame(pairs, "a long, b long"), least)
    assert {r.node: (r.cluster, r.is_core) for r in old.collect()} == want
