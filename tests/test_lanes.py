"""Lane rules, candidates and exact percentiles against plain versions."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.operators import lanes, quantiles


def test_percentiles_both_ways(spark):
    rnd = random.Random(3)
    at = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]
    for values in ([rnd.gauss(0, 5) for _ in range(997)], [float(rnd.randint(0, 6)) for _ in range(500)] + [1e9, -1e9], [4.0] * 50, [1.0], [1.0, 2.0]):
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v double").repartition(5)
        want = np.percentile(values, [100 * p for p in at])
        for buffered in (10**6, 0):  # one buffer, and ranges
            got = quantiles.percentiles(df, F.col("v"), at, buffered).first()["q"]
            assert np.allclose(got, want, rtol=1e-12, atol=1e-12)
    assert quantiles.percentiles(spark.createDataFrame([(None,)], "v double"), F.col("v"), at, 0).first()["q"] is None


def test_slowness_of_forced_nodes(spark):
    nan = float("nan")
    rows = [(1, 99.0, True, True), (2, 0.2, True, False), (3, 0.4, True, False), (4, 0.9, False, False), (5, 99.0, True, True), (6, nan, True, False), (7, None, True, False), (8, -1.0, True, False),
            (9, -1.0, False, False), (10, 99.0, True, False), (11, nan, True, True)]
    n = spark.createDataFrame(rows, "id long, slowness double, active boolean, special boolean")
    e = spark.createDataFrame([(1, 2), (2, 1), (3, 1), (1, 4), (1, 10), (1, 1), (8, 5)], "u long, v long")
    got = {r.id: r.effective for r in lanes.effective_slowness(n, e).collect()}
    assert got == pytest.approx({1: 0.3, 2: 0.2, 3: 0.4, 4: 0.9, 5: 0.085, 6: 0.085, 7: 0.085, 8: 0.085, 9: -1.0, 10: 99.0, 11: 0.085})


def test_overlap_and_lanes(spark):
    n = spark.createDataFrame([(k, 100.0 * k, 0.0, 3.0, k == 0, k == 9) for k in range(10)], "id long, x double, y double, penalty double, blocked boolean, allowed boolean")
    path, ends = n.where("id < 5"), n.where("id IN (0, 4)")
    once = {r.id: (r.penalty, r.blocked, r.changed) for r in lanes.overlap_control(n, path, ends, 100.0, 100.0, most=12.0).collect()}
    assert once == {k: (12.0 if k == 2 else 3.0, False, k == 2) for k in range(10)}
    shut = {r.id for r in lanes.overlap_control(n, path, ends, 100.0, 0.0, action="block").where("blocked").collect()}
    assert shut == {1, 2, 3, 5}
    assert lanes.overlap_control(n, path, ends, action="none").where("changed").count() == 0
    with pytest.raises(ValueError):
        lanes.overlap_control(n, path, ends, action="other")
    p = lanes.lane_preference(n, path, 100.0, preferred=200.0, most=4.0, hard=300.0)
    got = {r.id: (r.lane_distance, r.lane_penalty, r.lane_blocked) for r in p.collect()}
    far = lambda k: max(0, k - 4) * 100.0
    assert got == {k: (far(k), min(4.0, 1 + 1.5 * max(0, far(k) - 100) / 100), far(k) > 300 and k != 9) for k in range(10)}
    assert tuple(lanes.lane_spread(p, n.where("id IN (4, 5, 6)")).first()) == (100.0, 200.0)
    alone = lanes.lane_preference(n, path.where("false"), 100.0)
    assert {(r.lane_distance, r.lane_penalty, r.lane_blocked) for r in alone.collect()} == {(math.inf, 1.0, False)}
    assert tuple(lanes.lane_spread(alone, n).first()) == (None, None)


def test_peak_candidates(spark):
    rows = [(1, 9, 1, 0, 0, "N"), (2, 5, 2, 0, 0, "N"), (3, 9, 9, 9, 0, "DB"), (4, 7, 1, 0, 1, "N"), (5, 8, 0, 0, 1, None), (6, 1, 5, 0, 2, "N"), (7, 30, 0, 0, -1, "N"), (8, 2, 0, 0, -1, "N"), (9, 40, 0, 0, -1, "RA")]
    n = spark.createDataFrame(rows, "id long, hits long, degree long, pairs long, cluster int, label_prefix string")
    got = [(r.candidate_id, r.id) for r in lanes.peak_candidates(n, noise=0.5).orderBy("candidate_id").collect()]
    assert got == [("IP001", 7), ("IP002", 5), ("IP003", 2)]
    assert [r.id for r in lanes.peak_candidates(n, noise=None).orderBy("candidate_id").collect()] == [5, 2]
    assert lanes.peak_candidates(n.where("false")).count() == 0


def _moved(cands, nodes, clear, reach, apart, loss, must):
    """The same choice, node by node."""
    by, out = {n[0]: n for n in nodes}, []
    now = [by[c][1:3] for _, c in cands]
    for i, (place, c) in enumerate(cands):
        _, x, y, h0, _, cl0 = by[c]
        stay = lambda why: out.append((place, c, c, why))  # noqa: E731, B023
        if cl0 >= clear:
            stay("clear")
            continue
        near = [n for n in nodes if n[4] and n[0] != c and math.hypot(n[1] - x, n[2] - y) <= reach]
        good = [n for n in near if (n[5] >= clear if must else n[5] > cl0)]
        free = [n for n in good if all(math.hypot(n[1] - a, n[2] - b) >= apart for j, (a, b) in enumerate(now) if j != i)]
        rich = [n for n in free if n[3] >= h0 * (1 - loss)]
        if not rich:
            stay("none in reach" if not near else "none clear enough" if not good else "too near others" if not free else "too few hits")
            continue
        top = max(max(n[3] for n in rich), h0, 1)
        score = lambda n: min(n[5] / clear, 2) / 2 + 0.25 * n[3] / top - 0.2 * math.hypot(n[1] - x, n[2] - y) / reach  # noqa: E731, B023
        best = max(rich, key=lambda n: (score(n), -n[0]))
        now[i] = best[1:3]
        out.append((place, c, best[0], "shifted"))
    return sorted(out)


def test_shifted_candidates(spark):
    rnd = random.Random(5)
    nodes = [(k, rnd.uniform(0, 400), rnd.uniform(0, 400), rnd.randint(0, 20), rnd.random() < 0.5, rnd.choice([0.0, 10.0, 40.0, 60.0, 90.0, math.inf])) for k in range(150)]
    cands = [(p, c) for p, c in enumerate(rnd.sample(range(150), 40))]
    n = spark.createDataFrame(nodes, "id long, x double, y double, hits long, eligible boolean, clearance double")
    c = spark.createDataFrame(cands, "place long, id long").repartition(3)
    seen = set()
    for clear, reach, apart, loss, must in ((50.0, 80.0, 20.0, 1.0, True), (50.0, 60.0, 40.0, 0.2, True), (70.0, 30.0, 0.0, 0.5, False)):
        got = sorted((r.place, r.id, r.to, r.reason) for r in lanes.shifted(c, n, clear, reach, apart, loss, must_clear=must).collect())
        assert got == _moved(cands, nodes, clear, reach, apart, loss, must)
        seen |= {r[3] for r in got}
    assert seen == {"clear", "none in reach", "none clear enough", "too near others", "too few hits", "shifted"}
    assert lanes.shifted(c.where("false"), n).count() == 0
    with pytest.raises(ValueError):
        lanes.shifted(c, n, most=3)
