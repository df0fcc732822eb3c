"""Scans, sinks and model operators on hand-made files and edge cases."""

import gzip
import json
import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.functions import classes as K
from skyloom.functions import columns as C
from skyloom.operators import model, spatial
from skyloom.sources import tables


def _file(tmp_path, name, text):
    p = tmp_path / name
    p.parent.mkdir(parents=True, exist_ok=True)
    p.write_text(text)
    return str(p)


def _rows(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


def test_model_scans(spark, tmp_path):
    f = _file(tmp_path, "cost.xyz", "# head\n1 2 3 0.5 0.25 A\n\n4,5,6,0.5,0.75\n7 8 9 bad 1\n1 2\n")
    assert _rows(tables.cost_model(spark, f), "x", "slowness", "density", "label") == [(1.0, 0.5, 0.25, "A"), (4.0, 0.5, 0.75, None)]
    g = _file(tmp_path, "labels.xyz", "1 2 3 0.5 DB1\n4 5 6 0.7 RA2\n")
    assert _rows(tables.cost_model(spark, g), "density", "label") == [(None, "DB1"), (None, "RA2")]
    h = _file(tmp_path, "plane.txt", "1 2 0 5\n1,2,0,7\n3 4 0 1\nx y z v\n")
    assert sorted(_rows(tables.plane_model(spark, h), "lon", "lat", "slowness")) == [(1.0, 2.0, 7.0), (3.0, 4.0, 1.0)]
    n = _file(tmp_path, "nodes.txt", "1 2 3 4\n1 2 3 4 db7\n1 2 3 4 x9 ra\n1 2 3 4 a b c\n")
    assert _rows(tables.node_model(spark, n), "label", "label_prefix") == [("NODE", "NODE"), ("db7", "DB"), ("x9", "RA")]
    p = _file(tmp_path, "padded.txt", "1 2\n1 2 9\n1 2 3 9\n1\n")
    assert _rows(tables.padded(spark, p), "x", "y", "z", "value") == [(1.0, 2.0, 0.0, 0.0), (1.0, 2.0, 0.0, 9.0), (1.0, 2.0, 3.0, 9.0)]


def test_tables_with_and_without_header(spark, tmp_path):
    a = _file(tmp_path, "a.csv", "lon;lat;name\n1;2;x\n3;4;y\n")
    assert _rows(tables.sniffed(spark, a), "lon", "lat", "name") == [("1", "2", "x"), ("3", "4", "y")]
    b = _file(tmp_path, "b.txt", "# c\n1 2 3\n4 5 6\n")
    assert _rows(tables.sniffed(spark, b), "x", "y", "z") == [("1", "2", "3"), ("4", "5", "6")]
    assert tables.sniffed(spark, _file(tmp_path, "c.txt", "\n")).count() == 0
    m = tables.planning_model(spark, _file(tmp_path, "m.txt", "x y risk\n1 2 0.5\n3 4 \n"), {"risk": 0.0, "label": ""})
    assert _rows(m, "x", "risk", "label") == [(1, 0.5, ""), (3, 0.0, "")]


def test_folders(spark, tmp_path):
    d = tmp_path / "routes"
    _file(d, "DB1_main_01.csv", "node\n1\n2\n"), _file(d, "DB1_summary.csv", "node\n9\n"), _file(d, "notes.txt", "node\n8\n")
    assert sorted(_rows(tables.route_files(spark, str(d), exclude=["summary"]), "node", "file_name")) == [("1", "DB1_main_01.csv"), ("2", "DB1_main_01.csv")]
    files = tables.file_table(spark, str(d))
    best = tables.scored(files, {"db1": -5, "summary": 3}, [".csv"])
    assert best.count() == 2 and tables.best_file(best).endswith("DB1_main_01.csv")
    kinds = tables.classified(files, [("summary", "report"), (r"\.csv$", "route")])
    assert sorted(_rows(kinds, "name", "category")) == [("DB1_main_01.csv", "route"), ("DB1_summary.csv", "report"), ("notes.txt", "other")]
    e = tmp_path / "plans"
    _file(e, "one.xyz", "1 2\n1 2 3\nbad 2\n"), _file(e, "two.xyz", "5 6 7 Docking A\n")
    assert sorted(_rows(tables.plans(spark, str(e)), "name", "lon", "z")) == [("Docking A", 5.0, 7.0), ("one", 1.0, 0.0), ("one", 1.0, 3.0)]


def test_cells_and_buildings(spark, tmp_path):
    head = ",".join(tables.CELL)
    lines = "LTE,452,1,1,1,0,105.5,21,100,3,1,0,0,-80\nGSM,1,1,1,1,0,10,20,100,3,1,0,0,0\nGSM,,1,1,1,0,10,20,100,3,1,0,0,0\nGSM,452,1,1,1,0,0,20,1,1,1,0,0,0\nGSM,452,1,1,1,0,x,20,1,1,1,0,0,0\n"
    with gzip.open(tmp_path / "c.csv.gz", "wt") as f:
        f.write(head + "\n" + lines)
    assert sorted(_rows(tables.cell_towers(spark, str(tmp_path / "c.csv.gz"), 452), "radio", "lon")) == [("GSM", 10.0), ("LTE", 105.5)]
    assert tables.cell_towers(spark, _file(tmp_path, "d.csv", lines)).count() == 3
    b = spark.createDataFrame([(1.0, 1.0, "g1", 5.0, "x"), (9.0, 9.0, "g2", 6.0, "y")], "lon double, lat double, Geom string, Height double, other string")
    b.write.parquet(str(tmp_path / "b.parquet"))
    got = tables.buildings(spark, str(tmp_path / "b.parquet"), (0, 0, 2, 2))
    assert got.columns == ["lon", "lat", "geometry", "height"] and _rows(got, "geometry", "height") == [("g1", 5.0)]
    assert "other" not in got._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[1]
    u = tables.united_buildings({"b": got, "a": got.withColumn("floors", F.lit(2)).unionByName(spark.createDataFrame([(3.0, 3.0, None, 1.0, 1)] * 2, "lon double, lat double, geometry string, height double, floors int"))})
    assert sorted(_rows(u, "source", "geometry", "floors"), key=str) == [("a", "g1", 2), ("a", None, 1), ("a", None, 1)]


def test_requests_and_samples(spark):
    p = spark.range(1, 121).select("id", F.lit(0.0).alias("lon"), F.lit(0.0).alias("lat"))
    r = tables.forecast_requests(p, 24, datetime(2024, 1, 1, 10, 40))
    assert sorted(_rows(r.groupBy("call").count(), "call", "count")) == [(0, 50), (1, 50), (2, 20)]
    assert r.select("first", "last").distinct().collect() == [(datetime(2024, 1, 1, 10), datetime(2024, 1, 2, 10))]
    assert tables.request_box([(0, 0), (2, 1)], 0.5) == [1.5, -0.5, -0.5, 2.5]
    assert tables.sub_boxes(spark, 0, 0, 1, 0.5, 0.4).count() == 6 and tables.map_tiles(spark, -10.0, -10.0, 10.0, 10.0, 3).count() == 4
    s = tables.polygon_samples(spark, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)], 0.4)
    assert set(_rows(s, "x", "y")) == {(a, b) for a in (0.0, 0.4, 0.8) for b in (0.0, 0.4, 0.8)} | {(1.0, 0.0), (1.0, 1.0), (0.0, 1.0), (0.5, 0.5)}
    d = tables.profile(spark.createDataFrame([(1, "a"), (3, None)], "n int, s string"))
    assert [tuple(r)[0:4] for r in d.collect()] == [("n", "int", 2, 0), ("s", "string", 2, 1)] and d.first().mean == 2.0


def test_sinks(spark, tmp_path):
    d = spark.createDataFrame([("a", 1, True), ("b", 2, None), ("a", 3, False)], "g string, v int, burned boolean")
    tables.write_groups(d, f"{tmp_path}/g", "g")
    assert spark.read.option("header", True).csv(f"{tmp_path}/g/g=a").count() == 2
    tables.write_voxels(d, f"{tmp_path}/v", F.col("burned"))
    assert [spark.read.parquet(f"{tmp_path}/v/{n}").count() for n in ("all", "flyable", "burned")] == [3, 2, 1]
    assert json.loads(spark.read.text(f"{tmp_path}/v/summary").first()[0]) == {"total": 3, "burned": 1, "flyable": 2}
    m = spark.createDataFrame([("in", "csv", "a", "b", "ok", 1)], "category string, type string, src string, dst string, status string, more int")
    tables.add_manifest(m, f"{tmp_path}/m"), tables.add_manifest(m, f"{tmp_path}/m")
    assert spark.read.option("header", True).csv(f"{tmp_path}/m").count() == 2
    f = spark.createDataFrame([(1, [[(0.0, 1.0), (2.0, 3.0)], [(4.0, 5.0)]])], "feature_id int, parts array<array<struct<x:double,y:double>>>")
    v = tables.vertices(f)
    assert _rows(v, "part", "seq", "x") == [(0, 0, 0.0), (0, 1, 2.0), (1, 0, 4.0)]
    tables.write_vertices(v, f"{tmp_path}/x")
    assert [r[0] for r in spark.read.text(f"{tmp_path}/x").collect()] == ["0.0 1.0", "2.0 3.0", "NaN NaN", "4.0 5.0", "NaN NaN"]
    k = tables.path_kml(spark.createDataFrame([("a&b", 1, 3.0, 4.0, None), ("a&b", 0, 1.0, 2.0, 5.0)], "route string, seq int, lon double, lat double, z double")).first().kml
    assert "<name>a&amp;b</name>" in k and "1.00000000,2.00000000,5.000 3.00000000,4.00000000,0.000" in k


@pytest.mark.parametrize("limit", [10_000, 0])
def test_nearest_with_places_missing(spark, limit):
    nan, inf = float("nan"), float("inf")
    points = spark.createDataFrame([(1, 0.0, 0.0), (2, None, 1.0), (3, nan, 0.0), (4, inf, 0.0), (5, 100.0, 0.0)], "id int, x double, y double")
    sites = spark.createDataFrame([(7, 1.0, 0.0), (8, nan, 0.0), (9, None, None), (10, inf, 1.0)], "site int, x double, y double")
    got = {r.id: (r.site, r.dist) for r in spatial.nearest_of_few(points, sites, limit=limit).collect()}
    assert got == {1: (7, 1.0), 2: (None, None), 3: (None, None), 4: (None, None), 5: (7, 99.0)}


def test_paths(spark):
    m = spark.createDataFrame([(1, 0.5), (2, 20.0), (3, None)], "id int, slowness double")
    path = lambda *ids: spark.createDataFrame([(i,) for i in ids], "id int")
    blocked = F.col("slowness") >= 10
    assert model.validated(path(1), m, blocked).count() == 1
    for bad in ((1, 2), (3,), (4,)):
        with pytest.raises(ValueError):
            model.validated(path(*bad), m, blocked)
    d = spark.createDataFrame([("a", 0, 0.0, 0.0, 0.0, 1.0), ("a", 1, 3.0, 4.0, 0.0, 3.0), ("a", 2, 3.0, 4.0, 12.0, 3.0)], "r string, k int, x double, y double, z double, c double")
    assert _rows(model.path_metrics(d, "r", ["k"], F.col("c")), "nodes", "distance", "cost") == [(3, 17.0, 46.0)]
    lon = spark.createDataFrame([("a", 0, 105.0, 21.0, 1.0), ("a", 1, 105.001, 21.0, 3.0)], "r string, k int, lon double, lat double, slowness double")
    last = model.cumulative(lon, "r", ["k"]).orderBy(F.desc("k")).first()
    assert abs(last.distance_m - 111.32 * math.cos(math.radians(21))) < 1 and abs(last.time_s - 2 * last.distance_m) < 1e-6
    s = spark.createDataFrame([([(1.0, 0.0, 0.0), (2.0, 0.0, math.pi / 2), (50.0, math.pi / 2, 0.0)],)], "m array<struct<r:double,psi:double,phi:double>>")
    got = s.select(K.spherical_points(F.col("m"), F.lit(0), F.lit(0), F.lit(0), (0, 0, 0), (10, 1.5, 10))).first()[0]
    assert np.allclose([tuple(p) for p in got], [(1, 0, 0), (1, 1.5, 0), (1, 1.5, 10)])


def test_balanced_choice(spark):
    pool = spark.createDataFrame([(1, "a", 0.0, 0.0, 9.0, 1), (2, "a", 1.0, 0.0, 8.0, 1), (3, "a", 500.0, 0.0, 7.0, 1), (4, "b", 2.0, 0.0, 9.0, 1), (5, "b", 700.0, 0.0, 1.0, 1), (6, "c", 190.0, 0.0, 5.0, 1)], "id int, area string, x double, y double, score double, hits int")
    areas = spark.createDataFrame([("a", 2, 10.0), ("b", 1, 5.0), ("c", 1, 1.0)], "area string, quota int, density double")
    got = model.balanced(pool, areas, apart=300.0).orderBy("turn_rank")
    assert _rows(got, "id", "kind", "area_rank") == [(1, "primary", 1), (5, "primary", 1), (6, "primary", 1), (3, "extra", 2)]
    assert model.balanced(pool.limit(0), areas).count() == 0
    r = spark.createDataFrame([(1, 0.0, 0.0, "p", 9), (2, 1.0, 0.0, "q", 8), (3, 50.0, 0.0, "q", 1)], "id int, x double, y double, cluster string, hits int")
    assert sorted(_rows(model.spread_representatives(r, "cluster", 10.0), "id")) == [(1,), (3,)]
    nodes = [(k, 5, 3, 1, -1 if k > 5 else 0, "RA" if k == 2 else "N") for k in range(1, 12)] + [(20, 50, 3, 1, -1, "N"), (21, 1, 9, 9, 0, "N")]
    pool = model.candidate_pool(spark.createDataFrame(nodes, "id int, hits int, degree int, pairs int, cluster int, label_prefix string"))
    assert {r.id for r in pool.collect()} == {1, 3, 4, 5, 20}


def test_classes(spark):
    d = spark.createDataFrame([(0, 1), (7, 3), (15449, 42)], "n long, s long")
    got = [r[0] for r in d.select(K.unit_hash(F.col("n"), F.col("s"))).collect()]
    assert all(0 <= g <= 1 for g in got) and len(set(got)) == 3
    texts = spark.createDataFrame([("approx 12 m",), ("10;12",), ("about 5 floors",), ("30 feet",), (None,), ("nan",)], "t string")
    assert [r[0] for r in texts.select(C.parse_metres(F.col("t"), strict=True)).collect()] == [12.0, 10.0, None, pytest.approx(9.144), None, None]
    volts = spark.createDataFrame([("35,5",), ("110000",), ("110kv",)], "t string")
    assert [r[0] for r in volts.select(C.parse_kilovolts(F.col("t"))).collect()] == [35.5, 110.0, None]
    assert model.route_prefixes(["DB", "FLZ", "DK"]) == (["DB", "DK"], ["RA", "FLZ"]) and model.route_prefixes(["DB", "FLZ"], flz=True) == (["DB", "FLZ"], ["RA"])
    r = model.relabelled(spark.createDataFrame([("DB", 20.0), ("N", 1.0)], "label_prefix string, s double"), F.col("s") > 10)
    assert _rows(r, "label_prefix", "label_prefix_before") == [("NOFLY", "DB"), ("N", "N")]
    assert model.circle_risk(spark.createDataFrame([(1, 0.0, 0.0)], "id int, x double, y double"), spark.createDataFrame([], "x double, y double, radius double"), 5.0).first() == (1, 0.0, False)
