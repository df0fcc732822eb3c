"""Registered queries on geometry, voxels, density layers, cost rules and the master network, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import columns as C
from ..operators import geometry, graph, grid, network, routes, search, selection, voxel
from .registry import _city, _grid, _routes, _scored, _SCORED, query
from .tables import ROUTE_ORDER, SQL_ORDER, points, table


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


# --- geometry

_SITES = "s AS (SELECT s_suppkey AS site, 100.0::DOUBLE + s_suppkey % 50 * 0.3::DOUBLE AS lon, s_suppkey % 37 * 0.5::DOUBLE AS lat, 5.0::DOUBLE + s_nationkey AS km FROM supplier)"


def _sites(spark, sf):
    return table(spark, sf, "supplier").select(F.col("s_suppkey").alias("site"), (100.0 + F.col("s_suppkey") % 50 * 0.3).alias("lon"), (F.col("s_suppkey") % 37 * 0.5).alias("lat"), (5.0 + F.col("s_nationkey")).alias("km"))


@query(f"""WITH {_SITES}, v AS (SELECT *, radians(i % 12 * 30.0::DOUBLE) AS b, km / 6371.0088 AS d, radians(lat) AS a FROM s, (SELECT unnest(range(0, 13)) AS i)),
w AS (SELECT *, sin(a)*cos(d) + cos(a)*sin(d)*cos(b) AS up FROM v)
SELECT site, CAST(i AS INT) AS vertex, round((degrees(radians(lon) + atan2(sin(b)*sin(d)*cos(a), cos(d) - sin(a)*up)) + 540) % 360 - 180, 6) AS vertex_lon, round(degrees(asin(up)), 6) AS vertex_lat FROM w""")
def circle_vertices(spark, sf_dir):
    return geometry.circles(_sites(spark, sf_dir), "lon", "lat", "km", 12).select("site", "vertex", _r("vertex_lon"), _r("vertex_lat"))


@query(f"""WITH {_SITES} SELECT site, round(2 * 6371008.8 * asin(sqrt(least(1, pow(sin(radians(10 - lat)/2), 2) + cos(radians(lat)) * cos(radians(10)) * pow(sin(radians(105 - lon)/2), 2)))), 4) AS metres FROM s""")
def great_circle(spark, sf_dir):
    return _sites(spark, sf_dir).select("site", F.round(geometry.haversine(F.col("lon"), F.col("lat"), F.lit(105.0), F.lit(10.0)), 4).alias("metres"))


@query()
def geodesic_distance(spark, sf_dir):
    return _sites(spark, sf_dir).select("site", F.round(geometry.geodesic(F.col("lon"), F.col("lat"), F.lit(105.0), F.lit(10.0)), 4).alias("metres"))


@query(f"""WITH {_SITES} SELECT site, CAST(floor((lon + 180) / 360 * 4096) AS BIGINT) AS tx, CAST(floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 4096) AS BIGINT) AS ty FROM s""")
def map_tiles(spark, sf_dir):
    tx, ty = C.tile_of(F.col("lon"), F.col("lat"), 12)
    return _sites(spark, sf_dir).select("site", tx.alias("tx"), ty.alias("ty"))


_SHAPES = "p AS (SELECT p_partkey AS id, p_partkey % 61 * 3.0::DOUBLE AS x0, p_partkey % 53 * 3.0::DOUBLE AS y0, p_size * 0.3::DOUBLE AS w, p_size * 0.2::DOUBLE + 1 AS h, p_retailprice AS price FROM part)"


def _shapes(spark, sf):
    """Parts as rectangles on a plane."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") % 61 * 3.0).alias("x0"), (F.col("p_partkey") % 53 * 3.0).alias("y0"), (F.col("p_size") * 0.3).alias("w"), (F.col("p_size") * 0.2 + 1).alias("h"), F.col("p_retailprice").alias("price"))
    x0, y0, x1, y1 = F.col("x0"), F.col("y0"), F.col("x0") + F.col("w"), F.col("y0") + F.col("h")
    return p.withColumn("ring", F.array(*[F.struct(x.alias("x"), y.alias("y")) for x, y in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))]))


@query(f"WITH {_SHAPES} SELECT id, round(w * h, 6) AS area, round(w * h * price, 4) AS volume FROM p")
def footprints(spark, sf_dir):
    area = geometry.ring_area(F.col("ring"))
    return _shapes(spark, sf_dir).select("id", F.round(area, 6).alias("area"), F.round(area * F.col("price"), 4).alias("volume"))


@query(f"""WITH {_SHAPES}, g AS (SELECT a.i AS ix, b.i AS iy FROM range(0, 120) a(i), range(0, 120) b(i))
SELECT ix, iy, arg_max(price, id) AS value FROM g JOIN p ON (ix + 0.5) * 2 >= x0 AND (ix + 0.5) * 2 < x0 + w AND (iy + 0.5) * 2 >= y0 AND (iy + 0.5) * 2 < y0 + h GROUP BY 1, 2""")
def burned_raster(spark, sf_dir):
    d = _shapes(spark, sf_dir).select("ring", F.col("price").alias("value"), F.col("id").alias("draw_order"))
    return geometry.rasterised(d, 2.0).select(F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"), "value")


_LINES = "l AS (SELECT o_orderkey AS id, o_orderkey % 89 * 1.0::DOUBLE AS x1, o_orderkey % 83 * 1.0::DOUBLE AS y1, o_custkey % 79 * 1.0::DOUBLE AS x2, o_custkey % 73 * 1.0::DOUBLE AS y2 FROM orders)"


def _lines(spark, sf):
    at = lambda c, n, to: (F.col(c) % n * 1.0).alias(to)
    return table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), at("o_orderkey", 89, "x1"), at("o_orderkey", 83, "y1"), at("o_custkey", 79, "x2"), at("o_custkey", 73, "y2"))


@query(f"""WITH {_LINES}, e AS (SELECT *, x2 - x1 AS dx, y2 - y1 AS dy FROM l),
t AS (SELECT *, CASE WHEN dx = 0 THEN 0 ELSE least((20.5-x1)/dx, (60.5-x1)/dx) END AS ax, CASE WHEN dx = 0 THEN 1 ELSE greatest((20.5-x1)/dx, (60.5-x1)/dx) END AS bx, CASE WHEN dy = 0 THEN 0 ELSE least((10.5-y1)/dy, (50.5-y1)/dy) END AS ay, CASE WHEN dy = 0 THEN 1 ELSE greatest((10.5-y1)/dy, (50.5-y1)/dy) END AS by_ FROM e
 WHERE NOT (dx = 0 AND (x1 < 20.5 OR x1 > 60.5)) AND NOT (dy = 0 AND (y1 < 10.5 OR y1 > 50.5))), c AS (SELECT *, greatest(0, ax, ay) AS lo, least(1, bx, by_) AS hi FROM t)
SELECT id, round(sqrt(dx*dx + dy*dy) * (hi - lo), 6) AS length FROM c WHERE lo <= hi""")
def clipped_lines(spark, sf_dir):
    part = geometry.clipped(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"), geometry.box(20.5, 10.5, 60.5, 50.5))
    d = _lines(spark, sf_dir).withColumn("part", part).where("part IS NOT NULL")
    return d.select("id", F.round(F.hypot(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")) * (F.col("part.hi") - F.col("part.lo")), 6).alias("length"))


@query(f"""WITH {_LINES}, e AS (SELECT *, sqrt(pow(x2-x1, 2) + pow(y2-y1, 2)) AS len FROM l), s AS (SELECT *, unnest(range(0, CAST(ceil(len / 10) AS BIGINT) + 1)) AS i FROM e)
SELECT id, CAST(i AS INT) AS sample, round(x1 + CASE WHEN len > 0 THEN least(1, i * 10 / len) ELSE 0 END * (x2-x1), 6) AS sx, round(y1 + CASE WHEN len > 0 THEN least(1, i * 10 / len) ELSE 0 END * (y2-y1), 6) AS sy FROM s""")
def sampled_lines(spark, sf_dir):
    return geometry.sampled(_lines(spark, sf_dir), 10.0).select("id", "sample", _r("sx"), _r("sy"))


@query(f"""WITH {_LINES}, e AS (SELECT *, CAST(greatest(abs(x2-x1), abs(y2-y1)) AS BIGINT) AS n FROM l), s AS (SELECT *, unnest(range(0, n + 1)) AS i FROM e),
c AS (SELECT id, i, CAST(floor(x1 + CASE WHEN n > 0 THEN i * (x2-x1) / n ELSE 0 END + 0.5) AS BIGINT) AS cx, CAST(floor(y1 + CASE WHEN n > 0 THEN i * (y2-y1) / n ELSE 0 END + 0.5) AS BIGINT) AS cy FROM s)
SELECT id, count(*) AS cells, count(*) FILTER ((cx * 7 + cy * 3) % 11 = 0) AS blocked, coalesce(array_to_string(list_slice(list(cx || ',' || cy ORDER BY i) FILTER ((cx * 7 + cy * 3) % 11 = 0), 1, 10), ';'), '') AS first_blocked FROM c GROUP BY id""")
def blocked_segments(spark, sf_dir):
    """Cells under each segment, how many are blocked, and the first ten of these."""
    blocked = (F.col("cx") * 7 + F.col("cy") * 3) % 11 == 0
    d = geometry.line_cells(_lines(spark, sf_dir)).withColumn("at", F.when(blocked, F.struct("place", F.concat_ws(",", "cx", "cy").alias("t"))))
    first = F.array_join(F.transform(F.slice(F.sort_array(F.collect_list("at")), 1, 10), lambda s: s["t"]), ";")
    return d.groupBy("id").agg(F.count("*").alias("cells"), F.count("at").alias("blocked"), first.alias("first_blocked"))


@query(f"""WITH {_SCORED}, s AS (SELECT s_suppkey AS site, s_suppkey % 97 * 10.0::DOUBLE AS x, s_suppkey % 41 * 20.0::DOUBLE AS y, 0.1::DOUBLE + s_nationkey * 0.03::DOUBLE AS weight, 15.0::DOUBLE + s_suppkey % 9 * 20 AS reach FROM supplier)
SELECT c.id, round(coalesce(max(weight * exp(-sqrt(pow(c.x-s.x,2)+pow(c.y-s.y,2)) / reach)), 0), 6) AS support FROM c LEFT JOIN s ON sqrt(pow(c.x-s.x,2)+pow(c.y-s.y,2)) <= reach GROUP BY c.id""")
def coverage_support(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") % 97 * 10.0).alias("x"), (F.col("s_suppkey") % 41 * 20.0).alias("y"), (0.1 + F.col("s_nationkey") * 0.03).alias("weight"), (15.0 + F.col("s_suppkey") % 9 * 20).alias("reach"))
    return geometry.coverage(_scored(spark, sf_dir), s).select("id", _r("support"))


# --- voxels and density layers

@query("""WITH h AS (SELECT p_partkey AS id, p_retailprice / 10 AS src, p_size * 1.0::DOUBLE AS ter FROM part), f AS (SELECT *, src >= 100 AND src > ter AND src - ter BETWEEN 2 AND 400 AS top FROM h)
SELECT id, round(greatest(0, CASE WHEN top THEN src - ter ELSE src END), 6) AS agl, top AS is_msl_top FROM f""")
def building_heights(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    h = voxel.height_reference(F.col("p_retailprice") / 10, F.col("p_size").cast("double"))
    return p.select(F.col("p_partkey").alias("id"), F.round(h["agl"], 6).alias("agl"), h["is_msl_top"].alias("is_msl_top"))


@query("""WITH v AS (SELECT s_suppkey AS xy_id, CAST(iz AS INT) AS iz, iz * 10.0::DOUBLE AS z_bot, iz * 10.0::DOUBLE + 10 AS z_top, CASE WHEN s_nationkey % 3 = 0 THEN s_nationkey * 1.0::DOUBLE END AS ground FROM supplier, (SELECT unnest(range(0, 6)) AS iz)),
f AS (SELECT l_suppkey AS xy_id, l_orderkey AS feature, l_returnflag = 'R' AS line, CAST(l_tax AS DOUBLE) * 100 AS t, CAST(l_quantity AS DOUBLE) AS h FROM lineitem),
i AS (SELECT *, CASE WHEN line THEN greatest(t, t + h - 3) ELSE t END AS base, CASE WHEN line THEN t + h + 3 ELSE t + h + 1 END AS top FROM f)
SELECT xy_id, iz, count(*) FILTER (line) AS n_lines, count(*) FILTER (NOT line) AS n_poles, count(DISTINCT feature) AS n_features FROM v JOIN i USING (xy_id) WHERE z_bot < top AND greatest(base, coalesce(ground, base)) < z_top AND greatest(base, coalesce(ground, base)) < top GROUP BY 1, 2""")
def powerline_voxels(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("xy_id"), "s_nationkey")
    v = grid.voxels(s, [0.0, 10.0, 20.0, 30.0, 40.0, 50.0]).select("xy_id", "iz", F.col("z").alias("z_bot"), (F.col("z") + 10).alias("z_top"))
    f = _routes(spark, sf_dir).select(F.col("l_suppkey").alias("xy_id"), F.col("l_orderkey").alias("feature"), F.when(F.col("l_returnflag") == "R", "line").otherwise("pole").alias("kind"), (F.col("l_tax").cast("double") * 100).alias("terrain"), F.col("l_quantity").cast("double").alias("height"))
    return voxel.powerline_burn(v, f, s.where("s_nationkey % 3 = 0").select("xy_id", (F.col("s_nationkey") * 1.0).alias("terrain_top")), 3.0, 1.0)


@query("""WITH t AS (SELECT l_suppkey % 20 AS ix, l_partkey % 20 AS iy, l_linenumber AS tile, l_orderkey, CASE WHEN l_returnflag = 'A' THEN NULL ELSE CAST(l_quantity AS DOUBLE) END AS v FROM lineitem), c AS (SELECT ix, iy, tile, min(v) AS v FROM t GROUP BY 1, 2, 3)
SELECT ix, iy, arg_min(v, tile) FILTER (v IS NOT NULL) AS v FROM c GROUP BY 1, 2""")
def mosaic_tiles(spark, sf_dir):
    t = _routes(spark, sf_dir).select((F.col("l_suppkey") % 20).alias("ix"), (F.col("l_partkey") % 20).alias("iy"), F.col("l_linenumber").alias("tile"), F.when(F.col("l_returnflag") != "A", F.col("l_quantity").cast("double")).alias("v"))
    return voxel.mosaic(t, "tile")


@query("""WITH s AS (SELECT c_custkey AS id, CASE WHEN c_nationkey % 4 = 0 THEN c_acctbal END AS a, CASE WHEN c_nationkey % 5 = 0 THEN c_acctbal / 2 END AS b FROM customer), m AS (SELECT quantile_cont(coalesce(a, b), 0.5) AS m FROM s)
SELECT id, round(coalesce(a, b, m), 6) AS z, CASE WHEN a IS NOT NULL THEN 'a' WHEN b IS NOT NULL THEN 'b' ELSE 'median' END AS z_source FROM s, m""")
def terrain_fill(spark, sf_dir):
    n, v = F.col("c_nationkey"), F.col("c_acctbal")
    s = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.when(n % 4 == 0, v).alias("a"), F.when(n % 5 == 0, v / 2).alias("b"))
    return voxel.filled(s, ["a", "b"], "z").select("id", _r("z"), "z_source")


_TWO = """a AS (SELECT c_nationkey AS ix, c_custkey % 12 AS iy, count(*) AS v FROM customer GROUP BY 1, 2), b AS (SELECT s_nationkey AS ix, s_suppkey % 12 AS iy, count(*) AS v FROM supplier GROUP BY 1, 2),
j AS (SELECT ix, iy, coalesce(a.v / (SELECT max(v) FROM a), 0) AS p, coalesce(b.v / (SELECT max(v) FROM b), 0) AS q FROM a FULL JOIN b USING (ix, iy)), w AS (SELECT *, 0.7 * p + 0.3 * q AS m, p + q AS s FROM j)"""


@query(f"""WITH {_TWO} SELECT CAST(ix AS BIGINT) AS ix, CAST(iy AS BIGINT) AS iy, round(greatest(p, q), 6) AS v_max, round(m / max(m) OVER (), 6) AS v_mean, round(s / max(s) OVER (), 6) AS v_sum FROM w""")
def combined_density(spark, sf_dir):
    cells = lambda t, k: table(spark, sf_dir, t).groupBy(F.col(f"{k}_nationkey").cast("long").alias("ix"), (F.col("c_custkey" if k == "c" else "s_suppkey") % 12).cast("long").alias("iy")).agg(F.count("*").alias("v"))
    a, b = cells("customer", "c"), cells("supplier", "s")
    d = voxel.combined(a, b).withColumnRenamed("v", "v_max")
    for mode, name in (("weighted_mean", "v_mean"), ("sum", "v_sum")):
        d = d.join(voxel.combined(a, b, mode, 0.7, 0.3).withColumnRenamed("v", name), ["ix", "iy"])
    return d.select("ix", "iy", _r("v_max"), _r("v_mean"), _r("v_sum"))


@query("""WITH g AS (SELECT c_nationkey AS ix, CAST(date_part('month', o_orderdate) AS INT) AS iy, sum(o_totalprice) AS v FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
k AS (SELECT i, exp(-0.5 * i * i) / sum(exp(-0.5 * i * i)) OVER () AS w FROM (SELECT unnest(range(-4, 5)) AS i))
SELECT CAST(g.ix + a.i AS BIGINT) AS ix, CAST(g.iy + b.i AS BIGINT) AS iy, round(sum(v * a.w * b.w), 2) AS v FROM g, k a, k b GROUP BY 1, 2""")
def gaussian_density(spark, sf_dir):
    d = grid.blurred(_grid(spark, sf_dir), "v", 1.0)
    return d.select(F.col("ix").cast("long").alias("ix"), F.col("iy").cast("long").alias("iy"), F.round("v", 2).alias("v"))


@query("""WITH b AS (SELECT s_nationkey AS col, max(s_acctbal) AS base_top FROM supplier GROUP BY 1), r AS (SELECT c_nationkey AS col, c_custkey AS block_id, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS INT) AS rank FROM customer)
SELECT col, block_id, rank, round(coalesce(base_top, 0) + rank * 2.5, 6) AS z FROM r LEFT JOIN b USING (col)""")
def stacked_blocks(spark, sf_dir):
    blocks = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("col"), F.col("c_custkey").alias("block_id"))
    base = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("col"), F.col("s_acctbal").alias("top"))
    return grid.surface_stack(blocks, base, "col", 2.5).select("col", "block_id", "rank", _r("z"))


# --- cost rules

@query("""WITH c AS (SELECT c_custkey AS id, CASE substr(c_mktsegment, 1, 4) WHEN 'AUTO' THEN 0.3 WHEN 'BUIL' THEN 0.6 ELSE 0.05 END + 0.2 * (c_nationkey / 24.0) AS r, c_custkey % 13 * 1.0::DOUBLE AS s, (c_custkey % 5) / 4.0 AS score FROM customer),
k AS (SELECT *, least(1, greatest(0, CASE WHEN s >= 10 THEN greatest(r, 1) ELSE r END)) AS risk FROM c), m AS (SELECT *, s * (1 + 3 * risk) * (1 + (1 - score)) AS cost FROM k)
SELECT id, round(risk, 6) AS risk, round(greatest(CASE WHEN s >= 10 THEN greatest(cost, s) ELSE cost END, 1e-9), 6) AS cost FROM m""")
def multiplied_costs(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("s", F.col("c_custkey") % 13 * 1.0)
    c = c.withColumn("risk", C.prefix_risk(F.substring("c_mktsegment", 1, 4), {"AUTO": 0.3, "BUIL": 0.6}, 0.05, [(F.col("c_nationkey") / 24, 0.2)], F.col("s")))
    return c.select(F.col("c_custkey").alias("id"), _r("risk"), F.round(C.multiplied_cost(F.col("s"), F.col("risk"), F.col("c_custkey") % 5 / 4), 6).alias("cost"))


@query("""SELECT c_custkey AS id, round(CASE WHEN s < 10 THEN s * greatest(1 - 0.5 * near, 0.7) ELSE s END, 6) AS attracted, round(CASE WHEN s < 10 THEN s * least(1 + 2 * near, 2.5) ELSE s END, 6) AS repelled
FROM (SELECT *, c_custkey % 13 * 1.0::DOUBLE AS s, c_nationkey / 24.0 AS near FROM customer)""")
def traffic_factors(spark, sf_dir):
    s, near = F.col("c_custkey") % 13 * 1.0, F.col("c_nationkey") / 24
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.round(C.attracted(s, near, 0.5, 0.7, 10.0), 6).alias("attracted"), F.round(C.repelled(s, near, 2.0, 2.5, 10.0), 6).alias("repelled"))


@query("""WITH t AS (SELECT *, max(l_quantity) OVER () AS top FROM lineitem) SELECT l_orderkey, l_linenumber, l_partkey, CASE l_shipmode WHEN 'AIR' THEN 0.9 WHEN 'RAIL' THEN 0.6 WHEN 'SHIP' THEN 0.45 ELSE 0.5 END AS radio,
round(least(1, greatest(0.2, ln(1 + l_quantity) / ln(1 + top))), 6) AS samples, round(least(1, greatest(0.05, (120 - l_quantity * 4) / 60)), 6) AS signal FROM (SELECT *, CAST(CASE l_returnflag WHEN 'A' THEN 'AIR' WHEN 'N' THEN 'RAIL' ELSE 'SHIP' END AS VARCHAR) AS l_shipmode FROM t)""")
def radio_weights(spark, sf_dir):
    r = _routes(spark, sf_dir)
    r = r.crossJoin(F.broadcast(r.agg(F.max("l_quantity").alias("top"))))  # one row
    kind = F.when(F.col("l_returnflag") == "A", "lte").when(F.col("l_returnflag") == "N", "UMTS").otherwise("GSM")
    return r.select("l_orderkey", "l_linenumber", "l_partkey", C.radio_weight(kind).alias("radio"), F.round(C.sample_weight(F.col("l_quantity"), F.col("top")), 6).alias("samples"), F.round(C.signal_weight(-F.col("l_quantity") * 4), 6).alias("signal"))


@query("""SELECT event_id, round((0.5 * least(1, greatest(0, value / 15)) + 0.2 * (1 - least(1, greatest(0, value * 300 / 10000)))) / 0.7, 6) AS risk FROM events""")
def weather_risk(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", F.col("value").alias("wind_speed_mps"), (F.col("value") * 300).alias("visibility_m"))
    return C.weather_risk(e, "risk").select("event_id", _r("risk"))


# --- routes and the master network

@query("""WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 4 = 0 THEN -1 ELSE l_suppkey % 4 END AS cluster FROM lineitem), n AS (SELECT l_orderkey, count(*) AS n_nodes FROM r GROUP BY 1),
c AS (SELECT l_orderkey, cluster, floor(quantile_cont(l_linenumber, 0.5)) AS m, count(*) AS k FROM r WHERE cluster >= 0 GROUP BY 1, 2)
SELECT l_orderkey, n_nodes, CAST(count(cluster) AS INT) AS n_clusters, coalesce(string_agg(CAST(cluster AS VARCHAR), ';' ORDER BY m, cluster), '') AS cluster_sequence, coalesce(string_agg(cluster || ':' || printf('%.3f', k / n_nodes), ';' ORDER BY m, cluster), '') AS coverage_sequence FROM n LEFT JOIN c USING (l_orderkey) GROUP BY 1, 2""")
def route_clusters(spark, sf_dir):
    k = F.col("l_suppkey") % 4
    return routes.cluster_sequence(_routes(spark, sf_dir).withColumn("cluster", F.when(k == 0, -1).otherwise(k)), "l_orderkey", "l_linenumber", "cluster")


@query(f"""WITH o AS (SELECT *, l_suppkey % 3 * 1.0::DOUBLE AS x, l_linenumber * 1.0::DOUBLE AS y FROM lineitem), a AS (SELECT *, row_number() OVER w AS k, degrees(atan2(y - lag(y) OVER w, x - lag(x) OVER w)) AS a, degrees(atan2(lead(y) OVER w - y, lead(x) OVER w - x)) AS b,
coalesce((x = lag(x) OVER w AND y = lag(y) OVER w), false) OR coalesce((x = lead(x) OVER w AND y = lead(y) OVER w), false) AS still FROM o WINDOW w AS (PARTITION BY l_orderkey ORDER BY {SQL_ORDER})),
t AS (SELECT *, abs(b - a) % 360 AS raw FROM a), u AS (SELECT *, CASE WHEN raw > 180 THEN 360 - raw ELSE raw END AS turn FROM t)
SELECT l_orderkey, count(*) AS kept, CAST(sum(l_linenumber) AS BIGINT) AS places FROM u WHERE turn IS NULL OR still OR turn > 1 GROUP BY 1""")
def simplified_routes(spark, sf_dir):
    s = routes.simplified(_routes(spark, sf_dir), "l_orderkey", ROUTE_ORDER, F.col("l_suppkey") % 3 * 1.0, F.col("l_linenumber") * 1.0)
    return s.groupBy("l_orderkey").agg(F.count("*").alias("kept"), F.sum("l_linenumber").alias("places"))


_OUTER = f"""{_SCORED}, g AS (SELECT avg(x) AS cx, avg(y) AS cy FROM c), d AS (SELECT id, least(x, y, 960 - x, 820 - y) AS away, sqrt(pow(x-cx,2)+pow(y-cy,2)) AS r, seg IN ('BUILDING', 'MACHINERY') AS ok FROM c, g),
z AS (SELECT id, away, r / max(r) OVER () AS radial, ok AND away <= 30 AS is_outer FROM d)"""


def _outer(spark, sf):
    n = _scored(spark, sf).withColumnRenamed("seg", "role")
    return network.outer_zone(n, geometry.box(0.0, 0.0, 960.0, 820.0), ["BUILDING", "MACHINERY"], 30.0)


@query(f"WITH {_OUTER} SELECT id, round(away, 6) AS boundary_m, round(radial, 6) AS radial, is_outer FROM z")
def outer_nodes(spark, sf_dir):
    return _outer(spark, sf_dir).select("id", _r("boundary_m"), _r("radial"), "is_outer")


_NET = """e AS (SELECT DISTINCT least(o_custkey, k) AS u, greatest(o_custkey, k) AS v FROM (SELECT o_custkey, o_custkey * 5 % 149 + 1 AS k FROM orders) WHERE o_custkey <> k)"""


def _net(spark, sf):
    a, b = F.col("o_custkey").cast("long"), (F.col("o_custkey") * 5 % 149 + 1).cast("long")
    return table(spark, sf, "orders").where(a != b).select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v")).distinct()


@query(f"""WITH {_OUTER}, {_NET} SELECT e.u, e.v, coalesce(a.is_outer, false) AS u_outer, coalesce(b.is_outer, false) AS v_outer, coalesce(a.is_outer, false) OR coalesce(b.is_outer, false) AS is_outer_edge FROM e LEFT JOIN z a ON a.id = e.u LEFT JOIN z b ON b.id = e.v""")
def outer_edges(spark, sf_dir):
    return network.outer_edges(_net(spark, sf_dir), _outer(spark, sf_dir)).select("u", "v", "u_outer", "v_outer", "is_outer_edge")


@query(f"""WITH {_NET}, w AS (SELECT u, v, (u * 37 + v * 11) % 997 + 5.0::DOUBLE AS d, (u + v) % 23 * 1.0::DOUBLE AS n, (u * 3 + v) % 900 * 1.0::DOUBLE AS c, (v % 10) / 10.0 AS s, u % 3 = 0 AS tn, v % 7 = 0 AS flz, u % 11 = 0 AS outer_ FROM e),
p AS (SELECT greatest(1, quantile_cont(d, 0.95)) AS pd, greatest(1, quantile_cont(n, 0.95)) AS pn FROM w),
k AS (SELECT u, v, d / pd - 0.5 * n / pn + 1 - least(1, greatest(0, c / 600)) - 0.3 * s - 0.5 * tn::INT + 0.7 * flz::INT + 0.25 * outer_::INT AS raw FROM w, p) SELECT u, v, round(raw - min(raw) OVER () + 0.05, 6) AS edge_cost FROM k""")
def master_edge_costs(spark, sf_dir):
    u, v = F.col("u"), F.col("v")
    e = _net(spark, sf_dir).withColumns({"distance_m": (u * 37 + v * 11) % 997 + 5.0, "density": (u + v) % 23 * 1.0, "clearance_m": (u * 3 + v) % 900 * 1.0, "support": v % 10 / 10, "is_tn": u % 3 == 0, "is_flz": v % 7 == 0, "is_outer_edge": u % 11 == 0})
    w = {"distance": 1.0, "density": 0.5, "clearance": 1.0, "support": 0.3, "tn": 0.5, "flz": 0.7, "outer": 0.25}
    return network.edge_costs(e, w).select("u", "v", _r("edge_cost"))


@query(f"""WITH {_NET}, n AS (SELECT DISTINCT s_suppkey AS node FROM supplier WHERE s_nationkey < 5) SELECT u, v FROM e WHERE u IN (SELECT node FROM n) OR v IN (SELECT node FROM n) OR (u + v) % 9 = 0""")
def avoided_edges(spark, sf_dir):
    e = _net(spark, sf_dir)
    return network.avoided(e, table(spark, sf_dir, "supplier").where("s_nationkey < 5").select(F.col("s_suppkey").cast("long").alias("node")), e.where((F.col("u") + F.col("v")) % 9 == 0))


@query()
def kmeans_candidates(spark, sf_dir):
    """Customers in eight weighted clusters, and of each cluster its representative."""
    d = _scored(spark, sf_dir)
    c = network.weighted_clusters(graph.cut(d), 8)
    return selection.representatives(d.join(c, "id"), "cluster").select("cluster", "id", "hits", F.round("center_m", 4).alias("center_m"))


# --- solvers

@query()
def replanned_routes(spark, sf_dir):
    """Walks of agents that find two nations blocked after two steps."""
    pairs, e, at = _city(spark, sf_dir)
    return graph.solve_on_plane(pairs, e, at, lambda g, a, b: search.replanned(g, a, b, [(2, frozenset({7, 18}) - {a, b})]))


@query()
def turning_routes(spark, sf_dir):
    """Paths on which every change of direction costs two."""
    pairs, e, at = _city(spark, sf_dir)
    return graph.solve_on_plane(pairs, e, at, lambda g, a, b: search.turning(g, a, b, 2.0))


@query()
def alternative_routes(spark, sf_dir):
    """Up to three paths a pair, cheapest first, turns counted."""
    pairs, e, at = _city(spark, sf_dir)
    return graph.solve_many(pairs, e, at, lambda g, a, b: [(f"rank_{i + 1:02d}", p, c) for i, (p, c) in enumerate(search.alternatives(g, a, b, 3, 2.0))])


@query()
def ranked_routes(spark, sf_dir):
    """Up to three paths a pair, the edges of earlier ones made dearer."""
    pairs, e, at = _city(spark, sf_dir)
    return graph.solve_many(pairs, e, at, lambda g, a, b: [(f"rank_{i + 1:02d}", p, c) for i, (p, c) in enumerate(search.ranked(g, a, b, 3))])


@query()
def lane_library(spark, sf_dir):
    """Forward and backward lanes of each pair, main and backup, inner nodes locked for later lanes."""
    pairs, e, at = _city(spark, sf_dir)
    both = e.select("src", "dst", "cost").union(e.select("dst", "src", "cost")).groupBy("src", "dst").agg(F.min("cost").alias("cost"))
    return graph.solve_many(pairs.where("start < goal"), both, at, lambda g, a, b: search.lanes(g, a, b))


def _swarm_lane(g, a, b):
    """The smooth line between two nations through a field that is slow about the middle."""
    import numpy as np

    line, value = search.smooth_route(lambda x, y: 1 + 4 * np.exp(-((x - 20) ** 2 + (y - 20) ** 2) / 50), g.at[a], g.at[b], middles=3, particles=15, rounds=25)
    return [("swarm", [int(round(v * 1000)) for v in line.ravel()], value)]


@query()
def swarm_lines(spark, sf_dir):
    """Continuous lines optimised by a particle swarm; x and y of their points in thousandths, in turn."""
    pairs, e, at = _city(spark, sf_dir)
    return graph.solve_many(pairs.where("start < goal"), e, at, _swarm_lane)


@query()
def marched_fields(spark, sf_dir):
    """Arrival times of a front over each region's grid of nations and months, by fast marching from its first cell."""
    import pandas as pd

    d = _grid(spark, sf_dir).join(table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("ix"), F.col("n_regionkey").cast("long").alias("region")), "ix")

    def field(pdf: pd.DataFrame) -> pd.DataFrame:
        m = pdf.pivot_table(index="iy", columns="ix", values="v", aggfunc="first")  # at most 12 months by the nations of a region
        t = search.marched((m / 1e6 + 0.1).to_numpy(), (0, 0))
        rows = [(int(pdf["region"].iloc[0]), int(x), int(y), float(t[i, j])) for i, y in enumerate(m.index) for j, x in enumerate(m.columns)]
        return pd.DataFrame([r for r in rows if r[3] != float("inf")], columns=["region", "ix", "iy", "arrival"]).round(6)

    return d.groupBy("region").applyInPandas(field, "region long, ix long, iy long, arrival double")


@query("SELECT p.vec_id AS id, CAST(embedding[1] AS DOUBLE) * 1000 > 0 AS inside FROM embeddings p WHERE abs(CAST(embedding[1] AS DOUBLE) * 1000) <= 60 AND abs(CAST(embedding[2] AS DOUBLE) * 1000) <= 60")
def boxed_points(spark, sf_dir):
    """Points of a box, and on which side of its middle they lie."""
    return points(spark, sf_dir).where(F.col("x").between(-60, 60) & F.col("y").between(-60, 60)).select("id", (F.col("x") > 0).alias("inside"))
