"""Registered queries on node models, facilities, reports and object classes, with their SQL."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions import classes as K
from ..functions import columns as C
from ..operators import geometry, model, spatial
from ..sources import tables
from .registry import _nodes, _NODES, query
from .tables import ROUTE_ORDER, SQL_ORDER, points, table, POINTS


def _r(name: str, digits: int = 6):
    return F.round(name, digits).alias(name)


# --- joins

@query("""WITH h AS (SELECT l_suppkey AS node, count(DISTINCT l_orderkey) AS hit_count, string_agg(DISTINCT l_returnflag, ';' ORDER BY l_returnflag) AS directions FROM lineitem WHERE l_quantity > 45 GROUP BY 1)
SELECT s_suppkey AS node, coalesce(hit_count, 0) AS hit_count, coalesce(directions, '') AS directions, s_nationkey >= 10 AS is_nofly,
  CASE WHEN s_nationkey >= 10 THEN 0 ELSE coalesce(hit_count, 0)::DOUBLE END AS density_hit_count FROM supplier LEFT JOIN h ON node = s_suppkey""")
def density_map(spark, sf):
    hits = table(spark, sf, "lineitem").where("l_quantity > 45").groupBy(F.col("l_suppkey").alias("node")).agg(
        F.countDistinct("l_orderkey").alias("hit_count"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ";").alias("directions"))
    nodes = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"), F.col("s_nationkey").cast("double").alias("slowness"))
    return model.density_map(nodes, hits, "node", ["hit_count"], ["directions"]).drop("slowness")


@query("""SELECT c_custkey, c_custkey % 31 AS ix, c_nationkey % 7 AS iy, dense_rank() OVER (ORDER BY c_custkey % 31, c_nationkey % 7) - 1 AS xy_id FROM customer""")
def cell_numbers(spark, sf):
    c = table(spark, sf, "customer").select("c_custkey", (F.col("c_custkey") % 31).alias("ix"), (F.col("c_nationkey") % 7).alias("iy"))
    return model.with_xy_id(c)


@query("""WITH a AS (SELECT c_custkey, c_custkey % 40 * 0.1 AS x, c_nationkey * 0.1 AS y FROM customer), b AS (SELECT s_suppkey % 40 AS kx, s_nationkey AS ky, count(*) AS n FROM supplier GROUP BY 1, 2)
SELECT c_custkey, round(x::DOUBLE, 4) AS x, round(y::DOUBLE, 4) AS y, n FROM a LEFT JOIN b ON kx = round(x * 10) AND ky = round(y * 10)""")
def joined_places(spark, sf):
    at = lambda d, k, n, *more: d.select(*more, (F.col(k) % 40 * 0.1).alias("x"), (F.col(n) * 0.1).alias("y"))
    b = table(spark, sf, "supplier").groupBy((F.col("s_suppkey") % 40).alias("k"), "s_nationkey").agg(F.count("*").alias("n"))
    return model.join_xy(at(table(spark, sf, "customer"), "c_custkey", "c_nationkey", "c_custkey"), at(b, "k", "s_nationkey", "n")).select("c_custkey", _r("x", 4), _r("y", 4), "n")


@query("""SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 10.0 WHEN 'O' THEN 0.5 ELSE 1.0 END AS weight FROM orders""")
def looked_up(spark, sf):
    return table(spark, sf, "orders").select("o_orderkey", model.lookup(F.col("o_orderstatus"), {"F": 10.0, "O": 0.5}, 1.0).alias("weight"))


@query(f"""WITH {_NODES} SELECT DISTINCT n.id FROM n, s WHERE s.nation = 3 AND sqrt(pow(n.x-s.x, 2) + pow(n.y-s.y, 2)) <= 30""")
def near_path_nodes(spark, sf):
    n, s = _nodes(spark, sf)
    return model.near_path(n, s.where("nation = 3"), 30.0)


@query(f"""WITH {_NODES}, g AS (SELECT a.site AS seg, a.x AS x1, a.y AS y1, b.x AS x2, b.y AS y2 FROM s a JOIN s b ON b.site = a.site + 1),
l AS (SELECT *, sqrt(pow(x2-x1, 2) + pow(y2-y1, 2)) AS len FROM g), i AS (SELECT *, unnest(range(0, CAST(ceil(len / 100) AS INT) + 1)) AS k FROM l),
p AS (SELECT seg, x1 + t * (x2-x1) AS x, y1 + t * (y2-y1) AS y FROM (SELECT *, CASE WHEN len > 0 THEN least(1, k * 100.0 / len) ELSE 0 END AS t FROM i))
SELECT p.seg, round(min(sqrt(pow(p.x-n.x, 2) + pow(p.y-n.y, 2))), 6) AS clearance FROM p, n WHERE n.id % 5 = 0 GROUP BY p.seg""")
def segment_clearance(spark, sf):
    n, s = _nodes(spark, sf)
    g = s.select(F.col("site").alias("seg"), F.col("x").alias("x1"), F.col("y").alias("y1")).join(s.select((F.col("site") - 1).alias("seg"), F.col("x").alias("x2"), F.col("y").alias("y2")), "seg")
    return model.clearances(g, n.where("id % 5 = 0"), 100.0).select("seg", _r("clearance"))


@query(f"""WITH {_NODES} SELECT DISTINCT n.id FROM n, s WHERE s.site % 4 = 0 AND sqrt(pow(greatest(abs(n.x - s.x) - 20, 0), 2) + pow(greatest(abs(n.y - s.y) - 12, 0), 2)) <= 15""")
def buffered_shapes(spark, sf):
    n, s = _nodes(spark, sf)
    corner = lambda i, j: F.struct((F.col("x") + i * 20.0).alias("x"), (F.col("y") + j * 12.0).alias("y"))
    return model.in_buffer(n, s.where("site % 4 = 0").select(F.array(corner(-1, -1), corner(1, -1), corner(1, 1), corner(-1, 1)).alias("ring")), 15.0)


@query(f"""WITH {_NODES}, f AS (SELECT site AS id, nation % 4 AS prefix, x, y FROM s) SELECT least(a.id, b.id) AS origin, greatest(a.id, b.id) AS goal, round(min(sqrt(pow(a.x-b.x, 2) + pow(a.y-b.y, 2))), 6) AS dist
FROM f a, f b WHERE a.id <> b.id AND a.prefix <> b.prefix AND sqrt(pow(a.x-b.x, 2) + pow(a.y-b.y, 2)) <= 120 GROUP BY 1, 2""")
def facility_pairs(spark, sf):
    f = _nodes(spark, sf)[1].select(F.col("site").alias("id"), (F.col("nation") % 4).alias("prefix"), "x", "y")
    return model.od_pairs(f, f, 120.0, ordered=False, skip_same_prefix=True).select("origin", "goal", _r("dist"))


_ACCESS = f"""{_NODES}, d AS (SELECT s.site, s.nation % 2 = 0 AS even, n.bal > 0 AS fly, sqrt(pow(n.x-s.x, 2) + pow(n.y-s.y, 2)) AS dist FROM s, n),
a AS (SELECT site, even, count(*) FILTER (dist <= 25) AS nearby, count(*) FILTER (dist <= 25 AND fly) AS nearby_flyable, min(dist) FILTER (fly) AS nearest_flyable FROM d GROUP BY 1, 2)"""


def _access(spark, sf):
    n, s = _nodes(spark, sf)
    return model.access(s, n, 25.0, F.col("bal") > 0, least=2).withColumn("kind", F.when(F.col("nation") % 2 == 0, "DB").otherwise("DK"))


@query(f"""WITH {_ACCESS} SELECT site, nearby, nearby_flyable, round(nearest_flyable, 6) AS nearest_flyable, nearby_flyable >= 2 AS accessible, CASE WHEN nearby_flyable >= 2 THEN '' ELSE 'no_fly_covered' END AS reason FROM a""")
def facility_access(spark, sf):
    return _access(spark, sf).select("site", "nearby", "nearby_flyable", _r("nearest_flyable"), "accessible", "reason")


@query(f"""WITH {_ACCESS} SELECT CASE WHEN even THEN 'DB' ELSE 'DK' END AS kind, count(*) AS n, count(*) FILTER (nearby_flyable >= 2) AS n_accessible, count(*) FILTER (nearby_flyable < 2) AS n_blocked,
round(100.0 * count(*) FILTER (nearby_flyable < 2) / count(*), 6) AS blocked_percent, round(min(nearest_flyable), 6) AS nearest_min, round(avg(nearest_flyable), 6) AS nearest_mean, round(max(nearest_flyable), 6) AS nearest_max,
CASE WHEN count(*) FILTER (nearby_flyable < 2) > 0 THEN 'no_fly_covered' ELSE '' END AS notes FROM a GROUP BY 1""")
def possible_paths(spark, sf):
    got = model.path_statistics(_access(spark, sf))
    return got.select("kind", "n", "n_accessible", "n_blocked", *[_r(c) for c in ("blocked_percent", "nearest_min", "nearest_mean", "nearest_max")], "notes")


# --- filters

@query("""SELECT c_custkey FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY') AND c_nationkey <> 7 AND c_acctbal >= 0""")
def kept_nodes(spark, sf):
    c = table(spark, sf, "customer").withColumns({"label_prefix": F.col("c_mktsegment"), "label": F.col("c_nationkey"), "ra": F.col("c_acctbal") < 0})
    return model.excluded(c, ["building", "machinery"], [7], "ra").select("c_custkey")


@query(f"""WITH {POINTS} SELECT id FROM points WHERE x BETWEEN -180 AND 180 AND y BETWEEN -90 AND 90 AND x <> 0 AND y <> 0 AND coalesce(nullif(label, 3) = 2, true)""")
def valid_places(spark, sf):
    p = points(spark, sf)
    return p.where(K.valid_place(F.col("x"), F.col("y"), F.nullif("label", F.lit(3)), 2)).select("id")


_ISOLATED = f"""{POINTS}, p AS (SELECT *, id % 3 <> 0 AS live, id % 4 = 1 AS special FROM points),
r AS (SELECT a.id, count(*) FILTER (b.live) AS n FROM p a LEFT JOIN p b ON a.id <> b.id AND sqrt(pow(a.x-b.x, 2) + pow(a.y-b.y, 2)) <= 6 GROUP BY 1)"""


@query(f"WITH {_ISOLATED} SELECT p.id, live AND (n > 0 OR NOT special) AS active FROM p JOIN r USING (id)")
def special_access(spark, sf):
    p = points(spark, sf)
    return model.isolated(p, spatial.within_pairs(p, 6.0), F.col("id") % 3 != 0, F.col("id") % 4 == 1).select("id", "active")


# --- aggregations

@query(f"""WITH {POINTS}, m AS (SELECT min(x) AS x0, min(y) AS y0 FROM points) SELECT id, CAST(floor((x - x0) / 25) AS BIGINT) AS area_ix, CAST(floor((y - y0) / 25) AS BIGINT) AS area_iy,
CAST(floor((x - x0) / 25) AS BIGINT) || '_' || CAST(floor((y - y0) / 25) AS BIGINT) AS area_id FROM points, m""")
def area_squares(spark, sf):
    return model.area_cells(points(spark, sf), 25.0).select("id", "area_ix", "area_iy", "area_id")


@query("""WITH r AS (SELECT p_size % 12 AS layer, CASE p_partkey % 3 WHEN 0 THEN 'Point' WHEN 1 THEN 'MultiLineString' ELSE 'Polygon' END AS g, p_brand AS source FROM part WHERE p_size % 12 < 9),
l AS (SELECT unnest(range(0, 12)) AS layer) SELECT CAST(l.layer AS BIGINT) AS layer, count(g) AS n_features, count(*) FILTER (g = 'Point') AS n_points, count(*) FILTER (g = 'MultiLineString') AS n_lines,
count(*) FILTER (g = 'Polygon') AS n_polygons, coalesce(string_agg(DISTINCT source, ';' ORDER BY source), '') AS sources, CASE WHEN count(g) > 0 THEN 'available' ELSE 'empty' END AS status FROM l LEFT JOIN r USING (layer) GROUP BY 1""")
def layer_availability(spark, sf):
    kind = F.when(F.col("p_partkey") % 3 == 0, "Point").when(F.col("p_partkey") % 3 == 1, "MultiLineString").otherwise("Polygon")
    rows = table(spark, sf, "part").select((F.col("p_size") % 12).cast("long").alias("layer"), kind.alias("geom_type"), F.col("p_brand").alias("source")).where("layer < 9")
    return model.availability(spark.range(12).toDF("layer"), rows)


_BUILT = "b AS (SELECT p_partkey AS building, p_brand AS source, CASE WHEN p_size % 5 = 0 THEN NULL WHEN p_size % 7 = 0 THEN 0 ELSE p_size END::DOUBLE AS height, p_retailprice AS area FROM part)"


def _built(spark, sf):
    h = F.when(F.col("p_size") % 5 == 0, None).when(F.col("p_size") % 7 == 0, 0).otherwise(F.col("p_size")).cast("double")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("building"), F.col("p_brand").alias("source"), h.alias("height"), F.col("p_retailprice").alias("area"))


@query(f"""WITH {_BUILT} SELECT source, count(*) AS n, count(*) FILTER (height > 0) AS n_valid, count(*) - count(*) FILTER (height > 0) AS n_missing, min(height) FILTER (height > 0) AS least, round(avg(height) FILTER (height > 0), 6) AS mean,
quantile_cont(height, 0.5) FILTER (height > 0) AS median, max(height) FILTER (height > 0) AS greatest, round(sum(area), 3) AS area, round(coalesce(sum(height * area) FILTER (height > 0), 0), 3) AS volume FROM b GROUP BY 1""")
def height_report(spark, sf):
    return model.height_report(_built(spark, sf), "source").withColumns({"mean": F.round("mean", 6), "area": F.round("area", 3), "volume": F.round("volume", 3)})


@query(f"""WITH {_BUILT} SELECT building % 50 AS xy_id, max(height) AS height_max, round(sum(height * area), 3) AS volume_sum, count(DISTINCT building % 400) AS n_buildings FROM b GROUP BY 1""")
def cell_buildings(spark, sf):
    b = _built(spark, sf).select((F.col("building") % 50).alias("xy_id"), (F.col("building") % 400).alias("building"), "height", (F.col("height") * F.col("area")).alias("volume"))
    return model.cell_buildings(b).withColumn("volume_sum", F.round("volume_sum", 3))


@query("""SELECT count(*) AS n, count(*) FILTER (c_nationkey = 0) AS n_hard, min(c_acctbal) FILTER (c_nationkey <> 0) AS c_acctbal_min, round(avg(c_acctbal) FILTER (c_nationkey <> 0), 6) AS c_acctbal_mean,
max(c_acctbal) FILTER (c_nationkey <> 0) AS c_acctbal_max FROM customer""")
def cost_summary(spark, sf):
    return model.cost_summary(table(spark, sf, "customer"), ["c_acctbal"], F.col("c_nationkey") == 0).withColumn("c_acctbal_mean", F.round("c_acctbal_mean", 6))


_BURN = "v AS (SELECT l_quantity > 40 AS building, l_discount > 0.08 AS terrain, l_tax > 0.07 AS powerline, l_partkey % 60 AS xy_id, l_quantity AS z, l_suppkey % 9 AS ground FROM lineitem)"


def _voxels(spark, sf):
    return table(spark, sf, "lineitem").select((F.col("l_quantity") > 40).alias("building"), (F.col("l_discount") > 0.08).alias("terrain"), (F.col("l_tax") > 0.07).alias("powerline"), (F.col("l_partkey") % 60).alias("xy_id"),
                                               F.col("l_quantity").cast("double").alias("z"), (F.col("l_suppkey") % 9).cast("double").alias("ground"))


_FLAGS = ("building", "terrain", "powerline")


@query(f"""WITH {_BURN}, c AS (SELECT *, CASE WHEN terrain THEN 'terrain' WHEN building THEN 'building' ELSE 'air' END AS label FROM v)
SELECT 'total' AS counter, count(*) AS n FROM c UNION ALL SELECT 'burn_building', count(*) FROM c WHERE building UNION ALL SELECT 'burn_terrain', count(*) FROM c WHERE terrain UNION ALL SELECT 'burn_powerline', count(*) FROM c WHERE powerline
UNION ALL SELECT 'burned', count(*) FROM c WHERE building OR terrain OR powerline UNION ALL SELECT 'flyable', count(*) FROM c WHERE NOT (building OR terrain OR powerline) UNION ALL SELECT 'label_' || label, count(*) FROM c GROUP BY 1""")
def burn_counts(spark, sf):
    label = F.when(F.col("terrain"), "terrain").when(F.col("building"), "building").otherwise("air")
    return model.burn_counts(_voxels(spark, sf), {n: F.col(n) for n in _FLAGS}, label)


@query(f"""WITH {_BURN}, k AS (SELECT unnest(['building', 'terrain', 'powerline']) AS class), s AS (SELECT *, CASE WHEN building THEN 'building' WHEN terrain THEN 'terrain' WHEN powerline THEN 'powerline' END AS shown FROM v),
b AS (SELECT class, count(*) FILTER (CASE class WHEN 'building' THEN building WHEN 'terrain' THEN terrain ELSE powerline END) AS before, count(*) FILTER (shown = class) AS after FROM s, k GROUP BY 1)
SELECT class, before, after, before - after AS removed FROM b""")
def display_classes(spark, sf):
    return model.display_classes(_voxels(spark, sf), {n: F.col(n) for n in _FLAGS})


@query(f"""WITH {_BURN}, l AS (SELECT 'building' AS layer, * FROM v WHERE building UNION ALL SELECT 'powerline', * FROM v WHERE powerline)
SELECT layer, count(*) AS n, count(DISTINCT xy_id) AS n_columns, min(z)::DOUBLE AS msl_min, quantile_cont(z::DOUBLE, 0.5) AS msl_p50, max(z)::DOUBLE AS msl_max, min(z - ground)::DOUBLE AS agl_min, quantile_cont((z - ground)::DOUBLE, 0.5) AS agl_p50,
max(z - ground)::DOUBLE AS agl_max FROM l GROUP BY 1""")
def layer_extents(spark, sf):
    return model.layer_extents(_voxels(spark, sf), {n: F.col(n) for n in ("building", "powerline")})


@query(f"""WITH {POINTS}, d AS (SELECT a.id, min(sqrt(pow(a.x-b.x, 2) + pow(a.y-b.y, 2))) AS d FROM points a, points b WHERE a.id <> b.id GROUP BY 1)
SELECT round(quantile_cont(d, 0.5), 6) AS spacing, count(*) AS n FROM d WHERE d <= 40""")
def neighbour_spacing(spark, sf):
    return model.neighbour_spacing(points(spark, sf), 40.0).select(_r("spacing"), "n")


@query("""WITH q AS (SELECT unnest(quantile_cont(l_extendedprice, [0, 0.25, 0.5, 0.75, 1])) AS v FROM lineitem) SELECT array_to_string(list(DISTINCT CAST(round(v, 1) AS DECIMAL(12, 1)) ORDER BY CAST(round(v, 1) AS DECIMAL(12, 1))), ';') AS bounds FROM q""")
def colour_bounds(spark, sf):
    b = model.colour_bounds(table(spark, sf, "lineitem"), "l_extendedprice", 4, 1)
    return b.select(F.array_join(F.transform("bounds", lambda v: v.cast("decimal(12,1)").cast("string")), ";").alias("bounds"))


# --- ordered rows

@query(f"""WITH o AS (SELECT l_orderkey, row_number() OVER w AS k, l_partkey % 100 AS x1, l_suppkey % 10 AS y1, lead(l_partkey % 100) OVER w AS x2, lead(l_suppkey % 10) OVER w AS y2 FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {SQL_ORDER})),
e AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY k) AS p FROM o WHERE x2 IS NOT NULL)
SELECT l_orderkey, 0 AS place, x1 AS x, y1 AS y FROM e WHERE p = 1 UNION ALL SELECT l_orderkey, p, x2, y2 FROM e""")
def route_points(spark, sf):
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy(*ROUTE_ORDER)
    e = table(spark, sf, "lineitem").select("l_orderkey", F.row_number().over(w).alias("k"), (F.col("l_partkey") % 100).alias("x1"), (F.col("l_suppkey") % 10).alias("y1"), F.lead(F.col("l_partkey") % 100).over(w).alias("x2"), F.lead(F.col("l_suppkey") % 10).over(w).alias("y2"))
    return model.route_points(e.where("x2 IS NOT NULL"), "l_orderkey", "k")


@query("""SELECT o_orderkey AS path, least(o_custkey % 20, o_orderkey % 20) || '_to_' || greatest(o_custkey % 20, o_orderkey % 20) AS pair,
row_number() OVER (PARTITION BY least(o_custkey % 20, o_orderkey % 20), greatest(o_custkey % 20, o_orderkey % 20) ORDER BY o_totalprice, o_orderkey) AS rank FROM orders""")
def ranked_pairs(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderkey").alias("path"), (F.col("o_custkey") % 20).alias("a"), (F.col("o_orderkey") % 20).alias("b"), F.col("o_totalprice").alias("cost"))
    return model.ranked_pairs(o).select("path", "pair", "rank")


@query("""SELECT l_orderkey, round(avg(s_acctbal) FILTER (s_acctbal > 0), 6) AS bal FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1""")
def path_means(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("node"), F.when(F.col("s_acctbal") > 0, F.col("s_acctbal").cast("double")).otherwise(float("nan")).alias("bal"))
    return model.means_along(table(spark, sf, "lineitem").withColumnRenamed("l_suppkey", "node"), s, ["bal"], "l_orderkey", "node").select("l_orderkey", _r("bal"))


@query(f"""WITH {_NODES}, d AS (SELECT n.id, n.seg AS route, min(sqrt(pow(n.x-s.x, 2) + pow(n.y-s.y, 2))) AS d FROM n, s WHERE s.nation < 6 GROUP BY 1, 2)
SELECT route, round(avg(d), 6) AS mean_m, round(max(d), 6) AS max_m FROM d GROUP BY 1""")
def route_closeness(spark, sf):
    n, s = _nodes(spark, sf)
    return model.closeness(n.withColumnRenamed("seg", "route"), s.where("nation < 6"), 50.0).select("route", _r("mean_m"), _r("max_m"))


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 2 = 0 THEN value END AS dep, CASE WHEN event_id % 3 = 0 THEN value + 9 END AS arr, CASE WHEN event_id % 5 <> 0 THEN user_id % 7 END::DOUBLE AS late FROM events),
s AS (SELECT *, coalesce(dep, 5 + coalesce(late, 0)) AS leaves FROM e) SELECT event_id, round(leaves, 6) AS departure, round(coalesce(arr, leaves + 60), 6) AS arrival, coalesce(late, 0) AS delay FROM s""")
def flight_schedule(spark, sf):
    e, v = table(spark, sf, "events"), F.col("value").cast("double")
    s = K.schedule(F.when(F.col("event_id") % 2 == 0, v), F.when(F.col("event_id") % 3 == 0, v + 9), F.lit(60.0), F.when(F.col("event_id") % 5 != 0, (F.col("user_id") % 7).cast("double")), F.lit(5.0))
    return e.select("event_id", s.alias("s")).select("event_id", F.round("s.departure", 6).alias("departure"), F.round("s.arrival", 6).alias("arrival"), "s.delay")


# --- choosing and layers

@query("""SELECT 'c' AS kind, c_custkey AS key, c_acctbal AS bal, NULL AS size FROM customer UNION ALL SELECT 'p', p_partkey, NULL, p_size FROM part UNION ALL SELECT 's', s_suppkey, s_acctbal, NULL FROM supplier""")
def united_tables(spark, sf):
    part = lambda t, k, **more: table(spark, sf, t).select(F.lit(t[0]).alias("kind"), F.col(k).alias("key"), *[F.col(c).alias(n) for n, c in more.items()])
    return model.union_all(part("customer", "c_custkey", bal="c_acctbal"), part("part", "p_partkey", size="p_size"), part("supplier", "s_suppkey", bal="s_acctbal"))


_READ = "CASE WHEN l_partkey % 11 = 0 THEN NULL ELSE l_quantity / 3.0::DOUBLE END"


@query(f"""WITH f AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, {_READ} AS wind, l_quantity / 2.5::DOUBLE AS gust, l_discount * 60 AS rain, l_extendedprice / 40.0::DOUBLE AS cape, l_extendedprice / 5.0::DOUBLE AS sight FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(greatest(least(1, greatest(0, (wind - 5) / 10)), least(1, greatest(0, (gust - 8) / 12)), least(1, greatest(0, (rain - 0.1) / 4.9)), least(1, greatest(0, (cape - 500) / 2000)), least(1, greatest(0, (10000 - sight) / 9000))), 6) AS risk,
coalesce(wind >= 15, false) OR gust >= 20 OR rain >= 5 OR cape >= 2500 OR sight <= 1000 AS no_fly FROM f""")
def forecast_index(spark, sf):
    read = {"wind_speed_120m": F.when(F.col("l_partkey") % 11 != 0, F.col("l_quantity") / 3.0), "wind_gusts_10m": F.col("l_quantity") / 2.5, "precipitation": F.col("l_discount").cast("double") * 60, "cape": F.col("l_extendedprice") / 40.0, "visibility": F.col("l_extendedprice") / 5.0}
    risk, no_fly = K.forecast_index({k: v.cast("double") for k, v in read.items()})
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", C.rounded(risk, 6).alias("risk"), no_fly.alias("no_fly"))


@query(f"""WITH {_NODES}, c AS (SELECT x, y, 10.0 + nation AS radius FROM s WHERE site % 6 = 0), d AS (SELECT n.id, sqrt(pow(n.x-c.x, 2) + pow(n.y-c.y, 2)) AS d, radius FROM n, c)
SELECT id, round(max(CASE WHEN d <= radius THEN 1 ELSE exp(-pow((d - radius) / 20, 2)) END), 6) AS risk, bool_or(d <= radius) AS hard FROM d GROUP BY 1""")
def circle_risks(spark, sf):
    n, s = _nodes(spark, sf)
    return model.circle_risk(n, s.where("site % 6 = 0").select("x", "y", (10.0 + F.col("nation")).alias("radius")), 20.0).select("id", _r("risk"), "hard")


@query("""WITH m AS (SELECT c_custkey, CASE WHEN c_nationkey >= 20 THEN 'existing_nofly' WHEN c_mktsegment = 'BUILDING' THEN 'highrise' ELSE 'flyable' END AS mixed_class FROM customer)
SELECT c_custkey, mixed_class, CASE WHEN mixed_class = 'flyable' THEN 1.0 ELSE 10.0 END AS mixed_slowness FROM m""")
def mixed_model(spark, sf):
    c = table(spark, sf, "customer").withColumn("slowness", F.col("c_nationkey").cast("double"))
    return model.mixed_model(c, "slowness", F.col("c_mktsegment") == "BUILDING", threshold=20.0).select("c_custkey", "mixed_class", "mixed_slowness")


@query(f"""WITH {_NODES}, i AS (SELECT *, x BETWEEN 200 AND 600 AND y BETWEEN 100 AND 700 AS hit, id % 13 AS sl FROM n) SELECT id, hit AS in_control, hit AND sl < 10 AS newly_forced, CASE WHEN hit THEN 10 ELSE sl END::DOUBLE AS slowness FROM i""")
def controlled_model(spark, sf):
    n = _nodes(spark, sf)[0].withColumn("slowness", (F.col("id") % 13).cast("double"))
    return model.controlled(n, geometry.box(200.0, 100.0, 600.0, 700.0), "slowness").select("id", "in_control", "newly_forced", "slowness")


@query("""WITH h AS (SELECT l_suppkey AS id, count(*) AS hits FROM lineitem WHERE l_quantity > 48 GROUP BY 1), n AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS k FROM supplier WHERE s_nationkey % 5 IN (1, 2))
SELECT s_suppkey AS id, s_nationkey AS label, coalesce(hits, 0) AS hits FROM n LEFT JOIN h ON id = s_suppkey WHERE k = 1""")
def objectives(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_nationkey").alias("label"), F.element_at(F.array(*map(F.lit, ("XX", "DB", "dk", "RA", "YY"))), (F.col("s_nationkey") % 5 + 1).cast("int")).alias("label_prefix"))
    h = table(spark, sf, "lineitem").where("l_quantity > 48").groupBy(F.col("l_suppkey").alias("id")).agg(F.count("*").alias("hits"))
    return model.objective_table(s, ["DB", "DK"], h).select("id", "label", "hits")


@query("""WITH r AS (SELECT *, c_custkey % 700 AS node_id, CASE c_nationkey WHEN 1 THEN 'DB' WHEN 2 THEN 'DK' WHEN 3 THEN 'FLZ' WHEN 4 THEN CASE WHEN c_acctbal > 0 THEN 'TN_major' END WHEN 5 THEN CASE WHEN c_acctbal > 0 THEN 'TN_minor' END END AS role FROM customer WHERE c_mktsegment <> 'BUILDING'),
k AS (SELECT *, row_number() OVER (PARTITION BY node_id ORDER BY c_custkey) AS k FROM r WHERE role IS NOT NULL)
SELECT node_id, role, CASE WHEN role LIKE 'TN%' THEN 'TN_' || node_id ELSE c_name END AS name, round(c_acctbal::DOUBLE, 4) AS hits FROM k WHERE k = 1""")
def master_nodes(spark, sf):
    nation = F.col("c_nationkey")
    none = F.lit(None).cast("string")
    c = table(spark, sf, "customer").select((F.col("c_custkey") % 700).alias("id"), F.col("c_custkey").alias("row"), F.when(nation == 1, "DB").when(nation == 2, "dk").when(nation == 3, "FLZ").alias("label_prefix"), F.col("c_name").alias("label"),
                                            (F.col("c_acctbal") > 0).alias("flyable"), nation.isin(4, 5).alias("is_candidate"), F.when(nation == 4, " Major ").otherwise("other").alias("candidate_type"), none.alias("candidate_id"), none.alias("objective_label"),
                                            (F.col("c_mktsegment") == "BUILDING").alias("in_ra"), F.col("c_acctbal").alias("hits"), F.lit(0.0).alias("x"), F.lit(0.0).alias("y"))
    return model.master_nodes(c).select("node_id", "role", "name", _r("hits", 4))


@query(f"""WITH p AS (SELECT l_orderkey AS r, row_number() OVER w AS k, l_suppkey AS n, lead(l_suppkey) OVER w AS t FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY {SQL_ORDER})),
e AS (SELECT a.s_suppkey AS u, b.s_suppkey AS v, 1.0 * (b.s_suppkey - a.s_suppkey) AS length, a.s_acctbal AS clearance FROM supplier a JOIN supplier b ON b.s_suppkey > a.s_suppkey AND b.s_nationkey = a.s_nationkey)
SELECT r AS route, string_agg(n::VARCHAR, ';' ORDER BY k) AS node_ids, string_agg(s_name, ';' ORDER BY k) AS node_names, round(sum(length)::DOUBLE, 4) AS length_m, round(min(clearance)::DOUBLE, 4) AS least_clearance, count(length) AS known_edges
FROM p JOIN supplier ON s_suppkey = n LEFT JOIN e ON u = least(n, t) AND v = greatest(n, t) GROUP BY 1""")
def route_summaries(spark, sf):
    from pyspark.sql import Window

    k = F.row_number().over(Window.partitionBy("l_orderkey").orderBy(*ROUTE_ORDER))
    p = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("route"), k.alias("k"), F.col("l_suppkey").alias("node_id"))
    s = table(spark, sf, "supplier")
    a, b = s.select(F.col("s_suppkey").alias("u"), "s_nationkey", F.col("s_acctbal").alias("clearance")), s.select(F.col("s_suppkey").alias("v"), "s_nationkey")
    e = a.join(b, "s_nationkey").where("u < v").select("u", "v", ((F.col("v") - F.col("u")) * 1.0).alias("length"), "clearance")
    return model.route_summary(p, s.select(F.col("s_suppkey").alias("node_id"), F.col("s_name").alias("name")), e, "route", "k").select("route", "node_ids", "node_names", F.round(F.col("length_m").cast("double"), 4).alias("length_m"), F.round(F.col("least_clearance").cast("double"), 4).alias("least_clearance"), "known_edges")


# --- classes

_TAGS = ["motorway", "Primary_Link", "living_street", "track", "road", "steps", "ferry"]


@query("""SELECT p_partkey, CASE p_partkey % 8 WHEN 0 THEN 'expressway_or_trunk' WHEN 1 THEN 'primary' WHEN 2 THEN 'residential' WHEN 3 THEN 'service_or_track' WHEN 4 THEN 'unclassified' WHEN 5 THEN 'non_motorized' WHEN 6 THEN 'ferry' ELSE 'unknown' END AS road,
CASE p_partkey % 5 WHEN 0 THEN 'Drone-Base' WHEN 1 THEN 'Docking' WHEN 2 THEN 'FLZ' WHEN 3 THEN 'Restricted_airspace' ELSE 'Other' END AS objective FROM part""")
def road_classes(spark, sf):
    tag = F.get(F.array(*map(F.lit, _TAGS)), (F.col("p_partkey") % 8).cast("int"))
    name = F.concat(F.get(F.array(*map(F.lit, ("Drone-Base ", "docking", "FLZ", "Restricted_Airspace-", "tower"))), (F.col("p_partkey") % 5).cast("int")), F.col("p_name"))
    return table(spark, sf, "part").select("p_partkey", K.road_class(tag).alias("road"), K.objective_class(name).alias("objective"))


@query("""WITH t AS (SELECT p_partkey, p_partkey % 4 AS k, CASE WHEN p_size % 3 = 0 THEN p_size END::DOUBLE AS tag FROM part)
SELECT p_partkey, ['power_cable', 'power_minor_line', 'telecom_tower', 'pipeline'][k + 1] AS kind, coalesce(tag, [0.0, 15.0, 45.0, 0.0][k + 1])::DOUBLE AS height_m, CASE WHEN k = 1 THEN 6.0 ELSE 0.0 END::DOUBLE AS z_min,
CASE WHEN k IN (0, 3) THEN 0 ELSE coalesce(tag, [0.0, 15.0, 45.0, 0.0][k + 1]) END::DOUBLE AS z_max,
CASE WHEN k = 3 THEN 'usually_underground_not_air_obstacle' WHEN tag IS NOT NULL THEN 'osm_height' WHEN k = 0 THEN 'assumed_underground_or_cable_not_air_obstacle' WHEN k = 1 THEN 'assumed_power_minor_line' ELSE 'assumed_telecom_tower' END AS source FROM t""")
def infra_heights(spark, sf):
    k = (F.col("p_partkey") % 4).cast("int")
    pick = lambda *v: F.get(F.array(*[F.lit(x).cast("string") for x in v]), k)
    layer, power, man_made, none = pick("power_lines", "power_lines", "telecom_masts_towers", "pipelines"), pick("Cable", "minor_line", None, None), pick(None, None, "tower", None), F.lit(None).cast("string")
    kind = K.infra_class(layer, power, man_made, none, none, none, none)
    said = F.when(F.col("p_size") % 3 == 0, F.concat(F.col("p_size"), F.lit(" m"))).otherwise("about 5 floors")
    h = K.infra_height(layer, kind, [F.lit("unknown"), said], power, none, none)
    return table(spark, sf, "part").select("p_partkey", kind.alias("kind"), h.alias("h")).select("p_partkey", "kind", "h.*")


@query("""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'roads' WHEN p_partkey % 3 = 1 AND p_size % 2 = 0 THEN 'building' WHEN p_size % 5 = 0 THEN 'highway' ELSE 'other' END AS feature FROM part""")
def feature_groups(spark, sf):
    k = F.col("p_partkey") % 3
    group = F.when(k == 0, " Roads ").when(k == 1, "unheard of")
    tags = {"building": F.when((k == 1) & (F.col("p_size") % 2 == 0), "yes").otherwise("none"), "highway": F.when(F.col("p_size") % 5 == 0, "track").otherwise(" ")}
    return table(spark, sf, "part").select("p_partkey", K.feature_group([group], tags, ["roads", "rail"]).alias("feature"))


@query("""WITH a AS (SELECT c_custkey, radians(c_custkey % 360 - 180) AS a FROM customer) SELECT c_custkey, CAST(round_even((a + pi()) / (2 * pi()) * 32, 0) AS INT) % 32 AS bucket, round(-3 * sin(a), 6) AS u, round(-3 * cos(a), 6) AS v FROM a""")
def direction_buckets(spark, sf):
    deg = (F.col("c_custkey") % 360 - 180).cast("double")
    u, v = K.wind_arrow(deg, F.lit(3.0), "wind_flow_to")
    return table(spark, sf, "customer").select("c_custkey", K.direction_bucket(F.radians(deg)).alias("bucket"), F.round(u, 6).alias("u"), F.round(v, 6).alias("v"))


@query("""SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 12.5 WHEN 1 THEN 30 * 0.3048 WHEN 2 THEN 7.0 WHEN 4 THEN 40.0 END::DOUBLE AS metres, CASE p_partkey % 5 WHEN 2 THEN 7.0 WHEN 4 THEN 40.0 END::DOUBLE AS kilovolts FROM part""")
def strict_tags(spark, sf):
    said = F.get(F.array(*map(F.lit, ("12,5 m", "30 ft", "7;9", "about 5 floors", "40"))), (F.col("p_partkey") % 5).cast("int"))
    return table(spark, sf, "part").select("p_partkey", C.parse_metres(said, strict=True).alias("metres"), C.parse_kilovolts(said).alias("kilovolts"))


@query("""SELECT 'w005_n15_e000_n10' AS tile_name WHERE false UNION ALL SELECT (CASE WHEN x < 0 THEN 'w' ELSE 'e' END) || abs(x) || '_' || (CASE WHEN y + 5 < 0 THEN 's' ELSE 'n' END) || abs(y + 5) || '_' || (CASE WHEN x + 5 < 0 THEN 'w' ELSE 'e' END) || abs(x + 5) || '_' || (CASE WHEN y < 0 THEN 's' ELSE 'n' END) || abs(y)
FROM (SELECT unnest(range(-10, 15, 5)) AS x), (SELECT unnest(range(-5, 20, 5)) AS y)""")
def degree_tiles(spark, sf):
    return tables.degree_tiles(spark, -7.5, -1.0, 12.0, 16.0).select("tile_name")


@query("""SELECT CAST(10000 AS DOUBLE) AS m2, 0.01::DOUBLE AS km2, 1.0::DOUBLE AS ha""")
def area_stats(spark, sf):
    return model.area_stats([(0.0, 0.0), (200.0, 0.0), (200.0, 50.0), (0.0, 50.0)], spark)


# --- without SQL: sequential choices, tested on small cases

@query()
def balanced_areas(spark, sf):
    p = points(spark, sf)
    pool = model.area_cells(p, 50.0).select("id", F.col("area_id").alias("area"), "x", "y", F.pmod(F.xxhash64("id"), F.lit(1000)).cast("double").alias("score"), (F.col("id") % 17).alias("hits"))
    areas = pool.groupBy("area").agg(F.least(F.lit(4), F.count("*")).cast("int").alias("quota"), F.sum("hits").cast("double").alias("density"))
    return model.balanced(pool, areas, apart=20.0).select("id", "area", "kind", "area_rank", "turn_rank")


@query()
def spread_representatives(spark, sf):
    p = points(spark, sf).select("id", "x", "y", F.pmod("label", F.lit(9)).alias("cluster"), (F.col("id") % 23).alias("hits"))
    return model.spread_representatives(p, "cluster", 10.0)


@query()
def unit_hashes(spark, sf):
    return table(spark, sf, "customer").select("c_custkey", K.unit_hash(F.col("c_custkey"), F.col("c_nationkey")).alias("u"))
