"""Graph operators: level-synchronous search and components as DataFrame loops; exact solvers per query group."""

from __future__ import annotations

import heapq
import tempfile
import uuid
from collections.abc import Callable
from itertools import count as naturals

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def cut(df: DataFrame) -> DataFrame:
    """Cut lineage with a reliable checkpoint in the shared folder (set here only where the session names none)."""
    sc = df.sparkSession.sparkContext
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(df.sparkSession.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="skyloom-"))
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """Cut lineage with a table in the shared folder: unlike a checkpoint it keeps nothing of the plan that made it."""
    spark = df.sparkSession
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.sparkContext.getCheckpointDir() or "file://" + tempfile.mkdtemp(prefix="skyloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    path = f"{base.rstrip('/')}/graph-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def hops(edges: DataFrame, source: int) -> DataFrame:
    """Breadth-first levels from `source` over directed (src, dst), until one has no new node: node, hops."""
    seen = cut(edges.sparkSession.range(1).select(F.lit(source).cast("long").alias("node"), F.lit(0).alias("hops")))
    front = seen
    for k in naturals(1):
        new = front.join(edges, front["node"] == edges["src"]).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        new = cut(new.select("node", F.lit(k).alias("hops")))
        if not new.limit(1).count():
            return seen
        seen, front = cut(seen.unionByName(new)), new


def distances(edges: DataFrame, source: int, most: int = 500) -> DataFrame:
    """Least path cost from `source` over directed (src, dst, cost >= 0), by relaxing the nodes that improved: node, dist."""
    best = cut(edges.sparkSession.range(1).select(F.lit(source).cast("long").alias("node"), F.lit(0.0).alias("dist")))
    front = best
    for _ in range(most):
        reach = front.join(edges, front["node"] == edges["src"]).groupBy(F.col("dst").alias("node")).agg(F.min(F.col("dist") + F.col("cost")).alias("new"))
        better = cut(reach.join(best, "node", "left").where("dist IS NULL OR new < dist").select("node", F.col("new").alias("dist")))
        if not better.limit(1).count():
            return best
        best, front = cut(best.join(better.select("node"), "node", "left_anti").unionByName(better)), better
    raise RuntimeError(f"distances did not settle in {most} rounds")


def components(nodes: DataFrame, edges: DataFrame, most: int = 100) -> DataFrame:
    """(node, component): the least node reachable over undirected (src, dst), by alternating large-star and small-star steps.

    Every step is a table of its own: a checkpoint would keep the constraints of all steps before it, which grow round by round on the driver.
    """
    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    def step(e: DataFrame) -> DataFrame:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least(both).select("u", F.least("u", "m").alias("m")), "u").where("v > u AND v > m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        first = least(large)
        small = large.join(first, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return small.union(first.select("u", F.col("m").alias("v"))).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = written(edges.select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).where("src <> dst").distinct())
    seen = mark(e)
    for _ in range(most if seen[0] else 0):
        e = written(step(e))
        now = mark(e)
        if now == seen:
            break
        seen = now
    else:
        if seen[0]:
            raise RuntimeError(f"components did not settle in {most} rounds")
    return nodes.select("node").join(e, nodes["node"] == e["u"], "left").select("node", F.coalesce("v", "node").alias("component"))


def dbscan(nodes: DataFrame, pairs: DataFrame, least_weight: float) -> DataFrame:
    """Weighted DBSCAN from ε-pairs (a, b): node, cluster (the least core node; null for noise), is_core.

    A node is core if its own weight and its neighbours' sum to `least_weight`; a border node takes its least adjacent cluster."""
    both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    w = nodes.select(F.col("node").alias("b"), F.col("weight").alias("wb"))
    near = both.join(w, "b").groupBy(F.col("a").alias("node")).agg(F.sum("wb").alias("around"))
    flagged = cut(nodes.join(near, "node", "left").select("node", (F.col("weight") + F.coalesce("around", F.lit(0.0)) >= least_weight).alias("is_core")))
    core = flagged.where("is_core").select("node")
    inner = pairs.join(core.withColumnRenamed("node", "a"), "a", "left_semi").join(core.withColumnRenamed("node", "b"), "b", "left_semi")
    c = components(core, inner.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    border = both.join(c.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("adjacent"))
    return flagged.join(c, "node", "left").join(border, "node", "left").select("node", F.when(F.col("is_core"), F.col("component")).otherwise(F.col("adjacent")).alias("cluster"), "is_core")


Solver = Callable[[dict, int, int], tuple[list[int], float]]
SOLVERS: dict[str, Solver] = {}


def solver(name: str) -> Callable[[Solver], Solver]:
    def put(f: Solver) -> Solver:
        SOLVERS[name] = f
        return f
    return put


def _search(near: dict, start: int, goal: int, guess: Callable[[int], float] = lambda _: 0.0) -> tuple[list[int], float]:
    queue, best, back, done = [(guess(start), 0, start)], {start: 0.0}, {}, set()
    count = 0
    while queue:
        _, _, u = heapq.heappop(queue)
        if u in done:
            continue
        if u == goal:
            path = [u]
            while path[-1] != start:
                path.append(back[path[-1]])
            return path[::-1], best[goal]
        done.add(u)
        for v, cost in near.get(u, ()):
            if v not in done and best[u] + cost < best.get(v, float("inf")):
                best[v], back[v], count = best[u] + cost, u, count + 1
                heapq.heappush(queue, (best[v] + guess(v), count, v))
    return [], float("inf")


@solver("dijkstra")
def dijkstra(near: dict, start: int, goal: int) -> tuple[list[int], float]:
    return _search(near, start, goal)


@solver("bfs")
def bfs(near: dict, start: int, goal: int) -> tuple[list[int], float]:
    return _search({u: [(v, 1.0) for v, _ in vs] for u, vs in near.items()}, start, goal)


def solve(pairs: DataFrame, edges: DataFrame, name: str, most_edges: int = 2_000_000) -> DataFrame:
    """Paths of (pair_id, start, goal) by a registered solver over broadcast edges (src, dst, cost), grouped by source.

    The edge list is checked against `most_edges` before it is broadcast; larger graphs use `distances`."""
    spark = edges.sparkSession
    if edges.count() > most_edges:
        raise ValueError(f"over {most_edges} edges: use distances()")
    near: dict[int, list] = {}
    for r in edges.select("src", "dst", "cost").orderBy("src", "cost", "dst").toLocalIterator():
        near.setdefault(r["src"], []).append((r["dst"], r["cost"]))
    shared, find = spark.sparkContext.broadcast(near), SOLVERS[name]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out = []
        for r in pdf.itertuples():
            path, cost = find(shared.value, r.start, r.goal)
            out.append((r.pair_id, bool(path), [int(x) for x in path], cost if path else None))
        return pd.DataFrame(out, columns=["pair_id", "success", "path_indices", "total_cost"])

    return pairs.groupBy("start").applyInPandas(run, "pair_id long, success boolean, path_indices array<long>, total_cost double")


def _shared(edges: DataFrame, nodes: DataFrame, blocked: list[int], most_edges: int):
    from .search import Graph

    if edges.count() > most_edges or nodes.count() > most_edges:
        raise ValueError(f"over {most_edges} edges: use distances()")
    near: dict[int, list] = {}
    for r in edges.select("src", "dst", "cost").orderBy("src", "cost", "dst").toLocalIterator():
        near.setdefault(r["src"], []).append((r["dst"], r["cost"]))
    return edges.sparkSession.sparkContext.broadcast(Graph(near, {r["node"]: (r["x"], r["y"]) for r in nodes.toLocalIterator()}, frozenset(blocked)))


def solve_on_plane(pairs: DataFrame, edges: DataFrame, nodes: DataFrame, find: Callable, blocked: list[int] = (), most_edges: int = 2_000_000) -> DataFrame:
    """Paths of (pair_id, start, goal) by a solver of search.py over edges (src, dst, cost) and nodes (node, x, y).

    The graph is checked against `most_edges` and then broadcast; pairs are dealt one by one over the tasks.
    """
    shared = _shared(edges, nodes, blocked, most_edges)

    def run(batches):
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                path, cost = find(shared.value, r.start, r.goal)
                out.append((r.pair_id, bool(path), [int(x) for x in path], round(cost, 9) if path else None))
            yield pd.DataFrame(out, columns=["pair_id", "success", "path_indices", "total_cost"])

    return pairs.repartition("pair_id").mapInPandas(run, "pair_id long, success boolean, path_indices array<long>, total_cost double")


def solve_many(pairs: DataFrame, edges: DataFrame, nodes: DataFrame, find: Callable, blocked: list[int] = (), most_edges: int = 2_000_000) -> DataFrame:
    """As `solve_on_plane`, for solvers that give several named paths, [(name, path, cost)]: a row for each, in `place` from 1."""
    shared = _shared(edges, nodes, blocked, most_edges)

    def run(batches):
        for pdf in batches:
            out = [(r.pair_id, i, name, [int(x) for x in path], round(cost, 6)) for r in pdf.itertuples() for i, (name, path, cost) in enumerate(find(shared.value, r.start, r.goal), 1)]
            yield pd.DataFrame(out, columns=["pair_id", "place", "name", "path_indices", "total_cost"])

    return pairs.repartition("pair_id").mapInPandas(run, "pair_id long, place int, name string, path_indices array<long>, total_cost double")
