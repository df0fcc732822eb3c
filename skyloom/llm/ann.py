"""Approximate nearest neighbours: random-projection trees, one shared queue, exact reranking.

Rows are dealt by a hash of their number to shards of bounded size.  A shard builds a forest over its distinct vectors;
queries meet every shard in blocks, pop leaves of all trees from one priority queue, best margin first, and
rank the vectors of the popped leaves exactly.  The best of all shards are merged per query.
"""

from __future__ import annotations

from collections.abc import Iterator
from heapq import heappop, heappush

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import materialise

#: Vectors per shard; trees of a forest; vectors per leaf; part of a forest's rows (a row counts once a tree) that a query pops.
SHARD, TREES, LEAF, POPS = 16384, 24, 64, 0.035
#: Queries per block and searched together.
QUERIES, TOGETHER = 65536, 256


class Forest:
    """Random-projection trees over the rows of `x`, all of the same depth and split at medians."""

    def __init__(self, x: np.ndarray, trees: int = TREES, leaf: int = LEAF, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.depth = max(0, int(np.ceil(np.log2(max(1, len(x)) / leaf))))
        n = 1 << self.depth
        self.normals = np.zeros((trees, max(1, n - 1), x.shape[1]))
        self.cuts = np.zeros((trees, max(1, n - 1)))
        self.leaves: list[np.ndarray] = []
        for t in range(trees):
            parts = [np.arange(len(x))]
            node = 0
            for _ in range(self.depth):
                below = []
                for p in parts:
                    way = rng.standard_normal(x.shape[1])
                    way /= np.linalg.norm(way)
                    at = x[p] @ way
                    order, half = np.argsort(at, kind="stable"), len(p) // 2
                    self.normals[t, node] = way
                    self.cuts[t, node] = (at[order[half - 1]] + at[order[half]]) / 2 if half else 0
                    below += [p[order[:half]], p[order[half:]]]
                    node += 1
                parts = below
            self.leaves += parts

    def popped(self, q: np.ndarray, part: float = POPS) -> Iterator[list[int]]:
        """Leaves that each query pops from the queue shared by all trees, until they hold `part` of all trees' rows.

        The queue starts with every root.  A node's priority is the least margin on its path, the side the query lies on
        first; popping a node puts its two children in the queue.  Margins of a block come from one product a tree.
        """
        trees, inner = len(self.normals), (1 << self.depth) - 1
        enough = max(part * trees * sum(map(len, self.leaves[:inner + 1])), 1)
        margins = np.stack([q @ self.normals[t].T - self.cuts[t] for t in range(trees)], axis=1).astype(np.float32)
        for mine in margins:
            queue = [(-np.inf, t, 0) for t in range(trees)]
            mine, out, held = mine.tolist(), [], 0
            while queue and held < enough:
                bound, t, node = heappop(queue)
                if node >= inner:
                    leaf = t * (inner + 1) + node - inner
                    out.append(leaf)
                    held += len(self.leaves[leaf])
                else:
                    m = mine[t][node]  # children of node i are 2 i + 1 (below the cut) and 2 i + 2
                    heappush(queue, (max(bound, m), t, 2 * node + 1))
                    heappush(queue, (max(bound, -m), t, 2 * node + 2))
            yield out


#: What is found: the query's row, and for each the id (0 and missing, if null), number and score.
FOUND = "query long, missing boolean, vec_id long, number long, score double"


def search(rows: pd.DataFrame, asks: pd.DataFrame, k: int, trees: int = TREES, leaf: int = LEAF, part: float = POPS) -> pd.DataFrame:
    """The k nearest found per query among rows of another number, by inner product, ties to the smaller id (null last)."""
    x, q = (np.array(d["embedding"].tolist(), np.float64) for d in (rows, asks))
    numbers, ids, missing, mine = rows["number"].to_numpy(), rows["vec_id"].to_numpy(), rows["missing"].to_numpy(), asks["number"].tolist()
    distinct, of = np.unique(x, axis=0, return_inverse=True)
    of = of.ravel()
    order = np.lexsort((numbers, ids, missing, of))
    first = np.searchsorted(of[order], np.arange(len(distinct) + 1)).tolist()
    forest = Forest(distinct, trees, leaf)
    out = []
    for lo in range(0, len(q), TOGETHER):
        block = q[lo:lo + TOGETHER]
        for i, pops in enumerate(forest.popped(block, part)):
            mask = np.zeros(len(distinct), bool)
            mask[np.concatenate([forest.leaves[j] for j in pops])] = True
            near = np.flatnonzero(mask)
            score = distinct[near] @ block[i]
            if len(near) > k + 1:  # one may be the query itself
                good = score >= np.partition(score, len(score) - k - 1)[len(score) - k - 1]
                near, score = near[good], score[good]
            found = [(-s, bool(missing[r]), int(ids[r]), int(numbers[r])) for d, s in zip(near.tolist(), score.tolist()) for r in order[first[d]:min(first[d + 1], first[d] + k + 1)].tolist() if numbers[r] != mine[lo + i]]
            out += [(mine[lo + i], m, v, n, -s) for s, m, v, n in sorted(found)[:k]]
    return pd.DataFrame(out, columns=["query", "missing", "vec_id", "number", "score"]).astype({"query": "int64", "missing": bool, "vec_id": "int64", "number": "int64", "score": "float64"})


def usable(d: DataFrame) -> DataFrame:
    """Rows whose vector is not null or zero and has finite components only; ids as longs."""
    e = F.col("embedding")
    ok = e.isNotNull() & F.forall(e, lambda x: F.coalesce(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists(e, lambda x: x != 0)
    return d.where(ok).withColumns({"vec_id": F.col("vec_id").cast("long"), "embedding": F.col("embedding").cast("array<double>")})


def _nearest(v: DataFrame, q: DataFrame, k: int, shard: int, trees: int, leaf: int, part: float) -> DataFrame:
    """v, q: number (one row's own, the same for a query and its own row), vec_id, embedding, all usable."""
    shards = max(1, -(-v.count() // shard))
    blocks = max(1, -(-q.count() // QUERIES))
    mine = lambda n: F.pmod(F.xxhash64("number"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    each = ["number", F.isnull("vec_id").alias("missing"), F.coalesce("vec_id", F.lit(0)).alias("vec_id"), "embedding"]
    rows = v.select(F.lit(False).alias("asks"), mine(shards).alias("shard"), every(blocks).alias("qblock"), *each).union(
        q.select(F.lit(True).alias("asks"), every(shards).alias("shard"), mine(blocks).alias("qblock"), *each))

    def cell(pdf: pd.DataFrame) -> pd.DataFrame:
        size = pdf["embedding"].map(len)
        found = []
        for n in sorted(size.unique()):
            part_of = pdf[size == n]
            asks = part_of["asks"].to_numpy()
            if asks.any() and not asks.all():
                found.append(search(part_of[~asks], part_of[asks], k, trees, leaf, part))
        return pd.concat(found) if found else pd.DataFrame({"query": [], "missing": [], "vec_id": [], "number": [], "score": []}).astype({"query": "int64", "missing": bool, "vec_id": "int64", "number": "int64", "score": "float64"})

    near = rows.groupBy("shard", "qblock").applyInPandas(cell, FOUND)
    ranked = near.withColumn("rank", F.expr("row_number() OVER (PARTITION BY query ORDER BY score DESC, missing, vec_id, number)"))
    return ranked.where(F.col("rank") <= k).select("query", F.col("rank").cast("int").alias("rank"), F.when(~F.col("missing"), F.col("vec_id")).alias("vec_id"), "score")


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 20, shard: int = SHARD, trees: int = TREES, leaf: int = LEAF, part: float = POPS) -> DataFrame:
    """(query_id, rank, vec_id, score): up to k rows per query, nearest first.  Both inputs have vec_id and embedding.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do rows without an id.
    An id stands for one vector here: rows that repeat it count once, with the least (ann_digest keeps rows apart).  Vectors meet
    only those of their own length.
    """
    once = lambda d: usable(d).where("vec_id IS NOT NULL").groupBy("vec_id").agg(F.min("embedding").alias("embedding")).withColumn("number", F.col("vec_id"))
    return _nearest(once(vectors), once(queries), k, shard, trees, leaf, part).withColumnRenamed("query", "query_id")


def ann_digest(embeddings: DataFrame, k: int = 20) -> DataFrame:
    """Contract columns.  Rows count one by one: those that share an id ask for themselves and are each other's candidates, and rows
    without an id are candidates (after others in a tie, vec_id null)."""
    e = materialise(usable(embeddings.select("vec_id", "embedding")).withColumn("number", F.monotonically_increasing_id()), "vectors")
    q = e.where("vec_id % 20 = 0")
    found = _nearest(e, q, k, SHARD, TREES, LEAF, POPS)
    return found.join(q.select(F.col("number").alias("query"), F.col("vec_id").alias("query_id")), "query").select("query_id", "rank", "vec_id", "score")
