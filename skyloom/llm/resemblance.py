"""Near-duplicates by resemblance: all pairs of texts whose sets of word shingles have a Jaccard similarity of at least `least`.

Nothing is sampled out of the result.  Texts with equal sets are one node.  In any order of all shingles, two sets that
are similar enough share one of their first n - ceil(least * n) + 1 (prefix filter); common shingles come last in ours, so
that few nodes share a bucket.  Pairs of a bucket that pass three necessary conditions (sizes; places of the shared shingle in
that order, if no earlier one is shared; parities of the shingles, as a set's difference from another is at least the number
of parities that differ) are compared shingle by shingle.  In a
crowded bucket all are first compared with a few hubs, round by round with others, which joins most of a group by few pairs;
then the pairs that are not yet in one component are left, and all of them are compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import connected_components, materialise, small_batches, text_key

SHINGLE, LEAST = 5, 0.8
#: Part of the texts that common shingles are counted in, times there that make one common, and how many are kept.  They
#: only set the order.
SAMPLE, COMMON, MOST = 16, 4, 100_000
#: Texts whose shingles are compared, up to which the list of their hashes is broadcast.
LISTED = 500_000
#: Nodes of a bucket of which all pairs are compared at once; hubs of a larger one, and rounds of them at most; 64-bit words of parities.
CROWD, HUBS, ROUNDS, PARITIES = 4, 8, 8, 16
#: A round of hubs is worth it while pairs of a bucket in different components are over CHEAP a row and the last round took WORTH of them
#: away.  They only set the order of the work: whatever is left is compared.
CHEAP, WORTH = 16, 0.1

_FACTORS = np.random.default_rng(2025).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_set(text: str | None, size: int = SHINGLE) -> np.ndarray:
    """Sorted 64-bit hashes of the distinct runs of `size` words (fewer words: the whole sequence; none: nothing)."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    k = min(size, len(w))
    h = np.zeros(len(w) - k + 1, np.uint64)
    for i in range(k):
        h += w[i:i + len(h)] * _FACTORS[i % 64]
        h ^= h >> np.uint64(29)
    h *= np.uint64(0x9E3779B97F4A7C15)
    return np.unique(h ^ (h >> np.uint64(32)))


def _parities(s: np.ndarray) -> np.ndarray:
    """Parity of the number of shingles in each of 64 * PARITIES classes."""
    odd = np.bincount((s % np.uint64(64 * PARITIES)).astype(np.int64), minlength=64 * PARITIES) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _prefix(s: np.ndarray, common: np.ndarray, rank: np.ndarray, least: float) -> np.ndarray:
    """The first shingles of `s`: by hash, then the common ones (sorted, with their ranks) by rank."""
    n = len(s) - int(np.ceil(least * len(s) - 1e-9)) + 1 if len(s) else 0
    if not len(common):
        return s[:n]
    at = np.minimum(np.searchsorted(common, s), len(common) - 1)
    late = np.where(common[at] == s, rank[at] + 1, 0)
    return s[np.argsort(late, kind="stable")[:n]]


def _may(nu: np.ndarray, nv: np.ndarray, differ: np.ndarray, least: float) -> np.ndarray:
    """Pairs that can be similar enough, by sizes and by the number of parities that differ."""
    return (np.minimum(nu, nv) >= least * np.maximum(nu, nv) - 1e-9) & (differ <= (nu + nv) * (1 - least) / (1 + least) + 1e-9)


def _may_from(n: np.ndarray, at: np.ndarray, p: np.ndarray, i: np.ndarray, j: np.ndarray, least: float) -> np.ndarray:
    """The same for rows i and j of a bucket (p: words of parities); false also where the pair could only be similar enough by
    sharing an earlier bucket."""
    both = np.minimum(n[i] - at[i], n[j] - at[j])  # shared at most, this one included
    good = both >= (n[i] + n[j]) * least / (1 + least) - 1e-9
    i, j = i[good], j[good]
    good[good] = _may(n[i], n[j], np.bitwise_count(p[i] ^ p[j]).sum(axis=1, dtype=np.int64), least)
    return good


def _words(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint64).reshape(len(column), -1)


def _by_bucket(rows: DataFrame, of: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """`of` over whole buckets `t`, each node once, ascending; Python holds one bucket besides a batch."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        for pdf in batches:
            if not len(pdf):
                continue
            t, node = pdf["t"].to_numpy(), pdf["node"].to_numpy()
            fresh = np.concatenate(([True], (t[1:] != t[:-1]) | (node[1:] != node[:-1])))
            if held:
                last = held[-1].iloc[-1]
                fresh[0] = last["t"] != t[0] or last["node"] != node[0]
            pdf, t = pdf[fresh], t[fresh]
            if not len(pdf):
                continue
            if held and held[0]["t"].iloc[0] == t[-1] and t[0] == t[-1]:
                held.append(pdf)
                continue
            first = int((t == t[-1]).argmax())
            whole = pd.concat([*held, pdf.iloc[:first]], ignore_index=True)
            held = [pdf.iloc[first:]]
            if len(whole):
                yield of(whole)
        if held:
            yield of(pd.concat(held, ignore_index=True))

    return rows.repartition("t").sortWithinPartitions("t", "node").mapInPandas(run, schema)


def _first_pairs(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """Pairs (u, v) to compare, and the members (t, u, null) of crowded buckets, of which only pairs with a hub are here."""
    t, node, n, at, p = (pdf[c].to_numpy() for c in ("t", "node", "n", "at", "parity"))
    p = p.view(np.uint64).reshape(-1, 1)  # bits of a signed number are those of its absolute value
    lo = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
    hi = np.concatenate((lo[1:], [len(t)]))
    crowded = hi - lo > CROWD
    us, vs = [], []

    def put(i: np.ndarray, j: np.ndarray) -> None:
        good = _may_from(n, at, p, i, j, least)
        us.append(i[good]), vs.append(j[good])

    i = np.flatnonzero(~np.repeat(crowded, hi - lo))
    for k in range(1, CROWD):
        i = i[i + k < len(t)]
        i = i[t[i] == t[i + k]]
        if not len(i):
            break
        put(i, i + k)
    members = [np.empty(0, np.int64)]
    for a, b in zip(lo[crowded].tolist(), hi[crowded].tolist()):
        members.append(np.arange(a, b))
        for k in range(a, a + 2):  # more in the rounds
            put(np.full(b - k - 1, k), np.arange(k + 1, b))
    u, v, m = np.concatenate([*us, members[0]]), np.concatenate([*vs, members[0]]), np.concatenate(members)
    found = pd.DataFrame({"t": pd.Series([None] * len(u), dtype="Int64"), "u": node[u], "v": pd.Series(node[v], dtype="Int64"), "at": at[u]})
    crowd = pd.DataFrame({"t": pd.Series(t[m], dtype="Int64"), "u": node[m], "v": pd.Series([None] * len(m), dtype="Int64"), "at": at[m]})
    return pd.concat([found, crowd], ignore_index=True)


def _hub_pairs(pdf: pd.DataFrame, turn: int, least: float) -> pd.DataFrame:
    """Pairs of each bucket's hubs of a round (the same nodes in all buckets that they share) with nodes of other roots."""
    t, node, n, at, root = (pdf[c].to_numpy() for c in ("t", "node", "n", "at", "root"))
    p = _words(pdf["fold"])
    order = (node.view(np.uint64) ^ np.uint64(turn * 0x632BE59BD9B4E019 & (1 << 64) - 1)) * np.uint64(0x9E3779B97F4A7C15)
    order ^= order >> np.uint64(31)
    lo = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
    us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for a, b in zip(lo.tolist(), [*lo[1:].tolist(), len(t)]):
        rows = np.arange(a, b)
        if (root[a:b] == root[a]).all():
            continue
        for i in (a + np.argsort(order[a:b])[:HUBS]).tolist():
            j = rows[root[a:b] != root[i]]
            j = j[_may_from(n, at, p, j, np.full(len(j), i), least)]
            us.append(np.minimum(node[j], node[i])), vs.append(np.maximum(node[j], node[i]))
    return pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs)}).drop_duplicates()


def _apart(placed: DataFrame) -> int:
    """About the number of pairs that `_left_pairs` looks at: rows of each bucket, times those outside its largest component."""
    parts = placed.groupBy("t", "root").agg(F.count("*").cast("double").alias("c"))
    each = parts.groupBy("t").agg((F.sum("c") * (F.sum("c") - F.max("c"))).alias("w"))
    return int(each.agg(F.coalesce(F.sum("w"), F.lit(0.0))).first()[0])


def _left_pairs(pdf: pd.DataFrame, least: float) -> pd.DataFrame:
    """Pairs of each bucket whose roots differ: all with a node outside the bucket's largest component."""
    t, node, n, at, root = (pdf[c].to_numpy() for c in ("t", "node", "n", "at", "root"))
    p = _words(pdf["fold"])
    lo = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1])))
    us, vs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    for a, b in zip(lo.tolist(), [*lo[1:].tolist(), len(t)]):
        _, part, count = np.unique(root[a:b], return_inverse=True, return_counts=True)
        big = count.argmax()
        rows = np.arange(a, b)
        for i in np.flatnonzero(part != big).tolist():
            j = rows[(part != part[i]) & ((part == big) | (rows > a + i))]
            j = j[_may_from(n, at, p, j, np.full(len(j), a + i), least)]
            us.append(np.minimum(node[j], node[a + i])), vs.append(np.maximum(node[j], node[a + i]))
    return pd.DataFrame({"u": np.concatenate(us), "v": np.concatenate(vs)}).drop_duplicates()


def similar(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, size: int, least: float) -> DataFrame:
    """Those of the distinct pairs (u, v) of nodes that are similar enough, written to the shared folder."""
    @F.pandas_udf("boolean")
    def may(nu: pd.Series, nv: pd.Series, bu: pd.Series, bv: pd.Series) -> pd.Series:
        if not len(nu):
            return pd.Series([], dtype=bool)
        bits = [np.frombuffer(b"".join(b), np.uint64).reshape(len(b), -1) for b in (bu, bv)]
        return pd.Series(_may(nu.to_numpy(), nv.to_numpy(), np.bitwise_count(bits[0] ^ bits[1]).sum(axis=1, dtype=np.int64), least))

    @F.pandas_udf("binary")
    def whole(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: shingle_set(t, size).tobytes())

    @F.pandas_udf("boolean")
    def enough(us: pd.Series, vs: pd.Series) -> pd.Series:
        def one(a: bytes, b: bytes) -> bool:
            both = len(np.intersect1d(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), assume_unique=True))
            return both / ((len(a) + len(b)) // 8 - both) >= least
        return pd.Series([one(a, b) for a, b in zip(us, vs)], dtype=bool)

    side = lambda d, x: d.select(F.col("node").alias(x), *[F.col(c).alias(c + x) for c in d.columns if c != "node"])
    few = materialise(pairs.select(F.col("u").alias("node")).union(pairs.select("v")).distinct(), "nodes-of-pairs")
    brief = nodes.select("node", "n", "bits", "h").join(F.broadcast(few) if few.count() <= LISTED else few, "node", "left_semi")
    near = pairs.join(side(brief, "u"), "u").join(side(brief, "v"), "v")
    near = materialise(near.where(may("nu", "nv", "bitsu", "bitsv")).select("u", "v", "hu", "hv"), "candidates")
    need = near.select(F.col("u").alias("node"), F.col("hu").alias("h")).union(near.select("v", "hv")).distinct()
    need = materialise(need, "to-compare")
    wanted = need.select("h")
    wanted = F.broadcast(wanted) if need.count() <= LISTED else wanted
    texts = docs.select(F.xxhash64("text").alias("h"), "text").join(wanted, "h", "left_semi").dropDuplicates(["h"])
    sets = materialise(need.join(texts, "h").select("node", whole("text").alias("s")), "sets")
    both = near.join(side(sets, "u"), "u").join(side(sets, "v"), "v")
    return materialise(both.where(enough("su", "sv")).select("u", "v"), "similar")


def near_duplicates(docs: DataFrame, size: int = SHINGLE, least: float = LEAST) -> DataFrame:
    """(doc_id, h, group, component_id): one row per document row; `h` is text_key, `group` a number that linked rows share,
    component_id the least doc_id reachable over similar pairs.

    Texts without words (null, empty) are alike.  Rows that repeat a doc_id are documents of their own; null ids take the
    component's least id (null if it has none).
    """
    spark = docs.sparkSession
    small_batches(spark)

    @F.pandas_udf("array<long>")
    def hashes(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: shingle_set(t, size).view(np.int64))

    some = docs.where(F.pmod(F.xxhash64("text"), F.lit(SAMPLE)) == 0).select(F.explode(hashes("text")).alias("t"))
    top = some.groupBy("t").count().where(F.col("count") >= COMMON).orderBy(F.desc("count"), "t").limit(MOST).collect()
    common = np.array([r["t"] for r in top], np.int64).view(np.uint64)
    by_hash = np.argsort(common)
    shared = spark.sparkContext.broadcast((common[by_hash], (len(common) - 1 - np.arange(len(common)))[by_hash]))  # MOST at most

    @F.pandas_udf("node long, n long, parity long, fold binary, bits binary, prefix array<long>")
    def of(texts: pd.Series) -> pd.DataFrame:
        out = []
        for text in texts:
            s = shingle_set(text, size)
            bits = _parities(s)
            node = np.uint64(xxhash.xxh64_intdigest(s.tobytes())).view(np.int64) if len(s) else 0
            fold = np.bitwise_xor.reduce(bits.reshape(-1, 4))  # parities of fewer classes
            out.append((int(node), len(s), int(np.bitwise_xor.reduce(bits).view(np.int64)), fold.tobytes(), bits.tobytes(), _prefix(s, *shared.value, least).view(np.int64)))
        return pd.DataFrame(out, columns=["node", "n", "parity", "fold", "bits", "prefix"])

    d = materialise(docs.select("doc_id", F.xxhash64("text").alias("h"), text_key(F.col("text")).alias("key"), of("text").alias("x")).select("doc_id", "h", "key", "x.*"), "sets-of-documents")
    nodes = materialise(d.groupBy("node").agg(F.min("doc_id").alias("least"), *[F.first(c).alias(c) for c in ("n", "parity", "fold", "bits", "h")]), "nodes")
    spread = d.select(F.posexplode("prefix").alias("at", "t"), "node", "n", "parity")
    found = materialise(_by_bucket(spread, lambda pdf: _first_pairs(pdf, least), "t long, u long, v long, at int"), "pairs")
    edges = similar(found.where("v IS NOT NULL").select("u", "v").distinct(), nodes, docs, size, least)
    crowd = found.where("v IS NULL").select("t", F.col("u").alias("node"), "at")
    roots = connected_components(edges)
    if crowd.limit(1).count():
        members = materialise(crowd.join(nodes.select("node", "n", "fold"), "node"), "crowd")
        linear, before, turn = members.count() * CHEAP, None, 0
        while True:
            roots = materialise(roots, "roots")
            known = F.broadcast(roots) if roots.count() <= LISTED else roots
            placed = members.join(known, "node", "left").withColumn("root", F.coalesce("root", "node"))
            apart = _apart(placed)
            whole = apart <= linear or turn == ROUNDS or before is not None and apart > (1 - WORTH) * before
            how = (lambda pdf: _left_pairs(pdf, least)) if whole else (lambda pdf, turn=turn: _hub_pairs(pdf, turn, least))
            pairs = materialise(_by_bucket(placed, how, "u long, v long").distinct(), "pairs-left") if apart else None
            more = similar(pairs, nodes, docs, size, least) if pairs is not None and pairs.limit(1).count() else None
            if more is not None and more.limit(1).count():
                edges = edges.union(more)
                roots = connected_components(edges)
            if whole:
                break
            before, turn = apart, turn + 1
    known = nodes.select("node", "least").join(roots, "node", "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    known = materialise(known, "roots")
    groups = known.groupBy("root").agg(F.min("least").alias("component_id"))
    named = known.join(groups, "root").select(F.col("node").alias("k"), F.col("root").alias("group"), "component_id")
    return d.select("doc_id", F.col("key").alias("h"), "node").join(named, F.col("node") == F.col("k")).select("doc_id", "h", "group", "component_id")
