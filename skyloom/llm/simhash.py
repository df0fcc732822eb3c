"""SimHash near-duplicates: links at a small Hamming distance found through pivot distance tables.

Fingerprints go to buckets by the pigeonhole principle: two that differ in at most `radius` bits agree on
radius-complement blocks of the 64 bits, so every link shares a bucket.  Inside a bucket each
fingerprint has a row of distances to fixed reference fingerprints; a pair whose rows differ by more
than the radius in any coordinate cannot be a link (triangle inequality) and is discarded; the
survivors are verified.  A search from each fingerprint among those not yet reached keeps a bucket of
near copies linear and emits a spanning forest instead of all pairs.  Copies are one fingerprint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import connected_components, materialise, quoted, small_batches, text_key

SHINGLE, SEED, RADIUS = 4, 42, 4
#: Blocks of the 64 bits; links agree on BLOCKS - RADIUS of them, about 21 bits for 6 blocks.
BLOCKS = 6
PIVOTS = 32
#: Shingles hashed at a time, so that one very long text stays within a few MB.
CHUNK = 1 << 16


def fingerprint(text: str | None, size: int = SHINGLE) -> int:
    """Majority of the bits of the XXH64 of all shingles (fewer words: the whole sequence; none: zero)."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - size + 1)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, CHUNK):
        k = min(CHUNK, n - i)
        a = starts[i:i + k].tolist()
        b = ends[min(size, len(words)) - 1 + i:][:k].tolist()
        h = np.fromiter((xxhash.xxh64_intdigest(joined[x:y], SEED) for x, y in zip(a, b)), np.uint64, k)
        counts += np.unpackbits(h.view(np.uint8).reshape(k, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id, `h` (text_key) and `fp`, the fingerprint as a signed long."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(np.fromiter((fingerprint(t) for t in texts), np.uint64, len(texts)).view(np.int64))

    return docs.select("doc_id", text_key(F.col("text")).alias("h"), of(F.col("text")).alias("fp"))


def block_masks(blocks: int = BLOCKS, radius: int = RADIUS) -> list[int]:
    """Masks of every choice of blocks - radius blocks, as signed longs."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    each = [((1 << (b - a)) - 1) << a for a, b in zip(edges, edges[1:])]
    whole = [sum(c) for c in combinations(each, blocks - radius)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in whole]


def pivots(n: int = PIVOTS) -> np.ndarray:
    return np.random.default_rng(2024).integers(0, 1 << 64, n, dtype=np.uint64)


def _weight(x: np.ndarray) -> np.ndarray:
    return np.bitwise_count(x).astype(np.int8)


def forest(fps: np.ndarray, radius: int = RADIUS, refs: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning edges (indices) of the graph of pairs within `radius`, by pivot tables."""
    refs = pivots() if refs is None else refs
    table = np.stack([_weight(fps ^ r) for r in refs])
    left = np.arange(len(fps))  # not yet reached
    out = []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            i = queue.pop()
            near = left
            for row in table:  # discard by one coordinate after another
                near = near[np.abs(row[near] - row[i]) <= radius]
                if not len(near):
                    break
            near = near[_weight(fps[near] ^ fps[i]) <= radius]
            if len(near):
                out += [(i, int(j)) for j in near]
                queue += near.tolist()
                left = left[~np.isin(left, near, assume_unique=True)]
    return out


def links(fps: DataFrame, blocks: int = BLOCKS, radius: int = RADIUS) -> DataFrame:
    """Edges (u, v) between distinct fingerprints that span every component of the link graph.

    `fps` has distinct non-null `fp`.  Buckets are read as a sorted stream, so Python holds one bucket.
    """
    masks = block_masks(blocks, radius)
    keys = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m)) for m in masks])).alias("choice", "bits")
    spread = fps.select("fp", keys)
    sorted_ = spread.repartition("choice", "bits").sortWithinPartitions("choice", "bits", "fp")

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        refs, held = pivots(), None

        def of(pdf: pd.DataFrame) -> pd.DataFrame:
            c, b, f = (pdf[x].to_numpy() for x in ("choice", "bits", "fp"))
            cut = np.flatnonzero((c[1:] != c[:-1]) | (b[1:] != b[:-1])) + 1
            lo, hi = np.concatenate(([0], cut)), np.concatenate((cut, [len(f)]))
            us, vs = [], []
            for x, y in zip(lo[hi - lo == 2].tolist(), hi[hi - lo == 2].tolist()):
                if bin((int(f[x]) ^ int(f[x + 1])) & (1 << 64) - 1).count("1") <= radius:
                    us.append(f[x]), vs.append(f[x + 1])
            for x, y in zip(lo[hi - lo > 2].tolist(), hi[hi - lo > 2].tolist()):
                for i, j in forest(f[x:y].view(np.uint64), radius, refs):
                    us.append(f[x + i]), vs.append(f[x + j])
            return pd.DataFrame({"u": np.array(us, np.int64), "v": np.array(vs, np.int64)})

        for pdf in batches:
            if not len(pdf):
                continue
            pdf = pdf if held is None else pd.concat([held, pdf], ignore_index=True)
            same = (pdf["choice"] == pdf["choice"].iloc[-1]) & (pdf["bits"] == pdf["bits"].iloc[-1])
            first = int(same.to_numpy().argmax())
            held = pdf.iloc[first:].reset_index(drop=True)
            yield of(pdf.iloc[:first].reset_index(drop=True)) if first else pd.DataFrame({"u": [], "v": []}).astype("int64")
        if held is not None:
            yield of(held)

    return sorted_.mapInPandas(search, "u long, v long").distinct()


def grouped(docs: DataFrame) -> DataFrame:
    """(doc_id, h, fp, group, component_id): one row per document row of (doc_id, text); `h` is text_key, `group` a number that
    linked rows share, component_id the least doc_id reachable.

    Null or empty texts have fingerprint zero and are linked like any other; rows repeating a doc_id are
    documents of their own; null ids take the component's least id (null if it has none).
    """
    d = materialise(with_fingerprint(docs), "fingerprints")
    each = d.groupBy("fp").agg(F.min("doc_id").alias("least"))
    roots = connected_components(links(each.select("fp")))
    known = each.join(roots, each["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    known = materialise(known, "roots")
    groups = known.groupBy("root").agg(F.min("least").alias("component_id"))
    named = known.join(groups, "root").select(F.col("fp").alias("k"), F.col("root").alias("group"), "component_id")
    return d.join(named, d["fp"] == named["k"]).select("doc_id", "h", "fp", "group", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, fp, component_id): see `grouped`."""
    return grouped(docs).select("doc_id", "fp", "component_id")


def simhash_digest(docs: DataFrame) -> DataFrame:
    n = near_duplicates(docs.select("doc_id", "text"))
    return n.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, groups: Callable[[DataFrame], DataFrame] = grouped) -> DataFrame:
    """`docs` with one row of each near-duplicate group; columns unchanged.

    `groups` gives doc_id, h (text_key) and group of (doc_id, text).  The default is op10's contract; the pipeline asks for
    resemblance.near_duplicates.  The row that stays has the group's least doc_id, then the least text key; of rows that
    repeat both, the least hash of their other columns (map columns left out), and of equal rows any.  So an id that several texts
    share loses only the texts that another document repeats.  Rows without an id are groups of their own: no document with an
    id stands for them, and one row of each of their groups stays.
    """
    key = ("missing", "doc_id", "h")
    place = F.struct(F.isnull("doc_id").alias("missing"), "doc_id", "h")
    n = groups(docs.select("doc_id", "text")).withColumn("at", place).groupBy("group", "at").agg(F.count("*").alias("n"))
    best = materialise(n.groupBy("group", "at.missing").agg(F.min(F.struct("at", "n")).alias("best")).select("best.at.*", "best.n"), "kept")
    rows = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), F.isnull("doc_id").alias("missing"), F.col("doc_id"), text_key(F.col("text")).alias("h"))
    same = [rows["missing"] == best["missing"], rows["doc_id"].eqNullSafe(best["doc_id"]), rows["h"] == best["h"]]
    kept = rows.join(best.hint("merge"), same[0] & same[1] & same[2]).select("row", *[rows[c] for c in key], "n")
    if not best.where("n > 1").limit(1).count():
        return kept.select("row.*")
    plain = [f"row.{quoted(f.name)}" for f in docs.schema.fields if "map<" not in f.dataType.simpleString()]
    repeated = kept.where("n > 1").groupBy(*key).agg(F.min_by("row", F.xxhash64(*plain)).alias("row"))
    return kept.where("n = 1").select("row.*").unionByName(repeated.select("row.*"))
