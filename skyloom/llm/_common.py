"""Helpers shared by the corpus operators."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession, tag: str) -> str:
    """A fresh path in the folder that the driver and all executors share (spark.checkpoint.dir); a local session may leave it unset."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="skyloom-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{tag}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, tag: str) -> DataFrame:
    """Write `df` to the shared folder and read it again: cuts lineage and survives lost executors."""
    path = shared_dir(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Let Arrow batches to Python workers hold at most `most` bytes: whole texts make batches of the default size large, in the JVM's
    direct buffers and in the workers.  A session that asks for less keeps its own setting."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    number, unit = re.fullmatch(r"(-?\d+)\s*([kmgtp]?)b?", spark.conf.get(key).strip().lower()).groups()
    now = int(number) << 10 * " kmgtp".index(unit or " ")
    if not 0 < now <= most:
        spark.conf.set(key, f"{most}b")


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_key(text: Column) -> Column:
    """A struct of two 64-bit hashes that stands for a text; null has one of its own."""
    return F.struct(F.xxhash64(text, F.isnull(text)).alias("a"), F.xxhash64(F.lit(29), text).alias("b"))


def spare(df: DataFrame, n: int) -> list[str]:
    """`n` column names that `df` doesn't use."""
    return [f"__{uuid.uuid4().hex}" for _ in range(n)]


def bound(value: Column, of: Callable[[Column], Column]) -> Column:
    """`of(value)` with `value` worked out once: inside lambdas Spark repeats any expression that is not a variable."""
    return F.element_at(F.transform(F.array(value), of), 1)


def _folded(a: Column, op: Callable[[Column, Column], Column]) -> Column:
    return F.aggregate(F.slice(a, 2, F.size(a)), F.element_at(a, 1), op)


def running(values: Column, op: Callable[[Column, Column], Column], block: int = 64) -> Column:
    """Inclusive running folds of an array<long> under an associative `op`; an empty array stays empty.

    Blocks of `block`, then blocks of blocks: n * block / 2 steps and a square term only in n / block^2.
    """
    def short(a: Column) -> Column:
        return F.transform(a, lambda _, i: _folded(F.slice(a, 1, i + 1), op))

    def level(a: Column, inner: Callable[[Column], Column]) -> Column:
        n = F.ceil(F.size(a) / block).cast("int")
        cut = F.transform(F.sequence(F.lit(1), n), lambda b: F.slice(a, (b - 1) * block + 1, block))

        def joined(blocks: Column) -> Column:
            within = F.transform(blocks, short)
            before = inner(F.transform(blocks, lambda x: _folded(x, op)))
            return bound(before, lambda t: F.flatten(F.transform(within, lambda w, i: F.when(i == 0, w).otherwise(F.transform(w, lambda x: op(F.get(t, i - 1), x))))))

        return bound(cut, joined)

    return bound(values, lambda v: F.when(F.size(v) == 0, v).otherwise(level(v, lambda t: bound(t, lambda u: level(u, lambda x: bound(x, short))))))


def running_totals(values: Column) -> Column:
    """Inclusive running totals of an array<long>."""
    return running(values, lambda x, y: x + y)


#: Code points of the two sizes of chunk that `pieces` cuts a text into.
_LARGE, _SMALL = 1 << 18, 1 << 12


def pieces(text: Column, spans: Column) -> Column:
    """The substrings [start, end) of `text` for array<struct<start, end, ...>>, in code points.

    substr counts from the start of its string, so the text is first cut into chunks, large ones and those into small ones.
    """
    def cut(t: Column, size: int) -> Column:
        return F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.ceil(F.length(t) / size).cast("int") - 1)), lambda i: t.substr(i * size + 1, F.lit(size)))

    def one(chunks: Column, s: Column) -> Column:
        a, b = s["start"].cast("int"), s["end"].cast("int")
        i, j = F.floor(a / _SMALL).cast("int"), F.floor(b / _SMALL).cast("int")
        here = F.get(chunks, i)
        tail = F.when(b % _SMALL > 0, F.get(chunks, j).substr(F.lit(1), b % _SMALL)).otherwise("")
        between = F.when(j > i + 1, F.array_join(F.slice(chunks, i + 2, j - i - 1), "")).otherwise("")
        return F.when(a >= b, "").when(i == j, here.substr(a % _SMALL + 1, b - a)).otherwise(F.concat(here.substr(a % _SMALL + 1, F.lit(_SMALL)), between, tail))

    small = F.flatten(F.transform(bound(text, lambda t: cut(t, _LARGE)), lambda t: cut(t, _SMALL)))
    return bound(spans, lambda ss: F.when(F.size(ss) == 0, F.array().cast("array<string>")).otherwise(bound(small, lambda c: F.transform(ss, lambda s: one(c, s)))))


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) for each node of `edges` (u, v), root the least node of its component.

    Alternating large-star and small-star steps, each written to the shared folder; the edge set
    becomes one star per component.  Degrees shrink to one, so no step holds a whole component.
    """
    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.min("v").alias("m"))

    def step(e: DataFrame) -> DataFrame:
        both = e.select("u", "v").union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        m = least(both).select("u", F.least("u", "m").alias("m"))
        large = both.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u > v").distinct()
        m2 = least(large)
        near = large.join(m2, "u")
        small = near.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        return small.union(m2.select("u", F.col("m").alias("v"))).distinct()

    def mark(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    e = materialise(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "edges")
    seen = mark(e)
    for _ in range(rounds if seen[0] else 0):
        e = materialise(step(e), "edges")
        now = mark(e)
        if now == seen:
            break
        seen = now
    else:
        if seen[0]:
            raise RuntimeError(f"components did not settle in {rounds} rounds")
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
