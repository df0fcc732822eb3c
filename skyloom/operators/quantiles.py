"""Exact percentiles of a column of any size."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import cut

#: Distinct values (about) up to which one aggregation buffer holds them all.
BUFFERED = 1_000_000


def percentiles(df: DataFrame, value: Column, at: list[float], buffered: int = BUFFERED) -> DataFrame:
    """One row with `q`, the exact percentiles (linear between neighbours) of the values that are not null; null if there are none.

    The built-in aggregate keeps all distinct values in one buffer.  With more than `buffered` of them, the values and their counts are
    dealt to ranges instead, and only the ranges' sizes and the values at the wanted places come to the driver.  Both ways agree.
    """
    v = df.select(value.cast("double").alias("v")).where("v IS NOT NULL")
    if v.agg(F.approx_count_distinct("v")).first()[0] <= buffered:
        return v.agg(F.percentile("v", F.array(*[F.lit(float(p)) for p in at])).alias("q"))
    counts = v.groupBy("v").agg(F.count("*").alias("c"))
    counts = cut(counts.repartitionByRange("v").withColumn("p", F.spark_partition_id()))
    sizes = sorted((r["p"], r["n"]) for r in counts.groupBy("p").agg(F.sum("c").alias("n")).collect())  # a row a range
    ends = list(accumulate(n for _, n in sizes))
    spots = [p * (ends[-1] - 1) for p in at]
    wanted = sorted({min(int(s) + i, ends[-1] - 1) for s in spots for i in (0, 1)})
    by_range: dict[int, list[int]] = {}
    for k in wanted:
        i = bisect_right(ends, k)
        by_range.setdefault(sizes[i][0], []).append(k - (ends[i - 1] if i else 0))
    to = F.sum("c").over(Window.partitionBy("p").orderBy("v"))
    placed = counts.where(F.col("p").isin(*by_range)).select("p", "v", "c", to.alias("to"))
    holds = [(F.col("p") == p) & (F.col("to") > k) & (F.col("to") - F.col("c") <= k) for p, ks in by_range.items() for k in ks]
    found = placed.select("v", F.explode(F.array(*[F.when(h, i) for i, h in enumerate(holds)])).alias("i")).where("i IS NOT NULL")
    values = dict(zip(wanted, (r["v"] for r in found.orderBy("i").collect())))  # two a percentile at most
    out = []
    for s in spots:
        low, high = values[int(s)], values[min(int(s) + 1, ends[-1] - 1)]
        out.append(low if low == high else (int(s) + 1 - s) * low + (s - int(s)) * high)
    return df.sparkSession.createDataFrame([(out,)], "q array<double>")


def percentile(df: DataFrame, value: Column, at: float, to: str, buffered: int = BUFFERED) -> DataFrame:
    """One row with the percentile as column `to`."""
    return percentiles(df, value, [at], buffered).select(F.col("q")[0].alias(to))
