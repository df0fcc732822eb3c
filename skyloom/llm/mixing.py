"""Source mixing: temperature weights under a target entropy or repetition limit, realised as block permutations.

Shares p of the sources' tokens become weights proportional to p^a.  The exponent a is bisected in SQL.
A source's token budget is spent on whole permutations of its documents (epochs) and the head of a
last one; block b of the result takes from each source the part of its budget that b is due.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import materialise, quoted

#: Bisection steps; sources beyond MAX_SOURCES raise, since weights are worked out in one row.
STEPS, MAX_SOURCES = 60, 1_000_000


def n_tokens(text: Column) -> Column:
    """White-space words, null as empty."""
    trimmed = F.regexp_replace(F.coalesce(text, F.lit("")), r"^[ \t\n\x0B\f\r]+", "")
    return F.when(trimmed == "", F.lit(0)).otherwise(F.size(F.split(F.regexp_replace(trimmed, r"[ \t\n\x0B\f\r]+$", ""), r"[ \t\n\x0B\f\r]+"))).cast("long")


def weights(counts: DataFrame, entropy: float | None = 0.95, repeats: float | None = None, budget: int | None = None) -> DataFrame:
    """One row per source: `source`, `n_docs`, `tokens`, `share`, `exponent`, `weight`, `budget` (tokens to take).

    `counts` has source (null is a source of its own), n_docs and tokens.  `entropy`: target as part of log(sources);
    the largest exponent in [0, 1] whose weights have at least that entropy.  `repeats`: no source may be
    taken more often than this; the smallest exponent in [0, 1] that keeps to it (1 if none does, when
    the budget itself exceeds the limit).  With both, the larger exponent: the limit wins.  `budget` defaults
    to all tokens.  A source without tokens has weight 0; an empty table gives no rows.
    """
    total = F.aggregate("all", F.lit(0).cast("double"), lambda a, s: a + s["tokens"])
    d = counts.select(F.struct("source", "n_docs", "tokens").alias("s")).agg(F.sort_array(F.collect_list("s")).alias("all"), F.count("*").alias("n"))
    d = d.withColumn("all", F.when(F.col("n") <= MAX_SOURCES, F.col("all")).otherwise(F.raise_error(F.lit(f"over {MAX_SOURCES} sources"))))
    d = d.withColumn("total", total).withColumn("to_take", F.col("total") if budget is None else F.lit(float(budget)))
    d = d.withColumn("p", F.transform(F.filter("all", lambda s: s["tokens"] > 0), lambda s: s["tokens"] / F.col("total")))
    zero, one = F.lit(0.0), F.lit(1.0)

    def add(xs: Column) -> Column:
        return F.aggregate(xs, zero, lambda a, x: a + x)

    def powers(a: Column) -> Column:
        return F.transform("p", lambda x: F.pow(x, a))

    def entropy_of(a: Column) -> Column:  # log Z - (sum p^a log p^a) / Z
        z = add(powers(a))
        return F.log(z) - add(F.transform("p", lambda x: F.pow(x, a) * a * F.log(x))) / z

    def most_repeats(a: Column) -> Column:  # weight * budget / tokens, greatest over sources
        z = add(powers(a))
        return F.array_max(F.transform("p", lambda x: F.pow(x, a) / z * F.col("to_take") / (x * F.col("total"))))

    def bisect(low_side) -> Column:
        """The exponent where low_side(a) turns from true to false; (low, high) halves STEPS times."""
        start = F.struct(zero.alias("lo"), one.alias("hi"))
        mid = lambda s: (s["lo"] + s["hi"]) / 2
        step = lambda s, _: F.when(low_side(mid(s)), F.struct(mid(s).alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), mid(s).alias("hi")))
        return F.aggregate(F.sequence(F.lit(1), F.lit(STEPS)), start, step)

    some = F.size("p") > 0
    parts = []
    if entropy is not None:
        aim = F.lit(entropy) * F.log(F.size("p").cast("double"))
        parts.append(F.when(entropy_of(one) >= aim, one).otherwise(bisect(lambda a: entropy_of(a) >= aim)["lo"]))
    if repeats is not None:
        parts.append(F.when(most_repeats(zero) <= repeats, zero).otherwise(bisect(lambda a: most_repeats(a) > repeats)["hi"]))
    exponent = F.lit(1.0) if not parts else parts[0] if len(parts) == 1 else F.greatest(*parts)
    d = d.withColumn("exponent", F.when(some, exponent))
    d = d.withColumn("z", add(powers(F.col("exponent")))).withColumn("s", F.explode("all"))
    share = F.when(F.col("total") > 0, F.col("s.tokens") / F.col("total")).otherwise(0.0)
    weight = F.when(F.col("s.tokens") > 0, F.pow(share, F.col("exponent")) / F.col("z")).otherwise(0.0)
    return d.select("s.source", "s.n_docs", "s.tokens", share.alias("share"), "exponent", weight.alias("weight"), F.round(weight * F.col("to_take")).cast("long").alias("budget"))


def _numbered(docs: DataFrame) -> DataFrame:
    """A written copy of `docs` as (`row`, `number`, doc_id, source, n_tokens, `key`); number is one row's own."""
    d = docs.select(F.struct(*[F.col(quoted(c)) for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("number"), "doc_id",
                    F.col("source").cast("string").alias("source"), n_tokens(F.col("text")).alias("n_tokens"), F.xxhash64("text").alias("key"))
    return materialise(d, "mix-docs")


def _picked(slim: DataFrame, entropy: float | None, repeats: float | None, budget: int | None, block_tokens: int, seed: int, bucket_docs: int) -> tuple[DataFrame, DataFrame]:
    counts = slim.groupBy("source").agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("tokens"))
    w = materialise(weights(counts, entropy, repeats, budget), "mix-weights")
    plan = w.where("budget > 0").select(F.col("source").alias("w_source"), "tokens", "budget", "weight", F.ceil(F.col("budget") / F.col("tokens")).cast("int").alias("epochs"),
                                        F.greatest(F.lit(1), F.ceil(F.col("n_docs") / bucket_docs)).cast("long").alias("buckets"))
    due = slim.join(F.broadcast(plan), slim["source"].eqNullSafe(plan["w_source"])).drop("w_source")  # bounded: MAX_SOURCES short rows
    each = due.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.col("epochs") - 1)))
    # rows without an id may be many and alike, so their own numbers deal them
    each = each.withColumn("h", F.shiftrightunsigned(F.xxhash64(F.lit(seed), "epoch", "doc_id", "n_tokens", "key", F.when(F.isnull("doc_id"), F.col("number"))), 1))
    each = each.withColumn("bucket", F.least(F.col("buckets") - 1, F.floor(F.col("h") / F.lit(float(2**63)) * F.col("buckets")).cast("long")))
    sums = each.groupBy("source", "epoch", "bucket").agg(F.sum("n_tokens").alias("held"))
    # one row per some thousand documents and epoch; the running sum per source and epoch goes over those alone
    before = "sum(held) OVER (PARTITION BY source, epoch ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    base = sums.select(F.col("source").alias("b_source"), F.col("epoch").alias("b_epoch"), F.col("bucket").alias("b_bucket"), F.expr(f"coalesce({before}, 0)").alias("before"))
    inside = "sum(n_tokens) OVER (PARTITION BY source, epoch, bucket ORDER BY h, doc_id, n_tokens, key, number ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    placed = each.withColumn("inside", F.expr(f"coalesce({inside}, 0)"))
    placed = placed.join(base, placed["source"].eqNullSafe(base["b_source"]) & (placed["epoch"] == base["b_epoch"]) & (placed["bucket"] == base["b_bucket"]))
    placed = placed.withColumn("place", F.col("epoch") * F.col("tokens") + F.col("before") + F.col("inside")).where("place < budget")
    block = F.floor(F.col("place") / (F.col("weight") * block_tokens)).cast("long")
    return placed.select("number", "doc_id", "source", "n_tokens", "epoch", block.alias("block"), "place"), w


def mix(docs: DataFrame, entropy: float | None = 0.95, repeats: float | None = None, budget: int | None = None, block_tokens: int = 200_000,
        seed: int = 17, bucket_docs: int = 4096) -> tuple[DataFrame, DataFrame]:
    """(picks, weights).  picks: one row per document taken and epoch: doc_id, source, n_tokens, epoch, block, place.

    An epoch orders a source's documents by a seeded hash; `place` is the tokens its source has spent before it,
    and `block` the block whose due part of the budget that falls in.  A document is taken while its place is below
    the budget, so a source overshoots by less than one document; documents without tokens are taken
    whenever their place comes.  Places come from per-bucket sums (a bucket holds about `bucket_docs`
    documents of one source by hash range), so a source of any size is spread over many tasks.
    Null ids and repeated rows are ordinary documents, each with picks of its own; ties in the hash go by doc_id, then text.
    """
    slim = docs.select(F.monotonically_increasing_id().alias("number"), F.col("doc_id"), F.col("source").cast("string").alias("source"), n_tokens(F.col("text")).alias("n_tokens"), F.xxhash64("text").alias("key"))
    picks, w = _picked(materialise(slim, "mix-docs"), entropy, repeats, budget, block_tokens, seed, bucket_docs)
    return picks.drop("number"), w


def mixed_documents(docs: DataFrame, entropy: float | None = 0.95, repeats: float | None = None, budget: int | None = None, block_tokens: int = 200_000,
                    seed: int = 17, bucket_docs: int = 4096) -> DataFrame:
    """The rows as often as they are taken, with `mix_epoch`, `mix_block` and `mix_place`; other columns stay (those of these three
    names are replaced).

    Every row has picks of its own, so rows that repeat each other, or have no id, together keep to the budget.  Within a block, order
    by a hash of doc_id and epoch to interleave the sources.
    """
    d = _numbered(docs)
    picks, _ = _picked(d.drop("row"), entropy, repeats, budget, block_tokens, seed, bucket_docs)
    picks = picks.select(F.col("number").alias("picked"), F.col("epoch").alias("mix_epoch"), F.col("block").alias("mix_block"), F.col("place").alias("mix_place"))
    rows = d.select("row", "number").join(picks.hint("merge"), F.col("number") == F.col("picked"))
    new = ["mix_epoch", "mix_block", "mix_place"]
    return rows.select(*[F.col(f"row.{quoted(c)}").alias(c) for c in docs.columns if c not in new], *new)


def mix_digest(docs: DataFrame) -> DataFrame:
    """The operator over a whole table with production parameters: the picks with the weight of their source."""
    picks, w = mix(docs, entropy=0.95, repeats=4.0)
    w = w.select(F.col("source").alias("w_source"), F.round("weight", 9).alias("weight"), F.round("exponent", 9).alias("exponent"))
    return picks.join(F.broadcast(w), picks["source"].eqNullSafe(w["w_source"])).drop("w_source")
