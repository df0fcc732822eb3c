"""Benchmark decontamination: BM25 over test items with block-max WAND, then verification by word shingles.

The inverted index holds test items.  Weights of an item are divided by its own score, so that a passage with
all its words scores 1 and one threshold serves all items.  Postings come in blocks of consecutive items with their
greatest weight; a passage meets only blocks whose maxima can reach the threshold, and WAND skips inside them.
Items of fewer words than a shingle must occur whole, as a run of words.
"""

from __future__ import annotations

import re
from collections import Counter
from math import ceil, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import small_batches

K1, B = 1.2, 0.75
#: Least normalised BM25 score of a passage, least part of an item's shingles in the text around it, words per shingle.
THRESHOLD, OVERLAP, SHINGLE = 0.6, 0.8, 5
#: Items per index; a larger benchmark is searched index by index.  Blocks of an index.
ITEMS, BLOCKS = 20_000, 32
#: Words of the shortest class of items; items that may be searched for at once.
LIKE, MOST_ITEMS = 256, 1_000_000

_WORD = re.compile(r"\w+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def shingles(words: list[str], size: int = SHINGLE) -> set:
    """Runs of `size` words; of fewer words the whole sequence; of none nothing."""
    return {tuple(words[i:i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


class Index:
    """Block-max inverted index of items (id, words, answer words) under given corpus statistics."""

    def __init__(self, items: list[tuple], df: dict[str, int], n_items: int, mean_length: float) -> None:
        self.items = [(i, shingles(w), answer, w if len(w) < SHINGLE else []) for i, w, answer in items]
        self.longest = max((len(w) for _, w, _ in items), default=1) or 1
        self.per_block = max(8, ceil(len(items) / BLOCKS))
        self.n_blocks = max(1, ceil(len(items) / self.per_block))
        self.terms: dict[str, int] = {}
        self.postings: list[dict[int, list]] = []  # of each term: block -> [(item, weight)]
        for i, (_, words, _) in enumerate(items):
            tf = Counter(words)
            weight = {t: log(1 + (n_items - df[t] + 0.5) / (df[t] + 0.5)) * n * (K1 + 1) / (n + K1 * (1 - B + B * len(words) / mean_length)) for t, n in tf.items()}
            own = sum(weight.values())
            for t, w in weight.items():
                k = self.terms.setdefault(t, len(self.terms))
                if k == len(self.postings):
                    self.postings.append({})
                self.postings[k].setdefault(i // self.per_block, []).append((i, w / own))
        self.maxima = np.zeros((len(self.terms) + 1, self.n_blocks))  # the last row is for words of no item
        for k, p in enumerate(self.postings):
            for block, entries in p.items():
                self.maxima[k, block] = max(w for _, w in entries)

    def wand(self, terms: set[int], block: int, threshold: float) -> list[tuple[int, float]]:
        """All items of a block that score at least `threshold` for a passage with these terms."""
        lists = [(self.postings[t][block], self.maxima[t, block]) for t in terms if block in self.postings[t]]
        at = [0] * len(lists)
        out = []
        while True:
            live = sorted((entries[at[k]][0], k) for k, (entries, _) in enumerate(lists) if at[k] < len(entries))
            bound, pivot = 0.0, None
            for item, k in live:
                bound += lists[k][1]
                if bound >= threshold - 1e-9:
                    pivot = item
                    break
            if pivot is None:
                return out
            if live[0][0] == pivot:  # all lists before the pivot stand on it: score it
                score = 0.0
                for item, k in live:
                    if item != pivot:
                        break
                    score += lists[k][0][at[k]][1]
                    at[k] += 1
                if score >= threshold - 1e-9:
                    out.append((pivot, score))
            else:
                for item, k in live:
                    if item >= pivot:
                        break
                    entries = lists[k][0]
                    while at[k] < len(entries) and entries[at[k]][0] < pivot:
                        at[k] += 1

    def passages(self, ids: np.ndarray, threshold: float) -> list[tuple[int, int]]:
        """(passage, block) pairs whose maxima can reach the threshold.  Passage k holds words [k, k + 2) * longest, so
        every run of words as long as an item lies in one; a repeated word counts more than once here, never less."""
        step, sums = self.longest, []
        rows = max(1, (1 << 16) // step) * step
        for lo in range(0, len(ids), rows):
            part = ids[lo:lo + rows]
            sums.append(np.add.reduceat(self.maxima[part], np.arange(0, len(part), step), axis=0))
        s = np.concatenate(sums)
        if len(s) > 1:
            s = s[:-1] + s[1:]
        out = []
        for k in np.flatnonzero((s >= threshold - 1e-9).any(axis=1)).tolist():  # again with each word once
            once = self.maxima[np.unique(ids[k * step:(k + 2) * step])].sum(axis=0)
            out += [(k, b) for b in np.flatnonzero(once >= threshold - 1e-9).tolist()]
        return out

    def search(self, words: list[str], threshold: float = THRESHOLD, overlap: float = OVERLAP) -> dict[int, tuple[float, float]]:
        """Verified items of a text: item -> (best BM25 score, best overlap)."""
        if not words or not self.terms:
            return {}
        get, none = self.terms.get, len(self.terms)
        ids = np.fromiter((get(w, none) for w in words), np.int64, len(words))
        out: dict[int, tuple[float, float]] = {}
        step = self.longest
        last, around, have = None, [], set()
        for k, block in self.passages(ids, threshold):
            terms = set(ids[k * step:(k + 2) * step].tolist()) - {none}
            for item, score in self.wand(terms, block, threshold):
                if k != last:
                    last, around = k, words[max(0, (k - 1) * step):(k + 3) * step]
                    have = shingles(around)
                _, wanted, answer, short = self.items[item]
                share = float(_holds(around, short)) if short else len(wanted & have) / len(wanted)
                if share >= overlap and (not answer or _holds(around, answer)):
                    old = out.get(item, (0.0, 0.0))
                    out[item] = (max(old[0], score), max(old[1], share))
        return out


def _holds(words: list[str], run: list[str]) -> bool:
    return any(words[i:i + len(run)] == run for i in range(len(words) - len(run) + 1))


def build(items: DataFrame, limit: int = ITEMS) -> list[Index]:
    """Indexes over all items (item_id, text, and answer where there is one), `limit` items each at most, of like lengths: an index's
    passages are as long as its longest item.

    Statistics are those of the whole benchmark whatever the number of indexes.  Items without words match nothing.  All indexes are
    held by every Python worker at once, so a benchmark of more than MOST_ITEMS is refused: it is to be searched in parts.
    """
    has_answer = "answer" in items.columns
    d = items.select("item_id", "text", *(["answer"] if has_answer else [])).where("text IS NOT NULL")

    @F.pandas_udf("array<string>")
    def of(texts: pd.Series) -> pd.Series:
        return texts.map(words_of)

    d = d.withColumn("words", of("text")).where(F.size("words") > 0).withColumn("turn", F.xxhash64("item_id", "text"))
    n, total = d.agg(F.count("*"), F.sum(F.size("words"))).first()
    if n > MOST_ITEMS:
        raise ValueError(f"{n} items; search at most {MOST_ITEMS} at a time")
    out = []
    lengths = F.greatest(F.lit(0), F.ceil(F.log2(F.size("words") / LIKE) / 2)).cast("int")  # up to LIKE words, then fourfold classes
    d = d.withColumn("class", lengths)
    classes = sorted((r["class"], max(1, ceil(r["count"] / limit))) for r in d.groupBy("class").count().collect()) if n else []
    frequency = d.select(F.explode(F.array_distinct("words")).alias("word")).groupBy("word").count()
    for c, turn, turns in ((c, turn, turns) for c, turns in classes for turn in range(turns)):
        mine = d.where(F.col("class") == c).where(F.pmod("turn", F.lit(turns)) == turn)
        rows = sorted(((r["item_id"], r["words"], words_of(r["answer"]) if has_answer else []) for r in mine.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        mine_words = mine.select(F.explode("words").alias("word")).distinct()
        df = {r["word"]: r["count"] for r in frequency.join(mine_words, "word", "left_semi").collect()}
        out.append(Index(rows, df, n, total / n))
    return out


FOUND = "array<struct<item_id:bigint,score:double,overlap:double>>"


def matches(text: Column, docs: DataFrame, indexes: list[Index]) -> Column:
    """Verified items of each text as array<struct<item_id, score, overlap>>; null and empty texts have none."""
    spark = docs.sparkSession
    small_batches(spark)

    def one(index: Index) -> Column:
        shared = spark.sparkContext.broadcast(index)  # bounded: `limit` items

        @F.pandas_udf(FOUND)
        def of(texts: pd.Series) -> pd.Series:
            index = shared.value
            return pd.Series([[{"item_id": index.items[i][0], "score": s, "overlap": o} for i, (s, o) in sorted(index.search(words_of(t)).items())] for t in texts])

        return of(text)

    return F.concat(*map(one, indexes)) if indexes else F.array().cast(FOUND)


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, score, overlap): a row for each document row and test item found in it, over whole texts."""
    d = docs.select("doc_id", "text")
    found = d.select("doc_id", F.explode(matches(F.col("text"), d, build(items))).alias("m"))
    return found.select("doc_id", "m.item_id", "m.score", "m.overlap")


def keep_clean(docs: DataFrame, items: DataFrame) -> DataFrame:
    """`docs` without those that hold a test item; columns unchanged."""
    return docs.where(F.size(matches(F.col("text"), docs, build(items))) == 0)
