"""Quality classifier by positive-unlabelled learning: the non-negative unbiased risk of a logistic model.

Features describe a whole text: shares of its bytes, of pairs of byte classes, and repetition of its words.
Training sees trusted positives and unlabelled documents only; the class prior is estimated from the labelled sample.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._common import small_batches

#: Bounds of the training sample: trusted positives, unlabelled documents (all text of each).
POSITIVES, UNLABELLED = 3000, 6000
THRESHOLD = 0.7

_CLASSES = np.zeros(256, np.uint8)  # other control, space, newline, lower, upper, digit, then ASCII marks by kind, other bytes
_CLASSES[32], _CLASSES[10] = 1, 2
_CLASSES[97:123], _CLASSES[65:91], _CLASSES[48:58] = 3, 4, 5
for _i, _marks in enumerate((b".,;:?", b"!", b"#$%&*", b"|", b"'\"`", b"()[]{}<>", b"-_=+/\\~^@")):
    _CLASSES[list(_marks)] = 6 + _i
_CLASSES[128:192], _CLASSES[192:] = 13, 14
N_FEATURES = 256 + 225 + 8


def features(text: str | None) -> np.ndarray:
    """Feature vector of a whole text; null and empty texts share one."""
    out = np.zeros(N_FEATURES, np.float32)
    raw = (text or "").encode("utf-8", "surrogatepass")
    if not raw:
        out[-1] = 1
        return out
    b = np.frombuffer(raw, np.uint8)
    out[:256] = np.sqrt(np.bincount(b, minlength=256) / len(b))
    c = _CLASSES[b]
    pairs = np.zeros(225)
    for i in range(0, len(c) - 1, 1 << 20):
        part = c[i:i + (1 << 20) + 1].astype(np.int16)
        pairs += np.bincount(part[:-1] * 15 + part[1:], minlength=225)
    out[256:481] = np.sqrt(pairs / max(1, len(c) - 1))
    words = raw.split()
    if words:
        counts = Counter(words)
        n, top = len(words), counts.most_common(1)[0][1]
        same = sum(x == y for x, y in zip(words, words[1:]))
        distinct = len(counts)
        out[481:488] = (distinct / n, top / n, same / n, np.log(distinct) / np.log(n + 1), min(2, len(raw) / n / 10), min(1, raw.count(b"\n") / n * 5), np.log1p(n) / 10)
    return out


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, rounds: int = 1500, rate: float = 0.02, decay: float = 1e-4) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """(weights, bias, means, deviations) that minimise, over standardised features, the non-negative PU risk of the logistic loss with Adam.

    The risk is prior * R_p(+) + max(0, R_u(-) - prior * R_p(-)); while the part in max() is negative, the step
    climbs it back instead.  Without positives or unlabelled rows the model scores everything at the prior.
    """
    width = N_FEATURES
    if not len(positive) or not len(unlabelled):
        return np.zeros(width), float(np.log(prior / (1 - prior))), np.zeros(width), np.ones(width)
    both = np.concatenate((positive, unlabelled))
    mean, std = both.mean(axis=0, dtype=np.float64), both.std(axis=0, dtype=np.float64)
    std = np.where(std < 1e-4, np.inf, std)  # constant features stay out
    del both
    p, u = np.clip((positive - mean) / std, -5, 5), np.clip((unlabelled - mean) / std, -5, 5)
    w, b = np.zeros(width), float(np.log(prior / (1 - prior)))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -60, 60)))
    for t in range(1, rounds + 1):
        zp, zu = p @ w + b, u @ w + b
        sp, su = sigmoid(zp), sigmoid(zu)
        negative = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        down_u, down_p = su / len(u), prior * sp / len(p)  # gradients of the two parts of `negative`
        g = np.append(u.T @ down_u - p.T @ down_p, down_u.sum() - down_p.sum())
        up = prior * (sp - 1) / len(p)
        g = np.append(p.T @ up, up.sum()) + g if negative >= 0 else -g
        g[:-1] += decay * w
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b, mean, std


class Model:
    """A fitted classifier; small (a few kB), so it travels inside the scoring function."""

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float) -> None:
        self.w, self.b, self.mean, self.std = fit(positive, unlabelled, prior)
        self.prior = prior

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.std, -5, 5) @ self.w + self.b
        return 1 / (1 + np.exp(-np.clip(z, -60, 60)))

    def column(self, text: Column) -> Column:
        @F.pandas_udf("double")
        def of(texts: pd.Series) -> pd.Series:
            out = np.empty(len(texts))
            for i in range(0, len(texts), 1024):
                out[i:i + 1024] = self.score(np.stack([features(t) for t in texts.iloc[i:i + 1024]]))
            return pd.Series(out)

        return of(text)


def fold(doc_id: Column, of: int) -> Column:
    """crc32 of the id's decimal digits, modulo `of`; a null id counts as an empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % of


def _sampled(ids: DataFrame, n: int, seed: int) -> DataFrame:
    """At most n ids, those of least hash."""
    return ids.orderBy(F.xxhash64("doc_id", F.lit(seed)), "doc_id").limit(n)


def train(docs: DataFrame, labels: DataFrame, positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Fit on bounded samples of the training folds: labelled positives, and documents whatever their label.

    The prior is the labelled positives' part of all labelled rows, smoothed, which holds if rows were labelled
    at random; ids with contradicting labels count as negative.  The samples are chosen by a hash of doc_id.
    """
    small_batches(docs.sparkSession)
    trusted = labels.where(fold(F.col("doc_id"), 4) != 2).where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    n = trusted.agg(F.count("*"), F.sum(F.when(F.col("quality") == 1, 1).otherwise(0))).first()
    prior = ((n[1] or 0) + 1) / (n[0] + 2)
    d = docs.select("doc_id", "text").where("doc_id IS NOT NULL").where(fold(F.col("doc_id"), 4) != 2)
    take_p = _sampled(trusted.where("quality = 1").select("doc_id"), positives, 11)
    take_u = _sampled(d.select("doc_id").distinct(), unlabelled, 23)
    chosen = take_p.withColumn("p", F.lit(1)).join(take_u.withColumn("u", F.lit(1)), "doc_id", "full")

    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t).tobytes() for t in texts])

    # broadcast: at most positives + unlabelled short rows
    one = d.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "p", "u").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # an id may repeat
    rows = one.select("p", "u", of("text").alias("x")).toPandas()
    pick = lambda c: np.frombuffer(b"".join(rows.loc[rows[c] == 1, "x"]), np.float32).reshape(-1, N_FEATURES) if (rows[c] == 1).any() else np.empty((0, N_FEATURES))
    return Model(pick("p"), pick("u"), prior)


def quality_digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Contract columns, one row per document row; null text scores as empty text."""
    model = train(docs, labels)
    d = docs.select("doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), model.column(F.col("text")).alias("score"))
    return d.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """`docs` without those that score below the threshold; columns unchanged."""
    model = train(docs, labels)
    return docs.where(model.column(F.col("text")) >= THRESHOLD)
