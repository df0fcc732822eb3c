"""Language identification by unigram piece models, summed over all segmentations of a text.

Pieces are the byte strings of a fixed public vocabulary.  P(text | language) is a product over words of the sum, over
all ways to cut a word into pieces, of the product of piece probabilities, computed by a forward
recursion.  Piece probabilities are trained per language by expectation-maximisation on word counts.
"""

from __future__ import annotations

import base64
import uuid
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import spare
from .quality import fold

VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Training documents per language (chosen by a hash of doc_id, whole texts), rounds of EM.
SAMPLE, ROUNDS = 400, 2
#: In training alone, words of more bytes are cut into parts of that length; scores sum over all segmentations of whole words.
CUT = 48
#: Words kept in a worker's cache of word scores, and the longest word there; longer words go one by one, BLOCK bytes at a time.
CACHE, LONG, BLOCK = 200_000, 256, 1 << 16
#: Numbers (bytes of words, and alphas) that a batch of words may fill; languages a model may have.
CELLS, ALPHAS, MOST = 1 << 20, 1 << 23, 1000
UNKNOWN = "und"


def load_vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """All pieces of a rank file, read on the driver; single bytes always included."""
    with open(path, "rb") as f:
        pieces = {base64.b64decode(line.split()[0]) for line in f if line.strip()}
    return sorted(pieces | {bytes([i]) for i in range(256)})


def words_of(text: str | None, cut: int | None = None) -> list[bytes]:
    """Lower-cased words, each with a space before it; those over `cut` bytes in parts."""
    out = [b" " + w for w in (text or "").lower().encode("utf-8", "surrogatepass").split()]
    return out if cut is None else [w[i:i + cut] for w in out for i in range(0, len(w), cut)]


class Lattice:
    """Finds pieces inside many words at once by hashing byte strings into an open table."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.pieces = pieces
        # a word has white space only before it, so pieces with more of it occur in none
        self.sizes = sorted({len(p) for p in pieces if len(p) == 1 or len((p[1:] if p[:1] == b" " else p).split()) == 1 and not p[-1:].isspace()})
        self.longest = self.sizes[-1]
        self.powers = np.array([pow(0x100000001B3, i, 1 << 64) for i in range(max(map(len, pieces)) + 1)], np.uint64)
        h = np.array([self._hash(p) for p in pieces], np.uint64)
        self.order = np.argsort(h)
        self.hashes = h[self.order]
        if (self.hashes[1:] == self.hashes[:-1]).any():
            raise ValueError("two pieces share a hash")
        self.bits = 20
        slot = (self.hashes >> np.uint64(64 - self.bits)).astype(np.int64)
        self.first = np.searchsorted(slot, np.arange((1 << self.bits) + 1)).astype(np.int32)
        self.deepest = int(np.diff(self.first).max())

    def _hash(self, p: bytes) -> int:
        h = 0
        for c in p:
            h = (h * 0x100000001B3 + c + 1) & (1 << 64) - 1
        return self._mix(h * (2 * len(p) + 1) & (1 << 64) - 1)

    @staticmethod
    def _mix(h: int) -> int:
        h = (h ^ h >> 32) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
        return h ^ h >> 29

    def ids(self, h: np.ndarray, size: int) -> np.ndarray:
        """Piece numbers of hashed strings of `size` bytes, -1 if none."""
        h = h * np.uint64(2 * size + 1)
        h = (h ^ (h >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15)
        h = h ^ (h >> np.uint64(29))
        slot = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, stop = self.first[slot], self.first[slot + 1]
        out = np.full(len(h), -1, np.int32)
        for _ in range(self.deepest):
            safe = np.minimum(at, len(self.hashes) - 1)
            hit = (at < stop) & (self.hashes[safe] == h)
            out[hit] = self.order[safe[hit]]
            at = at + 1
        return out

    def arcs(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, dict]:
        """(order, lengths, arcs): words sorted by falling length; arcs[(end, size)] numbers the piece of `size` bytes that ends at `end` in each word of at least that length."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-sizes, kind="stable")
        sizes = sizes[order]
        wide = int(sizes[0]) if len(sizes) else 0
        grid = np.zeros((len(words), wide), np.uint8)
        flat = np.frombuffer(b"".join(words[i] for i in order.tolist()), np.uint8)
        grid[np.arange(wide) < sizes[:, None]] = flat
        sums = np.zeros((wide + 1, len(words)), np.uint64)
        for j in range(wide):
            sums[j + 1] = sums[j] * np.uint64(0x100000001B3) + grid[:, j] + np.uint64(1)
        found = {}
        for end in range(1, wide + 1):
            n = int(np.searchsorted(-sizes, -end, side="right"))
            for size in self.up_to(end):
                found[end, size] = self.ids(sums[end, :n] - sums[end - size, :n] * self.powers[size], size)
        return order, sizes, found

    def up_to(self, end: int) -> list[int]:
        return self.sizes[:bisect_right(self.sizes, end)]

    def batches(self, words: list[bytes], width: int) -> Iterator[np.ndarray]:
        """Numbers of words, by length, so that a batch's grid and its alphas (`width` to a byte) stay bounded."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(sizes, kind="stable")
        at = 0
        while at < len(order):
            n = max(1, min(CELLS, ALPHAS // max(1, width)) // int(sizes[order[min(at + 20_000, len(order)) - 1]]))
            yield order[at:at + min(n, 20_000)]
            at += min(n, 20_000)

    def forward(self, words: list[bytes], logs: np.ndarray) -> np.ndarray:
        """log P(word | language) of each word, summed over segmentations; logs: pieces x languages, -inf where a language lacks one."""
        out = np.zeros((len(words), logs.shape[1]))
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        for batch in self.batches([words[i] for i in short], logs.shape[1]):
            batch = np.array(short)[batch]
            order, sizes, arcs = self.arcs([words[i] for i in batch.tolist()])
            alpha = self._alphas(sizes, arcs, logs)
            out[batch[order]] = alpha[sizes, np.arange(len(batch))]
        p = np.exp(logs)
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self.forward_long(w, p)
        return out

    def forward_long(self, word: bytes, p: np.ndarray) -> np.ndarray:
        """The same for one word of any length, by blocks; what is kept is as long as a block and the longest piece."""
        wide = self.longest
        alpha = np.zeros((wide, p.shape[1]))  # alphas of the last bytes before a block, all scaled by one logarithm per language
        alpha[-1] = 1
        log = np.zeros(p.shape[1])
        for lo in range(0, len(word), BLOCK):
            hi = min(lo + BLOCK, len(word))
            back = min(lo, wide)
            data = np.frombuffer(word[lo - back:hi], np.uint8)
            ends, sizes, ids = [], [], []
            h = np.zeros(len(data) + 1, np.uint64)
            for size in range(1, wide + 1):  # hash of the `size` bytes before each end
                h = np.concatenate((np.zeros(1, np.uint64), h[:-1] * np.uint64(0x100000001B3) + data + np.uint64(1)))
                if size in self.sizes:
                    i = self.ids(h[back + 1:], size)
                    hit = np.flatnonzero((i >= 0) & (np.arange(lo + 1, hi + 1) >= size))
                    ends.append(hit), sizes.append(np.full(len(hit), size)), ids.append(i[hit])
            ends, sizes, ids = np.concatenate(ends), np.concatenate(sizes), np.concatenate(ids)
            order = np.argsort(ends, kind="stable")
            ends, sizes, probs = ends[order], sizes[order], p[ids[order]]
            first = np.searchsorted(ends, np.arange(hi - lo + 1)).tolist()
            alpha = np.concatenate((alpha[-wide:], np.zeros((hi - lo, p.shape[1]))))
            for e in range(hi - lo):
                a, b = first[e], first[e + 1]
                got = (alpha[wide + e - sizes[a:b]] * probs[a:b]).sum(axis=0)
                alpha[wide + e] = got
                if e % 8 == 0 and (got < 1e-100).any():  # scale all that later bytes can reach
                    most = np.maximum(alpha[max(0, e + 1):wide + e + 1].max(axis=0), 1e-300)
                    alpha[max(0, e + 1):wide + e + 1] /= most
                    log += np.log(most)
        with np.errstate(divide="ignore"):
            return np.log(np.maximum(alpha[-1], 1e-300)) + log

    def _alphas(self, sizes: np.ndarray, arcs: dict, logs: np.ndarray) -> np.ndarray:
        with_none = np.vstack((np.exp(logs), np.zeros((1, logs.shape[1]))))  # row -1: no piece
        wide = int(sizes[0])
        alpha = np.zeros((wide + 1, len(sizes), logs.shape[1]))
        scale = np.zeros((wide + 1, len(sizes), 1))  # alpha is kept near 1 by a logarithm per position
        alpha[0] = 1
        for end in range(1, wide + 1):
            n = len(arcs[end, 1])
            top = scale[end - 1, :n]
            total = np.zeros((n, logs.shape[1]))
            for size in self.up_to(end):
                i = arcs[end, size]
                hit = np.flatnonzero(i >= 0)
                total[hit] += alpha[end - size, hit] * with_none[i[hit]] * np.exp(scale[end - size, hit] - top[hit])
            most = np.maximum(total.max(axis=1, keepdims=True), 1e-300)
            alpha[end, :n] = total / most
            scale[end, :n] = top + np.log(most)
        with np.errstate(divide="ignore"):
            return np.log(np.maximum(alpha, 1e-300)) + scale

    def expected(self, words: list[bytes], weights: np.ndarray, logs: np.ndarray) -> np.ndarray:
        """Expected number of uses of each piece, over all segmentations of weighted words, under one language (logs: pieces)."""
        out = np.zeros(len(self.pieces))
        for batch in self.batches(words, 2):
            some = [words[i] for i in batch.tolist()]
            order, sizes, arcs = self.arcs(some)
            weight = weights[batch[order]]
            fwd = self._alphas(sizes, arcs, logs[:, None])[:, :, 0]
            wide, p = int(sizes[0]), np.exp(logs)
            back = np.full((wide + 1, len(some)), -np.inf)
            back[sizes, np.arange(len(some))] = 0
            whole = fwd[sizes, np.arange(len(some))]
            for end in range(wide, 0, -1):
                n = len(arcs[end, 1])
                for size in self.up_to(end):
                    i = arcs[end, size]
                    hit = np.flatnonzero(i >= 0)
                    step = np.log(np.maximum(p[i[hit]], 1e-300)) + back[end, hit]
                    back[end - size, hit] = np.logaddexp(back[end - size, hit], step)
                    np.add.at(out, i[hit], weight[hit] * np.exp(np.minimum(0, fwd[end - size, hit] + step - whole[hit])))
        return out


def fit(words: list[bytes], counts: np.ndarray, lattice: Lattice, rounds: int = ROUNDS, smooth: float = 0.05) -> np.ndarray:
    """Log probabilities of all pieces for one language, from its word counts by EM with additive smoothing."""
    logs = np.full(len(lattice.pieces), -np.log(len(lattice.pieces)))  # a flat start
    for _ in range(rounds):
        uses = lattice.expected(words, counts, logs) + smooth
        logs = np.log(uses / uses.sum())
    return logs


def train(docs: DataFrame, pieces: list[bytes], sample: int = SAMPLE, rounds: int = ROUNDS) -> tuple[list[str], np.ndarray]:
    """(languages, logs: pieces x languages) from labelled documents (text, lang, doc_id) outside the held-out fold.

    About `sample` documents per language take part, those whose id hashes low; an executor trains each language.
    """
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL").where(fold(F.col("doc_id"), 3) != 1).select("doc_id", "lang", "text")
    sizes = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # a row per language
    if len(sizes) > MOST:
        raise ValueError(f"{len(sizes)} languages; a model holds {MOST}")
    if not sizes:
        return [], np.zeros((len(pieces), 0))
    share = F.coalesce(*[F.when(F.col("lang") == k, F.lit(min(1.0, sample / n))) for k, n in sizes.items()])
    low = F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) / float(1 << 30)
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(pieces)  # bounded: the vocabulary file

    def learn(pdf: pd.DataFrame) -> pd.DataFrame:
        counts = Counter()
        for t in pdf["text"]:
            counts.update(words_of(t, CUT))
        words = sorted(counts)
        if not words:
            words, counts = [b" "], {b" ": 1}
        logs = fit(words, np.array([counts[w] for w in words], np.float64), Lattice(shared.value), rounds)
        return pd.DataFrame({"lang": [pdf["lang"].iloc[0]], "logs": [logs.tolist()]})

    got = sorted(known.where(low < share).groupBy("lang").applyInPandas(learn, "lang string, logs array<double>").collect())
    if not got:
        return [], np.zeros((len(pieces), 0))
    return [r["lang"] for r in got], np.array([r["logs"] for r in got]).T


def identify(docs: DataFrame, pieces: list[bytes], languages: list[str], logs: np.ndarray, text: str = "text") -> DataFrame:
    """`docs` plus (in place of columns of these names) `__lang` (the language of greatest likelihood, ties to the first by name, or und) and `__score`, its
    posterior under equal priors with the log-likelihood tempered by the square root of the number of words."""
    shared = docs.sparkSession.sparkContext.broadcast((pieces, languages, logs))  # bounded: vocabulary x languages
    name = uuid.uuid4().hex  # a reused worker may still hold another model

    @F.pandas_udf("lang string, score double")
    def of(texts: pd.Series) -> pd.DataFrame:
        pieces, languages, logs = shared.value
        if _STATE.get("name") != name:
            _STATE.update(name=name, lattice=Lattice(pieces), cache={})
        lattice, cache, out = _STATE["lattice"], _STATE["cache"], []
        texts = texts.tolist()
        for lo in range(0, len(texts), 256):
            docs_words = [words_of(t) if languages and t and any(map(str.isalpha, t)) else None for t in texts[lo:lo + 256]]
            if len(cache) > CACHE:
                cache.clear()
            new = list({w for ws in docs_words if ws for w in ws if w not in cache})
            cache.update(zip(new, lattice.forward(new, logs)))
            for ws in docs_words:
                if not ws:
                    out.append((UNKNOWN, 0.0))
                    continue
                total = np.zeros(len(languages))
                for i in range(0, len(ws), 50_000):
                    total += np.array([cache[w] for w in ws[i:i + 50_000]]).sum(axis=0)
                z = (total - total.max()) / np.sqrt(len(ws))
                best = int(total.argmax())
                out.append((languages[best], float(1 / np.exp(z).sum())))
        return pd.DataFrame(out, columns=["lang", "score"])

    x = spare(docs, 1)[0]
    return docs.withColumn(x, of(F.col(text))).withColumns({"__lang": F.col(f"{x}.lang"), "__score": F.col(f"{x}.score")}).drop(x)


_STATE: dict = {}


def language_digest(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """Contract columns, one row per document row; null text or text without letters is und with score 0."""
    pieces = load_vocabulary(path)
    languages, logs = train(docs, pieces)
    d = docs.select("doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "text")
    return identify(d, pieces, languages, logs).select("doc_id", "held_out", F.col("__lang").alias("lang_pred"), F.col("__score").alias("score"))
