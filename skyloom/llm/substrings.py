"""Exact substring deduplication of word windows by super-k-mer partitioning.

Each window of WINDOW words has a minimiser, the least mixed hash of its GRAM-word runs; runs that are frequent in the corpus come
after all others, so that a common phrase draws only windows made of common phrases alone.  Consecutive windows with one minimiser
form a super-k-mer: their words travel once, as one packed string, to the bucket of the minimiser.
Equal windows have equal minimisers, so a bucket sees all copies of its windows; there they are sorted by
hash and compared as text.  Before they travel, equal super-k-mers of a task are reduced to the earliest.
Packed strings of a task that share a bucket are compressed together.
"""

from __future__ import annotations

import hashlib
import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, GRAM = 20, 4
#: Text bytes per bucket; packed bytes that a map task holds before it sends blocks; windows sorted at a time.
BUCKET_BYTES, FLUSH_BYTES, SORT_WINDOWS = 6 << 20, 48 << 20, 2_000_000
#: A run of words is frequent if its windows fill this part of a bucket; one document in so many is counted (by a hash of its text) to
#: find such runs.  This sets the order of minimisers alone: windows are counted in all text, whatever the order.
FREQUENT, ONE_IN = 0.25, 256
_BASE, _MASK = 0x9E3779B97F4A7C15 | 1, (1 << 64) - 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.empty(n, np.uint64)
    out[0] = 1
    k = 1
    while k < n:
        m = min(k, n - k)
        out[k:k + m] = out[:m] * np.uint64(pow(base, k, 1 << 64))
        k += m
    return out


class Slices:
    """Hashes of any slices of a byte string, mod 2^64, from running sums."""

    def __init__(self, data: np.ndarray) -> None:
        n = len(data) + 1
        self.sums = np.zeros(n, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _powers(n, _BASE)[:-1], out=self.sums[1:])
        self.back = _powers(n, _INVERSE)

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return (self.sums[ends] - self.sums[starts]) * self.back[starts]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _least_of(h: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` consecutive values."""
    out, have = h, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[:-step], out[step:])
        have += step
    return out


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def _borders(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of words in lines of single-spaced words, each line ended by a newline."""
    ends = np.flatnonzero((data == 32) | (data == 10))
    return np.concatenate(([0], ends[:-1] + 1)), ends


def _grams(packed: bytes, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of words and, with the top bit clear, the mixed hashes of all runs of `gram` words."""
    data = np.frombuffer(packed, np.uint8)
    starts, ends = _borders(data)
    if len(starts) < gram:
        return starts, ends, np.empty(0, np.uint64)
    return starts, ends, _mixed(Slices(data).of(starts[:len(starts) - gram + 1], ends[gram - 1:])) >> np.uint64(1)


def super_kmers(packed: bytes, n_words: np.ndarray, window: int, gram: int, frequent: np.ndarray = np.empty(0, np.uint64)) -> Iterator[tuple[int, int, int, int, int, int]]:
    """(document, first word, windows, start byte, end byte, minimiser) of lines of single-spaced words; `frequent` is sorted."""
    starts, ends, grams = _grams(packed, gram)
    if len(starts) < window:
        return
    if len(frequent):
        late = frequent[np.minimum(np.searchsorted(frequent, grams), len(frequent) - 1)] == grams
        grams = np.where(late, grams | np.uint64(1 << 63), grams)
    least = _least_of(grams, window - gram + 1)
    doc = np.repeat(np.arange(len(n_words)), n_words)
    first = np.concatenate(([0], np.cumsum(n_words)[:-1]))
    whole = doc[:len(least)] == doc[window - 1:]
    new = np.ones(len(least), bool)
    new[1:] = (least[1:] != least[:-1]) | ~whole[:-1]
    at = np.flatnonzero(new & whole)
    if not len(at):
        return
    stop = np.flatnonzero(np.concatenate(((new[1:] | ~whole[1:]) & whole[:-1], whole[-1:])))  # last window of each run
    yield from zip(doc[at].tolist(), (at - first[doc[at]]).tolist(), (stop - at + 1).tolist(), starts[at].tolist(), ends[stop + window - 1].tolist(), least[at].tolist())


def _block(entries: list[tuple[bytes, tuple]]) -> bytes:
    """Compressed heads (null flag, doc_id, hash, first word; ids as differences, all as byte planes) and texts."""
    head = np.array([k for _, k in entries], dtype=np.int64).T.copy()
    head[1, 1:] -= head[1, :-1].copy()
    planes = head.view(np.uint8).reshape(4, len(entries), 8).transpose(0, 2, 1).tobytes()
    return struct.pack("<I", len(entries)) + zstandard.ZstdCompressor(level=5).compress(planes + b"\n".join(t for t, _ in entries) + b"\n")


def _unblock(block: bytes) -> tuple[np.ndarray, bytes]:
    n = struct.unpack("<I", block[:4])[0]
    raw = zstandard.ZstdDecompressor().decompress(block[4:])
    head = np.frombuffer(raw, np.uint8, n * 32).reshape(4, 8, n).transpose(0, 2, 1).copy().view(np.int64).reshape(4, n)
    head[1] = np.cumsum(head[1])
    return head.T, raw[n * 32:]


def _mapper(buckets: int, window: int, gram: int, frequent: np.ndarray = np.empty(0, np.uint64)):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[bytes, tuple] = {}
        of: dict[bytes, int] = {}
        size, marks = 0, []

        def flush() -> Iterator[pd.DataFrame]:
            groups = defaultdict(list)
            for t, k in held.items():
                groups[of[t] % buckets].append((t, k))
            keys = list(groups)
            for i in range(0, len(keys), 64):
                yield pd.DataFrame({"bucket": keys[i:i + 64], "block": [_block(groups.pop(k)) for k in keys[i:i + 64]]})
            if marks:
                m = np.array(marks, np.int64)
                yield pd.DataFrame({"bucket": [int(abs(m[0, 2])) % buckets], "block": [b"\0\0\0\0" + m.tobytes()]})
            held.clear(), of.clear(), marks.clear()

        for pdf in batches:
            missing, ids, hashes, texts = (pdf[c].tolist() for c in ("missing", "doc_id", "h", "text"))
            lines, n_words, rows, length = [], [], [], 0
            for r, text in enumerate([*texts, None]):
                words = words_of(text)
                if len(words) >= window:
                    lines.append(b" ".join(words))
                    n_words.append(len(words)), rows.append(r)
                    length += len(lines[-1])
                if lines and (length > 1 << 20 or r == len(texts)):
                    packed = b"\n".join(lines) + b"\n"
                    for d, w, n, a, b, mini in super_kmers(packed, np.array(n_words), window, gram, frequent):
                        t, row = packed[a:b], rows[d]
                        k = (missing[row], ids[row], hashes[row], w)
                        old = held.get(t)
                        if old is None:
                            held[t], of[t] = k, mini
                            size += b - a + 200
                        elif old != k:  # all windows of the later one start earlier in the other
                            late = max(old, k)
                            held[t] = min(old, k)
                            marks.append((*late, w := late[3], w + n - 1 + window))
                            size += 100
                    lines, n_words, rows, length = [], [], [], 0
                    if size > FLUSH_BYTES:
                        yield from flush()
                        size = 0
        yield from flush()

    return run


def _runs(keys: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Rows (null, doc_id, hash, from, to) of the words that runs of marked windows cover; at: word of each."""
    cut = np.ones(len(at), bool)
    cut[1:] = (keys[1:, :3] != keys[:-1, :3]).any(axis=1) | (at[1:] != at[:-1] + 1)
    lo = np.flatnonzero(cut)
    hi = np.concatenate((lo[1:] - 1, [len(at) - 1]))
    return np.column_stack((keys[lo, :3], at[lo], at[hi] + window))


def repeated_windows(blocks: list[bytes], window: int) -> np.ndarray:
    """Runs of windows of a bucket whose words also start earlier."""
    parts = [_unblock(b) for b in blocks]
    total = sum(t.count(b" ") - (window - 2) * len(head) for head, t in parts)
    rounds = total // SORT_WINDOWS + 1
    late_keys = []
    for turn in range(rounds):  # windows by hash, so that equal ones meet in one round
        hashes, where = [], []  # where: part, line, word of the line, start byte, end byte
        for p, (head, text) in enumerate(parts):
            data = np.frombuffer(text, np.uint8)
            starts, ends = _borders(data)
            closes = np.flatnonzero(data[ends] == 10)
            line = np.repeat(np.arange(len(closes), dtype=np.int32), np.diff(closes, prepend=-1))
            first = np.concatenate(([0], closes[:-1] + 1))
            i = np.flatnonzero(line[:len(line) - window + 1] == line[window - 1:])
            h = _mixed(Slices(data).of(starts[i], ends[i + window - 1]))
            if rounds > 1:
                pick = h % np.uint64(rounds) == np.uint64(turn)
                i, h = i[pick], h[pick]
            hashes.append(h)
            where.append(np.stack((np.full(len(i), p), line[i], i - first[line[i]], starts[i], ends[i + window - 1])).astype(np.int32))
        h, at = np.concatenate(hashes), np.concatenate(where, axis=1)
        if not len(h):
            continue
        order = np.argsort(h, kind="stable")
        twin = h[order][1:] == h[order][:-1]
        order = order[np.concatenate((twin, [False])) | np.concatenate(([False], twin))]
        if not len(order):
            continue
        h, at = h[order], at[:, order]
        bases = np.concatenate(([0], np.cumsum([len(head) for head, _ in parts])[:-1]))
        key = np.concatenate([head for head, _ in parts])[bases[at[0]] + at[1]]
        key[:, 3] += at[2]
        order = np.lexsort((key[:, 3], key[:, 2], key[:, 1], key[:, 0], h))
        h, at, key = h[order], at[:, order], key[order]
        new = np.concatenate(([True], h[1:] != h[:-1]))
        late, seen = [], {}
        keys = list(map(tuple, key.tolist()))
        for i, (p, lo, hi, fresh) in enumerate(zip(at[0].tolist(), at[3].tolist(), at[4].tolist(), new.tolist())):
            if fresh:
                seen = {}
            if seen.setdefault(parts[p][1][lo:hi], keys[i]) != keys[i]:  # in order of place; equal hashes are told apart as text
                late.append(i)
        late_keys.append(key[late])
    late_key = np.concatenate(late_keys) if late_keys else np.empty((0, 4), np.int64)
    if not len(late_key):
        return np.empty((0, 5), np.int64)
    late_key = late_key[np.lexsort((late_key[:, 3], late_key[:, 2], late_key[:, 1], late_key[:, 0]))]
    return _runs(late_key, late_key[:, 3], window)


def frequent_grams(docs: DataFrame, bucket_bytes: int, gram: int = GRAM) -> np.ndarray:
    """Sorted hashes of the runs whose windows would fill a good part of a bucket; as many at most as the text has such parts,
    times the runs of a window."""
    least = max(8, int(FREQUENT * bucket_bytes / 150 / ONE_IN))  # a run brings about 150 bytes of windows each time it occurs

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lines = [b" ".join(w) for w in map(words_of, pdf["text"].tolist()) if w]
            h, n = np.unique(_grams(b"\n".join(lines) + b"\n", gram)[2] if lines else np.empty(0, np.uint64), return_counts=True)
            yield pd.DataFrame({"g": h.view(np.int64), "n": n.astype(np.int64)})

    some = docs.select("text").where(F.pmod(F.xxhash64("text"), F.lit(ONE_IN)) == 0)
    got = some.mapInPandas(count, "g long, n long").groupBy("g").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("g").collect()
    return np.sort(np.array([r["g"] for r in got], np.int64).view(np.uint64))


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """(missing, doc_id, h, spans): per document with repeats, the word ranges [from, to) that are repeated.

    missing is 1 for a null doc_id; h is the xxhash64 of the text, which orders documents with equal ids.
    """
    d = docs.select(F.isnull("doc_id").cast("long").alias("missing"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.xxhash64("text").alias("h"), "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(48, size // bucket_bytes)
    sent = d.mapInPandas(_mapper(buckets, window, gram, frequent_grams(docs, bucket_bytes, gram)), "bucket long, block binary")

    def reduce(pdf: pd.DataFrame) -> pd.DataFrame:
        blocks = pdf["block"].tolist()
        marks = [np.frombuffer(b, np.int64, offset=4).reshape(-1, 6)[:, [0, 1, 2, 4, 5]] for b in blocks if b[:4] == b"\0\0\0\0"]
        rows = np.concatenate([*marks, repeated_windows([b for b in blocks if b[:4] != b"\0\0\0\0"], window)]) if any(b[:4] != b"\0\0\0\0" for b in blocks) else np.concatenate(marks)
        return pd.DataFrame(rows, columns=["missing", "doc_id", "h", "a", "b"])

    spans = sent.groupBy("bucket").applyInPandas(reduce, "missing long, doc_id long, h long, a long, b long")
    return spans.groupBy("missing", "doc_id", "h").agg(F.collect_set(F.struct("a", "b")).alias("spans"))


def kept_words(text: str | None, spans: list | None) -> tuple[list[bytes], int]:
    """(words that stay, number of words)."""
    words = words_of(text)
    if spans is None or not len(spans):
        return words, len(words)
    gone = np.zeros(len(words) + 1, np.int64)
    for s in spans:
        gone[s["a"]] += 1
        gone[s["b"]] -= 1
    keep = np.cumsum(gone[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist()) if k], len(words)


def substring_digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Contract columns, one row per document row.

    Null texts have no words.  Rows that repeat both id and text are one document: they don't make each other's
    windows repeats, and get equal results.  Rows that share an id but not the text are ordered by the text's hash;
    rows without an id come last.
    """
    docs = docs.select("doc_id", "text")
    spans = repeated_spans(docs, window).withColumnsRenamed({"doc_id": "s_id", "h": "s_h"})
    d = docs.withColumn("h", F.xxhash64("text"))
    with_spans = d.join(spans, (F.coalesce(d["doc_id"], F.lit(0)) == spans["s_id"]) & (d["h"] == spans["s_h"]) & (d["doc_id"].isNull().cast("long") == spans["missing"]), "left")

    @F.pandas_udf("n_words long, n_removed long, kept_sha256 string")
    def digest(texts: pd.Series, spans: pd.Series) -> pd.DataFrame:
        out = []
        for t, s in zip(texts, spans):
            kept, n = kept_words(t, s)
            out.append((n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        return pd.DataFrame(out, columns=["n_words", "n_removed", "kept_sha256"])

    return with_spans.select("doc_id", digest("text", "spans").alias("x")).select("doc_id", "x.*")
