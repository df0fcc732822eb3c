"""Rows that earlier versions lost, repeated, or took too long over, against plain Python versions."""

import collections
import random
import re
import time

import numpy as np
from pyspark.sql import functions as F

from skyloom.llm import _common, ann, chat, langid, mixing, quality, secrets, simhash, substrings

ZERO = [0] * len(secrets.ALPHABET) ** 2


def test_running_folds_and_pieces(spark):
    rnd = random.Random(1)
    sizes = (0, 1, 63, 64, 65, 4096, 4097, 9001)
    rows = [(k, [rnd.randint(-5, 9) for _ in range(n)]) for k, n in enumerate(sizes)]
    d = spark.createDataFrame(rows, "k long, a array<long>")
    got = {r.k: r for r in d.select("k", _common.running_totals(F.col("a")).alias("t"), _common.running(F.col("a"), lambda x, y: F.greatest(x, y)).alias("m")).collect()}
    for k, a in rows:
        assert got[k].t == np.cumsum(a).tolist() and got[k].m == (np.maximum.accumulate(a).tolist() if a else [])
    text = "".join(rnd.choice("abcé漢😀 ") for _ in range(20_000))
    cuts = sorted(rnd.randint(0, 20_000) for _ in range(60))
    spans = [*zip(cuts[::2], cuts[1::2]), (0, 20_000), (4096, 8192), (5, 5), (0, 0)]
    d = spark.createDataFrame([(text, spans), ("", [(0, 0)]), ("x", [])], "t string, s array<struct<start:long,end:long>>")
    assert [r[0] for r in d.select(_common.pieces(F.col("t"), F.col("s"))).collect()] == [[text[a:b] for a, b in spans], [""], []]


def test_a_text_of_200_000_matches(spark):
    text = " ".join(f"{k:032x} é" if k % 3 else f"token = Zm9vYmFyMTIzNDU2Nzg5MEFCQ0RFRg{k}" for k in range(200_000))
    d = spark.createDataFrame([(1, text, "mine", "also mine")], "doc_id long, text string, `__text` string, `__spans` string")
    began = time.time()
    got = secrets.secret_digest(d, ZERO).first()
    assert (got.n_hex, got.n_assign, got.n_markov) == (133_333, 66_667, 0)
    masked = secrets.redact(d, ZERO).first()
    assert time.time() - began < 150
    assert masked.text == re.sub(r"[0-9a-f]{32}", "[SECRET]", re.sub(r"token = [A-Za-z0-9]+", "[SECRET]", text))
    assert masked["__text"] == "mine" and masked["__spans"] == "also mine"


def test_overlapping_spans_fall_under_one_mark(spark):
    rows = [(1, "a password=0123456789abcdef0123 b"), (2, "secret:token:abcdefghijklmnop é"), (3, None), (4, "")]
    got = {r.doc_id: r.text for r in secrets.redact(spark.createDataFrame(rows, "doc_id long, text string"), ZERO).collect()}
    assert got == {1: "a [SECRET] b", 2: "secret:token:abcdefghijklmnop é", 3: None, 4: ""}


def test_models_on_held_out_tokens(spark):
    """Precision and recall over tokens made otherwise than the training sample."""
    rnd = random.Random(77)
    letters = "abcdefghijklmnopqrstuvwxyz"
    alphabets = (letters + letters.upper() + "0123456789", letters + letters.upper() + "0123456789+/", letters.upper() + "234567")
    secret = ["".join(rnd.choice(rnd.choice(alphabets[:1]) if k % 2 else alphabets[k % 3]) for _ in range(rnd.randint(24, 48))) for k in range(400)]
    nouns = "river stone cloud summer winter garden bridge silver copper forest window letter number market engine planet travel harbor castle marble".split()
    plain = [rnd.choice(("_", "-", "/", "")).join(rnd.choice((str, str.title))(rnd.choice(nouns)) for _ in range(rnd.randint(4, 6))) for _ in range(400)]
    rows = [(k, "see " + t + " there") for k, t in enumerate(secret + plain)]
    got = {r.doc_id: r.n_markov + r.n_hex + r.n_access for r in secrets.secret_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    hits, false = sum(got[k] > 0 for k in range(400)), sum(got[400 + k] > 0 for k in range(400))
    assert hits / 400 > 0.95 and false / 400 < 0.02


def test_a_conversation_of_20_000_turns(spark):
    rows = spark.range(20_000).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("é "), F.col("id")).alias("text"))
    began = time.time()
    got = {r.conv_id: r for r in chat.chat_digest(rows).collect()}[1]
    assert got.n_turns == 20_000 and got.loss_chars == sum(len(f"é {k}") for k in range(1, 20_000, 2)) and time.time() - began < 60


def test_one_of_each_group_by_text(spark):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    rows = [(3, b, "x"), (5, a, "y"), (5, b, "z"), (7, a, "u"), (7, "other text", "v"), (None, a, "n"), (None, a, "n"), (9, "twice here", "q"), (9, "twice here", "q"), (9, "twice here", "p")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string, missing string")).collect()
    got = collections.Counter((r.doc_id, r.text) for r in kept)
    assert got == {(3, b): 1, (5, a): 1, (7, "other text"): 1, (None, a): 1, (9, "twice here"): 1}


def test_mixing_counts_every_row(spark):
    rows = [(None, " ".join(["w"] * 20), "s", "p", 1)] * 50
    d = spark.createDataFrame(rows, "doc_id long, text string, source string, p_id string, number int")
    got = mixing.mixed_documents(d, entropy=None, budget=100)
    assert got.count() == 5 and {"p_id", "number"} <= set(got.columns) and got.first().p_id == "p"
    assert mixing.mixed_documents(d, entropy=None, budget=2000).count() == 100


def test_words_of_any_length_are_summed_whole():
    rng = np.random.default_rng(3)
    pieces = sorted({bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in rng.integers(1, 14, 60)} | {bytes([i]) for i in range(256)})
    lattice = langid.Lattice(pieces)
    logs = np.log(rng.dirichlet(np.ones(len(pieces)), 3).T)
    p = dict(zip(pieces, np.exp(logs)))

    def plain(w):
        alpha = [np.ones(3, np.longdouble)] + [np.zeros(3, np.longdouble)] * len(w)
        for e in range(1, len(w) + 1):
            alpha[e] = sum((alpha[e - n] * p[w[e - n:e]] for n in range(1, min(13, e) + 1) if w[e - n:e] in p), np.zeros(3))
        return np.log(alpha[-1]).astype(float)

    words = [b" " + bytes(rng.integers(97, 100, n).astype(np.uint8)) for n in (1, 40, 49, 64, 255)]
    assert np.allclose(lattice.forward(words, logs), [plain(w) for w in words])
    long = words[0] + bytes(rng.integers(97, 100, 900).astype(np.uint8))
    whole = lattice.forward([long], logs)
    old, langid.BLOCK = langid.BLOCK, 7
    try:
        assert np.allclose(whole, lattice.forward([long], logs)) and np.allclose(lattice.forward_long(words[4], np.exp(logs)), plain(words[4]))
    finally:
        langid.BLOCK = old
    assert len(langid.load_vocabulary()) >= 50_000 and langid.words_of("a" * 5000) == [b" " + b"a" * 5000]


def test_language_scores_by_hand(spark):
    rows = [(k, ("alpha beta gamma" if k % 2 else "uno dos tres") + f" {k % 7}", "xy"[k % 2]) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    pieces = langid.load_vocabulary()
    languages, logs = langid.train(docs, pieces)
    number = {b: i for i, b in enumerate(pieces)}

    def word(w, lang):
        alpha = [1.0] + [0.0] * len(w)
        for e in range(1, len(w) + 1):
            alpha[e] = sum(alpha[s] * np.exp(logs[number[w[s:e]], lang]) for s in range(e) if w[s:e] in number)
        return np.log(alpha[-1])

    got = {r.doc_id: r["__score"] for r in langid.identify(docs, pieces, languages, logs).collect()}
    for k, text, _ in rows[:4]:
        ws = [b" " + w for w in text.encode().split()]
        z = np.array([sum(word(w, i) for w in ws) for i in range(2)]) / np.sqrt(len(ws))
        assert np.isclose(got[k], 1 / np.exp(z - z.max()).sum())


def test_rows_that_share_an_id_are_candidates(spark):
    rng = np.random.default_rng(4)
    x = rng.standard_normal((60, 8)).round(3)
    ids = [0, 0, 20, None, None, *range(101, 156)]
    e = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x)], "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in ann.ann_digest(e).collect():
        got[r.query_id].append((r["rank"], r.vec_id, round(r.score, 9)))
    want = collections.defaultdict(list)
    for row in [k for k, i in enumerate(ids) if i is not None and i % 20 == 0]:
        s = (x @ x[row]).round(9)
        near = sorted((k for k in range(60) if k != row), key=lambda k: (-s[k], ids[k] is None, ids[k] or 0))[:20]
        want[ids[row]] += [(n + 1, ids[k], s[k]) for n, k in enumerate(near)]
    assert {k: sorted(v, key=str) for k, v in got.items()} == {k: sorted(v, key=str) for k, v in want.items()} and len(got[0]) == 40


def test_common_phrases_draw_no_bucket(spark, monkeypatch):
    """Equal results with frequent runs of words in any place of the order."""
    rnd = random.Random(6)
    phrase = [f"c{k}" for k in range(30)]
    texts = [" ".join([f"w{rnd.randrange(400)}" for _ in range(rnd.randint(0, 40))] + phrase[rnd.randrange(8):] + [f"w{rnd.randrange(400)}" for _ in range(20)]) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    plain = sorted(map(tuple, substrings.substring_digest(docs).collect()))
    monkeypatch.setattr(substrings, "ONE_IN", 1)
    monkeypatch.setattr(substrings, "FREQUENT", 0.0)
    frequent = substrings.frequent_grams(docs, 6 << 20)
    assert len(frequent) >= 20 and sorted(map(tuple, substrings.substring_digest(docs).collect())) == plain


def test_a_repeated_id_does_not_swell_the_training_sample(spark):
    docs = spark.createDataFrame([(1, f"text number {k}") for k in range(500)] + [(k, "some words " * k) for k in range(2, 40)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1) for k in range(40)], "doc_id long, quality int")
    seen = []
    old, quality.Model = quality.Model, lambda p, u, prior: seen.append((len(p), len(u)))
    try:
        quality.train(docs, labels)
    finally:
        quality.Model = old
    assert seen[0][0] <= 39 and seen[0][1] <= 39
