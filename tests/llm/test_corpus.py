"""Corpus operators against brute-force versions on small fixtures with null, empty, long, tied and repeated rows."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from skyloom.llm import ann, chat, decontam, langid, mixing, quality, secrets, simhash, substrings, warc

RND = random.Random(5)
WORDS = [a + b for a in ("th", "er", "on", "an", "re", "st", "nd", "ou") for b in ("ing", "ed", "ly", "at", "es", "or", "ble", "tion")]


def prose(n, rnd=RND):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


LONG = prose(5000)
PASSAGE = prose(60)
SAME = prose(80)
DOCS = [(0, SAME), (1, None), (2, ""), (3, SAME), (4, SAME + " tail"), (5, LONG), (6, prose(40) + "\n" + PASSAGE + "\t" + prose(30)), (7, prose(15) + " " + PASSAGE + " " + prose(3)),
        (8, "same " * 50), (8, "same " * 50), (8, prose(30)), (9, 'x password = "abcdefghijkl" é AKIA' + "Q" * 16 + " 0123456789abcdef0 token:short"), (None, SAME), (None, "  \n"),
        (10, "zeta " + "Zm9vYmFyMTIzNDU2Nzg5MEFCQ0RFRg8xQz9k" + " the_quick_brown_identifier_name okay"), (11, "one two"), (12, "Été 12 " + prose(50))]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, ("en", "fr", None)[k % 3], ("a", "b", "b", None)[k % 4], 1, "x", k) for k, (i, t) in enumerate(DOCS)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string, h int").repartition(3)


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def spans_of(text):
    out = []
    for m in re.finditer(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        out += [(m.start(), 0, m.end())] if len(m[2]) >= 12 else []
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 16]
    return ",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secrets(spark, docs, none):
    table = secrets.train(secrets.samples(spark))
    got = secrets.secret_digest(docs, table).collect()
    want = collections.Counter((i, hashlib.sha256(spans_of(t or "").encode()).hexdigest()) for i, t in DOCS)
    assert collections.Counter((r.doc_id, r.base_sha256) for r in got) == want
    assert [r.n_markov for r in got if r.doc_id == 10] == [1]  # the base-64 token, not the identifier
    assert sum(r.n_markov for r in got) == 1 and secrets.secret_digest(none, table).count() == 0
    masked = {r.doc_id: r.text for r in secrets.redact(docs, table).collect()}
    assert masked[9] == 'x [SECRET]" é [SECRET] [SECRET] token:short' and masked[1] is None


def test_many_spans_in_one_text(spark):
    text = " ".join(f"{k:032x}" for k in range(3000))
    got = secrets.secret_digest(spark.createDataFrame([(1, text)], "doc_id long, text string"), [0] * len(secrets.ALPHABET) ** 2).first()
    assert got.n_hex == 3000 and got.spans == spans_of(text)


def test_decontamination(spark, docs, none):
    items = spark.createDataFrame([(100, PASSAGE), (101, prose(40)), (102, None), (103, ""), (104, "one two"), (None, SAME.upper())], "item_id long, text string")
    want, dirty, wanted = set(), set(), items.collect()
    for i, t in DOCS:
        s = decontam.shingles(decontam.words_of(t))
        for r in wanted:
            w = decontam.shingles(decontam.words_of(r.text))
            if w and len(w & s) / len(w) >= decontam.OVERLAP:
                want.add((i, r.item_id)), dirty.add((i, t))
    got = decontam.contamination(docs, items).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want and (6, 100) in want and (None, None) in want
    assert decontam.contamination(none, items).count() == 0 and decontam.contamination(docs, items.limit(0)).count() == 0
    assert {(r.doc_id, r.text) for r in decontam.keep_clean(docs, items).collect()} == set(DOCS) - dirty


def test_wand_returns_all_above_threshold():
    rnd = random.Random(3)
    items = [(k, [rnd.choice(WORDS) for _ in range(rnd.randint(5, 30))], []) for k in range(60)]
    df = collections.Counter(w for _, ws, _ in items for w in set(ws))
    ix = decontam.Index(items, df, 60, 17.0)
    for _ in range(50):
        terms = {ix.terms[w] for w in rnd.sample(WORDS, 30) if w in ix.terms}
        for block in range(ix.n_blocks):
            score = collections.Counter()
            for t in terms:
                for i, w in ix.postings[t].get(block, []):
                    score[i] += w
            assert {i for i, _ in ix.wand(terms, block, 0.5)} == {i for i, s in score.items() if s >= 0.5 - 1e-9}


def substring_brute(rows):
    """rows: distinct documents in order; result per document."""
    seen, out = set(), []
    for t in rows:
        w = t.encode().split() if t else []
        gone = [0] * len(w)
        for s in range(len(w) - 19):
            k = tuple(w[s:s + 20])
            if k in seen:
                gone[s:s + 20] = [1] * 20
            seen.add(k)
        out.append((len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone) if not g)).hexdigest()))
    return out


def test_substrings(spark, docs, none, monkeypatch):
    for sort in (2_000_000, 40):
        monkeypatch.setattr(substrings, "SORT_WINDOWS", sort)
        got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substrings.substring_digest(docs).collect())
        keyed = {(i, t): (i is None, i or 0, h) for (i, t), h in zip(DOCS, (r[0] for r in spark.createDataFrame([(t, k) for k, (_, t) in enumerate(DOCS)], "t string, k int").orderBy("k").select(F.xxhash64("t")).collect()))}
        order = sorted(keyed, key=keyed.get)
        result = dict(zip(order, substring_brute([t for _, t in order])))
        assert got == collections.Counter((i, *result[i, t]) for i, t in DOCS)
    assert substrings.substring_digest(none).count() == 0


def test_language(spark, docs, none):
    rows = [(k, (prose(12) if k % 2 else " ".join(w[::-1] + "é" for w in prose(12).split())), "en" if k % 2 else "xx") for k in range(200)]
    rows += [(900, None, None), (901, "12 34 !!", None), (902, "", "en")]
    d = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in langid.language_digest(d).collect()}
    assert all(got[k].lang_pred == lang for k, _, lang in rows[:200]) and all(0 <= r.score <= 1 for r in got.values())
    assert [got[k].lang_pred for k in (900, 901, 902)] == ["und"] * 3
    assert langid.language_digest(d.limit(0)).count() == 0 and {r.lang_pred for r in langid.language_digest(d.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def test_forward_sums_all_segmentations():
    pieces = [b" ", b"a", b"b", b"ab", b" a", b"ba", b"aba"]
    logs = np.log(np.array([[0.2, 0.1], [0.2, 0.3], [0.1, 0.1], [0.2, 0.1], [0.1, 0.2], [0.1, 0.1], [0.1, 0.1]]))
    p = dict(zip(pieces, np.exp(logs)))

    def total(w):
        return np.ones(2) if not w else sum((p[w[:k]] * total(w[k:]) for k in range(1, min(3, len(w)) + 1) if w[:k] in p), np.zeros(2))

    words = [b" abab", b" a", b" bbaab", b"ab"]
    lattice = langid.Lattice(pieces)
    assert np.allclose(lattice.forward(words, logs), [np.log(total(w)) for w in words])
    uses = lattice.expected(words, np.ones(4), logs[:, 0])
    assert np.isclose(sum(n * len(x) for n, x in zip(uses, pieces)), sum(map(len, words)))


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((1500, 16)).astype(np.float32)
    x[300:700] = x[299]
    rows = [(k, v.tolist()) for k, v in enumerate(x)] + [(5000, None), (5020, [0.0] * 16), (5040, [float("nan")] * 16), (None, x[0].tolist()), (40, x[40].tolist()), (5060, [1.0, 2.0])]
    e = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.nearest(e, e.where("vec_id % 20 = 0"), shard=600).collect()
    by = collections.defaultdict(list)
    for r in sorted(got, key=lambda r: r.rank):
        by[r.query_id].append((r.vec_id, r.score))
    good = total = 0
    for q in range(0, 1500, 20):
        s = x.astype(np.float64) @ x[q].astype(np.float64)
        want = [k for k in np.lexsort((np.arange(1500), -np.round(s, 9))) if k != q][:20]
        good, total = good + len({v for v, _ in by[q]} & set(want)), total + 20
        assert len(by[q]) == 20 and all(abs(s[v] - z) < 1e-9 for v, z in by[q])
    assert good / total >= 0.9 and set(by) == set(range(0, 1500, 20))
    assert ann.nearest(e.limit(0), e.limit(0)).count() == 0


def test_quality(spark):
    rnd = random.Random(9)
    good = [(k, prose(rnd.randint(20, 200), rnd)) for k in range(600)]
    bad = [(1000 + k, " ".join([rnd.choice(WORDS).upper() + "!!"] * 40)) for k in range(120)]
    docs = spark.createDataFrame([*good, *bad, (5000, None), (5001, "")], "doc_id long, text string")
    labels = spark.createDataFrame([(k, 1, 0) for k, _ in good[:300]] + [(k, 0, 0) for k, _ in bad[:60]] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality_digest(docs, labels).collect()}
    assert np.mean([got[k].predicted for k, _ in good]) > 0.97 and np.mean([got[k].predicted for k, _ in bad]) < 0.05
    assert 0 <= got[5000].score <= 1 and got[5000].score == got[5001].score
    assert quality.quality_digest(docs.limit(0), labels).count() == 0 and quality.quality_digest(docs, labels.limit(0)).count() == 722
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_chat(spark):
    rows = [(1, 1, "assistant", "b\\<|end|>\\"), (1, 0, "user", "a<s></s>[INST]"), (2, 0, "system", None), (2, 1, "user", "<\\|"), (2, 2, "assistant", ""), (3, 0, None, "x"), (3, 0, "assistant", "<|turn|>"), (3, 0, "assistant", "<|turn|>"), (None, None, "assistant", "n")]
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("prompt", F.lit("clash"))
    got = {r.conv_id: r for r in chat.chat_digest(d).collect()}
    turns = {1: [("user", "a<s></s>[INST]"), ("assistant", "b\\<|end|>\\")], 2: [("system", ""), ("user", "<\\|"), ("assistant", "")], 3: [("", "x"), ("assistant", "<|turn|>"), ("assistant", "<|turn|>")],
             None: [("assistant", "n")], -7: [("user", "</s>[INST] ok [/INST]"), ("assistant", "</s>[INST] ok [/INST]")]}
    assert set(got) == set(turns)
    for k, ts in turns.items():
        loss = "".join(t for r, t in ts if r == "assistant")
        assert (got[k].n_turns, got[k].loss_chars) == (len(ts), len(loss))
        assert got[k].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in ts).encode()).hexdigest()
        assert got[k].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_chat_layouts(spark):
    rows = ['{"messages":[{"role":"user","content":"q"},{"role":"assistant","content":"a"}]}', '{"conversations":[{"from":"human","value":"q"},{"from":"gpt","value":"a"}]}', '{"prompt":"q","response":"a"}',
            '{"instruction":"q","output":"a"}', '{"instruction":"q","input":"i","output":"a"}', '{"unknown":"z"}']
    schema = "messages array<struct<role:string,content:string>>, conversations array<struct<`from`:string,value:string>>, prompt string, response string, instruction string, input string, output string, unknown string"
    d = spark.createDataFrame([(k, r) for k, r in enumerate(rows)], "k int, j string").select("k", F.from_json("j", schema).alias("r")).select("k", "r.*")
    got = [r["__turns"] for r in chat.canonical(d, d.columns[1:]).orderBy("k").collect()]
    assert [g and [tuple(t) for t in g] for g in got] == [[("user", "q"), ("assistant", "a")]] * 4 + [[("user", "q\n\ni"), ("assistant", "a")], None]


def test_warc(spark):
    rows = [(k, f"https://h{k % 3}.example.com/p/{k}", f"page {k % 7}" if k % 5 else None) for k in range(60)]
    rows += [(70, None, None), (71, "bad url:[ \n", "é"), (None, "http://q/", "page 1"), (61, "http://q/", "twice"), (61, "http://q/", "twice"), (62, "http://www.A.b:8080/x?b=1&a=2", "x" * 300000)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("key", F.lit("clash"))
    by = collections.defaultdict(list)
    for i, _, h in rows:
        by[h or ""].append(i)
    want = collections.Counter()
    for i, _, h in rows:
        b, w = (h or "").encode(), max((x for x in by[h or ""] if x is not None), default=None)
        first = i == w and not any(k[0] == i and k[3] == "response" for k in want)
        want[i, len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "response" if first else "revisit", None if first else w] += 1
    assert collections.Counter(map(tuple, warc.warc_digest(d).collect())) == want
    assert warc.warc_digest(d.limit(0)).count() == 0
    captures, folder = warc.write(d)
    found = warc.lookup(spark, warc.index(captures, folder, lines=4), "https://H1.example.com/p/4")
    assert [f[0]["WARC-Record-ID"] for f in found] == ["<urn:page:4>"] and warc.url_key("http://www.b.com/X/?z=1&a=2") == "com,b)/x?a=2&z=1"


def test_mixing(spark, none):
    rnd = random.Random(2)
    rows = [(k, prose(rnd.randint(1, 40), rnd), s) for s, n in (("big", 3000), ("mid", 300), ("small", 40), (None, 60)) for k in range(n)] + [(1, None, "small"), (2, "", "empty")]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumns({"weight": F.lit(1), "place": F.lit("x")})
    picks, w = mixing.mix(d, entropy=0.9, repeats=4.0, bucket_docs=100)
    w = {r.source: r for r in w.collect()}
    some = [r for r in w.values() if r.weight > 0]
    h = -sum(r.weight * np.log(r.weight) for r in some)
    reps = max(r.weight * sum(x.tokens for x in some) / r.tokens for r in some)
    assert abs(sum(r.weight for r in some) - 1) < 1e-9 and (abs(h - 0.9 * np.log(4)) < 1e-6 and reps <= 4 + 1e-6 or abs(reps - 4) < 1e-6)
    taken = collections.defaultdict(list)
    for r in picks.collect():
        taken[r.source].append(r)
    for s, rs in taken.items():
        spent = sum(r.n_tokens for r in rs)
        assert w[s].budget <= spent < w[s].budget + 41 or w[s].budget == 0
        rs.sort(key=lambda r: r.place)
        assert all(b.place >= a.place + a.n_tokens - 1e-9 for a, b in zip(rs, rs[1:]) if b.n_tokens and a.n_tokens)
    assert mixing.mix(none)[0].count() == 0
    assert "mix_block" in mixing.mixed_documents(d, entropy=0.9).columns


def test_simhash(spark, docs, none):
    rnd = random.Random(4)
    base = [rnd.choice(WORDS) + str(rnd.randint(0, 99)) for _ in range(400)]
    near = []
    for k in range(60):
        w = list(base)
        w[rnd.randrange(400)] = f"changed{k}"
        near.append((100 + k, " ".join(w)))
    rows = [*[(i, t) for i, t in DOCS], *near]
    got = simhash.simhash_digest(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    fps = [simhash.fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            if (fps[a] ^ fps[b]).bit_count() <= simhash.RADIUS:
                root[find(a)] = find(b)
    least = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        least[find(k)] += [] if i is None else [i]
    want = collections.Counter((i, f"{fps[k]:016x}", min(least[find(k)], default=None)) for k, (i, _) in enumerate(rows))
    assert collections.Counter(map(tuple, got)) == want
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns and simhash.simhash_digest(none).count() == 0
    ids = collections.Counter(r.doc_id for r in kept.collect())
    assert ids[0] == 1 and 3 not in ids and ids[None] == 2 and ids[8] >= 1


def test_fingerprint_by_bits():
    import xxhash

    words = ("A b\x0bC d " * 30).lower().split()
    hs = [xxhash.xxh64_intdigest(" ".join(words[i:i + 4]), 42) for i in range(len(words) - 3)]
    want = sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))
    assert simhash.fingerprint("A b\x0bC d " * 30) == want and simhash.fingerprint("") == simhash.fingerprint(None) == 0
    assert simhash.fingerprint("X y") == xxhash.xxh64_intdigest("x y", 42)


def test_all_links_share_a_bucket():
    rnd = np.random.default_rng(0)
    masks = [m & (1 << 64) - 1 for m in simhash.block_masks()]
    for _ in range(2000):
        x = int(rnd.integers(0, 1 << 63))
        y = x
        for b in rnd.integers(0, 64, simhash.RADIUS):
            y ^= 1 << int(b)
        assert any(x & m == y & m for m in masks)
