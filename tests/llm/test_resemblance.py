"""The near-duplicate stage against all pairs of five-word shingle sets."""

import random

import corpus_pipeline
from skyloom.llm import resemblance


def _sets(text):
    w = (text or "").lower().split()
    return {tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def _kept(rows):
    ids, sets = [k for k, _ in rows], [_sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            u = len(sets[a] | sets[b])
            if not u or len(sets[a] & sets[b]) / u >= 0.8:
                root[find(a)] = find(b)
    return {min(k for k, i in zip(ids, range(len(rows))) if find(i) == find(r)) for r in range(len(rows))}


def test_stage_finds_all_similar_pairs(spark, monkeypatch):
    rnd = random.Random(8)
    prose = lambda n: [f"w{rnd.randrange(500)}" for _ in range(n)]
    line = prose(25)
    texts = [prose(rnd.randint(1, 150)) for _ in range(120)]
    for t in texts[:60]:  # from 0.6 to 1 similar
        c = list(t)
        for _ in range(rnd.randint(0, 1 + len(c) // 40)):
            c[rnd.randrange(len(c))] = f"x{rnd.randrange(10**6)}"
        texts.append(c)
    base = prose(120)
    for _ in range(40):  # a chain of changes, so that its ends are not similar
        base = list(base)
        base[rnd.randrange(120)] = f"y{rnd.randrange(10**6)}"
        texts.append(base)
    texts += [line + prose(4) for _ in range(30)]  # a common line
    rows = [*enumerate(" ".join(t) for t in texts), (900, None), (901, ""), (902, "one"), (903, "ONE")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = _kept(rows)
    for crowd, common in ((64, 4), (6, 1)):
        monkeypatch.setattr(resemblance, "CROWD", crowd)
        monkeypatch.setattr(resemblance, "COMMON", common)
        assert {r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()} == want
    assert resemblance.near_duplicates(docs.where("false")).count() == 0
