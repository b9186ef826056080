import random
from collections import Counter

import xxhash
from millrace.llm import similar

from .fixtures import documents, odd_ids


def grams(text):
    w = (text or "").encode().lower().split()
    return frozenset(b" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute(rows):
    """rows: (doc_id, text). Components of links at a similarity of 0.8 or more."""
    sets = [grams(t) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if sets[i] == sets[j] or n >= 0.8 * (len(sets[i]) + len(sets[j]) - n):
                up[root(i)] = root(j)
    least = {}
    for i, r in enumerate(rows):
        key = (r[0] is not None, r[0] or 0)
        least[root(i)] = min(least.get(root(i), key), key)
    return Counter((r[0], least[root(i)]) for i, r in enumerate(rows))


def got(docs):
    return Counter((r.doc_id, (r.component.doc_id is not None, r.component.doc_id or 0)) for r in similar.similar(docs).collect())


def test_small(spark):
    for docs in (documents(spark), odd_ids(spark), documents(spark).limit(0)):
        assert got(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_edited_copies(spark, monkeypatch):
    monkeypatch.setattr(similar, "TILE", 16)
    monkeypatch.setattr(similar, "BUCKET", 50)
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    texts = []
    shared = [rnd.choice(words) for _ in range(60)]
    for k in range(60):
        base = [rnd.choice(words) for _ in range(rnd.choice([30, 80, 200, 400]))] + (shared if k % 3 == 0 else [])
        texts.append(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 40 if k == 5 else 1])):
            copy = list(base)
            for _ in range(max(1, int(len(copy) * rnd.choice([0.004, 0.01, 0.02, 0.03])))):
                copy[rnd.randrange(len(copy))] = rnd.choice(words)
            texts.append(copy)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    want, have = brute(rows), got(spark.createDataFrame(rows, "doc_id long, text string"))
    wanted, had = (dict(x) for x in (want.keys(), have.keys()))
    assert all(wanted[i] <= had[i] for i in wanted)  # nothing that is no duplicate is linked
    missed = sum(wanted[i] != had[i] for i in wanted)
    assert missed <= 0.02 * len(rows)


def test_passages_keep_all_words():
    rnd = random.Random(1)
    for n in (0, 1, 4, 5, 39, 40, 41, 1000):
        words = [b"%d" % rnd.randrange(50) for _ in range(n)]
        cut = similar.passages(words)
        assert [w for p in cut for w in p] == words and all(len(p) <= 40 for p in cut) and all(len(p) >= 4 for p in cut[:-1])
    assert similar.sketch(None) == (xxhash.xxh64_intdigest(b"", 7), 0, 0, [])


def test_large_groups_share_one_passage(spark, monkeypatch):
    """More copies of a short text than a tile holds, each with an ending of its own."""
    monkeypatch.setattr(similar, "TILE", 16)
    rnd = random.Random(3)
    rows = []
    for _ in range(4):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.choice([20, 40]))]
        rows += [" ".join(base + [f"e{rnd.randrange(10**6)}" for _ in range(rnd.choice([1, 2]))]) for _ in range(60)] + [" ".join(base)]
    rows = list(enumerate(rows))
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_short_texts_without_a_common_passage(spark):
    """Pairs at a similarity of 0.8 or more, of few passages each."""
    rnd = random.Random(11)
    rows = []
    for k in range(300):
        base = [f"w{rnd.randrange(10**6)}" for _ in range(rnd.choice([15, 20, 25, 30]))]
        copy = [f"v{k}", *base] if k % 3 else [*base[1:], f"v{k}"]
        rows += [" ".join(base), " ".join(copy)]
    rows = list(enumerate(rows))
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_repeats_within_a_text_do_not_count(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(0, " ".join(words)), (1, " ".join(words + [f"p{i}" for i in range(8)] * 60))]
    assert len({c for _, c in brute(rows)}) == 1
    assert got(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)
