import random
from collections import Counter

import numpy as np
import xxhash
from millrace.llm import simhash
from millrace.llm.queries import op7_simhash

from .fixtures import documents, odd_ids


def fp(text, width=3):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    votes = Counter(b for g in grams for b in range(64) if xxhash.xxh64_intdigest(g, 42) >> b & 1)
    return sum(1 << b for b, n in votes.items() if 2 * n > len(grams))


def groups(rows, k=2):
    """rows: (key, fp). Least key reachable, by comparing all pairs."""
    fps = sorted({f for _, f in rows})
    a, up = np.array(fps, dtype=np.uint64), list(range(len(fps)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(fps)):
        for j in np.nonzero(np.bitwise_count(a[i] ^ a[i + 1 :]) <= k)[0] + i + 1:
            up[root(int(j))] = root(i)
    at = {f: root(i) for i, f in enumerate(fps)}
    least = {}
    for key, f in rows:
        if key is not None:
            least[at[f]] = min(least.get(at[f], key), key)
    return Counter((key, f, least.get(at[f])) for key, f in rows)


def test_documents(spark):
    for docs in (documents(spark), odd_ids(spark), documents(spark).limit(0)):
        rows = [(r.doc_id, fp(r.text)) for r in docs.collect()]
        assert Counter((r.doc_id, r.fp % 2**64, r.component) for r in simhash.near_groups(docs).collect()) == groups(rows)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r.doc_id, fp(r.text)) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert Counter((r.doc_id, int(r.fingerprint, 16), r.component_id) for r in op7_simhash(spark, sf).collect()) == groups(rows)


def test_anchors_meet():
    rnd = random.Random(1)
    for k in (1, 2, 3):
        for _ in range(40):
            x = rnd.getrandbits(64)
            y = x
            for b in rnd.sample(range(64), k):
                y ^= 1 << b
            a, i, e = simhash.anchors(np.array([x, y], dtype=np.uint64), k)
            assert Counter(i[e == 0].tolist()) == {0: 1, 1: 1}
            assert set(a[(i == 0) & (e == 0)]) <= set(a[i == 1]) and set(a[(i == 1) & (e == 0)]) <= set(a[i == 0])


def test_crowded_anchor(spark):
    rnd = random.Random(2)
    seed = rnd.getrandbits(64)
    fps = {seed ^ sum({1 << rnd.randrange(46, 64) for _ in range(rnd.randrange(5))}) for _ in range(400)} | {rnd.getrandbits(64) for _ in range(300)}
    fps |= {f ^ 1 << rnd.randrange(64) for f in rnd.sample(sorted(fps), 100)}
    signed = [(f - (f >> 63 << 64),) for f in fps]
    classes = spark.createDataFrame(signed, "fp long")
    from millrace.llm.components import connected

    got = {r.node % 2**64: r.component for r in connected(simhash.links(classes, 2)).collect()}
    want = groups([(s, f) for (s,), f in zip(signed, fps)])
    assert {f: c for _, f, c in want if c in {c for (s, _, c), _ in want.items() if s != c}} == got
