import hashlib
from collections import Counter

import pytest
from millrace.llm import multiset
from millrace.llm.queries import op5_fingerprints

from .fixtures import documents, odd_ids


def brute(rows):
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        n = len(t) // 4
        edited = t[: len(t) - n] + after[:n]
        f, g, h = map(multiset.of_text, (t, edited, after))
        out.append((i, len(t), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), str(f), str(g), f.likeness(g), f.likeness(h)))
    return Counter(out)


@pytest.mark.parametrize("make", [documents, odd_ids, lambda s: documents(s).limit(0), lambda s: documents(s).limit(1)])
def test_small(spark, make):
    docs = make(spark)
    assert Counter(map(tuple, multiset.with_edits(docs).collect())) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op5_fingerprints(spark, sf).collect()
    assert Counter(map(tuple, got)) == brute(rows)
    by_text = {}
    for r in got:
        by_text.setdefault(dict(rows)[r.doc_id], set()).add(r.fingerprint)
    assert all(len(v) == 1 for v in by_text.values()) and len({min(v) for v in by_text.values()}) == len(by_text)
    long = [r for r in got if r.n_chars > 300]
    assert sum(r.near_edited for r in long) / len(long) > 0.6 > 0.3 > sum(r.near_next for r in long) / len(long)
    assert sum(r.near_edited > r.near_next for r in long) > 0.97 * len(long)


def test_multiset_laws():
    f = multiset.of_paragraphs
    a, b, c = "one paragraph", "another, longer paragraph of text", "a third é"
    assert f([a, b, c]).same(f([c, a, b])) and (f([a]) + f([b])).same(f([a, b])) and (f([a, b]) - f([b])).same(f([a]))
    assert not f([a, a]).same(f([a])) and not f([a, b]).same(f([a + "\n" + b])) and f([]).same(f([a]) - f([a]))
    long = ["x" * 5_000_000, "word " * 1_000_000]
    assert f(long).same(f(long[:1]) + f(long[1:]))


def test_many_equal_windows():
    """A window that occurs more often than 16 bits count."""
    text = "abc " * 40_000
    edited, _, _ = multiset.edit(text, "something else")
    assert multiset.of_text(text).likeness(multiset.of_text(edited)) > 0.99
