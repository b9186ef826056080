import math
from collections import Counter, defaultdict

import pytest
from millrace.llm import quality
from millrace.llm.queries import op3_quality
from pyspark.sql import functions as F

from .fixtures import documents


class Plain:
    """The model by its definition, from all running text of one language."""

    def __init__(self, texts):
        n = quality.ORDER
        counts = Counter()
        for t in texts:
            s = self.seen(t)
            counts.update(s[i : i + n] for i in range(len(s) - n + 1))
        self.c = {n: counts}
        for k in range(n - 1, 0, -1):
            self.c[k] = Counter(g[1:] for g in self.c[k + 1])
        self.d, self.ctx = {}, {}
        for k in self.c:
            m = Counter(self.c[k].values())
            d = []
            for j in (1, 2, 3):
                if m[1] and m[2] and m[j]:
                    y = m[1] / (m[1] + 2 * m[2])
                    d.append(min(max(j - (j + 1) * y * m[j + 1] / m[j], 0.05 * j), 0.95 * j))
                else:
                    d.append(0.5 * j)
            self.d[k] = d
            total, left = defaultdict(int), defaultdict(float)
            for g, c in self.c[k].items():
                total[g[:-1]] += c
                left[g[:-1]] += d[min(c, 3) - 1]
            self.ctx[k] = {x: (total[x], left[x] / total[x]) for x in total}

    @staticmethod
    def seen(text):
        words = text.split()
        return quality.OPEN * (quality.ORDER - 1) + " ".join(words) + quality.CLOSE if words else ""

    def p(self, g):
        if not g:
            return 1 / quality.SYMBOLS
        lower = self.p(g[1:])
        if g[:-1] not in self.ctx[len(g)]:
            return lower
        total, gamma = self.ctx[len(g)][g[:-1]]
        c = self.c[len(g)][g]
        return max(c - self.d[len(g)][min(c, 3) - 1], 0) / total + gamma * lower if c else gamma * lower

    def cost(self, text):
        n, s = quality.ORDER, self.seen(text)
        grams = [s[i : i + n] for i in range(len(s) - n + 1)]
        return -sum(math.log(self.p(g)) for g in grams), len(grams)


def test_against_definition(spark, sf, monkeypatch):
    monkeypatch.setattr(quality, "SHARD_ROWS", 3000)
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf}/documents.parquet").limit(60).collect()]
    train, test = rows[:40], [*rows[40:], (10_001, "unseen ☃☃ zzzz \x02 日本", "en"), (10_002, "", "en"), (10_003, None, "en"), (10_004, "no model", "xx"), (10_005, "text", None)]
    monkeypatch.setattr(quality, "BLOCK", 5000)
    path = quality.train(spark.createDataFrame([(t, lang) for _, t, lang in train], "text string, lang string"))
    models = {lang: Plain([t for _, t, x in train if x == lang]) for lang in {x for *_, x in train}}
    got = {r.doc_id: (r.cost, r.n) for r in quality.costs(spark.createDataFrame(test, "doc_id long, text string, lang string"), path).collect()}
    for doc_id, text, lang in test:
        if lang in models:
            want = models[lang].cost(text or "")
            assert got[doc_id][1] == want[1] and got[doc_id][0] == pytest.approx(want[0], rel=1e-6)
        elif lang is None:
            assert got[doc_id][0] == pytest.approx(min(m.cost(text)[0] for m in models.values()), rel=1e-6)
    sums = [sum(math.exp(-0.0) * m.p(h + c) for c in {g[-1] for g in m.c[1]}) for m in models.values() for h in ("", "t", "th")]
    assert all(s <= 1 + 1e-9 for s in sums)


def quantile(values, p):
    return sorted(values)[max(0, math.ceil(p * len(values)) - 1)]


def test_perplexity_bound_and_kept(spark):
    """The whole of judged() against the definition, with rows without a language, without trust, repeated and null."""
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()][:120]
    texts = {i: t for i, t, _ in rows}
    rows += [(50_001, rows[0][1], None), (50_002, "&&& %%% ### $$$ *** " * 30, None), (50_003, "words of a tongue that nobody trusts", "xx"), (50_004, " ", "en"), (50_005, None, None), rows[3], (None, rows[5][1], "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({c: F.lit("clash") for c in ("n", "cost", "judge", "bound", "quality")})
    labels = spark.createDataFrame([(i, 1, 0) for i in texts] + [(50_003, 0, 0), (None, 1, 0)], "doc_id long, quality int, toxic int")
    held = {r.doc_id for r in docs.where(quality.held("doc_id")).collect()}
    names = sorted({x for i, t, x in rows if i in texts and i not in held})
    models = {x: Plain([t for i, t, y in rows if i in texts and i not in held and x == y]) for x in names}
    costs = {(i, t, x): models[x].cost(t) for i, t, x in rows if x in models and t and t.strip()}
    checked = {x: [costs[r] for r in rows if r[0] in held and r[0] in texts and r[2] == x and r in costs] for x in names}

    def fence(of):
        med = quantile([c / n for c, n in of], 0.5)
        q1, q2, q3 = (quantile([(c + quality.PRIOR * med) / (n + quality.PRIOR) for c, n in of], p) for p in (0.25, 0.5, 0.75))
        return med, q3 + quality.FENCE * max(q3 - q1, 0.01 * q2)

    pooled = fence([c for x in names for c in checked[x]])
    fences = {x: fence(checked[x]) if checked[x] else pooled for x in names}
    want = Counter()
    for i, t, x in rows:
        if not (t or "").strip():
            want[i, x, None, None if x not in fences else round(math.exp(fences[x][1]), 4), False] += 1
            continue
        judge = x if x is not None else min(names, key=lambda y: models[y].cost(t)[0])
        if judge not in models:
            want[i, x, None, None, True] += 1
            continue
        (c, n), (med, bound) = models[judge].cost(t), fences[judge]
        want[i, x, round(math.exp(c / n), 4), round(math.exp(bound), 4), (c + quality.PRIOR * med) / (n + quality.PRIOR) <= bound] += 1
    got = Counter()
    for r in quality.judged(docs, labels).collect():
        empty = r.perplexity is None and not r.kept
        got[r.doc_id, r.lang, r.perplexity and round(r.perplexity, 4), None if r.bound is None or empty and r.lang is None else round(r.bound, 4), r.kept] += 1
    assert got == want
    assert not dict((k[0], k[4]) for k in got)[50_002] and dict((k[0], k[4]) for k in got)[50_001]


def test_order_of_words_counts(spark):
    words = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang = 'en'").limit(40).collect()]
    path = quality.train(spark.createDataFrame([(t, "en") for t in words], "text string, lang string"))
    text = " ".join(words[7].split()[:300])
    mixed = " ".join(sorted(text.split()))
    one, two = (r.cost for r in quality.costs(spark.createDataFrame([(1, text, "en"), (2, mixed, "en")], "doc_id long, text string, lang string"), path).orderBy("doc_id").collect())
    assert two > 1.02 * one


def test_many_shards_are_each_read_once_a_block(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang is not null")
    path = quality.train(docs.select("lang", "text"))
    few, grams = spark.read.parquet(path).count(), 200
    monkeypatch.setattr(quality, "SHARD_ROWS", -(-few // grams))
    many = quality.train(docs.select("lang", "text"))
    texts = [(r.lang, quality.running(r.text)) for r in docs.limit(60).collect()]
    reads = {}
    for p in (path, many):
        monkeypatch.setattr(quality, "LOADED", 0)  # no shard is kept
        s = quality.Scorer(p, spark.read.parquet(f"{p}.size").first().shards)
        opened, load = Counter(), s.shard
        s.shard = lambda k: (opened.update([k]), load(k))[1]  # noqa: B023
        reads[p] = s.score(*map(list, zip(*texts)))[0].tolist()
        blocks = len(list(quality.blocks(quality.pieces([t for _, t in texts]))))
        assert max(opened.values()) <= blocks
    assert reads[path] == pytest.approx(reads[many]) and spark.read.parquet(f"{many}.size").first().shards > 150


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    rows = op3_quality(spark, sf).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r.doc_id: r.kept for r in rows}
    assert set(kept) == set(docs) and len(rows) == len(docs)
    good = [kept[i] for i, r in labels.items() if r.quality == 1]
    bad = [kept[i] for i, r in labels.items() if r.quality == 0]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad)


def test_edge_cases(spark):
    docs = documents(spark)
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.lit(None).cast("int").alias("toxic"))
    rows = {r.doc_id: r for r in quality.judged(docs, labels).collect()}
    for r in docs.collect():
        if not (r.text or "").strip():
            assert not rows[r.doc_id].kept
        elif r.lang is None:
            assert rows[r.doc_id].perplexity > 1 and rows[r.doc_id].bound > 1
    assert quality.judged(docs.limit(0), labels).collect() == []
    none = quality.judged(docs, labels.limit(0)).collect()
    assert all(r.kept == bool((t or "").strip()) for r, t in ((r, dict(docs.select("doc_id", "text").collect())[r.doc_id]) for r in none))
