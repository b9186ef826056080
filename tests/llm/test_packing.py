import struct
import zlib
from collections import defaultdict

from millrace.llm import packing
from millrace.llm.queries import op6_packing, tokenizer
from pyspark.sql import functions as F

from .fixtures import documents, odd_ids

PATH = tokenizer("byte_bpe_50k.json")


def check(docs, rows, capacity=2048):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    want = defaultdict(int)
    for doc_id, text in docs:
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % capacity or capacity
        cuts = [0, *range(first, len(ids) + 1, capacity)]
        for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
            want[doc_id, k, lo, hi - lo, zlib.crc32(struct.pack(f"<{hi - lo}I", *ids[lo:hi]))] += 1
    got, bins = defaultdict(int), defaultdict(list)
    for r in rows:
        got[tuple(r[:5])] += 1
        bins[r.sequence_id].append((r.offset, r.length))
    assert got == want
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= capacity
    return len(bins)


def test_small(spark):
    for docs in (documents(spark), odd_ids(spark), documents(spark).limit(0)):
        check([(r.doc_id, r.text) for r in docs.collect()], packing.packed(packing.pieces(docs, PATH, 0)).collect())


def test_query(spark, monkeypatch):
    sf = "/root/testdata/sf0.01"
    rows = op6_packing(spark, sf).collect()
    n = check([(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()], rows)
    sizes = [r.length for r in rows]
    assert n <= len(packing.best_fit(sorted(range(len(sizes)), key=lambda i: -sizes[i]), sizes, 2048).bins)


def test_shards_and_epochs(spark, monkeypatch):
    monkeypatch.setattr(packing, "SHARD", 150)
    rows = spark.range(3000).select("id", F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), (F.pmod(F.xxhash64("id"), F.lit(1400)) + 1).alias("length"), F.lit(0).cast("long").alias("ids_crc32")).withColumnRenamed("id", "doc_id")
    got = packing.packed(rows.unionByName(rows)).collect()
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    assert len(got) == 6000
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 2048
    assert len(bins) <= -(-sum(r.length for r in got) // 2048) * 1.01 + 1


def test_genetic_beats_best_fit():
    import random

    rnd, better = random.Random(5), 0
    for seed in range(12):
        # triplets that fill bins exactly: best fit misses some of them
        sizes = []
        for _ in range(40):
            a = rnd.randrange(300, 900)
            b = rnd.randrange(200, 2048 - a - 100)
            sizes += [a, b, 2048 - a - b]
        rnd.shuffle(sizes)
        bins = packing.evolved(sizes, 2048, seed)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes))) and all(sum(sizes[i] for i in b) <= 2048 for b in bins)
        plain = len(packing.best_fit(sorted(range(len(sizes)), key=lambda i: -sizes[i]), sizes, 2048).bins)
        assert len(bins) <= plain and bins == packing.evolved(sizes, 2048, seed)
        better += len(bins) < plain
    assert packing.evolved([], 2048, 0) == []


def triplets(rnd, n):
    """Sizes that fill n bins exactly by threes, which best fit misses."""
    sizes = []
    for _ in range(n):
        a = rnd.randrange(520, 900)
        b = rnd.randrange(520, 2048 - a - 400)
        sizes += [a, b, 2048 - a - b]
    rnd.shuffle(sizes)
    return sizes


def test_islands_beat_best_fit_with_production_parameters(spark):
    """Several shards whose best fit isn't optimal, through the query's own path."""
    import random

    sizes = triplets(random.Random(9), 2500)
    rows = spark.createDataFrame([(i, 0, 0, n, 0) for i, n in enumerate(sizes)], packing.PIECES)
    got = packing.packed(rows).collect()
    bins = defaultdict(list)
    for r in got:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 2048
    plain = len(packing.best_fit(packing.largest_first(sizes), sizes, 2048).bins)
    assert sorted(r.doc_id for r in got) == list(range(len(sizes))) and 2500 <= len(bins) < plain
    # searched by the islands of each shard, fewer bins than its best fit
    shard = spark.createDataFrame([(0, i, n) for i, n in enumerate(sizes[:3000])], "shard long, uid long, length long")
    found = packing._searched(shard, 0, 2048).collect()
    assert sorted(r.uid for r in found) == list(range(3000))
    assert len({r.bin for r in found}) < len(packing.best_fit(packing.largest_first(sizes[:3000]), sizes[:3000], 2048).bins)
