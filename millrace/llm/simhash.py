"""SimHash near-dedup by anchor-point covering.

The anchors are the words of a covering code: pairs of words of the binary Golay code (23 bits, covering radius 3) on
bits 0-22 and 23-45 of a fingerprint; the other 18 bits are left to the comparison. Each fingerprint is at home at
its one nearest anchor, within radius 3 in either half. A fingerprint within k bits of it exceeds that radius by at
most k over both halves, so replicating each fingerprint to every anchor within radius plus k brings any such pair
together where one of them is at home. There the two are compared over all 64 bits."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, looked_up, slices, small_batches, written
from .components import connected

GOLAY = 0b101011100011  # fixed value: generator polynomial of the (23, 12) Golay code, x^11+x^9+x^7+x^6+x^5+x+1
N, RADIUS = 23, 3
#: Fingerprints at home at an anchor up to which pairs there are compared one by one; more take heavy_links().
HEAVY = 64


def _syndrome(word: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words by the generator: 11 bits."""
    w = word.astype(np.int64)
    for bit in range(22, 10, -1):
        w = np.where(w >> bit & 1, w ^ GOLAY << bit - 11, w)
    return w


@cache
def patterns(k: int) -> list[np.ndarray]:
    """For e = 0..k and each syndrome, the error patterns that lead from a word to the code words at distance at most
    3 (e = 0: one, the code is perfect) or exactly 3 + e; rows are padded with -1."""
    out = []
    for e in range(k + 1):
        found: list[list[int]] = [[] for _ in range(2048)]
        for weight in range(RADIUS + 1) if not e else [RADIUS + e]:
            bits = np.array([sum(1 << i for i in c) for c in combinations(range(N), weight)], dtype=np.int64)
            for s, p in zip(_syndrome(bits).tolist(), bits.tolist()):
                found[s].append(p)
        table = np.full((2048, max(map(len, found))), -1, dtype=np.int64)
        for s, row in enumerate(found):
            table[s, : len(row)] = row
        out.append(table)
    return out


def anchors(fps: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The anchors within radius plus k of each fingerprint (uint64): their numbers, the index of the fingerprint,
    and by how much the radius is exceeded (0: its home)."""
    half = [(fps >> np.uint64(shift) & np.uint64((1 << N) - 1)).astype(np.int64) for shift in (0, N)]
    syn = [_syndrome(h) for h in half]
    a, i, x = [], [], []
    for e1 in range(k + 1):
        left = patterns(k)[e1][syn[0]]
        for e2 in range(k + 1 - e1):
            right = patterns(k)[e2][syn[1]]
            # a code word is known by its upper 12 bits
            one, two = (half[0][:, None] ^ left) >> 11, (half[1][:, None] ^ right) >> 11
            both = (one[:, :, None] << 12 | two[:, None, :]).reshape(len(fps), -1)
            row, col = np.nonzero(((left >= 0)[:, :, None] & (right >= 0)[:, None, :]).reshape(len(fps), -1))
            a.append(both[row, col])
            i.append(row)
            x.append(np.full(len(row), e1 + e2, dtype=np.int8))
    return np.concatenate(a), np.concatenate(i), np.concatenate(x)


def shingle_hashes(words: list[bytes], width: int, part: int = 65_536) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of all shingles, a bounded part at a time. Fewer words than width: one shingle of all."""
    import xxhash

    h64, joined = xxhash.xxh64_intdigest, b" ".join(words)
    if len(words) <= width:
        if words:
            yield np.array([h64(joined, 42)], dtype=np.uint64)
        return
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = (ends - sizes).tolist()
    ends = ends.tolist()
    n = len(words) - width + 1
    for lo in range(0, n, part):
        yield np.array([h64(joined[s:e], 42) for s, e in zip(starts[lo : min(n, lo + part)], ends[lo + width - 1 :])], dtype=np.uint64)


def majority(hashes: Iterator[np.ndarray]) -> int:
    """A bit is set if it is in over half of the hashes; of none: 0."""
    votes, n = np.zeros(64, dtype=np.int64), 0
    for h in hashes:
        bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int32)
        n += len(h)
    return int(np.packbits(votes * 2 > n, bitorder="little").view("<u8")[0])


def majorities(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """majority() of each run of hashes that begins at one of starts, all of which are not empty."""
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    bits = np.unpackbits(hashes.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    votes = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
    sizes = np.diff(np.append(starts, len(hashes)))
    return np.packbits(votes * 2 > sizes[:, None], axis=1, bitorder="little").view("<u8")[:, 0].astype(np.uint64)


def fingerprint(words: list[bytes], width: int) -> int:
    return majority(shingle_hashes(words, width))


def ascii_words(text: str | None) -> list[bytes]:
    """Words [^\\x20\\x09-\\x0D]+ after lower-casing A-Z only, which is what bytes.lower() and bytes.split() do."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def fingerprints(docs: DataFrame, width: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fp (the 64 bits as a signed long) of each row. Null and empty texts have fingerprint 0."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in slices(batches):
            fps = np.fromiter((fingerprint(ascii_words(t), width) for t in b.column(1).to_pylist()), dtype=np.uint64, count=b.num_rows)
            yield pa.record_batch({"key": b.column(0), "fp": pa.array(fps.view(np.int64))})

    return small_batches(docs).select(F.col(key).cast("long"), F.col(text)).mapInArrow(run, "key long, fp long")


def replicas(classes: DataFrame, k: int) -> DataFrame:
    """anchor int, fp long, home boolean: each fingerprint at every anchor within covering radius plus k."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            fps = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for lo in range(0, len(fps), 10_000):
                some = fps[lo : lo + 10_000]
                a, i, x = anchors(some, k)
                yield pa.record_batch({"anchor": pa.array(a.astype(np.int32)), "fp": pa.array(some[i].view(np.int64)), "home": pa.array(x == 0)})

    return small_batches(classes).select("fp").mapInArrow(run, "anchor int, fp long, home boolean")


def heavy_links(fps: DataFrame, k: int) -> DataFrame:
    """Links whose components are those of all pairs of fps (distinct) within k bits, without comparing pairs: two
    fingerprints within k bits have a point between them, within ceil(k/2) of one and floor(k/2) of the other, and
    any two that are that near to one point are within k bits. So each joins the least one that shares a point.
    (k even: all points within k/2. k odd: those within (k-1)/2, and from one side (k+1)/2.)"""
    near, far = k // 2, k - k // 2
    masks = [sum(1 << i for i in c) for w in range(far + 1) for c in combinations(range(64), w)]
    own = [m for m in masks if m.bit_count() <= near]
    signed = lambda ms: F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in ms])
    at = fps.select("fp", F.explode(signed(own)).alias("m")).select((F.col("fp").bitwiseXOR(F.col("m"))).alias("point"), "fp")
    least = at.groupBy("point").agg(F.min("fp").alias("least"))
    reach = at if near == far else fps.select("fp", F.explode(signed(masks)).alias("m")).select((F.col("fp").bitwiseXOR(F.col("m"))).alias("point"), "fp")
    return reach.join(least, "point").where("fp <> least").select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct()


def links(classes: DataFrame, k: int) -> DataFrame:
    """a, b: pairs of distinct fingerprints (long fp of classes) within k bits; where more than HEAVY are at home at
    an anchor, links that connect the same fingerprints instead. The work at an anchor is at most HEAVY times the
    fingerprints there, so a large group of near copies stays linear."""
    near = written(replicas(classes, k), "replicas")
    home = near.where("home").select("anchor", F.col("fp").alias("own"))
    heavy = written(home.groupBy("anchor").count().where(F.col("count") > HEAVY).select("anchor"), "heavy")
    if full := not heavy.isEmpty():
        home = home.join(heavy, "anchor", "left_anti")
    pairs = near.join(home, "anchor").where((F.col("fp") != F.col("own")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("own"))) <= k))
    out = pairs.select(F.col("fp").alias("a"), F.col("own").alias("b"))
    if full:
        out = out.unionByName(heavy_links(near.join(heavy, "anchor", "left_semi").select("fp").distinct(), k))
    out = written(out.distinct(), "pairs")
    drop_written(near)
    return out


def near_groups(docs: DataFrame, width: int = 3, k: int = 2, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, fp, component: the least key reachable over links of k or fewer differing bits, equal fingerprints
    included. Ties cannot arise: every link counts. Rows that share a key and a text are alike; a null key has no
    part in component unless the whole component has none but null keys (then null). An empty table gives no row."""
    rows = written(fingerprints(docs, width, key, text), "fingerprints")
    classes = written(rows.groupBy("fp").agg(F.min("key").alias("rep"), F.count("*").alias("n")), "classes")
    nodes = connected(links(classes, k))
    joined = classes.join(nodes, classes.fp == nodes.node, "left").select("fp", "rep", "n", F.coalesce("component", "fp").alias("root"))
    least = joined.groupBy("root").agg(F.min("rep").alias("component"))
    table = written(joined.join(least, "root").select("fp", "component", "n"), "components")
    return looked_up(rows, table, "fp", "n").select(F.col("key").alias(key), "fp", "component")
