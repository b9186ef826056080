"""Near duplicates by Jaccard similarity of word shingles, found by the SimHash operator.

At a similarity of 0.8 the fingerprints of two whole texts differ in about ten bits, where covering anchors would have
to be replicated over a hundred thousand times. So the anchors take fingerprints of passages: a text is cut where a
hash of a word says so, in about ten words each, and the PASSAGES of least hash stand for it. An edit spoils the
passage that it falls in and no other, so most texts as alike as 0.8 share one of theirs. Of each class of passages
(fingerprints linked within k bits) one document stands for it, and the others are held against that one alone: linear
work, however large the class. That connects most of what is alike.

The rest is found by a second, exact way. Put the shingles of all texts in one order, those that are common in a sample
last: two texts as alike as LEAST share one of their first n - ceil(LEAST n) + 1. So texts that share a shingle there,
and aren't connected yet, are compared as well, whatever passages they have: first by the numbers of their shingles, in
all, behind the shared one, and at each of PLACES, then FINE places, which can't differ by more than the sets do and rule out no
pair that is alike; then by their shingles. The sample and the passages only move work, no result.

Nothing larger than two tiles of documents, or about GRAMS shingles, meets in a task but a single text.
Texts of equal words are one node from the start."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, looked_up, release, small_batches, text_slices, written
from .components import connected
from .embedding import _stars
from .simhash import links, majorities

WIDTH, LEAST, PASSAGES, BITS = 5, 0.8, 5, 1
#: Places of the tallies that all texts have, and of those of texts that the first leave as candidates.
PLACES, FINE = 256, 2048
#: About so many texts are sampled for common shingles, of which so many at most are ordered last.
SAMPLE, COMMON = 10_000, 250_000
TILE = 512
#: Rows of small classes that go through one task together, and shingles that do.
BUCKET, GRAMS = 4096, 1_000_000
#: Odd multipliers of the shingles' hash, and the inverse of the first modulo 2^64.
K1, K2 = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
UNDO = pow(K1, -1, 1 << 64)
SHORT, LONG = 4, 40  # words of a passage


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(29)) * np.uint64(K2)
    return h ^ h >> np.uint64(32)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def cuts(n: int, ends: list[int]) -> list[int]:
    """Where passages end in n words: after each of ends that leaves SHORT words at least, or LONG words."""
    out, lo = [], 0
    for p in [*ends, n]:
        while p - lo > LONG or (p - lo == LONG and p < n):
            lo += LONG
            out.append(lo)
        if p - lo >= SHORT and p < n:
            out.append(p)
            lo = p
    if lo < n:
        out.append(n)
    return out


def passages(words: list[bytes]) -> list[list[bytes]]:
    """Cut after words whose hash is a multiple of 8, at 4 to 40 words. All words are in one passage each."""
    import xxhash

    at = cuts(len(words), [i + 1 for i, w in enumerate(words) if not xxhash.xxh64_intdigest(w) & 7])
    return [words[lo:hi] for lo, hi in zip([0, *at], at)]


class Words:
    """The words ([^\\x20\\x09-\\x0D]+, A-Z lower-cased) of some texts: a hash of each, and of all shingles."""

    def __init__(self, texts):
        """texts: an Arrow array of strings. Nulls are empty texts."""
        import pyarrow as pa
        import pyarrow.compute as pc
        import xxhash

        rows = pc.ascii_lower(pc.ascii_trim_whitespace(pc.fill_null(texts.cast(pa.large_string()), "")))
        lists = pc.ascii_split_whitespace(rows)
        empty = pc.equal(rows, "").to_numpy(zero_copy_only=False)
        chunks = lists.flatten().dictionary_encode()
        names = chunks.dictionary.cast(pa.large_binary()).to_pylist()
        known = np.fromiter(map(xxhash.xxh64_intdigest, names), dtype=np.uint64, count=len(names))
        word = known[chunks.indices.to_numpy()]
        sizes = np.diff(lists.offsets.to_numpy())
        starts = np.cumsum(sizes) - sizes
        word = np.delete(word, starts[empty])  # an empty text is one empty word
        sizes = np.where(empty, 0, sizes)
        self.word, self.sizes, self.starts = word, sizes, np.cumsum(sizes) - sizes
        # sums of the words' hashes times powers: equal runs of words have equal sums, but for a power
        self.sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(word * _powers(K1, len(word))[: len(word)])])
        self.back = _powers(UNDO, len(word))

    def runs(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """Hashes of the words from lo to hi (exclusive)."""
        return _mixed((self.sums[hi] - self.sums[lo]) * self.back[lo] + (hi - lo).astype(np.uint64) * np.uint64(K2))

    def shingles(self, lo: int, hi: int) -> np.ndarray:
        """Hashes of the shingles of the words from lo to hi; fewer words than WIDTH: one shingle of all."""
        if hi == lo:
            return np.empty(0, dtype=np.uint64)
        first = np.arange(lo, max(lo + 1, hi - WIDTH + 1))
        return self.runs(first, np.minimum(first + WIDTH, hi))

    def distinct(self, k: int) -> np.ndarray:
        lo = int(self.starts[k])
        return np.unique(self.shingles(lo, lo + int(self.sizes[k])))

    def marks(self) -> list[np.ndarray]:
        """Fingerprints of the passages that stand for each text: those of its PASSAGES least hashes."""
        ends = np.nonzero(self.word & np.uint64(7) == 0)[0] + 1
        first = np.searchsorted(ends, self.starts, side="right")
        last = np.searchsorted(ends, self.starts + self.sizes, side="right")
        spans, counts = [], []
        for lo, n, i, j in zip(self.starts.tolist(), self.sizes.tolist(), first.tolist(), last.tolist()):
            at = np.array([lo, *(lo + c for c in cuts(n, (ends[i:j] - lo).tolist()))], dtype=np.int64)
            own = self.runs(at[:-1], at[1:])
            best = np.unique(own, return_index=True)[1][:PASSAGES]
            spans.append(np.stack([at[best], at[best + 1]], axis=1) if len(best) else np.empty((0, 2), dtype=np.int64))
            counts.append(len(best))
        lo, hi = np.concatenate(spans).T if spans else np.empty((2, 0), dtype=np.int64)
        n = np.maximum(hi - lo - WIDTH + 1, 1)
        first = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(n.sum())
        prints = majorities(self.runs(first, np.minimum(first + WIDTH, np.repeat(hi, n))), np.cumsum(n) - n)
        return np.split(prints, np.cumsum(counts)[:-1]) if counts else []

    def nodes(self) -> list[int]:
        """A hash of each text's words in order."""
        import xxhash

        return [xxhash.xxh64_intdigest(self.word[i : i + n].astype("<u8").tobytes(), 7) for i, n in zip(self.starts.tolist(), self.sizes.tolist())]


def tally(grams: np.ndarray, places: int = PLACES) -> bytes:
    """How many of a set's shingles are at each of so many places, 255 at most. The sum of the differences of two sets'
    is at most the number of shingles that only one of them has."""
    return np.minimum(np.bincount((grams >> np.uint64(32)).astype(np.int64) % places, minlength=places), 255).astype(np.uint8).tobytes()


def first_shingles(grams: np.ndarray, common: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The shingles of a set (sorted) that another as alike as LEAST has one of among its own: n - ceil(LEAST n) + 1, in
    the order of how often they are in the sample, then by hash. common: sorted shingles, and how often each is."""
    n = len(grams)
    values, often = common
    rank = np.zeros(n, dtype=np.int64)
    if n and len(values):
        at = np.minimum(np.searchsorted(values, grams), len(values) - 1)
        rank = np.where(values[at] == grams, often[at], 0)
    return grams[np.lexsort((grams, rank))[: n - math.ceil(LEAST * n - 1e-9) + 1]] if n else grams


def sketch(text: str | None) -> tuple[int, int, int, list[int]]:
    """The node (a hash of the words in order), the tally, number of different shingles, and the fingerprints
    of the passages that stand for the text."""
    import pyarrow as pa

    w = Words(pa.array([text], pa.string()))
    grams = w.distinct(0)
    return w.nodes()[0], int.from_bytes(tally(grams), "little"), len(grams), w.marks()[0].tolist()


def _signed(x: int) -> int:
    return x - (x >> 63 << 64)


def common_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles that occur more than once in a sample of the texts: at most COMMON, sorted, and in how many."""
    import pyarrow as pa

    part = max(1, docs.count() // SAMPLE)
    some = docs.where(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(part)) == 0).select("text").where("text is not null").distinct()

    def run(batches: Iterator) -> Iterator:
        for b in text_slices(batches, 0):
            w = Words(b.column(0))
            grams = [w.distinct(k) for k in range(b.num_rows)]
            yield pa.record_batch({"gram": pa.array(np.concatenate(grams).view(np.int64) if grams else [], pa.int64())})

    counts = some.mapInArrow(run, "gram long").groupBy("gram").agg(F.count("*").alias("n")).where("n > 1")
    top = counts.orderBy(F.desc("n"), "gram").limit(COMMON).toArrow()
    grams, n = top.column("gram").to_numpy().view(np.uint64), top.column("n").to_numpy()
    order = np.argsort(grams)
    return grams[order], n[order]


def _lists(parts: list[np.ndarray]):
    """An Arrow list of longs of each part."""
    import pyarrow as pa

    flat = np.concatenate(parts).view(np.int64) if parts else np.empty(0, dtype=np.int64)
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)), pa.array(flat))


def sketches(docs: DataFrame, common: Broadcast) -> DataFrame:
    """doc_id, th (hash of the text), node, bits (the tally), n, marks (passages' fingerprints), first (the shingles of
    first_shingles()) of each row."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        release()
        for b in text_slices(batches, 2):
            w = Words(b.column(2))
            grams = [w.distinct(k) for k in range(b.num_rows)]
            cols = [
                pa.array(list(map(_signed, w.nodes())), pa.int64()),
                pa.array(list(map(tally, grams)), pa.binary()),
                pa.array(list(map(len, grams)), pa.int64()),
                _lists(w.marks()),
                _lists([first_shingles(g, common.value) for g in grams]),
            ]
            yield pa.record_batch([b.column(0), b.column(1), *cols], ["doc_id", "th", "node", "bits", "n", "marks", "first"])

    rows = docs.select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.col("text"))
    return rows.mapInArrow(run, "doc_id long, th long, node long, bits binary, n long, marks array<long>, first array<long>")


def shingles(docs: DataFrame) -> DataFrame:
    """node, grams (its different shingles' hashes, sorted as unsigned) of docs(node, text)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in text_slices(batches, 1):
            w = Words(b.column(1))
            yield pa.record_batch([b.column(0), _lists([w.distinct(k) for k in range(b.num_rows)])], ["node", "grams"])

    return docs.select("node", "text").mapInArrow(run, "node long, grams array<long>")


def _grams_of(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, grams of the nodes in wanted, from their documents' texts."""
    reps = nodes.join(wanted.select("node").distinct(), "node", "left_semi").select("node", F.col("rep.doc_id").alias("rep_id"), F.col("rep.th").alias("rep_th"))
    reps = written(reps, "wanted")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), "text")
    texts = texts.join(reps, texts.doc_id.eqNullSafe(reps.rep_id) & (texts.th == reps.rep_th)).select("node", "text")
    out = written(shingles(texts).dropDuplicates(["node"]), "grams")
    drop_written(reps)
    return out


def _views(column) -> list[np.ndarray]:
    """The arrays of an Arrow list column, without a copy of them as Python objects."""
    column = column.combine_chunks()
    flat, ends = column.values.to_numpy().view(np.uint64), column.offsets.to_numpy()
    return [flat[i:j] for i, j in zip(ends, ends[1:])]


def alike_by_sketch(bits: np.ndarray, n: np.ndarray, also: np.ndarray | None = None) -> np.ndarray:
    """Pairs of sets (among those of also) that sizes and tallies (a row each) leave possible: similar ones differ in
    at most (1 - LEAST) / (1 + LEAST) of the sum of their sizes."""
    out = np.triu(np.minimum(n[:, None], n) >= LEAST * np.maximum(n[:, None], n) - 1e-9, 1)
    if also is not None:
        out &= also
    i, j = np.nonzero(out)
    for lo in range(0, len(i), 20_000):
        a, b = i[lo : lo + 20_000], j[lo : lo + 20_000]
        far = np.abs(bits[a].astype(np.int16) - bits[b]).sum(axis=1, dtype=np.int64)
        out[a, b] = far <= (1 - LEAST) / (1 + LEAST) * (n[a] + n[b]) + 1e-9
    return out | out.T


def together(ok: np.ndarray) -> np.ndarray:
    """The least index that each can be reached from over the pairs of ok (symmetric)."""
    label, near = np.arange(len(ok)), ok | np.eye(len(ok), dtype=bool)
    while True:
        new = np.where(near, label, len(ok)).min(axis=1)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def alike(grams: list[np.ndarray]) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of LEAST or more: exact, as products of 0/1 blocks."""
    sizes = np.array([len(g) for g in grams])
    values, at = np.unique(np.concatenate(grams), return_inverse=True)
    row = np.repeat(np.arange(len(grams)), sizes)
    shared = np.bincount(at, minlength=len(values)) > 1
    col = (np.cumsum(shared) - 1)[at]
    keep = shared[at]
    row, col = row[keep], col[keep]
    order = np.argsort(col, kind="stable")
    row, col = row[order], col[order]
    common = np.zeros((len(grams), len(grams)), dtype=np.float64)
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, 4096):
        i, j = np.searchsorted(col, [lo, lo + 4096])
        block = np.zeros((len(grams), 4096), dtype=np.float32)
        block[row[i:j], col[i:j] - lo] = 1
        common += block @ block.T
    return common >= LEAST * (sizes[:, None] + sizes - common) - 1e-9


def _classes(mark: np.ndarray, *then: np.ndarray) -> Iterator[np.ndarray]:
    """The places of each value of mark, in the order of then."""
    order = np.lexsort((*then, mark))
    at = np.nonzero(np.diff(mark[order], prepend=mark[order[0]] + 1))[0].tolist() + [len(order)]
    return (order[i:j] for i, j in zip(at, at[1:]))


def _dealt(rows: DataFrame, groups: int) -> DataFrame:
    """rows(mark, node, ...) with the columns group, lo and hi: small classes whole, many to a group; large ones by
    pairs of tiles, each document once for each tile."""
    sizes = written(rows.groupBy("mark").agg(F.count("*").alias("size")).where("size > 1"), "sizes")
    dealt = looked_up(rows, sizes.select("mark", "size", F.col("size").alias("c")), "mark", "size").where("c > 1")
    tiles = F.ceil(F.col("c") / TILE).cast("int")
    tile = F.pmod(F.xxhash64("node"), tiles).cast("int")
    dealt = dealt.withColumn("other", F.explode(F.when(F.col("c") <= TILE, F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), tiles - 1))))
    whole = F.col("other") < 0
    dealt = dealt.withColumn("lo", F.when(whole, -1).otherwise(F.least(tile, "other"))).withColumn("hi", F.when(whole, -1).otherwise(F.greatest(tile, "other")))
    return dealt.withColumn("group", F.when(whole, F.pmod(F.xxhash64("mark", F.lit(3)), F.lit(groups))).otherwise(F.col("mark"))).drop("other", "c")


def _promising(t):
    """mark, node of the documents that the sketches can't tell from another one of their class, and that aren't
    connected to it yet (where there are component and pos, the place of the mark in the order of the document's
    shingles). The mark is one of the set of documents to compare, so that those that meet in many classes are compared
    once."""
    import pyarrow as pa
    import xxhash

    mark, node, n = (t.column(c).to_numpy() for c in ("mark", "node", "n"))
    apart, pos = (t.column(c).to_numpy() if c in t.column_names else None for c in ("component", "pos"))
    bits = np.frombuffer(b"".join(t.column("bits").to_pylist()), dtype=np.uint8).reshape(len(node), -1)
    out: set[tuple[int, int]] = set()
    for own in _classes(mark, node):
        also = None
        if pos is not None:
            # at the first shingle that two sets share, no more can be shared than it and what follows in both
            rest, size = n[own] - pos[own], n[own]
            also = (apart[own][:, None] != apart[own]) & (np.minimum(rest[:, None], rest) >= LEAST / (1 + LEAST) * (size[:, None] + size) - 1e-9)
        ok = alike_by_sketch(bits[own], n[own], also)
        some = ok.any(axis=1)
        own, ok = own[some], ok[np.ix_(some, some)]
        label = together(ok) if len(own) else own
        for first in np.unique(label).tolist():
            some = node[own[label == first]]
            key = _signed(xxhash.xxh64_intdigest(some.tobytes(), 11))
            out.update((key, x) for x in some.tolist())
    return pa.table({"mark": pa.array([k for k, _ in out], pa.int64()), "node": pa.array([x for _, x in out], pa.int64())})


def _linked(t):
    import pyarrow as pa

    mark, node, grams = t.column("mark").to_numpy(), t.column("node").to_numpy(), _views(t.column("grams"))
    star: set[tuple[int, int]] = set()
    for own in _classes(mark):
        if len(own) > 1:
            i, j = np.nonzero(np.triu(alike([grams[k] for k in own]), 1))
            star.update(_stars(node[own[i]].tolist(), node[own[j]].tolist()))
    return pa.table({"a": pa.array([x for x, _ in star], pa.int64()), "b": pa.array([x for _, x in star], pa.int64())})


def _held_against(t):
    """a, b of t(a, node, grams) where node is alike to a, which is among its own rows."""
    import pyarrow as pa

    a, node, grams = t.column("a").to_numpy(), t.column("node").to_numpy(), _views(t.column("grams"))
    out = []
    for own in _classes(a):
        base = grams[next(k for k in own if node[k] == a[k])]
        for k in own[node[own] != a[own]]:
            at = np.minimum(np.searchsorted(base, grams[k]), len(base) - 1) if len(base) else []
            common = int((base[at] == grams[k]).sum()) if len(base) else 0
            if common >= LEAST * (len(base) + len(grams[k]) - common) - 1e-9:
                out.append((a[k], node[k]))
    return pa.table({"a": pa.array([x for x, _ in out], pa.int64()), "b": pa.array([x for _, x in out], pa.int64())})


def _star(docs: DataFrame, nodes: DataFrame, marks: DataFrame) -> DataFrame:
    """a, b: which of marks(mark, node, n) are alike to the one that stands for their class: that whose marks have the
    largest classes, as the original of edited copies."""
    sizes = written(marks.groupBy("mark").agg(F.count("*").alias("size")).where("size > 1").withColumn("c", F.col("size")), "sizes")
    sized = written(looked_up(marks, sizes, "mark", "c").where("size > 1"), "sized")
    centre = written(sized.groupBy("node").agg(F.sum("size").alias("weight")), "centre")
    best = F.max(F.struct("weight", "node", "n")).alias("r")
    chosen = written(sized.join(centre, "node").groupBy("mark").agg(best, F.count("*").alias("c")), "chosen")
    pairs = looked_up(sized, chosen, "mark", "c").where((F.col("node") != F.col("r.node")) & (F.least("n", "r.n") >= LEAST * F.greatest("n", "r.n") - 1e-9))
    pairs = written(pairs.select(F.col("r.node").alias("a"), "node", "n").distinct(), "pairs")
    for d in (sizes, sized, centre, chosen):
        drop_written(d)
    grams = _grams_of(docs, nodes, pairs.select("node").unionByName(pairs.select(F.col("a").alias("node"))))
    # a text that many are held against goes to as many pieces as their shingles fill
    pieces = pairs.groupBy("a").agg(F.ceil(F.sum("n") / GRAMS).cast("int").alias("pieces"), F.count("*").alias("c"))
    pieces = written(pieces, "pieces")
    groups = max(1, -(-(pairs.agg(F.sum("n")).first()[0] or 0) // GRAMS))
    members = looked_up(pairs.select("a", "node"), pieces, "a", "c").select("a", "node", F.pmod(F.xxhash64("node"), "pieces").cast("int").alias("piece"))
    centres = pieces.select("a", F.col("a").alias("node"), F.explode(F.expr("sequence(0, pieces - 1)")).alias("piece"))
    both = members.unionByName(centres).join(grams, "node").withColumn("group", F.pmod(F.xxhash64("a", "piece"), F.lit(groups)))
    out = written(both.select("group", "a", "node", "grams").groupBy("group").applyInArrow(_held_against, "a long, b long"), "links")
    for d in (pairs, pieces, grams):
        drop_written(d)
    return out


def _prefixed(nodes: DataFrame, near: DataFrame) -> DataFrame:
    """mark, node, bits, n, component, pos of nodes that share one of their first shingles with one that near (node,
    component) doesn't connect them to. Every pair as alike as LEAST that isn't connected meets at one."""
    posts = nodes.join(near, "node", "left").select("node", "n", F.coalesce("component", "node").alias("component"), F.posexplode("first").alias("pos", "mark"))
    mixed = written(posts.groupBy("mark").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi").select("mark"), "mixed")
    some = written(posts.join(mixed, "mark", "left_semi"), "posts")
    out = written(some.join(nodes.select("node", "bits"), "node"), "posts")
    drop_written(mixed)
    drop_written(some)
    return out


def _tallies(grams: DataFrame) -> DataFrame:
    """node, n, bits (at FINE places) of grams(node, grams)."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            sets = _views(pa.chunked_array([b.column(1)]))
            yield pa.record_batch([b.column(0), pa.array(list(map(len, sets)), pa.int64()), pa.array([tally(g, FINE) for g in sets], pa.binary())], ["node", "n", "bits"])

    return grams.select("node", "grams").mapInArrow(run, "node long, n long, bits binary")


def _links(docs: DataFrame, nodes: DataFrame, posts: DataFrame) -> DataFrame:
    """a, b: links that connect the documents of each class of posts that are alike."""
    by, sets = ["group", "lo", "hi"], "mark long, node long"
    dealt = _dealt(posts, max(1, -(-posts.count() // BUCKET))).select(*by, "mark", "node", "bits", "n", "component", "pos")
    hopeful = written(dealt.groupBy(*by).applyInArrow(_promising, sets).distinct(), "hopeful")
    grams = _grams_of(docs, nodes, hopeful)
    fine = written(_tallies(grams), "tallies")
    dealt = _dealt(hopeful, max(1, -(-hopeful.count() * FINE // (8 * GRAMS)))).join(fine, "node").select(*by, "mark", "node", "bits", "n")
    close = written(dealt.groupBy(*by).applyInArrow(_promising, sets).distinct(), "close")
    total = close.join(fine, "node").agg(F.sum("n")).first()[0] or 0
    both = _dealt(close, max(1, -(-total // GRAMS))).join(grams, "node").select(*by, "mark", "node", "grams")
    out = written(both.groupBy(*by).applyInArrow(_linked, "a long, b long"), "links")
    for d in (hopeful, grams, fine, close):
        drop_written(d)
    return out


def similar(docs: DataFrame) -> DataFrame:
    """doc_id, th, component (a struct of the least doc_id and its th), kept of each row of docs(doc_id, text), where
    th is a hash of the text.

    Linked are texts of equal words (lower-cased A-Z; so all without a word are), and pairs with a Jaccard similarity
    of LEAST or more of their sets of WIDTH-word shingles. kept: the document of the least id of
    its component. Rows equal in id and text are one document; null ids come first; very long texts are taken whole;
    an empty table gives no row; other columns are ignored."""
    common = docs.sparkSession.sparkContext.broadcast(common_shingles(small_batches(docs)))
    rows = written(sketches(docs, common), "sketches")
    common.destroy()
    names = written(rows.select("doc_id", "th", "node"), "names")
    doc = F.struct("doc_id", "th")
    nodes = written(rows.groupBy("node").agg(F.min(doc).alias("rep"), F.first("bits").alias("bits"), F.first("n").alias("n"), F.first("marks").alias("marks"), F.first("first").alias("first"), F.count("*").alias("rows")), "nodes")
    drop_written(rows)
    marks = nodes.select("node", "n", F.explode("marks").alias("mark"))
    prints = written(marks.select(F.col("mark").alias("fp")).distinct(), "prints")
    near = links(prints, BITS)
    classes = connected(near).withColumnRenamed("node", "mark").withColumnRenamed("component", "class")
    marks = marks.join(classes, "mark", "left").select("node", "n", F.coalesce("class", "mark").alias("mark"))
    marks = written(marks.dropDuplicates(["mark", "node"]), "marks")
    drop_written(prints)
    drop_written(near)
    pairs = _star(docs, nodes, marks)
    drop_written(marks)
    posts = _prefixed(nodes, connected(pairs))
    pairs = pairs.unionByName(_links(docs, nodes, posts))
    drop_written(posts)
    joined = nodes.select("node", "rep", "rows").join(connected(pairs), "node", "left").withColumn("root", F.coalesce("component", "node"))
    least = joined.groupBy("root").agg(F.min("rep").alias("component"))
    table = written(joined.select("node", "root", "rows").join(least, "root").select("node", "component", "rows"), "components")
    drop_written(nodes)
    out = looked_up(names, table, "node", "rows")
    return out.select("doc_id", "th", "component", F.struct("doc_id", "th").eqNullSafe(F.col("component")).alias("kept"))
