"""Best-fit packing by a grouping genetic algorithm on islands.

Genes are whole sequences (bins). A child takes well-filled bins of one parent into the other, drops that one's bins
that hold any of the same documents, and puts the documents so displaced back, largest first, where they fit best.
Fitness is the mean of squared fills, which favours few, full bins.

Documents are dealt at random to shards of about SHARD pieces. A shard is first packed by best fit; where that isn't
provably optimal, ISLANDS populations of it evolve apart, each island of each shard in a task of its own. After every
ROUND generations the populations are written, and each island's elite migrates to the next by a join. Between epochs
the full bins of a shard's best packing stay as they are, and the pieces of its other bins go to new, fewer shards
together with those of all others; so the loss of dealing shrinks to what no packing can avoid, and no task ever holds
more than a shard."""

from __future__ import annotations

import random
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_written, small_batches, written
from .records import steps
from .tokens import encoder, le

CAPACITY, SHARD, EPOCHS = 2048, 4096, 4
ISLANDS, POPULATION, ROUNDS, ROUND = 2, 4, 3, 10
#: Share of a bin from which it stays as it is between epochs.
FULL = 0.9985
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Bins:
    """Bins by the room they have left, so that the fullest that still takes a piece is found at once."""

    def __init__(self, capacity: int, bins: list[list[int]] | None = None, sizes: list[int] = ()):
        self.capacity, self.bins, self.room = capacity, [], []
        self.by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.mask = 0
        for b in bins or []:
            self.open(list(b), capacity - sum(sizes[i] for i in b))

    def open(self, items: list[int], room: int) -> None:
        self.by_room[room].append(len(self.bins))
        self.mask |= 1 << room
        self.bins.append(items)
        self.room.append(room)

    def put(self, item: int, size: int) -> None:
        fits = self.mask >> size
        if not fits:
            self.open([item], self.capacity - size)
            return
        room = size + (fits & -fits).bit_length() - 1
        k = self.by_room[room].pop()
        if not self.by_room[room]:
            self.mask &= ~(1 << room)
        self.bins[k].append(item)
        left = self.room[k] = room - size
        self.by_room[left].append(k)
        self.mask |= 1 << left

    def fitness(self) -> float:
        return sum((1 - r / self.capacity) ** 2 for r in self.room) / max(1, len(self.room))


def best_fit(order: list[int], sizes: list[int], capacity: int, into: Bins | None = None) -> Bins:
    out = into or Bins(capacity)
    for i in order:
        out.put(i, sizes[i])
    return out


def improved(bins: list[list[int]], free: list[int], sizes: list[int], capacity: int) -> tuple[list[list[int]], list[int]]:
    """Swaps single pieces of bins for larger ones of free that fill them better, the largest that fits. Returns the
    bins and what is free then, largest first."""
    free = sorted(free, key=sizes.__getitem__)
    held = [sizes[i] for i in free]
    out = []
    for items in bins:
        room = capacity - sum(sizes[i] for i in items)
        if room and held:
            items = list(items)
            for at, i in enumerate(items):
                k = bisect_right(held, sizes[i] + room) - 1
                if k >= 0 and held[k] > sizes[i]:
                    room -= held[k] - sizes[i]
                    items[at], gone = free.pop(k), held.pop(k)
                    j = bisect_right(held, sizes[i])
                    free.insert(j, i)
                    held.insert(j, sizes[i])
                    if not room:
                        break
        out.append(items)
    return out, free[::-1]


def crossed(a: Bins, b: Bins, sizes: list[int], rnd: random.Random) -> Bins:
    """A child of a with well-filled bins of b injected whole."""
    ranked = sorted(range(len(b.bins)), key=b.room.__getitem__)
    best = ranked[: max(1, len(ranked) // 2)]
    gift = [b.bins[k] for k in best if rnd.random() < 0.5] or [b.bins[best[0]]]
    taken = set().union(*gift)
    kept, displaced = [], []
    for items in a.bins:
        if taken.isdisjoint(items):
            kept.append(items)
        else:
            displaced += [i for i in items if i not in taken]
    kept, displaced = improved(kept, displaced, sizes, a.capacity)
    return best_fit(displaced, sizes, a.capacity, Bins(a.capacity, gift + kept, sizes))


def mutated(a: Bins, sizes: list[int], rnd: random.Random) -> Bins:
    """Dissolves the emptiest bins and a few others."""
    n = len(a.bins)
    gone = set(sorted(range(n), key=lambda k: -a.room[k])[: max(1, n // 20)]) | {rnd.randrange(n) for _ in range(max(1, n // 50))}
    kept, free = improved([items for k, items in enumerate(a.bins) if k not in gone], [i for k in gone for i in a.bins[k]], sizes, a.capacity)
    free.sort(key=lambda i: -sizes[i] + rnd.random() * 8)
    return best_fit(free, sizes, a.capacity, Bins(a.capacity, kept, sizes))


def fewest(sizes: list[int], capacity: int) -> int:
    """No packing has fewer bins: for any k, pieces over half a bin have bins of their own; those of them over capacity
    - k take nothing of k or more besides, and what the others leave is all that there is for pieces from k to a half
    before further bins are begun."""
    if not sizes:
        return 0
    s = np.sort(np.array(sizes, dtype=np.int64))
    sums = np.concatenate([[0], np.cumsum(s)])
    half = np.searchsorted(s, capacity / 2, side="right")
    k = np.unique(np.concatenate([[0], s[:half]]))
    over, least = np.searchsorted(s, capacity - k, side="right"), np.searchsorted(s, k, side="left")
    over = np.maximum(over, half)
    left = (over - half) * capacity - (sums[over] - sums[half])
    more = np.maximum(0, -((left - (sums[half] - sums[least])) // capacity))
    return int((len(s) - half + more).max())


def largest_first(sizes: list[int]) -> list[int]:
    return sorted(range(len(sizes)), key=lambda i: (-sizes[i], i))


def rank(p: Bins) -> tuple[int, float]:
    return len(p.bins), -p.fitness()


def settlers(sizes: list[int], capacity: int, rnd: random.Random) -> list[Bins]:
    """An island's first population: best fit, and best fit in orders that are disturbed."""
    down = largest_first(sizes)
    noisy = [best_fit(sorted(down, key=lambda i: -sizes[i] * rnd.uniform(0.9, 1.1)), sizes, capacity) for _ in range(POPULATION - 1)]
    return [best_fit(down, sizes, capacity), *noisy]


def generations(pop: list[Bins], sizes: list[int], capacity: int, rnd: random.Random) -> list[Bins]:
    """A population after ROUND generations, its elite first."""
    least = fewest(sizes, capacity)
    pop = sorted(pop, key=rank)
    for _ in range(ROUND):
        if len(pop[0].bins) <= least:
            break
        a, b = sorted(rnd.sample(pop, 2), key=rank)
        child = crossed(a, b, sizes, rnd)
        if rnd.random() < 0.5:
            child = mutated(child, sizes, rnd)
        if rank(child) <= rank(pop[-1]):
            pop[-1] = child
        pop.sort(key=rank)
    return pop


def evolved(sizes: list[int], capacity: int, seed: int) -> list[list[int]]:
    """The search over one shard in one process: the bins (lists of indices of sizes) of the best packing found, the
    fewest, then the fullest. Deterministic."""
    first = best_fit(largest_first(sizes), sizes, capacity)
    if len(first.bins) <= fewest(sizes, capacity):
        return first.bins
    rnds = [random.Random(seed * ISLANDS + k) for k in range(ISLANDS)]
    islands = [settlers(sizes, capacity, r) for r in rnds]
    for _ in range(ROUNDS):
        islands = [generations(pop, sizes, capacity, r) for pop, r in zip(islands, rnds)]
        elites = [pop[0] for pop in islands]
        for pop, guest in zip(islands, elites[-1:] + elites[:-1]):
            pop[-1] = guest
    return min((p for pop in islands for p in pop), key=rank).bins


def pieces(docs: DataFrame, tokenizer: str, end_id: int, capacity: int = CAPACITY) -> DataFrame:
    """A row per piece of each whole text's ids with end_id last: only longer documents are cut, and their first piece
    may be the shorter one. A null text has the end id alone."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc, end = encoder(tokenizer), le([end_id])
        for some in steps((i, t) for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            rows = []
            for (doc_id, _), ids in zip(some, enc.batch([t for _, t in some])):
                ids += end
                n = len(ids) // 4
                cuts = [0, *range(n % capacity or capacity, n + 1, capacity)]
                for k, (lo, hi) in enumerate(zip(cuts, cuts[1:])):
                    rows.append((doc_id, k, lo, hi - lo, zlib.crc32(ids[4 * lo : 4 * hi])))
            yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return small_batches(docs).select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text")).mapInArrow(run, PIECES)


def _in_order(t):
    import pyarrow as pa

    return t.take(pa.array(np.argsort(t.column("uid").to_numpy(), kind="stable")))


def _numbers(bins: list[list[int]], n: int) -> np.ndarray:
    """The bin that each of n pieces is in."""
    out = np.empty(n, dtype=np.int32)
    for k, items in enumerate(bins):
        out[items] = k
    return out


def _members(numbers: np.ndarray) -> list[list[int]]:
    order = np.argsort(numbers, kind="stable")
    cuts = np.nonzero(np.diff(numbers[order]))[0] + 1
    return [x.tolist() for x in np.split(order, cuts)]


def _best_fit(capacity: int):
    """Packs a shard by best fit; open: whether fewer bins may be possible."""

    def pack(t):
        import pyarrow as pa

        t = _in_order(t)
        sizes = t.column("length").to_pylist()
        bins = best_fit(largest_first(sizes), sizes, capacity).bins
        found = pa.array(_numbers(bins, len(sizes)))
        return t.select(["shard", "uid", "length"]).append_column("bin", found).append_column("open", pa.array([len(bins) > fewest(sizes, capacity)] * len(sizes)))

    return pack


def _island(round_: int, epoch: int, capacity: int):
    """ROUND generations of an island of a shard. pop: of each piece, its bin in every packing of the population; guest:
    its bin in the packing that came from the island before. n, fitness: of the elite, which is the first of pop."""

    def evolve(t):
        import pyarrow as pa

        t = _in_order(t)
        sizes = t.column("length").to_pylist()
        shard, island = t.column("shard")[0].as_py(), t.column("island")[0].as_py()
        rnd = random.Random(f"{epoch} {round_} {shard} {island}")
        if round_:
            pop = np.array(t.column("pop").to_pylist(), dtype=np.int32).T.copy()
            pop[-1] = t.column("guest").to_numpy()
            pop = [Bins(capacity, _members(p), sizes) for p in pop]
        else:
            pop = settlers(sizes, capacity, rnd)
        pop = generations(pop, sizes, capacity, rnd)
        told = pa.array(np.stack([_numbers(p.bins, len(sizes)) for p in pop]).T.tolist(), pa.list_(pa.int32()))
        n, fitness = len(pop[0].bins), pop[0].fitness()
        return t.select(["shard", "island", "uid", "length"]).append_column("pop", told).append_column("n", pa.array([n] * len(sizes), pa.int64())).append_column("fitness", pa.array([fitness] * len(sizes)))

    return evolve


def _searched(open_: DataFrame, epoch: int, capacity: int) -> DataFrame:
    """shard, uid, bin of the best packing that the islands of each shard of open_(shard, uid, length) found."""
    pop = open_.select("shard", "uid", "length", F.explode(F.sequence(F.lit(0), F.lit(ISLANDS - 1))).alias("island"))
    out = "shard long, island int, uid long, length long, pop array<int>, n long, fitness double"
    came = None
    for r in range(ROUNDS):
        pop = written(pop.groupBy("shard", "island").applyInArrow(_island(r, epoch, capacity), out), "islands")
        if came is not None:
            drop_written(came)
        came = pop
        if r < ROUNDS - 1:
            guests = pop.select("shard", F.pmod(F.col("island") + 1, F.lit(ISLANDS)).alias("island"), "uid", F.col("pop")[0].alias("guest"))
            pop = pop.join(guests, ["shard", "island", "uid"])
    best = came.groupBy("shard").agg(F.min(F.struct("n", -F.col("fitness"), "island"))["island"].alias("island"))
    return came.join(best, ["shard", "island"]).select("shard", "uid", F.col("pop")[0].alias("bin"))


def packed(rows: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """rows (as of pieces(), lengths 1 to capacity) with sequence_id and offset: gapless from 0 in every sequence.

    Pieces of full length are sequences of their own. Every row gets a place: repeated rows, equal and null ids too; of
    equal packings the first island's counts. An empty table gives no row."""
    rows = written(rows, "pieces").withColumn("uid", F.monotonically_increasing_id())
    names = [c.split()[0] for c in PIECES.split(", ")]
    whole = rows.where(F.col("length") >= capacity).select(*names, (F.col("uid") + F.lit(1 << 61)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    todo = written(rows.where(F.col("length") < capacity), "todo")
    for epoch in range(EPOCHS):
        n = todo.count()
        if not n:
            break
        shards = -(-n // SHARD)
        last = epoch == EPOCHS - 1 or shards == 1
        shard = F.pmod(F.xxhash64("uid", F.lit(epoch)), F.lit(shards)).alias("shard")
        found = written(todo.select(shard, "uid", "length").groupBy("shard").applyInArrow(_best_fit(capacity), "shard long, uid long, length long, bin int, open boolean"), "best")
        best, open_ = found.where("NOT open").select("shard", "uid", "bin"), found.where("open")
        if not open_.isEmpty():
            best = best.unionByName(_searched(open_, epoch, capacity))
        own = Window.partitionBy("shard", "bin")
        rows = todo.join(best, "uid").withColumn("filled", F.sum("length").over(own)).withColumn("offset", F.sum("length").over(own.orderBy("uid").rowsBetween(Window.unboundedPreceding, -1)))
        stays = F.lit(True) if last else F.col("filled") >= FULL * capacity
        rows = written(rows.select(*names, "uid", F.coalesce("offset", F.lit(0)).cast("long").alias("offset"), F.when(stays, F.lit(epoch << 56) + F.col("shard") * (1 << 16) + F.col("bin")).cast("long").alias("sequence_id")), "packed")
        whole = whole.unionByName(rows.where("sequence_id is not null").select(*whole.columns))
        todo = rows.where("sequence_id is null").select(*names, "uid")
        if last:
            break
    return whole
