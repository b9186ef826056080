"""Quality classifier: an interpolated modified Kneser-Ney n-gram model of trusted text.

The model is of the characters of running text: a text's words with one blank between them, after ORDER - 1 opening
marks and before a closing one, so that contexts reach across words. Its n-grams are counted per language over all
trusted documents. Highest-order counts are occurrences, lower ones numbers of different left neighbours; each order
has three discounts, from its own counts of counts, and is interpolated with the next lower. Shares and back-off
weights come from joins of the n-gram tables by context and by suffix, sharded by n-gram; the result is written in
shards of a bounded size, by hash.

Scoring joins the different n-grams of a block of documents with the shards, each shard once a block, whichever
documents it is that need it; a worker keeps what n-grams cost for the blocks that follow, and shards while they fit.
So neither texts nor the model are shuffled or broadcast, and memory is bounded however large the model. Documents are
kept whose perplexity stays below a bound set, for each language, by quantiles of trusted documents that were held
out."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, file_system, release, small_batches, text_slices, work_dir, worker_only, write, written

ORDER = 5
OPEN, CLOSE = "\x02", "\x03"
#: Symbols that an unknown character is one of, all alike.
SYMBOLS = 1024
SHARD_ROWS = 50_000
#: Rows of shards that a worker holds at a time (16 bytes each).
LOADED = 2_000_000
#: N-grams that a worker keeps the costs of (16 bytes each), and n-grams that a task counts before it passes them on.
KEPT, COUNTED = 1_000_000, 400_000
#: Characters that are scored at a time.
BLOCK = 1_000_000
#: Characters of median text that are added to each document, so that a few words alone don't condemn it.
PRIOR = 40
#: The bound is this many interquartile ranges above the upper quartile.
FENCE = 6.0
#: Trusted ids up to which they are broadcast (16 MB); more are joined by shuffle.
BROADCAST_IDS = 1_000_000
#: Odd multiplier of the hash by which n-grams are told apart in a worker.
K = np.uint64(0x9E3779B97F4A7C15)


def trusted_ids(labels: DataFrame) -> DataFrame:
    """Documents of good quality that nobody called toxic; contradictory labels don't count as trust."""
    rows = labels.groupBy("doc_id").agg(F.min("quality").alias("q"), F.max("toxic").alias("t"))
    return rows.where("q = 1 AND coalesce(t, 0) = 0 AND doc_id IS NOT NULL").select(F.col("doc_id").cast("long"))


def held(doc_id: str) -> F.Column:
    """A fifth of the trusted documents, which set the bounds and are not trained on."""
    return F.pmod(F.xxhash64(doc_id), F.lit(5)) == 0


def running(text: str | None) -> str:
    """A text as the model sees it; one without a word has nothing to see."""
    words = (text or "").split()
    return OPEN * (ORDER - 1) + " ".join(words) + CLOSE if words else ""


def pieces(texts: list[str]) -> Iterator[tuple[int, str]]:
    """(index, piece) of all texts in turn: a text longer than BLOCK comes in pieces that together have its n-grams."""
    for i, s in enumerate(texts):
        for lo in range(0, max(0, len(s) - ORDER + 1), BLOCK):
            yield i, s[lo : lo + BLOCK + ORDER - 1]


class Grams:
    """The different n-grams of some pieces of text. at: the number of each place's n-gram; sizes: places of each
    piece; keys: a hash of each different one; where: a place in whole that has it."""

    def __init__(self, some: list[str], salts: list[int]):
        self.whole = "".join(some)
        code = np.frombuffer(self.whole.encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        n = len(code) - ORDER + 1
        key = np.zeros(max(n, 0), dtype=np.uint64)
        for j in range(ORDER):
            key = key * K + code[j : j + n]
        self.sizes = np.array([len(s) - ORDER + 1 for s in some], dtype=np.int64)
        ends = np.cumsum(self.sizes + ORDER - 1)
        first = np.ones(len(key), dtype=bool)
        for j in range(1, ORDER):
            first[ends[:-1] - j] = False  # these would reach into the next piece
        place = np.nonzero(first)[0]
        found = pa.array(key[place] * K + np.repeat(np.array(salts, dtype=np.uint64), self.sizes)).dictionary_encode()
        self.at, self.keys = found.indices.to_numpy(), found.dictionary.to_numpy()
        self.where = np.empty(len(self.keys), dtype=np.int64)
        self.where[self.at] = place

    def gram(self, k: int) -> str:
        return self.whole[self.where[k] : self.where[k] + ORDER]


def blocks(rows: Iterator[tuple[int, str]]) -> Iterator[list[tuple[int, str]]]:
    """Lists of pieces of about BLOCK characters together."""
    some, held = [], 0
    for r in rows:
        some.append(r)
        held += len(r[1])
        if held >= BLOCK:
            yield some
            some, held = [], 0
    if some:
        yield some


def gram_counts(docs: DataFrame) -> DataFrame:
    """lang, g, n: the n-grams of docs(lang, text), pre-aggregated in each task."""

    def count(batches: Iterator) -> Iterator:
        release()
        sums: dict[str, Counter] = {}

        def out():
            for lang, c in sums.items():
                yield pa.record_batch([pa.array([lang] * len(c), pa.string()), pa.array(list(c), pa.string()), pa.array(list(c.values()), pa.int64())], ["lang", "g", "n"])
            sums.clear()

        for b in text_slices(batches, 1):
            of: dict[str, list[str]] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                of.setdefault(lang, []).append(running(text))
            for lang, texts in of.items():
                for some in blocks(pieces(texts)):
                    grams = Grams([s for _, s in some], [0] * len(some))
                    n = np.bincount(grams.at, minlength=len(grams.keys)).tolist()
                    sums.setdefault(lang, Counter()).update(dict(zip(map(grams.gram, range(len(n))), n)))
                if sum(map(len, sums.values())) > COUNTED:
                    yield from out()
        yield from out()

    return small_batches(docs).select("lang", "text").mapInArrow(count, "lang string, g string, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))


def train(docs: DataFrame) -> str:
    """Trains on docs(lang, text), both not null; returns the folder of the model's shards (h long, v double): h is a
    hash of language and n-gram with the log of its probability, or of language and context with the log of its
    back-off weight. Beside it the number of shards and the languages, of which there is a row each."""
    spark = docs.sparkSession
    tables = {ORDER: written(gram_counts(docs), "grams")}
    for k in range(ORDER - 1, 0, -1):
        tables[k] = written(tables[k + 1].groupBy("lang", F.expr("substring(g, 2)").alias("g")).agg(F.count("*").alias("n")), "grams")
    out, shares, lower = [], [], None
    for k in range(1, ORDER + 1):
        counts = tables[k].groupBy("lang").agg(*[F.sum((F.col("n") == j).cast("double")).alias(f"n{j}") for j in range(1, 5)])
        y = "(n1 / (n1 + 2 * n2))"
        disc = counts.select("lang", *[F.expr(f"CASE WHEN n1 > 0 AND n2 > 0 AND n{j} > 0 THEN least(greatest({j} - {j + 1} * {y} * n{j + 1} / n{j}, 0.05 * {j}), 0.95 * {j}) ELSE 0.5 * {j} END").alias(f"d{j}") for j in (1, 2, 3)])
        table = tables[k].join(F.broadcast(disc), "lang").withColumn("ctx", F.expr(f"substring(g, 1, {k - 1})")).withColumn("d", F.expr("CASE n WHEN 1 THEN d1 WHEN 2 THEN d2 ELSE d3 END"))
        context = table.groupBy("lang", "ctx").agg(F.sum("n").alias("c"), F.sum("d").alias("left")).select("lang", "ctx", "c", (F.col("left") / F.col("c")).alias("gamma"))
        table = table.join(context, ["lang", "ctx"])
        if lower is None:
            table = table.withColumn("q", F.lit(1.0 / SYMBOLS))
        else:
            table = table.withColumn("suffix", F.expr("substring(g, 2)")).join(lower, ["lang", "suffix"])
        p = written(table.select("lang", "g", (F.greatest((F.col("n") - F.col("d")) / F.col("c"), F.lit(0.0)) + F.col("gamma") * F.col("q")).alias("p")), "shares")
        shares.append(p)
        lower = p.select("lang", F.col("g").alias("suffix"), F.col("p").alias("q"))
        out += [p.select(_hash("P", "g").alias("h"), F.log("p").alias("v")), context.select(_hash("B", "ctx").alias("h"), F.log("gamma").alias("v"))]
    model = out[0]
    for more in out[1:]:
        model = model.unionByName(more)
    n = tables[ORDER].count() * 3
    shards = max(1, -(-n // SHARD_ROWS))
    path = work_dir(spark, "model")
    shard = F.pmod("h", F.lit(shards)).cast("int")
    rows = model.select(shard.alias("shard"), "h", "v").repartitionById(shards, F.col("shard"))
    write(rows, path, "shard")
    langs = sorted(r.lang for r in tables[1].select("lang").distinct().collect())
    size = pa.table({"shards": pa.array([shards], pa.int32()), "langs": pa.array([langs], pa.list_(pa.string()))})
    spark.createDataFrame(size).coalesce(1).write.parquet(f"{path}.size")
    for t in [*tables.values(), *shares]:
        drop_written(t)
    return path


def _hash(kind: str, gram: str) -> F.Column:
    return F.xxhash64(F.concat(F.lit(kind), "lang", F.lit("\x00"), gram))


class Scorer:
    """Costs (minus log probability) of texts under a model in shared storage."""

    def __init__(self, path: str, shards: int):
        self.fs, self.top = file_system(path)
        self.shards = shards
        self.loaded: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        self.forget()

    def forget(self) -> None:
        self.keys, self.costs = np.empty(0, dtype=np.uint64), np.empty(0)

    def shard(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        if k not in self.loaded:
            import pyarrow.dataset as ds
            from pyarrow import fs as pafs

            found = self.fs.get_file_info(pafs.FileSelector(f"{self.top}/shard={k}", allow_not_found=True))
            files = [f.path for f in found if f.path.endswith(".parquet")]
            t = ds.dataset(files, filesystem=self.fs, format="parquet").to_table(columns=["h", "v"], use_threads=False) if files else None
            h, v = (t.column("h").to_numpy(), t.column("v").to_numpy()) if files else (np.empty(0, np.int64), np.empty(0))
            order = np.argsort(h)
            while self.loaded and sum(len(x) for x, _ in self.loaded.values()) + len(h) > LOADED:
                self.loaded.pop(next(iter(self.loaded)))
            self.loaded[k] = h[order], v[order]
        return self.loaded[k]

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys; NaN for those the model hasn't. Each shard is visited once, those at hand first."""
        out = np.full(len(keys), np.nan)
        at = keys % self.shards
        order = np.argsort(at, kind="stable")
        ends = np.searchsorted(at[order], np.arange(self.shards + 1))
        for k in sorted(range(self.shards), key=lambda k: k not in self.loaded):
            own = order[ends[k] : ends[k + 1]]
            if len(own):
                h, v = self.shard(k)
                i = np.minimum(np.searchsorted(h, keys[own]), max(0, len(h) - 1))
                if len(h):
                    out[own] = np.where(h[i] == keys[own], v[i], np.nan)
        return out

    def learn(self, langs: list[str], grams: list[str]) -> np.ndarray:
        """Minus log p of the last character of each n-gram after the others: the longest known n-gram's share, times
        the back-off weights of the longer contexts that are known. All are looked up together."""
        import xxhash

        number: dict[str, int] = {}
        ask = lambda kind, lang, g: number.setdefault(f"{kind}{lang}\x00{g}", len(number))
        shares = np.array([[ask("P", lang, g[-k:]) for k in range(ORDER, 0, -1)] for lang, g in zip(langs, grams)])
        backs = np.array([[ask("B", lang, g[-k:-1]) for k in range(ORDER, 0, -1)] for lang, g in zip(langs, grams)])
        hashes = np.fromiter((xxhash.xxh64_intdigest(x.encode("utf-8", "surrogatepass"), 42) for x in number), dtype=np.uint64, count=len(number))
        values = self.find(hashes.view(np.int64))
        logp, open_ = np.zeros(len(grams)), np.ones(len(grams), dtype=bool)
        for k in range(ORDER):
            share, back = values[shares[:, k]], values[backs[:, k]]
            hit = open_ & ~np.isnan(share)
            logp[hit] += share[hit]
            open_ &= ~hit
            logp[open_] += np.nan_to_num(back[open_])
        logp[open_] -= np.log(SYMBOLS)
        return -logp

    def score(self, langs: list[str], texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The sum of costs and the number of n-grams of each text, closing mark included."""
        total, n = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
        names = sorted(set(langs))
        salt = {lang: k for k, lang in enumerate(names)}
        salts = [hash_of(lang) for lang in names]
        for some in blocks(pieces(texts)):
            own = [salt[langs[i]] for i, _ in some]
            grams = Grams([s for _, s in some], [salts[k] for k in own])
            cost = self.costs_of(grams, np.repeat(own, grams.sizes), names)
            sums = np.add.reduceat(cost[grams.at], np.cumsum(grams.sizes) - grams.sizes)
            for (i, _), c, m in zip(some, sums.tolist(), grams.sizes.tolist()):
                total[i] += c
                n[i] += m
        return total, n

    def costs_of(self, grams: Grams, own: np.ndarray, names: list[str]) -> np.ndarray:
        """The cost of each different n-gram; own: the language of each place."""
        if len(self.keys):
            at = np.minimum(np.searchsorted(self.keys, grams.keys), len(self.keys) - 1)
            cost = np.where(self.keys[at] == grams.keys, self.costs[at], np.nan)
        else:
            cost = np.full(len(grams.keys), np.nan)
        new = np.nonzero(np.isnan(cost))[0]
        if len(new):
            lang = np.empty(len(grams.keys), dtype=np.int64)
            lang[grams.at] = own
            cost[new] = self.learn([names[k] for k in lang[new].tolist()], list(map(grams.gram, new.tolist())))
            if len(self.keys) + len(new) > KEPT:
                self.forget()
                new = np.arange(len(grams.keys))
            keys, costs = np.concatenate([self.keys, grams.keys[new]]), np.concatenate([self.costs, cost[new]])
            order = np.argsort(keys)
            self.keys, self.costs = keys[order], costs[order]
        return cost


def hash_of(lang: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(lang, 1)


def scorer(path: str, shards: int) -> Scorer:
    """This worker's view of a model; it outlives the task."""
    return worker_only("scorer", path, lambda: Scorer(path, shards))


def costs(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, th (hash of the text), lang, judge (the language whose model is applied: lang, or for rows without one
    that which makes the text most probable, the first of equals), cost, n, wordy (whether it has a word) of every row
    of docs, from its whole text. Nothing is shuffled."""
    size = docs.sparkSession.read.parquet(f"{path}.size").first()
    shards, known = size.shards, size.langs

    def run(batches: Iterator) -> Iterator:
        s = scorer(path, shards)
        for b in text_slices(batches, 3):
            langs, texts = b.column(2).to_pylist(), list(map(running, b.column(3).to_pylist()))
            judge, cost, n = list(langs), np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
            own = [i for i, lang in enumerate(langs) if lang is not None]
            cost[own], n[own] = s.score([langs[i] for i in own], [texts[i] for i in own])
            none = [i for i, lang in enumerate(langs) if lang is None]
            if none and known:
                each = [s.score([lang] * len(none), [texts[i] for i in none]) for lang in known]
                best = np.argmin([c for c, _ in each], axis=0)
                for i, row, k in zip(none, range(len(none)), best.tolist()):
                    judge[i], cost[i], n[i] = known[k], each[k][0][row], each[k][1][row]
            yield pa.record_batch([*b.columns[:3], pa.array(judge, pa.string()), pa.array(cost), pa.array(n), pa.array([t != "" for t in texts], pa.bool_())], ["doc_id", "th", "lang", "judge", "cost", "n", "wordy"])

    rows = small_batches(docs).select(F.col("doc_id").cast("long"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th"), F.col("lang").cast("string"), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, th long, lang string, judge string, cost double, n long, wordy boolean")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, th, lang, n_grams, perplexity, bound, kept for each row of docs.

    perplexity: per character, over the whole text. kept: the mean cost, with PRIOR characters of the language's
    median text added, is at most its bound. Texts without a word (null, empty, blank) are not kept, and have no
    perplexity. Rows whose lang is null are held to the language that makes them most probable. A language with
    trusted text, of which none is held out, has the bound of all languages together; texts of one without trusted
    text can't be told and are kept, without perplexity or bound, as all are where nothing is trusted. Rows with equal
    id and text fare alike; ties keep; an empty table gives no row; other columns of docs and labels are ignored."""
    ids = trusted_ids(labels)
    mark = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    usable = docs.where("lang is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string"), F.col("text").cast("string")).where(~held("doc_id"))
    path = train(usable.join(mark, "doc_id", "left_semi"))
    rows = written(costs(docs, path), "costs")
    mean = F.col("cost") / F.col("n")
    checked = rows.where("n > 0 and lang is not null").where(held("doc_id")).join(mark, "doc_id", "left_semi").withColumn("mean", mean)
    # a row per language, and one of null for all together
    every = checked.unionByName(checked.withColumn("judge", F.lit(None).cast("string")))
    cuts = every.groupBy("judge").agg(F.percentile_approx("mean", 0.5, 10_000).alias("median"))
    shrunk = (F.col("cost") + PRIOR * F.col("median")) / (F.col("n") + PRIOR)
    own = every.join(F.broadcast(cuts.withColumnRenamed("judge", "j")), F.col("judge").eqNullSafe(F.col("j"))).drop("j")
    fences = own.groupBy("judge").agg(F.percentile_approx(shrunk, [0.25, 0.5, 0.75], 10_000).alias("q"), F.first("median").alias("median"))
    fences = fences.select("judge", "median", (F.col("q")[2] + FENCE * F.greatest(F.col("q")[2] - F.col("q")[0], 0.01 * F.col("q")[1])).alias("bound")).collect()
    spark, langs = docs.sparkSession, docs.sparkSession.read.parquet(f"{path}.size").first().langs
    known = {r.judge: (r.median, r.bound) for r in fences}
    table = [(lang, *known.get(lang, known.get(None, (None, None)))) for lang in langs]
    bounds = spark.createDataFrame(pa.table([pa.array([t[i] for t in table], k) for i, k in enumerate((pa.string(), pa.float64(), pa.float64()))], ["judge", "median", "bound"]))
    out = rows.join(F.broadcast(bounds), "judge", "left")
    seen = (F.col("n") > 0) & F.col("judge").isin(langs) if langs else F.lit(False)
    kept = F.coalesce(shrunk <= F.col("bound"), F.lit(True)) & F.col("wordy")
    return out.select("doc_id", "th", "lang", F.col("n").alias("n_grams"), F.when(seen, F.exp(mean)).alias("perplexity"), F.exp("bound").alias("bound"), kept.alias("kept"))
