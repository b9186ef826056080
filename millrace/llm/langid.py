"""Language ID by error-correcting output codes.

Each language has a codeword of bits; a binary n-gram classifier per bit tells the languages with 1 from those with 0.
Its weights are log ratios of n-gram shares (byte bigrams, and byte trigrams hashed to TRIGRAMS buckets, of the
lower-cased text), where each language weighs alike. A text's margin in a bit is the sum of its n-grams' weights over
the root of their number. Loss-weighted decoding takes the codeword whose bits, each weighed by how surely that
classifier was right on training texts of that language, lose least; if the second loses little more, the text is
ambiguous."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import array_slices, release, small_batches, text_slices, written

BIGRAMS, TRIGRAMS = 1 << 16, 1 << 17
#: Documents of each language that are learnt from: about so many, those with the least hashes of doc_id.
SAMPLE = 2_000
#: A text whose two best codewords lose so nearly the same is ambiguous.
AMBIGUOUS = 0.10
UNKNOWN = "und"


def codewords(k: int) -> np.ndarray:
    """k rows of +-1. Up to 6 languages: all ways to part them; beyond, the best of 500 random codes."""
    if k <= 1:
        return np.ones((k, 1), dtype=np.int8)
    if k <= 6:
        return np.array([[1 if not i or not b >> (i - 1) & 1 else -1 for b in range(1, 1 << (k - 1))] for i in range(k)], dtype=np.int8)
    rng, bits = np.random.default_rng(k), min(63, 10 * int(np.ceil(np.log2(k))))
    best = None
    for _ in range(500):
        code = rng.choice(np.array([-1, 1], dtype=np.int8), size=(k, bits))
        apart = (code[:, None, :] != code[None]).sum(axis=2) + bits * np.eye(k, dtype=int)
        whole = (np.abs(code.sum(axis=0)) < k).all()
        if whole and (best is None or apart.min() > best[0]):
            best = apart.min(), code
    return best[1]


def grams(text: str) -> np.ndarray:
    """Features of a text, repeats included. Memory is bounded by the caller's parts of it."""
    b = np.frombuffer(b" " + text.lower().encode("utf-8", "surrogatepass") + b" ", dtype=np.uint8).astype(np.int32)
    two = b[:-1] << 8 | b[1:]
    three = ((two[:-1].astype(np.uint32) << np.uint32(8) | b[2:].astype(np.uint32)) * np.uint32(2654435761)) >> np.uint32(15)
    return np.concatenate([two, BIGRAMS + three.astype(np.int32)])


def parts(text: str, size: int = 500_000) -> Iterator[str]:
    """All of a text, a bounded part at a time."""
    for lo in range(0, max(1, len(text)), size):
        yield text[lo : lo + size]


def margins(text: str, weights: np.ndarray) -> np.ndarray:
    total, n = np.zeros(weights.shape[1]), 0
    for p in parts(text):
        g = grams(p)
        total += weights[g].sum(axis=0, dtype=np.float64)
        n += len(g)
    return total / np.sqrt(n)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


class Model:
    """langs, in order; code: a row of +-1 for each; weights: features by bits; trust: languages by bits."""

    def __init__(self, langs: list[str], code: np.ndarray, weights: np.ndarray, trust: np.ndarray):
        self.langs, self.code, self.weights, self.trust = langs, code, weights, trust

    def losses(self, m: np.ndarray) -> np.ndarray:
        return (self.trust * np.logaddexp(0, -self.code * np.clip(m, -30, 30))).sum(axis=1)

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return UNKNOWN, 0.0
        if len(self.langs) == 1:
            return self.langs[0], 1.0
        loss = self.losses(margins(text, self.weights))
        one, two = np.argsort(loss, kind="stable")[:2]
        return self.langs[one], float(1 - (loss[one] + 1e-12) / (loss[two] + 1e-12))


def held_out(doc_id) -> F.Column:
    """crc32 of doc_id as text leaves no remainder by 5; a row without doc_id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(True))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from text and non-null lang of docs that are not held out. Rows are chosen by a hash of doc_id, as many
    of each language in expectation, whatever its share. The n-gram counts are summed by the cluster; the driver gets
    one row per language and feature, at most languages * (BIGRAMS + TRIGRAMS)."""
    known = small_batches(docs).where("lang is not null and text is not null").where(~held_out("doc_id")).select(F.col("doc_id").cast("long"), "text", "lang")
    shares = known.groupBy("lang").count()
    ratio = F.least(F.lit(1.0), F.lit(float(sample)) / F.col("count"))
    picked = known.join(F.broadcast(shares.select("lang", ratio.alias("ratio"))), "lang").where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) < F.col("ratio") * (1 << 30)).select("lang", "text")
    picked = written(picked, "sample")

    def count(batches: Iterator) -> Iterator:
        release()
        sums: dict[str, np.ndarray] = {}
        for b in text_slices(batches, 1):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                into = sums.setdefault(lang, np.zeros(BIGRAMS + TRIGRAMS, dtype=np.int64))
                for p in parts(text):
                    into += np.bincount(grams(p), minlength=BIGRAMS + TRIGRAMS)
        for lang, into in sums.items():
            at = np.nonzero(into)[0]
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(into[at])], ["lang", "feature", "n"])

    counts = picked.mapInArrow(count, "lang string, feature int, n long").groupBy("lang", "feature").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    code = codewords(len(langs))
    share = np.zeros((len(langs), BIGRAMS + TRIGRAMS))
    for i, lang in enumerate(langs):
        own = counts[counts["lang"] == lang]
        row = np.full(BIGRAMS + TRIGRAMS, 0.1)
        row[own["feature"].to_numpy()] += own["n"].to_numpy()
        for lo, hi in ((0, BIGRAMS), (BIGRAMS, BIGRAMS + TRIGRAMS)):
            share[i, lo:hi] = row[lo:hi] / row[lo:hi].sum()
    if len(langs) < 2:
        return Model(langs, code, np.zeros((BIGRAMS + TRIGRAMS, code.shape[1]), dtype=np.float32), np.ones(code.shape))
    weights = np.stack([np.log(share[code[:, b] > 0].mean(axis=0)) - np.log(share[code[:, b] < 0].mean(axis=0)) for b in range(code.shape[1])], axis=1).astype(np.float32)
    sent = docs.sparkSession.sparkContext.broadcast(weights)  # features by at most 63 bits, whatever the corpus
    row_of = {lang: i for i, lang in enumerate(langs)}

    def right(batches: Iterator) -> Iterator:
        ok, n = np.zeros(code.shape), np.zeros(len(langs), dtype=np.int64)
        for b in text_slices(batches, 1):
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                i = row_of[lang]
                ok[i] += code[i] * margins(text, sent.value) > 0
                n[i] += 1
        yield pa.record_batch([pa.array([lang for lang in langs], pa.string()), pa.array(n), pa.array(ok.tolist(), pa.list_(pa.float64()))], ["lang", "n", "ok"])

    trust = np.ones(code.shape)
    for r in picked.mapInArrow(right, "lang string, n long, ok array<double>").groupBy("lang").agg(F.sum("n").alias("n"), *[F.sum(F.col("ok")[b]).alias(f"ok{b}") for b in range(code.shape[1])]).collect():
        trust[row_of[r.lang]] = [(r[f"ok{b}"] + 1) / (r.n + 2) for b in range(code.shape[1])]
    sent.destroy()
    return Model(langs, code, weights, trust / trust.sum(axis=1, keepdims=True))


def predicted(docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, lang_pred, score (0 to 1), ambiguous for each row, from its whole text alone. A null text or one without a
    letter: und, 0, true. Equal losses: the first language in order. Nothing is shuffled."""
    sent = small_batches(docs).sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator) -> Iterator:
        release()
        for b in text_slices(batches, 1):
            out = [sent.value.predict(t) for t in b.column(1).to_pylist()]
            score = [s for _, s in out]
            yield pa.record_batch([b.column(0), pa.array([p for p, _ in out], pa.string()), pa.array(score, pa.float64()), pa.array([s < AMBIGUOUS for s in score], pa.bool_())], ["key", "lang_pred", "score", "ambiguous"])

    return docs.select(F.col(key).cast("long"), F.col(text).cast("string")).mapInArrow(run, "key long, lang_pred string, score double, ambiguous boolean").withColumnRenamed("key", key)


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """docs with lang_pred, score and ambiguous beside each row's own columns, without a shuffle. Only texts go through
    Python."""
    sent = small_batches(docs).sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double, ambiguous: boolean>")
    def found(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        release()
        for texts in parts:
            out = [sent.value.predict(t) for some in array_slices(texts) for t in some.to_pylist()]
            score = [s for _, s in out]
            yield pa.StructArray.from_arrays([pa.array([p for p, _ in out], pa.string()), pa.array(score, pa.float64()), pa.array([s < AMBIGUOUS for s in score], pa.bool_())], ["lang_pred", "score", "ambiguous"])

    # else a filter on what it returns would be pushed below it, and the model be applied twice
    once = found.asNondeterministic()
    rows = docs.drop("lang_pred", "score", "ambiguous").withColumn("__found", once(F.col("text").cast("string")))
    return rows.select("*", "__found.*").drop("__found")


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, ambiguous: fits on docs and predicts all of them. Without any labelled row
    every prediction is und; with one language all texts with a letter are of it. Repeated rows repeat; an empty
    table gives no row; other columns are ignored."""
    return predicted(docs, fit(docs)).select("doc_id", held_out("doc_id").alias("held_out"), "lang_pred", "score", "ambiguous")
