"""Document fingerprints by a homomorphic multiset hash.

A document is the multiset of its paragraphs (lines). Each paragraph is hashed to a wide vector, and a fingerprint is
the sum of its paragraphs' vectors, lane by lane modulo powers of two. Order doesn't count, and a paragraph is put in
or taken out by one addition or subtraction: the edited text's fingerprint is made so, from the paragraphs that the
edit touches alone.

The first lanes (EXACT, modulo 2^32) come from an extendable hash of the paragraph and decide equality. The others
(SKETCH, modulo 2^32) count the paragraph's 12-byte windows with signs, so that the cosine of two documents' lanes
estimates how much text they share, whichever the paragraphs."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_ranges, shuffle_parts, small_batches

EXACT, SKETCH, WINDOW = 32, 128, 12
K1, K2, K3 = (np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9))  # odd multipliers


class Fingerprint:
    """exact: EXACT lanes of u32; sketch: SKETCH lanes of u32."""

    __slots__ = ("exact", "sketch")

    def __init__(self, exact: np.ndarray, sketch: np.ndarray):
        self.exact, self.sketch = exact, sketch

    def __add__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.exact + other.exact, self.sketch + other.sketch)

    def __sub__(self, other: Fingerprint) -> Fingerprint:
        return Fingerprint(self.exact - other.exact, self.sketch - other.sketch)

    def __str__(self) -> str:
        return base64.b64encode(self.exact.astype("<u4").tobytes() + self.sketch.astype("<u4").tobytes()).decode()

    def same(self, other: Fingerprint) -> bool:
        return np.array_equal(self.exact, other.exact) and np.array_equal(self.sketch, other.sketch)

    def likeness(self, other: Fingerprint) -> float:
        """1 if the fingerprints are equal, else the cosine of their sketches, at least 0 and less than 1."""
        if self.same(other):
            return 1.0
        a, b = (x.sketch.view(np.int32).astype(np.float64) for x in (self, other))
        size = np.sqrt((a @ a) * (b @ b))
        return float(min(max(a @ b / size, 0.0), 1 - 1e-6)) if size else 0.0


def of_paragraphs(paragraphs: list[str]) -> Fingerprint:
    """The sum of the paragraphs' vectors; of none: zero."""
    parts = [p.encode("utf-8", "surrogatepass") for p in paragraphs]
    digests = b"".join(hashlib.shake_128(p).digest(4 * EXACT) for p in parts)
    exact = np.frombuffer(digests, dtype="<u4").reshape(-1, EXACT).sum(axis=0, dtype=np.uint32)
    sketch = np.zeros(SKETCH, dtype=np.int64)
    # each window begins in a paragraph and sees zeros after its end; parts are cut to bound memory on long texts
    gap = b"\0" * WINDOW
    data, some, held = [], [], 0
    for p in [*parts, None]:
        if p is not None:
            some.append(p)
            held += len(p)
        if held > 2_000_000 or p is None:
            data.append(gap.join(some) + gap)
            some, held = [], 0
    for whole in data:
        for lo in range(0, len(whole) - WINDOW + 1, 2_000_000):
            buf = np.frombuffer(whole[lo : lo + 2_000_000 + WINDOW - 1], dtype=np.uint8)
            n = len(buf) - WINDOW + 1
            views = np.lib.stride_tricks.sliding_window_view(buf, WINDOW)[buf[:n] != 0]
            words = np.ascontiguousarray(views)
            h = (words[:, :8].copy().view("<u8")[:, 0] * K1) ^ (words[:, 4:].copy().view("<u8")[:, 0] * K2)
            h = (h ^ h >> np.uint64(29)) * K3
            lane = (h >> np.uint64(57)).astype(np.int64)
            sketch += np.bincount(lane, minlength=SKETCH) - 2 * np.bincount(lane[(h >> np.uint64(40) & np.uint64(1)).astype(bool)], minlength=SKETCH)
    return Fingerprint(exact, (sketch & 0xFFFFFFFF).astype(np.uint32))


def of_text(text: str) -> Fingerprint:
    return of_paragraphs(text.split("\n"))


def edit(text: str, after: str) -> tuple[str, list[str], list[str]]:
    """The text with its last floor(n/4) code points replaced by the first as many of after; the paragraphs that go
    and those that come."""
    n = len(text)
    keep = text[: n - n // 4]
    tail = after[: n // 4]
    whole = keep.rfind("\n") + 1
    return keep + tail, text[whole:].split("\n"), (keep[whole:] + tail).split("\n")


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def with_edits(docs: DataFrame) -> DataFrame:
    """Each document's fingerprint, its edited text's, and the likeness to that and to the next document by doc_id
    (after the last: the first).

    Rows go to ranges of doc_id, and the first row of each range goes to the range before as well, so that every
    document meets its successor in one shuffle of the texts. A null text is empty (one empty paragraph); null ids
    come first; rows of equal id follow each other by text, and each gives a row; a sole document follows itself; an
    empty table gives no row; other columns are ignored."""
    spark = docs.sparkSession
    rows, bounds = id_ranges(small_batches(docs).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), "doc_id")
    parts = len(bounds) + 1
    least = docs.agg(F.count("*").alias("n"), F.count("doc_id").alias("ids"), F.min(F.col("doc_id").cast("long")).alias("low")).first()
    first = F.col("doc_id").isNull() if least.n > least.ids else F.col("doc_id") == F.lit(least.low)
    opens = F.coalesce(first, F.lit(False))
    if bounds:
        opens = opens | F.coalesce(F.array_contains(F.array(*map(F.lit, bounds)), F.col("doc_id")), F.lit(False))
    at = F.struct(F.col("__part").alias("part"), F.lit(False).alias("look"))
    ahead = F.struct(F.expr(f"pmod(__part - 1, {parts})").cast("int").alias("part"), F.lit(True).alias("look"))
    rows = rows.withColumn("at", F.explode(F.when(opens, F.array(at, ahead)).otherwise(F.array(at)))).select("doc_id", "text", "at.part", "at.look")
    rows = rows.repartitionById(max(parts, shuffle_parts(spark)), F.col("part")).sortWithinPartitions("part", "look", F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        held, out = None, []

        def batch():
            kinds = (pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64())
            return pa.record_batch([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], [c.split()[0] for c in OUT.split(", ")])

        for b in batches:
            for doc_id, text, look in zip(*(b.column(c).to_pylist() for c in ("doc_id", "text", "look"))):
                own = of_text(text)
                if held is not None:
                    i, t, f = held
                    edited, gone, come = edit(t, text)
                    g = f - of_paragraphs(gone) + of_paragraphs(come)
                    out.append((i, len(t), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), str(f), str(g), f.likeness(g), f.likeness(own)))
                    if len(out) == 2_000:
                        yield batch()
                        out = []
                if look:
                    held = None
                    break  # the rows after it are others that share its id
                held = doc_id, text, own
        yield batch()

    return rows.mapInArrow(run, OUT)
