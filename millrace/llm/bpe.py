"""BPE encoding by backtracking over longest matches, and decoding by an offset table.

A text is cut by the byte-level pattern as the library does. In a piece, an Aho-Corasick automaton over the whole
vocabulary finds the longest token at every position in one scan. Encoding takes the longest token, checks that it is
compatible with the one before (the two would stay apart if their bytes alone were encoded), else takes the longest
token that is a proper prefix of it, else steps back; a position proved dead is never tried again. Sequences whose
neighbours are all compatible are exactly those that merging by rank makes, so the ids are the library's, in time
linear in the piece however long it is."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches, worker_only
from .records import steps
from .tokens import Encoder, byte_letters, le

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"  # fixed value of byte-level BPE
KEPT_PAIRS = 1_000_000


class OffsetTable:
    """Byte strings end to end, and where each begins: many are joined by one gather."""

    def __init__(self, strings: list[bytes]):
        self.sizes = np.fromiter(map(len, strings), dtype=np.int64, count=len(strings))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.blob = np.frombuffer(b"".join(strings), dtype=np.uint8)

    def join(self, ids: np.ndarray) -> bytes:
        out = []
        for lo in range(0, len(ids), 1 << 18):
            some = ids[lo : lo + (1 << 18)]
            sizes = self.sizes[some]
            before = np.cumsum(sizes) - sizes
            out.append(self.blob[np.arange(sizes.sum()) + np.repeat(self.starts[some] - before, sizes)].tobytes())
        return b"".join(out)


class Bpe(Encoder):
    """The same interface and chunks as Encoder, with no library call: whole() is the backtracking encoder."""

    def __init__(self, path: str):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        raw = {t: bytes(letters[c] for c in t) for t in vocab if t not in self.special}
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        # tokens are numbered by rank: single bytes, then merges in order
        order = [t for t in raw if len(raw[t]) == 1]
        order += list(dict.fromkeys(a + b for a, b in merges))
        at = {t: i for i, t in enumerate(order)}
        self.bytes_ = [raw[t] for t in order]
        self.ids = [vocab[t] for t in order]
        self.split: list[tuple[int, int] | None] = [None] * len(order)
        self.merged: dict[tuple[int, int], int] = {}
        for a, b in merges:
            if self.split[at[a + b]] is None:
                self.split[at[a + b]] = (at[a], at[b])
            self.merged.setdefault((at[a], at[b]), at[a + b])
        known = {b: i for i, b in enumerate(self.bytes_)}
        self.shorter = [next((known[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in known), None) for b in self.bytes_]
        self.size = [len(b) for b in self.bytes_]
        self.matcher = ahocorasick.Automaton()
        for b, i in known.items():
            self.matcher.add_word(b.decode("latin-1"), i)
        self.matcher.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.cut = regex.compile(PATTERN)
        self.marks = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        by_id = {i: b for i, b in zip(self.ids, self.bytes_)} | {i: s.encode() for s, i in self.special.items()}
        strings = [by_id.get(i, b"") for i in range(max(by_id) + 1)]
        self.table = OffsetTable(strings)
        self.decimal = OffsetTable([b"%d," % i for i in range(len(strings))])
        self.start(spaced=True)

    def compatible(self, a: int, b: int) -> bool:
        """Whether a then b stay two tokens. Undoes the later of the two merges, again and again: if the parts that
        then meet merge by a rank that comes before what was undone, they would have met first."""
        key = (a, b)
        if (known := self.pairs.get(key)) is not None:
            return known
        if len(self.pairs) > KEPT_PAIRS:
            self.pairs.clear()
        limit, good = len(self.split), True
        while True:
            m = self.merged.get((a, b))
            if m is not None and m < limit:
                good = False
                break
            if a > b:
                if self.split[a] is None:
                    break
                limit, a = a, self.split[a][1]
            else:
                if self.split[b] is None:
                    break
                limit, b = b + 1, self.split[b][0]
        self.pairs[key] = good
        return good

    def piece(self, data: bytes) -> list[int]:
        n, size, shorter, compatible = len(data), self.size, self.shorter, self.compatible
        longest = [0] * (n + 1)
        for end, t in self.matcher.iter(data.decode("latin-1")):
            longest[end + 1 - size[t]] = t  # matches come by their ends: the last is the longest
        alive = bytearray(b"\1") * (n + 1)
        out: list[int] = []
        pos, token = 0, longest[0]
        while pos < n:
            last = out[-1] if out else None
            while token is not None:
                if alive[pos + size[token]] and (last is None or compatible(last, token)):
                    break
                token = shorter[token]
            if token is not None:
                out.append(token)
                pos += size[token]
                token = longest[pos]
            else:
                alive[pos] = 0
                token = out.pop()
                pos -= size[token]
        return [self.ids[t] for t in out]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        at = 0
        for m in self.marks.finditer(text) if self.marks else ():
            for p in self.cut.findall(text[at : m.start()]):
                out += self.piece(p.encode("utf-8", "surrogatepass"))
            out.append(self.special[m.group()])
            at = m.end()
        for p in self.cut.findall(text[at:]):
            out += self.piece(p.encode("utf-8", "surrogatepass"))
        return out

    def whole(self, texts: list[str]) -> list[bytes]:
        return [le(self.encode(t)) for t in texts]

    def stem(self, stem: str) -> bytes:
        return le(self.piece(stem.encode()))

    def decode(self, ids: np.ndarray) -> str:
        return self.table.join(ids).decode("utf-8", "replace")


def bpe(path: str) -> Bpe:
    """This worker's encoder for a vocabulary; it outlives the task."""
    return worker_only("bpe", path, lambda: Bpe(path))


def encoded(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids (array<int>) of each row's whole text. A null text is encoded as an empty one: no ids."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc = bpe(vocabulary)
        for some in steps((i, t) for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            ids = [np.frombuffer(x, dtype="<u4").astype(np.int32) for x in enc.batch([t for _, t in some])]
            yield pa.record_batch([pa.array([i for i, _ in some], pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _rows(docs).mapInArrow(run, "doc_id long, ids array<int>")


def decoded(rows: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, text of rows(doc_id, ids): invalid UTF-8 becomes U+FFFD as in the library. Null ids: a null text."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc = bpe(vocabulary)
        for b in batches:
            texts = [None if x is None else enc.decode(np.array(x, dtype=np.int64)) for x in b.column(1).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of the decimal ids joined by commas), decoded_sha256 (of the decoded text).

    One row per row of docs: a null text counts as empty, repeated rows and ids repeat, an empty table gives no row,
    other columns are ignored. Nothing is shuffled."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        enc = bpe(vocabulary)
        for some in steps((i, t) for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            rows = []
            for (doc_id, _), data in zip(some, enc.batch([t for _, t in some])):
                ids = np.frombuffer(data, dtype="<u4")
                text = enc.decode(ids).encode("utf-8")
                rows.append((doc_id, len(ids), hashlib.sha256(enc.decimal.join(ids)[:-1]).hexdigest(), hashlib.sha256(text).hexdigest()))
            yield pa.record_batch([pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.int64(), pa.int64(), pa.string(), pa.string()))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _rows(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _rows(docs: DataFrame) -> DataFrame:
    return small_batches(docs).select(F.col("doc_id").cast("long"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
