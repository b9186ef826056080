"""Whole-text encoding with the tokenizers library, a chunk at a time.

Both vocabularies never merge across white space, so a text's ids are those of its chunks in turn. Chunks repeat and
the library is slow, so each worker keeps the ids of chunks that it has met, in arrays; a batch of texts is split and
looked up by Arrow's kernels, and only chunks that are new go through Python. A text with anything that could make a
chunk depend on its neighbours (adjacent or unusual white space, the marks of special tokens) is encoded whole."""

from __future__ import annotations

import os
import sys
from array import array

import numpy as np

from .common import worker_only

#: Chunks that a worker keeps (about 30 bytes each); beyond, it drops those least met since it last did.
KEPT = 250_000
#: Letter stems of a generation that a worker keeps (about 200 bytes each). The generation before is kept too, and what
#: is met again of it moves on, so that frequent ones are never forgotten.
KEPT_STEMS = 120_000
#: White space other than blanks and line ends; adjacent white space; what begins the marks of special tokens.
UNUSUAL = r"\t\x0b\f\r\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
ODD = rf"[ \n][ \n]|[{UNUSUAL}]|<\|"
MARKS = ".,!?;:"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


def le(ids: list[int]) -> bytes:
    """ids as little-endian unsigned 32-bit integers."""
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


def _plain(stem: str) -> bool:
    """Letters below U+0250 only, which every Unicode version classes, composes and lower-cases alike."""
    return stem.isalpha() and (stem.isascii() or max(stem) < "ɐ")


class _Stems:
    """The ids of chunks that follow the same text (a space or nothing)."""

    def __init__(self, owner: Encoder, before: str):
        self.owner, self.before = owner, before
        self.alone = owner.whole([before])[0] if before else b""
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def many(self, words: list[str]) -> list[bytes]:
        """Letters and closing marks are put together of the two, which the vocabularies split apart too. Letters, with
        the space before them, are one piece, which goes to the library's model as it is."""
        if len(self.new) > KEPT_STEMS:
            self.old, self.new = self.new, {}
        new, old, owner, before, lower = self.new, self.old, self.owner, self.before, not self.owner.spaced
        out, ends, stem_of, odd = [], owner.ends, owner.stem, []
        for w in words:
            stem = w.rstrip(MARKS)
            low = stem.lower() if lower else stem
            if not low.isalpha() or not (w.isascii() or _plain(stem) and _plain(low)):
                if w:
                    odd.append(len(out))
                out.append(self.alone)
                continue
            ids = new.get(low)
            if ids is None:
                ids = new[low] = old.get(low) or stem_of(before + low)
            out.append(ids + ends[w[len(stem) :]] if len(stem) < len(w) else ids)
        for i, ids in zip(odd, owner.whole([before + words[i] for i in odd])):
            out[i] = ids
        return out


class _Marks(dict):
    """Runs of closing marks and their ids."""

    def __init__(self, owner: Encoder):
        super().__init__()
        self.owner = owner

    def __missing__(self, marks: str) -> bytes:
        ids = self[marks] = self.owner.whole([marks])[0]
        return ids


class Encoder:
    """batch(texts): the ids of each, as bytes, four a token."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.lib.no_padding()
        self.lib.no_truncation()
        self.model = self.lib.model
        letter_of = {b: c for c, b in byte_letters().items()}
        self.letters = [letter_of[b] for b in range(256)]
        self.start(self.lib.normalizer is None)

    def start(self, spaced: bool) -> None:
        """spaced: a word's ids hold the space before it, and case counts; else white space is dropped."""
        self.spaced = spaced
        self.first, self.rest = _Stems(self, ""), _Stems(self, " ")
        self.ends = _Marks(self)
        self.newline = self.whole(["\n"])[0]
        self._empty()

    def whole(self, texts: list[str]) -> list[bytes]:
        return [le(e.ids) for e in self.lib.encode_batch_fast(texts, add_special_tokens=False)]

    def stem(self, stem: str) -> bytes:
        if stem.isascii():
            stem = stem.replace(" ", self.letters[32])
        else:
            stem = "".join([self.letters[b] for b in stem.encode()])
        return le([t.id for t in self.model.tokenize(stem)])

    def batch(self, texts: list[str]) -> list[bytes]:
        import pyarrow as pa
        import pyarrow.compute as pc

        rows = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(rows, ODD).to_numpy(zero_copy_only=False).nonzero()[0].tolist()
        if not odd:
            return self._plain_texts(rows)
        apart = set(odd)
        rest = [i for i in range(len(texts)) if i not in apart]
        out = dict(zip(rest, self._plain_texts(rows.take(pa.array(rest, pa.int64())))))
        for i in odd:
            out[i] = self.whole([texts[i]])[0]
        return [out[i] for i in range(len(texts))]

    def _plain_texts(self, rows) -> list[bytes]:
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.ends) > 10_000:
            self.ends = _Marks(self)
        if self.spaced:
            # a chunk that begins a line has the line's end before it, also that of the first line, which isn't kept
            rows = pc.binary_join_element_wise(pa.scalar("\n", pa.large_string()), pc.replace_substring(rows, "\n", " \n"), pa.scalar("", pa.large_string()))
            words = pc.split_pattern(rows, " ")
        else:
            words = pc.ascii_split_whitespace(rows)
        chunks = words.flatten().dictionary_encode()
        place = self._places(chunks.dictionary)
        at = place[chunks.indices.to_numpy()]
        self.met += np.bincount(at, minlength=len(self.met))
        counts = self.sizes[at]
        ends = np.concatenate([[0], np.cumsum(counts)])
        out = self.flat[np.repeat(self.starts[at] - ends[:-1], counts) + np.arange(ends[-1])].tobytes()
        cuts = ends[words.offsets.to_numpy()].tolist()
        skip = len(self.newline) if self.spaced else 0
        return [out[4 * lo + skip : 4 * hi] for lo, hi in zip(cuts, cuts[1:])]

    def _places(self, chunks) -> np.ndarray:
        """Where each of some different chunks is among those that are kept, which it is from now on."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if len(self.known) > KEPT:
            self._forget()
        found = pc.index_in(chunks, self.known)
        place = found.fill_null(-1).to_numpy().astype(np.int64)
        missing = np.nonzero(place < 0)[0]
        if len(missing):
            more = chunks.take(pa.array(missing))
            ids = [x for lo in range(0, len(more), 20_000) for x in self._learnt(more.slice(lo, 20_000).to_pylist())]
            place[missing] = np.arange(len(self.known), len(self.known) + len(missing))
            sizes = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids)) // 4
            self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(sizes) - sizes])
            self.sizes = np.concatenate([self.sizes, sizes])
            self.flat = np.concatenate([self.flat, np.frombuffer(b"".join(ids), dtype="<u4")])
            self.met = np.concatenate([self.met, np.zeros(len(ids), dtype=np.int64)])
            self.known = pa.concat_arrays([self.known, more])
        return place

    def _empty(self) -> None:
        import pyarrow as pa

        self.known = pa.array([], pa.large_string())
        self.starts = self.sizes = self.met = np.empty(0, dtype=np.int64)
        self.flat = np.empty(0, dtype="<u4")

    def _forget(self) -> None:
        """Keeps the half that was met most."""
        import pyarrow as pa

        best = np.sort(np.argsort(-self.met, kind="stable")[: KEPT // 2])
        known, starts, sizes, flat = self.known.take(pa.array(best)), self.starts[best], self.sizes[best], self.flat
        ends = np.cumsum(sizes)
        self.known, self.sizes, self.starts, self.met = known, sizes, ends - sizes, np.zeros(len(best), dtype=np.int64)
        self.flat = flat[np.repeat(starts - self.starts, sizes) + np.arange(ends[-1])]

    def _learnt(self, chunks: list[str]) -> list[bytes]:
        if not self.spaced:
            return self.first.many(chunks)
        opens = [c[:1] == "\n" for c in chunks]
        begun = iter(self.first.many([c[1:] for c, o in zip(chunks, opens) if o]))
        going = iter(self.rest.many([c for c, o in zip(chunks, opens) if not o]))
        return [self.newline + next(begun) if o else next(going) for o in opens]


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file; it outlives the task."""
    return worker_only("encoder", path, lambda: Encoder(path))
