import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from millrace.llm import bpe
from millrace.llm.queries import op4_bpe, tokenizer

from .fixtures import TEXTS, documents, odd_ids

PATH = tokenizer("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def lib():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def brute(lib, rows):
    out = []
    for doc_id, text in rows:
        ids = lib.encode(text or "", add_special_tokens=False).ids
        dec = lib.decode(ids, skip_special_tokens=False)
        out.append((doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(dec.encode()).hexdigest()))
    return Counter(out)


@pytest.mark.parametrize("make", [documents, odd_ids, lambda s: documents(s).limit(0)])
def test_small(spark, lib, make):
    docs = make(spark)
    assert Counter(map(tuple, bpe.round_trip(docs, PATH).collect())) == brute(lib, [(r.doc_id, r.text) for r in docs.collect()])


def test_query(spark, sf, lib):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert Counter(map(tuple, op4_bpe(spark, sf).collect())) == brute(lib, rows)


def test_random_texts(lib):
    rnd, enc = random.Random(3), bpe.bpe(PATH)
    letters = "aaabcdeest  \n\t'é😀ßÉ本1234567890.,!?|<>endoftext  ́"
    texts = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(60))) for _ in range(3000)]
    texts += ["".join(chr(c) for c in (rnd.choice([rnd.randrange(32, 0x250), rnd.randrange(0x250, 0xD800), rnd.randrange(0x10000, 0x1F700)]) for _ in range(30)) if chr(c).isprintable() and chr(c).isalpha() is not None) for _ in range(300)]
    texts += ["a" * n for n in range(1, 200, 7)] + [" " * n + "x" for n in range(30)] + ["ab" * 3000]
    for t, got in zip(texts, enc.batch(texts)):
        ids = np.frombuffer(got, dtype="<u4")
        want = lib.encode(t, add_special_tokens=False).ids
        assert ids.tolist() == want, t
        assert enc.decode(ids) == lib.decode(want, skip_special_tokens=False)


def test_decode_any_ids(lib):
    rnd, enc = random.Random(4), bpe.bpe(PATH)
    for _ in range(500):
        ids = [rnd.randrange(50257) for _ in range(rnd.randrange(12))]
        assert enc.decode(np.array(ids, dtype=np.int64)) == lib.decode(ids, skip_special_tokens=False)


def test_columns(spark):
    docs = documents(spark)
    back = bpe.decoded(bpe.encoded(docs, PATH), PATH)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r.doc_id, r.text or "") for r in docs.collect())
    assert len(TEXTS) == docs.count()
