import struct
import zlib

import pytest
from millrace.llm import records
from millrace.llm.common import work_dir
from millrace.llm.queries import op1_token_records, tokenizer

from .fixtures import documents, odd_ids

PATH = tokenizer("word_bpe_49k.json")


def brute(rows):
    from tokenizers import Tokenizer

    tok, start, out = Tokenizer.from_file(PATH), 0, []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*tok.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((doc_id, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    return out


def sort(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: r[1])


@pytest.mark.parametrize("make", [documents, odd_ids])
def test_small(spark, make):
    docs = make(spark)
    assert sort(records.token_records(spark, docs, PATH).collect()) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_query(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    assert sort(op1_token_records(spark, sf).collect()) == brute(rows)


def test_empty(spark):
    assert records.token_records(spark, documents(spark).limit(0), PATH).collect() == []


def test_index_and_damage(spark):
    docs, path = documents(spark), work_dir(spark, "records")
    shards = records.write_records(docs, path, PATH, 2).collect()
    by_id = {r.doc_id: bytes(r.ids) for r in records.read_records(spark, path).collect()}
    found = dict(records.random_record(spark, row, k) for row in shards for k in reversed(range(row.n_docs)))
    assert found == by_id
    data = records.frame(b"payload")
    import io

    assert list(records.unframe(io.BytesIO(data * 2))) == [b"payload"] * 2
    for i in range(len(data)):
        with pytest.raises((ValueError, struct.error, MemoryError, OverflowError)):
            list(records.unframe(io.BytesIO(data[:i] + bytes([data[i] ^ 1]) + data[i + 1 :])))
