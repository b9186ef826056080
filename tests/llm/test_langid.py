import zlib

import numpy as np
from millrace.llm import langid
from millrace.llm.queries import op10_langid
from pyspark.sql import functions as F

from .fixtures import documents


def test_query_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = op10_langid(spark, sf).collect()
    assert {r.doc_id for r in rows} == set(lang) and len(rows) == len(lang)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in out) >= 0.97 * len(out)


def test_fit_ignores_held_out_rows_and_predict_uses_text_alone(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    one = langid.fit(docs)
    two = langid.fit(docs.withColumn("lang", F.when(langid.held_out("doc_id"), F.lit("xx")).otherwise(F.col("lang"))))
    assert one.langs == two.langs and np.array_equal(one.weights, two.weights) and np.array_equal(one.trust, two.trust)
    plain = {r.doc_id: (r.lang_pred, r.score) for r in langid.predicted(docs, one).collect()}
    assert plain == {r.doc_id: one.predict(r.text) for r in docs.collect()}


def test_edge_cases(spark):
    docs = documents(spark)
    rows = {r.doc_id: r for r in langid.languages(docs).collect()}
    for r in docs.collect():
        assert (rows[r.doc_id].lang_pred == "und") == (not langid.has_letter(r.text))
        assert r.text is not None or rows[r.doc_id].ambiguous
    assert langid.languages(docs.limit(0)).collect() == []
    none = langid.languages(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(none) == docs.count() and {r.lang_pred for r in none} == {"und"}
    sole = langid.languages(docs.withColumn("lang", F.lit("zz"))).collect()
    assert {r.lang_pred for r in sole} == {"zz", "und"}


def test_codes():
    for k in (2, 3, 4, 5, 6, 7, 12, 40):
        code = langid.codewords(k).astype(int)
        apart = ((code[:, None] != code[None]).sum(axis=2) + 99 * np.eye(k, dtype=int)).min()
        assert apart >= (code.shape[1] + 1) // 2 if k <= 6 else apart >= 0.25 * code.shape[1]
        assert (np.abs(code.sum(axis=0)) < k).all()
