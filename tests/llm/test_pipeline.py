import corpus_pipeline as cp
from millrace.llm import langid, quality
from pyspark.sql import functions as F

from . import test_packing, test_similar, test_winnow
from .fixtures import documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_one_by_one(spark, sf, tmp_path):
    """Each stage's decisions, by hand, on what the one before kept."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for k, (name, stage) in enumerate(cp.STAGES):
        before = docs.collect()
        out = stage(spark, docs, sf)
        out.write.parquet(f"{tmp_path}/{k}")
        after = spark.read.parquet(f"{tmp_path}/{k}")
        rows = after.collect()
        if name != "packing":
            assert after.columns == COLUMNS
        if name == "language":
            model = langid.fit(docs)
            kept = {r.doc_id for r in before if (p := model.predict(r.text))[0] != "und" and p[1] >= langid.AMBIGUOUS}
            assert {r.doc_id for r in rows} == kept and len(kept) > 0.97 * len(before)
        if name == "quality":
            judged = {r.doc_id: r.kept for r in quality.judged(docs, spark.read.parquet(f"{sf}/labels.parquet")).collect()}
            assert {r.doc_id for r in rows} == {i for i, k in judged.items() if k}
        if name == "lines":
            want = test_winnow.brute(sorted((r.doc_id, r.text) for r in before))
            assert {r.doc_id: r.text for r in rows} == want and all(r.n_chars == len(r.text) for r in rows if r.text != dict((b.doc_id, b.text) for b in before)[r.doc_id])
        if name == "near duplicates":
            groups = test_similar.brute([(r.doc_id, r.text) for r in before])
            assert {r.doc_id for r in rows} == {least for _, (_, least) in groups}
            source = {r.doc_id: r for r in before}
            assert all(r == source[r.doc_id] for r in rows)
        if name == "packing":
            test_packing.check([(r.doc_id, r.text) for r in before], rows)
        docs = after


def test_run_is_the_stages_in_turn(spark, sf):
    assert [n for n, _ in cp.STAGES] == ["language", "quality", "lines", "near duplicates", "packing"] and cp.ORACLE_SQL is None
    rows = cp.run(spark, sf).collect()
    assert rows and sum(r.offset == 0 for r in rows) == len({r.sequence_id for r in rows})


def test_odd_and_empty_tables(spark, sf):
    docs = documents(spark).select(*COLUMNS, F.lit(1).alias("score"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for table in (docs, docs.limit(0)):
        for name, stage in cp.STAGES:
            if name == "quality":
                continue  # it takes its labels from sf_dir: see test_quality
            out = stage(spark, table, sf)
            assert (out.count() > 0) == (table.count() > 0)
    assert labels.count() == 0
