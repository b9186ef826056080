"""The queries of the training-data operators: each applies one to its whole table with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import winnow


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .records import token_records

    return token_records(spark, table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"), end_id=2)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archived

    return archived(spark, table(spark, sf_dir, "pages"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import judged

    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("th")


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import round_trip

    return round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .multiset import with_edits

    return with_edits(table(spark, sf_dir, "documents"))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import packed, pieces

    return packed(pieces(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), end_id=0))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_groups

    out = near_groups(table(spark, sf_dir, "documents"), width=3, k=2)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op8_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embedding import near_vectors

    return near_vectors(table(spark, sf_dir, "embeddings"), least=0.93)


def op9_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .winnow import without_repeats

    return without_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_deleted", F.md5("text").alias("text_md5"))


def op10_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import languages

    return languages(table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_token_records, op2_warc, op3_quality, op4_bpe, op5_fingerprints, op6_packing, op7_simhash, op8_embedding, op9_lines, op10_langid, pipeline)}
ORACLES: dict[str, str] = {
    "op2_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS last, array_to_string(list_transform(string_split(sha1(html), ''), lambda c: lpad(bin(('0x' || c)::INT), 4, '0')), '') AS bits FROM p)
SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes,
    array_to_string(list_transform(range(0, 160, 5), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + list_sum(list_transform(range(0, 5), lambda j: CAST(substr(bits, CAST(i + j + 1 AS INT), 1) AS INT) * CAST(2 ** (4 - j) AS INT))) AS INT), 1)), '') AS payload_digest,
    CASE WHEN last = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN last <> page_id THEN last END AS refers_to FROM q""",
    "op8_embedding": """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sound AS (SELECT * FROM v WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM sound AS a JOIN sound AS b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
reach AS (SELECT vec_id, vec_id AS c FROM v UNION SELECT link.b, reach.c FROM reach JOIN link ON link.a = reach.vec_id AND reach.c < link.b),
least AS (SELECT vec_id, min(c) AS component_id FROM reach GROUP BY 1)
SELECT vec_id, (SELECT count(*) FROM link WHERE a = least.vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM least""",
    "op9_lines": winnow.ORACLE,
}
