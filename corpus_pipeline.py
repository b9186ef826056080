"""The corpus pipeline: language ID, quality, line dedup, near-dedup and packing over whole documents.

Each stage is (spark, docs, sf_dir) -> DataFrame. All but the last return the columns of documents; the last returns
the packed pieces. Every stage covers all that the one before kept."""

from __future__ import annotations

import public_tokenizers
from millrace.llm import langid, packing, quality, similar, winnow
from millrace.llm.common import work_dir
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def _with(docs: DataFrame, decided: DataFrame) -> DataFrame:
    """docs whose (doc_id, th) is in decided, which has each once."""
    rows = docs.withColumn("__doc", F.struct(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")))
    ids = decided.select(F.struct("doc_id", "th").alias("__id"))
    return rows.join(ids, rows["__doc"].eqNullSafe(ids["__id"]), "left_semi").drop("__doc")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and ambiguous ones; fills in the language where it is null."""
    found = langid.identified(docs, langid.fit(docs))
    return found.where("NOT ambiguous").withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts that trusted text of their language makes improbable."""
    rows = quality.judged(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _with(docs, rows.where("kept")).select(*COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later repeats of passages; n_chars follows the text."""
    rows = winnow.without_repeats(docs)
    return rows.withColumn("n_chars", F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays."""
    return _with(docs, similar.similar(docs).where("kept")).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.packed(packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0))


STAGES = [("language", language), ("quality", good), ("lines", lines), ("near duplicates", near_duplicates), ("packing", pack)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, path = spark.read.parquet(f"{sf_dir}/documents.parquet"), work_dir(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{path}/{k}")
        docs = spark.read.parquet(f"{path}/{k}")
    return docs
