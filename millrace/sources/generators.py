"""Generated rows, the same for the same seed whatever the partitioning, as batches or as streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import source

LETTERS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _uniform(seed: int, salt: int, low: int, high: int, row: str = "id") -> Column:
    return (F.pmod(F.xxhash64(F.lit(seed), F.lit(salt), F.col(row)), F.lit(high - low)) + low).cast("int")


@source("events")
def random_events(spark: SparkSession, n: int, attributes: tuple[str, ...] = ("A", "B", "C"), low: int = 0, high: int = 100, seed: int = 0, partitions: int | None = None) -> DataFrame:
    """seq and whole numbers, uniform in [low, high)."""
    rows = spark.range(0, n, 1, partitions) if partitions else spark.range(n)
    return rows.select(F.col("id").alias("seq"), *[_uniform(seed, k, low, high).alias(a) for k, a in enumerate(attributes)])


@source("constant")
def constant(spark: SparkSession, value: int, n: int = 100_000) -> DataFrame:
    return spark.range(n).select(F.lit(value).alias("v"))


def vocabulary(n: int, seed: int = 0, length: int = 25) -> Column:
    """n words of letters and digits; the k-th is always the same."""
    word = lambda k: F.array_join(F.transform(F.sequence(F.lit(1), F.lit(length)), lambda j: F.substring(F.lit(LETTERS), (F.pmod(F.xxhash64(F.lit(seed), k, j), F.lit(36)) + 1).cast("int"), F.lit(1))), "")
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), word)


def _rows(spark: SparkSession, n: int, rate: int) -> DataFrame:
    """n numbered rows; of -1: a stream without end."""
    if n >= 0:
        return spark.range(n)
    return spark.readStream.format("rate").option("rowsPerSecond", rate).load().select(F.col("value").alias("id"), "timestamp")


@source("words")
def random_words(spark: SparkSession, n: int, distinct: int = 1_000, seed: int = 1, rate: int = 1_000) -> DataFrame:
    rows = _rows(spark, n, rate)
    more = [c for c in rows.columns if c != "id"]
    return rows.select(F.col("id").alias("seq"), F.element_at(vocabulary(distinct, seed), _uniform(seed, 7, 1, distinct + 1)).alias("word"), *more)


@source("phrases")
def random_phrases(spark: SparkSession, n: int, phrases: int = 100, words: int = 10, distinct: int = 100, seed: int = 0, rate: int = 1_000) -> DataFrame:
    """Phrases out of a fixed number of different ones, each of so many words."""
    rows = _rows(spark, n, rate).withColumn("p", _uniform(seed, 11, 0, phrases))
    more = [c for c in rows.columns if c not in ("id", "p")]
    pick = F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda j: F.element_at(vocabulary(distinct, seed), (F.pmod(F.xxhash64(F.lit(seed), F.col("p"), j), F.lit(distinct)) + 1).cast("int")))
    return rows.select(F.col("id").alias("seq"), F.array_join(pick, " ").alias("phrase"), *more)


@source("vectors")
def random_vectors(spark: SparkSession, n: int, dims: int, seed: int = 0) -> DataFrame:
    """Lines of dims numbers in [0, 100) with two decimals."""
    one = F.transform(F.sequence(F.lit(0), F.lit(dims - 1)), lambda j: (F.pmod(F.xxhash64(F.lit(seed), F.col("id"), j), F.lit(10_000)) / 100).cast("string"))
    return spark.range(n).select(F.array_join(one, " ").alias("line"))


@source("network")
def network(spark: SparkSession, host: str = "localhost", port: int = 9000, schema: str = "A int, B int, C int") -> DataFrame:
    """A stream of named tuples, one JSON object a line, from a server that Spark connects to."""
    lines = spark.readStream.format("socket").option("host", host).option("port", port).load()
    return lines.select(F.from_json("value", schema).alias("t")).select("t.*")
