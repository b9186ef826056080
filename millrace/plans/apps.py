"""The bundled programs, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import parse_vector, round2, tokens, words
from ..operators.joins import nearest
from ..operators.rolling import rolling_counts, trending
from ..sinks.files import write_lines
from ..sources.files import read_lines


def word_count(lines: DataFrame, line: str = "line") -> DataFrame:
    """word, n."""
    return lines.select(F.explode(words(line)).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def word_count_files(spark: SparkSession, source: str, target: str) -> DataFrame:
    return write_lines(word_count(read_lines(spark, source)), target)


def sorted_distinct(lines: DataFrame) -> DataFrame:
    """Different lines, in order: dealt by range, so that all sort in parallel."""
    return lines.distinct().orderBy(*lines.columns)


def sort_files(spark: SparkSession, source: str, target: str | None) -> DataFrame:
    out = sorted_distinct(read_lines(spark, source))
    return write_lines(out, target) if target else out


def k_means(points: DataFrame, centres: list[list[float]], threshold: float, max_rounds: int | None = None, vector: str = "vector") -> tuple[DataFrame, list[list[float]], int]:
    """points with the index of their centre and that centre; the centres (their number is the caller's, so they stay
    with the driver); the number of rounds. A new centre is the mean of its points, to two decimals; the least index
    wins ties; a centre without points goes. Ends when the centres moved by at most threshold in all, or after max_rounds where
    that is given."""
    spark = points.sparkSession
    dims, rounds = len(centres[0]), 0
    while True:
        rounds += 1
        table = spark.createDataFrame([(i, c) for i, c in enumerate(centres)], "index int, centre array<double>")
        assigned = nearest(points, table, vector)
        sums = assigned.groupBy("index").agg(F.count("*").alias("n"), *[F.sum(F.col(vector)[d]).alias(f"s{d}") for d in range(dims)])
        means = sums.select("index", *[round2(round2(f"s{d}") / F.col("n")).alias(f"m{d}") for d in range(dims)]).collect()  # a row per centre
        new = {r["index"]: [float(r[f"m{d}"]) for d in range(dims)] for r in means}
        moved = sum(int(100 * sum((a - b) ** 2 for a, b in zip(new[i], centres[i])) ** 0.5 + 0.5) // 100 for i in new)
        if moved <= threshold or rounds == max_rounds:
            final = spark.createDataFrame([(i, new[i]) for i in sorted(new)], "index int, centre array<double>")
            return assigned.join(F.broadcast(final), "index"), [new[i] for i in sorted(new)], rounds
        centres = [new[i] for i in sorted(new)]


def vectors(lines: DataFrame, line: str = "line") -> DataFrame:
    return lines.select(parse_vector(line).alias("vector"))


def streaming_word_count(phrases: DataFrame) -> DataFrame:
    """word, n of a stream of phrases; in update mode each trigger gives the counts that changed."""
    return phrases.select(F.explode(tokens("phrase")).alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def trending_topics(words_: DataFrame, k: int = 10, ts: str = "timestamp") -> DataFrame:
    """On a batch ranked at once; on a stream counts, ranked per window in foreachBatch by rankings()."""
    if words_.isStreaming:
        return rolling_counts(words_, "word", ts, delay="0 seconds")
    return trending(words_, "word", ts, k)
