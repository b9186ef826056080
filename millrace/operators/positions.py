"""Places of rows in arrival order, without gathering them in one task.

Rows fall into ranges of the sequence number; each range is numbered by itself, and the numbers of rows in the ranges
before are added. The ranges' bounds are found on that column alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def ranges(df: DataFrame, seq: str, rows: int = 50_000) -> list:
    """Bounds of ranges of about so many rows, at most 4,000 ranges."""
    n = df.count()
    parts = min(4_000, -(-n // rows))
    if parts < 2:
        return []
    share = [i / parts for i in range(1, parts)]
    return sorted(set(df.agg(F.percentile_approx(seq, share, 20 * parts)).first()[0]))


def in_range(seq: str, bounds: list) -> F.Column:
    """The number of bounds at or below seq, by halving."""

    def half(lo: int, hi: int) -> F.Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(F.col(seq) < F.lit(bounds[mid]), half(lo, mid)).otherwise(half(mid + 1, hi))

    return half(0, len(bounds))


def numbered(df: DataFrame, seq: str, group: str | None = None, name: str = "i") -> DataFrame:
    """name: the row's place in arrival order, from 1, in its group (nulls are a group) or in all. seq is unique in a
    group. A group of any size is numbered in pieces."""
    bounds = ranges(df, seq)
    by = [group] if group else []
    order = Window.partitionBy(*by, "__range").orderBy(seq) if bounds or by else Window.partitionBy(F.lit(0)).orderBy(seq)
    df = df.withColumn("__range", in_range(seq, bounds))
    df = df.withColumn(name, F.row_number().over(order).cast("long"))
    if bounds:
        sizes = df.groupBy(*by, "__range").agg(F.count("*").alias("__n"))
        before = Window.partitionBy(*by).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
        starts = sizes.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
        if group:
            starts = starts.withColumnRenamed("__range", "__r2").withColumnRenamed(group, "__g2")
            df = df.join(starts, (F.col("__range") == F.col("__r2")) & F.col(group).eqNullSafe(F.col("__g2"))).drop("__r2", "__g2")
        else:
            df = df.join(F.broadcast(starts), "__range")  # a row per range
        df = df.withColumn(name, F.col(name) + F.col("__start")).drop("__start")
    return df.drop("__range")
