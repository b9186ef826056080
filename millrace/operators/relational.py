"""Projection, sampling, duplicates, grouping, exchange, and the shapes of a pipeline's graph."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import field_hash


def project(df: DataFrame, positions: Sequence[int]) -> DataFrame:
    """Keeps, reorders or repeats fields by position; a repeat is named after its place."""
    names = [df.columns[i] for i in positions]
    return df.select(*[F.col(n).alias(n if n not in names[:k] else f"{n}_{k}") for k, n in enumerate(names)])


def project_by_name(df: DataFrame, *attributes: str) -> DataFrame:
    """Keeps the named attributes in the order of the input."""
    if unknown := set(attributes) - set(df.columns):
        raise ValueError(f"no attribute {sorted(unknown)}")
    return df.select(*[c for c in df.columns if c in attributes])


def sample(df: DataFrame, percent: int, seed: int | None = None) -> DataFrame:
    """Each row with this probability."""
    _percent(percent)
    return df.sample(percent / 100, seed=seed)


def sample_by_key(df: DataFrame, percent: int, *keys: str) -> DataFrame:
    """The rows whose keys' hash falls below the percentage: the same ones on every run and in every partitioning."""
    _percent(percent)
    return df.where(F.pmod(field_hash(*keys), F.lit(100)) < percent)


def _percent(percent: int) -> None:
    if not 0 <= percent <= 100:
        raise ValueError("a percentage is 0 to 100")


def block(df: DataFrame) -> DataFrame:
    """Swallows every row; Spark plans an empty relation."""
    return df.where(F.lit(False))


def add_channel(df: DataFrame, channel: int) -> DataFrame:
    return df.withColumn("channel", F.lit(channel))


def merge_channels(*paths: DataFrame) -> DataFrame:
    """Paths of different schemas through one exchange, tagged by their places; what one lacks is null."""
    out = add_channel(paths[0], 0)
    for i, p in enumerate(paths[1:], 1):
        out = out.unionByName(add_channel(p, i), allowMissingColumns=True)
    return out


def distinct(df: DataFrame) -> DataFrame:
    return df.distinct()


def drop_consecutive(df: DataFrame, order: str, columns: Sequence[str], partition: Sequence[str] = ()) -> DataFrame:
    """Drops each row whose columns equal those of the row before it in its partition (nulls equal each other)."""
    before = F.lag(F.struct(*columns)).over(Window.partitionBy(*partition).orderBy(order))
    return df.withColumn("__before", before).where(~F.struct(*columns).eqNullSafe(F.col("__before"))).drop("__before")


def group_bag(df: DataFrame, *keys: str) -> DataFrame:
    """One row per group: its keys and a bag (array) of the remaining fields. For folds use fold(), which is
    pre-aggregated before the shuffle; a bag holds its whole group in one row."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.collect_list(F.struct(*rest)).alias("bag"))


def fold(df: DataFrame, keys: Sequence[str], **folds: Column) -> DataFrame:
    """Aggregates by name."""
    return df.groupBy(*keys).agg(*[c.alias(n) for n, c in folds.items()])


def average(value: str) -> Column:
    """Of whole numbers, truncated towards zero as the sum divided by the count."""
    return F.expr(f"sum({value}) div count({value})")


def exchange(df: DataFrame, *keys: str, partitions: int | None = None) -> DataFrame:
    """Deals rows to partitions by the hash of the keys (of none: of all fields)."""
    keys = keys or tuple(df.columns)
    return df.repartition(partitions, *keys) if partitions else df.repartition(*keys)


def exchange_by(df: DataFrame, partition: Column, partitions: int) -> DataFrame:
    """Deals rows by a partition number that is computed from each."""
    return df.repartitionById(partitions, partition.cast("int"))


def gather(df: DataFrame, *order: str) -> DataFrame:
    """All rows in one partition, in order if one is given. One task: for results, not for data."""
    out = df.repartition(1) if order else df.coalesce(1)
    return out.sortWithinPartitions(*order) if order else out


def branch(main: DataFrame, other: DataFrame) -> DataFrame:
    """The other source's rows join the rest of the main path: union of all."""
    return main.unionByName(other)


def tee(df: DataFrame, path: Callable[[DataFrame], DataFrame], skipped: Callable[[DataFrame], DataFrame] = lambda d: d) -> DataFrame:
    """Every row goes both ways, through path and through the actions that path skips, and the two meet again."""
    return skipped(df).unionByName(path(df))


def unique_ids(df: DataFrame, name: str = "id") -> DataFrame:
    return df.withColumn(name, F.monotonically_increasing_id())


def counted(df: DataFrame, observation, **counters: Column) -> DataFrame:
    """Named sums that are there once an action has run, at no further pass."""
    return df.observe(observation, *[c.alias(n) for n, c in counters.items()])
