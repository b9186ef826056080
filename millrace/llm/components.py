"""Connected components of a graph given as links, by alternating large-star and small-star rounds."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written


def _forest(batches: Iterator) -> Iterator:
    """A spanning star of each tree that the links of one task form; its links number at most its nodes."""
    import pyarrow as pa

    up: dict[int, int] = {}

    def root(x: int) -> int:
        while (y := up.setdefault(x, x)) != x:
            up[x] = x = up[y]
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if (r := root(u)) != (s := root(v)):
                up[max(r, s)] = min(r, s)
        if len(up) > 500_000:
            yield _stars(up, root, pa)
            up.clear()
    yield _stars(up, root, pa)


def _stars(up, root, pa):
    pairs = [(x, r) for x in list(up) if (r := root(x)) != x]
    return pa.record_batch({"u": pa.array([x for x, _ in pairs], pa.int64()), "v": pa.array([r for _, r in pairs], pa.int64())})


def connected(links: DataFrame) -> DataFrame:
    """links: two long columns, either way round. Returns node, component (the smallest node reachable) of every
    node that has a link to another node.

    Each round shuffles the links by node twice and is written to the shared folder; their number never grows, and
    the rounds are logarithmic in practice. No node's links are gathered in one task: minima are pre-aggregated, and
    the joins back are ordinary ones, whose hot side Spark splits."""
    u, v = links.columns
    links = links.select(F.col(u).cast("long").alias("u"), F.col(v).cast("long").alias("v")).where("u <> v")
    edges = written(links.mapInArrow(_forest, "u long, v long").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "links")
    seen = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = written(small, "links")
        drop_written(edges)
        edges, mark = new, new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if mark == seen or not mark[0]:
            break
        seen = mark
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
