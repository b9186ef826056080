"""Embedding near-dedup: int8 tile products with rigorous error bounds, full precision only where they leave doubt.

A unit vector x is held as s*q with integers q of at most 127 and s = max|x|/127, and with e >= |x - s*q|. For two
such, |x.y - s_x*s_y*(q_x.q_y)| <= e_y + e_x*(1 + e_y): the integer product decides every pair beyond that bound and
the double-precision cosine of the original vectors is taken of the others. Equal vectors of a label are one class
with a count, classes are dealt to tiles of about TILE by hash, and each pair of tiles is one group of at most about
twice TILE rows: no label, however common, meets in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import looked_up, written
from .components import connected

TILE = 1024
SLACK = 1e-9  # over the rounding of doubles in sums of a few thousand terms


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows, int8 rows, scales, error bounds of rows of doubles without zero rows."""
    big = np.abs(x).max(axis=1, keepdims=True)
    u = x / big  # first, so that no square overflows or vanishes
    u = u / np.sqrt((u * u).sum(axis=1, keepdims=True))
    s = np.abs(u).max(axis=1) / 127
    q = np.rint(u / s[:, None]).astype(np.int8)
    return u, q, s, np.sqrt(((u - s[:, None] * q) ** 2).sum(axis=1)) + SLACK


def tile_links(x: np.ndarray, y: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Indices (i in x, j in y) of pairs with cosine >= least; without y the pairs i < j in x."""
    ux, qx, sx, ex = quantised(x)
    uy, qy, sy, ey = (ux, qx, sx, ex) if y is None else quantised(y)
    kind = np.float32 if x.shape[1] <= 1000 else np.float64  # sums of products of int8 are exact in either
    near = qx.astype(kind) @ qy.astype(kind).T * sx[:, None] * sy
    doubt = near + ey + ex[:, None] * (1 + ey) + 1e-5 >= least  # 1e-5: rounding of the scaled product in float32
    if y is None:
        doubt = np.triu(doubt, 1)
    i, j = np.nonzero(doubt)
    keep = [np.empty(0, dtype=bool)]
    yy = x if y is None else y
    for lo in range(0, len(i), 100_000):
        a, b = x[i[lo : lo + 100_000]], yy[j[lo : lo + 100_000]]
        a, b = a / np.abs(a).max(axis=1, keepdims=True), b / np.abs(b).max(axis=1, keepdims=True)
        keep.append((a * b).sum(axis=1) / (np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))) >= least)
    sure = np.concatenate(keep)
    return i[sure], j[sure]


def _stars(i: list[int], j: list[int]) -> list[tuple[int, int]]:
    """At most one link per node that connect what the pairs connect."""
    up: dict[int, int] = {}

    def root(v: int) -> int:
        while (w := up.setdefault(v, v)) != v:
            up[v] = v = up[w]
        return v

    for a, b in zip(i, j):
        if (r := root(a)) != (s := root(b)):
            up[max(r, s)] = min(r, s)
    return [(v, root(v)) for v in list(up) if root(v) != v]


def near_vectors(vectors: DataFrame, least: float = 0.93) -> DataFrame:
    """vectors: vec_id, embedding (array of float or double), label. Returns vec_id, n_links, component_id, kept.

    Only vectors of equal, non-null label and equal length are compared. A vector that is null, empty, zero, or holds
    null or non-finite components has no link, is its own component and kept. Equal vectors link with each other.
    Rows with equal vec_id are vectors of their own that share the id; a null vec_id counts as a vector, but its
    component takes the least non-null id. An empty table gives no row; other columns are ignored."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label"), F.col("embedding").cast("array<double>").alias("e"))
    sound = F.col("label").isNotNull() & F.coalesce(F.size("e") > 0, F.lit(False)) & F.coalesce(F.forall("e", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))), F.lit(False)) & F.coalesce(F.exists("e", lambda v: v != 0), F.lit(False))
    rows = written(rows.withColumn("class", F.when(sound, F.struct("label", "e"))).select("vec_id", F.when(sound, F.sha2(F.concat_ws(",", F.size("e"), F.col("label"), F.col("e").cast("string")), 256)).alias("class"), "label", F.when(sound, F.col("e")).alias("e")), "vectors")
    classes = written(rows.where("class is not null").groupBy("class").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n"), F.first("label").alias("label"), F.first("e").alias("e")).withColumn("node", F.xxhash64("class")), "classes")
    sizes = classes.groupBy("label", F.size("e").alias("width")).agg(F.ceil(F.count("*") / TILE).cast("int").alias("tiles"))
    dealt = classes.withColumn("width", F.size("e")).join(F.broadcast(sizes) if sizes.count() <= 10_000 else sizes, ["label", "width"])
    tile = F.pmod(F.xxhash64("class", F.lit(1)), F.col("tiles")).cast("int")
    both = dealt.withColumn("tile", tile).withColumn("other", F.explode(F.expr("sequence(0, tiles - 1)")))
    pairs = both.select("label", "width", F.least("tile", "other").alias("lo"), F.greatest("tile", "other").alias("hi"), "tile", "node", "n", "e")

    def compare(t):
        import pyarrow as pa

        lo, hi = t.column("lo")[0].as_py(), t.column("hi")[0].as_py()
        width = t.column("width")[0].as_py()
        tiles, node, n = (t.column(c).to_numpy() for c in ("tile", "node", "n"))
        x = t.column("e").combine_chunks().flatten().to_numpy().reshape(-1, width)
        a, b = (np.nonzero(tiles == k)[0] for k in (lo, hi))
        i, j = tile_links(x[a], None if lo == hi else x[b], least) if len(a) and len(b) else (a[:0], b[:0])
        i, j = a[i], b[j]
        gained = np.bincount(i, n[j], len(x)) + np.bincount(j, n[i], len(x))
        some = np.nonzero(gained)[0]
        star = _stars(node[i].tolist(), node[j].tolist())
        return pa.table({
            "node": pa.array([*node[some].tolist(), *(s for s, _ in star)], pa.int64()),
            "other": pa.array([None] * len(some) + [s for _, s in star], pa.int64()),
            "n_links": pa.array([*gained[some].astype(np.int64).tolist(), *[0] * len(star)], pa.int64()),
        })

    found = written(pairs.groupBy("label", "width", "lo", "hi").applyInArrow(compare, "node long, other long, n_links long"), "links")
    counts = found.groupBy("node").agg(F.sum("n_links").alias("more"))
    nodes = connected(found.where("other is not null").select("node", "other"))
    joined = classes.drop("e", "label").join(counts, "node", "left").join(nodes, "node", "left").withColumn("root", F.coalesce("component", "node"))
    roots = joined.groupBy("root").agg(F.min("rep").alias("component_id"))
    table = joined.join(roots, "root").select("class", "n", (F.coalesce("more", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    out = looked_up(rows.where("class is not null").select("vec_id", "class"), written(table, "classes"), "class", "n")
    alone = rows.where("class is null").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = out.select("vec_id", F.col("n_links").cast("long").alias("n_links"), "component_id").unionByName(alone)
    return out.withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
