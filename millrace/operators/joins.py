"""Stream joins over windows of rows or of values, in closed form; co-group and lookup joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import distance
from .positions import in_range, ranges


def joined_columns(low: DataFrame, high: DataFrame, seq: str) -> list[tuple[str, str]]:
    """(side, name) of the output: high's attributes in order, then those of low alone; a shared name has low's value."""
    rest = lambda d: [c for c in d.columns if c != seq]
    return [("l" if c in rest(low) else "h", c) for c in rest(high)] + [("l", c) for c in rest(low) if c not in rest(high)]


def _arrivals(low: DataFrame, high: DataFrame, on: str, seq: str) -> DataFrame:
    """Both sides in one order: seq, on, side, and the numbers of rows of either side up to and with each row."""
    both = low.select(F.col(seq).alias("seq"), F.col(on).alias("key"), F.lit(0).alias("side")).unionByName(high.select(F.col(seq).alias("seq"), F.col(on).alias("key"), F.lit(1).alias("side")))
    bounds = ranges(both, "seq")
    both = both.withColumn("part", in_range("seq", bounds))
    order = Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # over a row per range
    sizes = both.groupBy("part").agg(F.sum((F.col("side") == 0).cast("long")).alias("a"), F.sum("side").alias("b"))
    starts = sizes.select("part", F.coalesce(F.sum("a").over(before), F.lit(0)).alias("a"), F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b"))
    both = both.withColumn("n0", F.sum((F.col("side") == 0).cast("long")).over(order)).withColumn("n1", F.sum("side").over(order))
    return both.join(F.broadcast(starts), "part").select("seq", "key", "side", (F.col("n0") + F.col("a")).alias("n0"), (F.col("n1") + F.col("b")).alias("n1"))


def _pairs(held: DataFrame, probe: DataFrame, mine: str, size: int) -> DataFrame:
    """Rows of held that are among its side's last size rows when a row of probe with the same key arrives. Places are
    cut into blocks of size, of which a window touches two, so that a frequent key is only met near in time."""
    h = held.select("key", F.col("seq").alias("seq_h"), F.col(mine).alias("place"), F.expr(f"({mine} - 1) div {size}").alias("block"))
    p = probe.select("key", F.col("seq").alias("seq_p"), F.col(mine).alias("so_far"), F.explode(F.expr(f"array_distinct(array((greatest({mine} - {size}, 0)) div {size}, ({mine} - 1) div {size}))")).alias("block"))
    return h.join(p, ["key", "block"]).where((F.col("place") <= F.col("so_far")) & (F.col("place") > F.col("so_far") - size)).select("seq_h", "seq_p")


def _with_rows(pairs: DataFrame, low: DataFrame, high: DataFrame, seq: str) -> DataFrame:
    """The rows that pairs(seq_l, seq_h) name, with both sequence numbers."""
    l = low.select(F.struct(*low.columns).alias("l"), F.col(seq).alias("seq_l"))
    h = high.select(F.struct(*high.columns).alias("h"), F.col(seq).alias("seq_h"))
    return pairs.join(l, "seq_l").join(h, "seq_h").select("seq_l", "seq_h", *[F.col(f"{side}.{c}").alias(c) for side, c in joined_columns(low, high, seq)])


def window_join(low: DataFrame, high: DataFrame, on: str, size: int, seq: str = "seq") -> DataFrame:
    """Each side holds its last size rows; an arrival meets those of the other side that have its key. seq is unique
    over both. A null key meets nothing."""
    rows = _arrivals(low, high, on, seq)
    a, b = rows.where("side = 0"), rows.where("side = 1")
    first_low = _pairs(a, b, "n0", size).select(F.col("seq_h").alias("seq_l"), F.col("seq_p").alias("seq_h"))
    first_high = _pairs(b, a, "n1", size).select(F.col("seq_p").alias("seq_l"), F.col("seq_h").alias("seq_h"))
    return _with_rows(first_low.unionByName(first_high), low, high, seq)


def _first_at_least(values: list, limits: list) -> list:
    """For each place the first later place whose value is at least the limit of the first, or None."""
    from bisect import bisect_right

    ahead, places, out = [], [], [None] * len(values)  # the places that top all between them, the nearest last; values negated
    for i in range(len(values) - 1, -1, -1):
        if at := bisect_right(ahead, -limits[i]):
            out[i] = places[at - 1]
        if values[i] is not None:
            while ahead and -ahead[-1] <= values[i]:
                ahead.pop(), places.pop()
            ahead.append(-values[i]), places.append(i)
    return out


def _first_of(tops: list, limit, none):
    """What belongs to the first of (top, what) in rising order whose top is enough."""
    from bisect import bisect_left

    at = bisect_left(tops, limit, key=lambda t: t[0])
    return tops[at][1] if at < len(tops) else none


def band_join(low: DataFrame, high: DataFrame, on: str, size: int, seq: str = "seq") -> DataFrame:
    """An arrival of value v drops from the other side what has at most v - size, then meets what has v. on holds
    numbers; a null meets nothing, NaN is as great as infinity. seq is unique over both.

    A row is there until the first later arrival of the other side with its value plus size, or more: its end. A row x
    meets a later y of the same value if that end comes after y, which is to say if the first arrival of y's own side
    that ends x is also the first after y that would. So each row gets both sides' next end, and rows join on the
    value and the end: what meets in a value of any frequency is what was there together. An end is looked for in the
    row's own range of the sequence, else it is the first later range whose greatest value is enough; the driver holds
    a number per range and side."""
    rows = low.select(F.col(seq).alias("seq"), F.col(on).alias("key"), F.lit(0).alias("side")).unionByName(high.select(F.col(seq).alias("seq"), F.col(on).alias("key"), F.lit(1).alias("side"))).where("key is not null")
    if size < 1:
        return _with_rows(rows.where(F.lit(False)).select(F.col("seq").alias("seq_l"), F.col("seq").alias("seq_h")), low, high, seq)
    rows = rows.withColumn("part", in_range("seq", ranges(rows, "seq", rows=10_000)))
    tops = rows.groupBy("part", "side").agg(F.max("key").alias("top"), F.min("seq").alias("first")).orderBy("part").collect()  # two a range at most
    firsts: dict = {}
    for r in tops:
        firsts[r["part"]] = min(r["first"], firsts.get(r["part"], r["first"]))
    tops = [(r["part"], r["side"], _whole(r["top"])) for r in tops]
    never = min(firsts.values(), default=None)
    kinds = rows.schema
    schema = T.StructType([*kinds.fields[:3], *[T.StructField(f"end{s}", kinds["seq"].dataType) for s in (0, 1)]])

    def ends(pdf):
        """end0, end1: what names each row's end by either side. If it is the first in its range that is enough, the
        range's first row names it, which itself ends no row of its range; if there is none, the first row of all. In
        the first range each end has its own name, as no row lies before."""
        import pandas as pd

        pdf = pdf.sort_values("seq")
        part, seqs, keys, sides = int(pdf["part"].iloc[0]), pdf["seq"].tolist(), [_whole(k) for k in pdf["key"].tolist()], pdf["side"].tolist()
        limits = [k + size for k in keys]
        out = {"seq": pdf["seq"], "key": pdf["key"], "side": pdf["side"]}
        for side in (0, 1):
            own = [k if s == side else None for k, s in zip(keys, sides)]
            later, rising = [], []  # tops of later ranges and values of this one that top all before
            for p, s, top in tops:
                if s == side and p > part and (not later or top > later[-1][0]):
                    later.append((top, firsts[p]))
            for i, k in enumerate(own):
                if k is not None and (not rising or k > rising[-1][0]):
                    rising.append((k, i))
            end = []
            for at, limit in zip(_first_at_least(own, limits), limits):
                if at is None:
                    end.append(_first_of(later, limit, never))
                else:
                    end.append(firsts[part] if firsts[part] != never and at == _first_of(rising, limit, None) else seqs[at])
            out[f"end{side}"] = pd.Series(end, index=pdf.index, dtype=object)
        return pd.DataFrame(out)[schema.fieldNames()]

    told = rows.groupBy("part").applyInPandas(ends, schema)
    # each row is held until the other side ends it, and met until its own side would
    held = told.select("key", F.col("seq").alias("x"), F.col("side").alias("first"), F.when(F.col("side") == 0, F.col("end1")).otherwise(F.col("end0")).alias("end"))
    met = told.select("key", F.col("seq").alias("y"), (1 - F.col("side")).alias("first"), F.when(F.col("side") == 0, F.col("end0")).otherwise(F.col("end1")).alias("end"))
    pairs = held.join(met, ["key", "end", "first"]).where("x < y")
    return _with_rows(pairs.selectExpr("IF(first = 0, x, y) AS seq_l", "IF(first = 0, y, x) AS seq_h"), low, high, seq)


def _whole(value):
    """NaN as infinity, which Python can order."""
    return value if value == value else float("inf")


def cogroup_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """What a group-by over a tagged union of both sides can express: inner, outer, semi and anti joins."""
    return left.join(right, on, how)


def nearest(points: DataFrame, centres: DataFrame, vector: str = "vector", centre: str = "centre", index: str = "index") -> DataFrame:
    """points with the index of the nearest centre, the least of equals. centres are few: they travel as one array."""
    all_ = centres.agg(F.sort_array(F.collect_list(F.struct(F.col(index).alias("i"), F.col(centre).alias("c")))).alias("__centres"))
    far = F.transform("__centres", lambda x: F.struct(distance(F.col(vector), x["c"]).alias("d"), x["i"].alias("i")))
    return points.join(F.broadcast(all_), F.lit(True)).withColumn(index, F.array_min(far)["i"]).drop("__centres")
