"""Sorting in partitions, over all, and with a bounded buffer; top-k and rankings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .positions import in_range, ranges


def partition_sort(df: DataFrame, keys: Sequence[str], order: Sequence[str] | None = None, partitions: int | None = None) -> DataFrame:
    """Deals rows by keys and sorts each partition, by the keys or by order (a secondary sort)."""
    dealt = df.repartition(partitions, *keys) if partitions else df.repartition(*keys)
    return dealt.sortWithinPartitions(*(order or keys))


def global_sort(df: DataFrame, *order) -> DataFrame:
    """By ranges, in parallel."""
    return df.orderBy(*order)


def first_of_each(df: DataFrame, keys: Sequence[str], *order) -> DataFrame:
    """The first row of each key in a secondary sort, found by a minimum that is pre-aggregated."""
    names = [c if isinstance(c, str) else c._jc.toString() for c in order]
    rest = [c for c in df.columns if c not in keys and c not in names]
    return df.groupBy(*keys).agg(F.min(F.struct(*names, *rest)).alias("__r")).select(*[c if c in keys else F.col(f"__r.{c}").alias(c) for c in df.columns])


def top_k(df: DataFrame, k: int, *order) -> DataFrame:
    """Each task sends its best k: never a full sort."""
    return df.orderBy(*order).limit(k)


def rank_in(df: DataFrame, keys: Sequence[str], k: int, *order, name: str = "rank") -> DataFrame:
    """The best k of each key, numbered."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(name) <= k)


def slack_sorted(rows: list, key, slack: int, descending: bool = False, compat: bool = False, held: list = ()) -> tuple[list, list]:
    """What a buffer of slack + 1 rows lets go in turn, and what is left in it. The smallest goes first (descending:
    the largest), equals in order of arrival. compat: the other end goes, and the rest is in the buffer's order. held:
    what is in the buffer at first, in order of arrival."""
    from bisect import insort

    rows = [*held, *rows]
    buffer, out = [], []
    for n, r in enumerate(rows):
        k = key(r)
        entry = (_Reverse(k), n) if descending else (k, n)
        if n >= len(held) and len(buffer) == slack + 1:
            out.append(rows[buffer.pop(-1 if compat else 0)[1]])
        insort(buffer, entry)
    left = [rows[n] for _, n in (reversed(buffer) if compat else buffer)]
    return out, left


class _Reverse:
    __slots__ = ("k",)

    def __init__(self, k):
        self.k = k

    def __lt__(self, other):
        return other.k < self.k

    def __eq__(self, other):
        return self.k == other.k


#: Rows of a range of the sequence that one task takes through the buffer.
RANGE = 50_000


def slack_sort(df: DataFrame, seq: str, attribute: str, slack: int, descending: bool = False, compat: bool = False, flush: bool = True, group: str | None = None) -> DataFrame:
    """Rows through a bounded buffer in order of seq; out: the place in which each leaves it. Without flush (compat:
    always) rows still in the buffer at the end are dropped. Each group (null is one) is one sequence, and so is a
    stream without groups. Only attribute and seq are held, the rows join by seq.

    The buffer holds the row that came last and, of those before it, the slack rows that would leave last. So ranges of
    the sequence are sorted at the same time, each from the buffer that the ranges before it leave: the last of them,
    and the best of the slack + 1 best rows of each. A task holds a range, or those of all ranges."""
    final = flush and not compat
    keys = df.select(F.col(seq).alias("__seq"), F.col(attribute).alias("__key"), (F.col(group) if group else F.lit(0)).alias("__group")).where("__key is not null")
    keys = keys.withColumn("__range", in_range("__seq", ranges(keys, "__seq", RANGE)))
    # which rows stay longest: those at the end that doesn't go; of equals those that do not go first
    by_key = F.col("__key").asc() if descending != compat else F.col("__key").desc()
    by_seq = F.col("__seq").asc() if compat else F.col("__seq").desc()
    of = Window.partitionBy("__group", "__range")
    told = keys.withColumn("__best", F.row_number().over(of.orderBy(by_key, by_seq))).withColumn("__late", F.row_number().over(of.orderBy(F.col("__seq").desc()))).withColumn("__n", F.count("*").over(of))
    told = told.where((F.col("__best") <= slack + 1) | (F.col("__late") == 1)).drop("__best")
    kinds = keys.schema
    seeds = T.StructType([kinds["__group"], kinds["__range"], T.StructField("s_seq", kinds["__seq"].dataType), T.StructField("s_key", kinds["__key"].dataType), T.StructField("before", T.LongType()), T.StructField("last", T.BooleanType())])
    names = seeds.fieldNames()

    def begin(pdf):
        """What the buffer holds when each range begins; a row without s_seq for each range besides."""
        import pandas as pd

        out, best, late, before = [], [], None, 0
        group_ = pdf["__group"].iloc[0]
        parts = sorted(pdf.groupby("__range"), key=lambda x: x[0])
        for at, (number, part) in enumerate(parts):
            out.append((group_, number, None, None, before, at == len(parts) - 1))
            if late is not None:
                held = [late, *[r for r in best if r[1] != late[1]][:slack]]
                out += [(group_, number, s, k, before, False) for k, s in sorted(held, key=lambda r: r[1])]
            some = best + list(zip(part["__key"], part["__seq"]))
            some.sort(key=lambda r: r[1], reverse=not compat)
            some.sort(key=lambda r: r[0], reverse=descending == compat)
            best = list(dict.fromkeys(some))[: slack + 1]
            late = next(zip(part["__key"][part["__late"] == 1], part["__seq"][part["__late"] == 1]))
            before += int(part["__n"].iloc[0])
        return pd.DataFrame(out, columns=names).astype({"s_seq": object, "s_key": object})

    schema = T.StructType([T.StructField("__seq", kinds["__seq"].dataType), T.StructField("out", T.LongType())])

    def run(pdf, start):
        import pandas as pd

        pdf = pdf.sort_values("__seq")
        head = start[start["s_seq"].isna()].iloc[0]
        held = start[start["s_seq"].notna()].sort_values("s_seq")
        out, left = slack_sorted(list(zip(pdf["__key"], pdf["__seq"])), lambda r: r[0], slack, descending, compat, list(zip(held["s_key"], held["s_seq"])))
        order = [s for _, s in (out + left if final and head["last"] else out)]
        first = max(0, int(head["before"]) - slack - 1) + 1
        return pd.DataFrame({"__seq": order, "out": range(first, first + len(order))})

    by = ["__group", "__range"]
    placed = keys.groupBy(*by).cogroup(told.groupBy("__group").applyInPandas(begin, seeds).groupBy(*by)).applyInPandas(run, schema)
    return df.join(placed, df[seq] == placed["__seq"]).drop("__seq")


def rankings(counts: DataFrame, k: int, keys: Sequence[str] = (), word: str = "word", count: str = "n") -> DataFrame:
    """keys, words, counts: the k most frequent words as two arrays; equal counts by word. Zero counts are left out."""
    best = rank_in(counts.where(F.col(count) > 0), keys, k, F.col(count).desc(), F.col(word)) if keys else top_k(counts.where(F.col(count) > 0), k, F.col(count).desc(), F.col(word))
    pairs = F.sort_array(F.collect_list(F.struct((-F.col(count)).alias("c"), F.col(word).alias("w"))))
    return best.groupBy(*keys).agg(pairs.alias("__p")).select(*keys, F.transform("__p", lambda p: p["w"]).alias("words"), F.transform("__p", lambda p: -p["c"]).alias("counts"))


