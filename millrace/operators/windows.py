"""Running aggregates over windows of a number of rows, in closed form.

Each input row gives one row: the aggregate of the window that it has just entered. When a window holds size rows,
advance of them (at most size) leave before the next. Windows are evaluated in pieces of bounded length, so neither a
single stream nor a hot group meets in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .positions import numbered

FUNCTIONS = ("SUM", "MIN", "MAX", "COUNT", "AVG")
#: Rows of a piece of a sliding window's stream, besides the rows that it repeats of the piece before.
PIECE = 20_000


def _parts(value: str, over: Window | None) -> dict[str, Column]:
    parts = {"__sum": F.sum(value), "__min": F.min(value), "__max": F.max(value), "__n": F.count("*"), "__nn": F.count(value)}
    return {k: c.over(over) for k, c in parts.items()} if over is not None else parts


def _result(function: str) -> Column:
    return {"SUM": F.col("__sum"), "MIN": F.col("__min"), "MAX": F.col("__max"), "COUNT": F.col("__n"), "AVG": F.expr("__sum div nullif(__nn, 0)")}[function]


def count_window(df: DataFrame, seq: str, value: str, function: str, size: int, advance: int = 1, group: str | None = None, evict: str = "oldest", preserve: tuple[str, ...] = (), name: str = "agg") -> DataFrame:
    """value (whole numbers): aggregated over the last rows of its group. Returns seq, value, name, the group and the
    preserved attributes. evict: "oldest" rows leave, or the "newest" ones. SUM, MIN, MAX and AVG skip nulls; AVG
    truncates; COUNT is the number of rows."""
    if function not in FUNCTIONS or evict not in ("oldest", "newest") or size < 1 or advance < 1:
        raise ValueError("function, evict, size or advance")
    advance = min(advance, size)
    keep = list(dict.fromkeys([seq, value, *([group] if group else []), *preserve]))
    rows = numbered(df.select(*keep), seq, group, "__i").withColumn(value, F.col(value).cast("long"))
    by = [group] if group else []
    if evict == "newest" and advance < size:
        rows = _newest(rows, value, size, advance, by)
    elif advance == size:
        rows = rows.withColumn("__block", F.expr(f"(__i - 1) div {size}"))
        rows = rows.withColumns(_parts(value, Window.partitionBy(*by, "__block").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)))
    elif advance == 1:
        piece = max(PIECE, 4 * size)
        own = f"(__i - 1) div {piece}"
        rows = rows.withColumn("__own", F.expr(own)).withColumn("__block", F.explode(F.expr(f"IF(__i > (__own + 1) * {piece} - {size - 1}, array(__own, __own + 1), array(__own))")))
        rows = rows.withColumns(_parts(value, Window.partitionBy(*by, "__block").orderBy("__i").rowsBetween(1 - size, 0))).where("__own = __block")
    else:
        # block k holds rows advance*k + 1 to advance*k + size; a row's result comes from the block that is open then
        rows = rows.withColumn("__own", F.expr(f"IF(__i <= {size}, 0, (__i - {size} - 1) div {advance} + 1)"))
        rows = rows.withColumn("__block", F.explode(F.expr(f"sequence(IF(__i <= {size}, 0, (__i - {size} - 1) div {advance} + 1), (__i - 1) div {advance})")))
        rows = rows.withColumns(_parts(value, Window.partitionBy(*by, "__block").orderBy("__i").rowsBetween(Window.unboundedPreceding, 0))).where("__own = __block")
    return rows.select(seq, value, _result(function).alias(name), *[k for k in keep if k not in (seq, value)])


def _newest(rows: DataFrame, value: str, size: int, advance: int, by: list[str]) -> DataFrame:
    """The first size - advance rows stay for good; of the others the window holds those since the last eviction."""
    running = lambda *block: Window.partitionBy(*by, *block).orderBy("__i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__block", F.expr(f"IF(__i <= {size}, -1, (__i - {size} - 1) div {advance})")).withColumns(_parts(value, running("__block")))
    base = rows.where(F.col("__i") <= size - advance).groupBy(*by).agg(*[c.alias(f"{k}0") for k, c in _parts(value, None).items()])
    if by:
        base = base.withColumnRenamed(by[0], "__g0")
        rows = rows.join(base, F.col(by[0]).eqNullSafe(F.col("__g0")), "left").drop("__g0")
    else:
        rows = rows.join(F.broadcast(base), F.lit(True), "left")  # one row
    late = F.col("__i") > size
    both = {"__sum": F.coalesce(F.col("__sum") + F.col("__sum0"), "__sum", "__sum0"), "__min": F.least("__min", "__min0"), "__max": F.greatest("__max", "__max0"), "__n": F.col("__n") + F.col("__n0"), "__nn": F.col("__nn") + F.col("__nn0")}
    return rows.withColumns({k: F.when(late, c).otherwise(F.col(k)) for k, c in both.items()})
