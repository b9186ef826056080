"""Text files, custom writers, results to the driver, and what streams print."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F


def write_lines(df: DataFrame, path: str, overwrite: bool = True, gzip: bool = False) -> DataFrame:
    """One line per row, its fields joined by a blank; arrays as [a, b]; a null field is empty text. Rows of no
    field write nothing; a row whose fields are empty writes an empty line. Passes the rows on."""
    lines = df.select(F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]).alias("value"))
    (lines if df.columns else lines.limit(0)).write.mode("overwrite" if overwrite else "append").option("compression", "gzip" if gzip else "none").text(path)
    return df


def write_with(df: DataFrame, writer: Callable[[int, Iterator[Row]], None]) -> None:
    """A user's writer gets the number of each partition and its rows. A partition may be written more than once if
    its executor is lost: name what is written after it."""

    def run(rows: Iterator[Row]) -> None:
        from pyspark import TaskContext

        writer(TaskContext.get().partitionId(), rows)

    df.foreachPartition(run)


def result(df: DataFrame) -> Iterator[Row]:
    """Rows page by page, a partition at a time."""
    return df.toLocalIterator(prefetchPartitions=True)


class Throughput:
    """A foreachBatch sink: (elapsed_ms, rows, rows a second) each time that many more rows have come."""

    def __init__(self, every: int):
        import time

        self.every, self.began, self.rows, self.last = every, time.time(), 0, (0, time.time())
        self.lines: list[tuple[int, int, float]] = []

    def __call__(self, df: DataFrame, _batch: int) -> None:
        import time

        self.rows += df.count()
        if self.rows - self.last[0] >= self.every:
            now = time.time()
            self.lines.append((int((now - self.began) * 1000), self.rows, (self.rows - self.last[0]) / max(1e-9, now - self.last[1])))
            self.last = self.rows, now
