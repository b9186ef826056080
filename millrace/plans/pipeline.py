"""A fluent path of operators over a batch or a stream.

The same definition runs on either: what is without order is plain DataFrame operations; what depends on the order of
arrival takes its closed form on a batch and a stateful processor on a stream. Paths may split and join again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..functions.predicates import Constraint, keep
from ..operators import joins, ordering, relational, windows


class Path:
    def __init__(self, df: DataFrame, seq: str = "seq"):
        self.df, self.seq = df, seq

    def _then(self, df: DataFrame) -> Path:
        return Path(df, self.seq)

    def filter(self, *constraints: Constraint) -> Path:
        return self._then(keep(self.df, *constraints))

    def map(self, *attributes: str) -> Path:
        """Projects to the named attributes and the order of arrival."""
        return self._then(relational.project_by_name(self.df, *dict.fromkeys([*attributes, *([self.seq] if self.seq in self.df.columns else [])])))

    def aggregate(self, value: str, function: str, size: int, advance: int = 1, group: str | None = None, preserve: tuple[str, ...] = (), evict: str = "oldest") -> Path:
        if self.df.isStreaming:
            from ..streaming.stateful import stream_count_window

            return self._then(stream_count_window(self.df, self.seq, value, function, size, advance, group, evict=evict, preserve=preserve))
        return self._then(windows.count_window(self.df, self.seq, value, function, size, advance, group, evict, preserve))

    def sort(self, attribute: str, slack: int, descending: bool = False, compat: bool = False) -> Path:
        """The slack sort's output carries its order in out, which the rest of the path goes by."""
        if self.df.isStreaming:
            from ..streaming.stateful import stream_slack_sort

            return Path(stream_slack_sort(self.df, self.seq, attribute, slack, descending, compat), "out")
        return Path(ordering.slack_sort(self.df, self.seq, attribute, slack, descending, compat), "out")

    def split(self) -> tuple[Path, Path]:
        """Two paths that both get every row. Spark reads a shared exchange once."""
        return Path(self.df, self.seq), Path(self.df, self.seq)

    def join(self, other: Path, on: str, size: int, by_window: bool = True) -> Path:
        """This path is channel 0. by_window: over the last size rows; else over a band of values."""
        from pyspark.sql import functions as F

        high = other.df.withColumnRenamed(other.seq, self.seq)
        if self.df.isStreaming or high.isStreaming:
            from ..streaming.stateful import stream_join

            out = stream_join(self.df, high, on, size, self.seq, by_window)
        else:
            out = (joins.window_join if by_window else joins.band_join)(self.df, high, on, size, self.seq)
        return Path(out.withColumn(self.seq, F.greatest("seq_l", "seq_h")).drop("seq_l", "seq_h"), self.seq)

    def union(self, other: Path) -> Path:
        return self._then(relational.branch(self.df, other.df))

    def then(self, action: Callable[[DataFrame], DataFrame]) -> Path:
        """Any user action."""
        return self._then(action(self.df))
