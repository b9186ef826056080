"""Stateful processors for what depends on the order of arrival: count windows, slack sort, joins over windows of rows
or of values, and running counts. State lives in the state store and survives lost executors; each group is one key, and a stream
without groups is one key, as its order is global. Rows of a micro-batch are taken in order of seq."""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.types import StructField, StructType

from ..operators.joins import joined_columns
from ..operators.ordering import _Reverse
from .arrival import ROWS, arrivals, from_bytes, in_pieces, ordered, packed, sent, to_bytes, unpacked


def window_values(state: list, value, size: int, advance: int, evict: str) -> tuple[list, list]:
    """The window that a value enters, and what stays of it for the next."""
    now = [*state, value]
    if len(now) < size:
        return now, now
    advance = min(advance, size)
    return now, now[advance:] if evict == "oldest" else now[: size - advance]


def folded(values: list, function: str):
    some = [v for v in values if v is not None]
    if function == "COUNT":
        return len(values)
    if not some:
        return None
    if function == "AVG":
        total = sum(some)
        return abs(total) // len(some) * (1 if total >= 0 else -1)
    return {"SUM": sum, "MIN": min, "MAX": max}[function](some)


class _CountWindow(StatefulProcessor):
    def __init__(self, seq, value, function, size, advance, evict, names):
        self.args = seq, value, function, size, advance, evict, names

    def init(self, handle):
        self.state = handle.getValueState("window", "v array<long>")

    def handleInputRows(self, key, rows, timerValues):
        import pandas as pd

        seq, value, function, size, advance, evict, names = self.args
        window = list(self.state.get()[0]) if self.state.exists() else []
        for pdf in ordered(rows, seq):
            agg = []
            for v in pdf[value]:
                now, window = window_values(window, None if pd.isna(v) else int(v), size, advance, evict)
                agg.append(folded(now, function))
            yield pdf.assign(agg=pd.array(agg, dtype="Int64"))[names]
        self.state.update((window,))

    def close(self):
        pass


def stream_count_window(df: DataFrame, seq: str, value: str, function: str, size: int, advance: int = 1, group: str | None = None, evict: str = "oldest", preserve: tuple[str, ...] = ()) -> DataFrame:
    """The streaming form of count_window()."""
    keep = list(dict.fromkeys([seq, value, *([group] if group else []), *preserve]))
    rows = df.select(*keep).withColumn(value, F.col(value).cast("long")).withColumn("__key", F.col(group) if group else F.lit(0))
    names = [seq, value, "agg", *[k for k in keep if k not in (seq, value)]]
    kinds = {f.name: f.dataType for f in rows.schema} | {"agg": rows.schema[value].dataType}
    schema = StructType([StructField(n, kinds[n]) for n in names])
    return rows.groupBy("__key").transformWithStateInPandas(_CountWindow(seq, value, function, size, advance, evict, names), schema, "Append", "None")


class _SlackSort(StatefulProcessor):
    def __init__(self, seq, attribute, slack, descending, compat):
        self.args = seq, attribute, slack, descending, compat

    def init(self, handle):
        self.buffer = handle.getValueState("buffer", "rows binary, out long")

    def handleInputRows(self, key, rows, timerValues):
        import pyarrow as pa

        seq, attribute, slack, descending, compat = self.args
        raw, count = self.buffer.get() if self.buffer.exists() else (None, 0)
        # what leaves first is the least: equals in order of arrival, with compat the other way round
        sign = -1 if compat else 1
        entry = (lambda k, i: (k, sign * i)) if descending == compat else lambda k, i: (_Reverse(k), sign * i)
        pool = from_bytes(raw) if raw is not None else None  # rows in order of arrival, among them those in the buffer
        heap = [entry(k, i) for i, k in enumerate(pool[attribute].to_pylist())] if pool else []
        heapq.heapify(heap)
        for table in arrivals(rows, seq):
            first, left = len(pool) if pool else 0, []
            pool = pa.concat_tables([pool, table]) if pool else table
            for i, k in enumerate(table[attribute].to_pylist(), first):
                if len(heap) == slack + 1:
                    left.append(sign * heapq.heapreplace(heap, entry(k, i))[1])
                else:
                    heapq.heappush(heap, entry(k, i))
            if left:
                yield from sent(pool.take(left).append_column("out", pa.array(range(count + 1, count + 1 + len(left)), pa.int64())))
                count += len(left)
            if len(pool) > 4 * max(len(heap), len(table)):
                pool, heap = self._held(pool, heap, sign)
        if pool:
            self.buffer.update((to_bytes(self._held(pool, heap, sign)[0]), count))

    def _held(self, pool, heap, sign):
        """Only what is in the buffer."""
        stay = sorted(heap, key=lambda e: sign * e[1])
        heap = [(k, sign * at) for at, (k, _) in enumerate(stay)]
        heapq.heapify(heap)
        return pool.take([sign * i for _, i in stay]).combine_chunks(), heap

    def close(self):
        pass


def stream_slack_sort(df: DataFrame, seq: str, attribute: str, slack: int, descending: bool = False, compat: bool = False) -> DataFrame:
    """The streaming form of slack_sort(); what is in the buffer stays there while the stream goes on."""
    schema = StructType([*df.schema.fields, StructField("out", df.sparkSession.range(0).schema["id"].dataType)])
    rows = packed(df.where(F.col(attribute).isNotNull()), seq).groupBy("__key")
    return unpacked(rows.transformWithStateInPandas(_SlackSort(seq, attribute, slack, descending, compat), "rows binary", "Append", "None"), schema)


class _RowJoin(StatefulProcessor):
    def __init__(self, on, size, by_window):
        self.args = on, size, by_window

    def init(self, handle):
        self.sides = [handle.getValueState(f"side{i}", "rows binary") for i in (0, 1)]

    def handleInputRows(self, key, rows, timerValues):
        import pyarrow as pa
        import pyarrow.compute as pc

        on, size, by_window = self.args
        pools = [from_bytes(s.get()[0]) if s.exists() else None for s in self.sides]  # seq, row of each side
        held = [list(enumerate(self._keys(p["row"]))) if p else [] for p in pools]  # places there and keys
        for table in arrivals(rows, "seq"):
            next_ = [len(p) if p else 0 for p in pools]
            for side, name in enumerate("lh"):
                some = table.filter(pc.equal(table["side"], side)).select(["seq", name]).rename_columns(["seq", "row"])
                pools[side] = pa.concat_tables([pools[side], some]) if pools[side] else some
            pools = [p.combine_chunks() for p in pools]
            pairs = [], []
            for side, *both in zip(table["side"].to_pylist(), self._keys(table["l"]), self._keys(table["h"])):
                k, at = both[side], next_[side]
                next_[side] += 1
                if not by_window:
                    if k is None:
                        continue
                    held[1 - side] = [e for e in held[1 - side] if e[1] > k - size]
                if k is not None:
                    met = [i for i, other in held[1 - side] if other == k]
                    pairs[side].extend([at] * len(met))
                    pairs[1 - side].extend(met)
                held[side].append((at, k))
                if by_window:
                    del held[side][:-size]
                if len(pairs[0]) >= ROWS:
                    yield from self._joined(pools, pairs)
                    pairs = [], []
            yield from self._joined(pools, pairs)
            pools = [p.take(pa.array([i for i, _ in h], pa.int64())) for p, h in zip(pools, held)]
            held = [[(at, k) for at, (_, k) in enumerate(h)] for h in held]
        for s, p in zip(self.sides, pools):
            if p is not None:
                s.update((to_bytes(p),))

    def _keys(self, rows) -> list:
        import pyarrow.compute as pc

        on, _, by_window = self.args
        nan = "NaN" if by_window else float("inf")
        return [nan if k is not None and k != k else k for k in pc.struct_field(rows, [rows.type.get_field_index(on)]).to_pylist()]

    def _joined(self, pools, pairs):
        import pyarrow as pa

        low, high = (p.take(pa.array(i, pa.int64())) for p, i in zip(pools, pairs))
        return sent(pa.table({"seq_l": low["seq"], "seq_h": high["seq"], "l": low["row"], "h": high["row"]}))

    def close(self):
        pass


def _row_pairs(both: DataFrame, on: str, size: int, by_window: bool) -> DataFrame:
    """seq_l, seq_h, l, h of a stream of both sides: seq, side (0 or 1), l or h (the row, the other null)."""
    if by_window and size < 1:
        raise ValueError("size is at least 1")
    kinds = both.schema
    schema = StructType([*[StructField(n, kinds["seq"].dataType) for n in ("seq_l", "seq_h")], *[StructField(n, kinds[n].dataType) for n in ("l", "h")]])
    rows = packed(both, "seq").groupBy("__key")
    return unpacked(rows.transformWithStateInPandas(_RowJoin(on, size, by_window), "rows binary", "Append", "None"), schema)


def stream_join(low: DataFrame, high: DataFrame, on: str, size: int, seq: str = "seq", by_window: bool = True) -> DataFrame:
    """The streaming form of window_join() and, without by_window, of band_join(): seq_l, seq_h and the joined columns.
    Rows of a micro-batch are taken in order of seq over both sides; what comes in a later one comes later. Band joins
    hold rows for as long as the other side's values don't rise."""
    empty = lambda d: F.lit(None).cast(StructType(d.schema.fields))
    side = lambda d, k, l, h: d.select(F.col(seq).alias("seq"), F.lit(k).alias("side"), l.alias("l"), h.alias("h"))
    both = side(low, 0, F.struct(*low.columns), empty(high)).unionByName(side(high, 1, empty(low), F.struct(*high.columns)))
    return _row_pairs(both, on, size, by_window).select("seq_l", "seq_h", *[F.col(f"{at}.{c}").alias(c) for at, c in joined_columns(low, high, seq)])


def stream_window_join(tagged: DataFrame, size: int) -> DataFrame:
    """seq_l, seq_h: the pairs of window_join() over a stream of both sides: seq long, key long, side (0 or 1)."""
    row = F.struct("seq", "key")
    both = tagged.select("seq", "side", F.when(F.col("side") == 0, row).alias("l"), F.when(F.col("side") == 1, row).alias("h"))
    return _row_pairs(both, "key", size, True).select("seq_l", "seq_h")


def _counts_at(words: list, first: int, n: int, slots: int):
    """word, slot, n of the words from first on, of which the first is number n + 1."""
    import numpy as np
    import pyarrow as pa

    coded = pa.array(words, pa.string()).dictionary_encode(null_encoding="encode")
    kinds, back = max(1, len(coded.dictionary)), np.arange(slots + 1)
    at = np.arange(first, len(words))[:, None] - back
    pairs = (at - first + back) * kinds + coded.indices.to_numpy()[np.maximum(at, 0)]
    inside = at >= 0
    found, which = np.unique(pairs[inside], return_inverse=True)
    counts = np.bincount(which, np.broadcast_to(back < slots, at.shape)[inside], len(found)).astype("int64")
    return pa.table({"word": coded.dictionary.take(pa.array(found % kinds)), "slot": found // kinds + n + 1, "n": counts})


class _TupleCounts(StatefulProcessor):
    def __init__(self, slots):
        self.slots = slots

    def init(self, handle):
        self.state = handle.getValueState("last", "words array<string>, n long")

    def handleInputRows(self, key, rows, timerValues):
        last, n = self.state.get() if self.state.exists() else ([], 0)
        last = list(last)  # the last slots words and the one that has just gone
        for table in arrivals(rows, "seq"):
            for some in in_pieces(table, 1 + 500_000 // self.slots):
                words = [*last, *some["word"].to_pylist()]
                yield from sent(_counts_at(words, len(last), n, self.slots))
                last, n = words[-self.slots - 1 :], n + len(some)
        self.state.update((last, n))

    def close(self):
        pass


def stream_tuple_counts(df: DataFrame, slots: int) -> DataFrame:
    """The streaming form of tuple_counts(), over seq long, word string."""
    if slots < 2:
        raise ValueError("at least 2 slots")
    rows = packed(df.select("seq", "word"), "seq").groupBy("__key")
    return unpacked(rows.transformWithStateInPandas(_TupleCounts(slots), "rows binary", "Append", "None"), "word string, slot long, n long")


class _RunningCount(StatefulProcessor):
    def init(self, handle):
        self.n = handle.getValueState("n", "n long")

    def handleInputRows(self, key, rows, timerValues):
        n = self.n.get()[0] if self.n.exists() else 0
        for pdf in ordered(rows, "seq"):
            yield pdf.assign(n=range(n + 1, n + 1 + len(pdf)))[["seq", "word", "n"]]
            n += len(pdf)
        self.n.update((n,))

    def close(self):
        pass


def stream_running_counts(df: DataFrame) -> DataFrame:
    """seq, word, n for each row of a stream (seq long, word string): how often its word has come so far."""
    return df.select("seq", "word").groupBy("word").transformWithStateInPandas(_RunningCount(), "seq long, word string, n long", "Append", "None")
