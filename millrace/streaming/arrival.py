"""Rows of a micro-batch in order of arrival, in memory that doesn't grow with them.

A stream without groups is one key, whose rows all come to one task. So they travel in pieces: tasks sort each Arrow
batch by itself and send it as one value, and the task of the key merges pieces. Pieces beyond HELD bytes go to a file of
the task's own, which goes with it; of pieces that overlap no more than RUNS are open at a time, and where more do, sets of
so many are merged first. What a processor returns travels in pieces as well, and types stay those of Arrow throughout."""

from __future__ import annotations

import heapq
import os
import tempfile
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame

#: Rows and bytes, about, of a piece.
ROWS, BYTES = 10_000, 1_000_000
#: Runs that are merged at a time.
RUNS = 16
#: Bytes of pieces that stay in memory.
HELD = 32_000_000


def to_bytes(table) -> bytes:
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def from_bytes(raw):
    import pyarrow as pa

    return pa.ipc.open_stream(raw).read_all()


def in_pieces(table, rows: int | None = None) -> Iterator:
    most = max(1, min(rows or ROWS, BYTES * len(table) // max(1, table.nbytes)))
    for at in range(0, len(table), most):
        yield table.slice(at, most)


def by_seq(table, seq: str):
    """Nulls last; equals as they come."""
    import pyarrow.compute as pc

    return table.take(pc.sort_indices(table, sort_keys=[(seq, "ascending")]))


def packed(df: DataFrame, seq: str) -> DataFrame:
    """__key (0 for all), rows: the rows of a stream without groups in pieces."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for piece in in_pieces(by_seq(pa.Table.from_batches([batch]), seq)):
                yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([to_bytes(piece)], pa.binary())], ["__key", "rows"])

    return df.mapInArrow(run, "__key int, rows binary")


def sent(table) -> Iterator:
    """What a processor returns for a table."""
    import pandas as pd

    for piece in in_pieces(table):
        yield pd.DataFrame({"rows": [to_bytes(piece)]})


def unpacked(df: DataFrame, schema) -> DataFrame:
    """The rows that a processor sent."""

    def run(batches):
        for batch in batches:
            for raw in batch.column("rows"):
                yield from from_bytes(raw.as_buffer()).to_batches()

    return df.mapInArrow(run, schema)


def _place(value) -> tuple:
    return value is None, value


class Arrivals:
    """Takes sorted pieces and gives all their rows back in order of seq, in pieces."""

    def __init__(self, seq: str):
        self.seq, self.told, self.size, self.file = seq, [], 0, None

    def add(self, table) -> None:
        if len(table):
            self.told.append(self._kept(table))

    def _kept(self, table) -> tuple:
        """First and last place, and the table or where it lies."""
        column, at = table[self.seq], table
        self.size += table.nbytes
        if self.size > HELD:
            if self.file is None:
                self.file = tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)
            raw = to_bytes(table)
            at = self.file.seek(0, os.SEEK_END), len(raw)
            self.file.write(raw)
        return _place(column[0].as_py()), _place(column[-1].as_py()), at

    def _read(self, at):
        if not isinstance(at, tuple):
            return at
        self.file.seek(at[0])
        return from_bytes(self.file.read(at[1]))

    def _runs(self) -> list[list]:
        """The fewest runs of pieces that don't overlap."""
        runs, ends = [], []
        for piece in sorted(self.told, key=lambda p: p[0]):
            if ends and ends[0][0] <= piece[0]:
                at = ends[0][1]
                heapq.heapreplace(ends, (piece[1], at))
                runs[at].append(piece)
            else:
                heapq.heappush(ends, (piece[1], len(runs)))
                runs.append([piece])
        return runs

    def _up_to(self, table, place: tuple) -> int:
        import pyarrow as pa
        import pyarrow.compute as pc

        column = table[self.seq]
        return len(table) if place[0] else pc.sum(pc.less_equal(column, pa.scalar(place[1], column.type))).as_py() or 0

    def _merged(self, runs: list[list]) -> Iterator:
        """Of the pieces that are open, what comes before the next piece begins is complete."""
        open_, ready, rows, size = [], [], 0, 0
        for piece in [*sorted((p for r in runs for p in r), key=lambda p: p[0]), None]:
            some, still = [], []
            for last, table in open_:
                n = len(table) if piece is None or last <= piece[0] else self._up_to(table, piece[0])
                some += [table.slice(0, n)] if n else []
                still += [(last, table.slice(n))] if n < len(table) else []
            open_ = still
            if some:
                ready.append(self._sorted(some))
                rows, size = rows + len(ready[-1]), size + ready[-1].nbytes
            if ready and (rows >= ROWS or size >= BYTES or piece is None):
                yield from in_pieces(_one(ready))
                ready, rows, size = [], 0, 0
            if piece is not None:
                open_.append((piece[1], self._read(piece[2])))

    def _sorted(self, tables: list):
        return tables[0] if len(tables) == 1 else by_seq(_one(tables), self.seq)

    def __iter__(self) -> Iterator:
        runs, self.told = self._runs(), []
        while len(runs) > RUNS:
            runs = [[self._kept(t) for t in self._merged(runs[at : at + RUNS])] for at in range(0, len(runs), RUNS)]
        yield from self._merged(runs)


def _one(tables: list):
    import pyarrow as pa

    return pa.concat_tables(tables, promote_options="permissive").combine_chunks()


def arrivals(frames: Iterable, seq: str) -> Iterator:
    """The rows of packed() in order of seq, as tables."""
    told = Arrivals(seq)
    for frame in frames:
        for raw in frame["rows"]:
            told.add(from_bytes(raw))
    return iter(told)


def ordered(frames: Iterable, seq: str) -> Iterator:
    """The rows of a group in order of seq, as frames: one for a group of up to ROWS rows. Rows of larger groups are
    merged as bytes."""
    import pickle

    import pandas as pd
    import pyarrow as pa

    def table(frame):
        return pa.table({"seq": pa.array(frame[seq], from_pandas=True), "row": pa.array([pickle.dumps(r) for r in frame.itertuples(index=False, name=None)], pa.binary())})

    frames, few, rows = iter(frames), [], 0
    for frame in frames:
        few.append(frame)
        rows += len(frame)
        if rows > ROWS:
            break
    if not few:
        return
    if rows <= ROWS:
        yield pd.concat(few).sort_values(seq, kind="stable")
        return
    told, names = Arrivals("seq"), few[0].columns
    while few:
        told.add(by_seq(table(few.pop(0)), "seq"))
    for frame in frames:
        told.add(by_seq(table(frame), "seq"))
    for some in told:
        yield pd.DataFrame([pickle.loads(r) for r in some["row"].to_pylist()], columns=names)
