"""Rows of a micro-batch in order of arrival: no processor holds them all."""

import random
from collections import Counter

import pandas as pd
import pyarrow as pa
import pytest
from millrace.operators.ordering import slack_sorted
from millrace.streaming import arrival, stateful


class Handle:
    """States of one key, in memory."""

    def __init__(self):
        self.values = {}

    def getValueState(self, name, schema):
        states = self.values

        class State:
            exists = staticmethod(lambda: name in states)
            get = staticmethod(lambda: states[name])
            update = staticmethod(lambda value: states.update({name: value}))

        return State


@pytest.fixture(params=["in order", "mixed"])
def small(request, monkeypatch):
    """Pieces of 50 rows, of which few stay in memory; how rows arrive."""
    monkeypatch.setattr(arrival, "ROWS", 50)
    monkeypatch.setattr(arrival, "HELD", 2_000)
    monkeypatch.setattr(arrival, "RUNS", 3)
    return request.param == "mixed"


def pieces_of(rows: list[dict], mixed: bool, schema: pa.Schema):
    """What packed() sends for batches of 50 rows."""
    rows = random.Random(5).sample(rows, len(rows)) if mixed else rows
    for at in range(0, len(rows), 50):
        some = arrival.by_seq(pa.Table.from_pylist(rows[at : at + 50], schema), "seq")
        yield pd.DataFrame({"rows": [arrival.to_bytes(some)]})


def run(processor, batches):
    """The tables that a processor gives for micro-batches of one key, each by itself."""
    handle = Handle()
    for frames in batches:
        processor.init(handle)
        for frame in processor.handleInputRows((0,), frames, None):
            yield from (arrival.from_bytes(raw) for raw in frame["rows"])


def test_merge(small):
    """All rows in one order, nulls last, in pieces; what is open at a time does not grow with the rows."""
    peaks = []
    for n in (2_000, 8_000):
        seqs = [*range(n), *[None] * 70]
        told, peak = arrival.Arrivals("seq"), [0]
        for frame in pieces_of([{"seq": s} for s in seqs], small, pa.schema([("seq", pa.int64())])):
            told.add(arrival.from_bytes(frame["rows"][0]))
        sort = told._sorted
        told._sorted = lambda some: (peak.append(sum(map(len, some))), sort(some))[1]
        tables = list(told)
        assert [v for t in tables for v in t["seq"].to_pylist()] == seqs and max(map(len, tables)) <= 50
        assert told.file is not None
        peaks.append(max(peak))
    assert max(peaks) <= 50 * 2 * arrival.RUNS


def test_equal_places(small):
    told = arrival.Arrivals("seq")
    for k in range(40):
        told.add(pa.table({"seq": [7] * 50, "k": [k] * 50}))
    tables = list(told)
    assert Counter(v for t in tables for v in t["k"].to_pylist()) == dict.fromkeys(range(40), 50) and max(map(len, tables)) <= 50


def test_groups_in_frames(small):
    """A group of any size comes in frames of few rows, a small one in one frame; values stay as they are."""
    rows = [{"seq": i, "w": None if i % 7 == 0 else f"w{i}", "d": {"a": i}} for i in range(3_000)]
    some = random.Random(1).sample(rows, len(rows)) if small else rows
    frames = list(arrival.ordered((pd.DataFrame(some[at : at + 40]) for at in range(0, len(some), 40)), "seq"))
    assert [r for f in frames for r in f.to_dict("records")] == rows and max(map(len, frames)) <= 50
    assert [len(f) for f in arrival.ordered(iter([pd.DataFrame(rows[5:20]), pd.DataFrame(rows[:5])]), "seq")] == [20]
    counts = stateful._RunningCount()
    counts.init(Handle())
    out = list(counts.handleInputRows(("w",), (pd.DataFrame({"seq": [i, i + 1], "word": "w"}) for i in range(0, 400, 2)), None))
    assert pd.concat(out)["n"].tolist() == list(range(1, 401)) and max(map(len, out)) <= 50


def test_tuple_counts_in_pieces(small):
    """Word, slot, n of every arrival over two micro-batches, never all at once."""
    words = [random.Random(i).choice(["a", "b", "c", None]) for i in range(3_000)]
    rows = [{"seq": i, "word": w} for i, w in enumerate(words)]
    schema = pa.schema([("seq", pa.int64()), ("word", pa.string())])
    tables = list(run(stateful._TupleCounts(4), [pieces_of(rows[:1_000], small, schema), pieces_of(rows[1_000:], small, schema)]))
    want = set()
    for i in range(len(words)):
        now = Counter(words[max(0, i - 3) : i + 1])
        want |= {(w, i + 1, now[w]) for w in words[max(0, i - 4) : i + 1]}
    got = [tuple(r.values()) for t in tables for r in t.to_pylist()]
    assert len(got) == len(want) and set(got) == want and max(map(len, tables)) <= 50


@pytest.mark.parametrize("descending", [False, True])
@pytest.mark.parametrize("compat", [False, True])
@pytest.mark.parametrize("slack", [0, 7, 300])
def test_slack_sort_in_pieces(small, slack, compat, descending):
    """What one list through the buffer gives, over two micro-batches, in pieces; integers beyond 2^53 beside nulls stay."""
    some = random.Random(3)
    rows = [{"seq": i, "v": some.randrange(40), "x": None if i % 3 else 2**60 + i} for i in range(2_000)]
    schema = pa.schema([("seq", pa.int64()), ("v", pa.int64()), ("x", pa.int64())])
    sort = stateful._SlackSort("seq", "v", slack, descending, compat)
    tables = list(run(sort, [pieces_of(rows[:30], small, schema), pieces_of(rows[30:1_100], small, schema), pieces_of(rows[1_100:], small, schema)]))
    want, _ = slack_sorted(rows, lambda r: r["v"], slack, descending, compat)
    assert [r for t in tables for r in t.to_pylist()] == [r | {"out": i} for i, r in enumerate(want, 1)]
    assert max(map(len, tables)) <= 50


@pytest.mark.parametrize("by_window, size", [(True, 6), (True, 200), (False, 3)])
def test_row_join_in_pieces(small, monkeypatch, by_window, size):
    """The pairs of rows one by one over two micro-batches, in pieces; nulls and NaN as keys."""
    monkeypatch.setattr(stateful, "ROWS", 50)
    some = random.Random(4)
    key = lambda i: some.choice([None, float("nan"), 1.0, 2.0]) if by_window else some.choice([None, *[float(i // 10 + k) for k in range(4)]])
    rows = []
    for i in range(2_000):
        side = some.randrange(2)
        rows.append({"seq": i, "side": side, "l": None, "h": None} | {"lh"[side]: {"k": key(i), "x": None if i % 3 else 2**60 + i}})
    struct = pa.struct([("k", pa.float64()), ("x", pa.int64())])
    schema = pa.schema([("seq", pa.int64()), ("side", pa.int32()), ("l", struct), ("h", struct)])
    batches = [pieces_of(rows[:30], small, schema), pieces_of(rows[30:1_100], small, schema), pieces_of(rows[1_100:], small, schema)]
    tables = list(run(stateful._RowJoin("k", size, by_window), batches))
    held, want = [[], []], []
    for r in rows:
        side = r["side"]
        k = r["lh"[side]]["k"]
        if not by_window:
            if k is None:
                continue
            held[1 - side] = [e for e in held[1 - side] if e["lh"[1 - side]]["k"] > k - size]
        for e in held[1 - side]:
            other = e["lh"[1 - side]]["k"]
            if k is not None and other is not None and (other == k or (other != other and k != k)):
                low, high = (e, r) if side else (r, e)
                want.append((low["seq"], high["seq"], low["l"]["x"], high["h"]["x"]))
        held[side].append(r)
        if by_window:
            del held[side][:-size]
    got = [(r["seq_l"], r["seq_h"], r["l"]["x"], r["h"]["x"]) for t in tables for r in t.to_pylist()]
    assert len(want) > 500 and sorted(got, key=str) == sorted(want, key=str) and max(map(len, tables)) <= 50
