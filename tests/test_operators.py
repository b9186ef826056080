"""Worked examples, odd inputs, and the shapes of plans."""

import random

import pytest
from millrace.functions.predicates import Constraint, Op, keep
from millrace.functions.scalars import format_vector, parse_vector, round2, words
from millrace.functions.types import tuple_schema
from millrace.operators import joins, ordering, positions, relational, rolling, windows
from pyspark.sql import functions as F


def seq(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values, 1)], "seq long, v long")


def window(spark, values, *args, **kw):
    return [r.agg for r in windows.count_window(seq(spark, values), "seq", "v", *args, **kw).orderBy("seq").collect()]


@pytest.mark.parametrize(
    "values, size, advance, evict, want",
    [
        (range(1, 7), 3, 1, "oldest", [1, 3, 6, 9, 12, 15]),
        (range(1, 7), 3, 3, "oldest", [1, 3, 6, 4, 9, 15]),
        (range(1, 9), 4, 2, "oldest", [1, 3, 6, 10, 12, 18, 18, 26]),
        (range(1, 9), 4, 2, "newest", [1, 3, 6, 10, 8, 14, 10, 18]),
        (range(1, 7), 3, 1, "newest", [1, 3, 6, 7, 8, 9]),
        (range(1, 7), 3, 9, "newest", [1, 3, 6, 4, 9, 15]),
    ],
)
def test_worked_windows(spark, values, size, advance, evict, want):
    assert window(spark, values, "SUM", size, advance, evict=evict) == want


def model(values, function, size, advance, evict):
    from millrace.streaming.stateful import folded, window_values

    state, out = [], []
    for v in values:
        now, state = window_values(state, v, size, advance, evict)
        out.append(folded(now, function))
    return out


def test_windows_against_a_model(spark, monkeypatch):
    monkeypatch.setattr(windows, "PIECE", 7)
    real = positions.ranges
    monkeypatch.setattr(positions, "ranges", lambda df, s, rows=9: real(df, s, 9))
    rnd = random.Random(1)
    for function, size, advance, evict in [("SUM", 5, 1, "oldest"), ("MIN", 6, 4, "oldest"), ("MAX", 6, 4, "newest"), ("AVG", 4, 4, "oldest"), ("COUNT", 3, 2, "oldest"), ("AVG", 5, 2, "newest"), ("SUM", 1, 1, "newest")]:
        values = [rnd.choice([None, *range(-9, 10)]) for _ in range(60)]
        assert window(spark, values, function, size, advance, evict=evict) == model(values, function, size, advance, evict)
        groups = [rnd.choice(["a", "b", None]) for _ in values]
        df = spark.createDataFrame([(i, v, g) for i, (v, g) in enumerate(zip(values, groups))], "seq long, v long, g string")
        got = windows.count_window(df, "seq", "v", function, size, advance, "g", evict).orderBy("seq").collect()
        for g in ("a", "b", None):
            assert [r.agg for r in got if r.g == g] == model([v for v, x in zip(values, groups) if x == g], function, size, advance, evict)


@pytest.mark.parametrize(
    "descending, compat, out, left",
    [(False, True, [5, 4, 3, 6], [2, 1, 0]), (True, True, [1, 2, 3, 4], [0, 5, 6]), (False, False, [1, 2, 3, 4], [0, 5, 6])],
)
def test_slack_sort(spark, descending, compat, out, left):
    values = [5, 1, 4, 2, 3, 6, 0]
    assert ordering.slack_sorted(values, lambda v: v, 2, descending, compat) == (out, left)
    df = ordering.slack_sort(seq(spark, values), "seq", "v", 2, descending, compat)
    assert [r.v for r in df.orderBy("out").collect()] == (out if compat else out + left)


@pytest.mark.parametrize("slack", [0, 1, 5])
def test_slack_sort_in_ranges(spark, monkeypatch, slack):
    """Many ranges, groups and ties give what one buffer gives."""
    monkeypatch.setattr(ordering, "RANGE", 12)
    rnd = random.Random(slack)
    rows = [(i, rnd.randrange(9), rnd.choice(["a", "b", None])) for i in range(150)]
    df = spark.createDataFrame(rows, "seq long, v long, g string")
    for descending in (False, True):
        for compat in (False, True):
            for group in (None, "g"):
                got = ordering.slack_sort(df, "seq", "v", slack, descending, compat, group=group).collect()
                for g in {r[2] for r in rows} if group else {0}:
                    own = [r for r in rows if not group or r[2] == g]
                    out, left = ordering.slack_sorted(own, lambda r: r[1], slack, descending, compat)
                    want = [(r[0], i) for i, r in enumerate(out if compat else out + left, 1)]
                    assert sorted((r.seq, r.out) for r in got if not group or r.g == g) == sorted(want)


def join_model(events, size):
    held, out = {"a": [], "b": []}, set()
    for s, (side, k) in enumerate(events, 1):
        out |= {(o, s) if side == "b" else (s, o) for o, x in held["a" if side == "b" else "b"] if x == k}
        held[side] = [*held[side], (s, k)][-size:]
    return out


def test_window_join(spark, monkeypatch):
    real = positions.ranges
    monkeypatch.setattr(joins, "ranges", lambda df, s, rows=9: real(df, s, 9))
    rnd = random.Random(2)
    cases = [([("a", 1), ("b", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 3)], 2)] + [([(rnd.choice("ab"), rnd.randrange(4)) for _ in range(60)], size) for size in (1, 3, 7, 50)]
    for events, size in cases:
        side = lambda x, c: spark.createDataFrame([(s, k, s * 10) for s, (y, k) in enumerate(events, 1) if x == y], f"seq long, k long, {c} long")  # noqa: E731, B023
        got = joins.window_join(side("a", "B"), side("b", "C"), "k", size)
        assert got.columns == ["seq_l", "seq_h", "k", "C", "B"]
        assert {(r.seq_l, r.seq_h) for r in got.collect()} == join_model(events, size)


def band_model(events, size):
    held, out = {"a": [], "b": []}, set()
    for s, (side, k) in enumerate(events, 1):
        other = "a" if side == "b" else "b"
        held[other] = [(o, x) for o, x in held[other] if x > k - size]
        out |= {(o, s) if side == "b" else (s, o) for o, x in held[other] if x == k}
        held[side].append((s, k))
    return out


def test_band_join(spark, monkeypatch):
    real = positions.ranges
    monkeypatch.setattr(joins, "ranges", lambda df, s, rows=9: real(df, s, 9))
    rnd = random.Random(3)
    for size in (0, 1, 2, 5):
        events = [(rnd.choice("ab"), i // 4 + rnd.randrange(-3, 4)) for i in range(80)]
        side = lambda x: spark.createDataFrame([(s, k) for s, (y, k) in enumerate(events, 1) if x == y], "seq long, k long")  # noqa: E731, B023
        assert {(r.seq_l, r.seq_h) for r in joins.band_join(side("a"), side("b"), "k", size).collect()} == band_model(events, size)


def test_band_join_of_a_frequent_key(spark, monkeypatch):
    """One value holds nearly all rows; what ends them comes from either side, in other ranges, and many times."""
    real = positions.ranges
    monkeypatch.setattr(joins, "ranges", lambda df, s, rows=9: real(df, s, 9))
    rnd = random.Random(4)
    for odd in (0.0, 0.1, 0.3):
        events = [(rnd.choice("ab"), rnd.choice([9, 30, -5]) if rnd.random() < odd else 7) for _ in range(90)]
        side = lambda x: spark.createDataFrame([(s, float(k)) for s, (y, k) in enumerate(events, 1) if x == y], "seq long, k double")  # noqa: E731, B023
        assert {(r.seq_l, r.seq_h) for r in joins.band_join(side("a"), side("b"), "k", 2).collect()} == band_model(events, 2)
    nulls = spark.createDataFrame([(1, None), (2, float("nan")), (3, 1.0)], "seq long, k double")
    others = spark.createDataFrame([(4, None), (5, float("nan")), (6, 1.0)], "seq long, k double")
    assert [(r.seq_l, r.seq_h) for r in joins.band_join(nulls, others, "k", 2).collect()] == []


def test_shared_names_take_the_lower_channel(spark):
    low = spark.createDataFrame([(1, 7, "low", 1)], "seq long, k long, x string, p int")
    high = spark.createDataFrame([(2, 7, "high", 2)], "seq long, k long, x string, q int")
    row = joins.window_join(low, high, "k", 5).first()
    assert row.asDict() == {"seq_l": 1, "seq_h": 2, "k": 7, "x": "low", "q": 2, "p": 1}


def test_consecutive(spark):
    df = spark.createDataFrame(list(enumerate("aabaacc")), "i int, x string")
    assert [r.x for r in relational.drop_consecutive(df, "i", ["x"]).orderBy("i").collect()] == list("abac")
    odd = spark.createDataFrame([(1, None), (2, None), (3, "x"), (4, None)], "i int, x string")
    assert relational.drop_consecutive(odd, "i", ["x"]).count() == 3


def test_slot_counter(spark):
    df = spark.createDataFrame([("X", 0), ("X", 1), ("X", 2), ("X", 3), ("Y", 12)], "w string, t int")
    got = {r.slot: r.n for r in rolling.slot_counts(df, "w", "t", 5).where("word = 'X'").collect()}
    assert [got.get(t) for t in range(10)] == [1, 2, 3, 4, 4, 3, 2, 1, 0, None]


def test_termination_shapes(spark):
    df = spark.range(100).toDF("v")
    assert relational.gather(df).rdd.getNumPartitions() == 1
    assert relational.exchange(relational.exchange(df, "v", partitions=10), "v", partitions=1).count() == 100
    assert relational.tee(df, lambda d: d).count() == 200
    assert relational.branch(df, df.limit(30)).count() == 130
    assert relational.block(df).count() == 0
    assert relational.tee(relational.branch(df, df), lambda d: relational.block(d)).count() == 200


def test_predicates(spark):
    df = spark.createDataFrame([(1, "ab", 1.5), (None, None, None), (3, "b", 2.5)], "n int, s string, d double")
    ids = lambda *c: [r.n for r in keep(df, *c).collect()]
    assert ids() == [1, None, 3] and ids(Constraint("n", Op.DF, 1)) == [3] and ids(Constraint("s", Op.IN, "b"), Constraint("n", Op.GT, 1)) == [3]
    assert ids(Constraint("d", Op.GT, 0)) == [] and ids(Constraint("s", Op.PF, "a")) == [1] and ids(Constraint("s", Op.DF, "b")) == [1]
    for bad in (("n", Op.PF, 1), ("s", Op.GT, "x")):
        with pytest.raises(ValueError):
            Constraint(*bad)


def test_filters_fuse_and_reach_the_scan(spark, sf):
    df = spark.read.parquet(f"{sf}/lineitem.parquet")
    for _ in range(30):
        df = keep(df, Constraint("l_linenumber", Op.GT, 2))
    plan = df.select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert plan.count(") Filter (") == 1 and "GreaterThan(l_linenumber,2)" in plan and "l_comment" not in plan


def test_project(spark):
    df = spark.createDataFrame([(1, 2, 3)], "a int, b int, c int")
    assert relational.project(df, [2, 0, 2]).first().asDict() == {"c": 3, "a": 1, "c_2": 3}
    assert relational.project_by_name(df, "c", "a").columns == ["a", "c"]
    with pytest.raises(ValueError):
        relational.project_by_name(df, "z")
    with pytest.raises(ValueError):
        relational.sample(df, 101)


def test_scalars_and_types(spark):
    df = spark.createDataFrame([("x  y\tx",), ("",), (" y",)], "t string")
    assert {r.w: r["count"] for r in df.select(F.explode(words("t")).alias("w")).groupBy("w").count().collect()} == {"x": 2, "y": 2}
    one = spark.createDataFrame([("1.5 -2 3",)], "t string").select(parse_vector("t").alias("v")).select("v", format_vector("v").alias("f"), round2(F.lit(-0.005)).alias("r")).first()
    assert one.v == [1.5, -2.0, 3.0] and one.f == "1.5 -2.0 3.0" and one.r == 0.0
    assert tuple_schema("TInt", "TBag(TString, TLong)").simpleString() == "struct<c0:int,c1:array<struct<c0:string,c1:bigint>>>"
    with pytest.raises(ValueError):
        tuple_schema("TFloat")


def test_numbered_and_empty(spark):
    empty = seq(spark, [])
    for args in (("SUM", 3, 1), ("SUM", 3, 2), ("SUM", 3, 3)):
        assert windows.count_window(empty, "seq", "v", *args).collect() == []
    assert joins.window_join(empty, empty.withColumnRenamed("v", "v"), "v", 3).collect() == []
    assert positions.numbered(empty, "seq").collect() == []


def test_counters(spark):
    from pyspark.sql import Observation

    o = Observation("seen")
    assert relational.counted(spark.range(10), o, rows=F.count("*"), total=F.sum("id")).count() == 10
    assert o.get == {"rows": 10, "total": 45}
    assert relational.unique_ids(spark.range(100, numPartitions=4)).select("id").distinct().count() == 100
