"""Sources, sinks, actions, jobs, programs and streams."""

import gzip
import json
import socket
import threading

import pytest
from millrace.functions.predicates import Constraint, Op
from millrace.operators import joins, ordering, rolling, windows
from millrace.plans import apps
from millrace.plans.actions import Action, Job, apply, gather
from millrace.plans.pipeline import Path
from millrace.sinks.files import Throughput, result, write_lines, write_with
from millrace.sources import files, generators
from millrace.streaming import stateful
from pyspark.sql import functions as F


@pytest.fixture()
def folder(tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "one.txt").write_text("x  y\tx\n\n y\n")
    (tmp_path / "a" / "_hidden").write_text("no\n")
    (tmp_path / "a" / ".dot").write_text("no\n")
    with gzip.open(tmp_path / "a" / "b" / "two.gz", "wt") as f:
        f.write("y z\n")
    return tmp_path


def test_files(spark, folder):
    assert sorted(r.line for r in files.read_lines(spark, f"{folder}/a").collect()) == ["", " y", "x  y\tx", "y z"]
    assert {r.path.rsplit("/", 1)[1] for r in files.list_files(spark, f"{folder}/a").collect()} == {"one.txt", "two.gz"}
    assert [r.n for r in files.read_with(spark, f"{folder}/a", lambda b: [(len(b),)], "n int", "*.txt").collect()] == [11]
    apps.word_count_files(spark, f"{folder}/a", f"{folder}/out")
    assert sorted(r.value for r in spark.read.text(f"{folder}/out").collect()) == ["x 2", "y 3", "z 1"]
    apps.sort_files(spark, f"{folder}/a", f"{folder}/sorted")
    assert files.read(spark, "text", path=f"{folder}/sorted").count() == 4  # an empty line is a row like others
    write_lines(spark.createDataFrame([(1, [1.5, 2.0], None)], "a int, b array<double>, c string"), f"{folder}/gz", gzip=True)
    assert spark.read.text(f"{folder}/gz").first().value == "1 [1.5, 2.0] "
    write_lines(spark.createDataFrame([(" ",), ("",), (None,), ("x",)], "a string"), f"{folder}/blank")
    assert sorted(r.value for r in spark.read.text(f"{folder}/blank").collect()) == ["", "", " ", "x"]
    write_lines(spark.range(3).select(), f"{folder}/none")
    assert spark.read.text(f"{folder}/none").count() == 0
    write_with(spark.range(10).repartition(3), lambda k, rows, to=str(folder): open(f"{to}/part{k}", "w").write(json.dumps([r.id for r in rows])))
    assert sorted(sum((json.loads((folder / f"part{k}").read_text()) for k in range(3)), [])) == list(range(10))
    assert [r.id for r in result(spark.range(5))] == list(range(5))
    with pytest.raises(ValueError):
        files.read(spark, "nowhere")


def test_generators(spark):
    a, b = generators.random_events(spark, 10_000, ("A", "B", "C", "D"), seed=3), generators.random_events(spark, 10_000, ("A", "B", "C", "D"), seed=3, partitions=7)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))
    low, high, mean = a.agg(F.min("A"), F.max("A"), F.avg("A")).first()
    assert (low, high) == (0, 99) and 48 < mean < 51
    assert generators.random_phrases(spark, 500).select("phrase").distinct().count() <= 100
    assert generators.random_words(spark, 2000, distinct=50).select("word").distinct().count() == 50
    assert generators.constant(spark, 10).agg(F.sum("v")).first()[0] == 1_000_000
    assert generators.random_vectors(spark, 5, 3).count() == 5
    assert files.read(spark, "row", values=(1, "x")).first().asDict() == {"c0": 1, "c1": "x"}


class Doubler(Action):
    parameters = {"times": (int, 2, True), "label": (str, None, False)}
    schema = "v long, label string"

    def start(self):
        self.seen = 0

    def process(self, row):
        self.seen += 1
        for _ in range(self.times):
            yield row[0], self.label

    def stop(self):
        yield self.seen, "end"


def test_actions_and_jobs(spark):
    rows = apply(spark.range(10, numPartitions=2), lambda: Doubler(label="x")).collect()
    assert len(rows) == 22 and sum(r.v for r in rows if r.label == "end") == 10
    for bad in ({"times": "2"}, {"other": 1}):
        with pytest.raises(ValueError):
            Doubler(**bad)
    order = []
    job = Job({"k": "v"}).step(lambda j: order.append("second"), waits_for=("first",)).step(lambda j: order.append(j.properties["k"]), notifies="first")
    job.run()
    assert order == ["v", "second"]
    with pytest.raises(ValueError):
        Job().step(print, waits_for=("never",)).run()
    with pytest.raises(ZeroDivisionError):
        Job().step(lambda j: 1 / 0, notifies="a").step(lambda j: order.append("no"), waits_for=("a",)).run()
    assert "no" not in order


class Labeller(Action):
    schema = "v long, label string"

    def process(self, row):
        self.context.put("most", max(row[0], self.context.get("most", 0)))
        yield row[0], self.context.properties["prefix"] + self.context.get("names")[row[0] % 2]


def test_actions_see_their_job(spark):
    job, df = Job({"prefix": "n-"}), spark.range(10, numPartitions=2)
    job.step(lambda j: j.put("names", ["even", "odd"]), notifies="named")
    job.step(lambda j: [r.label for r in apply(df, Labeller, job=j).orderBy("v").collect()], waits_for=("named",), notifies="labels")
    job.step(lambda j: j.put("most", gather(df, Labeller, "most", "none", job=j)), waits_for=("named",), notifies="most")
    assert job.run()["labels"] == ["n-even", "n-odd"] * 5
    assert job.get("most") == {"most": [4, 9], "none": []} and job.get("nothing") is None
    assert gather(df.where("id < 0"), Labeller, "most") == {"most": []}


def test_k_means(spark):
    points = spark.createDataFrame([([0.0, 0.0],), ([0.0, 1.0],), ([10.0, 10.0],), ([10.0, 11.0],)], "vector array<double>")
    out, centres, rounds = apps.k_means(points, [[0.0, 0.0], [9.0, 9.0], [500.0, 500.0]], 0.0)
    assert centres == [[0.0, 0.5], [10.0, 10.5]] and rounds >= 2 and {tuple(r.centre) for r in out.collect()} == {(0.0, 0.5), (10.0, 10.5)}


def test_paths(spark):
    df = generators.random_events(spark, 1000)
    left, right = Path(df).filter(Constraint("A", Op.GT, 50), Constraint("B", Op.GT, 0), Constraint("C", Op.LT, 100)).map("A", "B").split()
    assert set(left.df.columns) == {"seq", "A", "B"} and left.union(right).df.count() == 2 * left.df.count()
    assert left.aggregate("A", "MAX", 10).df.count() == left.df.count()
    assert left.sort("A", 20).df.count() == left.df.count()


def run_stream(spark, df, name, mode="append"):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination(300)
    return spark.table(name)


@pytest.fixture(scope="module")
def arriving(spark, tmp_path_factory):
    """200 rows in two files, read as a stream of two batches in order of arrival."""
    d = tmp_path_factory.mktemp("stream")
    rows = generators.random_events(spark, 200, ("A", "B"), 0, 10).withColumn("v", F.col("A").cast("long")).withColumn("ts", F.timestamp_seconds("seq"))
    for k in range(2):
        rows.where(f"seq div 100 = {k}").coalesce(1).write.mode("append").parquet(f"{d}/{k}")
    batch = spark.read.schema(rows.schema).parquet(f"{d}/0", f"{d}/1")
    return batch, lambda: spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(d))


def rows_of(df):
    return sorted(tuple(r) for r in df.collect())


def test_streams_equal_batches(spark, arriving):
    batch, stream = arriving
    for kw in (dict(function="SUM", size=7, advance=3), dict(function="AVG", size=5, advance=2, group="B", evict="newest")):
        want = windows.count_window(batch, "seq", "v", **kw)
        assert rows_of(run_stream(spark, stateful.stream_count_window(stream(), "seq", "v", **kw).select(want.columns), "w")) == rows_of(want)
    tagged = lambda df: df.select("seq", F.col("v").alias("key"), (F.col("B") % 2).alias("side"))
    sides = [batch.where(f"B % 2 = {k}").select("seq", "v") for k in (0, 1)]
    want = joins.window_join(*sides, "v", 6).select("seq_l", "seq_h")
    assert rows_of(run_stream(spark, stateful.stream_window_join(tagged(stream()), 6), "j")) == rows_of(want)
    want = ordering.slack_sort(batch, "seq", "v", 5, flush=False).select("seq", "out")
    assert rows_of(run_stream(spark, Path(stream()).sort("v", 5).df.select("seq", "out"), "s")) == rows_of(want)
    want = rolling.running_counts(batch.withColumn("word", F.col("v").cast("string")), "word", "seq").select("seq", "word", "n")
    assert rows_of(run_stream(spark, stateful.stream_running_counts(stream().withColumn("word", F.col("v").cast("string"))), "r")) == rows_of(want)


@pytest.mark.parametrize("by_window, size", [(True, 6), (False, 3)])
def test_joins_on_streams(spark, arriving, by_window, size):
    """A path that splits and joins again gives on a stream what it gives on a batch, with all columns."""
    batch, stream = arriving

    def joined(df):
        odd = F.when(F.col("seq") % 7 > 0, F.col("seq") % 7 + F.col("seq").cast("long") * 0)
        path = Path(df.select("seq", "v", "B", "ts").withColumn("k", F.expr("seq div 10 + v % 4") if not by_window else odd))
        low, high = path.split()
        low = low.filter(Constraint("B", Op.GT, 4)).map("k", "v", "ts")
        return low.join(high.then(lambda d: d.where("B <= 4").select("seq", "k", F.when(F.col("v") > 3, F.col("v")).alias("w"))), "k", size, by_window).df

    want = joined(batch)
    got = joined(stream())
    assert got.columns == want.columns and dict(got.dtypes) == dict(want.dtypes)
    rows = rows_of(want.select([F.col(c).cast("string") for c in want.columns]).na.fill("-"))
    assert len(rows) > 20
    assert rows_of(run_stream(spark, got, f"path_join_{size}").select([F.col(c).cast("string") for c in want.columns]).na.fill("-")) == rows


def test_counts_at_each_tuple(spark, arriving):
    few = spark.createDataFrame(list(enumerate("abac")), "seq long, word string")
    got = {}
    for r in rolling.tuple_counts(few, "word", "seq", 3).collect():
        got.setdefault(r.slot, {})[r.word] = r.n
    assert got == {1: {"a": 1}, 2: {"a": 1, "b": 1}, 3: {"a": 2, "b": 1}, 4: {"a": 1, "b": 1, "c": 1}}
    batch, stream = arriving
    words = lambda df: df.select("seq", F.col("B").cast("string").alias("word"))
    want = rolling.tuple_counts(words(batch), "word", "seq", 4)
    assert rows_of(run_stream(spark, stateful.stream_tuple_counts(words(stream()), 4), "tuples").select("word", "slot", "n")) == rows_of(want.select("word", "slot", "n"))


def test_streaming_programs(spark, arriving):
    batch, stream = arriving
    phrases = lambda df: df.select(F.concat_ws(" ", "A", "B").alias("phrase"))
    assert rows_of(run_stream(spark, apps.streaming_word_count(phrases(stream())), "wc", "complete")) == rows_of(apps.streaming_word_count(phrases(batch)))
    words = lambda df: df.select(F.col("v").cast("string").alias("word"), F.col("ts").alias("timestamp"))
    assert rows_of(run_stream(spark, apps.trending_topics(words(stream())), "tt", "complete")) == rows_of(rolling.rolling_counts(words(batch), "word", "timestamp"))
    assert apps.trending_topics(words(batch), 3).count() > 0
    meter = Throughput(every=50)
    stream().writeStream.foreachBatch(meter).trigger(availableNow=True).start().awaitTermination(120)
    assert meter.rows == 200 and [n for _, n, _ in meter.lines] == [100, 200]


def test_network_source(spark):
    server = socket.create_server(("127.0.0.1", 0))

    def serve():
        conn, _ = server.accept()
        with conn:
            for i in range(20):
                conn.sendall((json.dumps({"A": i, "B": 2, "C": 3}) + "\n").encode())
            stop.wait(60)

    stop = threading.Event()
    threading.Thread(target=serve, daemon=True).start()
    q = generators.network(spark, "127.0.0.1", server.getsockname()[1]).writeStream.format("memory").queryName("net").start()
    try:
        for _ in range(60):
            q.processAllAvailable()
            if spark.table("net").count() == 20:
                break
            stop.wait(0.5)
        assert sorted(r.A for r in spark.table("net").collect()) == list(range(20))
    finally:
        stop.set()
        q.stop()
        server.close()
