"""The catalogue of queries: each operator over the driver's tables, with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.predicates import Constraint, Op, keep
from .functions.scalars import distance, field_hash, round2, tokens, words
from .operators import joins, ordering, relational, rolling, windows
from .plans import apps
from .plans.actions import Action, Job, apply
from .plans.pipeline import Path
from .sinks.files import write_lines
from .sinks.streams import finished, shared_folder
from .sources.files import Buckets, read, read_table, read_with
from .streaming import stateful

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def table(name: str):
    return lambda spark, sf: read_table(spark, sf, name)


lineitem, orders, customer, part, events, documents, nation, embeddings = map(table, ("lineitem", "orders", "customer", "part", "events", "documents", "nation", "embeddings"))
MEASURE = "CAST(floor(value) AS BIGINT)"


def stream(spark: SparkSession, sf: str, kind: str | None = None) -> DataFrame:
    """Events in order of arrival, with a whole-number measure."""
    df = events(spark, sf).select(F.col("event_id").alias("seq"), "user_id", "event_type", F.expr(MEASURE).alias("v"))
    return df.where(F.col("event_type") == kind) if kind else df


# Projections and predicates
@query("SELECT l_orderkey, l_extendedprice, l_partkey, l_orderkey AS l_orderkey_3 FROM lineitem")
def project_positional(spark, sf):
    df = lineitem(spark, sf)
    at = df.columns.index
    return relational.project(df, [at("l_orderkey"), at("l_extendedprice"), at("l_partkey"), at("l_orderkey")])


@query("SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders")
def project_by_name(spark, sf):
    return relational.project_by_name(orders(spark, sf), "o_totalprice", "o_orderkey", "o_orderstatus")


def _filters():
    cases = {
        "filter_num_eq": (part, Constraint("p_size", Op.EQ, 10), "part", "p_size = 10"),
        "filter_num_gt": (part, Constraint("p_size", Op.GT, 40), "part", "p_size > 40"),
        "filter_num_lt": (part, Constraint("p_size", Op.LT, 5), "part", "p_size < 5"),
        "filter_num_df": (part, Constraint("p_size", Op.DF, 10), "part", "p_size <> 10"),
        "filter_str_eq": (customer, Constraint("c_mktsegment", Op.EQ, "BUILDING"), "customer", "c_mktsegment = 'BUILDING'"),
        "filter_str_df": (customer, Constraint("c_mktsegment", Op.DF, "BUILDING"), "customer", "c_mktsegment <> 'BUILDING'"),
        "filter_str_prefix": (part, Constraint("p_type", Op.PF, "S"), "part", "starts_with(p_type, 'S')"),
        "filter_str_contains": (part, Constraint("p_name", Op.IN, "e"), "part", "contains(p_name, 'e')"),
        "filter_missing_attribute": (part, Constraint("nowhere", Op.GT, 0), "part", "false"),
        "filter_wrong_type": (part, Constraint("p_name", Op.GT, 0), "part", "false"),
    }
    for name, (source, c, where, cond) in cases.items():
        query(f"SELECT * FROM {where} WHERE {cond}", name)(lambda spark, sf, source=source, c=c: keep(source(spark, sf), c))


_filters()


@query("SELECT l_orderkey, l_linenumber, l_returnflag FROM lineitem WHERE l_linenumber > 1 AND l_linenumber < 6 AND l_returnflag <> 'N'")
def filter_conjunction(spark, sf):
    df = keep(lineitem(spark, sf), Constraint("l_linenumber", Op.GT, 1), Constraint("l_linenumber", Op.LT, 6), Constraint("l_returnflag", Op.DF, "N"))
    return relational.project_by_name(df, "l_orderkey", "l_linenumber", "l_returnflag")


@query(f"SELECT event_id AS seq, user_id, {MEASURE} AS v FROM events WHERE floor(value) > 0")
def filter_chain(spark, sf):
    path = Path(stream(spark, sf))
    for _ in range(20):
        path = path.filter(Constraint("v", Op.GT, 0))
    return path.map("user_id", "v").df


@query("SELECT * FROM orders WHERE false")
def block_flow(spark, sf):
    return relational.block(orders(spark, sf))


@query()
def sample_rows(spark, sf):
    return relational.sample(lineitem(spark, sf), 10, seed=1)


@query("SELECT * FROM orders WHERE CAST('0x' || substr(md5(CAST(o_orderkey AS VARCHAR)), 1, 15) AS BIGINT) % 100 < 10")
def sample_by_key(spark, sf):
    return relational.sample_by_key(orders(spark, sf), 10, "o_orderkey")


# Aggregates and duplicates
@query("SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, count(*) AS n FROM lineitem WHERE l_quantity < 24 GROUP BY ALL")
def group_sum(spark, sf):
    df = lineitem(spark, sf).where("l_quantity < 24")
    return relational.fold(df, ["l_returnflag", "l_linestatus"], sum_qty=F.sum("l_quantity"), n=F.count("*"))


@query("SELECT l_suppkey, min(l_linenumber) AS least, max(l_linenumber) AS most, CAST(count(*) AS BIGINT) AS n FROM lineitem GROUP BY ALL")
def group_min_max_count(spark, sf):
    return relational.fold(lineitem(spark, sf), ["l_suppkey"], least=F.min("l_linenumber"), most=F.max("l_linenumber"), n=F.count("*"))


@query("SELECT l_partkey, CAST(sum(l_suppkey) // count(l_suppkey) AS BIGINT) AS average FROM lineitem GROUP BY ALL")
def group_avg_trunc(spark, sf):
    return relational.fold(lineitem(spark, sf), ["l_partkey"], average=relational.average("l_suppkey"))


@query("SELECT o_custkey, string_agg(CAST(o_orderkey AS VARCHAR), ',' ORDER BY o_orderkey) AS bag FROM orders GROUP BY ALL")
def group_bag(spark, sf):
    bags = relational.group_bag(relational.project_by_name(orders(spark, sf), "o_custkey", "o_orderkey"), "o_custkey")
    return bags.select("o_custkey", F.array_join(F.transform(F.sort_array(F.col("bag.o_orderkey")), lambda x: x.cast("string")), ",").alias("bag"))


@query("SELECT DISTINCT l_partkey, l_suppkey FROM lineitem")
def distinct_rows(spark, sf):
    return relational.distinct(relational.project_by_name(lineitem(spark, sf), "l_partkey", "l_suppkey"))


@query("SELECT event_id, user_id, event_type FROM (SELECT *, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS b, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS bi FROM events) WHERE bi IS NULL OR b IS DISTINCT FROM event_type")
def dedup_consecutive(spark, sf):
    return relational.drop_consecutive(events(spark, sf).select("event_id", "user_id", "event_type"), "event_id", ["event_type"], ["user_id"])


# Order
@query("SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) AS place FROM orders")
def global_sort_rank(spark, sf):
    df = orders(spark, sf).select("o_orderkey", "o_totalprice").withColumn("__key", F.struct("o_totalprice", "o_orderkey"))
    ordered = ordering.global_sort(df.drop("__key"), "o_totalprice", "o_orderkey").withColumn("__pos", F.monotonically_increasing_id())
    at = F.expr("shiftright(__pos, 33)")
    sizes = ordered.groupBy(at.alias("p")).agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    starts = sizes.select("p", F.coalesce(F.sum("n").over(Window.orderBy("p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return ordered.withColumn("p", at).join(F.broadcast(starts), "p").select("o_orderkey", "o_totalprice", (F.col("__pos") - F.shiftleft(F.col("p"), 33) + F.col("start") + 1).alias("place"))


@query("SELECT o_custkey, o_orderdate, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS r FROM orders) WHERE r = 1")
def partition_sort_first(spark, sf):
    return ordering.first_of_each(orders(spark, sf).select("o_custkey", "o_orderdate", "o_orderkey"), ["o_custkey"], "o_orderdate", "o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def top_k(spark, sf):
    return ordering.top_k(orders(spark, sf).select("o_orderkey", "o_totalprice"), 10, F.col("o_totalprice").desc(), "o_orderkey")


def _slack_sql(slack: int, flush: bool) -> str:
    """A row goes at the arrival after the first place by which slack others, from before or after it, go later."""
    held = "" if flush else " WHERE goes <= total"
    return f"""WITH n AS (SELECT event_id AS seq, user_id, event_type, {MEASURE} AS v, row_number() OVER (ORDER BY event_id) AS i FROM events WHERE value IS NOT NULL),
    k AS (SELECT *, row_number() OVER (ORDER BY v, i) AS place, count(*) OVER () AS total FROM n),
    t AS (SELECT r.i, min(w.i, {slack}) AS first FROM k AS r JOIN k AS w ON w.place > r.place GROUP BY r.i),
    g AS (SELECT k.*, CASE WHEN len(first) >= {slack} THEN greatest(k.i, first[{slack}]) + 1 END AS goes FROM k LEFT JOIN t ON t.i = k.i)
    SELECT seq, user_id, event_type, v, CASE WHEN goes <= total THEN goes - {slack + 1}
        ELSE greatest(total - {slack + 1}, 0) + row_number() OVER (PARTITION BY coalesce(goes <= total, false) ORDER BY v, i) END AS out FROM g{held}"""


@query(_slack_sql(100, True))
def slack_sort(spark, sf):
    return Path(stream(spark, sf)).sort("v", 100).df


# Graph shapes
@query("SELECT o_orderkey FROM orders WHERE o_orderstatus = 'O' UNION ALL SELECT o_orderkey FROM orders WHERE o_totalprice > 100000")
def union_branch(spark, sf):
    df = orders(spark, sf)
    return relational.branch(df.where("o_orderstatus = 'O'").select("o_orderkey"), df.where("o_totalprice > 100000").select("o_orderkey"))


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber > 2 UNION ALL SELECT l_orderkey, l_linenumber FROM lineitem")
def split_rejoin_union(spark, sf):
    return relational.tee(lineitem(spark, sf).select("l_orderkey", "l_linenumber"), lambda d: d, lambda d: d.where("l_linenumber > 2"))


@query("SELECT 0 AS channel, n_nationkey AS k, n_name AS name, NULL AS r_regionkey FROM nation UNION ALL SELECT 1, r_regionkey, r_name, r_regionkey FROM region")
def merge_channels(spark, sf):
    a = nation(spark, sf).select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    b = read_table(spark, sf, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"), "r_regionkey")
    return relational.merge_channels(a, b)


@query("SELECT c_custkey, c_name FROM customer WHERE c_nationkey < 5 UNION ALL SELECT c_custkey, c_name FROM customer WHERE c_nationkey > 20")
def named_intermediates(spark, sf):
    buckets, df = Buckets(spark), customer(spark, sf)
    buckets.write(df.where("c_nationkey < 5").select("c_custkey", "c_name"), "bucket_low")
    buckets.write(df.where("c_nationkey > 20").select("c_custkey", "c_name"), "bucket_high")
    return buckets.read("bucket_low", "bucket_high")


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY ALL")
def exchange_by_partition(spark, sf):
    dealt = relational.exchange_by(orders(spark, sf), F.pmod(F.col("o_custkey"), F.lit(16)), 16)
    return dealt.groupBy("o_custkey").agg(F.count("*").alias("n"))


@query("SELECT n_nationkey, n_name FROM nation")
def gather(spark, sf):
    return relational.gather(nation(spark, sf).select("n_nationkey", "n_name"), "n_nationkey")


# Count windows
def _window_sql(function: str, size: int, advance: int, group: str | None, newest: bool = False) -> str:
    """Each row's window by its bounds: places before+1 to i of its group."""
    by = f"PARTITION BY {group} " if group else ""
    agg = {"SUM": "sum(w.v)", "MIN": "min(w.v)", "MAX": "max(w.v)", "COUNT": "count(*)", "AVG": "sum(w.v) // count(w.v)"}[function]
    a = min(advance, size)
    gone = f"CASE WHEN i - 1 >= {size} THEN {a} * ((i - 1 - {size}) // {a} + 1) ELSE 0 END"
    inside = f"(r.i <= {size} OR w.i <= {size - a} OR w.i > r.i - ((r.i - {size} - 1) % {a} + 1))" if newest and a < size else "w.i > r.gone"
    same = f"r.{group} = w.{group} AND " if group else ""
    return f"""WITH n AS (SELECT event_id AS seq, user_id, event_type, {MEASURE} AS v, row_number() OVER ({by}ORDER BY event_id) AS i FROM events),
        r AS (SELECT *, {gone} AS gone FROM n)
        SELECT r.seq, r.v, CAST({agg} AS BIGINT) AS agg{f", r.{group}" if group else ""} FROM r JOIN r AS w ON {same}w.i <= r.i AND w.i > r.i - {10**9 if newest else size} AND {inside} GROUP BY ALL"""


def _window_frame_sql(function: str, size: int, group: str | None) -> str:
    by = f"PARTITION BY {group} " if group else ""
    agg = {"SUM": "sum(v) OVER o", "MIN": "min(v) OVER o", "MAX": "max(v) OVER o", "COUNT": "count(*) OVER o", "AVG": "sum(v) OVER o // count(v) OVER o"}[function]
    return f"WITH n AS (SELECT event_id AS seq, user_id, {MEASURE} AS v FROM events) SELECT seq, v, CAST({agg} AS BIGINT) AS agg{f', {group}' if group else ''} FROM n WINDOW o AS ({by}ORDER BY seq ROWS BETWEEN {size - 1} PRECEDING AND CURRENT ROW)"


def _block_sql(function: str, size: int, group: str | None) -> str:
    by = f"PARTITION BY {group} " if group else ""
    agg = {"SUM": "sum(v) OVER o", "MIN": "min(v) OVER o", "MAX": "max(v) OVER o", "COUNT": "count(*) OVER o", "AVG": "sum(v) OVER o // count(v) OVER o"}[function]
    g = f"{group}, " if group else ""
    return f"WITH n AS (SELECT event_id AS seq, user_id, {MEASURE} AS v, (row_number() OVER ({by}ORDER BY event_id) - 1) // {size} AS b FROM events) SELECT seq, v, CAST({agg} AS BIGINT) AS agg{f', {group}' if group else ''} FROM n WINDOW o AS (PARTITION BY {g}b ORDER BY seq)"


def _count_windows():
    for f in windows.FUNCTIONS:
        query(_window_frame_sql(f, 100, None), f"window_slide_{f.lower()}")(lambda spark, sf, f=f: Path(stream(spark, sf)).aggregate("v", f, 100, 1).df)
        query(_window_frame_sql(f, 10, "user_id"), f"window_slide_grouped_{f.lower()}")(lambda spark, sf, f=f: Path(stream(spark, sf)).aggregate("v", f, 10, 1, "user_id").df)
        query(_block_sql(f, 10, "user_id"), f"window_tumble_{f.lower()}")(lambda spark, sf, f=f: Path(stream(spark, sf)).aggregate("v", f, 10, 10, "user_id").df)
        query(_window_sql(f, 8, 3, "user_id"), f"window_hop_{f.lower()}")(lambda spark, sf, f=f: Path(stream(spark, sf)).aggregate("v", f, 8, 3, "user_id").df)
    query(_block_sql("SUM", 100, None), "window_tumble_ungrouped")(lambda spark, sf: Path(stream(spark, sf)).aggregate("v", "SUM", 100, 250).df)
    query(_window_sql("SUM", 60, 20, None), "window_hop_ungrouped")(lambda spark, sf: Path(stream(spark, sf)).aggregate("v", "SUM", 60, 20).df)
    query(_window_sql("SUM", 8, 3, "user_id", newest=True), "window_hop_newest")(lambda spark, sf: Path(stream(spark, sf)).aggregate("v", "SUM", 8, 3, "user_id", evict="newest").df)


_count_windows()


# Stream joins
_SIDES = f"""WITH x AS (SELECT event_id AS seq, user_id, {MEASURE} AS a FROM events WHERE event_type = 'click'),
    y AS (SELECT event_id AS seq, user_id, {MEASURE} AS b FROM events WHERE event_type = 'view')"""
_WINDOW_JOIN = """, u AS (SELECT seq, user_id, 0 AS side FROM x UNION ALL SELECT seq, user_id, 1 FROM y),
    c AS (SELECT *, sum(1 - side) OVER (ORDER BY seq) AS nx, sum(side) OVER (ORDER BY seq) AS ny FROM u),
    p AS (SELECT l.seq AS seq_l, h.seq AS seq_h, l.user_id FROM c AS l JOIN c AS h ON l.side = 0 AND h.side = 1 AND l.user_id = h.user_id
        AND ((l.seq < h.seq AND h.nx - l.nx < {size}) OR (h.seq < l.seq AND l.ny - h.ny < {size})))"""


def _sides(spark, sf):
    one = stream(spark, sf, "click").select("seq", "user_id", F.col("v").alias("a"))
    two = stream(spark, sf, "view").select("seq", "user_id", F.col("v").alias("b"))
    return one, two


@query(_SIDES + _WINDOW_JOIN.format(size=50) + " SELECT p.seq_l, p.seq_h, p.user_id, y.b, x.a FROM p JOIN x ON x.seq = seq_l JOIN y ON y.seq = seq_h")
def window_join_count(spark, sf):
    return joins.window_join(*_sides(spark, sf), "user_id", 50)


@query(_SIDES + _WINDOW_JOIN.format(size=200).replace("FROM x UNION", "FROM x WHERE a > 10 UNION") + " SELECT greatest(seq_l, seq_h) AS seq, p.user_id, y.b, x.a FROM p JOIN x ON x.seq = seq_l JOIN y ON y.seq = seq_h")
def split_join(spark, sf):
    one, two = _sides(spark, sf)
    left, _ = Path(one).split()
    return left.filter(Constraint("a", Op.GT, 10)).join(Path(two), "user_id", 200).df


@query(
    _SIDES
    + _WINDOW_JOIN.format(size=100)
    + """, ab AS (SELECT greatest(seq_l, seq_h) AS seq, p.user_id FROM p),
    s AS (SELECT seq, user_id, max(1) AS one FROM ab GROUP BY ALL), z AS (SELECT event_id AS seq, user_id FROM events WHERE event_type = 'purchase'),
    u2 AS (SELECT seq, user_id, 0 AS side FROM s UNION ALL SELECT seq, user_id, 1 FROM z),
    c2 AS (SELECT *, sum(1 - side) OVER (ORDER BY seq) AS nx, sum(side) OVER (ORDER BY seq) AS ny FROM u2)
    SELECT greatest(l.seq, h.seq) AS seq, l.user_id FROM c2 AS l JOIN c2 AS h ON l.side = 0 AND h.side = 1 AND l.user_id = h.user_id
        AND ((l.seq < h.seq AND h.nx - l.nx < 100) OR (h.seq < l.seq AND l.ny - h.ny < 100))"""
)
def multi_split_join(spark, sf):
    one, two = _sides(spark, sf)
    first = Path(one).join(Path(two), "user_id", 100).then(lambda d: d.select("seq", "user_id").distinct())
    return first.join(Path(stream(spark, sf, "purchase").select("seq", "user_id")), "user_id", 100).df


@query(
    f"""WITH x AS (SELECT event_id AS seq, event_id // 20 AS k, {MEASURE} AS a FROM events WHERE event_type = 'click'),
    y AS (SELECT event_id AS seq, event_id // 20 + CAST(floor(value) AS BIGINT) % 3 AS k, {MEASURE} AS b FROM events WHERE event_type = 'view')
    SELECT x.seq AS seq_l, y.seq AS seq_h, x.k, b, a FROM x JOIN y USING (k) WHERE
      (x.seq < y.seq AND NOT EXISTS (FROM y AS z WHERE z.seq > x.seq AND z.seq < y.seq AND z.k >= x.k + 2)) OR
      (y.seq < x.seq AND NOT EXISTS (FROM x AS z WHERE z.seq > y.seq AND z.seq < x.seq AND z.k >= y.k + 2))"""
)
def band_join(spark, sf):
    one = stream(spark, sf, "click").select("seq", F.expr("seq div 20").alias("k"), F.col("v").alias("a"))
    two = stream(spark, sf, "view").select("seq", F.expr("seq div 20 + v % 3").alias("k"), F.col("v").alias("b"))
    return joins.band_join(one, two, "k", 2)


@query("SELECT c_custkey, o_orderkey FROM customer JOIN orders ON c_custkey = o_custkey")
def cogroup_inner(spark, sf):
    return _cogroup(spark, sf, "inner")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON c_custkey = o_custkey")
def cogroup_outer(spark, sf):
    return _cogroup(spark, sf, "left")


@query("SELECT c_custkey FROM customer SEMI JOIN orders ON c_custkey = o_custkey")
def cogroup_semi(spark, sf):
    return _cogroup(spark, sf, "left_semi")


@query("SELECT c_custkey FROM customer ANTI JOIN orders ON c_custkey = o_custkey")
def cogroup_anti(spark, sf):
    return _cogroup(spark, sf, "left_anti")


def _cogroup(spark, sf, how):
    right = orders(spark, sf).select(F.col("o_custkey").alias("c_custkey"), "o_orderkey")
    return joins.cogroup_join(customer(spark, sf).select("c_custkey"), right, "c_custkey", how)


@query("SELECT c_custkey, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey")
def lookup_join(spark, sf):
    return customer(spark, sf).join(F.broadcast(nation(spark, sf)), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


# Scalars
@query("SELECT a.vec_id, round(sqrt(list_sum(list_transform(range(1, len(a.embedding) + 1), lambda i: (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE) * (a.embedding[i]::DOUBLE - b.embedding[i]::DOUBLE)))), 6) AS far FROM embeddings a JOIN embeddings b ON b.vec_id = 0")
def euclidean_distance(spark, sf):
    df = embeddings(spark, sf).select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    origin = df.where("vec_id = 0").select(F.col("e").alias("o"))
    return df.join(F.broadcast(origin), F.lit(True)).select("vec_id", F.round(distance("e", "o"), 6).alias("far"))


@query("SELECT o_orderkey, floor(o_totalprice / 7 * 100 + 0.5) / 100 AS share FROM orders")
def round_half_up(spark, sf):
    return orders(spark, sf).select("o_orderkey", round2(F.col("o_totalprice") / 7).alias("share"))


@query("SELECT o_orderkey, CAST('0x' || substr(md5(concat(o_orderkey, '|', o_orderstatus)), 1, 15) AS BIGINT) AS h FROM orders")
def hash_of_fields(spark, sf):
    return orders(spark, sf).select("o_orderkey", field_hash("o_orderkey", "o_orderstatus").alias("h"))


# Programs
@query(r"SELECT word, count(*) AS n FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS word FROM documents) WHERE word <> '' GROUP BY ALL")
def word_count(spark, sf):
    return apps.word_count(documents(spark, sf), "text")


@query("SELECT doc_id, len(list_filter(regexp_split_to_array(text, '[ \t\n\r\f]+'), lambda w: w <> '')) AS n FROM documents")
def token_count(spark, sf):
    return documents(spark, sf).select("doc_id", F.size(tokens("text")).cast("long").alias("n"))


@query("SELECT DISTINCT unnest(string_split(text, chr(10))) AS line FROM documents")
def sort_lines(spark, sf):
    return apps.sorted_distinct(documents(spark, sf).select(F.explode(F.split("text", "\n")).alias("line")))


@query("SELECT event_id AS seq, event_type AS word, count(*) OVER (PARTITION BY event_type ORDER BY event_id) AS n FROM events")
def running_word_counts(spark, sf):
    return rolling.running_counts(events(spark, sf).withColumnRenamed("event_id", "seq"), "event_type", "seq")


_SLIDES = """WITH e AS (SELECT event_type AS word, CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS h FROM events),
    s AS (SELECT word, h + unnest(range(1, 11)) AS stop, 1 AS one FROM e), c AS (SELECT word, stop, count(*) AS n FROM s GROUP BY ALL)"""


@query(_SLIDES + " SELECT word, stop, n FROM c")
def rolling_word_counts(spark, sf):
    out = rolling.rolling_counts(events(spark, sf), "event_type", "ts", "10 hours", "1 hour")
    return out.select("word", F.expr("unix_seconds(`end`) div 3600").alias("stop"), "n")


@query(_SLIDES + ", r AS (SELECT *, row_number() OVER (PARTITION BY stop ORDER BY n DESC, word) AS k FROM c) SELECT stop, string_agg(word, ',' ORDER BY k) AS words, string_agg(CAST(n AS VARCHAR), ',' ORDER BY k) AS counts FROM r WHERE k <= 3 GROUP BY stop")
def trending_topics(spark, sf):
    out = rolling.trending(events(spark, sf), "event_type", "ts", 3, "10 hours", "1 hour")
    text = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ",")
    return out.select(F.expr("unix_seconds(`end`) div 3600").alias("stop"), text("words").alias("words"), text("counts").alias("counts"))


@query("""WITH e AS (SELECT event_type AS word, event_id // 500 AS t FROM events), c AS (SELECT word, t, count(*) AS n FROM e GROUP BY ALL), m AS (SELECT max(t) AS last FROM c)
    SELECT word, slot, CAST(sum(CASE WHEN slot - t < 5 THEN n ELSE 0 END) AS BIGINT) AS n FROM (SELECT word, n, t, unnest(range(t, least(t + 5, (SELECT last FROM m)) + 1)) AS slot FROM c) GROUP BY ALL""")
def slot_counts(spark, sf):
    return rolling.slot_counts(events(spark, sf).withColumn("slot", F.expr("event_id div 500")), "event_type", "slot", 5)


@query()
def k_means(spark, sf):
    points = embeddings(spark, sf).select("vec_id", F.transform(F.col("embedding").cast("array<double>"), round2).alias("vector"))
    first = [list(r.vector) for r in points.orderBy("vec_id").limit(5).collect()]
    return apps.k_means(points, first, 0.0)[0].select("vec_id", "index")


_TUPLES = """WITH e AS (SELECT event_type AS word, row_number() OVER (ORDER BY event_id) AS t FROM events), m AS (SELECT max(t) AS last FROM e)
    SELECT word, slot, CAST(sum(CASE WHEN slot - t < 5 THEN 1 ELSE 0 END) AS BIGINT) AS n FROM (SELECT word, t, unnest(range(t, least(t + 5, (SELECT last FROM m)) + 1)) AS slot FROM e) GROUP BY ALL"""


@query(_TUPLES)
def tuple_counts(spark, sf):
    return rolling.tuple_counts(events(spark, sf), "event_type", "event_id", 5)


# Streams, run to the end of what has arrived
def arriving(spark: SparkSession, sf: str, kind: str | None = None) -> DataFrame:
    """stream(), read as a stream. A glob may name a file as well as a folder."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    df = spark.readStream.schema(schema).parquet(f"{sf}/event[s].parquet").select(F.col("event_id").alias("seq"), "user_id", "event_type", F.expr(MEASURE).alias("v"))
    return df.where(F.col("event_type") == kind) if kind else df


@query(_window_frame_sql("AVG", 10, "user_id"))
def stream_window_avg(spark, sf):
    return finished(Path(arriving(spark, sf)).aggregate("v", "AVG", 10, 1, "user_id").df)


@query(_window_sql("SUM", 8, 3, "user_id"))
def stream_window_hop_sum(spark, sf):
    return finished(Path(arriving(spark, sf)).aggregate("v", "SUM", 8, 3, "user_id").df)


@query(_slack_sql(100, False))
def stream_slack_sort(spark, sf):
    return finished(Path(arriving(spark, sf)).sort("v", 100).df)


@query(ORACLES["split_join"])
def stream_split_join(spark, sf):
    left, _ = Path(arriving(spark, sf, "click").select("seq", "user_id", F.col("v").alias("a"))).split()
    right = Path(arriving(spark, sf, "view").select("seq", "user_id", F.col("v").alias("b")))
    return finished(left.filter(Constraint("a", Op.GT, 10)).join(right, "user_id", 200).df)


@query(ORACLES["band_join"])
def stream_band_join(spark, sf):
    one = arriving(spark, sf, "click").select("seq", F.expr("seq div 20").alias("k"), F.col("v").alias("a"))
    two = arriving(spark, sf, "view").select("seq", F.expr("seq div 20 + v % 3").alias("k"), F.col("v").alias("b"))
    return finished(stateful.stream_join(one, two, "k", 2, by_window=False))


@query(ORACLES["running_word_counts"])
def stream_running_counts(spark, sf):
    return finished(stateful.stream_running_counts(arriving(spark, sf).withColumnRenamed("event_type", "word")))


@query(_TUPLES)
def stream_tuple_counts(spark, sf):
    return finished(stateful.stream_tuple_counts(arriving(spark, sf).withColumnRenamed("event_type", "word"), 5))


# Files
@query("SELECT concat_ws(' ', n_nationkey, n_name, n_regionkey) AS line FROM nation")
def write_then_read(spark, sf):
    path = shared_folder(spark, "lines")
    write_lines(nation(spark, sf).select("n_nationkey", "n_name", "n_regionkey"), path, gzip=True)
    return read(spark, "text", path=path)


@query("SELECT CAST(n_nationkey AS INT) AS k, upper(n_name) AS name FROM nation")
def custom_reader(spark, sf):
    path = shared_folder(spark, "records")
    write_lines(nation(spark, sf).select("n_nationkey", F.expr("concat('=', n_name)")), path)
    records = lambda content: ((int(k), v.upper()) for k, v in (r.split(" =") for r in content.decode().splitlines()))
    return read_with(spark, path, records, "k int, name string")


class _Repeated(Action):
    """Each row as often as its second field says, with the job's label."""

    def process(self, row):
        for i in range(row[1] % 3):
            yield row[0], i, self.context.properties["label"] + self.context.get("names")[i]


@query("SELECT n_nationkey, CAST(i AS INT) AS i, 'x-' || CASE i WHEN 0 THEN 'first' ELSE 'second' END AS label FROM (SELECT n_nationkey, unnest(range(n_regionkey % 3)) AS i FROM nation)")
def user_action(spark, sf):
    job = Job({"label": "x-"}).put("names", ["first", "second"])
    return apply(nation(spark, sf).select("n_nationkey", "n_regionkey"), _Repeated, f"n_nationkey {nation(spark, sf).schema['n_nationkey'].dataType.simpleString()}, i int, label string", job)


def flagship(spark: SparkSession, sf: str) -> DataFrame:
    """The first pipeline of all: scan, filter, project, group."""
    return QUERIES["group_sum"](spark, sf)
