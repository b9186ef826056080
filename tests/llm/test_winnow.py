import hashlib
import random
import time
from collections import Counter, defaultdict

import duckdb
from millrace.llm import winnow
from millrace.llm.queries import op9_lines
from pyspark.sql import functions as F

from .fixtures import documents, odd_ids


def brute(rows):
    """rows: (doc_id, text), distinct ids in order. What stays of each text: of any two places, the longest run of equal
    lines that they are in is deleted at the later one if it is a passage."""
    docs = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        docs.append((doc_id, text, lines, [i for i, x in enumerate(lines) if x.strip(" \t\r")], set()))
    at = defaultdict(list)
    for d, (_, _, lines, real, _) in enumerate(docs):
        for k, i in enumerate(real):
            at[lines[i]].append((d, k))
    content = [[lines[i] for i in real] for _, _, lines, real, _ in docs]
    for places in at.values():
        for x, (d, k) in enumerate(places):
            for e, j in places[x + 1 :]:
                a, b = content[d], content[e]
                if k and j and a[k - 1] == b[j - 1]:
                    continue  # not where the run begins
                n = 0
                while k + n < len(a) and j + n < len(b) and a[k + n] == b[j + n]:
                    n += 1
                words = sum(len(b[j + m].split()) for m in range(n))
                if n >= winnow.MIN_LINES or words >= winnow.MIN_WORDS:
                    real = docs[e][3]
                    docs[e][4].update(range(real[j], real[j + n - 1] + 1))
    return {i: None if text is None else "\n".join(x for k, x in enumerate(lines) if k not in gone) for i, text, lines, _, gone in docs}


PASSAGE = " ".join(f"w{i}" for i in range(60))


def W(n, seed):
    return " ".join(f"{seed}v{i}" for i in range(n))


CASES = [
    "a\nb\nc\nd", "x\na\nb\nc\ny", f"start\n{PASSAGE}\nend", f"{PASSAGE}", f"other\n\n{PASSAGE}\nlast", "b\nc\nd\ne", "q\n\na\nb\n \nc\n\nz", "a\nb", "s\ns\ns\ns\ns", "s\ns\ns", None, "", "\n\n\n", " \n  \n",
    "one two three four five six\n" * 3, PASSAGE + " more", "\n".join(f"line {i % 50}" for i in range(3000)),
    # indented code: blanks are no words
    " " * 60 + "x", "def f():\n" + " " * 60 + "x", "\t\t\treturn\n\r\ny", "z\n\t\t\treturn",
    # runs whose last or first lines are no passage by themselves
    W(50, 1) + "\n" + W(24, 2) + "\n" + W(24, 3), "before\n" + W(50, 1) + "\n" + W(24, 2) + "\n" + W(24, 3) + "\nafter",
    W(20, 4) + "\n" + W(40, 5) + "\n" + W(5, 6), "p\n" + W(20, 4) + "\n" + W(40, 5) + "\n" + W(5, 6) + "\nq",
    W(5, 7) + "\n" + W(20, 8) + "\n" + W(40, 9), W(5, 7) + "\n\n" + W(20, 8) + "\n" + W(40, 9) + "\nr",
]


def test_cases(spark):
    docs = spark.createDataFrame(list(enumerate(CASES)), "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("th", "n", "gone", "n_lines", "content")})
    got = winnow.without_repeats(docs).collect()
    assert {r.doc_id: r.text for r in got} == brute(list(enumerate(CASES)))
    assert {r.doc_id: r.n_lines for r in got} == {i: len(t.split("\n")) if t is not None else 0 for i, t in enumerate(CASES)}


def test_odd_tables(spark):
    docs = documents(spark)
    assert {r.doc_id: r.text for r in winnow.without_repeats(docs).collect()} == brute(sorted((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()))
    assert winnow.without_repeats(docs.limit(0)).collect() == []
    twice = odd_ids(spark).unionByName(odd_ids(spark))
    assert Counter((r.doc_id, r.text) for r in winnow.without_repeats(twice).collect()) == Counter((r.doc_id, r.text) for r in twice.collect())


def test_query_and_oracle(spark):
    sf = "/root/testdata/sf0.01"
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()]
    got = {r.doc_id: (r.n_lines, r.n_deleted, r.text_md5) for r in op9_lines(spark, sf).collect()}
    assert {i: m for i, (_, _, m) in got.items()} == {i: hashlib.md5(t.encode()).hexdigest() for i, t in brute(docs).items()}
    assert sum(n for _, n, _ in got.values()) > 0
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet'")
    assert {i: (n, d, m) for i, n, d, m in db.execute(winnow.ORACLE).fetchall()} == got


def test_plan_is_native(spark, sf):
    plan = winnow.without_repeats(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_random_runs(spark):
    rnd = random.Random(4)
    lines = [" ".join(f"x{rnd.randrange(9999)}" for _ in range(rnd.choice([1, 2, 10, 24, 30, 49, 50, 60]))) for _ in range(25)] + ["", "  ", "\t"]
    for size in (8, 25):
        docs = [(i, "\n".join(rnd.choice(lines[-size:] if rnd.random() < 0.5 else lines) for _ in range(rnd.randrange(12)))) for i in range(150)]
        got = winnow.without_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()
        assert {r.doc_id: r.text for r in got} == brute(docs)


def test_linear_in_a_texts_lines(spark):
    def took(n):
        own = [f"line {i} of {n}" for i in range(n // 2)]
        docs = spark.createDataFrame([(1, "\n".join(own + own))], "doc_id long, text string")
        t = time.time()
        (row,) = winnow.without_repeats(docs).collect()
        assert row.n_lines == n and row.n_deleted == n // 2 and row.text == "\n".join(own)
        return time.time() - t

    took(1_000)
    assert took(100_000) <= 15 * took(10_000)
