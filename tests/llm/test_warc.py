import base64
import hashlib

from millrace.llm import warc
from millrace.llm.common import work_dir
from millrace.llm.queries import op2_warc
from pyspark.sql import functions as F


def brute(rows):
    last = {}
    for i, _, html in rows:
        if i is not None:
            last[html or ""] = max(last.get(html or "", i), i)
    out = []
    for i, _, html in rows:
        data = (html or "").encode()
        revisit = (html or "") in last and last[html or ""] != i
        out.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", last[html or ""] if revisit else None))
    return sorted(out, key=str)


def test_small(spark):
    rows = [(i, f"http://h/{i}", h) for i, h in enumerate([None, "", "<p>a</p>", "<p>a</p>", "é\r\n\r\nContent-Length: 3", "x" * 500_000, None, "<p>a</p>"])]
    rows += [(2, "http://h/2", "<p>a</p>"), (7, None, "<p>a</p>"), (None, "u\r\nX: y", "<p>a</p>"), (None, None, "alone")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({c: F.lit(1) for c in ("sha", "n", "last", "refers_to")})
    assert sorted(map(tuple, warc.archived(spark, pages).collect()), key=str) == brute(rows)
    assert warc.archived(spark, pages.limit(0)).collect() == []


def test_query(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url", "html").collect()]
    rows += [(i + 100_000, u, h) for i, u, h in rows[::3]]
    path = work_dir(spark, "in")
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{path}/pages.parquet")
    assert sorted(map(tuple, op2_warc(spark, path).collect()), key=str) == brute(rows)


def test_dictionary_helps_and_is_embedded(spark, sf):
    import zstandard

    pages, path = spark.read.parquet(f"{sf}/pages.parquet"), work_dir(spark, "warc")
    [*archives] = warc.write_archives(pages.repartition(1), path).collect()
    plain = sum(len(zstandard.compress(r.html.encode(), 3)) for r in pages.collect())
    assert sum(a.n_bytes for a in archives) < plain + 112_640
    fs, _ = warc.file_system(path)
    with fs.open_input_stream(archives[0].archive) as f:
        assert f.read(4) == b"\x5d\x2a\x4d\x18"


def test_dictionary_from_long_records(spark):
    """Pages longer than a piece, and revisits, are what the dictionary is built from as well."""
    page = "".join(f"<p>{i * 7919 % 10_007} common words of every page</p>" for i in range(3000))
    marked = spark.createDataFrame([(i, f"http://x/{i}", f"{i} {page}", None if i % 2 else i + 1) for i in range(300)], "page_id long, url string, html string, refers_to long")
    made = warc.trained(marked)
    assert b"common words of every page" in made and b"WARC-Refers-To" in made and len(made) <= warc.DICT_BYTES
