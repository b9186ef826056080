"""Line dedup by winnowing over line hashes, in DataFrame functions alone.

Lines of nothing but white space take no part. A passage is a run of lines of at least MIN_WORDS words or MIN_LINES
lines, and a window is a least one: that which begins at a line, or ends at it. Each window selects the line of least
hash in it (the last of equals), so two equal passages select the same lines: these are the fingerprints, a row each,
with the windows that selected them, at most MIN_LINES to either side.

Fingerprints are joined with how often their hash occurs, and those that occur once are dropped. At the positions that
are left, a match is extended to the left and to the right over the windows around it: each is held against the first
place (by doc_id, then line) at which the same fingerprint stands in the same window. Where that is before, the window
is a later repeat, and as windows reach both ways from every line, those that are make up each repeated run to its
first and last line. Their lines are deleted; the first occurrence of all content stays.

Comparing each place with the first of its kind, and not with all others, keeps the work linear however often a
passage occurs; counts and first places are pre-aggregated, and looked_up() keeps a hot passage's rows where they are.
Within a text every step is linear in its lines, but for one sort where lines are taken out. Contents are compared by
128 bits of hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, looked_up, written

MIN_LINES, MIN_WORDS = 3, 50
#: What words are parted by within a line.
BLANK = r" \t\r"


def _words(line: str) -> str:
    """The number of words; lines with single blanks between words, which are nearly all, are counted by those."""
    odd = f"contains({line}, '  ') OR contains({line}, '\\t') OR contains({line}, '\\r') OR startswith({line}, ' ') OR endswith({line}, ' ')"
    return f"IF({odd}, size(split(trim(BOTH '{BLANK}' FROM {line}), '[{BLANK}]+')), length({line}) - length(replace({line}, ' ', '')) + 1)"


def _size(step: int) -> str:
    """Lines of the window that begins (step 1) or ends (-1) at line k, whose words are x; null where there is none."""
    sums = ["x"]
    for j in range(1, MIN_LINES):
        sums.append(f"{sums[-1]} + get(w, k + {j * step})")
    cases = " ".join(f"WHEN {s} >= {MIN_WORDS} THEN {j + 1}" for j, s in enumerate(sums))
    return f"CASE {cases} WHEN get(w, k + {(MIN_LINES - 1) * step}) IS NOT NULL THEN {MIN_LINES} END"


def _least(first: str, size: str) -> str:
    """The line of least hash, the last of equals, in a window."""
    at = first
    cases = [f"WHEN 1 THEN {at}"]
    for j in range(1, MIN_LINES):
        at = f"IF(get(h, {first} + {j}) <= get(h, {at}), {first} + {j}, {at})"
        cases.append(f"WHEN {j + 1} THEN {at}")
    return f"CASE {size} {' '.join(cases)} END"


def _window(first: str, size: str) -> str:
    """A window's lines and a hash of what is in it."""
    own = lambda a: ", ".join(f"IF({size} > {j}, get({a}, {first} + {j}), NULL)" for j in range(MIN_LINES))
    return f"struct(get(i, {first}) AS start, get(i, {first} + {size} - 1) AS stop, struct({size} AS n, xxhash64({size}, {own('h')}) AS a, xxhash64({size}, {own('g')}) AS b) AS content)"


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, th (hash of the text), place (line number), f (the line's hash), windows (start and stop line, content)
    of each line that a window selects."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    lines = f"""filter(transform(split(text, '\\n', -1), (l, i) -> struct(i, xxhash64(l) AS h, xxhash64('2', l) AS g, {_words("l")} AS w,
        trim(BOTH '{BLANK}' FROM l) <> '' AS ok)), x -> x.ok)"""
    rows = rows.select("doc_id", F.xxhash64("text").alias("th"), F.expr(lines).alias("t"))
    # arrays of their own: one that were made within the functions below would be made for each line
    rows = rows.select("doc_id", "th", *[F.expr(f"transform(t, x -> x.{c})").alias(c) for c in "ihgw"])
    rows = rows.withColumn("m", F.expr(f"transform(w, (x, k) -> {_size(1)})")).withColumn("r", F.expr(f"transform(w, (x, k) -> {_size(-1)})"))
    rows = rows.withColumn("pm", F.expr(f"transform(m, (n, k) -> {_least('k', 'n')})"))
    # windows that end at a line, but for those that are also the one that begins at their first line
    rows = rows.withColumn("pr", F.expr(f"transform(r, (n, k) -> IF(get(m, k - n + 1) = n, NULL, {_least('(k - n + 1)', 'n')}))"))
    begun = [f"IF(get(pm, p - {j}) = p, {_window(f'(p - {j})', f'get(m, p - {j})')}, NULL)" for j in range(MIN_LINES)]
    ended = [f"IF(get(pr, p + {j}) = p, {_window(f'(p + {j} - get(r, p + {j}) + 1)', f'get(r, p + {j})')}, NULL)" for j in range(MIN_LINES)]
    one = f"filter(transform(h, (f, p) -> struct(get(i, p) AS place, f, filter(array({', '.join(begun + ended)}), x -> x IS NOT NULL) AS windows)), x -> size(x.windows) > 0)"
    return rows.select("doc_id", "th", F.explode(F.expr(one)).alias("o")).select("doc_id", "th", "o.place", "o.f", "o.windows")


def repeated_lines(docs: DataFrame) -> DataFrame:
    """doc_id, th, gone: the numbers of the lines to delete, in order, of each text that has any."""
    found = written(fingerprints(docs), "fingerprints")
    places = written(found.groupBy("f").agg(F.count("*").alias("n")).where("n > 1").withColumn("places", F.col("n")), "places")
    near = looked_up(found, places, "f", "n").where("places > 1")
    near = written(near.select("doc_id", "th", F.explode("windows").alias("x")).select("doc_id", "th", "x.start", "x.stop", "x.content"), "windows")
    drop_written(found)
    drop_written(places)
    place = F.struct("doc_id", "th", "start")
    firsts = written(near.groupBy("content").agg(F.min(place).alias("first"), F.count("*").alias("n")).where("n > 1"), "firsts")
    later = looked_up(near, firsts, "content", "n").where(place > F.col("first"))
    lines = later.select("doc_id", "th", F.explode(F.sequence("start", "stop")).alias("line"))
    out = written(lines.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("line")).alias("gone")), "gone")
    drop_written(near)
    drop_written(firsts)
    return out


def without_repeats(docs: DataFrame) -> DataFrame:
    """docs with text replaced by what is left of it, and the columns n_lines and n_deleted.

    A null text stays null, with no line. Blank lines within a deleted run go with it, others stay; a text of which all
    is deleted is empty. Rows that share doc_id and text are one document given twice, not repeats of each other, and
    fare alike; rows that share doc_id alone are ordered by a hash of the text. Null ids come first. Columns of docs
    that are named as those made here are overwritten; an empty table gives no row."""
    gone = repeated_lines(docs).select(F.struct("doc_id", "th").alias("__doc"), F.col("gone").alias("__gone"))
    rows = docs.drop("n_lines", "n_deleted").withColumn("__doc", F.struct("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("th")))
    # merged whatever the size of gone, which grows with the input: work and disk then grow in proportion
    rows = rows.join(gone.hint("merge"), rows["__doc"].eqNullSafe(gone["__doc"]), "left").drop("__doc")
    rows = rows.withColumn("__lines", F.when(F.col("text").isNotNull(), F.split("text", "\n", -1)))
    # lines and marks of deleted ones in one order: a line goes that a mark follows
    both = F.expr("sort_array(concat(transform(__lines, (l, k) -> struct(k, 0 AS mark, l)), transform(__gone, k -> struct(k, 1 AS mark, '' AS l))))")
    rows = rows.withColumn("__both", F.when(F.col("__gone").isNotNull(), both))
    left = F.expr("array_join(transform(filter(__both, (x, k) -> x.mark = 0 AND NOT coalesce(get(__both, k + 1).mark = 1, false)), x -> x.l), '\\n')")
    text = F.when(F.col("__gone").isNull(), F.col("text")).otherwise(left)
    n = {"n_lines": F.coalesce(F.size("__lines"), F.lit(0)).cast("long"), "n_deleted": F.coalesce(F.size("__gone"), F.lit(0)).cast("long")}
    return rows.withColumns({"text": text, **n}).drop("__gone", "__lines", "__both")


#: Longest runs of equal lines between any two places, the later of which is deleted if it is a passage.
ORACLE = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
line AS (SELECT doc_id, unnest(range(len(a))) AS i, unnest(a) AS l FROM d),
t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k, len(list_filter(regexp_split_to_array(l, '[{BLANK}]+'), lambda x: x <> '')) AS w
      FROM line WHERE regexp_matches(l, '[^{BLANK}]')),
pair AS (SELECT a.doc_id AS da, b.doc_id AS db, b.k - a.k AS off, b.k, b.i, b.w FROM t AS a JOIN t AS b ON a.l = b.l AND (a.doc_id < b.doc_id OR (a.doc_id = b.doc_id AND a.k < b.k))),
island AS (SELECT *, k - row_number() OVER (PARTITION BY da, db, off ORDER BY k) AS run FROM pair),
passage AS (SELECT db, min(i) AS lo, max(i) AS hi FROM island GROUP BY da, db, off, run HAVING count(*) >= {MIN_LINES} OR sum(w) >= {MIN_WORDS}),
gone AS (SELECT DISTINCT db AS doc_id, unnest(range(lo, hi + 1)) AS i FROM passage),
kept AS (SELECT line.doc_id, string_agg(l, chr(10) ORDER BY i) AS text FROM line ANTI JOIN gone USING (doc_id, i) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY 1)
SELECT documents.doc_id, CASE WHEN documents.text IS NULL THEN 0 ELSE len(a) END AS n_lines, coalesce(n.n, 0) AS n_deleted, CASE WHEN documents.text IS NOT NULL THEN md5(coalesce(kept.text, '')) END AS text_md5
FROM documents JOIN d USING (doc_id) LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id)
"""
