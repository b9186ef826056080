"""Shared plumbing of the training-data operators: the shared work folder, written intermediates, ordered ranges
of ids, and lookups that stand a hot key."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


#: The setting by which Spark deletes the shuffle files of a query at its end.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Rows and bytes of an Arrow batch at most.
ARROW, ROWS, BYTES = "spark.sql.execution.arrow.", 2_000, 2_000_000
_slot: dict[tuple, object] = {}


def worker_only(kind: str, key: str, make):
    """What a Python worker keeps from task to task: the object last asked for, and no other. Workers outlive stages,
    so that without this the caches of one stage would stay in memory during the next."""
    if (kind, key) not in _slot:
        _slot.clear()
        _slot[kind, key] = make()
    return _slot[kind, key]


def small_batches(df: DataFrame) -> DataFrame:
    """df; from now on its session sends rows to Python in batches of at most ROWS and BYTES, or less if it is set so.
    Batches are held outside of the JVM's heap, several copies at a time, where nothing else bounds them."""
    conf = df.sparkSession.conf
    for name, most in ((ARROW + "maxRecordsPerBatch", ROWS), (ARROW + "maxBytesPerBatch", BYTES)):
        now = conf.get(name)
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(name, str(most))
    return df


def release() -> None:
    """Gives up what this worker keeps: for stages that keep nothing themselves."""
    _slot.clear()


def text_slices(batches, column: int, rows: int = 500, size: int = 4_000_000):
    """Arrow batches in pieces of at most so many rows, and about so many bytes of the column's texts."""
    for b in batches:
        for lo, n in _cut(b.column(column), rows, size):
            yield b.slice(lo, n)


def array_slices(texts, rows: int = 500, size: int = 4_000_000):
    """An Arrow array of texts in such pieces."""
    for lo, n in _cut(texts, rows, size):
        yield texts.slice(lo, n)


def _cut(texts, rows: int, size: int):
    import pyarrow.compute as pc

    held = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    lo = 0
    while lo < len(texts):
        before = held[lo - 1] if lo else 0
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(held, before + size, side="right"))))
        yield lo, hi - lo
        lo = hi


def slices(batches, rows: int = 1_000):
    """Arrow batches in pieces of so many rows, so that only one piece is held as Python objects."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def work_dir(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which driver and executors share. Only where that is unset and Spark
    runs in one process, as in tests, is a temp folder taken instead; on a cluster its absence is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[[^]]*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + os.path.join(tempfile.gettempdir(), f"millrace-{spark.sparkContext.applicationId}")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def write(df: DataFrame, path: str, *by: str) -> None:
    """Writes df, and has Spark delete the shuffle files of that job at its end: nobody reads them again."""
    conf = df.sparkSession.conf
    before = conf.get(CLEAN)
    conf.set(CLEAN, "true")
    try:
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
    finally:
        conf.set(CLEAN, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends here, and a lost executor costs no recomputation before it."""
    path = work_dir(df.sparkSession, name)
    write(df, path)
    out = df.sparkSession.read.schema(T.StructType([T.StructField(f.name, f.dataType) for f in df.schema])).parquet(path)
    out._millrace_path = path
    return out


def drop_written(df: DataFrame) -> None:
    """Deletes what written() made, when nothing lazy reads it any more."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._millrace_path)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def file_system(uri: str):
    """The pyarrow file system of a folder in shared storage (file, hdfs, s3, gs), and the path within it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def shuffle_parts(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def id_ranges(df: DataFrame, key: str, parts: int | None = None) -> tuple[DataFrame, list[int]]:
    """df with a column __part: the range of key (a long) that a row falls in, and the first key of each range after
    the first. The bounds are keys that occur, found by one pass over that column alone, so the ranges hold like
    counts of rows without another scan of wide columns. Null keys go to range 0."""
    parts = parts or shuffle_parts(df.sparkSession)
    share = [i / parts for i in range(1, parts)]
    found = df.agg(F.percentile_approx(F.col(key).cast("long"), share, max(10_000, 20 * parts))).first()[0] if share else []
    bounds = sorted(set(found or []))
    low = df.agg(F.min(F.col(key).cast("long"))).first()[0] if bounds else None
    bounds = [b for b in bounds if b != low]
    edge = np.array(bounds, dtype=np.int64)

    @F.arrow_udf("int")
    def part(ids):
        import pyarrow as pa

        at = np.searchsorted(edge, ids.fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False), side="right")
        return pa.array(at.astype(np.int32))

    return df.withColumn("__part", part(F.col(key).cast("long")) if bounds else F.lit(0)), bounds


def looked_up(rows: DataFrame, table: DataFrame, key: str, count: str) -> DataFrame:
    """rows left-joined with table (one row per non-null key; count: how many of rows have it) on key.

    Keys that hold over a thousandth of all rows, of which there are under a thousand whatever the input, are joined
    by broadcast, so that they stay where they are; only the others are shuffled by key. rows is read twice."""
    total = table.agg(F.sum(count)).first()[0] or 0
    hot = F.col(count) * 1000 > total
    marked = F.broadcast(table.where(hot).drop(count).withColumn("__hot", F.lit(True)))
    first = rows.join(marked, key, "left")
    rest = rows.join(F.broadcast(table.where(hot).select(key)), key, "left_anti").join(table.where(~hot).drop(count), key, "left")
    return first.where("__hot").drop("__hot").unionByName(rest)
