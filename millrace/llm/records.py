"""Token-ID / binary output: length-delimited records with masked checksums, and an offset index beside each shard.

A record is  length (u64) | masked crc of those 8 bytes (u32) | payload | masked crc of the payload (u32),
its payload  flags (u8: 1 id known, 2 wide) | doc_id (i64) | n_tokens (u32) | ids (u16, or u32 if wide), all
little-endian. The checksum is CRC-32 (no library here has CRC-32C), rotated right by 15 and offset, so that records
may hold records. The index has, for each record in turn, offset (u64), length (u64) and doc_id (i64): a reader that
shuffles needs no scan of the shard.

Order and executors: rows are dealt to ranges of doc_id and each task writes the shard of its range under a name of
its own; the manifest of shards is a table that Spark commits, so what failed or repeated tasks wrote is never read.
Defined results: a null text has no ids but the end id; rows with equal doc_id all appear, ordered by text; a null
doc_id sorts first; an empty table gives no shard and no row; other columns are ignored."""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import file_system, id_ranges, shuffle_parts, small_batches, work_dir
from .tokens import encoder, le

MASK = 0xA282EAD8  # fixed value of the record format's masked checksum
HEAD, INDEX = "<BqI", "<QQq"
MANIFEST = "shard string, idx string, first_id long, part int, n_docs long, n_tokens long, n_bytes long"
READ = "doc_id long, start long, n_tokens long, ids binary"
#: Characters of texts that a task encodes at a time.
STEP = 2_000_000


def masked(data: bytes) -> int:
    c = zlib.crc32(data)
    return ((c >> 15 | c << 17) + MASK) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    n = struct.pack("<Q", len(payload))
    return b"".join((n, struct.pack("<I", masked(n)), payload, struct.pack("<I", masked(payload))))


def unframe(f) -> Iterator[bytes]:
    """The payloads of a shard, read in turn; raises if a length or payload doesn't match its checksum."""
    while head := f.read(12):
        n, c = struct.unpack("<QI", head)
        if c != masked(head[:8]):
            raise ValueError("damaged record length")
        body = f.read(n + 4)
        if len(body) != n + 4 or struct.unpack_from("<I", body, n)[0] != masked(body[:n]):
            raise ValueError("damaged record")
        yield body[:n]


def payload(doc_id: int | None, ids: bytes) -> bytes:
    """ids: little-endian u32. Stored in two bytes each if they fit."""
    a = np.frombuffer(ids, dtype="<u4")
    wide = bool(len(a) and a.max() > 0xFFFF)
    return struct.pack(HEAD, (doc_id is not None) | wide << 1, doc_id or 0, len(a)) + (ids if wide else a.astype("<u2").tobytes())


def parsed(body: bytes) -> tuple[int | None, bytes]:
    flags, doc_id, n = struct.unpack_from(HEAD, body)
    ids = np.frombuffer(body, dtype="<u4" if flags & 2 else "<u2", offset=struct.calcsize(HEAD), count=n)
    return doc_id if flags & 1 else None, ids.astype("<u4").tobytes()


def steps(rows: Iterator, size: int = STEP) -> Iterator[list]:
    """Lists of (key, text) of about size characters together; a longer text stands alone."""
    some, held = [], 0
    for r in rows:
        some.append(r)
        held += len(r[1])
        if held >= size:
            yield some
            some, held = [], 0
    if some:
        yield some


def write_records(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> DataFrame:
    """Encodes docs(doc_id, text), appends end_id to each and writes shards to path in order of doc_id. Returns the
    manifest, one row per shard, with start: the ids of all shards before it."""
    spark = docs.sparkSession
    rows, bounds = id_ranges(small_batches(docs).select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")), "doc_id")
    rows = rows.repartitionById(max(shuffle_parts(spark), len(bounds) + 1), F.col("__part")).sortWithinPartitions("__part", F.col("doc_id").asc_nulls_first(), "text")
    shards = f"{path}/shards"
    fs, top = file_system(shards)
    fs.create_dir(top, recursive=True)
    end = le([end_id])

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fs, top = file_system(shards)
        fs.create_dir(top, recursive=True)
        name, out, idx, at, docs_n, tokens, first, part = f"{top}/{uuid.uuid4().hex}", None, None, 0, 0, 0, None, None
        enc = encoder(tokenizer)
        for some in steps(((p, i), t) for b in batches for i, t, p in zip(*(b.column(c).to_pylist() for c in range(3)))):
            if out is None:
                out, idx = fs.open_output_stream(f"{name}.rec"), fs.open_output_stream(f"{name}.idx")
                part, first = some[0][0]
            for ((_, doc_id), _), ids in zip(some, enc.batch([t for _, t in some])):
                whole = frame(payload(doc_id, ids + end))
                out.write(whole)
                idx.write(struct.pack(INDEX, at, len(whole), doc_id or 0))
                at, docs_n, tokens = at + len(whole), docs_n + 1, tokens + len(ids) // 4 + 1
        if out is not None:
            out.close()
            idx.close()
            yield pa.RecordBatch.from_pylist([{"shard": f"{name}.rec", "idx": f"{name}.idx", "first_id": first, "part": part, "n_docs": docs_n, "n_tokens": tokens, "n_bytes": at}], pa.schema([("shard", pa.string()), ("idx", pa.string()), ("first_id", pa.int64()), ("part", pa.int32()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("n_bytes", pa.int64())]))

    rows.mapInArrow(write, MANIFEST).write.parquet(f"{path}/manifest")
    return manifest(spark, path)


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """The shards that were committed. One row each, so that the running sum is over few rows however large they are."""
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest").withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start (ids before it in the whole output), n_tokens, ids (u32 bytes) of every record, each checked."""
    return _records(manifest(spark, path), path, READ, lambda i, s, n, ids: ids)


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """As read_records(), with the CRC-32 of the ids in place of them."""
    return _records(manifest(spark, path), path, "doc_id long, start long, n_tokens long, ids_crc32 long", lambda i, s, n, ids: zlib.crc32(ids))


def _records(shards: DataFrame, path: str, schema: str, last) -> DataFrame:
    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fs, _ = file_system(path)
        kind = pa.binary() if "binary" in schema else pa.int64()
        for b in batches:
            for shard, start in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with fs.open_input_stream(shard, buffer_size=1 << 20) as f:
                    rows, held = [], 0
                    for doc_id, ids in map(parsed, unframe(f)):
                        rows.append((doc_id, start, len(ids) // 4, last(doc_id, start, len(ids) // 4, ids)))
                        start, held = start + len(ids) // 4, held + len(ids)
                        if len(rows) == 10_000 or held > 1 << 24:
                            yield _batch(rows, schema, kind, pa)
                            rows, held = [], 0
                    yield _batch(rows, schema, kind, pa)

    n = max(1, min(10_000, shards.count()))
    return shards.select("shard", "start").repartition(n).mapInArrow(read, schema)


def _batch(rows, schema, kind, pa):
    names = [c.strip().split()[0] for c in schema.split(",")]
    return pa.record_batch([pa.array([r[i] for r in rows], kind if i == 3 else pa.int64()) for i in range(4)], names)


def random_record(spark: SparkSession, row, k: int) -> tuple[int | None, bytes]:
    """The k-th record of one manifest row, by its index: what a shuffled reader does."""
    fs, _ = file_system(row["shard"])
    with fs.open_input_file(row["idx"]) as f:
        f.seek(k * struct.calcsize(INDEX))
        at, n, _ = struct.unpack(INDEX, f.read(struct.calcsize(INDEX)))
    with fs.open_input_file(row["shard"]) as f:
        f.seek(at)
        import io

        return parsed(next(unframe(io.BytesIO(f.read(n)))))


def token_records(spark: SparkSession, docs: DataFrame, tokenizer: str, end_id: int = 2) -> DataFrame:
    """Writes docs in a new folder of the shared one and returns the digests that are read back from its files."""
    path = work_dir(spark, "records")
    write_records(docs, path, tokenizer, end_id)
    return read_digests(spark, path)
