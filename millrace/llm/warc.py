"""WARC: dictionary-compressed writer and reader (.warc.zst).

An archive is a skippable frame that holds a Zstandard dictionary (itself a Zstandard frame), then one Zstandard
frame per record, compressed with that dictionary, so that any record can be read alone by its offset. The first
record is a warcinfo. The dictionary is built from records of the crawl that is archived: about SAMPLE_PAGES whole
payloads of at most SAMPLE_LONGEST characters, chosen by a hash of page_id.

Of pages with equal payloads the one with the largest page_id is a response and the others revisit it, found by
counting payload digests, never by gathering the pages of one. Executors: each task writes an archive under a name of
its own, and a manifest that Spark commits lists those that count."""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, looked_up, small_batches, work_dir, written

SKIPPABLE = 0x184D2A5D  # fixed value: the skippable frame that the .warc.zst format keeps for its dictionary
PIECE, SAMPLE, DICT_BYTES, LEVEL = 16_384, 400, 112_640, 3
#: Bytes of an archive after which a task begins another.
ROLL = 1 << 30
PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(kind: str, key) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{key}')}>"


def one_line(value: str) -> str:
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [("WARC-Type", kind), *headers, ("Content-Length", str(len(block)))])
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def page_record(page_id: int | None, url: str | None, payload: bytes, payload_digest: str, refers_to: int | None, own: str) -> bytes:
    """A revisit keeps the HTTP head alone; the payload's length and digest stay in its headers."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    headers = [("WARC-Record-ID", own), ("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Target-URI", one_line(url or "urn:none")), ("WARC-Payload-Digest", f"sha1:{payload_digest}"), ("Content-Type", "application/http; msgtype=response")]
    headers += [("X-Page-ID", str(page_id))] if page_id is not None else []
    if revisit:
        headers += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id("page", refers_to)), ("X-Refers-To-Page-ID", str(refers_to)), ("WARC-Truncated", "length")]
    return record("revisit" if revisit else "response", headers, http if revisit else http + payload)


def trained(marked: DataFrame) -> bytes:
    """The dictionary for records of marked(page_id, url, html, refers_to); b"" if there is too little to build one
    from. About SAMPLE pieces of at most PIECE characters reach the driver, however many pages there are and however
    long."""
    import zstandard

    rows = marked.withColumn("html", F.when(F.col("refers_to").isNull(), F.col("html")).otherwise(""))
    pieces = F.greatest(F.ceil(F.length("html") / PIECE), F.lit(1)).cast("int")
    share = SAMPLE / max(1, rows.agg(F.sum(pieces)).first()[0] or 0)
    chosen = F.expr(f"filter(sequence(0, pieces - 1), k -> pmod(xxhash64(page_id, url, k), {1 << 30}) < {share * (1 << 30)!r})")
    picked = rows.withColumn("pieces", pieces).select("page_id", "url", "html", "refers_to", F.explode(chosen).alias("k"))
    picked = picked.select("page_id", "url", F.expr(f"substring(html, k * {PIECE} + 1, {PIECE})").alias("part"), "refers_to", "k").collect()
    some = []
    for r in picked:
        data = r.part.encode("utf-8", "surrogatepass")
        some.append(data if r.k else page_record(r.page_id, r.url, data, digest(data), r.refers_to, record_id("page", r.page_id)))
    some.sort()
    try:
        return zstandard.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, some)) // 20)), some).as_bytes()
    except zstandard.ZstdError:
        return b""


def head_frame(dictionary: bytes) -> bytes:
    import zstandard

    body = zstandard.ZstdCompressor(level=19).compress(dictionary) if dictionary else b""
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def write_archives(pages: DataFrame, path: str) -> DataFrame:
    """Archives pages(page_id, url, html) under path; returns the manifest: archive, n_records, n_bytes.

    A null html is an empty payload, a null url urn:none. Pages that share id and payload with the response are
    responses too, since a record can't revisit itself; a null page_id never is what others refer to, and is a
    response if its payload has no other id. An empty table gives no archive; other columns are ignored."""
    spark = pages.sparkSession
    rows = small_batches(pages).select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    sha = F.sha1(F.encode("html", "utf-8")).alias("sha")
    copies = written(rows.groupBy(sha).agg(F.max("page_id").alias("last"), F.count("*").alias("n")).where("n > 1"), "copies")
    marked = rows.withColumn("sha", sha)
    marked = looked_up(marked, copies, "sha", "n") if not copies.isEmpty() else marked.withColumn("last", F.lit(None).cast("long"))
    marked = marked.select("page_id", "url", "html", F.when(~F.col("last").eqNullSafe(F.col("page_id")), F.col("last")).alias("refers_to"))
    dictionary = trained(marked)
    archives = f"{path}/archives"
    fs, top = file_system(archives)
    fs.create_dir(top, recursive=True)

    def write(batches: Iterator) -> Iterator:
        import pyarrow as pa
        import zstandard

        fs, top = file_system(archives)
        fs.create_dir(top, recursive=True)
        zdict = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=zdict, write_checksum=True)
        out, name, n, size, done = None, "", 0, 0, []
        for b in batches:
            for page_id, url, html, refers in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    name, n = f"{top}/{uuid.uuid4().hex}.warc.zst", 0
                    out = fs.open_output_stream(name)
                    info = record("warcinfo", [("WARC-Record-ID", record_id("file", name)), ("WARC-Date", "1970-01-01T00:00:00Z"), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n")
                    size = out.write(head_frame(dictionary)) + out.write(press.compress(info))
                data = html.encode("utf-8", "surrogatepass")
                own = record_id("page", page_id) if page_id is not None and refers is None else record_id("copy", f"{name}:{n}")
                size += out.write(press.compress(page_record(page_id, url, data, digest(data), refers, own)))
                n += 1
                if size > ROLL:
                    out.close()
                    done.append((name, n, size))
                    out = None
        if out is not None:
            out.close()
            done.append((name, n, size))
        yield pa.record_batch([pa.array([d[i] for d in done], k) for i, k in enumerate((pa.string(), pa.int64(), pa.int64()))], ["archive", "n_records", "n_bytes"])

    marked.mapInArrow(write, "archive string, n_records long, n_bytes long").write.parquet(f"{path}/manifest")
    return spark.read.schema("archive string, n_records long, n_bytes long").parquet(f"{path}/manifest")


def records_of(f) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive, from an open stream; memory holds one record at a time."""
    import zstandard

    magic, n = struct.unpack("<II", f.read(8))
    if magic != SKIPPABLE:
        raise ValueError("no dictionary frame")
    body = f.read(n)
    zdict = zstandard.ZstdCompressionDict(zstandard.ZstdDecompressor().decompress(body)) if body else None
    left = b""
    while True:
        one, parts = zstandard.ZstdDecompressor(dict_data=zdict).decompressobj(), []
        while not one.eof:
            chunk = left or f.read(1 << 18)
            if not chunk:
                if parts:
                    raise ValueError("an archive ends within a record")
                return
            parts.append(one.decompress(chunk))
            left = one.unused_data
        yield parsed(b"".join(parts))


def parsed(data: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode().split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines)
    n = int(headers["Content-Length"])
    if first != "WARC/1.1" or rest[n:] != b"\r\n\r\n":
        raise ValueError("damaged record")
    return headers, rest[:n]


def read_archives(manifest: DataFrame, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of each page record; a response's payload is
    held against its digest."""

    def read(batches: Iterator) -> Iterator:
        import pyarrow as pa

        fs, _ = file_system(path)
        schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
        for b in batches:
            for name in b.column(0).to_pylist():
                rows = []
                with fs.open_input_stream(name, buffer_size=1 << 20) as f:
                    for headers, block in records_of(f):
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        n = int(http.rpartition(b"Content-Length: ")[2])
                        said = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if headers["WARC-Type"] == "response" and (len(payload) != n or digest(payload) != said):
                            raise ValueError("a payload doesn't match its digest")
                        rows.append({"page_id": int(headers["X-Page-ID"]) if "X-Page-ID" in headers else None, "payload_bytes": n, "payload_digest": said, "record_type": headers["WARC-Type"], "refers_to": int(headers["X-Refers-To-Page-ID"]) if "X-Refers-To-Page-ID" in headers else None})
                        if len(rows) == 10_000:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows = []
                yield pa.RecordBatch.from_pylist(rows, schema)

    n = max(1, min(10_000, manifest.count()))
    return manifest.select("archive").repartition(n).mapInArrow(read, PAGE)


def archived(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Writes pages in a new folder of the shared one and returns what is read back from the archives."""
    path = work_dir(spark, "warc")
    return read_archives(write_archives(pages, path), path)
