"""WARC archives: write one record per page, read them back in splits.

Writing: every task writes its own file of gzip members, one record each,
below the shared folder, under a name that no other attempt uses; the list
of finished files is what counts, so a retried task leaves no double.

Reading: files are cut into byte ranges, one task reads many.  A task looks
for gzip's magic bytes in its range, takes a candidate for a record only if
its first bytes inflate to a WARC header, follows on from record to record,
and owns every record that starts inside its range, wherever it ends.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.common import arrow_map, shared_folder, stored

MAGIC = b"\x1f\x8b\x08"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
LEAST_REVISIT = 1000
RANGE, CHUNK = 4 << 20, 256 << 10
#: Records carry no fetch time of their own; the tables have none.
DATE = "2024-01-01T00:00:00Z"
RECORD = re.compile(rb"<urn:x-page:(null|-?\d+):([0-9a-f]{40})>")


def _member(header: list[tuple[str, str]], block: bytes) -> bytes:
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*header, ("Content-Length", str(len(block)))])
    data = b"WARC/1.1\r\n" + lines.encode("utf-8", "surrogatepass") + b"\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _id(page_id, digest: str) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}:{digest}>"


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to) -> bytes:
    """A response, or a revisit of the record ``refers_to`` (a pair of a page
    id, which may be None, and nothing else), as a gzip member."""
    http = (f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {len(payload)}\r\n\r\n").encode()
    head = [("WARC-Type", "revisit" if refers_to else "response"), ("WARC-Record-ID", _id(page_id, digest)),
            ("WARC-Date", DATE), ("Content-Type", "application/http; msgtype=response"),
            ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode())]
    if url:
        head.append(("WARC-Target-URI", "".join(f"%{ord(c):02X}" if c <= " " or c == "\x7f" else c for c in url)))
    if refers_to:
        head += [("WARC-Refers-To", _id(refers_to[0], digest)), ("WARC-Profile", REVISIT)]
    return _member(head, http if refers_to else http + payload)


def typed(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest, size, refers_to, revisit: of equal payloads
    of at least 1000 bytes, the largest page_id's is the response."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), "url",
                     F.coalesce("html", F.lit("")).alias("html"))
    p = p.withColumns({"digest": F.sha1(F.col("html").cast("binary")), "size": F.octet_length("html").cast("long")})
    # Stored, so that the join can split a payload that very many pages have.
    # One page alone refers to itself, which makes it a response.
    last = stored(p.filter(F.col("size") >= LEAST_REVISIT).groupBy("digest")
                  .agg(F.max("page_id").alias("last"), F.count("*").alias("n")).filter("n > 1")
                  .select("digest", "last"), "last")
    other = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return (p.join(last, "digest", "left")
            .select("page_id", "url", "html", "digest", "size",
                    F.when(other, F.col("last")).alias("refers_to"),
                    F.coalesce(other, F.lit(False)).alias("revisit")))


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """(path, size, records) of the archives written.

    Null html is an empty payload.  A null page_id is never the response
    that others refer to if one of them has an id; pages equal in id and
    payload each get a record of the same type."""
    folder = folder or shared_folder(pages.sparkSession, "warc")
    pages.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(
        pages.sparkSession.sparkContext._jsc.hadoopConfiguration()).mkdirs(
        pages.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(folder))

    def run(batches):
        out = path = None
        size = records = 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    path = f"{folder}/{uuid.uuid4().hex}.warc.gz"
                    store, name = fs.FileSystem.from_uri(path)
                    out = store.open_output_stream(name, compression=None)
                    size += out.write(_member([("WARC-Type", "warcinfo"), ("WARC-Date", DATE),
                                               ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"),
                                               ("Content-Type", "application/warc-fields")], b"format: WARC/1.1\r\n"))
                data = record(row["page_id"], row["url"], row["html"].encode("utf-8", "surrogatepass"),
                              row["digest"], (row["refers_to"],) if row["revisit"] else None)
                out.write(data)
                size, records = size + len(data), records + 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pylist([{"path": path, "size": size, "records": records}])

    return stored(typed(pages).mapInArrow(run, "path string, size long, records long"), "archives")


def _inflate(read, at: int, size: int, whole: bool):
    """The gzip member at ``at``: (its data, or None if it is no record; its
    end).  Unless ``whole``, only the first bytes are looked at."""
    z, parts, pos = zlib.decompressobj(31), [], at
    try:
        while not z.eof and pos < size:
            step = CHUNK if parts else 2048
            raw = read(pos, min(step, size - pos))
            parts.append(z.decompress(raw))
            pos += len(raw)
            if len(parts) == 1 and not parts[0].startswith(b"WARC/1."):
                return None, at
            if not whole:
                return parts[0], at
        return (b"".join(parts), pos - len(z.unused_data)) if z.eof else (None, at)
    except zlib.error:
        return None, at


def records_in(read, start: int, end: int, size: int):
    """Data of the records that start in [start, end)."""
    at = start
    while at < end:
        data, after = _inflate(read, at, size, True) if read(at, 3) == MAGIC else (None, at)
        if data is not None:
            yield data
            at = after
            continue
        # Look for the next magic; a chunk overlaps the next by two bytes.
        at += 1
        while at < end:
            chunk = read(at, min(CHUNK, end - at + 2, size - at))
            hit = chunk.find(MAGIC)
            if 0 <= hit and at + hit < end:
                at += hit
                break
            at += max(1, len(chunk) - 2)
            if len(chunk) < 3:
                at = end


def parse(data: bytes) -> dict | None:
    """A response or revisit as a row; None for other records."""
    head, _, block = data.partition(b"\r\n\r\n")
    fields = dict(line.partition(b": ")[::2] for line in head.split(b"\r\n")[1:])
    kind = fields.get(b"WARC-Type", b"").decode()
    if kind not in ("response", "revisit"):
        return None
    http, _, payload = block[:int(fields[b"Content-Length"])].partition(b"\r\n\r\n")
    size = int(re.search(rb"(?i)content-length: *(\d+)", http)[1])
    page = RECORD.fullmatch(fields[b"WARC-Record-ID"])[1]
    told = base64.b32decode(fields[b"WARC-Payload-Digest"].partition(b":")[2]).hex()
    if kind == "response" and (hashlib.sha1(payload).hexdigest() != told or len(payload) != size):
        raise ValueError(f"payload of {fields[b'WARC-Record-ID']!r} does not fit its digest")
    other = RECORD.fullmatch(fields.get(b"WARC-Refers-To", b""))
    return {"page_id": None if page == b"null" else int(page),
            "url": fields.get(b"WARC-Target-URI", b"").decode("utf-8", "replace") or None,
            "payload_bytes": size, "payload_digest": told, "record_type": kind,
            "refers_to": int(other[1]) if other and other[1] != b"null" else None,
            "payload": payload if kind == "response" else None}


READ = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(spark: SparkSession, files: DataFrame, step: int = RANGE, payload: bool = False) -> DataFrame:
    """Records of the archives listed in files (path, size), with the payload
    of responses if asked for; payloads are checked against their digests."""
    ranges = (files.filter("size > 0")
              .select("path", "size", F.explode(F.sequence(F.lit(0), F.col("size") - 1, F.lit(step))).alias("from"))
              .repartition(spark.sparkContext.defaultParallelism * 4, "path", "from"))
    names = [c.split()[0] for c in READ.split(", ")] + ["payload"] * payload

    def fn(batch, _):
        rows = []
        for path, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "from"))):
            store, name = fs.FileSystem.from_uri(path)
            with store.open_input_file(name) as f:
                rows += [r for r in map(parse, records_in(
                    lambda at, n: f.read_at(n, at), start, min(start + step, size), size)) if r]
        return [[r[c] for r in rows] for c in names]

    return arrow_map(ranges, fn, READ + ", payload binary" * payload, slice_rows=1)
