"""WARC archives: write records with an index of offset, length, URL and digest, read selected records by range.

Every record is a gzip member of its own, so a byte range of an archive is enough to read it. Tasks write one archive
each straight into the shared folder under a name of their own; the index is what Spark commits, so an archive of a
failed or repeated task attempt is never referred to. Reading starts from the index: selected records are sorted by
archive and offset, neighbouring ranges are fetched in one read, and only these bytes are touched.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanweave.session import materialize, read_table, shared_dir

INDEX = "page_id long, archive string, offset long, length long, url string, payload_digest string, payload_bytes long, record_type string, refers_to long"
RECORD = "page_id long, record_type string, refers_to long, payload_bytes long, payload_digest string, url string, payload binary"
_OUT = pa.schema([("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("url", pa.string()), ("payload", pa.binary())])


def _open(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")


def _record(page_id: int | None, url: str | None, payload: bytes, kind: str, refers: int | None) -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{'none' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if url is not None:
        head.insert(3, "WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    body = payload
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{'none' if refers is None else refers}>"]
        body = b""
    else:
        head.append("Content-Type: application/http; msgtype=response")
        body = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + payload
    head.append(f"Content-Length: {len(body)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def _parse(raw: bytes) -> tuple:
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    page = lambda x: None if x is None or x.endswith(":none>") else int(x[len("<urn:x-page:") : -1])
    digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
    payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
    kind = fields["WARC-Type"]
    return page(fields["WARC-Record-ID"]), kind, page(fields.get("WARC-Refers-To")), int(fields["X-Payload-Length"]), digest, fields.get("WARC-Target-URI"), payload if kind == "response" else None


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html", revisit_bytes: int = 1000, archive_bytes: int = 1 << 30) -> DataFrame:
    """Write one record for each row into archives under ``folder``; returns the index (INDEX), written as Parquet.

    Of rows with equal payloads (UTF-8 bytes of the body; null: empty) of at least ``revisit_bytes`` bytes, the one
    with the largest id becomes the response and the others revisit it; rows that share the largest id are all
    responses. Smaller payloads are all responses. Null ids rank lowest, a null URL is left out of the record. An empty
    table gives an empty index. Other columns don't matter. A task begins another archive after ``archive_bytes``.
    """
    body = F.coalesce(pages[body_col].cast("string"), F.lit(""))
    rows = pages.select(pages[id_col].cast("long").alias("page_id"), pages[url_col].cast("string").alias("url"), body.alias("body"))
    large = F.octet_length("body") >= revisit_bytes
    # a key that only large payloads can share: small ones are dealt by what they are, and match nothing
    own = F.encode(F.concat(F.lit("small "), F.xxhash64("page_id", "url", "body").cast("string")), "UTF-8")
    rows = rows.withColumn("same", F.when(large, F.unhex(F.sha2("body", 256))).otherwise(own))
    lead = rows.where(large).groupBy("same").agg(F.max("page_id").alias("lead"))
    rows = rows.join(lead.hint("shuffle_hash"), "same", "left")
    revisit = F.col("lead").isNotNull() & ~F.col("lead").eqNullSafe(F.col("page_id"))
    rows = rows.select("page_id", "url", "body", F.when(revisit, "revisit").otherwise("response").alias("kind"), F.when(revisit, F.col("lead")).alias("refers"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)
        fs.create_dir(base, recursive=True)
        name, at, out = f"pages-{uuid.uuid4().hex}.warc.gz", 0, None
        for batch in batches:
            found = []
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "body", "kind", "refers")), strict=True):
                page_id, url, body, kind, refers = row
                payload = body.encode()
                member = gzip.compress(_record(page_id, url, payload, kind, refers), 6, mtime=0)
                if out is not None and at >= archive_bytes:
                    out.close()
                    name, at, out = f"pages-{uuid.uuid4().hex}.warc.gz", 0, None
                if out is None:
                    out = fs.open_output_stream(f"{base}/{name}", compression=None)
                out.write(member)
                found.append((page_id, name, at, len(member), url, hashlib.sha1(payload).hexdigest(), len(payload), kind, refers))
                at += len(member)
            if found:
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64()]
                names = [x.split()[0] for x in INDEX.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), kinds, strict=True)], names)
        if out is not None:
            out.close()

    return materialize(rows.mapInArrow(write, INDEX), "warc-index")


def read_records(index: DataFrame, folder: str, gap: int = 64 << 10, most: int = 4 << 20, task_bytes: int = 16 << 20) -> DataFrame:
    """The records (RECORD) that the rows of ``index`` name; a revisit has a null payload. Ranges that lie less than
    ``gap`` bytes apart are fetched together, up to ``most`` bytes a read (a longer record is one read)."""
    wanted = index.select("archive", "offset", "length").withColumn("part", F.floor(F.col("offset") / most))
    # the index is small, what it points to isn't: as many tasks as the records' bytes ask for
    tasks = max(1, math.ceil((wanted.agg(F.sum("length")).first()[0] or 0) / task_bytes))
    wanted = wanted.repartition(tasks, "archive", "part").sortWithinPartitions("archive", "offset")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(folder)

        def fetch(name: str, todo: list[tuple[int, int]]) -> pa.RecordBatch:
            first = todo[0][0]
            with fs.open_input_file(f"{base}/{name}") as f:
                raw = f.read_at(max(o + n for o, n in todo) - first, first)
            rows = [_parse(gzip.decompress(raw[o - first : o - first + n])) for o, n in todo]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _OUT.types, strict=True)], schema=_OUT)

        name, todo = None, []
        for batch in batches:
            for a, o, n in zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length")), strict=True):
                if todo and (a != name or o > todo[-1][0] + todo[-1][1] + gap or o + n - todo[0][0] > most):
                    yield fetch(name, todo)
                    todo = []
                name = a
                todo.append((o, n))
        if todo:
            yield fetch(name, todo)

    return wanted.mapInArrow(read, RECORD)


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    index = write_archives(read_table(spark, sf_dir, "pages"), folder)
    found = read_records(index, folder)
    # bytes and digest of a response are those of the payload that was read, of a revisit those its header names
    size, digest = F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_bytes")), F.coalesce(F.sha1("payload"), F.col("payload_digest"))
    return found.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
k AS (SELECT page_id, CAST(strlen(body) AS BIGINT) AS payload_bytes, sha1(body) AS payload_digest,
             max(page_id) OVER (PARTITION BY body) AS lead FROM p)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND lead <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND lead <> page_id THEN lead END AS refers_to
FROM k
"""
