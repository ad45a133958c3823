"""WARC archives, index first.

`plan_records` finds equal payloads: of these the record with the largest id is the response, the others are revisits.
`write_archives` has each task write files of gzip members, one per record, and returns an index of file, offset, length,
URL, digest and more. `read_records` takes any selection of index rows, sorts them by file and offset, joins ranges that lie
close together into one read, and cuts the records out of it.

Files have random names, and only those of tasks that ended well are in the index, which Spark commits; so a repeated task
leaves an unlisted file and nothing else. The folder must be one that all executors share and that pyarrow can open.

Null payload is empty. Payloads shorter than `least` bytes are all responses. Rows with the largest id of their payload are
responses, several if the id repeats; a null id is never the largest, and where all ids are null all are responses. A null
URL has no WARC-Target-URI. Counts are partial before the shuffle and payloads are joined to them by a join Spark can split.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logsift.session import stored

FILE_BYTES, READ_BYTES, GAP, PART_BYTES = 1 << 30, 8 << 20, 64 << 10, 64 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
INDEX = ("id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, file string, offset long, length long")
RECORDS = "id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def plan_records(pages: DataFrame, id: str = "page_id", url: str = "url", payload: str = "html", least: int = 0) -> DataFrame:
    """(id, url, payload, sha1, record_type, refers_to)."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id).cast("long").alias("id"), F.col(url).alias("url"), body.alias("payload"))
    rows = rows.withColumns({"sha1": F.sha1("payload"), "long": F.octet_length("payload") >= least})
    last = rows.where("long").groupBy(F.col("sha1").alias("same")).agg(F.max("id").alias("last"), F.count("*").alias("times")).where("times > 1")
    last = stored(last, "last")  # so that Spark can split the join where one payload has very many records
    revisit = F.col("last").isNotNull() & ~F.col("id").eqNullSafe(F.col("last"))
    joined = rows.join(last, (F.col("sha1") == F.col("same")) & F.col("long"), "left")
    return joined.select("id", "url", "payload", "sha1", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                         F.when(revisit, F.col("last")).alias("refers_to"))


def record_id(id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{id}|{digest}')}>"


def record(id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool, date: str) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(id, digest)}", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> tuple[dict[str, str], int, bytes | None]:
    """The WARC headers in lower case, the length of the payload, and the payload, None for a revisit."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record here")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    block = rest[:int(fields["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(v) for k, _, v in (line.partition(b":") for line in http.split(b"\r\n")) if k.lower() == b"content-length")
    return fields, length, None if fields["warc-type"] == "revisit" else payload


def write_archives(planned: DataFrame, folder: str, date: str = "2000-01-01T00:00:00Z", file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write the records of `plan_records` below `folder`; returns the index, a stored table."""
    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()),
                        ("payload_digest", pa.string()), ("file", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        out, name, offset = None, "", 0
        try:
            for batch in batches:
                rows = []
                for id, url, payload, sha1, kind, refers_to in zip(*(batch.column(c) for c in ("id", "url", "payload", "sha1", "record_type", "refers_to"))):
                    if out is None or offset >= file_bytes:
                        if out is not None:
                            out.close()
                        name, offset = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    id, url, payload, kind, refers_to = id.as_py(), url.as_py(), payload.as_py(), kind.as_py(), refers_to.as_py()
                    digest = base64.b32encode(bytes.fromhex(sha1.as_py())).decode()
                    gzip = zlib.compressobj(1, zlib.DEFLATED, 31)
                    member = gzip.compress(record(id, url, payload, digest, refers_to, kind == "revisit", date)) + gzip.flush()
                    out.write(member)
                    rows.append((id, url, kind, refers_to, len(payload), digest, name, offset, len(member)))
                    offset += len(member)
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), schema)], schema=schema)
        finally:
            if out is not None:
                out.close()

    return stored(planned.mapInArrow(run, INDEX), "warc-index")


def coalesced(spans: list[tuple[int, int]], gap: int = GAP, most: int = READ_BYTES) -> list[tuple[int, int, int]]:
    """Sorted (offset, length) as reads (offset, length, number of spans): spans with at most `gap` between them go together
    while the read is at most `most` bytes."""
    reads: list[tuple[int, int, int]] = []
    for offset, length in spans:
        if reads:
            start, size, n = reads[-1]
            if offset - (start + size) <= gap and offset + length - start <= most:
                reads[-1] = (start, max(size, offset + length - start), n + 1)
                continue
        reads.append((offset, length, 1))
    return reads


def read_records(index: DataFrame, folder: str) -> DataFrame:
    """The records of the index rows given. Digest and length of a response are those of the payload as read."""
    part = F.floor(F.col("offset") / PART_BYTES)
    rows = index.withColumn("part", part).repartition("file", "part").sortWithinPartitions("file", "offset").drop("part")
    schema = pa.schema([("id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
                        ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        name, source = None, None
        for batch in batches:
            rows = batch.to_pylist()
            at = 0
            while at < len(rows):
                if rows[at]["file"] != name:
                    if source is not None:
                        source.close()
                    name = rows[at]["file"]
                    source = store.open_input_file(f"{root}/{name}")
                end = at
                while end < len(rows) and rows[end]["file"] == name:
                    end += 1
                for offset, length, n in coalesced([(r["offset"], r["length"]) for r in rows[at:end]]):
                    source.seek(offset)
                    raw, out = source.read(length), []
                    for r in rows[at:at + n]:
                        fields, size, payload = parse_record(zlib.decompress(raw[r["offset"] - offset:r["offset"] - offset + r["length"]], 31))
                        digest = fields["warc-payload-digest"].removeprefix("sha1:")
                        if payload is not None:
                            digest, size = base64.b32encode(hashlib.sha1(payload).digest()).decode(), len(payload)
                        if digest != r["payload_digest"] or payload is None and fields["warc-refers-to"] != record_id(r["refers_to"], digest):
                            raise ValueError(f"{name} at {r['offset']}: not the record of the index")
                        out.append((r["id"], r["url"], fields["warc-type"], r["refers_to"], size, digest, payload))
                    at += n
                    yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)
        if source is not None:
            source.close()

    return rows.mapInArrow(run, RECORDS)
