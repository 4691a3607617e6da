"""WARC archives: written with an index, read back by coalesced byte ranges.

Writing comes with the index. Each task appends its records, every one a gzip member of its own, to archives in the
shared folder and yields offset, length, URL and digest of each. The index becomes a table; an archive that no row of it
names is the left-over of a lost attempt and is never read. Records of equal payload are found by digest before
the payloads are written, so only digests and ids are shuffled: the smallest page id is the response, the others
revisit it and carry no payload.

Reading takes rows of the index, sorts them by archive and offset, and joins neighbouring ranges into one read as
long as the gap and the read stay small. Any selection of index rows can be read; what lies between is skipped.

Defined cases: a null payload is empty; a null URL is left out of the record and null again when read; control
characters of a URL are written as per cent escapes. All rows with the smallest id of a payload are responses, so
repeated rows are alike. Null ids count as larger than any other; if a payload has no other, all its rows are responses.
Extra columns are left behind. The archives' folder is any that ``pyarrow.fs`` can open by its URI.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pledgelens.operators.lookup import lookup_join
from pledgelens.session import shared_folder

from .common import utf8, written

#: An archive that has reached this size is closed and another begun.
ARCHIVE_BYTES = 256 << 20
#: Ranges no further apart than this are read as one, up to so many bytes.
GAP_BYTES = 64 << 10
READ_BYTES = 8 << 20

_CONTROLS = re.compile("[\x00-\x20\x7f]")
INDEX = (
    "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
    "archive string, offset bigint, length bigint"
)
RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, intact boolean"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of a text in base 32: four times ten hexadecimal digits are eight digits of base 32."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def record_bytes(row: dict, payload: bytes, date: str) -> bytes:
    """One record as a gzip member."""
    revisit = row["record_type"] == "revisit"
    page = lambda i: f"<urn:x-page:{'null' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['payload_bytes']}\r\n\r\n"
    block = http.encode() + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {row['record_type']}", f"WARC-Record-ID: {page(row['page_id'])}", f"WARC-Date: {date}"]
    if row["url"] is not None:
        head.append("WARC-Target-URI: " + _CONTROLS.sub(lambda m: f"%{ord(m[0]):02X}", row["url"]))
    if revisit:
        head += [f"WARC-Refers-To: {page(row['refers_to'])}",
                 "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    head += [f"WARC-Payload-Digest: sha1:{row['payload_digest']}", "Content-Type: application/http; msgtype=response",
             f"Content-Length: {len(block)}"]
    data = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def parsed(member: bytes) -> tuple[dict, bytes]:
    """A record's values and its payload (empty for a revisit)."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    http, _, payload = rest[:int(fields["Content-Length"])].partition(b"\r\n\r\n")
    size = int(http.rpartition(b": ")[2])
    page = lambda name: None if (x := fields[name][12:-1]) == "null" else int(x)
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    values = {
        "page_id": page("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest,
        "record_type": fields["WARC-Type"], "refers_to": page("WARC-Refers-To") if revisit else None,
        "intact": revisit or (len(payload) == size and base64.b32encode(hashlib.sha1(payload).digest()).decode() == digest),
    }
    return values, payload


def decided(pages: DataFrame, page_id: str, url: str, payload: str) -> DataFrame:
    """The pages with digest, length, record type and the page a revisit refers to."""
    keyed = pages.select(
        F.col(page_id).cast("bigint").alias("page_id"), F.col(url).alias("url"), F.col(payload).alias("payload"),
        F.coalesce(F.octet_length(payload), F.lit(0)).cast("bigint").alias("payload_bytes"),
        base32_sha1(F.coalesce(F.col(payload), F.lit(""))).alias("payload_digest"),
    )
    firsts = (
        keyed.groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1").select("payload_digest", "first")
    )
    out = lookup_join(keyed, written(firsts, "warc-firsts"), ["payload_digest"], salt_on=["page_id", "url"])
    revisit = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("page_id"))
    return out.select(
        "page_id", "url", "payload", "payload_bytes", "payload_digest",
        F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("first")).alias("refers_to"),
    )


def write_archives(
    pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", payload: str = "html",
    date: str = "1970-01-01T00:00:00Z", archive_bytes: int = ARCHIVE_BYTES,
) -> DataFrame:
    """Write a record per page and return the index, a table with the columns of ``INDEX``."""
    target = folder or f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    fields = [x.split()[0] for x in INDEX.split(", ")]

    def write(batches):
        store, root = fs.FileSystem.from_uri(target)
        store.create_dir(root)
        part = TaskContext.get().partitionId()
        out, name, at = None, "", 0
        try:
            for batch in batches:
                payloads = utf8(batch.column("payload"))
                rows = batch.drop_columns(["payload"]).to_pylist()
                for row, data in zip(rows, payloads):
                    if out is None:
                        name, at = f"{part:06d}-{uuid.uuid4().hex}.warc.gz", 0
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                    member = record_bytes(row, data, date)
                    out.write(member)
                    row |= {"archive": f"{target}/{name}", "offset": at, "length": len(member)}
                    at += len(member)
                    if at >= archive_bytes:
                        out.close()
                        out = None
                yield pa.RecordBatch.from_pydict({f: [r[f] for r in rows] for f in fields}, _INDEX_SCHEMA)
        finally:
            if out is not None:
                out.close()

    return written(decided(pages, page_id, url, payload).mapInArrow(write, INDEX), "warc-index")


_KINDS = {"bigint": pa.int64(), "string": pa.string(), "boolean": pa.bool_()}
_INDEX_SCHEMA = pa.schema([(n, _KINDS[t]) for n, t in (x.split() for x in INDEX.split(", "))])
_RECORD_SCHEMA = pa.schema([(n, _KINDS[t]) for n, t in (x.split() for x in RECORD.split(", "))])


#: Bytes of records that a task reads, and of a stretch of an archive that is not cut.
TASK_BYTES = 64 << 20
STRETCH_BYTES = 4 << 20


def ranges(rows: list[tuple[str, int, int]], gap: int = GAP_BYTES, most: int = READ_BYTES) -> Iterator[list[tuple[str, int, int]]]:
    """Runs of (archive, offset, length) in order that one read can serve."""
    run: list[tuple[str, int, int]] = []
    for name, at, size in rows:
        if run and (name != run[-1][0] or at > run[-1][1] + run[-1][2] + gap or at + size - run[0][1] > most):
            yield run
            run = []
        run.append((name, at, size))
    if run:
        yield run


def dealt(index: DataFrame) -> DataFrame:
    """The places of an index in reading order, dealt to tasks by the bytes of their records, not by those of the index.

    A stretch of an archive stays together; there are as many tasks as ``TASK_BYTES`` of records ask for, or as cores have a megabyte each.
    """
    places = index.select("archive", "offset", "length")
    whole = places.agg(F.sum("length")).first()[0] or 0
    cores = index.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(cores, math.ceil(whole / (1 << 20))), math.ceil(whole / TASK_BYTES))
    stretch = F.floor(F.col("offset") / F.lit(max(1, min(STRETCH_BYTES, whole // (4 * parts)))))
    return places.repartition(parts, F.col("archive"), stretch).sortWithinPartitions("archive", "offset")


def read_records(index: DataFrame, with_payload: bool = False) -> DataFrame:
    """The records that the rows of an index name, with ``payload`` (binary) if asked for."""
    schema = _RECORD_SCHEMA.append(pa.field("payload", pa.binary())) if with_payload else _RECORD_SCHEMA

    def read(batches):
        name, source = None, None
        for batch in batches:
            for run in ranges(list(zip(*(batch.column(c).to_pylist() for c in ("archive", "offset", "length"))))):
                if run[0][0] != name:
                    name = run[0][0]
                    store, path = fs.FileSystem.from_uri(name)
                    source = store.open_input_file(path)
                start = run[0][1]
                data = source.read_at(run[-1][1] + run[-1][2] - start, start)
                rows = []
                for _, at, size in run:
                    values, payload = parsed(data[at - start:at - start + size])
                    rows.append(values | {"payload": payload} if with_payload else values)
                yield pa.RecordBatch.from_pylist(rows, schema)

    return dealt(index).mapInArrow(read, RECORD + (", payload binary" if with_payload else ""))


def round_trip(pages: DataFrame) -> DataFrame:
    """Per page what its record in the archives says: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    found = read_records(write_archives(pages))
    broken = F.raise_error(F.concat(F.lit("a record does not match its digest: "), F.col("payload_digest")))
    digest = F.when(F.col("intact"), F.col("payload_digest")).otherwise(broken)
    return found.select("page_id", "payload_bytes", digest.alias("payload_digest"), "record_type", "refers_to")
