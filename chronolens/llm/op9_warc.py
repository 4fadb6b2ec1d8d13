"""Legacy archives (ARC) and their conversion to WARC.

ARC files of version 1 and 2 are read by their header lines: the version block
names the fields of the lines to come, the last field declares the length of the
bytes that follow.  Each capture becomes a WARC record with an identifier made
from file and offset, a timestamp made from the 14 (or 12) digits, a type and
SHA-1 digests of block and payload.  A capture whose payload of
``revisit_bytes`` or more equals that of another becomes a revisit record of the
one with the largest key.

Archives are written to the shared folder, one file for each task and attempt;
a manifest, written as a table when all tasks are done, names the chunks that
count.  Files left by lost attempts are in no manifest.  Record identifiers come
from the task's number and the offset, so an attempt that is repeated gives the
same ones.

Which captures are revisits is found on an index without their payloads; the
decisions go to the chunks that hold the captures, so payloads are never shuffled.

Defined results
  * null payload: empty; null URL: written as ``about:blank``; white space and
    control characters in URLs are percent-encoded;
  * null keys: kept as null; among equal payloads a null key is the response
    only if all keys are null; rows that share the largest key are all responses;
  * repeated rows give a record each; an empty table gives empty archives;
  * a record is held in memory as a whole, nothing else is;
  * extra columns aren't archived; helper names can't clash as the archive's
    fields are fixed.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import bound_batches, new_path, stage

REVISIT_BYTES = 1000
#: Compressed bytes of one chunk: the unit of reading.
CHUNK_BYTES = 4 << 20
LEVEL = 1

# Fixed values of the formats.
V1_FIELDS = "URL IP-address Archive-date Content-type Archive-length"
V2_FIELDS = "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")  # URLs

_unsafe = re.compile(r"[\x00-\x20\x7f]")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(data: bytes) -> bytes:
    """One gzip member."""
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def members(data: bytes, step: int = 1 << 15) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of each gzip member; fed in steps, so that what a member
    leaves over is never copied as a whole."""
    view, at = memoryview(data), 0
    while at < len(data):
        d, out, to = zlib.decompressobj(31), [], at
        while not d.eof:
            if to >= len(data):
                raise ValueError("gzip member cut short")
            out.append(d.decompress(view[to : to + step]))
            to = min(len(data), to + step)
        yield at, b"".join(out)
        at = to - len(d.unused_data)


# -- ARC ---------------------------------------------------------------------


def arc_version_block(version: int, name: str, date: str) -> bytes:
    fields = V1_FIELDS if version == 1 else V2_FIELDS
    body = f"{version} 0 chronolens\n{fields}\n".encode()
    more = "" if version == 1 else " 200 - - 0 " + name
    return f"filedesc://{name} 0.0.0.0 {date} text/plain{more} {len(body)}\n".encode() + body + b"\n"


def arc_record(version: int, url: str, ip: str, date: str, mime: str, status: int, block: bytes, name: str, offset: int) -> bytes:
    more = "" if version == 1 else f" {status} - - {offset} {name}"
    return f"{url} {ip} {date} {mime}{more} {len(block)}\n".encode() + block + b"\n"


def parse_arc(data: bytes, fields: list[str] | None = None) -> Iterator[tuple[dict, bytes, list[str]]]:
    """(header fields, block, field names) of each record in ARC bytes.

    ``fields`` are the names in force; a version block replaces them.  Lengths
    are the declared ones; a record cut short is an error.
    """
    at = 0
    while at < len(data):
        if data[at : at + 1] in (b"\n", b"\r"):
            at += 1
            continue
        end = data.find(b"\n", at)
        if end < 0:
            raise ValueError("ARC header line without an end")
        parts = data[at:end].decode("utf-8", "replace").rstrip("\r").split(" ")
        length = int(parts[-1])
        begin = end + 1
        block = data[begin : begin + length]
        if len(block) != length:
            raise ValueError("ARC record shorter than declared")
        if parts[0].startswith("filedesc://"):
            lines = block.decode("utf-8", "replace").split("\n")
            version = lines[0].split(" ")[0]
            if version not in ("1", "2"):
                raise ValueError(f"unknown ARC version {version}")
            fields = lines[1].strip().split(" ")
            yield {"filedesc": parts[0], "version": version}, block, fields
        else:
            if fields is None:
                raise ValueError("ARC record before a version block")
            if len(parts) < len(fields):
                raise ValueError("ARC header line with missing fields")
            # a URL may hold spaces: the other fields are counted from the right
            k = len(fields) - 1
            values = [" ".join(parts[: len(parts) - k]), *parts[len(parts) - k :]]
            yield dict(zip(fields, values)), block, fields
        at = begin + length


def warc_date(digits: str) -> str:
    """ISO form of 14 or 12 digits."""
    d = digits.ljust(14, "0")
    return f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z"


def record_id(name: str, offset: int, url: str, date: str) -> str:
    return f"urn:uuid:{uuid.uuid5(NAMESPACE, f'{name} {offset} {url} {date}')}"


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """HTTP header block (with its blank line) and payload."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    end = block.find(b"\r\n\r\n")
    return (block, b"") if end < 0 else (block[: end + 4], block[end + 4 :])


# -- WARC --------------------------------------------------------------------


def warc_record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in headers)
    return f"{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def convert(row: dict) -> bytes:
    """The WARC record of one ARC capture (a row of ARC_ROWS and ``refers_to_id``)."""
    revisit = row["refers_to_id"] is not None
    block = row["http"] if revisit else row["http"] + row["payload"]
    kind = "revisit" if revisit else "response" if row["http"] else "resource"
    mime = "application/http; msgtype=response" if row["http"] else row["mime"]
    headers = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<{row['record_id']}>"),
        ("WARC-Date", row["date"]),
        ("WARC-Target-URI", row["url"]),
        ("WARC-IP-Address", row["ip"]),
        ("Content-Type", mime),
        ("WARC-Payload-Digest", f"sha1:{row['digest']}"),
        ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"),
    ]
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{row['refers_to_id']}>"), ("WARC-Truncated", "length")]
    return warc_record(headers, block)


def parse_warc(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of one WARC record."""
    end = data.find(b"\r\n\r\n")
    lines = data[:end].decode("utf-8").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines[1:])
    length = int(headers["Content-Length"])
    block = data[end + 4 : end + 4 + length]
    if len(block) != length or data[end + 4 + length :] != b"\r\n\r\n":
        raise ValueError("WARC record of another length than declared")
    return headers, block


# -- files -------------------------------------------------------------------

MANIFEST = "path string, begin long, size long, records long"


def _open(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder)


def _writer(folder: str, suffix: str, rows: Iterator[dict], record, first=None):
    """Writes records to a new file; yields the manifest's rows."""
    system, base = _open(folder)
    system.create_dir(base, recursive=True)
    name = f"{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.{suffix}"
    out, at, begin, count = None, 0, 0, 0
    done = []

    def chunk():
        nonlocal begin, count
        if count:
            done.append((f"{base}/{name}", begin, at - begin, count))
        begin, count = at, 0

    try:
        for row in rows:
            if out is None:
                out = system.open_output_stream(f"{base}/{name}", compression=None)
            if first is not None and count == 0:  # each chunk can be read alone
                data = member(first(name))
                out.write(data)
                at += len(data)
            data = member(record(row, name, at))
            out.write(data)
            at += len(data)
            count += 1
            if at - begin >= CHUNK_BYTES:
                chunk()
        chunk()
    finally:
        if out is not None:
            out.close()
    if done:
        cols = list(zip(*done))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0]), *[pa.array(c, pa.int64()) for c in cols[1:]]], names=["path", "begin", "size", "records"])


def write_arc(df: DataFrame, folder: str, version: int = 1, date: str = "20240101000000") -> DataFrame:
    """Writes (key long, url, payload string) as ARC captures; the manifest."""

    bound_batches(df.sparkSession)

    def record(row, name, offset):
        body = (row["payload"] or "").encode("utf-8")
        key = "" if row["key"] is None else f"X-Capture-Key: {row['key']}\r\n"
        head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{key}Content-Length: {len(body)}\r\n\r\n"
        url = _unsafe.sub(lambda m: f"%{ord(m[0]):02X}", row["url"]) if row["url"] else "about:blank"
        return arc_record(version, url, "0.0.0.0", date, "text/html", 200, head.encode() + body, name, offset)

    def rows(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 100):
                yield from batch.slice(k, 100).to_pylist()

    out = df.select("key", "url", "payload").mapInArrow(lambda b: _writer(folder, "arc.gz", rows(b), record, lambda name: arc_version_block(version, name, date)), MANIFEST)
    return stage(out, "manifest")


def _chunks(folder: str, batches):
    system, _ = _open(folder)
    for batch in batches:
        for row in batch.to_pylist():
            with system.open_input_file(row["path"]) as f:
                f.seek(row["begin"])
                yield row, f.read(row["size"])


def _spread(manifest: DataFrame) -> DataFrame:
    """One chunk a task, as far as there are tasks."""
    n = manifest.count()
    return manifest.repartition(max(1, min(n, 10_000)), "path", "begin")


ARC_ROWS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("begin", T.LongType()),
        T.StructField("offset", T.LongType()),
        T.StructField("key", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("ip", T.StringType()),
        T.StructField("date", T.StringType()),
        T.StructField("mime", T.StringType()),
        T.StructField("record_id", T.StringType()),
        T.StructField("http", T.BinaryType()),
        T.StructField("payload", T.BinaryType()),
        T.StructField("digest", T.StringType()),
        T.StructField("size", T.LongType()),
    ]
)

_key = re.compile(rb"\r\nX-Capture-Key: (-?\d+)\r\n")


def _batches(rows: Iterator[tuple], types: list[pa.DataType], names: list[str], size: int = 4 << 20, weigh=lambda r: 100):
    held, weight = [], 0
    for r in rows:
        held.append(r)
        weight += weigh(r)
        if weight >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)
            held, weight = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), types)], names=names)


def _captures(chunk: dict, data: bytes) -> Iterator[tuple]:
    """Rows of ARC_ROWS of one chunk."""
    name = chunk["path"].rpartition("/")[2]
    task = name.partition("-")[0]
    fields = None
    for offset, content in members(data):
        for head, block, fields in parse_arc(content, fields):
            if "filedesc" in head:
                continue
            http, payload = split_http(block)
            key = _key.search(http)
            date = head["Archive-date"]
            place = chunk["begin"] + offset
            found = record_id(task, place, head["URL"], date)
            yield (
                *(chunk["path"], chunk["begin"], place, int(key[1]) if key else None),
                *(head["URL"], head["IP-address"], warc_date(date), head["Content-type"], found),
                *(http, payload, sha1_base32(payload), len(payload)),
            )


def read_arc(manifest: DataFrame, folder: str, blocks: bool = True) -> DataFrame:
    """Captures of the manifest's chunks, with WARC identifiers and dates, and
    ``size``, the payload's bytes.  Without ``blocks``, http and payload are null.
    """

    def rows(batches):
        for chunk, data in _chunks(folder, batches):
            for r in _captures(chunk, data):
                yield r if blocks else (*r[:9], None, None, *r[11:])

    types = [pa.string(), *[pa.int64()] * 3, *[pa.string()] * 5, pa.binary(), pa.binary(), pa.string(), pa.int64()]
    return _spread(manifest).mapInArrow(lambda b: _batches(rows(b), types, ARC_ROWS.names, weigh=lambda r: 500 + len(r[10] or b"")), ARC_ROWS)


def revisits(index: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """(path, begin, offset, refers_to_id): captures that repeat another's payload.

    ``index``: captures without their blocks.  Only digests that two captures or
    more share are joined back, on rows of some 100 bytes.
    """
    slim = index.where(F.col("size") >= revisit_bytes).select("path", "begin", "offset", "key", "record_id", "digest")
    best = (
        slim.groupBy("digest")
        .agg(F.max(F.struct("key", "record_id")).alias("best"), F.count("*").alias("n"))
        .where("n > 1")
        .select(F.col("digest").alias("_digest"), F.col("best.key").alias("_key"), F.col("best.record_id").alias("refers_to_id"))
    )
    joined = slim.join(best, F.col("digest") == F.col("_digest"))
    return joined.where(~F.col("key").eqNullSafe(F.col("_key"))).select("path", "begin", "offset", "refers_to_id")


def convert_archive(manifest: DataFrame, again: DataFrame, old: str, new: str) -> DataFrame:
    """Writes the manifest's captures as WARC records; the new manifest.

    ``again``: what ``revisits`` found.  Its rows go to their chunks, one row for
    each chunk of CHUNK_BYTES; each task reads a chunk and writes its records.
    """
    told = again.groupBy("path", "begin").agg(F.collect_list(F.struct("offset", "refers_to_id")).alias("told"))
    chunks = manifest.join(told, ["path", "begin"], "left").select(*manifest.columns, "told")

    def rows(batches):
        names = ARC_ROWS.names
        for chunk, data in _chunks(old, batches):
            refers = {x["offset"]: x["refers_to_id"] for x in chunk["told"] or ()}
            for r in _captures(chunk, data):
                row = dict(zip(names, r))
                row["refers_to_id"] = refers.get(row["offset"])
                yield row

    return stage(_spread(chunks).mapInArrow(lambda b: _writer(new, "warc.gz", rows(b), lambda row, name, at: convert(row)), MANIFEST), "manifest")


WARC_ROWS = "key long, record_id string, type string, url string, date string, payload_bytes long, payload_digest string, refers_to_id string"
_length = re.compile(rb"\r\nContent-Length: (\d+)\r\n")


def read_warc(manifest: DataFrame, folder: str) -> DataFrame:
    """Records of WARC files; payload length and digest as the records say.

    For records with a payload both are compared with the payload read.
    """

    def rows(batches):
        for _, data in _chunks(folder, batches):
            for _, content in members(data):
                head, block = parse_warc(content)
                http, payload = split_http(block)
                digest = head["WARC-Payload-Digest"].removeprefix("sha1:")
                refers = head.get("WARC-Refers-To")
                size = len(payload)
                if head["WARC-Type"] == "revisit":
                    declared = _length.search(http)
                    size = int(declared[1]) if declared else None
                elif sha1_base32(payload) != digest:
                    raise ValueError(f"payload digest of {head['WARC-Record-ID']} differs")
                key = _key.search(http)
                yield (
                    int(key[1]) if key else None,
                    head["WARC-Record-ID"][1:-1],
                    head["WARC-Type"],
                    head["WARC-Target-URI"],
                    head["WARC-Date"],
                    size,
                    base64.b32decode(digest).hex(),
                    refers[1:-1] if refers else None,
                )

    types = [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.string(), pa.string()]
    names = [x.split()[0] for x in WARC_ROWS.split(", ")]
    return _spread(manifest).mapInArrow(lambda b: _batches(rows(b), types, names), WARC_ROWS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    pages = pages.select(F.col("page_id").cast("long").alias("key"), "url", F.col("html").alias("payload"))
    old, new = new_path(spark, "arc"), new_path(spark, "warc")
    archive = write_arc(pages, old)
    again = stage(revisits(read_arc(archive, old, blocks=False)), "revisits")
    records = read_warc(convert_archive(archive, again, old, new), new)
    records = stage(records.select("key", "record_id", "type", "payload_bytes", "payload_digest", "refers_to_id"), "records")
    named = records.where("type <> 'revisit'").select(F.col("record_id").alias("_id"), F.col("key").alias("refers_to"))
    repeats = records.where("type = 'revisit'").join(named, F.col("refers_to_id") == F.col("_id"), "left").drop("_id")
    both = records.where("type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long")).unionByName(repeats)
    return both.select(F.col("key").alias("page_id"), "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to")


ORACLE = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS d FROM pages),
best AS (SELECT d, max(page_id) AS m FROM p WHERE n >= 1000 GROUP BY d)
SELECT p.page_id, CAST(n AS BIGINT) AS payload_bytes, p.d AS payload_digest,
  CASE WHEN n >= 1000 AND m <> p.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN n >= 1000 AND m <> p.page_id THEN m END AS refers_to
FROM p LEFT JOIN best ON p.d = best.d
"""
