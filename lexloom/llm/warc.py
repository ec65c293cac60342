"""WARC archives: written once, indexed first, read back by coalesced byte ranges.

Every task writes archives of its own into one shared folder, each record a gzip member, and returns
an index row for each record: archive, offset, length, url, digest. The index is written as a table
before anything is read. Archives that no index row names come from lost attempts and are ignored,
so a task can be repeated at any time.

Of records with equal payloads of at least ``least_bytes`` bytes the one with the smallest page_id
is the response; the others revisit it. Null payloads are empty; null ids sort last; of rows
repeated with one id and payload the first is the response; a null url leaves its header out. Other
columns are not archived.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_LAST = (1 << 63) - 1
_NAMES = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_INDEX = pa.schema(
    [
        ("archive", pa.string()),
        ("offset", pa.int64()),
        ("length", pa.int64()),
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("digest", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
    ]
)
_INDEX_DDL = "archive string, offset long, length long, page_id long, url string, digest string, record_type string, refers_to long"
_READ_DDL = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
_IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _record_id(page: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(_NAMES, f'{page} {digest}')}>"


def record(page: int | None, url: str | None, payload: bytes, revisits: tuple | None, date: str) -> bytes:
    """One WARC record. ``revisits`` holds the page_id of the response for a revisit."""
    digest = digest_of(payload)
    head = [("WARC-Type", "revisit" if revisits else "response"), ("WARC-Record-ID", _record_id(page, digest)), ("WARC-Date", date)]
    if url is not None:
        head.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~-._|{}^`\"<>\\")))
    head += [("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload)))]
    if page is not None:
        head.append(("X-Page-Id", str(page)))
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if revisits:
        head += [("WARC-Profile", _IDENTICAL), ("WARC-Refers-To", _record_id(revisits[0], digest))]
        if revisits[0] is not None:
            head.append(("X-Refers-To-Page-Id", str(revisits[0])))
        body += b"\r\n"
    else:
        body += b"Content-Length: %d\r\n\r\n" % len(payload) + payload
    head += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(body)))]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in head) + b"\r\n" + body + b"\r\n\r\n"


def parsed(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record (empty for a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    headers = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    block = rest[: int(headers["Content-Length"])]
    if len(block) != int(headers["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError(f"record {headers.get('WARC-Record-ID')} is cut short")
    return headers, block.partition(b"\r\n\r\n")[2]


def _writer(folder: str, date: str, roll_bytes: int):
    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        task = TaskContext.get()
        name, out, before = None, None, None
        count = at = 0
        for batch in batches:
            rows = []
            columns = (batch.column(k).to_pylist() for k in ("key", "page_id", "url", "html", "response_key", "content"))
            for key, page, url, html, response_key, content in zip(*columns):
                if out is None or at >= roll_bytes:
                    if out is not None:
                        out.close()
                    name = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{count:04d}.warc.gz"
                    out, at, count = store.open_output_stream(f"{root}/{name}", compression=None), 0, count + 1
                payload = (html or "").encode("utf-8", "surrogatepass")
                revisits = None
                if response_key is not None and (response_key != key or before == (key, content)):
                    revisits = (None if response_key == _LAST else response_key,)
                before = (key, content)
                press = zlib.compressobj(6, zlib.DEFLATED, 31)
                raw = press.compress(record(page, url, payload, revisits, date)) + press.flush()
                out.write(raw)
                kind = "revisit" if revisits else "response"
                rows.append((name, at, len(raw), page, url, digest_of(payload), kind, revisits[0] if revisits else None))
                at += len(raw)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _INDEX)], schema=_INDEX)
        if out is not None:
            out.close()

    return run


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 0, date: str = "1970-01-01T00:00:00Z", roll_bytes: int = 1 << 30) -> DataFrame:
    """Archives the rows of ``pages`` below ``folder``; returns the index, stored in ``folder``/index."""
    rows = pages.select(
        F.coalesce(F.col("page_id").cast("long"), F.lit(_LAST)).alias("key"),
        F.col("page_id").cast("long").alias("page_id"),
        F.col("url").cast("string").alias("url"),
        F.col("html").cast("string").alias("html"),
        F.sha2(F.coalesce(F.col("html").cast("string"), F.lit("")), 256).alias("content"),
        F.coalesce(F.octet_length("html"), F.lit(0)).alias("n"),
    )
    equal = (
        rows.filter(F.col("n") >= least_bytes).groupBy("content")
        .agg(F.min("key").alias("response_key"), F.count(F.lit(1)).alias("copies")).filter("copies > 1").drop("copies")
    )
    # Only ids and digests meet by content, where a hot payload may be split; the pages move by id.
    known = rows.select("key", "content").join(equal, "content").distinct()
    # Repeated rows meet in one task, which neither a broadcast nor a split of skewed partitions may change.
    (
        rows.repartition("key", "content").join(known, ["key", "content"], "left")
        .sortWithinPartitions("key", "content")
        .select("key", "page_id", "url", "html", "response_key", "content")
        .mapInArrow(_writer(f"{folder}/archives", date, roll_bytes), _INDEX_DDL)
        .write.mode("overwrite").parquet(f"{folder}/index")
    )
    return pages.sparkSession.read.schema(_INDEX_DDL).parquet(f"{folder}/index")


def _ranges(entries, gap: int, most: int):
    """Runs of (archive, offset, length) entries that lie close enough to be read at once."""
    run: list = []
    for entry in entries:
        if run and (
            entry[0] != run[0][0] or entry[1] - run[-1][1] - run[-1][2] > gap or entry[1] + entry[2] - run[0][1] > most
        ):
            yield run
            run = []
        run.append(entry)
    if run:
        yield run


def _reader(folder: str, gap: int, most: int):
    def run(batches):
        store, root = fs.FileSystem.from_uri(folder)
        name, source = None, None
        for batch in batches:
            entries = zip(*(batch.column(k).to_pylist() for k in ("archive", "offset", "length", "digest")))
            for near in _ranges(entries, gap, most):
                if near[0][0] != name:
                    name, source = near[0][0], store.open_input_file(f"{root}/{near[0][0]}")
                start = near[0][1]
                block = source.read_at(near[-1][1] + near[-1][2] - start, start)
                out = []
                for _, offset, length, digest in near:
                    headers, payload = parsed(zlib.decompress(block[offset - start : offset - start + length], 31))
                    said = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    response = headers["WARC-Type"] == "response"
                    if said != digest or response and (said != digest_of(payload) or len(payload) != int(headers["X-Payload-Length"])):
                        raise ValueError(f"{name} at {offset}: the payload differs from the index")
                    number = lambda k, h=headers: re.fullmatch(r"-?\d+", h.get(k, "")) and int(h[k])
                    out.append((number("X-Page-Id"), headers.get("WARC-Target-URI"), headers["WARC-Type"], number("X-Refers-To-Page-Id"), number("X-Payload-Length"), said, payload if response else None))
                types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]
                names = [c.split()[0] for c in _READ_DDL.split(", ")]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names=names)

    return run


def read_records(selected: DataFrame, folder: str, gap: int = 64 << 10, most: int = 8 << 20, task_bytes: int = 32 << 20) -> DataFrame:
    """The records of the ``selected`` index rows, in as many tasks as their bytes ask for.

    Index rows are sorted by place; ranges at most ``gap`` bytes apart are read together, at most
    ``most`` bytes (or one record) at a time. ``payload`` is null for revisits, see ``payloads``.
    """
    spark = selected.sparkSession
    total = selected.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // task_bytes))
    return (
        selected.select("archive", "offset", "length", "digest")
        .repartitionByRange(tasks, "archive", "offset").sortWithinPartitions("archive", "offset")
        .mapInArrow(_reader(f"{folder}/archives", gap, most), _READ_DDL)
    )


def payloads(records: DataFrame) -> DataFrame:
    """Records with the payload of every revisit filled in from the response it refers to."""
    responses = records.filter("record_type = 'response'")
    found = responses.select(F.col("page_id").alias("refers_to"), F.col("payload_digest").alias("_digest"), F.col("payload").alias("_found"))
    revisits = records.filter("record_type = 'revisit'").drop("payload")
    same = revisits.refers_to.eqNullSafe(found.refers_to) & (revisits.payload_digest == found._digest)
    filled = revisits.join(found, same).select(*(revisits[c] for c in revisits.columns), F.col("_found").alias("payload"))
    return responses.unionByName(filled)
