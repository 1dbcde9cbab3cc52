"""WARC archives with an index: write records, then read selected ones by coalesced byte ranges.

Each task writes its own gzip-member-per-record archives below a folder that the cluster shares
(any filesystem that pyarrow opens) and emits one index row per record.  A retried task writes
new files and only the index rows of the attempt that succeeded are kept.  Reading groups the
selected records by archive and slot of ``SLOT`` bytes, sorts them by offset, merges ranges less
than ``GAP`` bytes apart and fetches each merged range once.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.llm.scratch import Tables, materialize, new_path, prepare, shuffle_partitions
from lectern.llm.skew import spread_join

SLOT, GAP, ROTATE = 4 << 20, 64 << 10, 256 << 20
#: Compressed bytes that one reading task is given.
READ = 64 << 20
#: Fixed values of the WARC format.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"
_NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
_INDEX = "page_id long, url string, digest string, payload_bytes long, record_type string, refers_to long, archive string, offset long, length long"
_RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _record_id(page_id: int | None, url: str | None = None, digest: str = "") -> str:
    """Of a response a page alone tells, so that revisits can name it; what shares a page_id or has none is told apart by more."""
    return f"<urn:uuid:{uuid.uuid5(_NAMESPACE, f'page:{page_id}:{digest}' if url is None else f'page:{page_id}:{digest}:{url}')}>"


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> tuple[bytes, str]:
    """One compressed record and its payload digest (upper-case base32 SHA-1)."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {_record_id(page_id, (url or '') if revisit or page_id is None else None, digest)}",
        f"WARC-Target-URI: {target}",
        f"WARC-Date: {DATE}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Length: {len(block)}",
        *([] if page_id is None else [f"X-Page-ID: {page_id}"]),
        *([f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, None, digest)}", f"X-Refers-To-Page-ID: {refers_to}"] if revisit else []),
    ]
    squeeze = zlib.compressobj(4, zlib.DEFLATED, 31)
    return squeeze.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + squeeze.flush(), digest


def decode_record(raw: bytes) -> dict:
    """Headers and payload of one compressed record; checks lengths and, for responses, the digest."""
    data = zlib.decompress(raw, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    named = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(named["Content-Length"])]
    if len(block) != int(named["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("record length differs from its header")
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    kind = named["WARC-Type"]
    digest = named["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError("payload differs from its digest")
    number = lambda name: int(named[name]) if name in named else None
    return {
        "page_id": number("X-Page-ID"),
        "url": named["WARC-Target-URI"],
        "payload_bytes": size,
        "payload_digest": digest,
        "record_type": kind,
        "refers_to": number("X-Refers-To-Page-ID"),
        "payload": payload if kind == "response" else None,
    }


def _writer(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        out = name = None
        at = 0
        for batch in batches:
            rows = {c: [] for c in ("page_id", "url", "digest", "payload_bytes", "record_type", "refers_to", "archive", "offset", "length")}
            for page_id, url, payload, refers_to, revisit in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                    out = store.open_output_stream(f"{root}/{name}", compression=None)
                raw, digest = encode_record(page_id, url, payload, refers_to, revisit)
                out.write(raw)
                for c, v in zip(rows, (page_id, url, digest, len(payload), "revisit" if revisit else "response", refers_to if revisit else None, name, at, len(raw)), strict=True):
                    rows[c].append(v)
                at += len(raw)
                if at >= ROTATE:
                    out.close()
                    out = None
            longs = {"page_id", "payload_bytes", "refers_to", "offset", "length"}
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64() if c in longs else pa.string()) for c, v in rows.items()], names=list(rows))
        if out is not None:
            out.close()

    return run


def write_archives(pages: DataFrame, folder: str | None = None, min_revisit_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> tuple[DataFrame, str]:
    """Writes a record per row; returns the index table and the archives' folder.

    The payload is the page in UTF-8 (null: empty).  Among records with equal payloads of at
    least ``min_revisit_bytes`` bytes those with the smallest page_id are responses and the
    others revisits of it; smaller payloads are all responses.  Rows that repeat the smallest
    page_id are all responses.  A null page_id is never the smallest unless all are null, and
    then all are responses.  A record's id is made of page_id and payload digest (and URL, for revisits
    and null page_ids), so only records alike in all of these share one.  A null URL is written as empty.  Other columns are ignored; an empty
    table writes no archive.
    """
    spark = pages.sparkSession
    prepare(spark)
    if folder is None:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(new_path(spark, "warc"))
        target = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        target.mkdirs(path)
        folder = target.makeQualified(path).toUri().toString()
        folder = folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder
    payload = F.coalesce(F.col(html_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sum", F.unhex(F.sha1("payload")))
    # Digests are compared without their payloads, and those of a frequent payload by several tasks;
    # a payload then moves once, by page and digest.
    keys = rows.where(F.octet_length("payload") >= min_revisit_bytes).groupBy("page_id", "sum").agg(F.count(F.lit(1)).alias("rows"))
    with Tables(spark) as tables:
        keys = tables.write(keys, "warc-keys")
        least = keys.groupBy("sum").agg(F.min("page_id").alias("refers_to"), F.sum("rows").alias("n"), F.count(F.lit(1)).alias("weight"))
        least = tables.write(least.where("n > 1 AND refers_to IS NOT NULL"), "warc-least")
        again = spread_join(keys.select("page_id", "sum"), least.select("sum", "refers_to"), least.select("sum", "weight"), "sum", "page_id")
        again = again.where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select(F.col("page_id").alias("again_id"), F.col("sum").alias("again_sum"), "refers_to")
        joined = rows.join(again, rows["page_id"].eqNullSafe(again["again_id"]) & (rows["sum"] == again["again_sum"]), "left")
        index = joined.select("page_id", "url", "payload", "refers_to", F.col("refers_to").isNotNull().alias("revisit")).mapInArrow(_writer(folder), _INDEX)
        return materialize(index, "warc-index"), folder


def _reader(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for archive, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                wanted = sorted((w["offset"], w["length"]) for w in wanted)
                with store.open_input_file(f"{root}/{archive}") as source:
                    for group in coalesce(wanted):
                        start = group[0][0]
                        source.seek(start)
                        block = source.read(group[-1][0] + group[-1][1] - start)
                        found = [decode_record(block[at - start : at - start + n]) for at, n in group]
                        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in found], t) for c, t in zip(found[0], types, strict=True)], names=list(found[0]))

    return run


def coalesce(ranges: list[tuple[int, int]], gap: int = GAP) -> list[list[tuple[int, int]]]:
    """Sorted (offset, length) ranges in groups that are read at once."""
    out: list[list[tuple[int, int]]] = []
    for at, n in ranges:
        if out and at - (out[-1][-1][0] + out[-1][-1][1]) <= gap:
            out[-1].append((at, n))
        else:
            out.append([(at, n)])
    return out


def read_records(index: DataFrame, folder: str, where: Column | None = None) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload) of selected records.

    ``where`` selects on the index (url, digest, page_id, ...).  A revisit's size and digest are
    those of the full payload; its payload is null, to be had from the record it refers to.
    """
    chosen = index if where is None else index.where(where)
    # An index row stands for many bytes, so tasks are dealt by what is to be read and not by the rows' own size.
    size = chosen.agg(F.sum("length").alias("n")).first()["n"] or 0
    tasks = max(1, -(-size // READ), min(shuffle_partitions(index.sparkSession), -(-size // (READ >> 4))))
    slots = chosen.select("archive", F.floor(F.col("offset") / SLOT).alias("slot"), "offset", "length").repartition(tasks, "archive", "slot")
    ranges = slots.groupBy("archive", "slot").agg(F.collect_list(F.struct("offset", "length")).alias("wanted"))
    return ranges.select("archive", "wanted").mapInArrow(_reader(folder), _RECORD)
