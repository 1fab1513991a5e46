"""Operator 3: WARC archives, written in parallel and read by a splittable reader.

Each record is a gzip member of its own. Tasks of the reader get byte ranges; a task looks for the gzip
magic in its range, validates each candidate by decoding a WARC header from it, and owns the records that
start inside its range, reading past the range's end to finish the last one. So one huge archive is read by
many tasks, and no index is needed.

Files are written below the shared folder under a name of the attempt and renamed when whole, so a lost
executor or a speculative copy leaves no half-written archive under a final name; archives of an attempt
that did not win are never listed, as the names come from the tasks' results.

Defined results: a null id is written as none and read back as null, its record is a response; a null payload is empty; equal payloads of at least ``least`` bytes make one response (the
largest id, ids of rows being unique) and revisits that refer to it; an id that repeats gives a record each
time; an empty table gives no archive; a payload of any length is one record, of which a task holds some three copies; extra columns are dropped.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, new_path, small_batches

#: Production parameters: bytes of a split, of an archive file at most (about), and of a payload that may be revisited.
SPLIT_BYTES, FILE_BYTES, LEAST_REVISITED = 16 << 20, 256 << 20, 1000
GZIP_MAGIC = b"\x1f\x8b\x08"
_HEAD = "WARC/1.1"


def _store(uri: str) -> tuple:
    """A file system that executors reach by the URI alone, and the path in it."""
    from pyarrow import fs

    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = f"file://{uri[5:]}"
    return fs.FileSystem.from_uri(uri)


def record(kind: str, uri: str, key: int | None, payload: bytes, digest: str, refers_to: int | None, full_bytes: int) -> bytes:
    """One WARC/1.1 record; a revisit has the digest of the full payload and no payload of its own."""
    fields = [
        ("WARC-Type", kind),
        ("WARC-Record-ID", f"<urn:page:{'' if key is None else key}>"),
        ("WARC-Date", "2000-01-01T00:00:00Z"),
        ("WARC-Target-URI", uri.replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("X-Payload-Length", str(full_bytes)),
    ]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    fields += [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", str(len(payload)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"{_HEAD}\r\n{head}\r\n".encode() + payload + b"\r\n\r\n"


def member(data: bytes, level: int = 1) -> bytes:
    pack = zlib.compressobj(level, zlib.DEFLATED, 31)
    return pack.compress(data) + pack.flush()


def verdicts(pages: DataFrame, key: str = "page_id", payload: str = "html", least: int = LEAST_REVISITED) -> DataFrame:
    """``pages`` with digest, payload_bytes, record_type and refers_to.

    Groups are reduced to their largest id before the shuffle; only small columns are joined by digest, where
    one digest may hold a third of the rows (the join splits it at run time).
    """
    body = F.coalesce(F.col(payload), F.lit(""))
    marked = pages.select(F.col(key).alias("key"), F.sha1(body).alias("digest"), F.octet_length(body).cast("long").alias("payload_bytes"))
    groups = marked.filter(F.col("payload_bytes") >= least).groupBy("digest", "payload_bytes").agg(F.max("key").alias("best"), F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    repeats = marked.join(groups, ["digest", "payload_bytes"]).filter("key <> best").groupBy("key", "digest").agg(F.first("best").alias("refers_to"))
    return repeats.select("key", "digest", "refers_to")


def write(pages: DataFrame, key: str = "page_id", uri: str = "url", payload: str = "html", least: int = LEAST_REVISITED, file_bytes: int = FILE_BYTES) -> DataFrame:
    """Write every row as a record; returns the archives: path, bytes, records."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = new_path(spark, "warc")
    body = F.coalesce(F.col(payload), F.lit(""))
    rows = pages.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(uri), F.lit("")).alias("uri"), body.alias("payload"), F.sha1(body).alias("digest"))
    rows = rows.join(verdicts(pages, key, payload, least), ["key", "digest"], "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _store(folder)
        store.create_dir(root, recursive=True)
        out, done, name, size, n = None, [], "", 0, 0

        def close() -> None:
            out.close()
            store.move(f"{root}/_{name}", f"{root}/{name}")
            done.append((f"{folder}/{name}", size, n))

        for batch in batches:
            for k, u, p, d, r in zip(*(batch.column(c) for c in ("key", "uri", "payload", "digest", "refers_to")), strict=True):
                if out is None:
                    name, size, n = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{root}/_{name}", compression=None)
                data, to = p.as_py().encode("utf-8"), r.as_py()
                packed = member(record("response" if to is None else "revisit", u.as_py(), k.as_py(), data if to is None else b"", d.as_py(), to, len(data)))
                out.write(packed)
                size, n = size + len(packed), n + 1
                if size >= file_bytes:
                    close()
                    out = None
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], pa.string()), pa.array([x[1] for x in done], pa.int64()), pa.array([x[2] for x in done], pa.int64())], names=["path", "bytes", "records"])

    return materialise(rows.select("key", "uri", "payload", "digest", "refers_to").mapInArrow(run, "path string, bytes bigint, records bigint"), "warc-files")


def splits(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Byte ranges of the archives: path, first, last (exclusive), size."""
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0).cast("long")), F.lit(split_bytes).cast("long"))).alias("first")
    return files.filter("bytes > 0").select("path", "bytes", starts).withColumn("last", F.least(F.col("first") + split_bytes, F.col("bytes")))


def parse_head(head: bytes) -> dict[str, str] | None:
    """The named fields of a WARC header block, or None if it is none."""
    lines = head.split(b"\r\n")
    if not lines[0].startswith(b"WARC/1."):
        return None
    out = {}
    for line in lines[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        out[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    return out if "content-length" in out and out["content-length"].isdigit() else None


class _Window:
    """Forward reads of a file in pieces."""

    def __init__(self, file: pa.NativeFile, size: int, piece: int = 1 << 20) -> None:
        self.file, self.size, self.piece, self.at, self.data = file, size, piece, 0, b""

    def get(self, pos: int, n: int) -> bytes:
        if pos < self.at or pos + n > self.at + len(self.data):
            self.file.seek(pos)
            self.at, self.data = pos, self.file.read(min(max(n, self.piece), self.size - pos))
        return self.data[pos - self.at : pos - self.at + n]


def members(file: pa.NativeFile, size: int, first: int, last: int, piece: int = 1 << 16) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header and block of each record whose member starts in [first, last)."""
    window, pos = _Window(file, size), first
    while pos < last:
        near = window.get(pos, min(piece, last + 2 - pos, size - pos))
        hit = near.find(GZIP_MAGIC)
        if hit < 0:
            if pos + len(near) >= min(last + 2, size):
                return
            pos += max(1, len(near) - 2)
            continue
        start = pos + hit
        if start >= last:
            return
        got = _decode(window, start, size)
        if got is None:  # the magic inside compressed data
            pos = start + 1
            continue
        fields, block, pos = got
        yield fields, block


def _decode(window: _Window, start: int, size: int, piece: int = 1 << 16) -> tuple[dict[str, str], bytes, int] | None:
    """A record of the member at ``start`` and where the member ends; None if no WARC header decodes there."""
    unpack, out, at, fields, begin = zlib.decompressobj(31), io.BytesIO(), start, None, 0
    try:
        while not unpack.eof:
            if at >= size:
                return None
            data = window.get(at, min(piece, size - at))
            out.write(unpack.decompress(data))
            at += len(data)
            if fields is None:
                seen = out.getvalue()
                if not b"WARC/1.".startswith(seen[:7]) and not seen.startswith(b"WARC/1."):
                    return None
                end = seen.find(b"\r\n\r\n")
                if end >= 0:
                    fields, begin = parse_head(seen[:end]), end + 4
                    if fields is None:
                        return None
    except zlib.error:
        return None
    length = int(fields["content-length"]) if fields else -1
    block = out.getvalue()[begin : begin + length] if fields else b""
    return (fields, block, at - len(unpack.unused_data)) if fields and len(block) == length else None


def read(files: DataFrame, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Every record of the archives: page_id, uri, record_type, refers_to, payload_digest, payload_bytes, payload (null: revisit), digest_ok.

    A revisit is sound, and has its length, by the response that it refers to, as read back; without one of that id
    and digest, digest_ok is false and payload_bytes null.
    """
    ranges = splits(files, split_bytes)
    ranges = ranges.repartition(max(1, min(10_000, ranges.count())))

    def number(urn: str | None) -> int | None:
        digits = urn.strip("<>").rpartition(":")[2] if urn else ""
        return int(digits) if digits else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "uri", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload", "digest_ok"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.bool_()]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)

        for batch in batches:
            for part in batch.to_pylist():
                store, path = _store(part["path"])
                with store.open_input_file(path) as file:
                    rows, held = [], 0
                    for f, block in members(file, part["bytes"], part["first"], part["last"]):
                        revisit = f["warc-type"] == "revisit"
                        digest = f["warc-payload-digest"].removeprefix("sha1:")
                        n_bytes = None if revisit else len(block)
                        computed = digest if revisit else hashlib.sha1(block).hexdigest()
                        rows.append((number(f["warc-record-id"]), f.get("warc-target-uri"), f["warc-type"], number(f.get("warc-refers-to")), computed, n_bytes, None if revisit else block, computed == digest))
                        held += len(block)
                        if held > 4 << 20 or len(rows) >= 1000:
                            yield batch_of(rows)
                            rows, held = [], 0
                    if rows:
                        yield batch_of(rows)

    records = ranges.mapInArrow(run, "page_id bigint, uri string, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary, digest_ok boolean")
    # payloads are not shuffled: what the join needs is written without them
    slim = materialise(records.drop("payload"), "warc-records")
    there = slim.filter("record_type <> 'revisit'").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("there"))
    revisits = slim.filter("record_type = 'revisit'").join(there, ["refers_to", "payload_digest"], "left")
    revisits = revisits.withColumns({"payload_bytes": F.col("there"), "payload": F.lit(None).cast("binary"), "digest_ok": F.col("there").isNotNull()})
    return records.filter("record_type <> 'revisit'").unionByName(revisits.select(*records.columns))
