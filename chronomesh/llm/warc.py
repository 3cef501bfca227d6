"""WARC archives: one gzip member a record, payload deduplication, a splittable reader.

The reader never looks up an index.  A task owns the records whose gzip member
starts inside its byte range: it looks for gzip magic, decodes the head of each
candidate member, and takes the first that opens with a WARC version line; from
there each member's end gives the next member's start.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import file_system, scratch, stored, table

MAGIC = b"\x1f\x8b\x08"
RECORD = "page_id bigint, url string, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
BLOCK = 1 << 20


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def one_line(text: str | None) -> str:
    """A header value must not hold line ends; they are percent-encoded as in a URL."""
    return (text or "").replace("\r", "%0D").replace("\n", "%0A")


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """An uncompressed WARC/1.1 record; a revisit keeps the HTTP head and leaves out the payload."""
    http = (
        "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
        f"Content-Length: {len(payload)}\r\n\r\n"
    ).encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {one_line(url)}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}",
        f"Content-Type: application/http; msgtype=response\r\nContent-Length: {len(block)}",
    ]
    if revisit:
        head[2:2] = [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: <urn:page:{refers_to}>",
        ]
    return ("\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """Fields of one decompressed record; the payload of a response is measured, not trusted."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    field = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(field["content-length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    kind = field["warc-type"]
    digest = field["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response":
        size = len(payload)
        if base32_sha1(payload) != digest:
            raise ValueError(f"payload of {field['warc-record-id']} does not match its digest")
    else:
        size = next(int(x.partition(b":")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))

    def of(urn: str | None) -> int | None:
        own = (urn or "").removeprefix("<urn:page:").removesuffix(">")
        return int(own) if own else None

    return {
        "page_id": of(field["warc-record-id"]), "url": field["warc-target-uri"], "payload_bytes": size,
        "payload_digest": digest, "record_type": kind, "refers_to": of(field.get("warc-refers-to")),
        "payload": payload if kind == "response" else None,
    }


def owned_records(stream, start: int, end: int, size: int) -> Iterator[bytes]:
    """Decompressed records whose member starts in [start, end) of a seekable file of ``size`` bytes."""
    at, buffer = start, b""  # buffer holds the file from at on

    def more() -> bool:
        nonlocal buffer
        stream.seek(at + len(buffer))
        got = stream.read(BLOCK)
        buffer += got
        return bool(got)

    def opens() -> bool:
        """Whether a member that opens a WARC record begins at ``at``."""
        while len(buffer) < 512 and at + len(buffer) < size and more():
            pass
        if not buffer.startswith(MAGIC) or len(buffer) < 18 or buffer[3] & 0xE0:
            return False
        try:
            return zlib.decompressobj(31).decompress(buffer, 64).startswith(b"WARC/1.")
        except zlib.error:
            return False

    while at < end:
        found = buffer.find(MAGIC)
        if found < 0:
            keep = min(2, len(buffer))
            at, buffer = at + len(buffer) - keep, buffer[len(buffer) - keep:]
            if not more():
                return
            continue
        at, buffer = at + found, buffer[found:]
        if at >= end:
            return
        if not opens():
            at, buffer = at + 1, buffer[1:]
            continue
        while at < end:  # in step with the members
            engine, parts = zlib.decompressobj(31), []
            while not engine.eof:
                if not buffer:
                    if not more():
                        raise EOFError(f"member at {at} is cut off")
                parts.append(engine.decompress(buffer))
                at += len(buffer) - len(engine.unused_data)
                buffer = engine.unused_data
            yield b"".join(parts)
            if not buffer and not more():
                return
            if at < end and not opens():
                break  # padding or junk between members: look for magic again


def choose_types(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, refers_to: null marks a response.

    Of equal payloads of at least ``min_bytes`` the smallest page_id is the
    response.  Digests are counted with map-side combine, and only repeated ones are joined
    back; a digest with a third of the rows sits on the one side that AQE can split.
    """
    own = pages.select(
        "page_id", F.col("url").cast("string").alias("url"),
        F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha1("payload"))
    many = (
        own.where(F.octet_length("payload") >= min_bytes).groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    )
    return own.join(many, "digest", "left").select(
        "page_id", "url", "payload",
        F.when(F.col("page_id") > F.col("first"), F.col("first")).alias("refers_to"),
    )


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, level: int = 6) -> DataFrame:
    """Write ``pages`` (page_id, url, html) as .warc.gz files into ``folder``; returns their manifest.

    A task writes under a name of its own attempt; the manifest lists the files of the
    attempts that ended well, so a lost executor leaves an unlisted file at most.
    Null html is an empty payload, a null page_id an empty record id (always a
    response); rows that repeat the smallest page_id of their payload are responses too.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = file_system(folder)
        name = f"{root}/pages-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, n, size = None, 0, 0
        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    store.create_dir(root)
                    out = store.open_output_stream(name, compression=None)
                refers = row["refers_to"]
                raw = record_bytes(row["page_id"], row["url"], bytes(row["payload"]), refers, refers is not None)
                engine = zlib.compressobj(level, zlib.DEFLATED, 31)
                for part in (engine.compress(raw), engine.flush()):
                    size += len(part)
                    out.write(part)
                n += 1
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict(
                {"file": [f"{folder}/{name.rpartition('/')[2]}"], "bytes": [size], "records": [n]}
            )

    return choose_types(pages, min_bytes).mapInArrow(write, "file string, bytes bigint, records bigint")


def read_archives(manifest: DataFrame, split_bytes: int = 4 << 20, with_payload: bool = False) -> DataFrame:
    """Records of the files in ``manifest`` (file, bytes), read in ranges of ``split_bytes``."""
    fields = RECORD + (", payload binary" if with_payload else "")
    names = [x.split()[0] for x in fields.split(", ")]
    types = dict(zip(names, [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()], strict=False))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for split in batch.to_pylist():
                store, path = file_system(split["file"])
                with store.open_input_file(path) as stream:
                    rows, held = [], 0
                    for raw in owned_records(stream, split["start"], min(split["start"] + split_bytes, split["bytes"]), split["bytes"]):
                        record = parse_record(raw)
                        rows.append(record)
                        held += 200 + (len(raw) if with_payload else 0)
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], types[k]) for k in names})
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pydict({k: pa.array([r[k] for r in rows], types[k]) for k in names})

    splits = manifest.where("bytes > 0").select(
        "file", "bytes", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long"))).alias("start")
    )
    spark = manifest.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return splits.repartition(n, "file", "start").mapInArrow(read, fields)


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "warc")
    manifest, _ = stored(write_archives(table(spark, sf_dir, "pages"), folder), "manifest")
    return read_archives(manifest).drop("url")
