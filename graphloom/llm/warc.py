"""Operator 3: WARC archives as seekable Zstandard bundles.

Records are grouped into frames of about FRAME_BYTES that decompress on their own; frames are
appended to a bundle until it has BUNDLE_BYTES, and a skippable frame at its end holds the
seek table (compressed and plain size of each frame). An index maps each record id to bundle,
frame and offset in the frame, so one record costs one frame to read.

Of records with equal payloads of at least MIN_REVISIT bytes, the one with the smallest page id
is a response, the others are revisits of it; smaller payloads are always responses.

Nulls: null html is an empty payload; a null url has no WARC-Target-URI; a null page id is never
the smallest, so a row with one is a revisit if its payload has another page id, else a response.
Rows that repeat the smallest page id are all responses. Line breaks in a url are percent-encoded.
An empty table makes no bundle; columns other than page_id, url and html are not read. Each attempt of a
task writes bundles under names of its own, and only the attempt that Spark commits is in the index, so
what a lost or slower attempt leaves is never read.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import shared_dir, small_batches, table

MIN_REVISIT = 100
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 64 << 20
#: Bundles that a reading task takes at most, about.
BUNDLES_PER_TASK = 8
LEVEL = 3
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"
INDEX = "record_id string, page_id long, bundle string, frame int, offset long, length long"
RECORD = "record_id string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
SPACE = uuid.uuid5(uuid.NAMESPACE_URL, "urn:graphloom:warc")


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(SPACE, f'{page_id}|{digest}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """A response with its payload, or a revisit with the response's HTTP header only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http + payload if refers_to is None else http
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha256:{digest}")
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes, at: int = 0) -> tuple[tuple, int]:
    """The record at an offset, as a row of RECORD, and where the next one begins."""
    end = data.index(b"\r\n\r\n", at)
    head = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
    body = end + 4
    stop = body + int(head["Content-Length"])
    mark = data.index(b"\r\n\r\n", body)
    size = int(data[body:mark].rpartition(b"Content-Length: ")[2])
    digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
    payload = data[mark + 4 : stop] if head["WARC-Type"] == "response" else None
    if payload is not None and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"{head['WARC-Record-ID']}: payload doesn't match its digest")
    number = lambda k: int(head[k]) if k in head else None
    return (head["WARC-Record-ID"], number("X-Page-ID"), head.get("WARC-Target-URI"), head["WARC-Type"], number("X-Refers-To-Page-ID"), size, digest, payload), stop + 4


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", *f) for f in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(f) -> list[tuple[int, int, int]]:
    """(start, compressed, plain) of each frame."""
    size = f.size()
    f.seek(size - 9)
    n, _, magic = struct.unpack("<IBI", f.read(9))
    if magic != SEEKABLE:
        raise ValueError("not a seekable bundle")
    f.seek(size - 9 - 8 * n)
    sizes, out, at = struct.unpack(f"<{2 * n}I", f.read(8 * n)), [], 0
    for k in range(n):
        out.append((at, sizes[2 * k], sizes[2 * k + 1]))
        at += sizes[2 * k]
    return out


def opened(uri: str) -> tuple[pafs.FileSystem, str]:
    if "://" in uri or uri.startswith("file:"):
        return pafs.FileSystem.from_uri(uri if "://" in uri else uri.replace("file:", "file://", 1))
    return pafs.LocalFileSystem(), uri


def as_batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    """Rows as Arrow, which keeps every digit of a number next to a null."""
    kinds = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    fields = [x.split() for x in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([row[k] for row in rows], kinds[kind]) for k, (_, kind) in enumerate(fields)], [name for name, _ in fields])


class Bundle:
    """Writes frames to a file that gets its name when it is whole."""

    def __init__(self, folder: str, name: str):
        self.fs, self.folder = opened(folder)
        self.name, self.temp = f"{self.folder}/{name}", f"{self.folder}/.{name}.{uuid.uuid4().hex}"
        self.out, self.frames, self.bytes = self.fs.open_output_stream(self.temp), [], 0
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)

    def add(self, plain: bytes) -> None:
        packed = self.packer.compress(plain)
        self.out.write(packed)
        self.frames.append((len(packed), len(plain)))
        self.bytes += len(packed)

    def close(self) -> None:
        self.out.write(seek_table(self.frames))
        self.out.close()
        self.fs.move(self.temp, self.name)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write one record per row of pages (page_id, url, html) and return the index, itself
    kept in folder/index."""
    body = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url"), body.alias("payload")).withColumns({"size": F.octet_length("payload").cast("long"), "digest": F.sha2("payload", 256)})
    first = rows.filter(F.col("size") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1 and first is not null").drop("n")
    revisit = (F.col("size") >= MIN_REVISIT) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = rows.join(first, "digest", "left").select("page_id", "url", F.when(revisit, F.lit(None)).otherwise(F.col("payload")).alias("payload"), "size", "digest", F.when(revisit, F.col("first")).alias("refers_to"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, name, plain, index = None, "", bytearray(), []

        def flush(last: bool) -> pa.RecordBatch | None:
            nonlocal bundle, index
            if plain:
                bundle.add(bytes(plain))
                plain.clear()
            if bundle is None or not (last or bundle.bytes >= BUNDLE_BYTES):
                return None
            bundle.close()
            out, bundle, index = as_batch(index, INDEX), None, []
            return out

        for batch in batches:
            for page, url, payload, size, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "payload", "size", "digest", "refers_to")), strict=True):
                if bundle is None:  # attempts of one task never share a bundle
                    name = f"bundle-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.zst"
                    bundle = Bundle(folder, name)
                data = record(page, url, payload or b"", size, digest, refers)
                index.append((record_id(page, digest), page, name, len(bundle.frames), len(plain), len(data)))
                plain += data
                if len(plain) >= FRAME_BYTES and (out := flush(False)) is not None:
                    yield out
        if (out := flush(True)) is not None:
            yield out

    fs, at = opened(folder)
    fs.create_dir(at, recursive=True)
    rows.mapInArrow(write, INDEX).write.mode("overwrite").parquet(f"{folder}/index")
    return pages.sparkSession.read.schema(INDEX).parquet(f"{folder}/index")


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """All records of the bundles that the index names, frame by frame."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpacker = zstandard.ZstdDecompressor()
        fs, at = opened(folder)
        for batch in batches:
            for name in batch.column("bundle").to_pylist():
                with fs.open_input_file(f"{at}/{name}") as f:
                    for start, packed, plain in read_seek_table(f):
                        f.seek(start)
                        data, pos, out = unpacker.decompress(f.read(packed), max_output_size=plain), 0, []
                        while pos < len(data):
                            row, pos = parse(data, pos)
                            out.append(row)
                        yield as_batch(out, RECORD)

    bundles = index.select("bundle").distinct()
    n = bundles.count()
    tasks = max(1, min(n, 4 * index.sparkSession.sparkContext.defaultParallelism), -(-n // BUNDLES_PER_TASK))
    # dealt by number and not by name, which the planner would merge with the exchange of distinct()
    # and then put all names, which are small, into one task
    return bundles.repartition(tasks).mapInArrow(read, RECORD)


def read_record(folder: str, bundle: str, frame: int, offset: int) -> tuple:
    """One record by its place in the index; decompresses one frame."""
    fs, at = opened(folder)
    with fs.open_input_file(f"{at}/{bundle}") as f:
        start, packed, plain = read_seek_table(f)[frame]
        f.seek(start)
        return parse(zstandard.ZstdDecompressor().decompress(f.read(packed), max_output_size=plain), offset)[0]


def op3_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    index = write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), folder)
    return read_archives(index, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP3_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= {MIN_REVISIT} GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""
