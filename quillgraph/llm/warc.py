"""WARC archives as seekable Zstandard bundles.

Records are grouped into independent Zstandard frames of about `frame_bytes` raw
bytes; the archive ends with the public seekable-format seek table (a skippable
frame with each frame's compressed and raw size), so any frame can be read alone.
The index maps each record's identifier to (file, frame, offset inside the frame,
length).

Files are written by the executors through pyarrow's file systems (file:, hdfs:,
s3: ...) under the shared folder. A name has the attempt's random part: a retried
or speculative task writes another file, and only the index, which Spark commits
once, says which files count. Memory holds one Arrow batch and one frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm.common import new_path, shuffle_partitions, small_batches, table, written

#: Fixed values of the public seekable Zstandard format: the skippable frame's magic
#: number and that of the seek table's footer.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

FRAME_BYTES = 256 * 1024
ARCHIVE_BYTES = 64 * 1024 * 1024
#: Payloads below this many bytes are never stored as revisits.
REVISIT_BYTES = 1000
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_PREFIX = "urn:quillgraph:page:"

INDEX_SCHEMA = "page_id long, file string, frame int, frame_offset long, record_bytes long"
RECORD_SCHEMA = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload string, file string, frame int, frame_offset long"


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _header(value: str) -> str:
    """A header value on one line: control characters are percent-encoded."""
    return "".join(c if c >= " " and c != "\x7f" else f"%{ord(c):02X}" for c in value)


def build_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record. A revisit carries the HTTP header but no payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if page_id is not None:
        lines.append(f"WARC-Record-ID: <{RECORD_PREFIX}{page_id}>")
    if url is not None:
        lines.append(f"WARC-Target-URI: {_header(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{RECORD_PREFIX}{refers_to}>"]
    lines += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int = 0) -> tuple[dict, int]:
    """The record at an offset, and the offset behind it. A response's digest and
    length are recomputed from its payload and held against its header."""
    end = data.index(b"\r\n\r\n", at)
    head = dict(x.split(": ", 1) for x in data[at:end].decode().split("\r\n")[1:])
    start, size = end + 4, int(head["Content-Length"])
    block = data[start : start + size]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    number = lambda k: int(head[k].strip("<>").rsplit(":", 1)[1]) if k in head else None
    digest = base64.b32decode(head["WARC-Payload-Digest"].partition(":")[2]).hex()
    revisit = head["WARC-Type"] == "revisit"
    if not revisit:
        if (real := hashlib.sha1(payload).hexdigest()) != digest or len(payload) != int(fields["Content-Length"]):
            raise ValueError(f"record at {at}: payload has {real}, header says {digest}")
    return {
        "page_id": number("WARC-Record-ID"), "url": head.get("WARC-Target-URI"), "record_type": head["WARC-Type"],
        "refers_to": number("WARC-Refers-To"), "payload_bytes": int(fields["Content-Length"]), "payload_digest": digest,
        "payload": None if revisit else payload,
    }, start + size + 4


class BundleWriter:
    """Writes one seekable archive."""

    def __init__(self, sink, frame_bytes: int = FRAME_BYTES, level: int = 3):
        import zstandard

        self.sink, self.frame_bytes, self.frames, self.held, self.size, self.total = sink, frame_bytes, [], [], 0, 0
        self.packer = zstandard.ZstdCompressor(level=level, write_checksum=True)

    def add(self, record: bytes) -> tuple[int, int]:
        """Append a record; its frame and its offset in that frame."""
        if self.held and self.size + len(record) > self.frame_bytes:
            self.flush()
        at = (len(self.frames), self.size)
        self.held.append(record)
        self.size += len(record)
        return at

    def flush(self) -> None:
        if self.held:
            packed = self.packer.compress(b"".join(self.held))
            self.sink.write(packed)
            self.frames.append((len(packed), self.size))
            self.total += len(packed)
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<II", *x) for x in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)


def seek_table(source) -> list[tuple[int, int, int]]:
    """(position, compressed bytes, raw bytes) of each frame of an open archive."""
    size = source.size()
    source.seek(size - 9)
    n, descriptor, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("not a seekable archive")
    entry = 12 if descriptor & 0x80 else 8
    source.seek(size - 9 - entry * n)
    raw, out, at = source.read(entry * n), [], 0
    for i in range(n):
        packed, plain = struct.unpack_from("<II", raw, entry * i)
        out.append((at, packed, plain))
        at += packed
    return out


def read_frame(source, frame: tuple[int, int, int]) -> bytes:
    import zstandard

    source.seek(frame[0])
    return zstandard.ZstdDecompressor().decompress(source.read(frame[1]), max_output_size=max(1, frame[2]))


def write_archives(pages: DataFrame, root: str, *, frame_bytes: int = FRAME_BYTES, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write (page_id, url, payload, digest, refers_to, is_revisit) rows as archives
    below `root`; return the committed index of INDEX_SCHEMA."""

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(root)
        system.create_dir(base, recursive=True)
        writer, name, sink = None, "", None
        for batch in batches:
            rows = []
            cols = [batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to", "is_revisit")]
            for i in range(batch.num_rows):
                page_id, url, payload, digest, refers_to, revisit = (c[i].as_py() for c in cols)
                if writer is None:
                    name = f"part-{uuid.uuid4().hex}.warc.zst"
                    sink = system.open_output_stream(f"{base}/{name}", compression=None)
                    writer = BundleWriter(sink, frame_bytes)
                record = build_record(page_id, url, payload, digest, refers_to, revisit)
                rows.append((page_id, name, *writer.add(record), len(record)))
                if writer.total >= archive_bytes:
                    writer.close()
                    sink.close()
                    writer = None
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.int64()))],
                names=["page_id", "file", "frame", "frame_offset", "record_bytes"],
            )
        if writer is not None:
            writer.close()
            sink.close()

    return written(pages.mapInArrow(write, INDEX_SCHEMA), "warc-index")


def read_archives(index: DataFrame, root: str, *, payloads: bool = False) -> DataFrame:
    """Every record of the archives that the index names, frame by frame through the
    seek tables; an archive is one task's unit, a frame is what memory holds."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(root)
        keys = ["page_id", "url", "record_type", "refers_to", "payload_bytes", "payload_digest", "payload"]
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with system.open_input_file(f"{base}/{name}") as source:
                    for k, frame in enumerate(seek_table(source)):
                        data, at, found, starts = read_frame(source, frame), 0, [], []
                        while at < len(data):
                            starts.append(at)
                            record, at = parse_record(data, at)
                            record["payload"] = record["payload"].decode() if payloads and record["payload"] is not None else None
                            found.append(record)
                        n = len(found)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([x[c] for x in found], t) for c, t in zip(keys, kinds)]
                            + [pa.array([name] * n, pa.string()), pa.array([k] * n, pa.int32()), pa.array(starts, pa.int64())],
                            names=[*keys, "file", "frame", "frame_offset"],
                        )

    files = index.select("file").distinct().repartition(shuffle_partitions(index.sparkSession))
    return files.mapInArrow(read, RECORD_SCHEMA)


def fetch_records(wanted: DataFrame, index: DataFrame, root: str) -> DataFrame:
    """The records of `wanted.page_id` by random access: only their frames are read."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = _open(root)
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                with system.open_input_file(f"{base}/{row['file']}") as source:
                    data = read_frame(source, seek_table(source)[row["frame"]])
                record, _ = parse_record(data, row["frame_offset"])
                record["payload"] = record["payload"].decode() if record["payload"] is not None else None
                out.append({**record, **{k: row[k] for k in ("file", "frame", "frame_offset")}})
            schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.string()), ("file", pa.string()), ("frame", pa.int32()), ("frame_offset", pa.int64())])
            yield pa.RecordBatch.from_pylist(out, schema)

    return index.join(wanted.select("page_id").distinct(), "page_id", "left_semi").mapInArrow(read, RECORD_SCHEMA)


def plan_revisits(pages: DataFrame, *, min_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Payload, digest, and which record each page's refers to.

    Digests are counted by partial aggregation, so a payload that a third of all
    pages share arrives as one row per task; AQE splits its side of the join."""
    keyed = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload")).withColumn("digest", F.sha1("payload"))
    shared = (
        keyed.where(F.octet_length("payload") >= min_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("last"), F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > 1)
        .select("digest", "last")
    )
    revisit = F.col("last").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("last"))
    return keyed.join(shared, "digest", "left").select(
        "page_id", "url", "payload", "digest", F.when(revisit, F.col("last")).alias("refers_to"), revisit.alias("is_revisit")
    )


def op1_warc_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record per page, written as archives and read back from them.

    A null html is an empty payload. Rows that share the largest page_id of a payload
    are all responses; a null page_id is never the largest, and where all are null all
    are responses. An empty table gives no archive and no rows."""
    small_batches(spark)
    root = new_path(spark, "warc")
    index = write_archives(plan_revisits(table(spark, sf_dir, "pages")), root)
    return read_archives(index, root).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = f"""
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha1(payload) AS payload_digest FROM p
), l AS (
  SELECT payload_digest, max(page_id) AS last FROM d WHERE payload_bytes >= {REVISIT_BYTES} GROUP BY payload_digest HAVING count(*) > 1
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN last IS NOT NULL AND page_id IS DISTINCT FROM last THEN last END AS refers_to
FROM d LEFT JOIN l USING (payload_digest)
"""
