"""WARC archives as seekable Zstandard bundles: independent frames, a seek table at the end, an index of records."""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from alertweave.llm.common import cut, settle

#: Fixed values of the seekable format: magic of the skippable frame, magic at the file's end, descriptor bit for checksums.
SKIPPABLE, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x8F92EAB1, 0x80
#: Payloads below this size are always stored.
LEAST_SHARED = 100
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 16 << 20

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BUNDLES = "bundle string, content binary, records array<struct<record_id:string,frame:int,offset:long,length:long>>"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, bundle string, frame int, offset long, length long"


def record(page_id: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers_to: int | None) -> bytes:
    """One record with its HTTP response; a revisit has the response's head only."""
    name = "" if page_id is None else page_id
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = head + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:  # control characters would end the line
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    lines += [f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


class BundleWriter:
    """Collects records into frames; `finish` adds the seek table."""

    def __init__(self, frame_bytes: int = FRAME_BYTES):
        self.frame_bytes, self.size = frame_bytes, 0
        self.parts: list[bytes] = []
        self.table: list[tuple[int, int, int]] = []
        self.open = bytearray()
        self.index: list[dict] = []
        self.compress = zstandard.ZstdCompressor(level=6).compress

    def add(self, record_id: str, data: bytes) -> None:
        self.index.append({"record_id": record_id, "frame": len(self.table), "offset": len(self.open), "length": len(data)})
        self.open += data
        if len(self.open) >= self.frame_bytes:
            self._close()

    def _close(self) -> None:
        if self.open:
            raw = bytes(self.open)
            frame = self.compress(raw)
            self.parts.append(frame)
            self.size += len(frame)
            self.table.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
            self.open = bytearray()

    def finish(self) -> bytes:
        self._close()
        entries = b"".join(struct.pack("<III", *entry) for entry in self.table)
        foot = struct.pack("<IBI", len(self.table), CHECKSUMS, SEEKABLE)
        return b"".join(self.parts) + struct.pack("<II", SKIPPABLE, len(entries) + len(foot)) + entries + foot


class BundleReader:
    """Random access to the frames of a bundle by its seek table."""

    def __init__(self, content: bytes):
        count, descriptor, magic = struct.unpack("<IBI", content[-9:])
        width = 12 if descriptor & CHECKSUMS else 8
        start = len(content) - 9 - count * width
        kind, size = struct.unpack("<II", content[start - 8 : start]) if magic == SEEKABLE and start >= 8 else (0, 0)
        if (magic, kind, size) != (SEEKABLE, SKIPPABLE, count * width + 9):
            raise ValueError("no seek table")
        self.content, self.at = content, [0]
        self.entries = [struct.unpack("<III" if width == 12 else "<II", content[start + k * width : start + (k + 1) * width]) for k in range(count)]
        for entry in self.entries:
            self.at.append(self.at[-1] + entry[0])

    def frame(self, k: int) -> bytes:
        raw = zstandard.ZstdDecompressor().decompress(self.content[self.at[k] : self.at[k + 1]], max_output_size=self.entries[k][1])
        if len(raw) != self.entries[k][1] or len(self.entries[k]) == 3 and xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.entries[k][2]:
            raise ValueError(f"frame {k} is damaged")
        return raw


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """(headers, block, end) of the record at `at`."""
    top = data.index(b"\r\n\r\n", at)
    lines = data[at:top].decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no record here")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    start = top + 4
    end = start + int(headers["Content-Length"])
    return headers, data[start:end], end + 4


def described(data: bytes, at: int) -> tuple[dict, bytes, int]:
    """What a record says of its page, its payload (empty for a revisit) and where it ends; a payload must have its digest."""
    headers, block, end = parse(data, at)
    head, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", head)[1])
    digest = headers["WARC-Payload-Digest"].removeprefix("sha256:")
    number = lambda field: int(m[1]) if (m := re.search(r"<urn:page:(-?\d+)>", headers.get(field, ""))) else None
    if headers["WARC-Type"] == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError(f"{headers['WARC-Record-ID']} does not have its payload")
    row = {"page_id": number("WARC-Record-ID"), "url": headers.get("WARC-Target-URI"), "payload_bytes": size, "payload_digest": digest}
    return row | {"record_type": headers["WARC-Type"], "refers_to": number("WARC-Refers-To"), "offset": at, "length": end - at}, payload, end


def write(pages: DataFrame) -> DataFrame:
    """The pages (page_id, url, html) as stored bundles: (bundle, content, records), content being a whole .warc.zst file.

    There is a record per row, its payload the html in UTF-8, empty if null. Of rows with equal payloads of at least 100 bytes
    those with the smallest page_id become responses (repeated rows with this id all do), the others revisits of it; rows
    without page_id revisit too, or are responses if none of their equals has an id. Smaller payloads are responses. An empty
    table gives no bundle; other columns are not read. A task cuts a bundle after about 16 MB and a frame after 256 KB; a
    longer record has a frame of its own, so memory is that of a bundle and one record.
    """
    settle(pages.sparkSession)
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    shared = rows.where(F.octet_length("payload") >= LEAST_SHARED).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
    shared = shared.where("n > 1 and first is not null").select(F.col("digest").alias("shared"), "first")
    joined = rows.join(shared, rows.digest == F.col("shared"), "left")
    again = F.when(F.col("page_id").isNull() | (F.col("page_id") != F.col("first")), F.col("first"))
    # A revisit's payload stays behind.
    told = joined.select("page_id", "url", F.when(again.isNull(), F.col("payload")).alias("payload"), F.octet_length("payload").alias("size"), "digest", again.alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, done, writer = TaskContext.get().partitionId(), 0, BundleWriter()

        def bundle() -> pa.RecordBatch:
            row = {"bundle": f"part-{task:06d}-{done:05d}.warc.zst", "content": writer.finish(), "records": writer.index}
            return pa.RecordBatch.from_pylist([row], schema=_BUNDLES)

        for batch in batches:
            plain = [batch.column(name).to_pylist() for name in ("page_id", "url", "size", "digest", "refers_to")]
            for page_id, url, size, digest, refers_to, payload in zip(*plain, batch.column("payload"), strict=True):
                writer.add(f"<urn:page:{'' if page_id is None else page_id}>", record(page_id, url, payload.as_py(), size, digest, refers_to))
                if writer.size >= BUNDLE_BYTES:
                    yield bundle()
                    done, writer = done + 1, BundleWriter()
        if writer.index:
            yield bundle()

    return cut(told.mapInArrow(run, BUNDLES))


_RECORD = pa.struct([("record_id", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64())])
_BUNDLES = pa.schema([("bundle", pa.string()), ("content", pa.binary()), ("records", pa.list_(_RECORD))])
_ROWS = pa.schema([
    ("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
    ("refers_to", pa.int64()), ("bundle", pa.string()), ("frame", pa.int32()), ("offset", pa.int64()), ("length", pa.int64()),
])


def read(bundles: DataFrame) -> DataFrame:
    """Every record of the bundles, frame by frame, with its place; payloads are checked against their digests."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column("bundle").to_pylist(), batch.column("content"), strict=True):
                reader = BundleReader(content.as_py())
                for k in range(len(reader.entries)):
                    raw, at, out = reader.frame(k), 0, []
                    while at < len(raw):
                        row, _, at = described(raw, at)
                        out.append(row | {"bundle": name, "frame": k})
                    yield pa.RecordBatch.from_pylist(out, schema=_ROWS)

    return bundles.select("bundle", "content").mapInArrow(run, RECORDS)


def fetch(bundles: DataFrame, wanted: DataFrame) -> DataFrame:
    """(page_id, payload) of the pages in `wanted` (page_id): only frames that hold them are decompressed.

    A revisit's payload is that of the record it refers to, which is asked for under that record's own page_id.
    """
    ids = wanted.where("page_id is not null").select(F.format_string("<urn:page:%d>", F.col("page_id").cast("long")).alias("record_id")).distinct()
    places = bundles.select("bundle", F.inline("records")).join(ids, "record_id").groupBy("bundle").agg(F.collect_list(F.struct("frame", "offset")).alias("places"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, places in zip(batch.column("content"), batch.column("places").to_pylist(), strict=True):
                reader, frame, raw = BundleReader(content.as_py()), -1, b""
                for place in sorted(places, key=lambda p: (p["frame"], p["offset"])):
                    if place["frame"] != frame:
                        frame, raw = place["frame"], reader.frame(place["frame"])
                    row, payload, _ = described(raw, place["offset"])
                    yield pa.RecordBatch.from_pylist([{"page_id": row["page_id"], "payload": payload}])

    return bundles.select("bundle", "content").join(places, "bundle").select("content", "places").mapInArrow(run, "page_id long, payload binary")


def export(bundles: DataFrame, folder: str) -> None:
    """The bundles as .warc.zst files in a folder that every executor has mounted, such as a shared file system."""
    import os

    def store(rows: Iterator) -> None:
        for row in rows:
            path = os.path.join(folder, row.bundle)
            with open(f"{path}.{os.getpid()}", "wb") as f:
                f.write(row.content)
            os.replace(f.name, path)  # a task that runs again leaves the same file

    bundles.select("bundle", "content").foreachPartition(store)
