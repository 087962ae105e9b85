"""WARC archives in seekable Zstandard bundles.

Each task streams its records into bundles: records are grouped into independent frames of about
``FRAME`` bytes, a seek table in a skippable frame ends the bundle, and every record's identifier is
mapped to (bundle, frame, offset inside the frame). Of records with equal payloads the one with the
least page_id is a response and the others are revisits that name it. Bundles have names that no
other attempt uses, and the index names the bundles of the attempts that counted, so a task that runs
twice leaves an unnamed file and no false record. Reading deals ranges of frames to tasks.

Defined results: null html is an empty payload; a null page_id sorts last and is read back as null;
repeated rows of a responding page are all responses; a null url is written as the record's own
name; an empty table writes nothing and gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, materialise, shared_dir

FRAME = 256 * 1024
BUNDLE = 256 * 1024 * 1024
LEVEL = 3
#: Revisit rows that may be broadcast; a row is two ids and a digest, under 100 bytes.
BROADCAST_ROWS = 200_000
#: Bits of the filter that tells payloads that occur once where the revisits are more than that; 8 MB.
FILTER_BITS = 1 << 26
#: Frames of a range that one task reads at a time, and ranges a task where there are many.
FRAMES, RANGES = 64, 16
# Fixed values of the seekable format: skippable frame, seek table footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "1970-01-01T00:00:00Z"

INDEX = "record_id string, page_id bigint, bundle string, frame int, offset int, length int"
RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{digest}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> tuple[str, bytes]:
    """A record's identifier and bytes. A revisit's block ends with the HTTP header, whose length
    field still tells the payload's size."""
    digest = base32_sha1(payload)
    name = record_id(page_id, digest)
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = name[1:-1] if url is None else quote(url, safe="%/:=&?~#+!$,;'@()*[]")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}"]
    return name, "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


class BundleWriter:
    """One bundle: frames of whole records, then the seek table."""

    def __init__(self, folder: str):
        self.uri = f"{folder}/{uuid.uuid4().hex}.warc.zst"
        files, path = fs.FileSystem.from_uri(self.uri)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        self.out = files.open_output_stream(path, compression=None)
        self.zip = zstandard.ZstdCompressor(level=LEVEL)
        self.table: list[tuple[int, int]] = []
        self.parts: list[bytes] = []
        self.held = self.size = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """(frame, offset inside it) of the record."""
        if self.held and self.held + len(data) > FRAME:
            self.flush()
        at = len(self.table), self.held
        self.parts.append(data)
        self.held += len(data)
        return at

    def flush(self) -> None:
        if self.held:
            packed = self.zip.compress(b"".join(self.parts))
            self.out.write(packed)
            self.table.append((len(packed), self.held))
            self.size += len(packed)
            self.parts, self.held = [], 0

    def close(self) -> None:
        self.flush()
        body = b"".join(struct.pack("<II", *x) for x in self.table) + struct.pack("<IBI", len(self.table), 0, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(body)) + body)
        self.out.close()


class BundleReader:
    """Frames of a bundle by number, found by its seek table."""

    def __init__(self, uri: str):
        files, path = fs.FileSystem.from_uri(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        frames, _, magic = struct.unpack("<IBI", self.file.read_at(9, size - 9))
        if magic != SEEKABLE:
            raise ValueError(f"{uri} has no seek table")
        rows = self.file.read_at(8 * frames, size - 9 - 8 * frames)
        self.table = [struct.unpack_from("<II", rows, 8 * i) for i in range(frames)]
        self.starts = [0]
        for packed, _ in self.table:
            self.starts.append(self.starts[-1] + packed)
        self.unzip = zstandard.ZstdDecompressor()

    def frame(self, i: int) -> bytes:
        packed, size = self.table[i]
        return self.unzip.decompress(self.file.read_at(packed, self.starts[i]), max_output_size=size)

    def record(self, frame: int, offset: int, length: int) -> bytes:
        return self.frame(frame)[offset : offset + length]


def parse(data: bytes, at: int = 0) -> tuple[dict[str, str], bytes, int]:
    """The record at ``at``: its header fields, its block and where the next one starts."""
    end = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:end].decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError(f"not a record: {version[:20]}")
    fields = dict(x.split(": ", 1) for x in lines)
    start, size = end + 4, int(fields["Content-Length"])
    return fields, data[start : start + size], start + size + 4


def _page(name: str) -> int | None:
    number = name.split(":")[2]
    return int(number) if number else None


def write_archives(pages: DataFrame, folder: str | None = None, least_bytes: int = 0, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Write all pages; returns the index, one row a record (see INDEX), already materialised."""
    folder = folder or f"{shared_dir(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    html = F.coalesce(column(pages, "html", "string"), F.lit("")).cast("binary")
    rows = pages.select(column(pages, "page_id", "bigint").alias("page_id"), column(pages, "url", "string").alias("url"), html.alias("payload"), F.sha1(html).alias("sha"))
    keys = materialise(rows.select("page_id", "sha", F.length("payload").alias("size")), "payloads")
    groups = keys.where(F.col("size") >= least_bytes).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("sha").alias("s"), "first")
    groups = materialise(groups, "same")
    revisits = keys.join(groups, F.col("sha") == F.col("s")).where("first is not null and not (page_id <=> first)").select(F.col("page_id").alias("p"), "s", "first").distinct()
    revisits = materialise(revisits, "revisits")
    said = (F.col("page_id").eqNullSafe(F.col("p"))) & (F.col("sha") == F.col("s"))
    if revisits.count() <= broadcast_rows:
        marked = rows.join(F.broadcast(revisits), said, "left").select("page_id", "url", "payload", "first")
    else:
        # payloads that surely occur once stay where they are; only the others are shuffled
        bit = F.pmod(F.xxhash64("sha"), F.lit(FILTER_BITS))
        again = materialise(revisits.select(F.col("s").alias("sha")).distinct().groupBy(F.shiftright(bit, 15).alias("bucket")).agg(F.bitmap_construct_agg(bit.bitwiseAND(F.lit(0x7FFF))).alias("bitmap")), "repeated")
        probed = rows.join(F.broadcast(again), F.shiftright(bit, 15) == F.col("bucket"), "left")
        byte = F.conv(F.hex(F.substring("bitmap", F.shiftright(bit, 3).bitwiseAND(F.lit(4095)).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        some = F.coalesce(byte.bitwiseAND(F.get(F.array(*[F.lit(1 << i) for i in range(8)]), bit.bitwiseAND(F.lit(7)).cast("int"))) != 0, F.lit(False))
        probed = probed.select("page_id", "url", "payload", "sha", some.alias("some"))
        found = probed.where("some").join(revisits.hint("merge"), said, "left").select("page_id", "url", "payload", "first")
        marked = probed.where("not some").select("page_id", "url", "payload", F.lit(None).cast("bigint").alias("first")).unionByName(found)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        try:
            for batch in batches:
                out = []
                for page_id, url, payload, first in zip(*(c for c in batch.columns), strict=True):
                    if bundle is None:
                        bundle = BundleWriter(folder)
                    name, data = record(page_id.as_py(), url.as_py(), payload.as_py(), first.as_py(), first.is_valid)
                    frame, offset = bundle.add(data)
                    out.append((name, page_id.as_py(), bundle.uri, frame, offset, len(data)))
                    if bundle.size >= BUNDLE:
                        bundle.close()
                        bundle = None
                names = ["record_id", "page_id", "bundle", "frame", "offset", "length"]
                kinds = [pa.string(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 6, kinds, strict=True)], names)
        finally:
            # an attempt that fails leaves a closed bundle that no index names
            if bundle:
                bundle.close()

    return materialise(marked.mapInArrow(run, INDEX), "warc_index")


def read_archives(index: DataFrame) -> DataFrame:
    """Every record of the bundles that ``index`` names, read through their seek tables (see RECORD).

    A response's payload must match its digest.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for uri, lo, hi in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bundle = BundleReader(uri)
                for i in range(lo, hi + 1):
                    data, at, out = bundle.frame(i), 0, []
                    while at < len(data):
                        fields, block, at = parse(data, at)
                        digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        kind, refers = fields["WARC-Type"], fields.get("WARC-Refers-To")
                        if kind == "response" and (len(payload) != size or base32_sha1(payload) != digest):
                            raise ValueError(f"{fields['WARC-Record-ID']} is damaged")
                        out.append((_page(fields["WARC-Record-ID"][1:-1]), size, digest, kind, _page(refers[1:-1]) if refers else None))
                    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    ranges = index.groupBy("bundle", F.floor(F.col("frame") / FRAMES)).agg(F.min("frame").alias("lo"), F.max("frame").alias("hi"))
    ranges = materialise(ranges.select("bundle", "lo", "hi"), "ranges")
    n = ranges.count()
    # rows of a few bytes stand for megabytes, so their number of tasks is stated
    tasks = max(-(-n // RANGES), min(n, 4 * index.sparkSession.sparkContext.defaultParallelism), 1)
    return ranges.repartition(tasks).mapInArrow(run, RECORD)
