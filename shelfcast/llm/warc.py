"""WARC records in seekable Zstandard bundles.

A bundle is a row of independent Zstandard frames, each holding whole WARC records of about
``FRAME_BYTES``, and a last, skippable frame with the seek table: compressed and decompressed size
of every frame.  Any Zstandard tool reads the bundle as one stream; with the seek table and a
record's place (frame, offset inside the frame) one record is read by decompressing one frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfcast.llm.common import file_system, prepare, shared_folder, store, table

FRAME_BYTES = 1 << 20
#: A task begins a new bundle after so many bytes before compression.
BUNDLE_BYTES = 1 << 30
LEVEL = 3
#: Neighbouring frames that one task reads, and such stretches to a task in a large archive.
STRETCH, STRETCHES = 64, 4
#: Fixed values of the seekable format: magic of the skippable frame and of its footer.
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record_id(page_id) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def warc_record(page_id, url: str | None, payload: bytes, size: int, digest: str, refers_to) -> bytes:
    """One response, or a revisit of ``refers_to`` without the payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    target = (url or "about:blank").replace("\r", "%0D").replace("\n", "%0A")
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}",
            "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{digest}",
            "Content-Type: application/http;msgtype=response"]
    if page_id is not None:
        head.append(f"Page-Id: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}", f"Refers-To-Page-Id: {refers_to}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes, at: int) -> tuple[dict, int]:
    """The record that begins at ``at``: its fields, with HTTP length and payload, and where the next begins."""
    split = data.index(b"\r\n\r\n", at)
    version, *lines = data[at:split].decode().split("\r\n")
    if version != "WARC/1.1":
        raise ValueError("not a record's beginning")
    fields = dict(x.split(": ", 1) for x in lines)
    block = data[split + 4:split + 4 + int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    fields["size"] = int(http.rpartition(b"Content-Length: ")[2])
    fields["payload"] = payload
    return fields, split + 8 + int(fields["Content-Length"])


class BundleWriter:
    """Writes records into frames; knows the place of each."""

    def __init__(self, stream, frame_bytes: int = FRAME_BYTES):
        self.frame_bytes, self.stream, self.compress = frame_bytes, stream, zstandard.ZstdCompressor(level=LEVEL, write_content_size=True).compress
        self.frames: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.size = self.total = 0

    def add(self, record: bytes) -> tuple[int, int]:
        if self.size and self.size + len(record) > self.frame_bytes:
            self.flush()
        place = len(self.frames), self.size
        self.held.append(record)
        self.size += len(record)
        self.total += len(record)
        return place

    def flush(self) -> None:
        if self.held:
            data = self.compress(b"".join(self.held))
            self.stream.write(data)
            self.frames.append((len(data), self.size))
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<II", *f) for f in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE)
        self.stream.write(struct.pack("<II", SKIPPABLE, len(entries) + len(footer)) + entries + footer)
        self.stream.close()


class BundleReader:
    """Reads single frames of a bundle by its seek table."""

    def __init__(self, source):
        self.source, end = source, source.size()
        source.seek(end - 9)
        count, _, magic = struct.unpack("<IBI", source.read(9))
        if magic != SEEKABLE:
            raise ValueError("no seek table")
        source.seek(end - 9 - 8 * count)
        table = source.read(8 * count)
        self.frames, at = [], 0
        for compressed, size in struct.iter_unpack("<II", table):
            self.frames.append((at, compressed, size))
            at += compressed
        self.decompress = zstandard.ZstdDecompressor().decompress

    def frame(self, i: int) -> bytes:
        at, compressed, size = self.frames[i]
        self.source.seek(at)
        data = self.decompress(self.source.read(compressed))
        if len(data) != size:
            raise ValueError("a frame's size differs from the seek table")
        return data


def read_record(folder: str, bundle: str, frame: int, offset: int) -> dict:
    """One record by its place in the index."""
    system, path = file_system(folder)
    with system.open_input_file(f"{path}/{bundle}") as f:
        return parse_record(BundleReader(f).frame(frame), offset)[0]


def write_bundles(pages: DataFrame, folder: str, least: int = 0, frame_bytes: int = FRAME_BYTES) -> DataFrame:
    """Write all pages; return the stored index: record_id, page_id, bundle, frame, offset.

    Of records with equal payloads of at least ``least`` bytes (equal SHA-1 and length), that of the
    largest page_id is a response and the others revisit it.  The payloads travel once, to the
    join with the groups' largest ids, whose hot keys Spark may split; a revisit's payload is
    dropped there.  Bundles have names that no other attempt uses, and only those in the index count.

    A null html is an empty payload, a null url "about:blank".  A null page_id never is the one
    that others revisit; a group of null ids only has no revisits.  Rows that repeat the largest
    id of their group are all responses.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).cast("binary").alias("html"))
    rows = rows.withColumn("sha1", F.sha1("html")).withColumn("size", F.octet_length("html").cast("long"))
    first = (pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("html", F.lit("")).cast("binary").alias("html"))
             .select("page_id", F.sha1("html").alias("sha1"), F.octet_length("html").cast("long").alias("size"))
             .groupBy("sha1", "size").agg(F.max("page_id").alias("first")))
    joined = rows.join(first.hint("merge"), ["sha1", "size"])
    refers = F.when((F.col("size") >= least) & ~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    planned = joined.withColumn("refers_to", refers).select(
        "page_id", "url", F.when(F.col("refers_to").isNull(), F.col("html")).alias("html"), "size", "sha1", "refers_to")

    def run(batches):
        system, path = file_system(folder)
        writer = name = None
        for batch in batches:
            if not batch.num_rows:
                continue
            out = []
            for page in batch.to_pylist():
                if writer is not None and writer.total > BUNDLE_BYTES:
                    writer.close()
                    writer = None
                if writer is None:
                    system.create_dir(path, recursive=True)
                    name = f"bundle-{uuid.uuid4().hex}.warc.zst"
                    writer = BundleWriter(system.open_output_stream(f"{path}/{name}", compression=None), frame_bytes)
                digest = base64.b32encode(bytes.fromhex(page["sha1"])).decode()
                place = writer.add(warc_record(page["page_id"], page["url"], page["html"] or b"", page["size"], digest, page["refers_to"]))
                out.append((record_id(page["page_id"]), page["page_id"], name, *place))
            types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
            names = ["record_id", "page_id", "bundle", "frame", "offset"]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
        if writer is not None:
            writer.close()

    return store(planned.mapInArrow(run, "record_id string, page_id bigint, bundle string, frame bigint, offset bigint"))


def read_bundles(index: DataFrame, folder: str) -> DataFrame:
    """Read all records of the index back from the bundles, frame by frame.

    One row per record: page_id, payload_bytes, payload_digest, record_type, refers_to, from the
    record's own header; payloads of responses are checked against their digest.  Stretches of
    neighbouring frames are dealt out to tasks whose number follows the frames, so one large bundle
    is not one task's, nor a whole archive that has a small index.
    """
    def run(batches):
        system, path = file_system(folder)
        bundle = source = reader = None
        for batch in batches:
            for row in batch.to_pylist():
                if row["bundle"] != bundle:
                    if source is not None:
                        source.close()
                    bundle, source = row["bundle"], system.open_input_file(f"{path}/{row['bundle']}")
                    reader = BundleReader(source)
                data, at, out, places = reader.frame(row["frame"]), 0, [], set(row["offsets"])
                while at < len(data):
                    if at not in places:
                        raise ValueError("a record is not in the index")
                    places.discard(at)
                    fields, at = parse_record(data, at)
                    digest, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), fields["WARC-Type"]
                    if kind == "response" and (len(fields["payload"]) != fields["size"] or base64.b32encode(hashlib.sha1(fields["payload"]).digest()).decode() != digest):
                        raise ValueError("a payload differs from its digest")
                    ids = [int(x) if (x := fields.get(f)) is not None else None for f in ("Page-Id", "Refers-To-Page-Id")]
                    out.append((ids[0], fields["size"], digest, kind, ids[1]))
                if places:
                    raise ValueError("a record of the index is missing")
                types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
                names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
        if source is not None:
            source.close()

    dealt = index.select("bundle", F.floor(F.col("frame") / F.lit(STRETCH)).alias("stretch"), "frame", "offset")
    stretches = dealt.select("bundle", "stretch").distinct().count()
    tasks = max(1, -(-stretches // STRETCHES), min(stretches, index.sparkSession.sparkContext.defaultParallelism))
    frames = (dealt.repartition(tasks, "bundle", "stretch").groupBy("bundle", "stretch", "frame")
              .agg(F.collect_list("offset").alias("offsets")))  # a frame holds a bounded number of records
    return frames.sortWithinPartitions("bundle", "frame").mapInArrow(
        run, "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint")


def op5_warc(spark, sf_dir: str) -> DataFrame:
    prepare(spark)
    folder = shared_folder(spark, "warc")
    return read_bundles(write_bundles(table(spark, sf_dir, "pages"), folder), folder)
