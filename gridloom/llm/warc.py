"""Dictionary-compressed WARC archives (.warc.zst), and reading them back.

An archive begins with a skippable frame that holds a Zstandard dictionary built from records of this archive;
then each record is a frame of its own, compressed with that dictionary, so that a record can be read from its
offset with the dictionary alone. Records are WARC/1.1: a response holds the HTTP head and the payload, a revisit
(identical-payload-digest) the HTTP head only and the record it refers to.

Archives are rows (name, content): Spark's own writers put them into any store, and losing an executor costs the
archives of its tasks, which are made again. A task holds one archive of about ``archive_bytes`` at a time.
``export_archives`` writes such rows as files into a folder that all machines see.
"""

from __future__ import annotations

import base64
import hashlib
import os
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .prefilter import Filter
from .shared import by_bytes, materialize, table

#: Fixed values of the format: the magic number of the dictionary's skippable frame and that of Zstandard's frames.
DICT_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"
EPOCH = "2024-01-01T00:00:00Z"
#: Bytes of an archive that are given to the decompressor at once.
FEED = 4096


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """Header values are one line."""
    return " ".join(value.split())


def record(page_id, url: str | None, payload: bytes, digest: str, refers_to=None, revisit: bool = False) -> bytes:
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if revisit else head + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{URN}{'' if page_id is None else page_id}>", f"WARC-Date: {EPOCH}"]
    if url is not None:
        lines.append(f"WARC-Target-URI: {_clean(url)}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: <{URN}{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


def build_dictionary(records: list[bytes], *, dict_bytes: int = 16 << 10, sample_bytes: int = 1 << 20) -> bytes:
    """A dictionary from pieces of records, ``sample_bytes`` in all: from every record an equal share, spread over it.

    Where there are more records than the budget has 256-byte pieces for, evenly spaced ones are taken. A sample from which none can be trained (few or
    odd records) is itself the dictionary, as raw content. Empty only where there are no records. Records are stored whole in any case.
    """
    if not records:
        return b""
    share = max(256, sample_bytes // len(records))
    sample = []
    for r in records[:: max(1, -(-len(records) * share // sample_bytes))]:
        take = min(len(r), share)
        n = -(-take // 4096)
        size = -(-take // n)
        sample += [r[k * (len(r) - size) // max(1, n - 1) :][:size] for k in range(n)]
    try:
        return zstandard.train_dictionary(dict_bytes, sample, k=256, d=8).as_bytes()
    except zstandard.ZstdError:
        return b"".join(sample)[:dict_bytes]


def pack(records: list[bytes], level: int = 3) -> bytes:
    """One archive."""
    words = build_dictionary(records)
    made = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(words) if words else None)
    return b"".join([struct.pack("<II", DICT_MAGIC, len(words)), words, *map(made.compress, records)])


def unpack(archive: bytes) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    magic, size = struct.unpack_from("<II", archive)
    if magic != DICT_MAGIC:
        raise ValueError(f"not a dictionary frame: {magic:#x}")
    words, data, at = archive[8 : 8 + size], memoryview(archive), 8 + size
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(words) if words else None)
    while at < len(data):
        if data[at : at + 4] != FRAME_MAGIC:
            raise ValueError("a record doesn't begin with a Zstandard frame")
        one, parts = reader.decompressobj(), []
        while not one.eof:  # fed in pieces, so that what follows a frame is copied once at most
            piece = data[at : at + FEED]
            if not len(piece):
                raise ValueError("the archive ends inside a record")
            parts.append(one.decompress(piece))
            at += len(piece)
        at -= len(one.unused_data)
        yield b"".join(parts)


def parse(raw: bytes) -> dict:
    """The headers of a record, and its block's HTTP head and payload."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(rest) != len(block) + 4:
        raise ValueError("a record's length is not what it says")
    http, _, payload = block.partition(b"\r\n\r\n")
    told = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    return {"fields": fields, "payload": payload, "full_length": int(told["Content-Length"])}


def _id(urn: str) -> str | None:
    return urn.removeprefix(f"<{URN}").removesuffix(">") or None


def write_archives(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", min_revisit_bytes: int = 0, archive_bytes: int = 16 << 20) -> DataFrame:
    """Archives (name string, records long, content binary) that hold one record per row of ``pages``.

    Of rows with equal payloads of at least ``min_revisit_bytes``, those with the smallest id are responses and the others
    revisit it; shorter ones are all responses. A null payload is empty; a null url leaves the field out; a row with a null
    id never is the one referred to (a group that has null ids only is all responses). Rows that repeat the smallest id are
    all responses. An empty table makes no archive. Other columns are not read. Payloads that surely stand once stay where they
    are; only those that may be repeated shuffle, if Spark doesn't broadcast the table of repeated payloads after checking its size.
    """
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(F.col(payload_col).cast("binary"), F.lit("").cast("binary")).alias("payload")).withColumn("sha", F.unhex(F.sha1("payload")))
    long_ones = rows.where(F.length("payload") >= min_revisit_bytes)
    groups = materialize(long_ones.groupBy("sha").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("sha", "first"), "repeated-payloads")
    marked = Filter(groups.select(F.xxhash64("sha"))).mark(rows, F.xxhash64("sha"), "maybe")
    alone = marked.where("not maybe").withColumn("first", F.lit(None).cast(groups.schema["first"].dataType))
    told = alone.unionByName(marked.where("maybe").join(groups, "sha", "left"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def archive() -> pa.RecordBatch:
            name = hashlib.sha1(b"".join(hashlib.sha1(r).digest() for r in held)).hexdigest()  # the same rows give the same name when a task runs again
            return pa.RecordBatch.from_arrays([pa.array([f"{name}.warc.zst"]), pa.array([len(held)], pa.int64()), pa.array([pack(held)], pa.binary())], names=["name", "records", "content"])

        for batch in by_bytes(batches, 2):
            for i, url, payload, sha, first in zip(*batch.columns, strict=True):
                i, payload, first = i.as_py(), payload.as_py(), first.as_py()
                long = len(payload) >= min_revisit_bytes
                revisit = long and first is not None and i != first
                held.append(record(i, url.as_py(), payload, base64.b32encode(sha.as_py()).decode(), first, revisit))
                size += len(held[-1])
                if size >= archive_bytes:
                    yield archive()
                    held, size = [], 0
        if held:
            yield archive()

    return told.select("id", "url", "payload", "sha", "first").mapInArrow(run, "name string, records long, content binary")


def read_archives(archives: DataFrame, *, with_payload: bool = False) -> DataFrame:
    """The records of archives (column content): page_id string, url, payload_bytes, payload_digest, record_type, refers_to string[, payload].

    Payload length and digest are those of the full payload, of revisits too. A response whose payload isn't what its
    digest says raises an error.
    """
    schema = "page_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload binary" * with_payload

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in schema.split(", ")]
        for batch in batches:
            for content in batch.column(0):
                rows = []
                for raw in unpack(content.as_py()):
                    got = parse(raw)
                    f, kind = got["fields"], got["fields"]["WARC-Type"]
                    digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and (len(got["payload"]) != got["full_length"] or payload_digest(got["payload"]) != digest):
                        raise ValueError(f"{f['WARC-Record-ID']}: payload and digest differ")
                    rows.append((_id(f["WARC-Record-ID"]), f.get("WARC-Target-URI"), got["full_length"], digest, kind, _id(f.get("WARC-Refers-To", "")), got["payload"])[: len(names)])
                    if len(rows) == 2000:
                        yield _batch(rows, names)
                        rows = []
                if rows:
                    yield _batch(rows, names)

    return archives.select("content").mapInArrow(run, schema)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"payload_bytes": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*rows, strict=True), strict=True)], names=names)


def export_archives(archives: DataFrame, folder: str) -> DataFrame:
    """Write archives as files into a folder that all machines share; (path, bytes) of each. A file appears whole or not at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        os.makedirs(folder, exist_ok=True)
        for batch in batches:
            out = []
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                path = os.path.join(folder, name)
                part = f"{path}.{os.getpid()}.part"
                with open(part, "wb") as f:
                    f.write(content.as_py())
                os.replace(part, path)
                out.append((path, len(content.as_py())))
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out]), pa.array([n for _, n in out], pa.int64())], names=["path", "bytes"])

    return archives.select("name", "content").mapInArrow(run, "path string, bytes long")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    archives = materialize(write_archives(pages), "archives")
    kind = pages.schema["page_id"].dataType
    return read_archives(archives).select(F.col("page_id").cast(kind), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind))
