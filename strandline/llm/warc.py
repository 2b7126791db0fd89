"""WARC archives compressed record by record with Zstandard and a shared dictionary.

An archive starts with a skippable frame (magic 0x184D2A5D) that holds the dictionary; every record after it is
one frame of its own, so that a reader can start at any record. Records are WARC/1.1 ``response`` or ``revisit``;
of records with equal payloads of at least ``least`` bytes the one with the largest id is the response and the
others refer to it. Archives are written by tasks to the shared folder under names of their own attempt; the
manifest, which Spark commits, names those that count. A reader checks every frame, header and length.

Defined results: a NULL payload is empty; empty and short payloads are always responses; repeated rows with one
page_id each get a record, and an equal payload under the same id is not a revisit of itself; a NULL page_id gets
a record too, which never is what others refer to if one of them has an id; extra columns are ignored; an empty table writes no archive.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._store import Store, lean, shared_dir

MAGIC = 0x184D2A5D
ZSTD_MAGIC = 0xFD2FB528
DATE = "2024-01-01T00:00:00Z"
NO_ID = "none"
PIECE = 8 << 10


@dataclass(frozen=True)
class Params:
    """``least`` bytes of a payload that may be a revisit; ``level``; dictionary of ``dict_bytes`` trained on at most
    ``samples`` payloads, ``sample_bytes`` of each; ``archive_bytes``: an archive is closed beyond this size."""

    least: int = 1000
    level: int = 3
    dict_bytes: int = 64 << 10
    samples: int = 400
    sample_bytes: int = 16 << 10
    archive_bytes: int = 8 << 20
    salts: int = 32


class FormatError(ValueError):
    """What is read is not a whole, valid archive."""


# ---------------------------------------------------------------- one record


def encode_record(page_id: int | None, url: str, payload: bytes, kind: str, refers_to: int | None) -> bytes:
    """Header lines, a blank line, the block, two line ends. A revisit has no block but keeps the payload's digest and length."""
    url = "".join(c if c not in "\r\n" else " " for c in url or "")
    block = payload if kind == "response" else b""
    digest = hashlib.sha1(payload).hexdigest()
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{NO_ID if page_id is None else page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {url}", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}"]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def decode_record(raw: bytes) -> dict:
    """Fields of a record; anything missing, malformed or of a wrong length is an error."""
    head, sep, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if not sep or lines[0] != "WARC/1.1":
        raise FormatError("no WARC/1.1 header")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon or not name or name != name.strip():
            raise FormatError(f"bad header line: {line[:80]!r}")
        if name.lower() in fields:
            raise FormatError(f"header twice: {name}")
        fields[name.lower()] = value.strip()
    try:
        length, kind = int(fields["content-length"]), fields["warc-type"]
        name = fields["warc-record-id"].removeprefix("<urn:page:").removesuffix(">")
        page = None if name == NO_ID else int(name)
        digest, size = fields["warc-payload-digest"].removeprefix("sha1:"), int(fields["x-payload-length"])
        refers = int(fields["warc-refers-to"].removeprefix("<urn:page:").removesuffix(">")) if kind == "revisit" else None
    except (KeyError, ValueError) as e:
        raise FormatError(f"missing or bad header: {e}") from None
    if kind not in ("response", "revisit"):
        raise FormatError(f"unknown record type {kind!r}")
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise FormatError("content length does not match the record")
    block = rest[:length]
    if kind == "response" and (size != length or hashlib.sha1(block).hexdigest() != digest):
        raise FormatError("payload does not match its digest or length")
    return {"page_id": page, "url": fields.get("warc-target-uri", ""), "record_type": kind, "refers_to": refers, "payload_digest": digest, "payload_bytes": size, "payload": block if kind == "response" else None}


# ---------------------------------------------------------------- one archive


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", MAGIC, len(dictionary)) + dictionary


def read_archive(raw: bytes) -> Iterator[dict]:
    """The records of an archive: dictionary first, then exactly one frame per record."""
    if len(raw) < 8:
        raise FormatError("too short for an archive")
    magic, size = struct.unpack_from("<II", raw)
    if magic != MAGIC or 8 + size > len(raw):
        raise FormatError("no leading dictionary frame")
    body = raw[8 : 8 + size]
    if len(body) >= 4 and struct.unpack_from("<I", body)[0] == ZSTD_MAGIC:  # the dictionary itself may be compressed
        body = zstandard.ZstdDecompressor().decompress(body)
    table = zstandard.ZstdCompressionDict(body) if body else None
    make = zstandard.ZstdDecompressor(dict_data=table) if table else zstandard.ZstdDecompressor()
    at, view = 8 + size, memoryview(raw)
    while at < len(raw):
        if len(raw) - at < 4 or struct.unpack_from("<I", raw, at)[0] != ZSTD_MAGIC:
            raise FormatError(f"no frame at byte {at}")
        d, record, end = make.decompressobj(), [], at
        try:
            while not d.eof and end < len(raw):  # in pieces, since what a frame leaves over of its last one is copied
                piece = view[end : end + PIECE]
                record.append(d.decompress(piece))
                end += len(piece)
        except zstandard.ZstdError as e:
            raise FormatError(f"bad frame at byte {at}: {e}") from None
        if not d.eof:
            raise FormatError("the last frame is cut off")
        at = end - len(d.unused_data)
        yield decode_record(b"".join(record))


def train_dictionary(payloads: list[bytes], p: Params) -> bytes:
    """A dictionary from sampled payloads; empty where there is too little to train on."""
    parts = [x[: p.sample_bytes] for x in payloads if x]
    if len(parts) < 8:
        return b""
    try:
        return zstandard.train_dictionary(min(p.dict_bytes, max(1024, sum(map(len, parts)) // 8)), parts).as_bytes()
    except zstandard.ZstdError:
        return b""


# ---------------------------------------------------------------- distributed


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri.removeprefix("file:"))


def plan(pages: DataFrame, p: Params, store: Store) -> DataFrame:
    """page_id, url, payload, record_type, refers_to. Digests meet in a grouped maximum; pages look up repeated ones only."""
    x = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    x = x.withColumns({"d": F.sha1("payload"), "n": F.octet_length("payload")})
    best = x.filter(F.col("n") >= p.least).groupBy("d").agg(F.max("page_id").alias("top"), F.min("page_id").alias("low"), F.count(F.lit(1)).alias("k"), F.count("page_id").alias("named")).filter("low < top or named between 1 and k - 1")
    best = store.save(best, "repeated")
    # a payload with many copies is looked up under several salted keys, so its pages are dealt over tasks
    salt = F.explode(F.when(F.col("k") > 256, F.sequence(F.lit(0), F.lit(p.salts - 1))).otherwise(F.array(F.lit(0))))
    keys = best.select("d", "top", (F.col("k") > 256).alias("hot"), salt.alias("salt"))
    hot = best.filter("k > 256").select("d", F.lit(True).alias("is_hot"))
    n_hot = hot.count()
    x = x.join(F.broadcast(hot) if n_hot <= 500_000 else hot, "d", "left")
    x = x.withColumn("salt", F.when(F.col("is_hot"), F.pmod(F.xxhash64("page_id", "url"), F.lit(p.salts))).otherwise(0).cast("int"))
    n = keys.count()
    y = x.join(F.broadcast(keys) if n <= 300_000 else keys, ["d", "salt"], "left")
    revisit = F.col("top").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("top")) & (F.col("n") >= p.least)
    return y.select("page_id", "url", "payload", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("top")).alias("refers_to"))


def write_archives(records: DataFrame, uri: str, dictionary: bytes, p: Params) -> DataFrame:
    """Write records to archives below ``uri``; the manifest (path, records, bytes) names what was written."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _fs(uri)
        store.create_dir(root, recursive=True)
        table = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        pack = zstandard.ZstdCompressor(level=p.level, dict_data=table, write_content_size=True, write_checksum=True)
        out: list[bytes] = []
        size, n = 0, 0

        def close():
            nonlocal out, size, n
            name = f"{root}/{uuid.uuid4().hex}.warc.zst"  # a retried task writes another file; the manifest has only one of them
            with store.open_output_stream(name + ".part") as f:
                f.write(dictionary_frame(dictionary))
                for x in out:
                    f.write(x)
            store.move(name + ".part", name)
            row = pa.RecordBatch.from_arrays([pa.array([name.rsplit("/", 1)[1]]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=["name", "records", "bytes"])
            out, size, n = [], 0, 0
            return row

        for b in batches:
            for page, url, payload, kind, refers in zip(*(b.column(c) for c in ("page_id", "url", "payload", "record_type", "refers_to")), strict=True):
                frame = pack.compress(encode_record(page.as_py(), url.as_py(), payload.as_py(), kind.as_py(), refers.as_py()))
                out.append(frame)
                size += len(frame)
                n += 1
                if size >= p.archive_bytes:
                    yield close()
        if n:
            yield close()

    return records.mapInArrow(lean(run), "name string, records long, bytes long")


def read_archives(spark: SparkSession, uri: str, names: DataFrame) -> DataFrame:
    """All records of the archives in ``names`` (name, records), as a reader that knows nothing else sees them.

    An archive with another number of records than the manifest says is an error.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = _fs(uri)
        for b in batches:
            for name, records in zip(b.column("name").to_pylist(), b.column("records").to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{name}") as f:
                    rows, n, held = [], 0, 0
                    for r in read_archive(f.read()):
                        rows.append(r)
                        n += 1
                        held += r["payload_bytes"]
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, RECORD)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_pylist(rows, RECORD)
                    if n != records:
                        raise FormatError(f"{name}: {n} records, {records} were written")

    wide = names.select("name", "records").repartition(max(spark.sparkContext.defaultParallelism, 1) * 2)
    return wide.mapInArrow(lean(run), "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary")


RECORD = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()), ("payload", pa.binary())])


def round_trip(pages: DataFrame, p: Params = Params()) -> DataFrame:
    """Write all pages to archives in the shared folder and read them back: one row per record, payload of responses included."""
    spark = pages.sparkSession
    store = Store(spark)
    # a bounded sample for the dictionary: so many heads of so many bytes at most
    head = pages.filter("html is not null").select(F.substring(F.col("html").cast("binary"), 1, p.sample_bytes).alias("head")).limit(p.samples).collect()
    dictionary = train_dictionary([bytes(r["head"]) for r in head], p)
    uri = f"{shared_dir(spark)}/archives-{uuid.uuid4().hex}"
    manifest = store.save(write_archives(plan(pages, p, store), uri, dictionary, p), "manifest")
    return read_archives(spark, uri, manifest)


__all__ = ["FormatError", "Params", "read_archive", "read_archives", "round_trip", "write_archives", "pd"]
