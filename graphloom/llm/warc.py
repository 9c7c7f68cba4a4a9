"""WARC archives of individually compressed records with a shared Zstandard dictionary, and their reader."""

from __future__ import annotations

import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import cut, map_arrow

# Fixed values of the WARC and Zstandard formats.
SKIPPABLE = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: Dictionary bytes; records it is fitted on at most, and bytes of one payload of these at most; bytes of records after which a new archive begins.
DICTIONARY, SAMPLES, SAMPLE_BYTES, ARCHIVE_BYTES = 64 << 10, 1000, 64 << 10, 256 << 20
#: Rows up to which the table of repeated payloads is broadcast (some 100 bytes a row), and parts of a hot payload's rows where it is not.
BROADCAST_ROWS, SALTS = 200_000, 64
_PAGE = "urn:page:"


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder[5:].lstrip("/")
    return (fs.LocalFileSystem(), folder) if "://" not in folder else fs.FileSystem.from_uri(folder)


def build_dictionary(samples: list[bytes], size: int = DICTIONARY) -> bytes:
    """A Zstandard dictionary of the samples; of few or odd ones their own bytes, of none an empty one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes() if len(samples) > 6 else b"".join(samples)[:size]
    except zstandard.ZstdError:
        return b"".join(samples)[:size]


def record_id(page_id: int | None, url: str | None, digest: str) -> str:
    """A record's name: the page and a digest of url and payload, so that only rows that repeat throughout share one."""
    tail = hashlib.sha1(f"{url or ''}\n{digest}".encode("utf-8", "replace")).hexdigest()[:20]
    return f"<{_PAGE}{'null' if page_id is None else page_id}:{tail}>"


def _head(kind: str, name: str, date: str, fields: list[str], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name}", f"WARC-Date: {date}", *fields, f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def record(page_id: int | None, url: str | None, payload: bytes, length: int, digest: str, refers_to: tuple[int, str | None] | None, date: str) -> bytes:
    """The bytes of one record: a response with its payload, or a revisit that refers to the response of (page_id, url)."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {length}\r\n\r\n".encode()
    fields = [f"WARC-Target-URI: {_uri(url)}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response"]
    if refers_to is not None:
        fields += [f"WARC-Refers-To: {record_id(*refers_to, digest)}", f"WARC-Refers-To-Target-URI: {_uri(refers_to[1])}", f"WARC-Refers-To-Date: {date}", f"WARC-Profile: {IDENTICAL}"]
    return _head("response" if refers_to is None else "revisit", record_id(page_id, url, digest), date, fields, http + payload if refers_to is None else http)


def _uri(url: str | None) -> str:
    return (url or "urn:unknown").replace("\r", "%0D").replace("\n", "%0A")


def warcinfo(path: str, date: str) -> bytes:
    """The record that opens an archive."""
    block = b"software: graphloom\r\nformat: WARC File Format 1.1\r\n"
    name = f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, path)}>"
    return _head("warcinfo", name, date, [f"WARC-Filename: {path.rpartition('/')[2]}", "Content-Type: application/warc-fields"], block)


class ArchiveWriter:
    """One archive: a skippable frame with the dictionary, then a frame for each record, the first of them about the archive. It appears under its name when complete."""

    def __init__(self, files: fs.FileSystem, path: str, dictionary: bytes, date: str):
        self.files, self.path, self.part = files, path, f"{path}.{uuid.uuid4().hex}.part"
        self.out, self.records, self.raw = files.open_output_stream(self.part, compression=None), 0, 0
        packed = zstandard.ZstdCompressor(level=9).compress(dictionary)
        self.out.write(struct.pack("<II", SKIPPABLE, len(packed)) + packed)
        self.coder = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=3)
        self.out.write(self.coder.compress(warcinfo(path, date)))

    def add(self, data: bytes) -> None:
        self.out.write(self.coder.compress(data))
        self.records, self.raw = self.records + 1, self.raw + len(data)

    def close(self) -> tuple[str, int, int, int]:
        stored = self.out.tell()
        self.out.close()
        self.files.move(self.part, self.path)
        return self.path, self.records, self.raw, stored


def read_archive(source) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive but its warcinfo, from a binary file object; the dictionary comes from its first frame."""
    magic, size = struct.unpack("<II", source.read(8))
    packed = source.read(size)
    if magic != SKIPPABLE or len(packed) != size:
        raise ValueError("no leading dictionary frame")
    dictionary = zstandard.ZstdDecompressor().decompress(packed) if packed[:4] == ZSTD_MAGIC else packed
    coder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
    stream = io.BufferedReader(coder.stream_reader(source, read_across_frames=True), 1 << 20)
    while line := stream.readline():
        if line != b"WARC/1.1\r\n":
            raise ValueError(f"not a record: {line[:40]!r}")
        head = {}
        while (line := stream.readline()) != b"\r\n":
            name, _, value = line.decode().rstrip("\r\n").partition(": ")
            head[name] = value
        block = stream.read(int(head["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record has no end")
        if head["WARC-Type"] != "warcinfo":
            yield head, block


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 1000, date: str = "2024-01-01T00:00:00Z") -> DataFrame:
    """Writes a record for each row of (page_id, url, html) to archives in ``folder``; gives the (checkpointed) manifest (path, records, raw_bytes, stored_bytes).

    The payload is the html in UTF-8, empty for null. Of records with equal payloads of at least ``least_bytes`` the one
    with the largest page_id is a response and the others revisit it; all smaller ones are responses, and so are rows
    with a null page_id and, of rows that share the largest page_id, all. The dictionary is fitted on the bytes of
    SAMPLES records, those of least hash whose payload has at most SAMPLE_BYTES; it lies in each archive. A partition's
    archives have names of their own and are moved into place when complete, so that a task that runs again replaces
    what an earlier attempt left. Payloads are not shuffled unless very many of them repeat. An empty table gives no
    archive; extra columns are not read.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.select("*", F.length("payload").cast("long").alias("size"), F.sha1("payload").alias("digest"))
    hashed = rows.where(F.col("size") <= SAMPLE_BYTES).select(F.xxhash64("page_id", "digest").alias("h"), "page_id", "url", "size", "digest", "payload")
    least = [r[0] for r in hashed.select("h").distinct().orderBy("h").limit(SAMPLES).collect()]
    found = hashed.where(F.col("h") <= least[-1]).dropDuplicates(["h"]).collect() if least else []  # SAMPLES rows at most
    samples = [record(r.page_id, r.url, bytes(r.payload), r["size"], r.digest, None, date) for r in sorted(found, key=lambda r: r.h)]
    dictionary = build_dictionary(samples)
    alike = rows.where(F.col("size") >= least_bytes).groupBy("digest", "size").agg(F.max(F.struct("page_id", "url")).alias("head"), F.count(F.lit(1)).alias("m"))
    alike = cut(alike.where("m > 1").select("digest", "size", "head"))
    if alike.count() <= BROADCAST_ROWS:
        placed = rows.join(F.broadcast(alike), ["digest", "size"], "left")
    else:  # only rows that can repeat are dealt, a hot payload's to several tasks
        dealt = rows.withColumn("salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
        alike = alike.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        large = dealt.where(F.col("size") >= least_bytes).join(alike, ["digest", "size", "salt"], "left").drop("salt")
        placed = large.unionByName(rows.where(F.col("size") < least_bytes).withColumn("head", F.lit(None).cast(alike.schema["head"].dataType)))
    again = F.col("page_id") < F.col("head.page_id")
    placed = placed.select("page_id", "url", "size", "digest", F.when(again, F.col("head.page_id")).alias("refers_to"), F.when(again, F.col("head.url")).alias("refers_url"), F.when(again, F.lit(b"")).otherwise(F.col("payload")).alias("payload"))
    schema = pa.schema([("path", pa.string()), ("records", pa.int64()), ("raw_bytes", pa.int64()), ("stored_bytes", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(folder)
        files.create_dir(root, recursive=True)
        number, now, done = TaskContext.get().partitionId(), None, []
        for batch in batches:
            for r in batch.to_pylist():
                if now is None:
                    now = ArchiveWriter(files, f"{root}/part-{number:06d}-{len(done):04d}.warc.zst", dictionary, date)
                head = None if r["refers_to"] is None else (r["refers_to"], r["refers_url"])
                now.add(record(r["page_id"], r["url"], r["payload"], r["size"], r["digest"], head, date))
                if now.raw >= ARCHIVE_BYTES:
                    done.append(now.close())
                    now = None
        if now is not None:
            done.append(now.close())
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*done, strict=True), schema.types, strict=True)] if done else [pa.array([], t) for t in schema.types], schema=schema)

    return cut(map_arrow(placed, run, "path string, records long, raw_bytes long, stored_bytes long"))


def read_archives(manifest: DataFrame, folder: str) -> DataFrame:
    """(page_id, url, record_type, payload, payload_bytes, payload_digest, refers_to) of the records of the archives whose paths the manifest has.

    Records come one at a time, so an archive of any size can be read; a revisit's payload is null. A response whose
    digest is wrong fails, an empty manifest gives an empty table, and records that repeat come as often as they stand.
    """
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64())])

    def number(name: str | None) -> int | None:
        tail = (name or "").strip("<>").removeprefix(_PAGE).partition(":")[0]
        return int(tail) if tail.lstrip("-").isdigit() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, _ = _open(folder)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, held = [], 0
                with files.open_input_stream(path, compression=None) as source:
                    for head, block in read_archive(source):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        kind, digest = head["WARC-Type"], head["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and hashlib.sha1(payload).hexdigest() != digest:
                            raise ValueError(f"digest of {head['WARC-Record-ID']}")
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        rows.append((number(head["WARC-Record-ID"]), head["WARC-Target-URI"], kind, payload if kind == "response" else None, size, digest, number(head.get("WARC-Refers-To"))))
                        held += len(payload)
                        if held > 4 << 20 or len(rows) >= 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    tasks = max(1, min(manifest.count(), 10_000))
    return map_arrow(manifest.select("path").repartition(tasks), run, "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")
