"""WARC archives with a Zstandard dictionary, one frame for each record.

Each archive starts with a skippable frame that holds a dictionary built from the archive's own first records; then
every record is a frame of its own, compressed with it, so single records can be read. Tasks write archives of bounded
size below one folder and commit them by a manifest; archives of lost or repeated attempts are not in the manifest and
are not read. Reading back goes through Spark's own file reader.
"""

from __future__ import annotations

import base64
import hashlib
import io
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from palisade.llm.common import stored, work_folder

#: Frame that holds the dictionary, and the first bytes of a dictionary (fixed values of the format).
SKIPPABLE = 0x184D2A5D
DICTIONARY = 0xEC30A437
ZSTD = 0xFD2FB528
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payload bytes in front of an archive from which its dictionary is built, and the dictionary's size.
SAMPLE_BYTES, DICT_BYTES = 2 << 20, 32 << 10


def base32_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload, usedforsecurity=False).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC record; a revisit leaves the payload out and names its length."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url:
        head.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>"]
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Payload-Length: {len(payload)}", "Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A trained dictionary; from too few samples to train on, their own bytes."""
    if len(samples) >= 16 and sum(map(len, samples)) >= 8 * DICT_BYTES:
        try:
            return zstandard.train_dictionary(DICT_BYTES, samples, k=512, d=8)
        except zstandard.ZstdError:
            pass
    return zstandard.ZstdCompressionDict(b"".join(samples)[-DICT_BYTES:] or b"\0" * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


class Archive:
    """Holds back records until the dictionary is built, then compresses each as it comes."""

    def __init__(self, level: int) -> None:
        self.level, self.waiting, self.waits, self.out, self.records, self.compressor = level, [], 0, io.BytesIO(), 0, None

    def add(self, data: bytes) -> None:
        self.records += 1
        if self.compressor is not None:
            self.out.write(self.compressor.compress(data))
            return
        self.waiting.append(data)
        self.waits += len(data)
        if self.waits >= SAMPLE_BYTES:
            self.begin()

    def begin(self) -> None:
        if self.compressor is None:
            made = dictionary(self.waiting)
            raw = made.as_bytes()
            self.out.write(struct.pack("<II", SKIPPABLE, len(raw)) + raw)
            self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=made)
            for data in self.waiting:
                self.out.write(self.compressor.compress(data))
            self.waiting = []

    def size(self) -> int:
        return self.out.tell() + (self.waits if self.compressor is None else 0)

    def bytes(self) -> bytes:
        self.begin()
        return self.out.getvalue()


def read_archive(data: bytes) -> Iterator[dict]:
    """Records of an archive; raises if a payload does not have its digest."""
    magic, size = struct.unpack_from("<II", data)
    if magic != SKIPPABLE:
        raise ValueError("an archive without its dictionary in front")
    raw = data[8 : 8 + size]
    first = int.from_bytes(raw[:4], "little")
    if first == ZSTD:
        raw = zstandard.ZstdDecompressor().decompress(raw)
        first = int.from_bytes(raw[:4], "little")
    kind = zstandard.DICT_TYPE_FULLDICT if first == DICTIONARY else zstandard.DICT_TYPE_RAWCONTENT
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw, dict_type=kind))
    stream = io.BufferedReader(reader.stream_reader(memoryview(data)[8 + size :], read_across_frames=True), 1 << 20)
    while stream.readline():  # the version
        head = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b": ")
            head[name.decode().lower()] = value.decode()
        block = stream.read(int(head["content-length"]))
        stream.read(4)
        payload = block.partition(b"\r\n\r\n")[2]
        digest = head["warc-payload-digest"].removeprefix("sha1:")
        revisit = head["warc-type"] == "revisit"
        if not revisit and base32_digest(payload) != digest:
            raise ValueError(f"a payload of {head['warc-record-id']} that is not the one of its digest")
        ids = [int(x) if (x := head.get(k, "").removeprefix("<urn:page:").rstrip(">")) else None for k in ("warc-record-id", "warc-refers-to")]
        yield {"page_id": ids[0], "url": head.get("warc-target-uri"), "payload_bytes": int(head["warc-payload-length"]), "payload_digest": digest, "record_type": head["warc-type"], "refers_to": ids[1], "payload": None if revisit else payload}


def write_warc(pages: DataFrame, folder: str, least: int = 0, archive_bytes: int = 16 << 20, level: int = 3, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Archives below `folder`, and their stored manifest (archive, records, bytes).

    Of records with equal payloads of at least `least` bytes, those with the largest id are responses and the others
    revisit it. A null payload is empty; a null id is never the largest, and is a response if there is no other;
    repeated rows of the largest id are responses each; other columns of `pages` are not read; an empty table writes
    nothing. Digests are compared in a table of (id, digest), so equal payloads never meet in one place."""
    rows = pages.select(F.col(page_id).cast("long").alias("i"), F.col(url).alias("u"), F.coalesce(F.col(html), F.lit("")).alias("h"))
    digest = F.sha1(F.col("h").cast("binary"))
    keys = rows.filter(F.octet_length("h") >= least).select("i", digest.alias("d"))
    top = keys.groupBy("d").agg(F.max("i").alias("top"), F.count("*").alias("n")).filter("n > 1").select(F.col("d").alias("td"), "top")
    refs = keys.join(top, F.col("d") == F.col("td")).filter("top is not null and not i <=> top").select(F.col("i").alias("ri"), F.col("d").alias("rd"), "top").distinct()
    dealt = rows.join(refs, F.col("i").eqNullSafe(F.col("ri")) & (digest == F.col("rd")), "left").select("i", "u", "h", "top")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        place, base = fs.FileSystem.from_uri(folder)
        place.create_dir(base, recursive=True)
        task, n = TaskContext.get(), 0

        def close(archive: Archive) -> pa.RecordBatch:
            name, data = f"part-{task.partitionId():05d}-{task.taskAttemptId()}-{n:05d}.warc.zst", archive.bytes()
            with place.open_output_stream(f"{base}/{name}", compression=None) as out:
                out.write(data)
            return pa.record_batch([[name], [archive.records], [len(data)]], ["archive", "records", "bytes"])

        archive = Archive(level)
        for batch in batches:
            columns = (batch.column("i").to_pylist(), batch.column("u").to_pylist(), batch.column("h").cast(pa.binary()), batch.column("top").to_pylist())
            for i, u, h, top_id in zip(*columns, strict=True):
                payload = h.as_py()
                archive.add(record(i, u, payload, base32_digest(payload), top_id, top_id is not None))
                if archive.size() >= archive_bytes:
                    yield close(archive)
                    n, archive = n + 1, Archive(level)
        if archive.records:
            yield close(archive)

    return stored(dealt.mapInArrow(write, "archive string, records long, bytes long"))


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def read_warc(spark: SparkSession, folder: str, manifest: DataFrame | None = None) -> DataFrame:
    """Records of the archives below `folder`, payload included; of those in the manifest, if one is given."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    if manifest is not None and manifest.isEmpty():
        return spark.createDataFrame([], RECORDS)
    files = spark.read.schema(schema).format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    if manifest is not None:
        files = files.join(manifest.select("archive"), F.substring_index("path", "/", -1) == F.col("archive"), "left_semi")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RECORDS.split(", ")]
        types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for content in batch.column("content"):
                held, size = [], 0
                for row in read_archive(content.as_py()):
                    held.append(row)
                    size += row["payload_bytes"]
                    if size > 8 << 20:
                        yield pa.record_batch([pa.array([r[n] for r in held], t) for n, t in zip(names, types, strict=True)], names)
                        held, size = [], 0
                if held:
                    yield pa.record_batch([pa.array([r[n] for r in held], t) for n, t in zip(names, types, strict=True)], names)

    return files.select("content").mapInArrow(read, RECORDS)


def archive_pages(pages: DataFrame, **options) -> DataFrame:
    """Writes `pages` to archives below the work folder and reads them back."""
    spark = pages.sparkSession
    folder = f"{work_folder(spark)}/warc-{uuid.uuid4().hex}"
    return read_warc(spark, folder, write_warc(pages, folder, **options))
