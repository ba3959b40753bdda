"""WARC archives with a Zstandard dictionary: a writer and a reader.

Each partition becomes one archive: a leading skippable frame holds a dictionary (itself compressed), built from up to
SAMPLE bytes of the archive's own records; then each record is a frame of its own, so a reader may seek to any.
Of records with equal payloads of at least LEAST bytes the one with the smallest page_id is a response; the others are
revisits that refer to it and hold the HTTP header alone.

Executors write to the shared folder through pyarrow's file systems; a file's name holds its task attempt, and only the
files of finished attempts get into the list that is read back.

Null html is an empty payload, a null url an empty target. Repeated rows are records each: those that share the smallest
page_id of a payload are all responses. A null page_id never counts as smallest unless all are null. Other columns are never read.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, fresh_dir

LEAST = 100
#: Bytes of records that a dictionary is built from, and of the dictionary.
SAMPLE, DICTIONARY = 4 << 20, 64 << 10
LEVEL = 3
DATE = "2026-01-01T00:00:00Z"
#: Fixed values of the formats.
SKIPPABLE, ZSTD = 0x184D2A5D, b"\x28\xb5\x2f\xfd"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Payloads of several records up to which their list is broadcast.
BROADCAST_ROWS = 200_000
_ID = re.compile(rb"<urn:hexlode:page:(-?\d+|null)>")


def roles(pages: DataFrame) -> DataFrame:
    """page_id, url, html, digest and first (the smallest page_id with that payload, where the payload can be revisited)."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).cast("binary").alias("html")).withColumn("digest", F.unhex(F.sha2("html", 256)))
    several = rows.where(F.length("html") >= LEAST).groupBy(F.col("digest").alias("d")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    several = cut(several)
    small = several.count() <= BROADCAST_ROWS
    joined = rows.join(F.broadcast(several) if small else several, F.col("digest") == F.col("d"), "left")
    return joined.select("page_id", "url", "html", "digest", "first", F.col("d").isNotNull().alias("shared"))


def record(page_id: int | None, url: str | None, payload: bytes, digest: bytes, first: int | None, shared: bool) -> bytes:
    revisit = shared and page_id != first
    name = lambda i: f"<urn:hexlode:page:{'null' if i is None else i}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {quote(url or '', safe=":/?#[]@!$&'()*+,;=%~")}", f"WARC-Payload-Digest: sha256:{digest.hex()}",
    ]
    if revisit:
        head += [f"WARC-Refers-To: {name(first)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary(records: list[bytes]):
    """A trained dictionary, or one of raw content where there is too little to train on."""
    import zstandard

    try:
        return zstandard.train_dictionary(DICTIONARY, records, level=LEVEL)
    except zstandard.ZstdError:
        raw = b"".join(records)[-DICTIONARY:].rjust(8, b" ")
        return zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _files(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", folder))


class ArchiveWriter:
    """Writes records to a binary stream; holds SAMPLE bytes of them until the dictionary is built."""

    def __init__(self, out) -> None:
        self.out, self.held, self.size, self.compressor = out, [], 0, None

    def add(self, data: bytes) -> None:
        if self.compressor is None:
            self.held.append(data)
            self.size += len(data)
            if self.size >= SAMPLE:
                self._begin()
        else:
            self.out.write(self.compressor.compress(data))

    def _begin(self) -> None:
        import zstandard

        made = dictionary(self.held)
        content = zstandard.ZstdCompressor(level=19).compress(made.as_bytes())
        self.out.write(struct.pack("<II", SKIPPABLE, len(content)) + content)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=made, write_content_size=True)
        held, self.held = self.held, []
        for data in held:
            self.add(data)

    def close(self) -> None:
        if self.compressor is None:
            self._begin()


def archive_records(stream) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    import zstandard

    head = stream.read(8)
    if not head:
        return
    magic, size = struct.unpack("<II", head)
    if magic != SKIPPABLE:
        raise ValueError("the archive doesn't begin with a dictionary")
    content = stream.read(size)
    if content[:4] == ZSTD:
        content = zstandard.ZstdDecompressor().decompress(content)
    trained = content[:4] == b"\x37\xa4\x30\xec"
    made = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)
    reader, data = zstandard.ZstdDecompressor(dict_data=made), stream.read(1 << 20)
    while data:
        frame, parts = reader.decompressobj(), []
        while True:
            parts.append(frame.decompress(data))
            if frame.eof:
                data = frame.unused_data or stream.read(1 << 20)
                break
            if not (data := stream.read(1 << 20)):
                raise ValueError("the archive ends within a record")
        yield b"".join(parts)


def parsed(data: bytes) -> tuple:
    """page_id, url, payload's bytes, digest, type, referred page_id; a response's digest is checked against its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(b": ", 1) for line in head.split(b"\r\n")[1:])
    block = rest[: int(fields[b"Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(re.search(rb"Content-Length: (\d+)", http)[1])
    digest, kind = fields[b"WARC-Payload-Digest"].removeprefix(b"sha256:").decode(), fields[b"WARC-Type"].decode()
    number = lambda x: None if (v := _ID.fullmatch(x)[1]) == b"null" else int(v)
    if kind == "response":
        if len(payload) != size or hashlib.sha256(payload).hexdigest() != digest:
            raise ValueError(f"record {fields[b'WARC-Record-ID']!r} is damaged")
    refers = number(fields[b"WARC-Refers-To"]) if kind == "revisit" else None
    return number(fields[b"WARC-Record-ID"]), fields[b"WARC-Target-URI"].decode(), size, digest, kind, refers


def write_archives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """Writes pages(page_id, url, html) to archives; a row (path, records) for each, kept in the shared folder."""
    folder = folder or fresh_dir(pages.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context, writer, n = TaskContext.get(), None, 0
        files, root = _files(folder)
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}.warc.zst"
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if writer is None:
                    files.create_dir(root, recursive=True)
                    out = files.open_output_stream(f"{root}/{name}", compression=None)
                    writer = ArchiveWriter(out)
                writer.add(record(*row))
                n += 1
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [name], "records": [n]})

    return cut(roles(pages).mapInArrow(run, "path string, records long")).withColumn("path", F.concat(F.lit(f"{folder}/"), "path"))


def read_archives(archives: DataFrame) -> DataFrame:
    """A row for each record of archives(path)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, kinds = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"), (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64())
        made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                folder, _, name = path.rpartition("/")
                files, root = _files(folder)
                rows = []
                with files.open_input_stream(f"{root}/{name}", compression=None) as stream:
                    for data in archive_records(stream):
                        rows.append(parsed(data))
                        if len(rows) == 5000:
                            yield made(rows)
                            rows = []
                if rows:
                    yield made(rows)

    # A task for each archive, about; without a number, all paths would be merged into one task.
    paths = cut(archives.select("path"))
    return paths.repartitionByRange(max(1, paths.count()), "path").mapInArrow(run, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long")


#: The rows that the archives hold, in DuckDB's SQL.
ORACLE_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, octet_length(encode(html)) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= {LEAST} AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= {LEAST} AND page_id <> first THEN first END AS refers_to
FROM f
"""
