"""Dictionary-compressed WARC archives.

Each archive begins with a skippable frame that holds a Zstandard dictionary built
from the archive's own records; each record is a frame of its own, compressed with
that dictionary. Pages with equal payloads are archived once; the others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.session import shared_folder, stored
from .common import whole_text

# Fixed value: the magic number of the skippable frame for dictionaries in WARC files.
DICTIONARY_FRAME = 0x184D2A5D
# Bytes of records in one archive; a task writes as many archives as it needs.
ARCHIVE_BYTES = 16 << 20
DICTIONARY_BYTES = 64 << 10
# Bytes of records that the dictionary is built from, evenly over the archive.
TRAINING_BYTES = 4 << 20
LEVEL = 6
EQUAL_FROM_BYTES = 0


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record(kind: str, page_id: int | None, url: str | None, payload: bytes, payload_digest: str, length: int,
           refers_to: int | None) -> bytes:
    """A WARC/1.1 record. A revisit has the headers of the full payload but not its bytes."""
    block = payload if kind == "response" else b""
    name = lambda number: f"<urn:page:{number}>" if number is not None else f"<urn:uuid:{uuid.uuid4()}>"
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: text/html; charset=utf-8", f"WARC-Payload-Digest: sha1:{payload_digest}",
        f"X-Payload-Length: {length}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + url.replace("\r", "%0D").replace("\n", "%0A"))
    if refers_to is not None:
        lines.append(f"WARC-Refers-To: {name(refers_to)}")
        lines.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Page id, type, digest and lengths of a record, checked against its payload."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC/1.1 record")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    size = int(headers["Content-Length"])
    block = rest[:size]
    if rest[size:] != b"\r\n\r\n":
        raise ValueError("the record does not end where its length says")
    number = lambda name: int(name[10:-1]) if name.startswith("<urn:page:") else None
    declared = headers["WARC-Payload-Digest"].removeprefix("sha1:")
    length = int(headers["X-Payload-Length"])
    if headers["WARC-Type"] == "response" and (digest(block) != declared or len(block) != length):
        raise ValueError("the payload does not match its digest")
    return {"page_id": number(headers["WARC-Record-ID"]), "record_type": headers["WARC-Type"],
            "url": headers.get("WARC-Target-URI"), "payload_digest": declared, "payload_bytes": length,
            "payload": block, "refers_to": number(headers.get("WARC-Refers-To", ""))}


def archive(records: list[bytes]) -> bytes:
    """A dictionary frame and one frame per record."""
    import zstandard

    size = sum(map(len, records))
    step = max(1, -(-size // TRAINING_BYTES))
    # Long records are sampled by their beginnings; training needs several samples.
    samples = [r[:32 << 10] for r in records[::step]]
    dictionary = zstandard.ZstdCompressionDict(b"")
    if len(samples) >= 8 and sum(map(len, samples)) > 64 << 10:
        try:
            dictionary = zstandard.train_dictionary(DICTIONARY_BYTES, samples, k=512, d=8)
        except zstandard.ZstdError:  # samples too alike or too short to train on
            pass
    raw = dictionary.as_bytes()
    writer = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary) if raw else zstandard.ZstdCompressor(level=LEVEL)
    return struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw + b"".join(map(writer.compress, records))


def records_of(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, read a frame at a time."""
    import zstandard

    magic, size = struct.unpack("<II", stream.read(8))
    if magic != DICTIONARY_FRAME:
        raise ValueError("the archive does not begin with its dictionary")
    raw = stream.read(size)
    reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw)) if raw else zstandard.ZstdDecompressor()
    pending = b""
    while True:
        frame, out = reader.decompressobj(), []
        while not frame.eof:
            pending = pending or stream.read(chunk)
            if not pending:
                if out:
                    raise ValueError("the archive ends inside a record")
                return
            out.append(frame.decompress(pending))
            pending = frame.unused_data if frame.eof else b""
        yield b"".join(out)


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """``path, records, bytes`` of archives of ``pages`` (page_id, url, html, payload_digest, record_type, refers_to).

    A file is written under a name of its own attempt and moved into place, so a
    repeated task leaves no half-written archive among those listed. The table is
    stored: reading it again writes nothing.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
        files.create_dir(root, recursive=True)
        context = TaskContext.get()
        held: list[bytes] = []
        size = number = 0

        def flush() -> pa.RecordBatch:
            nonlocal size, number
            data = archive(held)
            name = f"part-{context.partitionId():05d}-{number:05d}-{context.taskAttemptId()}.warc.zst"
            with files.open_output_stream(f"{root}/.{name}") as out:
                out.write(data)
            files.move(f"{root}/.{name}", f"{root}/{name}")
            row = pa.RecordBatch.from_pydict({"path": [name], "records": [len(held)], "bytes": [len(data)]})
            held.clear()
            size, number = 0, number + 1
            return row

        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(6))):
                page_id, url, html, payload_digest, kind, refers_to = (v.as_py() for v in row)
                payload = html.encode("utf-8")
                held.append(record(kind, page_id, url, payload, payload_digest, len(payload), refers_to))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield flush()
        if held:
            yield flush()

    columns = ["page_id", "url", "html", "payload_digest", "record_type", "refers_to"]
    return stored(pages.select(columns).mapInArrow(write, "path string, records long, bytes long"))


def read_archives(listed: DataFrame, folder: str, with_payload: bool = False) -> DataFrame:
    """One row per record of the archives in ``listed``."""
    fields = [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
              ("record_type", pa.string()), ("refers_to", pa.int64())]
    if with_payload:
        fields.append(("payload", pa.binary()))
    schema = pa.schema(fields)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder.removeprefix("file:"))
        for batch in batches:
            for name, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, size, count = [], 0, 0
                with files.open_input_stream(f"{root}/{name}") as stream:
                    for data in records_of(stream):
                        found = parse(data)
                        rows.append({f.name: found[f.name] for f in schema})
                        size += len(data) if with_payload else 100
                        count += 1
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=schema)
                            rows, size = [], 0
                if count != expected:
                    raise ValueError(f"{name} has {count} records and not {expected}")
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=schema)

    types = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    # One archive is one unit of work; the list itself is small.
    spread = listed.select("path", "records").repartition(
        max(1, listed.sparkSession.sparkContext.defaultParallelism), F.xxhash64("path"))
    return spread.mapInArrow(read, types + (", payload binary" if with_payload else ""))


def with_record_types(pages: DataFrame, id_column: str = "page_id", html_column: str = "html", url_column: str = "url",
                      equal_from: int = EQUAL_FROM_BYTES) -> DataFrame:
    """Pages with the digest and type of their record.

    Of equal payloads of at least ``equal_from`` bytes the largest id is the
    response and the others revisit it; smaller payloads, and rows without an id, are
    responses. Rows that repeat the largest id are all responses.
    """
    rows = pages.select(F.col(id_column).cast("long").alias("page_id"), F.col(url_column).cast("string").alias("url"),
                        whole_text(html_column).alias("html"))
    payload = F.encode("html", "utf-8")
    keyed = rows.withColumn("sha", F.sha1(payload)).withColumn("size", F.octet_length(payload))
    narrow = keyed.where(F.col("page_id").isNotNull() & (F.col("size") >= equal_from)).select("page_id", "sha", "size")
    # Only payloads that occur again are joined, so most pages meet a small table.
    shared = stored(narrow.groupBy("sha", "size").agg(F.max("page_id").alias("first"), F.count("*").alias("n"))
                    .where("n > 1").select("sha", F.col("size").alias("_size"), "first"))
    joined = keyed.join(shared, (keyed.sha == shared.sha) & (F.col("size") == F.col("_size")), "left")
    revisit = F.col("first").isNotNull() & (F.col("page_id") < F.col("first"))
    return joined.select(
        "page_id", "url", "html", keyed.sha.alias("sha"),
        F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("first")).alias("refers_to"))


def _base32(hex_column: DataFrame) -> DataFrame:
    """``payload_digest`` from the hex SHA-1 in ``sha``: four base32 letters for every five hex digits."""
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
    letters = []
    for at in range(1, 41, 5):
        number = F.conv(F.substring("sha", at, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substring(F.lit(alphabet), F.shiftright(number, shift).bitwiseAND(F.lit(31)) + F.lit(1), F.lit(1)))
    return hex_column.withColumn("payload_digest", F.concat(*letters))


def archive_pages(pages: DataFrame, folder: str | None = None, equal_from: int = EQUAL_FROM_BYTES) -> tuple[DataFrame, DataFrame]:
    """Write all pages and return the list of archives and the records read back.

    ``folder`` has to be one that all executors reach; by default a new one in the
    shared folder. Null html is an empty payload, null ids and urls are archived
    without, repeated rows get a record each, other columns are not read, and an
    empty table gives no archive and no rows.
    """
    folder = folder or f"{shared_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    typed = _base32(with_record_types(pages, equal_from=equal_from))
    listed = write_archives(typed, folder)
    return listed, read_archives(listed, folder)
