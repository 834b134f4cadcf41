"""WARC archives compressed record by record with a dictionary of their own.

An archive begins with a skippable frame that holds a Zstandard dictionary built from the archive's records; each record
behind it is one frame, so that a reader can begin at any record. Payloads that occur again become revisit records.
Archives are rows of a table that Spark commits (one value is one whole ``.warc.zst`` file), so a lost task leaves
nothing behind; ``export_files`` lays them out as files.
"""
from __future__ import annotations

import base64
import hashlib
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import save

#: Payload bytes after which an archive is closed. A longer record makes an archive of its own size.
ARCHIVE_BYTES = 8_000_000
#: The dictionary's bytes, and the bytes of records, evenly spaced over the archive, that it is built from at most.
DICT_BYTES, DICT_SAMPLE_BYTES = 32_768, 1_000_000
#: Repeated payloads up to which their list is broadcast (about 100 bytes each).
BROADCAST_PAYLOADS = 200_000
SKIPPABLE = 0x184D2A5D
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:x-quillon:record:"
DATE = "1970-01-01T00:00:00Z"


def mark_revisits(records: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Adds ``refers_to`` to ``(id, uri, payload)``: for a payload of at least ``min_bytes`` that several records have, the
    largest of their ids, except in that record itself. Null payloads are empty. A null id refers to the largest
    id, and is no target; if all ids of a payload are null, nothing refers.

    Only digests are shuffled, after a partial maximum, so thousands of copies of one payload are one row a task. The list of
    repeated payloads is broadcast below a checked size and joined by shuffle beyond it.
    """
    records = records.withColumn("payload", F.coalesce(F.col("payload").cast("binary"), F.lit(b""))).withColumn("_sha", F.sha1("payload"))
    again = records.where(F.octet_length("payload") >= min_bytes).groupBy("_sha").agg(F.max("id").alias("_keep"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    again = save(again, "payloads")
    if again.limit(BROADCAST_PAYLOADS + 1).count() <= BROADCAST_PAYLOADS:
        again = F.broadcast(again)
    joined = records.join(again, "_sha", "left")
    target = F.when((F.octet_length("payload") >= min_bytes) & (F.col("id").isNull() | (F.col("id") != F.col("_keep"))), F.col("_keep"))
    return joined.select("id", "uri", "payload", target.alias("refers_to"))


def record(ident: int | None, uri: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """One uncompressed WARC record. A revisit keeps the HTTP header, with the full payload's length, and no payload."""
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + payload
    fields = [("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<{URN}{'' if ident is None else ident}>"),
              ("WARC-Date", DATE), ("WARC-Target-URI", " ".join((uri or "").split()))]
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<{URN}{refers_to}>")]
    fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """A ``.warc.zst`` file: dictionary in a leading skippable frame, then a frame for each record."""
    import zstandard as zstd

    step = max(1, -(-sum(map(len, records)) // DICT_SAMPLE_BYTES))
    sample = records[::step]
    try:
        dictionary = zstd.train_dictionary(min(DICT_BYTES, max(1024, sum(map(len, sample)) // 8)), sample, level=3)
    except zstd.ZstdError:  # too few records to train on: their own bytes are the dictionary
        dictionary = zstd.ZstdCompressionDict(b"".join(sample)[:DICT_BYTES], dict_type=zstd.DICT_TYPE_RAWCONTENT)
    press = zstd.ZstdCompressor(level=3, dict_data=dictionary, write_checksum=True)
    raw = dictionary.as_bytes()
    return b"".join([SKIPPABLE.to_bytes(4, "little") + len(raw).to_bytes(4, "little") + raw, *map(press.compress, records)])


def unpack(content: bytes):
    """The records of an archive, one at a time."""
    import zstandard as zstd

    at, dictionary = 0, None
    if int.from_bytes(content[:4], "little") == SKIPPABLE:
        at = 8 + int.from_bytes(content[4:8], "little")
        raw = content[8:at]
        dictionary = zstd.ZstdCompressionDict(raw, dict_type=zstd.DICT_TYPE_AUTO)
    press, view = zstd.ZstdDecompressor(dict_data=dictionary), memoryview(content)
    while at < len(content):
        frame, out = press.decompressobj(), []
        while not frame.eof:
            if at >= len(content):
                raise ValueError("archive ends within a record")
            part = view[at: at + 16384]
            out.append(frame.decompress(part))
            at += len(part)
        at -= len(frame.unused_data)
        yield b"".join(out)


def parse(raw: bytes) -> dict:
    """Fields of a record, by the names of the result of ``read_archives``."""
    head, _, block = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    block = block[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != length or base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest):
        raise ValueError(f"payload of {fields['WARC-Record-ID']} does not fit its digest")
    number = lambda x: int(y) if (y := x.strip("<>").removeprefix(URN)) else None
    return {"id": number(fields["WARC-Record-ID"]), "uri": fields["WARC-Target-URI"], "record_type": kind, "payload_digest": digest,
            "payload_bytes": length, "refers_to": number(fields["WARC-Refers-To"]) if kind == "revisit" else None, "payload": payload if kind == "response" else None}


def write_archives(records: DataFrame) -> DataFrame:
    """Archives of ``(id long, uri string, payload binary, refers_to long)`` as ``(archive, n_records, content)``.

    Each task writes the archives of its own rows; ids may repeat or be null, payloads may be empty, null or very long (a longer one than
    ``ARCHIVE_BYTES`` has an archive to itself). Header lines hold one line each: of a URI, runs of white space come back as one blank, and
    null as empty. Columns beside those four are not read. An empty table gives no archive.
    """
    def run(batches):
        name, held, size, number = uuid.uuid4().hex, [], 0, 0

        def close():
            return pa.RecordBatch.from_pydict({"archive": pa.array([f"{name}-{number:05d}.warc.zst"]), "n_records": pa.array([len(held)], pa.int64()), "content": pa.array([archive(held)], pa.binary())})

        for batch in batches:
            for ident, uri, payload, to in zip(*(batch.column(i) for i in range(4))):
                held.append(record(ident.as_py(), uri.as_py(), payload.as_py() or b"", to.as_py()))
                size += len(held[-1])
                if size > ARCHIVE_BYTES:
                    yield close()
                    held, size, number = [], 0, number + 1
        if held:
            yield close()

    return records.select("id", "uri", "payload", "refers_to").mapInArrow(run, "archive string, n_records long, content binary")


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """One row a record: ``id, uri, record_type, payload_digest, payload_bytes, refers_to, payload``. Digest and length are
    of the full payload; a revisit has no payload of its own. Stored payloads are checked against their digests."""
    names = ["id", "uri", "record_type", "payload_digest", "payload_bytes", "refers_to", "payload"]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches):
        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for raw in unpack(content.as_py()):
                    rows.append(parse(raw))
                    if not with_payload:
                        rows[-1]["payload"] = None
                    size += len(raw)
                    if size > ARCHIVE_BYTES:
                        yield _rows(rows, names, kinds)
                        rows, size = [], 0
                yield _rows(rows, names, kinds)

    return archives.select("content").mapInArrow(run, "id long, uri string, record_type string, payload_digest string, payload_bytes long, refers_to long, payload binary")


def _rows(rows: list[dict], names: list[str], kinds: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], k) for n, k in zip(names, kinds)], names)


def export_files(archives: DataFrame, uri: str) -> DataFrame:
    """Writes each archive as a file below ``uri`` (any store that pyarrow opens); returns ``(archive, n_bytes)``.

    A file appears under its name only when it is whole; a task that runs again replaces it by the same content.
    """
    def run(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                data = content.as_py()
                with store.open_output_stream(part := f"{root}/.{name}-{uuid.uuid4().hex}") as f:
                    f.write(data)
                store.move(part, f"{root}/{name}")
                yield pa.RecordBatch.from_pydict({"archive": pa.array([name]), "n_bytes": pa.array([len(data)], pa.int64())})

    return archives.select("archive", "content").mapInArrow(run, "archive string, n_bytes long")


def import_files(spark: SparkSession, path: str) -> DataFrame:
    """Archives below a folder, by Spark's own reader, as input of ``read_archives``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(path)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("archive"), "content")
