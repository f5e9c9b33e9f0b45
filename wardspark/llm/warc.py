"""WARC archives: a writer and a reader as Python data sources.

Records are gzip members, one each; a member's extra field ``sl`` holds its compressed and plain
length, so a reader that does not want a record's payload seeks past it. Of records with equal
payloads of at least ``REVISIT_FROM`` bytes the one with the smallest id is a response, the
others revisit it and carry no payload; every record states its payload's length and SHA-256.

Reading: each file is one partition, or several by byte ranges at member boundaries that the
writer lists beside it. Equality and membership filters on ``record_type``, ``target_uri``,
``record_id`` and ``payload_digest`` are tested on headers, before a payload is inflated; without
the column ``payload`` (option ``payload=false``) no payload is.

Null payloads are empty; null ids become records without an id number and are responses unless a
smaller id has the same payload; equal ids are written once for each row, and all rows of the
smallest id are responses; an empty table gives an archive without records.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition, WriterCommitMessage

from wardspark.llm import files, shared

REVISIT_FROM = 100
FILE_BYTES = 128 << 20
RANGE_BYTES = 32 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HEAD = b"\x1f\x8b\x08\x04\0\0\0\0\0\xff"


def member(data: bytes) -> bytes:
    """A gzip member that states its own and its content's length in the extra field ``sl``."""
    packer = zlib.compressobj(6, zlib.DEFLATED, -15)
    body = packer.compress(data) + packer.flush()
    size = len(_HEAD) + 14 + len(body) + 8
    return _HEAD + struct.pack("<H2sHII", 12, b"sl", 8, size, len(data)) + body + struct.pack("<II", zlib.crc32(data), len(data) & 0xFFFFFFFF)


def record(kind: str, uri: str | None, page: int | None, payload: bytes, digest: str, length: int, refers_to: int | None, refers: bool) -> bytes:
    """A WARC 1.1 record with an HTTP response block; a revisit's block ends after the HTTP header."""
    number = "none" if page is None else str(page)
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % length + payload
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{number}>", "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + (uri or "").replace("\r", "%0D").replace("\n", "%0A"), f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {length}",
    ]
    if refers:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{'none' if refers_to is None else refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


@dataclass
class _Written(WriterCommitMessage):
    made: list[dict]


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        made: list[dict] = []
        out, at, cuts = None, 0, [0]

        def close() -> None:
            out.close()
            made.append({"file": name, "bytes": at, "cuts": cuts})

        for batch in iterator:
            columns = [batch.column(c) for c in ("record_type", "target_uri", "page_id", "payload", "payload_digest", "payload_bytes", "refers_to")]
            for i in range(batch.num_rows):
                kind, uri, page, payload, digest, length, refers_to = (c[i].as_py() for c in columns)
                if out is None or at >= FILE_BYTES:
                    if out:
                        close()
                    name, at, cuts = f"{uuid.uuid4().hex}.warc.gz", 0, [0]
                    store, inner = files.at(f"{self.folder}/{name}")
                    out = store.open_output_stream(inner, compression=None)
                revisit = kind == "revisit"
                data = member(record(kind, uri, page, b"" if revisit else (payload or b""), digest, length, refers_to, revisit))
                if at - cuts[-1] >= RANGE_BYTES:
                    cuts.append(at)
                out.write(data)
                at += len(data)
        if out:
            close()
        return _Written(made)

    def commit(self, messages: list[_Written | None]) -> None:
        made = sorted((f for m in messages if m for f in m.made), key=lambda f: f["file"])
        files.write_bytes(f"{self.folder}/archives.json", json.dumps(made).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        for m in messages:
            for f in m.made if m else []:
                files.remove(f"{self.folder}/{f['file']}")


@dataclass
class _Range(InputPartition):
    file: str
    start: int
    stop: int


#: Bytes inflated at a time until a record's header is whole.
HEADER = 512

_FIELDS = {"record_type": "warc-type", "target_uri": "warc-target-uri", "record_id": "warc-record-id", "payload_digest": "warc-payload-digest"}
ROWS = pa.schema([
    ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.string()), ("payload_digest", pa.string()),
    ("payload_bytes", pa.int64()), ("payload", pa.binary()),
])
ROWS_DDL = "record_id string, record_type string, target_uri string, refers_to string, payload_digest string, payload_bytes bigint, payload binary"


def parse_header(text: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in text.decode("utf-8", "replace").split("\r\n")[1:]:
        name, colon, value = line.partition(":")
        if colon:
            out[name.strip().lower()] = value.strip()
    return out


def read_records(src, start: int, stop: int, wanted, payloads: bool) -> Iterator[tuple]:
    """Records of the members from ``start`` to ``stop`` whose header ``wanted`` accepts."""
    at = start
    while at < stop:
        src.seek(at)
        front = src.read(4096)
        size = struct.unpack_from("<H2sHII", front, 10)[3] if front[:4] == _HEAD[:4] and front[12:14] == b"sl" else 0
        if not size:
            raise ValueError(f"no member with its length at {at}")
        inflate = zlib.decompressobj(-15)
        read = min(len(front), size)
        plain = inflate.decompress(front[24:read], HEADER)
        while b"\r\n\r\n" not in plain:  # no further than the header
            more = inflate.unconsumed_tail
            if not more and read < size:
                more = src.read(min(4096, size - read))
                read += len(more)
            new = inflate.decompress(more, HEADER)
            if not new and not more:
                break
            plain += new
        head, _, block = plain.partition(b"\r\n\r\n")
        fields = parse_header(head)
        if wanted(fields):
            payload = None
            if payloads and fields.get("warc-type") != "revisit":
                block += inflate.decompress(inflate.unconsumed_tail + (src.read(size - read) if read < size else b"")) + inflate.flush()
                payload = block[: int(fields["content-length"])].partition(b"\r\n\r\n")[2]
            digest = fields.get("warc-payload-digest", "").removeprefix("sha256:")
            yield fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-target-uri"), fields.get("warc-refers-to"), digest, int(fields.get("x-payload-length", -1)), payload
        at += size


class _Reader(DataSourceReader):
    def __init__(self, folder: str, payloads: bool):
        self.folder, self.payloads = folder, payloads
        self.tests: list[tuple[str, tuple]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if isinstance(f, (EqualTo, In)) else None
            if column in _FIELDS:
                values = tuple(f.value) if isinstance(f, In) else (f.value,)
                self.tests.append((column, values))
            else:
                yield f

    def partitions(self) -> list[_Range]:
        made = json.loads(files.read_bytes(f"{self.folder}/archives.json"))
        return [_Range(f["file"], a, b) for f in made for a, b in zip(f["cuts"], [*f["cuts"][1:], f["bytes"]], strict=True)] or [_Range("", 0, 0)]

    def read(self, part: _Range) -> Iterator[pa.RecordBatch]:
        if not part.file:
            return
        tests = [(_FIELDS[c], {f"sha256:{v}" if c == "payload_digest" else v for v in values}) for c, values in self.tests]
        store, inner = files.at(f"{self.folder}/{part.file}")
        with store.open_input_file(inner) as src:
            rows, held = [], 0
            for row in read_records(src, part.start, part.stop, lambda h: all(h.get(c) in v for c, v in tests), self.payloads):
                rows.append(row)
                held += 500 + len(row[-1] or b"")
                if held >= 4 << 20:
                    yield _batch(rows)
                    rows, held = [], 0
            if rows:
                yield _batch(rows)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), ROWS, strict=True)], schema=ROWS)


class Warc(DataSource):
    """``spark.read.format("warc").option("path", folder)``; option ``payload`` false leaves payloads unread."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return ROWS_DDL

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], str(self.options.get("payload", "true")).lower() != "false")

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])


def write_pages(pages: DataFrame, folder: str) -> None:
    """A record for each row of (page_id, url, html).

    Payloads are hashed where they are read; only digests are grouped, only digests that recur
    are joined back, and a digest shared by many pages is split by the adaptive skew join.
    """
    spark = pages.sparkSession
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").alias("target_uri"), F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256)).withColumn("payload_bytes", F.length("payload").cast("long"))
    large = rows.where(f"payload_bytes >= {REVISIT_FROM}").select("payload_digest", "page_id")
    first = large.groupBy("payload_digest").agg(F.count("*").alias("n"), F.min("page_id").alias("refers_to")).where("n > 1").select("payload_digest", "refers_to")
    revisits = large.join(first, "payload_digest").where("refers_to is not null and not (page_id <=> refers_to)").select("page_id", "payload_digest", "refers_to").distinct()
    revisits = revisits.select(F.col("page_id").alias("_page"), F.col("payload_digest").alias("_digest"), "refers_to")
    told = rows.join(revisits, rows["page_id"].eqNullSafe(F.col("_page")) & (F.col("payload_digest") == F.col("_digest")), "left")
    out = told.select("page_id", "target_uri", "payload", "payload_digest", "payload_bytes", "refers_to", F.when(F.col("_digest").isNull(), "response").otherwise("revisit").alias("record_type"))
    files.make_folder(folder)
    spark.dataSource.register(Warc)
    out.write.format("warc").option("path", folder).mode("append").save()


def read_archives(spark: SparkSession, folder: str, payload: bool = True) -> DataFrame:
    """The records of all archives of a folder; filters on header fields are tested before payloads are read."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(Warc)
    return spark.read.format("warc").option("path", folder).option("payload", str(payload).lower()).load()


def page_records(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to of every record.

    A response's length and digest are taken from the payload that was read, a revisit's from its header.
    """
    rows = read_archives(spark, folder)
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '<urn:page:(-?[0-9]+)>', 1) as bigint)")
    return rows.select(
        number("record_id").alias("page_id"),
        F.coalesce(F.length("payload").cast("long"), "payload_bytes").alias("payload_bytes"),
        F.coalesce(F.sha2("payload", 256), "payload_digest").alias("payload_digest"),
        "record_type", number("refers_to").alias("refers_to"),
    )


