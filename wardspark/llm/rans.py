"""Token ids as entropy-coded binary files: a static range asymmetric numeral system.

One table of frequencies, counted over all ids, is shared by all blocks. A block codes up to
``BLOCK`` ids in interleaved lanes (id i belongs to lane i mod lanes), holds the decoder's
states at regular steps, and a checksum of the ids between two such checkpoints, so any run
of ids decodes from the checkpoint before it, and blocks decode independently.

A folder holds ``frequencies.bin``, files ``*.rans`` (blocks, then a directory of documents and
blocks, then a footer) and ``manifest.json`` with the files in document order. Files of failed
or repeated tasks are not in the manifest and are never read.

Null texts are empty documents of one end id; null doc_ids come first; equal doc_ids keep all
their rows; an empty table gives a manifest without files. Columns other than doc_id and text
are not read.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from wardspark.llm import files, shared, tokens

LANES = 1024
STEPS_PER_CHECKPOINT = 256
BLOCK = LANES * STEPS_PER_CHECKPOINT * 4
FILE_IDS = 8 * BLOCK
#: Words whose ids a worker remembers (some 150 bytes each).
WORDS = 1_340_000
MAGIC = b"RANSTOK1"
_LOW = np.uint64(1 << 32)
_U = np.uint64


@dataclass(frozen=True)
class Frequencies:
    """Symbols' shares of ``1 << bits`` slots, at least one each."""

    bits: int
    symbols: np.ndarray
    counts: np.ndarray

    @staticmethod
    def of(symbols: np.ndarray, counts: np.ndarray) -> Frequencies:
        order = np.argsort(symbols, kind="stable")
        symbols, counts = np.asarray(symbols, np.uint32)[order], np.asarray(counts, np.int64)[order]
        bits = min(24, max(12, int(len(symbols)).bit_length() + 4))
        if not len(symbols):
            return Frequencies(bits, symbols, counts)
        slots = 1 << bits
        share = np.maximum(1, np.floor(counts / counts.sum() * slots).astype(np.int64))
        over = int(share.sum()) - slots
        while over:  # the largest shares take the difference
            most = np.argsort(-share, kind="stable")
            give = np.minimum(np.maximum(share[most] // 2, 0), abs(over)) if over > 0 else np.array([-over])
            give = give[: int(np.searchsorted(np.cumsum(give), abs(over)) + 1)]
            give[-1] -= give.sum() - abs(over)
            share[most[: len(give)]] += -give if over > 0 else give
            over = int(share.sum()) - slots
        return Frequencies(bits, symbols, share)

    def to_bytes(self) -> bytes:
        body = self.symbols.astype("<u4").tobytes() + self.counts.astype("<u4").tobytes()
        return struct.pack("<II", self.bits, len(self.symbols)) + zlib.compress(body) + struct.pack("<I", zlib.crc32(body))

    @staticmethod
    def from_bytes(data: bytes) -> Frequencies:
        bits, n = struct.unpack_from("<II", data)
        body = zlib.decompress(data[8:-4])
        if zlib.crc32(body) != struct.unpack("<I", data[-4:])[0]:
            raise ValueError("the frequency table is damaged")
        return Frequencies(bits, np.frombuffer(body, "<u4", n), np.frombuffer(body, "<u4", n, 4 * n).astype(np.int64))


class Codec:
    """Encodes and decodes blocks by one table."""

    def __init__(self, table: Frequencies):
        self.bits = _U(table.bits)
        self.symbols = table.symbols
        self.share = table.counts.astype(np.uint64)
        self.first = (np.cumsum(table.counts) - table.counts).astype(np.uint64)
        self.place = np.zeros(int(table.symbols.max()) + 1 if len(table.symbols) else 1, np.int64)
        self.place[table.symbols] = np.arange(len(table.symbols))
        self.slot = np.repeat(np.arange(len(table.symbols), dtype=np.uint32), table.counts)

    def encode(self, ids: np.ndarray) -> bytes:
        n = len(ids)
        lanes = min(LANES, max(1, n // 64))
        steps = -(-n // lanes)
        at = self.place[ids]
        share, first = self.share[at], self.first[at]
        top = _U(64) - self.bits
        x = np.full(lanes, _LOW, np.uint64)
        words: list[np.ndarray] = [None] * steps
        marks: dict[int, np.ndarray] = {}
        for t in range(steps - 1, -1, -1):
            a, b = t * lanes, min(n, (t + 1) * lanes)
            f, state = share[a:b], x[: b - a]
            full = (state >> top) >= f
            words[t] = (state[full] & _U(0xFFFFFFFF)).astype("<u4")
            state = np.where(full, state >> _U(32), state)
            whole = state // f
            x[: b - a] = (whole << self.bits) + (state - whole * f) + first[a:b]
            if t % STEPS_PER_CHECKPOINT == 0:
                marks[t] = x.copy()
        sizes = np.cumsum([0, *(len(w) for w in words)])
        parts = []
        for t in sorted(marks):
            piece = ids[t * lanes : (t + STEPS_PER_CHECKPOINT) * lanes].astype("<u4").tobytes()
            parts.append(struct.pack("<QI", int(sizes[t]), zlib.crc32(piece)) + marks[t].astype("<u8").tobytes())
        body = b"".join(parts) + b"".join(w.tobytes() for w in words)
        return struct.pack("<IIII", n, lanes, len(parts), zlib.crc32(body)) + body

    def decode(self, data: bytes, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop`` of a block; a checkpoint's run of ids that the range touches is checked whole."""
        n, lanes, marks, check = struct.unpack_from("<IIII", data)
        stop = n if stop is None else min(stop, n)
        if start >= stop:
            return np.zeros(0, np.uint32)
        head, size = 16, 12 + 8 * lanes
        if start == 0 and stop == n and zlib.crc32(data[head:]) != check:
            raise ValueError("a block is damaged")
        words = np.frombuffer(data, "<u4", offset=head + marks * size)
        run = STEPS_PER_CHECKPOINT * lanes
        mask = _U((1 << int(self.bits)) - 1)
        out = []
        for m in range(start // run, (stop - 1) // run + 1):
            at, crc = struct.unpack_from("<QI", data, head + m * size)
            x = np.frombuffer(data, "<u8", lanes, head + m * size + 12).copy()
            got = np.empty(min(run, n - m * run), np.uint32)
            for t in range(0, len(got), lanes):
                k = min(lanes, len(got) - t)
                state = x[:k]
                low = state & mask
                place = self.slot[low]
                got[t : t + k] = place
                state = self.share[place] * (state >> self.bits) + low - self.first[place]
                need = np.flatnonzero(state < _LOW)
                state[need] = (state[need] << _U(32)) | words[at : at + len(need)]
                at += len(need)
                x[:k] = state
            got = self.symbols[got]
            if zlib.crc32(got.astype("<u4").tobytes()) != crc:
                raise ValueError("a run of ids is damaged")
            out.append(got)
        base = start // run * run
        return np.concatenate(out)[start - base : stop - base]


@lru_cache(maxsize=2)
def _codec(folder: str) -> Codec:
    return Codec(Frequencies.from_bytes(files.read_bytes(f"{folder}/frequencies.bin")))


class _File:
    """One output file: ids in, blocks out; documents may run across blocks."""

    def __init__(self, folder: str, place: int):
        self.place = place
        self.path = f"{folder}/{uuid.uuid4().hex}.rans"
        self.codec = _codec(folder)
        store, inner = files.at(self.path)
        self.out = store.open_output_stream(inner, compression=None)
        self.out.write(MAGIC)
        self.at = len(MAGIC)
        self.held: list[np.ndarray] = []
        self.n_held = self.n = 0
        self.docs: list[int | None] = []
        self.sizes: list[int] = []
        self.blocks: list[tuple[int, int, int]] = []

    def add(self, doc: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc)
        self.sizes.append(len(ids))
        self.n += len(ids)
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= BLOCK:
            rest = np.concatenate(self.held)
            while len(rest) >= BLOCK:
                self._block(rest[:BLOCK])
                rest = rest[BLOCK:]
            self.held, self.n_held = [rest], len(rest)

    def _block(self, ids: np.ndarray) -> None:
        data = self.codec.encode(ids)
        self.out.write(data)
        self.blocks.append((self.at, len(data), len(ids)))
        self.at += len(data)

    def close(self) -> dict:
        if self.n_held:
            self._block(np.concatenate(self.held))
        known = np.array([d is not None for d in self.docs], np.uint8)
        directory = zlib.compress(known.tobytes() + np.array([d or 0 for d in self.docs], "<i8").tobytes() + np.array(self.sizes, "<i8").tobytes() + np.array(self.blocks, "<i8").tobytes())
        self.out.write(directory)
        self.out.write(struct.pack("<QQQQI", self.at, len(directory), len(self.docs), len(self.blocks), zlib.crc32(directory)) + MAGIC)
        self.out.close()
        return {"file": self.path.rpartition("/")[2], "place": self.place, "first": self.docs[0], "last": self.docs[-1], "docs": len(self.docs), "ids": self.n}


@dataclass
class _Written(WriterCommitMessage):
    made: list[dict]


class _Writer(DataSourceArrowWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        made: list[dict] = []
        file, last = None, None
        for batch in iterator:
            for place, doc, raw, wide in zip(*(batch.column(c).to_pylist() for c in ("place", "doc_id", "ids", "width")), strict=True):
                # A task may read several ranges of documents in any order; each file holds one run without gaps.
                if file and (file.n >= FILE_IDS or place != last + 1):
                    made.append(file.close())
                    file = None
                file = file or _File(self.folder, place)
                file.add(doc, np.frombuffer(raw, "<u2" if wide == 2 else "<u4"))
                last = place
        if file:
            made.append(file.close())
        return _Written(made)

    def commit(self, messages: list[_Written | None]) -> None:
        made = [f for m in messages if m for f in m.made]
        made.sort(key=lambda f: f["place"])
        start = 0
        for f in made:
            f["start"] = start
            start += f["ids"]
        files.write_bytes(f"{self.folder}/manifest.json", json.dumps({"format": MAGIC.decode(), "ids": start, "files": made}).encode())

    def abort(self, messages: list[_Written | None]) -> None:
        for m in messages:
            for f in m.made if m else []:
                files.remove(f"{self.folder}/{f['file']}")


@dataclass
class _Part(InputPartition):
    file: str
    start: int
    first: int
    stop: int


class _Reader(DataSourceReader):
    """Partitions are runs of documents of one file; each decodes the blocks and checkpoints that it touches."""

    def __init__(self, folder: str, docs_per_task: int):
        self.folder, self.docs_per_task = folder, docs_per_task

    def partitions(self) -> list[_Part]:
        made = json.loads(files.read_bytes(f"{self.folder}/manifest.json"))["files"]
        step = self.docs_per_task
        return [_Part(f["file"], f["start"], a, min(a + step, f["docs"])) for f in made for a in range(0, f["docs"], step)] or [_Part("", 0, 0, 0)]

    def read(self, part: _Part) -> Iterator[pa.RecordBatch]:
        if part.file:
            yield from read_documents(self.folder, part.file, part.start, part.first, part.stop)


ROWS = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def read_documents(folder: str, name: str, base: int, first: int, stop: int, most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Documents ``first`` to ``stop`` of a file; ids as little-endian unsigned 32-bit integers."""
    codec = _codec(folder)
    store, inner = files.at(f"{folder}/{name}")
    with store.open_input_file(inner) as src:
        foot = 36 + len(MAGIC)
        src.seek(src.size() - foot)
        tail = src.read(foot)
        at, size, n_docs, n_blocks, check = struct.unpack("<QQQQI", tail[:36])
        src.seek(at)
        packed = src.read(size)
        if tail[36:] != MAGIC or zlib.crc32(packed) != check:
            raise ValueError(f"{name} is damaged")
        flat = zlib.decompress(packed)
        known = np.frombuffer(flat, np.uint8, n_docs)
        docs = np.frombuffer(flat, "<i8", n_docs, n_docs)
        sizes = np.frombuffer(flat, "<i8", n_docs, 9 * n_docs)
        blocks = np.frombuffer(flat, "<i8", 3 * n_blocks, 17 * n_docs).reshape(-1, 3)
        begins = np.cumsum(sizes) - sizes
        ends = np.cumsum(blocks[:, 2])
        opened: tuple[int, bytes] = (-1, b"")

        def ids(lo: int, hi: int) -> np.ndarray:
            nonlocal opened
            out = []
            b = int(np.searchsorted(ends, lo, side="right"))
            while lo < hi:
                if opened[0] != b:
                    src.seek(int(blocks[b, 0]))
                    opened = (b, src.read(int(blocks[b, 1])))
                before = int(ends[b] - blocks[b, 2])
                out.append(codec.decode(opened[1], lo - before, min(hi, int(ends[b])) - before))
                lo = min(hi, int(ends[b]))
                b += 1
            return np.concatenate(out) if out else np.zeros(0, np.uint32)

        a = first
        while a < stop:
            z = max(a + 1, min(stop, int(np.searchsorted(begins, begins[a] + most, side="right"))))
            lo = int(begins[a])
            run = ids(lo, int(begins[z - 1] + sizes[z - 1])).astype("<u4", copy=False)
            rows = [run[int(begins[i]) - lo : int(begins[i] + sizes[i]) - lo].tobytes() for i in range(a, z)]
            yield pa.RecordBatch.from_arrays([
                pa.array(docs[a:z], pa.int64(), mask=known[a:z] == 0), pa.array(base + begins[a:z], pa.int64()), pa.array(sizes[a:z], pa.int64()), pa.array(rows, pa.binary()),
            ], schema=ROWS)
            a = z


class RansTokens(DataSource):
    """``spark.read.format("rans_tokens").option("path", folder)``: doc_id, start, n_tokens, ids."""

    @classmethod
    def name(cls) -> str:
        return "rans_tokens"

    def schema(self) -> str:
        return "doc_id bigint, start bigint, n_tokens bigint, ids binary"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"], int(self.options.get("docsPerTask", 20_000)))

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"])


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        for raw, wide in zip(batch.column("ids").to_pylist(), batch.column("width").to_pylist(), strict=True):
            got = np.bincount(np.frombuffer(raw, "<u2" if wide == 2 else "<u4"))
            if len(got) > len(total):
                got[: len(total)] += total
                total = got
            else:
                total[: len(got)] += got
    seen = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int64()), pa.array(total[seen], pa.int64())], names=["id", "n"])


def encode_documents(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids, their width in bytes and place, which ascends by doc_id over all files and has no gaps within one."""
    width = tokens.encoder(vocabulary).dtype.itemsize
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])
    ordered = docs.select(F.col("doc_id").cast("long"), "text").repartitionByRange("doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", "text")
    ids = ordered.mapInArrow(tokens.encode_batches(vocabulary, schema, WORDS), "doc_id long, n_tokens long, ids binary")
    return shared.saved(ids.withColumns({"width": F.lit(width), "place": F.monotonically_increasing_id()}), "ids")


def write_tokens(docs: DataFrame, folder: str, vocabulary: str) -> None:
    """Encode all documents into ``folder``, ascending by doc_id; a vocabulary's worth of counts passes the driver."""
    spark = docs.sparkSession
    ids = encode_documents(docs, vocabulary)
    counted = ids.select("ids", "width").mapInArrow(_counts, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    rows = counted.collect()
    files.make_folder(folder)
    table = Frequencies.of(np.array([r["id"] for r in rows], np.int64), np.array([r["n"] for r in rows], np.int64))
    files.write_bytes(f"{folder}/frequencies.bin", table.to_bytes())
    spark.dataSource.register(RansTokens)
    ids.select("doc_id", "ids", "width", "place").write.format("rans_tokens").option("path", folder).mode("append").save()
    shared.discard(ids)


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids of every document of a folder."""
    spark.dataSource.register(RansTokens)
    return spark.read.format("rans_tokens").option("path", folder).load()
