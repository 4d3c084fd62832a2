"""Token-id files by bit-plane shuffling.

A file holds the ids of documents one after another. Ids are cut into blocks of ``block`` ids; a block is
transposed into planes (bit b of every id, or byte b of every id), and each plane is compressed with
zstandard. A chunk index at the end says where each block lies, so a reader fetches any range of ids without the rest.

Layout, little-endian: magic ``BPLANE1\\n``; u32 block, u8 planes (1 bits, 8 bytes), u8 width, u16 0; then the
planes of each block. Footer: zstd(chunk index: for each block u64 offset, u32 ids, then u32 length of each
plane), zstd(document index: i64 doc_id, u8 null flag, i64 ids), then u64 blocks, u64 documents, u64 ids,
u64 length of the chunk index, u64 length of the document index, magic.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import fresh_path, open_fs
from .tokens import END_ID, VOCABULARY, encoder
from .words import slices

MAGIC = b"BPLANE1\n"
BLOCK = 1 << 16
_HEAD, _TAIL = struct.Struct("<IBBH"), struct.Struct("<QQQQQ")
MANIFEST = "path string, n_docs long, n_ids long, first_doc long"
ROWS = "doc_id long, start long, n_tokens long, ids_crc32 long"


def to_planes(ids: np.ndarray, planes: str, width: int) -> list[bytes]:
    """The planes of one block, lowest first: ``width`` bit planes, or ``width`` byte planes."""
    raw = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if planes == "bytes":
        return [raw[:, b].tobytes() for b in range(width)]
    columns = [np.ascontiguousarray(raw[:, k]) for k in range(-(-width // 8))]
    return [np.packbits(columns[b // 8] & np.uint8(1 << b % 8), bitorder="little").tobytes() for b in range(width)]


def from_planes(parts: list[bytes], planes: str, n: int) -> np.ndarray:
    """The ids that to_planes() took apart."""
    if planes == "bytes":
        raw = np.zeros((n, 4), np.uint8)
        for b, part in enumerate(parts):
            raw[:, b] = np.frombuffer(part, np.uint8)
        return raw.reshape(-1).view("<u4").copy()
    raw = np.zeros((4, n), np.uint8)
    for b, part in enumerate(parts):
        raw[b // 8] |= np.unpackbits(np.frombuffer(part, np.uint8), count=n, bitorder="little") << np.uint8(b % 8)
    return np.ascontiguousarray(raw.T).reshape(-1).view("<u4")


class Writer:
    """Writes one file; ids may come in pieces of any size."""

    def __init__(self, out, planes: str = "bits", width: int = 16, block: int = BLOCK, level: int = 1):
        if planes not in ("bits", "bytes"):
            raise ValueError(f"planes must be bits or bytes, not {planes}")
        self.out, self.planes, self.block, self.width = out, planes, block, width
        self.zip = zstandard.ZstdCompressor(level=level)
        self.at, self.index, self.docs, self.n_ids = 0, [], [], 0
        self.waiting: list[np.ndarray] = []
        self.held = 0
        self._put(MAGIC + _HEAD.pack(block, 1 if planes == "bits" else 8, width, 0))

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, ids: np.ndarray, doc_ids: list[int | None], lengths: np.ndarray) -> None:
        most = int(ids.max()) if len(ids) else 0
        if most >> (self.width * (1 if self.planes == "bits" else 8)):
            raise ValueError(f"id {most} does not fit {self.width} {self.planes}")
        self.docs.append((np.array([d or 0 for d in doc_ids], "<i8"), np.array([d is None for d in doc_ids], np.uint8), lengths.astype("<i8")))
        self.waiting.append(ids)
        self.held += len(ids)
        self.n_ids += len(ids)
        if self.held >= self.block:
            self._flush(False)

    def _flush(self, last: bool) -> None:
        ids = np.concatenate(self.waiting) if self.waiting else np.zeros(0, np.uint32)
        stop = len(ids) if last else len(ids) // self.block * self.block
        for a in range(0, stop, self.block):
            some = ids[a : min(a + self.block, stop)]
            parts = [self.zip.compress(p) for p in to_planes(some, self.planes, self.width)]
            self.index.append((self.at, len(some), [len(p) for p in parts]))
            self._put(b"".join(parts))
        self.waiting, self.held = [ids[stop:]], len(ids) - stop

    def close(self) -> None:
        self._flush(True)
        chunks = self.zip.compress(b"".join(struct.pack(f"<QI{self.width}I", o, n, *sizes) for o, n, sizes in self.index))
        docs = self.zip.compress(b"".join(np.concatenate(x).tobytes() for x in zip(*self.docs, strict=True)) if self.docs else b"")
        n_docs = sum(len(x[0]) for x in self.docs)
        self._put(chunks + docs + _TAIL.pack(len(self.index), n_docs, self.n_ids, len(chunks), len(docs)) + MAGIC)


class Reader:
    """Reads a file by its chunk index."""

    def __init__(self, source):
        self.source, size = source, source.size()
        if size < 2 * len(MAGIC) + _HEAD.size + _TAIL.size or self._at(0, len(MAGIC)) != MAGIC or self._at(size - len(MAGIC), len(MAGIC)) != MAGIC:
            raise ValueError("not a whole bit-plane file")
        self.block, kind, self.width, _ = _HEAD.unpack(self._at(len(MAGIC), _HEAD.size))
        self.planes = "bits" if kind == 1 else "bytes"
        end = size - len(MAGIC) - _TAIL.size
        blocks, self.n_docs, self.n_ids, a, b = _TAIL.unpack(self._at(end, _TAIL.size))
        unzip = zstandard.ZstdDecompressor()
        step = struct.Struct(f"<QI{self.width}I")
        raw = unzip.decompress(self._at(end - b - a, a)) if blocks else b""
        self.index = [step.unpack_from(raw, k * step.size) for k in range(blocks)]
        docs = unzip.decompress(self._at(end - b, b)) if self.n_docs else b""
        n = self.n_docs
        self.doc_ids = np.frombuffer(docs, "<i8", n)
        self.null = np.frombuffer(docs, np.uint8, n, 8 * n)
        self.lengths = np.frombuffer(docs, "<i8", n, 9 * n)

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def blocks(self, first: int = 0) -> Iterator[np.ndarray]:
        unzip = zstandard.ZstdDecompressor()
        for offset, n, *sizes in self.index[first:]:
            raw, parts = self._at(offset, sum(sizes)), []
            for s in sizes:
                parts.append(unzip.decompress(raw[:s]))
                raw = raw[s:]
            yield from_planes(parts, self.planes, n) if n else np.zeros(0, np.uint32)

    def read(self, start: int, stop: int) -> np.ndarray:
        """Ids from ``start`` to ``stop``; only the blocks that hold them are fetched."""
        start, stop = max(0, start), min(stop, self.n_ids)
        if stop <= start:
            return np.zeros(0, np.uint32)
        first, got, need = start // self.block, [], stop - start // self.block * self.block
        for block in self.blocks(first):
            got.append(block)
            need -= len(block)
            if need <= 0:
                break
        return np.concatenate(got)[start - first * self.block : stop - first * self.block]

    def documents(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """(doc_id, ids) in file order; a block is held at a time, or one document where that is longer."""
        feed, held = self.blocks(), np.zeros(0, np.uint32)
        for d, null, n in zip(self.doc_ids.tolist(), self.null.tolist(), self.lengths.tolist(), strict=True):
            if len(held) < n:
                some, have = [held], len(held)
                while have < n:
                    some.append(next(feed))
                    have += len(some[-1])
                held = np.concatenate(some)
            yield (None if null else d), held[:n]
            held = held[n:]


def write_ids(docs: DataFrame, folder: str, vocabulary: str = VOCABULARY, end: int = END_ID, planes: str = "bits", width: int = 16, block: int = BLOCK) -> list:
    """Writes the ids of ``docs`` (doc_id, text; other columns are ignored) in ascending doc_id order.

    One file for each range of doc_id, written whole under another name and then renamed, so a task that is
    run again or twice leaves one whole file. Returns a manifest row for each file: (path, n_docs, n_ids,
    first_doc). Null ids come first; rows that share a doc_id are ordered by text; a null text is an empty one,
    whose ids are the end id alone. An empty table gives no file.
    """
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ordered = ordered.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    fs, base = open_fs(folder)
    fs.create_dir(base, recursive=True)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, own = TaskContext.get(), encoder(vocabulary, end)
        fs, base = open_fs(folder)
        name, draft = f"part-{task.partitionId():05d}.bpl", f".draft-{task.partitionId():05d}-{task.taskAttemptId()}"
        writer = out = None
        first, n_docs = None, 0
        for part in slices(batches, "text"):
            if writer is None:
                out = fs.open_output_stream(f"{base}/{draft}")
                writer, first = Writer(out, planes, width, block), part.column("doc_id")[0].as_py()
            ids, bounds = own.encode(part.column("text"))
            writer.add(ids, part.column("doc_id").to_pylist(), np.diff(bounds))
            n_docs += part.num_rows
        if writer is not None:
            writer.close()
            out.close()
            fs.move(f"{base}/{draft}", f"{base}/{name}")
            yield pa.RecordBatch.from_pylist([{"path": f"{folder}/{name}", "n_docs": n_docs, "n_ids": writer.n_ids, "first_doc": first}], schema=pa.schema([("path", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("first_doc", pa.int64())]))

    return sorted(ordered.mapInArrow(put, MANIFEST).collect(), key=lambda r: r.path)


def read_ids(spark: SparkSession, manifest: list) -> DataFrame:
    """A row for each document from the files: doc_id, start, n_tokens, ids_crc32, of ids counted over all files.

    The manifest has a row for each file, not for each document; running starts are summed from it.
    """
    starts, total = [], 0
    for row in manifest:
        starts.append((row.path, total))
        total += row.n_ids
    if not starts:
        return spark.createDataFrame([], ROWS)
    files = spark.createDataFrame(starts, "path string, base long").repartition(min(len(starts), 10_000), "path")

    def get(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "start", "n_tokens", "ids_crc32"]
        for batch in batches:
            for path, base in zip(batch.column("path").to_pylist(), batch.column("base").to_pylist(), strict=True):
                fs, at = open_fs(path)
                with fs.open_input_file(at) as source:
                    reader = Reader(source)
                    start = base + np.cumsum(reader.lengths) - reader.lengths
                    got = [(d, zlib.crc32(ids.astype("<u4").tobytes())) for d, ids in reader.documents()]
                for a in range(0, len(got), 10_000):
                    some = got[a : a + 10_000]
                    b = a + len(some)
                    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in some], pa.int64()), pa.array(start[a:b]), pa.array(reader.lengths[a:b].astype(np.int64)), pa.array([x[1] for x in some], pa.int64())], names=names)

    return files.mapInArrow(get, ROWS)


def token_files(docs: DataFrame, folder: str | None = None, **options) -> DataFrame:
    """write_ids() and read_ids(): the documents as their files have them. ``folder``: a shared one by default."""
    folder = folder or fresh_path(docs.sparkSession, "token-ids")
    return read_ids(docs.sparkSession, write_ids(docs, folder, **options))
