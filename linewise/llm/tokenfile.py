"""Token ids in a binary file format: shuffled planes with a chunk index.

A file holds the ids of whole documents, one after the other. The ids are cut into chunks
of ``chunk_ids``; a chunk is transposed into byte planes (all lowest bytes, then all second
bytes, ...) or bit planes, planes that are all zero at the top are left out, and every
plane is compressed with zstandard. Layout, all integers little-endian:

    magic  b"LWPLANE1"
    chunks: the planes' compressed bytes, chunk after chunk
    index  (zstandard): chunk rows, plane sizes, document ids and id counts, see Footer
    tail   uint64 index size, uint64 index offset, magic

The chunk index (offset, number of ids, planes) lets a reader open any chunk alone.

Writing: documents are range-partitioned by doc_id, each task sorts its range and streams
it into one file of the shared folder. A file name holds a token of its attempt, and only
files named in the returned table (which Spark commits) count, so a repeated or
speculative task leaves at most an unused file. Memory per task is one chunk and 16 bytes
a document.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from linewise.llm.common import cut, documents, ship_package
from linewise.llm.tokens import encoder
from linewise.plans.materialize import new_folder

MAGIC = b"LWPLANE1"
END_ID = 1
CHUNK_IDS = 1 << 16
UNIT_IDS = 1 << 24
TAIL = struct.Struct("<QQ8s")

FILES_SCHEMA = "part int, path string, n_docs bigint, n_ids bigint, n_bytes bigint"


def to_planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """Planes of uint32 ids, lowest first, without the zero planes at the top."""
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        n = (int(ids.max(initial=0)).bit_length() + 7) // 8
        return [raw[:, i].tobytes() for i in range(n)]
    n = int(ids.max(initial=0)).bit_length()
    rows = np.unpackbits(raw, axis=1, bitorder="little")[:, :n]
    return [np.packbits(rows[:, i], bitorder="little").tobytes() for i in range(n)]


def from_planes(planes: list[bytes], n: int, bits: bool = False) -> np.ndarray:
    """The ``n`` ids (uint32) of which :func:`to_planes` made ``planes``."""
    if not bits:
        raw = np.zeros((n, 4), np.uint8)
        for i, p in enumerate(planes):
            raw[:, i] = np.frombuffer(p, np.uint8)
        return raw.reshape(-1).view("<u4")
    rows = np.zeros((n, 32), np.uint8)
    for i, p in enumerate(planes):
        rows[:, i] = np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little")
    return np.packbits(rows, axis=1, bitorder="little").reshape(-1).view("<u4")


class PlaneWriter:
    """Streams documents' ids into one open file."""

    def __init__(self, out, chunk_ids: int = CHUNK_IDS, bits: bool = False, level: int = 3):
        self.out, self.chunk_ids, self.bits = out, chunk_ids, bits
        self.zip = zstandard.ZstdCompressor(level=level)
        self.pending: list[bytes] = []
        self.n_pending = self.n_ids = 0
        self.at = len(MAGIC)
        self.chunks: list[tuple[int, int, int]] = []  # offset, ids, planes
        self.sizes: list[int] = []
        self.doc_ids: list[int | None] = []
        self.counts: list[int] = []
        out.write(MAGIC)

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id)
        self.counts.append(len(ids) // 4)
        self.n_ids += len(ids) // 4
        self.pending.append(ids)
        self.n_pending += len(ids) // 4
        if self.n_pending >= self.chunk_ids:
            data = np.frombuffer(b"".join(self.pending), "<u4")
            whole = len(data) // self.chunk_ids * self.chunk_ids
            for lo in range(0, whole, self.chunk_ids):
                self._chunk(data[lo:lo + self.chunk_ids])
            self.pending = [data[whole:].tobytes()]
            self.n_pending = len(data) - whole

    def _chunk(self, ids: np.ndarray) -> None:
        planes = [self.zip.compress(p) for p in to_planes(ids, self.bits)]
        self.chunks.append((self.at, len(ids), len(planes)))
        for p in planes:
            self.sizes.append(len(p))
            self.out.write(p)
            self.at += len(p)

    def close(self) -> int:
        """Write what is left and the index; the file's size."""
        if self.n_pending:
            self._chunk(np.frombuffer(b"".join(self.pending), "<u4"))
        known = np.array([d is not None for d in self.doc_ids], np.uint8)
        index = self.zip.compress(b"".join([
            struct.pack("<4Q", int(self.bits), len(self.chunks), len(self.sizes), len(self.counts)),
            np.array(self.chunks, "<u8").tobytes(), np.array(self.sizes, "<u8").tobytes(),
            np.array([d or 0 for d in self.doc_ids], "<i8").tobytes(),
            np.array(self.counts, "<u8").tobytes(), known.tobytes()]))
        self.out.write(index)
        self.out.write(TAIL.pack(len(index), self.at, MAGIC))
        return self.at + len(index) + TAIL.size


class PlaneReader:
    """Reads a file of :class:`PlaneWriter`; ``f`` is seekable."""

    def __init__(self, f):
        self.f = f
        f.seek(-TAIL.size, 2)
        size, at, magic = TAIL.unpack(f.read(TAIL.size))
        if magic != MAGIC:
            raise ValueError("not a token plane file")
        f.seek(at)
        self.unzip = zstandard.ZstdDecompressor()
        data = self.unzip.decompress(f.read(size))
        bits, n_chunks, n_sizes, n_docs = struct.unpack_from("<4Q", data)
        self.bits, pos = bool(bits), 32
        self.chunks = np.frombuffer(data, "<u8", 3 * n_chunks, pos).reshape(-1, 3)
        pos += 24 * n_chunks
        self.sizes = np.frombuffer(data, "<u8", n_sizes, pos)
        pos += 8 * n_sizes
        ids = np.frombuffer(data, "<i8", n_docs, pos)
        pos += 8 * n_docs
        self.counts = np.frombuffer(data, "<u8", n_docs, pos).astype(np.int64)
        known = np.frombuffer(data, np.uint8, n_docs, pos + 8 * n_docs)
        self.doc_ids = [int(d) if k else None for d, k in zip(ids, known)]
        self.first_size = np.concatenate([[0], np.cumsum(self.chunks[:, 2])]).astype(np.int64)

    def chunk(self, i: int) -> np.ndarray:
        """The ids of chunk ``i`` alone."""
        at, n, _ = map(int, self.chunks[i])
        self.f.seek(at)
        sizes = self.sizes[self.first_size[i]:self.first_size[i + 1]]
        return from_planes([self.unzip.decompress(self.f.read(int(s))) for s in sizes], n, self.bits)

    def documents(self, first: int = 0, last: int | None = None) -> Iterator[tuple[int | None, int, int, int]]:
        """(doc_id, ids of the file before it, number of ids, crc32 of the ids) of the documents
        from number ``first`` up to ``last`` (all), in order; only their chunks are read."""
        import zlib

        starts = np.concatenate([[0], np.cumsum(self.counts)]).astype(np.int64)
        ends = np.cumsum(self.chunks[:, 1].astype(np.int64))
        last = len(self.counts) if last is None else last
        nxt = int(np.searchsorted(ends, starts[first], "right"))
        data, at = b"", 4 * int(starts[first] - (ends[nxt - 1] if nxt else 0))
        for i in range(first, last):
            count, code = int(self.counts[i]), 0
            need = 4 * count
            while need:
                if at >= len(data):
                    at -= len(data)
                    data, nxt = self.chunk(nxt).tobytes(), nxt + 1
                take = data[at:at + need]
                code = zlib.crc32(take, code)
                need -= len(take)
                at += len(take)
            yield self.doc_ids[i], int(starts[i]), count, code & 0xFFFFFFFF


def _open(path: str):
    """File system and path of a URI or of a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:")
                                  else f"file://{path}")


def write_tokens(docs: DataFrame, folder: str, end_id: int = END_ID, tokenizer: str | None = None,
                 chunk_ids: int = CHUNK_IDS, bits: bool = False) -> DataFrame:
    """Write all documents' ids (``end_id`` appended to each) in ascending doc_id order, one
    file per range; the table of committed files: part (in doc_id order), path, n_docs,
    n_ids, n_bytes.

    A null or empty text has the single id ``end_id``; null doc_ids come first; repeated
    doc_ids lie next to each other. No document, no file.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        part, writer = TaskContext.get().partitionId(), None
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = batch.slice(lo, 256)
                if writer is None:
                    fs, base = _open(folder)
                    fs.create_dir(base)
                    path = f"part-{part:06d}-{uuid.uuid4().hex}.planes"
                    out = fs.open_output_stream(f"{base}/{path}")
                    writer = PlaneWriter(out, chunk_ids, bits)
                for d, ids in zip(rows.column(0).to_pylist(), enc.encode(rows.column(1).to_pylist())):
                    writer.add(d, ids + end)
        if writer is not None:
            size = writer.close()
            out.close()
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([f"{folder.rstrip('/')}/{path}"]),
                 *[pa.array([v], pa.int64()) for v in (len(writer.counts), writer.n_ids, size)]],
                names=["part", "path", "n_docs", "n_ids", "n_bytes"])

    key = F.col("doc_id").cast("bigint")
    ranged = (docs.select(key.alias("doc_id"), F.col("text").cast("string").alias("text"))
              .repartitionByRange("doc_id").sortWithinPartitions("doc_id"))
    return cut(ranged.mapInArrow(run, FILES_SCHEMA), "token-files")


def read_tokens(files: DataFrame, unit_ids: int = UNIT_IDS) -> DataFrame:
    """Read files back: doc_id, start (ids of all documents before), n_tokens, ids_crc32.

    A task reads one unit: a file, or of a file with over ``unit_ids`` ids the documents of
    one of several equal ranges, whose chunks it finds by the chunk index."""
    ship_package(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, base, first, last in zip(*(c.to_pylist() for c in batch.columns)):
                fs, own = _open(path)
                with fs.open_input_file(own) as f:
                    rows = []
                    for d, at, n, code in PlaneReader(f).documents(first, last):
                        rows.append((d, base + at, n, code))
                        if len(rows) == 50_000:
                            yield _rows(rows)
                            rows = []
                    if rows:
                        yield _rows(rows)

    # one row per file: the running total is over as many rows as there are partitions
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    based = files.select("part", "path", "n_docs", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("base"),
                         F.least("n_docs", F.ceil(F.col("n_ids") / unit_ids)).alias("units"))
    units = based.withColumn("unit", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("units") - 1)))
    edge = lambda u: F.floor(u * F.col("n_docs") / F.col("units")).cast("bigint")
    n = files.agg(F.sum(F.least("n_docs", F.ceil(F.col("n_ids") / unit_ids)))).first()[0] or 1
    # a number of partitions of one's own: Spark would put the few KB of names into one task
    spread = units.select("path", "base", edge(F.col("unit")).alias("first"), edge(F.col("unit") + 1).alias("last"))
    return spread.repartitionByRange(int(n), "base", "first").mapInArrow(
        run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)],
                                      names=["doc_id", "start", "n_tokens", "ids_crc32"])


def op10_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write all documents' ids into plane files of the shared folder, read them back."""
    return read_tokens(write_tokens(documents(spark, sf_dir), new_folder(spark, "token-planes")))
