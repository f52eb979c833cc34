"""Token-ID / binary output: bit-plane shuffling.

Ids are written in ascending order of document to shard files. A shard holds blocks of a fixed number of ids; a block
is transposed into bit or byte planes (all lowest bits or bytes first, then the next ...), each plane is compressed by
zstandard, and a chunk index at the end of the file gives each block's place and its planes' lengths, besides each
document's id and number of ids. Any block, so any document, can be read alone.

Layout: MAGIC | planes of block 0 | planes of block 1 | ... | footer | 8 bytes: length of the footer | MAGIC. The
footer is zstandard over: JSON line {plane, block, ids, docs} and then, as little-endian arrays, the blocks' offsets
(u8), each plane's length (u4), the documents' ids (i8), whether they are null (u1) and their numbers of ids (u8).

Shards are cut by Spark's range partitioning on doc_id; a task writes its shard under a name of its own (a lost or
repeated attempt leaves a file that no manifest names) and returns one manifest row. The manifest is written as
Parquet to the shared folder before anything reads a shard.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkwright.llm.common import cut, fresh_path, input_partitions, small
from sparkwright.llm.pieces import PieceEncoder

MAGIC = b"TIDPLN1\n"
MANIFEST = "file string, part int, first_doc long, docs long, ids long, bytes long"


def to_planes(ids: np.ndarray, plane: str) -> list[bytes]:
    """The planes of a block of unsigned 32-bit ids, lowest first."""
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if plane == "byte":
        return [rows[:, k].tobytes() for k in range(4)]
    return [np.packbits((rows[:, b // 8] >> (b % 8)) & 1).tobytes() for b in range(32)]


def from_planes(planes: list[bytes], n: int, plane: str) -> np.ndarray:
    if plane == "byte":
        out = np.empty((n, 4), np.uint8)
        for k, p in enumerate(planes):
            out[:, k] = np.frombuffer(p, np.uint8)
        return out.reshape(-1).view("<u4")
    out = np.zeros(n, "<u4")
    for b, p in enumerate(planes):
        if any(p):
            out |= np.unpackbits(np.frombuffer(p, np.uint8), count=n).astype("<u4") << np.uint32(b)
    return out


class ShardWriter:
    """Writes one shard to an open binary file; holds one block and a few numbers per document."""

    def __init__(self, sink, plane: str = "byte", block: int = 1 << 16, level: int = 3):
        if plane not in ("bit", "byte") or block < 8 or block % 8:
            raise ValueError("plane is bit or byte, block a multiple of 8")
        self.sink, self.plane, self.block = sink, plane, block
        self.zip = zstandard.ZstdCompressor(level=level)
        self.waiting: list[bytes] = []
        self.held = self.ids = 0
        self.at = sink.write(MAGIC) or len(MAGIC)
        self.offsets, self.lengths, self.doc_ids, self.nulls, self.counts = [], [], [], [], []

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.doc_ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.counts.append(len(ids) // 4)
        self.waiting.append(ids)
        self.held += len(ids)
        if self.held >= 4 * self.block:
            data = b"".join(self.waiting)
            whole = len(data) - len(data) % (4 * self.block)
            for i in range(0, whole, 4 * self.block):
                self.put(data[i : i + 4 * self.block])
            self.waiting, self.held = [data[whole:]], len(data) - whole

    def put(self, data: bytes) -> None:
        self.offsets.append(self.at)
        self.ids += len(data) // 4
        for p in to_planes(np.frombuffer(data, "<u4"), self.plane):
            packed = self.zip.compress(p)
            self.lengths.append(len(packed))
            self.sink.write(packed)
            self.at += len(packed)

    def close(self) -> int:
        if self.held:
            self.put(b"".join(self.waiting))
        head = json.dumps({"plane": self.plane, "block": self.block, "ids": self.ids, "docs": len(self.counts)}).encode() + b"\n"
        arrays = ((self.offsets, "<u8"), (self.lengths, "<u4"), (self.doc_ids, "<i8"), (self.nulls, "u1"), (self.counts, "<u8"))
        footer = self.zip.compress(head + b"".join(np.asarray(x, t).tobytes() for x, t in arrays))
        self.sink.write(footer + struct.pack("<Q", len(footer)) + MAGIC)
        return self.at + len(footer) + 8 + len(MAGIC)


class ShardReader:
    """Reads a shard: ``docs()`` streams the documents, ``ids(i, j)`` returns any range of ids."""

    def __init__(self, source):
        size = source.size()
        source.seek(size - 8 - len(MAGIC))
        length, magic = struct.unpack("<Q", source.read(8))[0], source.read(len(MAGIC))
        if magic != MAGIC:
            raise ValueError("not a shard of token planes")
        source.seek(size - 8 - len(MAGIC) - length)
        head, _, rest = zstandard.ZstdDecompressor().decompress(source.read(length)).partition(b"\n")
        self.source, self.head = source, json.loads(head)
        self.planes = {"bit": 32, "byte": 4}[self.head["plane"]]
        blocks, docs, at = -(-self.head["ids"] // self.head["block"]), self.head["docs"], 0
        for name, t, n in (("offsets", "<u8", blocks), ("lengths", "<u4", blocks * self.planes), ("doc_ids", "<i8", docs), ("nulls", "u1", docs), ("counts", "<u8", docs)):
            x = np.frombuffer(rest, t, n, at)
            setattr(self, name, x)
            at += x.nbytes

    def block(self, k: int) -> np.ndarray:
        n = min(self.head["block"], self.head["ids"] - k * self.head["block"])
        unzip, out = zstandard.ZstdDecompressor(), []
        self.source.seek(int(self.offsets[k]))
        for length in self.lengths[k * self.planes : (k + 1) * self.planes].tolist():
            out.append(unzip.decompress(self.source.read(length)))
        return from_planes(out, n, self.head["plane"])

    def ids(self, start: int, stop: int) -> np.ndarray:
        b = self.head["block"]
        parts = [self.block(k)[max(0, start - k * b) : stop - k * b] for k in range(start // b, -(-stop // b))]
        return np.concatenate(parts) if parts else np.zeros(0, "<u4")

    def docs(self) -> Iterator[tuple[int | None, int, np.ndarray]]:
        """(doc_id, first id within the shard, ids), one block in memory besides the document."""
        k, left, at = 0, np.zeros(0, "<u4"), 0
        for doc_id, null, n in zip(self.doc_ids.tolist(), self.nulls.tolist(), self.counts.tolist(), strict=True):
            parts, have = [left], len(left)
            while have < n:
                parts.append(self.block(k))
                have += len(parts[-1])
                k += 1
            left = np.concatenate(parts) if len(parts) > 1 else left
            yield None if null else doc_id, at, left[:n]
            left, at = left[n:], at + n


def filesystem(path: str):
    """pyarrow's file system for a local path or URI, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def write_shards(docs: DataFrame, out: str, tokenizer: str, end_id: int | None = 2, plane: str = "byte", block: int = 1 << 16) -> DataFrame:
    """Encode ``docs`` (doc_id, text; other columns are ignored), write shards below ``out``, return the manifest.

    Order: doc_id ascending, nulls first, equal doc_ids by text. A null text counts as empty; every row becomes a
    document, and ``end_id`` (none if None) is appended to each. An empty table writes no shard.
    """
    spark = docs.sparkSession

    def write(batches):
        part, shard, writer, sink, first = TaskContext.get().partitionId(), None, None, None, None
        end = b"" if end_id is None else struct.pack("<I", end_id)
        encoder = None
        for b in small(batches):
            if writer is None and b.num_rows:
                encoder = PieceEncoder(tokenizer)
                fs, base = filesystem(out)
                fs.create_dir(base, recursive=True)
                shard = f"shard-{part:06d}-{uuid.uuid4().hex}.planes"
                sink = fs.open_output_stream(f"{base}/{shard}")
                writer, first = ShardWriter(sink, plane, block), b.column(0)[0].as_py()
            ids = b.column(0).to_pylist()
            for doc_id, got in zip(ids, encoder.encode(b.column(1).to_pylist()) if ids else [], strict=True):
                writer.add(doc_id, got + end)
        if writer is not None:
            size = writer.close()
            sink.close()
            yield pa.RecordBatch.from_arrays([pa.array([shard]), pa.array([part], pa.int32()), pa.array([first], pa.int64()), pa.array([len(writer.counts)], pa.int64()), pa.array([writer.ids], pa.int64()), pa.array([size], pa.int64())], names=["file", "part", "first_doc", "docs", "ids", "bytes"])

    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return cut(ordered.mapInArrow(write, MANIFEST), "shards-manifest")


def read_shards(spark: SparkSession, manifest: DataFrame, out: str) -> DataFrame:
    """From the files that ``manifest`` names: doc_id, start, n_tokens, ids_crc32 (of the little-endian ids), shard."""
    order = Window.orderBy(F.col("first_doc").asc_nulls_first(), "part").rowsBetween(Window.unboundedPreceding, -1)
    placed = manifest.withColumn("base", F.coalesce(F.sum("ids").over(order), F.lit(0)))

    def scan(frames):
        for f in frames:
            for file, base in zip(f["file"], f["base"], strict=True):
                fs, root = filesystem(out)
                with fs.open_input_file(f"{root}/{file}") as source:
                    rows, reader = [], ShardReader(source)
                    for doc_id, at, ids in reader.docs():
                        rows.append((doc_id, int(base) + at, len(ids), zlib.crc32(ids.tobytes()), file))
                        if len(rows) == 10_000:
                            yield frame(rows)
                            rows = []
                    yield frame(rows)

    def frame(rows):
        import pandas as pd

        out = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids_crc32", "shard"])
        return out.astype({"doc_id": "Int64", "start": "int64", "n_tokens": "int64", "ids_crc32": "int64"})

    return placed.select("file", "base").repartition(input_partitions(spark), "file").mapInPandas(scan, "doc_id long, start long, n_tokens long, ids_crc32 long, shard string")


def token_planes(docs: DataFrame, tokenizer: str, end_id: int | None = 2, plane: str = "byte", block: int = 1 << 16, out: str | None = None) -> DataFrame:
    """Write the shards of ``docs`` and return what reading them back gives; see write_shards and read_shards."""
    spark = docs.sparkSession
    out = out or fresh_path(spark, "token-planes")
    return read_shards(spark, write_shards(docs, out, tokenizer, end_id, plane, block), out)
