"""Files of token ids: one array of ids, and the documents' boundaries in it in Elias-Fano code.

A file (shard) holds whole documents in ascending order of doc_id:

    magic "TESSIDS1", then little-endian u64: documents, documents without id (they come first), ids, bytes an id,
    smallest doc_id (two's complement), then two Elias-Fano sequences, then the ids.

The first sequence holds the boundaries (documents + 1 values from 0 to the number of ids), the second the doc_ids less
the smallest. A sequence keeps the low bits of its values packed and their high bits in unary, with a 32-bit count of ones
before each 512 bits, by which any value is selected. Where a file stands in the whole is told by the manifest: one row a
file, of the attempts that Spark committed.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import pieces_of, shared_folder, table, written
from tessera.llm.tokens import ByteLevel, vocabulary

MAGIC = b"TESSIDS1"
HEAD = struct.Struct("<8sQQQQq")
#: Ids of a file at about; a longer document is a file's last.
SHARD = 1 << 24
#: Bits between counts of ones; values selected at a time.
BLOCK, STEP = 512, 1 << 16
#: The id that ends a document.
END = 2


class EliasFano:
    """A rising sequence of numbers from 0 on, in about 2 + log2(last / count) bits each."""

    HEAD = struct.Struct("<QQQ")

    def __init__(self, count: int, low_bits: int, low: np.ndarray, high: np.ndarray, ones: np.ndarray):
        self.count, self.low_bits, self.low, self.high, self.ones = count, low_bits, low, high, ones

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        last = int(values[-1]) if n else 0
        bits = max(0, (last // n).bit_length() - 1) if n else 0
        low = np.zeros(0, np.uint8)
        if bits:
            low = np.packbits(np.unpackbits(values.astype("<u8").view(np.uint8).reshape(n, 8), axis=1, bitorder="little")[:, :bits].ravel(), bitorder="little")
        at = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        size = -(-((last >> bits) + n + 1) // BLOCK) * BLOCK
        unary = np.zeros(size, bool)
        unary[at] = True
        ones = np.concatenate(([0], np.cumsum(unary.reshape(-1, BLOCK).sum(axis=1))[:-1])).astype("<u4")
        return cls(n, bits, low, np.packbits(unary, bitorder="little"), ones)

    def select(self, which: np.ndarray) -> np.ndarray:
        """The values at some places."""
        which = np.asarray(which, np.int64)
        out = np.empty(len(which), np.uint64)
        words = self.high.view("<u8").reshape(-1, BLOCK // 64)
        for lo in range(0, len(which), STEP):
            i = which[lo : lo + STEP]
            block = np.searchsorted(self.ones, i, "right") - 1
            left = i - self.ones[block].astype(np.int64)  # ones to pass within the block
            before = np.cumsum(np.bitwise_count(words[block]), axis=1, dtype=np.int64)
            word = (before <= left[:, None]).sum(axis=1)
            left -= np.where(word > 0, np.take_along_axis(before, np.maximum(word - 1, 0)[:, None], 1)[:, 0], 0)
            bits = np.unpackbits(words[block, word].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            inside = (np.cumsum(bits, axis=1, dtype=np.int64) <= left[:, None]).sum(axis=1)
            high = block * BLOCK + word * 64 + inside - i
            out[lo : lo + STEP] = (high.astype(np.uint64) << np.uint64(self.low_bits)) | self._low(i)
        return out

    def _low(self, i: np.ndarray) -> np.ndarray:
        if not self.low_bits:
            return np.zeros(len(i), np.uint64)
        at = i[:, None] * self.low_bits + np.arange(self.low_bits)
        bits = (self.low[at >> 3] >> (at & 7).astype(np.uint8)) & 1
        return (bits.astype(np.uint64) << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)

    def dump(self) -> bytes:
        low = self.low.tobytes()
        low += bytes(-len(low) % 8)
        return self.HEAD.pack(self.count, self.low_bits, len(self.ones)) + low + self.high.tobytes() + self.ones.tobytes() + bytes(-4 * len(self.ones) % 8)

    @classmethod
    def load(cls, data: memoryview, at: int = 0) -> tuple[EliasFano, int]:
        """A sequence and where it ends."""
        count, bits, blocks = cls.HEAD.unpack_from(data, at)
        at += cls.HEAD.size
        low = -(-count * bits // 8)
        parts = []
        for kind, length in (("u1", low), ("u1", blocks * BLOCK // 8), ("<u4", blocks)):
            parts.append(np.frombuffer(data, kind, length, at))
            size = parts[-1].nbytes
            at += size + -size % 8
        return cls(count, bits, *parts), at


class Shard:
    """A file's documents: ids by place, without taking the others apart."""

    def __init__(self, data: bytes):
        view = memoryview(data)
        magic, self.documents, self.nulls, self.n_ids, width, self.first = HEAD.unpack_from(view)
        if magic != MAGIC or width not in (2, 4):
            raise ValueError("not a file of token ids")
        self.bounds, at = EliasFano.load(view, HEAD.size)
        self.names, at = EliasFano.load(view, at)
        if self.bounds.count != self.documents + 1 or len(data) != at + width * self.n_ids:
            raise ValueError("a file of token ids that was cut or damaged")
        self.ids = np.frombuffer(view, f"<u{width}", self.n_ids, at)

    @staticmethod
    def pack(doc_ids: list[int | None], lengths: list[int], ids: list[bytes], width: int) -> bytes:
        nulls = sum(d is None for d in doc_ids)
        known = np.array(doc_ids[nulls:], np.int64)
        first = int(known[0]) if len(known) else 0
        bounds = np.concatenate(([0], np.cumsum(lengths)))
        names = known.astype(np.uint64) - np.uint64(first % (1 << 64))  # wraps, as a difference beyond 2**63 must
        return b"".join((HEAD.pack(MAGIC, len(doc_ids), nulls, int(bounds[-1]), width, first), EliasFano.of(bounds).dump(), EliasFano.of(names).dump(), *ids))

    def document(self, i: int) -> np.ndarray:
        lo, hi = self.bounds.select(np.array([i, i + 1])).astype(np.int64)
        return self.ids[lo:hi]

    def doc_ids(self) -> list[int | None]:
        known = (self.names.select(np.arange(self.names.count)) + np.uint64(self.first % (1 << 64))).astype(np.int64)
        return [None] * self.nulls + known.tolist()

    def offsets(self) -> np.ndarray:
        return self.bounds.select(np.arange(self.documents + 1)).astype(np.int64)


def write(docs: DataFrame, folder: str, path: str, end: int = END, shard: int = SHARD) -> DataFrame:
    """Documents (doc_id, text) to files of a folder that all executors reach; the manifest of them: part, seq, name,
    documents, n_ids, and start, the ids of all files before. Documents stand in ascending order of doc_id, without id
    first, of one doc_id by the texts' hash, so that runs agree and no id's rows need meet in one task; each ends with the id
    ``end``; null and empty texts are nothing else. No documents, no file.

    An attempt gives its files names of their own and the manifest lists those of committed attempts, so what a lost
    executor left is never read."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("h"))
    placed = rows.repartitionByRange(pieces_of(docs, 4, 32 << 20), F.asc_nulls_first("doc_id"), "h").sortWithinPartitions(F.asc_nulls_first("doc_id"), "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        encoder = _encoder(path)
        width = encoder.width.itemsize
        last = np.array([end], encoder.width).tobytes()
        part, seq, held = 0, 0, ([], [], [])

        def close() -> pa.RecordBatch:
            name = f"{uuid.uuid4().hex}.ids"
            with store.open_output_stream(f"{root}/{name}") as out:
                out.write(Shard.pack(*held, width))
            row = (part, seq, name, len(held[0]), sum(held[1]))
            for x in held:
                x.clear()
            return pa.RecordBatch.from_pylist([dict(zip(("part", "seq", "name", "documents", "n_ids"), row, strict=True))])

        n = 0
        for b in batches:
            part = b.column("part")[0].as_py() if b.num_rows else part
            ids = encoder.ids(b.column("text"))
            for d, x in zip(b.column("doc_id").to_pylist(), ids, strict=True):
                held[0].append(d)
                held[1].append(len(x) // width + 1)
                held[2].append(x + last)
                if (n := n + held[1][-1]) >= shard:
                    yield close()
                    seq, n = seq + 1, 0
        if held[0]:
            yield close()

    made = written(placed.select("doc_id", "text", F.spark_partition_id().alias("part")).mapInArrow(run, "part long, seq long, name string, documents long, n_ids long"), "manifest")
    inner = made.withColumn("before", F.sum("n_ids").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)))
    parts = made.groupBy("part").agg(F.sum("n_ids").alias("n"))  # one row a task that wrote
    parts = parts.select("part", F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("all_before"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    start = (zero(F.col("before")) + zero(F.col("all_before"))).alias("start")
    return written(inner.join(parts, "part").select("part", "seq", "name", "documents", "n_ids", start), "manifest")


_encoders: dict[str, ByteLevel] = {}


def _encoder(path: str) -> ByteLevel:
    """A worker's tokenizer: one of each file, with the pieces it knows by now."""
    if path not in _encoders:
        _encoders[path] = ByteLevel(path)
    return _encoders[path]


def read(manifest: DataFrame, folder: str, ids: bool = False) -> DataFrame:
    """The documents of the manifest's files: doc_id, start (ids of all documents before), n_tokens, ids_crc32 (of the ids
    as little-endian unsigned 32-bit numbers) and, with ``ids``, the ids. A worker holds one file."""
    spark = manifest.sparkSession
    n, cores = manifest.count(), spark.sparkContext.defaultParallelism
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for b in batches:
            for name, start in zip(b.column("name").to_pylist(), b.column("start").to_pylist(), strict=True):
                with store.open_input_file(f"{root}/{name}") as file:
                    got = Shard(file.read())
                at, names = got.offsets(), got.doc_ids()
                for lo in range(0, got.documents, 4096):
                    cuts = at[lo : lo + 4097]
                    wide = memoryview(got.ids[cuts[0] : cuts[-1]].astype("<u4")).cast("B")
                    inner = ((cuts - cuts[0]) * 4).tolist()
                    crc = [zlib.crc32(wide[x:y]) for x, y in zip(inner, inner[1:], strict=False)]
                    columns = [pa.array(names[lo : lo + 4096], pa.int64()), pa.array(cuts[:-1] + start), pa.array(np.diff(cuts)), pa.array(crc, pa.int64())]
                    if ids:
                        columns.append(pa.ListArray.from_arrays(pa.array(cuts - cuts[0], pa.int32()), pa.array(got.ids[cuts[0] : cuts[-1]], pa.int64())))
                    yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32", "ids"][: len(columns)])

    dealt = manifest.select("name", "start").repartition(max(1, min(n, 8 * cores), n // 16), "name")
    return dealt.mapInArrow(run, schema)


def op13_tokenbin(spark, sf_dir):
    """Every whole text of ``documents`` as ids in files, read back from them. Null and empty texts are the end id alone,
    repeated rows stand as often as they occur, an empty table gives no rows; other columns don't matter."""
    folder = shared_folder(spark, "tokens")
    manifest = write(table(spark, sf_dir, "documents"), folder, vocabulary("byte_bpe_50k.json"))
    return read(manifest, folder)
