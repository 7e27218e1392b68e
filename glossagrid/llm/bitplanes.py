"""Token ids in binary shard files: bit-plane shuffled blocks, zstandard, a chunk index.

A shard file holds the ids of consecutive documents in ascending doc_id order:

    magic "BPLN0001", u64 header length, header (JSON), documents, chunks

The header names the number of ids and documents, and for each chunk its number
of ids, bit width and the compressed size of every plane. `documents` is the
zstandard frame of two i64 arrays (doc_id, number of ids) and a null mask. A
chunk is a block of at most `block` ids; plane k holds bit k of all its ids,
eight ids a byte, compressed on its own. Any block can be read alone by the
index.

Rows with equal ids keep an order by text hash; null ids come first. Null and
empty texts give just the end id. An empty table gives no file.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..session import lookup_side, scratch_path, settle
from .base import END_ID, WordIds, slices, whole

MAGIC = b"BPLN0001"
BLOCK = 1 << 16
SHARD_IDS = 1 << 22


def pack_block(ids: np.ndarray, compress) -> tuple[int, list[bytes]]:
    """Bit width and compressed planes of one block of u32 ids."""
    width = int(ids.max()).bit_length() if len(ids) else 0
    bits = [(ids >> np.uint32(k)).astype(np.uint8) & 1 for k in range(width)]
    return width, [compress(np.packbits(b, bitorder="little").tobytes()) for b in bits]


def unpack_block(n: int, planes: list[bytes]) -> np.ndarray:
    out = np.zeros((n, 32), np.uint8)
    for k, plane in enumerate(planes):
        out[:, k] = np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little")
    return np.packbits(out, axis=1, bitorder="little").view("<u4").ravel()


def shard_bytes(doc_ids: list, docs: list[bytes], block: int = BLOCK, level: int = 1) -> bytes:
    """One shard file from documents' packed ids."""
    import zstandard

    compress = zstandard.ZstdCompressor(level=level).compress
    ids = np.frombuffer(b"".join(docs), "<u4")
    index, body = [], []
    for at in range(0, len(ids), block):
        part = ids[at:at + block]
        width, planes = pack_block(part, compress)
        index.append([len(part), width, [len(p) for p in planes]])
        body += planes
    known = np.array([d is not None for d in doc_ids], np.uint8)
    listed = compress(np.array([0 if d is None else d for d in doc_ids], "<i8").tobytes()
                      + np.array([len(d) // 4 for d in docs], "<i8").tobytes() + known.tobytes())
    header = json.dumps({"ids": len(ids), "docs": len(docs), "documents": len(listed), "chunks": index}).encode()
    return b"".join([MAGIC, struct.pack("<Q", len(header)), header, listed, *body])


class Shard:
    """Reads a shard's documents, or any one of its chunks by the index."""

    def __init__(self, data: bytes):
        import zstandard

        if data[:8] != MAGIC:
            raise ValueError("not a bit-plane shard")
        size = struct.unpack_from("<Q", data, 8)[0]
        self.header = json.loads(data[16:16 + size])
        self._data, self._expand = data, zstandard.ZstdDecompressor().decompress
        at = 16 + size + self.header["documents"]
        n = self.header["docs"]
        listed = self._expand(data[16 + size:at], max_output_size=17 * n + 64)
        self.doc_ids = np.frombuffer(listed, "<i8", n)
        self.lengths = np.frombuffer(listed, "<i8", n, 8 * n)
        self.known = np.frombuffer(listed, np.uint8, n, 16 * n).astype(bool)
        self.places = []
        for count, _, sizes in self.header["chunks"]:
            self.places.append((at, count, sizes))
            at += sum(sizes)

    def chunk(self, k: int) -> np.ndarray:
        at, count, sizes = self.places[k]
        planes = []
        for size in sizes:
            planes.append(self._expand(self._data[at:at + size], max_output_size=count // 8 + 64))
            at += size
        return unpack_block(count, planes)

    def ids(self) -> np.ndarray:
        return np.concatenate([self.chunk(k) for k in range(len(self.places))] or [np.zeros(0, "<u4")])


def _put(folder: str, name: str, data: bytes, attempt: str) -> None:
    """Write under a name of this attempt's own, then rename: a retried task writes the same bytes."""
    from pyarrow import fs

    store, root = fs.FileSystem.from_uri(folder)
    store.create_dir(root, recursive=True)
    own = f"{root}/.{name}.{attempt}"
    with store.open_output_stream(own) as out:
        out.write(data)
    try:
        store.move(own, f"{root}/{name}")
    except OSError:
        if store.get_file_info(f"{root}/{name}").size != len(data):
            raise
        store.delete_file(own)


def write_ids(docs: DataFrame, folder: str, tokenizer: str, shard_ids: int = SHARD_IDS, block: int = BLOCK) -> DataFrame:
    """Encode `text`, end each document with id 1, and write shards by ascending doc_id.

    `folder` is a URI all executors reach. Returns the manifest: file, ids, docs and
    start (ids in all files before it), one row per shard.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, end = WordIds(tokenizer), struct.pack("<I", END_ID)
        context = TaskContext.get()
        part, attempt = context.partitionId(), str(context.taskAttemptId())
        doc_ids, packed, held, shard = [], [], 0, 0

        def flush():
            name = f"part-{part:06d}-{shard:06d}.bpl"
            _put(folder, name, shard_bytes(doc_ids, packed, block), attempt)
            return pa.RecordBatch.from_pydict(
                {"file": [name], "ids": [held], "docs": [len(packed)]},
                schema=pa.schema([("file", pa.string()), ("ids", pa.int64()), ("docs", pa.int64())]))

        for batch in slices(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = words.encode(text) + end
                doc_ids.append(doc_id)
                packed.append(ids)
                held += len(ids) // 4
                if held >= shard_ids:
                    yield flush()
                    doc_ids, packed, held, shard = [], [], 0, shard + 1
        if packed:
            yield flush()

    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), whole(F.col("text")).alias("text"))
    key = ["doc_id", F.xxhash64("text")]
    ordered = rows.repartitionByRange(n, *key).sortWithinPartitions(*key)
    listed = settle(ordered.mapInArrow(write, "file string, ids bigint, docs bigint"))
    # One row per few million ids: the running sum over files is small.
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    return listed.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0)))


def read_ids(spark: SparkSession, folder: str, manifest: DataFrame) -> DataFrame:
    """Documents of the shards: doc_id, start, ids (little-endian u32 bytes)."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content, start in zip(batch.column(0), batch.column(1).to_pylist()):
                shard = Shard(content.as_buffer().to_pybytes())
                ids = shard.ids()
                ends = np.cumsum(shard.lengths)
                for at in range(0, len(ends), 1000):
                    a, z = (ends[at - 1] if at else 0), ends[min(at + 1000, len(ends)) - 1]
                    offsets = np.concatenate([[a], ends[at:at + 1000]]) - a
                    yield pa.RecordBatch.from_arrays([
                        pa.array(shard.doc_ids[at:at + 1000], mask=~shard.known[at:at + 1000]),
                        pa.array(start + a + offsets[:-1]),
                        pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [
                            None, pa.py_buffer((offsets * 4).astype("<i8").tobytes()), pa.py_buffer(ids[a:z].tobytes())]).cast(pa.binary()),
                    ], names=["doc_id", "start", "ids"])

    if not manifest.head(1):
        return spark.createDataFrame([], "doc_id bigint, start bigint, ids binary")
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bpl").load(folder)
    named = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content")
    return named.join(lookup_side(manifest.select("file", "start")), "file").select("content", "start").mapInArrow(
        read, "doc_id bigint, start bigint, ids binary")


def round_trip(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Write the shards into a fresh shared folder and read them back."""
    folder = scratch_path(docs.sparkSession, "bitplanes")
    manifest = write_ids(docs, folder, tokenizer)
    return read_ids(docs.sparkSession, folder, manifest)
