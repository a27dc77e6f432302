"""Token ids in sorted-string-table shards, written and read by Spark tasks.

A shard holds the documents of one range of doc_id in ascending order. Its layout:

    blocks   entries of (shared prefix, suffix length, value length, suffix, value); the first key of a block is whole
    Bloom    bits over the keys, `BLOOM_BITS` a key
    index    for each block its first key, offset, length and number of entries
    footer   offsets and lengths of Bloom and index, numbers of entries and ids, id width, crc32 of Bloom and index

Shards hold about `SHARD_BYTES` of text, but are at least as many as shuffle partitions. A key is one byte that tells null from a value, then the id as eight bytes in an order that bytes compare by. A value
is the document's ids, end id included, as little-endian integers. A look-up reads the footer, the index and the
Bloom filter, and then the one block that a binary search in the index names.

Shards go to a folder that all executors share: each task writes under a name of its own attempt and renames at the
end, so a task that is run again after a lost executor leaves whole files only.

Cases: a null text is an empty one and has the end id alone; null doc_ids come first; a doc_id that occurs more than
once keeps all its entries; no rows give no shards and no result rows; other columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.common import in_small_batches, parallelism, shared_dir, text_or_empty
from evidentia.llm.tokens import encoded, ids_dtype

MAGIC = b"EVSST01\n"
TOKENIZER = "word_bpe_49k.json"
BLOCK_BYTES = 1 << 16
SHARD_BYTES = 128 << 20
BLOOM_BITS, BLOOM_HASHES = 10, 7
_FOOTER = struct.Struct("<QQQQQQQII8s")
_ENTRY = struct.Struct("<BBI")
_INDEX = struct.Struct("<9sQII")


def key_bytes(doc_id: int | None) -> bytes:
    return b"\0" * 9 if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def key_id(key: bytes) -> int | None:
    return None if key[:1] == b"\0" else struct.unpack(">Q", key[1:])[0] - (1 << 63)


def _bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.crc32(key[::-1], 0x5BD1E995) | 1
    return [(a + i * b + i * i) % bits for i in range(BLOOM_HASHES)]


class ShardWriter:
    """Writes entries that come in key order to an open binary file."""

    def __init__(self, out, width: int):
        self.out, self.width, self.at = out, width, 0
        self.block, self.size, self.last, self.count = [], 0, b"", 0
        self.index, self.keys, self.entries, self.ids = [], [], 0, 0
        self._write(MAGIC)

    def _write(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, key: bytes, value: bytes) -> None:
        shared = 0
        if self.block:
            while shared < len(key) and shared < len(self.last) and key[shared] == self.last[shared]:
                shared += 1
        else:
            self.first = key
        self.block += (_ENTRY.pack(shared, len(key) - shared, len(value)), key[shared:], value)
        self.size += _ENTRY.size + len(key) - shared + len(value)
        self.last, self.count, self.entries, self.ids = key, self.count + 1, self.entries + 1, self.ids + len(value) // self.width
        self.keys.append(key)
        if self.size >= BLOCK_BYTES:
            self._close_block()

    def _close_block(self) -> None:
        if self.block:
            data = b"".join(self.block)
            self.index.append(_INDEX.pack(self.first, self.at, len(data), self.count))
            self._write(data)
            self.block, self.size, self.count = [], 0, 0

    def finish(self) -> None:
        self._close_block()
        bits = max(64, BLOOM_BITS * self.entries)
        bloom = bytearray(-(-bits // 8))
        for key in self.keys:
            for p in _bloom_places(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        index, bloom_at = b"".join(self.index), self.at
        self._write(bytes(bloom))
        index_at = self.at
        self._write(index)
        self._write(_FOOTER.pack(bloom_at, bits, index_at, len(index), len(self.index), self.entries, self.ids, self.width, zlib.crc32(index, zlib.crc32(bloom)), MAGIC))


class ShardReader:
    """Reads a shard from a seekable binary file."""

    def __init__(self, file):
        self.file = file
        end = file.seek(0, 2)
        file.seek(end - _FOOTER.size)
        self.bloom_at, self.bits, index_at, size, blocks, self.entries, self.ids, self.width, crc, magic = _FOOTER.unpack(file.read(_FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        file.seek(self.bloom_at)
        self.bloom = file.read(index_at - self.bloom_at)
        index = file.read(size)
        if zlib.crc32(index, zlib.crc32(self.bloom)) != crc:
            raise ValueError("the shard's index or Bloom filter is damaged")
        self.index = [_INDEX.unpack_from(index, i * _INDEX.size) for i in range(blocks)]

    def _block(self, i: int) -> Iterator[tuple[bytes, bytes]]:
        _, at, size, count = self.index[i]
        self.file.seek(at)
        data, p, key = self.file.read(size), 0, b""
        for _ in range(count):
            shared, rest, length = _ENTRY.unpack_from(data, p)
            p += _ENTRY.size
            key = key[:shared] + data[p : p + rest]
            p += rest
            yield key, data[p : p + length]
            p += length

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for i in range(len(self.index)):
            yield from self._block(i)

    def get(self, key: bytes) -> list[bytes]:
        """All values of a key."""
        if not all(self.bloom[p >> 3] & (1 << (p & 7)) for p in _bloom_places(key, self.bits)):
            return []
        low, high = 0, len(self.index)
        while low < high:  # the first block whose first key is not below the key
            mid = (low + high) // 2
            low, high = (mid + 1, high) if self.index[mid][0] < key else (low, mid)
        found = []
        for i in range(max(low - 1, 0), len(self.index)):
            if self.index[i][0] > key:
                break
            found += [v for k, v in self._block(i) if k == key]
        return found


def _open(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


def write_shards(docs: DataFrame, folder: str, *, tokenizer: str = TOKENIZER, end_id: int = 1, shards: int | None = None) -> list[tuple]:
    """Writes the shards and returns (path, entries, ids) of each in key order; one such row a shard is all that the driver gets."""
    spark = docs.sparkSession
    rows = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    n = shards or max(parallelism(spark), -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // SHARD_BYTES))
    # rows that repeat an id are parted by their texts' hash, so that one id may fill several shards, which stand next to each other
    rows = rows.withColumn("tie", F.xxhash64("text"))
    rows = rows.repartitionByRange(n, "doc_id", "tie").sortWithinPartitions("doc_id", "tie").drop("tie")

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        out, name = None, None
        kind, task = ids_dtype(tokenizer), TaskContext.get()
        end = np.array([end_id], kind).tobytes()
        for frame in frames:
            if out is None and len(frame):
                system, base = _open(folder)
                system.create_dir(base, recursive=True)
                name = f"{base}/shard-{task.partitionId():06d}.sst"
                part = f"{name}.{task.taskAttemptId()}-{uuid.uuid4().hex}.part"
                out = system.open_output_stream(part)
                writer = ShardWriter(out, kind.itemsize)
            ids = (None if pd.isna(i) else int(i) for i in frame["doc_id"])
            for doc, coded in zip(ids, encoded(frame["text"].tolist(), tokenizer), strict=True):
                writer.add(key_bytes(doc), coded + end)
        if out is not None:
            writer.finish()
            out.close()
            system.move(part, name)
            yield pd.DataFrame({"shard": [task.partitionId()], "path": [f"{folder}/{name.rsplit('/', 1)[1]}"], "entries": [writer.entries], "ids": [writer.ids]})

    made = rows.mapInPandas(write, "shard int, path string, entries long, ids long").collect()
    return [(r["path"], r["entries"], r["ids"]) for r in sorted(made)]


def read_shards(spark: SparkSession, shards: list[tuple]) -> DataFrame:
    """doc_id, start, n_tokens and the ids of every entry, each shard read by one task."""
    schema = "doc_id long, start long, n_tokens long, ids binary"
    if not shards:
        return spark.createDataFrame([], schema)
    starts = [0, *np.cumsum([s[2] for s in shards]).tolist()]
    listed = spark.createDataFrame([(i, s[0], starts[i]) for i, s in enumerate(shards)], "shard int, path string, start long")

    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, start in zip(frame["path"], frame["start"], strict=True):
                system, name = _open(path)
                with system.open_input_file(name) as file:
                    reader, rows, held = ShardReader(file), [], 0
                    for key, value in reader:
                        n = len(value) // reader.width
                        rows.append((key_id(key), start, n, value))
                        start, held = start + n, held + len(value)
                        if held > 1 << 23:
                            yield _frame(rows)
                            rows, held = [], 0
                    yield _frame(rows)

    return listed.repartitionByRange(len(shards), "shard").mapInPandas(read, schema)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    frame = pd.DataFrame(rows, columns=["doc_id", "start", "n_tokens", "ids"])
    frame["doc_id"] = frame["doc_id"].astype("Int64")
    return frame


def look_up(shard: str, doc_id: int | None) -> list[np.ndarray]:
    """The ids of all entries of one document in a shard."""
    system, name = _open(shard)
    with system.open_input_file(name) as file:
        reader = ShardReader(file)
        return [np.frombuffer(v, f"<u{reader.width}") for v in reader.get(key_bytes(doc_id))]


def round_trip(docs: DataFrame, *, tokenizer: str = TOKENIZER, end_id: int = 1) -> DataFrame:
    """Writes shards under the shared folder and returns what reading them gives, with the crc32 of each document's ids."""
    spark = docs.sparkSession
    shards = write_shards(docs, f"{shared_dir(spark)}/sst-{uuid.uuid4().hex}", tokenizer=tokenizer, end_id=end_id)

    @F.pandas_udf("long")
    def crc(ids: pd.Series) -> pd.Series:
        kind = ids_dtype(tokenizer)
        return pd.Series([zlib.crc32(np.frombuffer(b, kind).astype("<u4").tobytes()) for b in ids], dtype="int64")

    return read_shards(spark, shards).withColumn("ids_crc32", crc("ids"))
