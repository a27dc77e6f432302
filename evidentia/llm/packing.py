"""Packing of token sequences: first-fit decreasing with a tournament tree, in randomised groups of documents.

A document's ids and one end id are cut into full sequences and one rest. Every full sequence stands alone. Rests
are packed by first-fit decreasing: bins stand in a row, and a tournament tree over them holds the largest free
capacity below each node, so that the first bin with enough room is found by one walk from the root. Groups are
drawn by a hash of the document and of its place among equal rows of its partition, so that rows that repeat are spread
too; they are packed independently in parallel, and hold about `group_documents` documents and at most about
`group_bytes` of text each however large the table is; a group's last bins are all that the split into groups costs.

Cases: a null or empty text gives the end id alone; null or repeated doc_ids are packed row by row; no rows give no
rows; a text of any length is cut into as many pieces as it needs; other columns are ignored. Equal lengths are
placed in the order of doc_id and text hash.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import in_small_batches, text_or_empty
from evidentia.llm.tokens import encoded, ids_dtype

LENGTH = 1024
TOKENIZER = "byte_bpe_50k.json"
#: Rows and bytes of text of a group that are packed together; a group's memory is about this many documents' ids.
GROUP_DOCUMENTS = 4096
GROUP_BYTES = 64 << 20

PACKED = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


class Bins:
    """Bins of one capacity in a row, with a tournament tree of their free room; grows by doubling."""

    def __init__(self, capacity: int):
        self.capacity, self.leaves, self.room = capacity, 1, [capacity, capacity]
        self.used = 0

    def put(self, size: int) -> tuple[int, int]:
        """The first bin with `size` free and the place taken in it."""
        if self.room[1] < size:
            self._double()
        room, node = self.room, 1
        while node < self.leaves:
            node *= 2
            if room[node] < size:
                node += 1
        place = self.capacity - room[node]
        room[node] -= size
        bin_, self.used = node - self.leaves, max(self.used, node - self.leaves + 1)
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
        return bin_, place

    def _double(self) -> None:
        held = self.room[self.leaves :] + [self.capacity] * self.leaves
        self.leaves *= 2
        self.room = [0] * self.leaves + held
        for node in range(self.leaves - 1, 0, -1):
            self.room[node] = max(self.room[2 * node], self.room[2 * node + 1])


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """The bin and the offset in it of each length; ties keep their order."""
    bins, bin_of, at = Bins(capacity), [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        bin_of[i], at[i] = bins.put(lengths[i])
    return bin_of, at


def pack(docs: DataFrame, *, length: int = LENGTH, tokenizer: str = TOKENIZER, end_id: int = 0, group_documents: int = GROUP_DOCUMENTS, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """One row per piece: doc_id, start, length, doc_tokens, sequence_id, offset and the piece's ids.

    ids holds little-endian unsigned integers, of two bytes where the vocabulary allows it and else of four.
    """
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    groups = max(1, -(-n // group_documents), -(-size // group_bytes))
    rows = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    rows = rows.withColumn("tie", F.xxhash64("doc_id", "text"))

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        end = np.array([end_id], ids_dtype(tokenizer)).tobytes()
        # a row's place among the equal rows of its partition does not depend on the order in which they come
        repeats, partition = Counter(), TaskContext.get().partitionId()
        for frame in frames:
            texts, places = frame["text"].tolist(), []
            for tie in frame["tie"]:
                places.append(repeats[tie] << 32 | (partition if repeats[tie] else partition >> 10))
                repeats[tie] += 1
            frame["ids"], frame["place"] = [b + end for b in encoded(texts, tokenizer)], places
            yield frame[["doc_id", "tie", "place", "ids"]]

    def pack_group(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        width = ids_dtype(tokenizer).itemsize
        frame = frame.sort_values(["doc_id", "tie"], kind="stable", na_position="first")
        sizes = [len(b) // width for b in frame["ids"]]
        rests = [n % length for n in sizes]
        short = [i for i, n in enumerate(rests) if n]
        bins, at = first_fit_decreasing([rests[i] for i in short], length)
        place = dict(zip(short, zip(bins, at, strict=True), strict=True))
        first = int(key[0]) << 40
        lone = first + (1 << 39)  # full sequences are numbered apart from the packed ones
        out = []
        for i, (doc, ids) in enumerate(zip(frame["doc_id"], frame["ids"], strict=True)):
            for start in range(0, sizes[i] - rests[i], length):
                out.append((doc, start, length, sizes[i], lone, 0, ids[start * width : (start + length) * width]))
                lone += 1
            if rests[i]:
                start = sizes[i] - rests[i]
                out.append((doc, start, rests[i], sizes[i], first + place[i][0], place[i][1], ids[start * width :]))
        done = pd.DataFrame(out, columns=["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
        done["doc_id"] = done["doc_id"].astype("Int64")
        return done

    coded = rows.mapInPandas(encode, "doc_id long, tie long, place long, ids binary")
    group = F.pmod(F.xxhash64("tie", "place", F.lit(17)), F.lit(groups)).cast("int")
    return coded.groupBy(group.alias("group")).applyInPandas(pack_group, PACKED)


def digest(packed: DataFrame, *, tokenizer: str = TOKENIZER) -> DataFrame:
    """The pieces with the crc32 of their ids as unsigned 32-bit integers in place of the ids."""

    @F.pandas_udf("long")
    def crc(ids: pd.Series) -> pd.Series:
        kind = ids_dtype(tokenizer)
        return pd.Series([zlib.crc32(np.frombuffer(b, kind).astype("<u4").tobytes()) for b in ids], dtype="int64")

    return packed.withColumn("ids_crc32", crc("ids")).drop("ids")
