"""Benchmark items inside documents: size-partitioned MinHash containment search, verified by exact containment.

Items are put into classes by the number of their shingles, each class twice as wide as the one before. For each
class the shingles of a document are cut into windows of twice the class's upper size that overlap by half, so that
an item that stands in the document stands whole in some window, and the window is at most about four times as large
as the item: a containment of 0.8 is then a Jaccard similarity of at least 0.19 however long the document is. A
window is a candidate for an item if they agree in any of `HASHES` minima (missed once in 800 times at that bound,
once in 10,000 for a whole item). A candidate is kept if the document as a whole has at least `containment` of the
item's distinct shingles. Of an item with fewer than `FEW` distinct shingles, which is small beside the smallest
windows, every text that has one of them is a candidate; an item shorter than a shingle is one shingle of its length.

Both sides meet in Spark joins: items by class, hash and minimum, then by shingle. Neither items nor documents go to
the driver. Documents are read once and send only minima and shingles that may be an item's: those that hit bitmaps of
all items' keys, which grow with the items up to `BITMAP_BITS` and beyond that only let more rows through. The items'
side is broadcast if it has at most `broadcast_rows` rows; beyond that rows are dealt by key and `SALTS` salts, so
that an item that stands in a large part of all documents doesn't make one task.

Cases: null and empty texts hold nothing; items without words are never found; null ids stay as they are; rows that
repeat id and text are listed each time if they are documents, and count once if they are items; texts of any length
are searched whole; no rows on either side give no rows; other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import cut, in_small_batches, text_or_empty
from evidentia.llm.words import mix, runs, shingle_hashes, word_hashes

WORDS, CONTAINMENT = 5, 0.8
HASHES = 32
#: Shingles of the smallest class of items, and of the pieces that windows are put together from.
SMALLEST = 8
#: Items with fewer distinct shingles are looked up by the shingles themselves.
FEW = SMALLEST // 2
#: Most bits of a bitmap of keys (32 MB), and bits for each key where these are enough; a document asks for thousands.
BITMAP_BITS, BITS_PER_KEY = 1 << 28, 256
#: Rows of 24 bytes or so that are broadcast at most.
BROADCAST_ROWS = 500_000
SALTS = 16
#: Kinds of an item's keys: a minimum, a shingle, and a shingle by which alone an item is a candidate.
MINIMUM, SHINGLE, DIRECT = 0, 1, 2
_STEP = np.uint64(0x9E3779B97F4A7C15)
_CHUNK = 1 << 15

_FACTORS = mix(np.arange(1, HASHES + 1, dtype=np.uint64) * _STEP) | np.uint64(1)


def size_class(n: int) -> int:
    """The upper size of the class of an item with n distinct shingles."""
    upper = SMALLEST
    while upper < n:
        upper *= 2
    return upper


def _offsets(upper: int) -> np.ndarray:
    """What is added to a class's minima, by hash function, so that those of different classes and functions differ."""
    return mix(np.arange(HASHES, dtype=np.uint64) + np.uint64(upper * int(_STEP) % (1 << 64)))


def item_keys(benchmark: DataFrame) -> DataFrame:
    """(item_id, item_hash, n, gram, upper, kind, key, check) of each item: its distinct shingles, and its minima; check
    is the key's scramble, for more places in a bitmap."""

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            for a, b in runs(texts):
                tokens, words = word_hashes(texts[a:b])
                shingles, bounds = shingle_hashes(tokens, words, WORDS)
                rows = []
                for i in range(b - a):
                    own = np.unique(shingles[bounds[i] : bounds[i + 1]])
                    length = int(words[i + 1] - words[i])
                    direct = length < WORDS or len(own) < FEW
                    upper = 0 if direct else size_class(len(own))
                    minima = own[:0] if direct else (own[None, :] * _FACTORS[:, None]).min(axis=1) + _offsets(upper)
                    for kind, keys in ((DIRECT if direct else SHINGLE, own), (MINIMUM, minima)):
                        if len(keys):
                            rows.append((frame["item_id"].iloc[a + i], frame["item_hash"].iloc[a + i], len(own), min(length, WORDS), upper, kind, keys.astype(np.int64), mix(keys).astype(np.int64)))
                if rows:
                    yield pd.DataFrame(rows, columns=["item_id", "item_hash", "n", "gram", "upper", "kind", "key", "check"])

    items = in_small_batches(benchmark).select("item_id", text_or_empty().alias("text")).distinct()
    kind = benchmark.schema["item_id"].dataType.simpleString()
    # ids go through Python as text, so that those that are null and those of any type come back as they were
    items = items.select(F.col("item_id").cast("string"), F.xxhash64("text").alias("item_hash"), "text")
    found = items.mapInPandas(measure, "item_id string, item_hash long, n int, gram int, upper int, kind int, key array<long>, check array<long>")
    return found.select(F.col("item_id").cast(kind), "item_hash", "n", "gram", "upper", "kind", F.inline(F.arrays_zip("key", "check")))


def bitmap(keys: DataFrame, count: int) -> np.ndarray:
    """A Bloom filter of the rows' keys, three bits each, put together in chunks of 4 KB; its size is bounded whatever
    their number."""
    bits = _CHUNK
    while bits < min(BITS_PER_KEY * count, BITMAP_BITS):
        bits *= 2
    places = F.explode(F.array(*[x.bitwiseAND(F.lit(bits - 1)) for x in (F.col("key"), F.col("check"), F.shiftright("check", 32))]))
    chunks = keys.select(places.alias("p")).groupBy(F.shiftright("p", 15).alias("c")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(F.lit(_CHUNK - 1))).alias("b"))
    out = np.zeros(bits // 8, np.uint8)
    for c, b in chunks.toLocalIterator():
        out[c * _CHUNK // 8 : (c + 1) * _CHUNK // 8] = np.frombuffer(b, np.uint8)
    return out


def may_hold(held: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The places of the keys that are among a filter's, or seem to be."""
    bit = lambda x: (held[(x & mask) >> np.uint64(3)] >> (x & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
    mask = np.uint64(8 * len(held) - 1)
    at = np.flatnonzero(bit(keys))
    for shift in (0, 32):
        at = at[bit(mix(keys[at]) >> np.uint64(shift))]
    return at


@dataclass
class Filter:
    """What a task must know of all items: bitmaps of their keys, their classes and the lengths of short ones."""

    minima: np.ndarray
    shingles: np.ndarray
    direct: np.ndarray
    classes: list[int]
    grams: list[int]

    def hits(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Keys of windows and distinct shingles of each text that may be an item's; nothing for texts without a candidate."""
        tokens, words = word_hashes(texts)
        shingles, bounds = shingle_hashes(tokens, words, WORDS)
        found = [(shingles, bounds)] + [shingle_hashes(tokens, words, g) for g in self.grams if g < WORDS]
        texts_of = lambda places, at: np.searchsorted(at, places, side="right") - 1
        keys, owners = self._window_keys(shingles, bounds)
        minima: dict[int, list] = {}
        for key, text in zip(keys, owners, strict=True):
            minima.setdefault(int(text), []).append(key)
        wanted = set(minima)
        for grams, at in found:
            wanted.update(texts_of(may_hold(self.direct, grams), at).tolist())
        own: dict[int, list] = {}
        for grams, at in found if wanted else ():
            places = np.union1d(may_hold(self.shingles, grams), may_hold(self.direct, grams))
            for place, text in zip(places, texts_of(places, at), strict=True):
                if text in wanted:
                    own.setdefault(int(text), []).append(grams[place])
        none = np.zeros(0, np.uint64)
        return [np.unique(minima[i]) if i in minima else none for i in range(len(texts))], [np.unique(own[i]) if i in own else none for i in range(len(texts))]

    def _window_keys(self, shingles: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Keys of all windows that hit the bitmap, and the windows' texts."""
        counts = np.diff(bounds)
        pieces = -(-counts // SMALLEST)  # pieces of each text
        piece_at = np.concatenate(([0], np.cumsum(pieces)))
        keys, owners = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
        if piece_at[-1] and self.classes:
            piece_text = np.repeat(np.arange(len(counts)), pieces)
            nth = np.arange(piece_at[-1]) - piece_at[piece_text]
            starts = bounds[piece_text] + nth * SMALLEST
            halves = {}
            for upper in self.classes:
                first = np.flatnonzero(nth % (upper // SMALLEST) == 0)
                text = piece_text[first]
                halves[upper] = first, text, np.flatnonzero(text[:-1] == text[1:]), _offsets(upper)
            for k, factor in enumerate(_FACTORS):
                least = np.minimum.reduceat(shingles * factor, starts)
                for first, text, pairs, offsets in halves.values():
                    window = np.minimum.reduceat(least, first)
                    window[pairs] = np.minimum(window[pairs], window[pairs + 1])
                    window += offsets[k]
                    hit = may_hold(self.minima, window)
                    keys.append(window[hit])
                    owners.append(text[hit])
        return np.concatenate(keys), np.concatenate(owners)


def _filter(items: DataFrame) -> tuple[Filter, int]:
    """The filter of the items' keys, and the number of keys."""
    counts = {r["kind"]: (r["c"], r["uppers"], r["grams"]) for r in items.groupBy("kind").agg(F.count("*").alias("c"), F.collect_set("upper").alias("uppers"), F.collect_set("gram").alias("grams")).collect()}
    held = [bitmap(items.where(F.col("kind") == kind), counts[kind][0]) if kind in counts else np.zeros(_CHUNK // 8, np.uint8) for kind in (MINIMUM, SHINGLE, DIRECT)]
    classes = sorted(counts[MINIMUM][1]) if MINIMUM in counts else []
    return Filter(*held, classes, sorted(counts[DIRECT][2]) if DIRECT in counts else []), sum(c[0] for c in counts.values())


def _hits(docs: DataFrame, known: Filter) -> DataFrame:
    """(doc_id, text_hash, rows, minima, shingles) of the texts with a candidate; equal rows are one, counted."""
    held = docs.sparkSession.sparkContext.broadcast(known)

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            for a, b in runs(texts):
                minima, shingles = held.value.hits(texts[a:b])
                some = [i for i in range(b - a) if len(shingles[i])]
                if not some:
                    continue
                part = frame.iloc[[a + i for i in some]][["doc_id", "text_hash"]].copy()
                part["minima"] = [minima[i].astype(np.int64) for i in some]
                part["shingles"] = [shingles[i].astype(np.int64) for i in some]
                yield part

    kind = docs.schema["doc_id"].dataType.simpleString()
    read = in_small_batches(docs).select(F.col("doc_id").cast("string"), text_or_empty().alias("text")).select("doc_id", F.xxhash64("text").alias("text_hash"), "text")
    found = read.mapInPandas(search, "doc_id string, text_hash long, minima array<long>, shingles array<long>")
    return found.groupBy(F.col("doc_id").cast(kind).alias("doc_id"), "text_hash", "minima", "shingles").agg(F.count("*").alias("rows"))


def _met(hits: DataFrame, items: DataFrame, small: bool) -> DataFrame:
    """The rows of documents (.., key) beside the items that have the key."""
    if small:
        return hits.join(F.broadcast(items), "key")
    salted = items.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return hits.withColumn("salt", F.pmod(F.xxhash64("doc_id", "text_hash"), F.lit(SALTS)).cast("int")).join(salted, ["key", "salt"]).drop("salt")


def found_items(docs: DataFrame, benchmark: DataFrame, *, containment: float = CONTAINMENT, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """One row for each different document and item that it contains: doc_id, text_hash (xxhash64), rows (so many
    documents are equal), item_id, containment."""
    items = cut(item_keys(benchmark))
    known, keys = _filter(items)
    hits, small = cut(_hits(docs, known)), keys <= broadcast_rows
    item, doc = ["item_id", "item_hash"], ["doc_id", "text_hash"]
    shingles = _met(hits.select(*doc, "rows", F.explode("shingles").alias("key")), items.where(F.col("kind") != MINIMUM).select(*item, "n", "kind", "key"), small)
    shared = shingles.groupBy(*doc, *item, "rows", "n", "kind").agg(F.count("*").alias("c")).withColumn("containment", F.col("c").cast("double") / F.col("n")).where(F.col("containment") >= containment)
    minima = _met(hits.select(*doc, F.explode("minima").alias("key")), items.where(F.col("kind") == MINIMUM).select(*item, "key"), small).select(*doc, *item).distinct()
    candidates = minima.toDF("d", "dh", "i", "ih")
    same = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_hash") == F.col("dh")) & F.col("item_id").eqNullSafe(F.col("i")) & (F.col("item_hash") == F.col("ih"))
    regular = shared.where(F.col("kind") == SHINGLE).drop("kind").join(candidates, same, "left_semi")
    return regular.unionByName(shared.where(F.col("kind") == DIRECT).drop("kind")).select(*doc, "rows", "item_id", "containment")


def contained_items(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row for each document and item that it contains: doc_id, item_id, containment."""
    found = found_items(docs, benchmark, **options)
    return found.withColumn("__ev_copy", F.explode(F.sequence(F.lit(1), F.col("rows")))).select("doc_id", "item_id", "containment")


def clean_documents(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that contain no item, columns as given."""
    found = cut(found_items(docs, benchmark, **options).select(F.col("doc_id").alias("__ev_id"), F.col("text_hash").alias("__ev_hash")).distinct())
    if found.count() <= options.get("broadcast_rows", BROADCAST_ROWS):
        found = F.broadcast(found)
    marked = docs.withColumn("__ev_text", F.xxhash64(text_or_empty()))
    same = F.col("doc_id").eqNullSafe(F.col("__ev_id")) & (F.col("__ev_text") == F.col("__ev_hash"))
    return marked.join(found, same, "left_anti").select(*docs.columns)


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}_]+') AS w FROM benchmark
), ds AS (
  SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM d WHERE len(w) > 0
), bs AS (
  SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i+4], ' '))) AS s FROM b WHERE len(w) > 0
), n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id)
SELECT ds.doc_id, bs.item_id, count(*)::DOUBLE / max(n.n) AS containment
FROM ds JOIN bs USING (s) JOIN n ON n.item_id = bs.item_id
GROUP BY ds.doc_id, bs.item_id
HAVING count(*)::DOUBLE / max(n.n) >= 0.8
"""
