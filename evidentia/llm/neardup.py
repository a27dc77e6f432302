"""Near-duplicate classes by ProbMinHash over weighted word shingles, banding and exact verification.

A text is the set of its five-word shingles; a shingle that occurs n times weighs 1 + ln n. Each shingle is a Poisson
process with its weight as the rate, and each arrival goes to a random register; a register keeps the shingle that
arrives first. Arrivals of one text end early, once none can come before the latest of its registers. Two texts agree
in a register with a probability equal to the probability Jaccard similarity of their weights. Where a shingle's counts
differ between two texts, that is less than the Jaccard similarity of the sets, so a text with repeats is signed a
second time with all rates 1, for which both are equal. A text without repeats has the same registers either way.

Registers are joined into bands, and texts that share a band value of either signature are candidates. A link is kept if the exact
Jaccard similarity of the two shingle sets is at least `similarity`; linked texts form classes.

Large buckets cost no quadratic number of rows. All members are first compared with the bucket's least member. Only
in buckets whose other members are then still in different classes, the members are compared with each other, block
against block inside a task, by a matrix product; a block pair returns at most a spanning forest of its links.
Texts with equal shingle sets (so all exact copies) are one node throughout.

Cases: a null text counts as empty; texts without words are near-duplicates only of equal texts; a text of one to
four words is one shingle; texts of any length are taken whole; null and repeated doc_ids stay as rows, and a class
whose doc_ids are all null has a null id; no rows give no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import cut, in_small_batches, text_or_empty
from evidentia.llm.graph import components
from evidentia.llm.words import mix, runs, shingle_hashes, word_hashes

WORDS, SIMILARITY = 5, 0.8
#: A pair of similarity 0.8 misses all bands of rate 1 once in 30,000 times, whatever the counts of its shingles.
BANDS, ROWS = 26, 5
#: Members of a block in block-against-block comparison, and shingles of all of them (8 bytes each).
BLOCK, BLOCK_SHINGLES = 512, 1 << 20
#: Members of a bucket that are compared with its centre in one task.
PART = 512
_STEP = np.uint64(0x9E3779B97F4A7C15)


def weighted_shingles(texts: list[str], k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingle hashes, ascending, and their weights, of each text."""
    hashes, bounds = shingle_hashes(*word_hashes(texts), k)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        found, counts = np.unique(hashes[a:b], return_counts=True)
        yield found, 1 + np.log(counts)


def probminhash(sets: list[tuple[np.ndarray, np.ndarray]], registers: int) -> np.ndarray:
    """A row of `registers` shingle hashes for each weighted set; sets without elements get zeros."""
    n = len(sets)
    sizes = [len(s[0]) for s in sets]
    item, rate = np.concatenate([s[0] for s in sets]), np.concatenate([s[1] for s in sets])
    owner = np.repeat(np.arange(n), sizes)
    first, winner = np.full(n * registers, np.inf), np.zeros(n * registers, np.uint64)
    latest, time, step = np.full(n, np.inf), np.zeros(len(item)), 0
    while len(item):
        step = (step + int(_STEP)) % (1 << 64)
        drawn = mix(item + np.uint64(step))
        time = time - np.log(((drawn >> np.uint64(11)).astype(np.float64) + 1) * 2.0**-53) / rate
        early = time < latest[owner]
        item, rate, owner, time, drawn = item[early], rate[early], owner[early], time[early], drawn[early]
        place = owner * registers + ((mix(drawn) >> np.uint64(32)) * np.uint64(registers) >> np.uint64(32)).astype(np.int64)
        better = np.flatnonzero(time < first[place])
        better = better[np.argsort(-time[better], kind="stable")]  # of several, the earliest is written last
        first[place[better]], winner[place[better]] = time[better], item[better]
        latest = first.reshape(n, registers).max(axis=1)
    return winner.reshape(n, registers)


def band_values(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    values = np.zeros((len(registers), bands), np.uint64)
    for r in range(rows):
        values = mix(values * _STEP + registers[:, r::rows])
    return mix(values + np.arange(bands, dtype=np.uint64) * _STEP).astype(np.int64)


def signatures(docs: DataFrame, *, words: int = WORDS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, text_hash, node (of equal shingle sets), size of the set and distinct band values of each row."""

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            for a, b in runs(texts):
                sets = list(weighted_shingles(texts[a:b], words))
                found = list(band_values(probminhash(sets, bands * rows), bands, rows))
                repeats = [i for i, (_, rate) in enumerate(sets) if (rate > 1).any()]
                if repeats:
                    plain = [(sets[i][0], np.ones(len(sets[i][0]))) for i in repeats]
                    for i, more in zip(repeats, band_values(probminhash(plain, bands * rows), bands, rows), strict=True):
                        found[i] = np.union1d(found[i], more)
                part = frame.iloc[a:b][["doc_id", "text_hash"]].copy()
                part["node"] = [hashlib.md5(b"s" + s.tobytes() if len(s) else b"t" + t.encode("utf-8", "surrogatepass")).digest() for (s, _), t in zip(sets, texts[a:b], strict=True)]
                part["size"] = [len(s) for s, _ in sets]
                part["bands"] = [found[i] if len(s) else [] for i, (s, _) in enumerate(sets)]
                yield part

    read = in_small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).withColumn("text_hash", F.xxhash64("text"))
    return read.select("doc_id", "text_hash", "text").mapInPandas(sign, "doc_id long, text_hash long, node binary, size int, bands array<long>")


def shingle_sets(texts: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of rows (node, text)."""

    def cut_up(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            texts = frame["text"].tolist()
            for a, b in runs(texts):
                yield pd.DataFrame({"node": frame["node"].iloc[a:b].tolist(), "shingles": [s.astype(np.int64) for s, _ in weighted_shingles(texts[a:b], words)]})

    return texts.mapInPandas(cut_up, "node binary, shingles array<long>")


def links_in_block(frame: pd.DataFrame, similarity: float) -> list[tuple[bytes, bytes]]:
    """A spanning forest of the links between members (node, component, shingles) of different components."""
    sets = frame["shingles"].tolist()
    sizes = np.array([len(s) for s in sets], np.float64)
    held, columns, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    rows, many = np.repeat(np.arange(len(sets)), sizes.astype(int)), counts > 1
    names = np.cumsum(many) - 1
    use = many[columns]
    rows, columns = rows[use], names[columns[use]]
    common = np.zeros((len(sets), len(sets)), np.float32)
    order = np.argsort(columns, kind="stable")
    rows, columns, width = rows[order], columns[order], 2048
    for start in range(0, int(many.sum()), width):
        a, b = np.searchsorted(columns, [start, start + width])
        part = np.zeros((len(sets), width), np.float32)
        part[rows[a:b], columns[a:b] - start] = 1
        common += part @ part.T
    near = common >= similarity * (sizes[:, None] + sizes[None, :] - common) - 1e-6
    parent = {c: c for c in frame["component"]}

    def root(c):
        while parent[c] != c:
            parent[c] = c = parent[parent[c]]
        return c

    nodes, comps, found = frame["node"].tolist(), frame["component"].tolist(), []
    for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
        a, b = root(comps[i]), root(comps[j])
        if a != b:
            parent[max(a, b)] = min(a, b)
            found.append((nodes[i], nodes[j]))
    return found


def near_duplicates(docs: DataFrame, *, words: int = WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS, block: int = BLOCK) -> DataFrame:
    """One row per document: doc_id, text_hash (xxhash64), class_id (the least doc_id of its class), class_size and
    kept, true for one row of the class: the one of the least (doc_id, text_hash)."""
    signed = cut(signatures(docs, words=words, bands=bands, rows=rows))
    nodes = cut(signed.where("size > 0").groupBy("node").agg(F.min(F.struct("doc_id", "text_hash")).alias("of"), F.any_value("size").alias("size"), F.any_value("bands").alias("bands")))
    members = nodes.select("node", "size", F.explode("bands").alias("bucket"))
    buckets = members.groupBy("bucket").agg(F.count("*").alias("n"), F.min(F.struct("node", "size")).alias("c")).where("n > 1")
    buckets = buckets.select("bucket", "n", F.col("c.node").alias("centre"), F.col("c.size").alias("centre_size"))
    members = cut(members.join(buckets, "bucket").where("node <> centre"))

    alike = F.least("size", "centre_size") >= similarity * F.greatest("size", "centre_size")
    pairs = members.where(alike).groupBy("centre", "node").agg(F.max("n").alias("n"))
    pairs = cut(pairs.select("centre", "node", F.ceil(F.col("n") / PART).cast("int").alias("parts")))
    wanted = members.select("node").union(members.select("centre")).distinct()
    source = nodes.join(wanted, "node").select("node", "of.doc_id", "of.text_hash")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), text_or_empty().alias("text"))
    texts = texts.join(source, texts["doc"].eqNullSafe(source["doc_id"]) & (F.xxhash64(texts["text"]) == source["text_hash"])).select("node", "text")
    sets = cut(shingle_sets(texts, words).dropDuplicates(["node"]))

    common = F.size(F.array_intersect("x.shingles", "y.shingles"))
    of_centres = sets.withColumnRenamed("node", "centre")
    few = pairs.where("parts = 1").join(of_centres, "centre").select("centre", "node", "shingles")
    # the set of a centre with very many pairs goes to as many tasks as they ask for
    many = pairs.where("parts > 1").withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int"))
    spread = many.select("centre", "parts").distinct().withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    many = many.join(spread.join(of_centres, "centre"), ["centre", "parts", "part"]).select("centre", "node", "shingles")
    tested = few.union(many).alias("x").join(sets.alias("y"), "node")
    links = tested.where(common >= similarity * (F.size("x.shingles") + F.size("y.shingles") - common) - 1e-6).select(F.col("centre").alias("a"), F.col("node").alias("b"))
    links = cut(links)
    classes = components(links)

    more = cut(_links_beyond_centres(members, sets, classes, similarity, block))
    if not more.isEmpty():
        classes = components(links.union(more))
    labelled = signed.select("doc_id", "text_hash", "node").join(classes, "node", "left").withColumn("label", F.coalesce("component", "node"))
    # written, so that the join below reads both sides by exchanges that Spark can split where a class is large
    per_class = cut(labelled.groupBy("label").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"), F.min(F.struct("doc_id", "text_hash")).alias("first")))
    return labelled.join(per_class, "label").select("doc_id", "text_hash", "class_id", "class_size", F.struct("doc_id", "text_hash").eqNullSafe(F.col("first")).alias("kept"))


def _links_beyond_centres(members: DataFrame, sets: DataFrame, classes: DataFrame, similarity: float, block: int) -> DataFrame:
    """Links between members of a bucket other than its centre, where these are still in different components."""
    placed = members.join(classes, "node", "left").select("bucket", "node", "size", F.coalesce("component", "node").alias("component"))
    open_ = (
        placed.groupBy("bucket")
        .agg(F.count("*").alias("m"), F.sum("size").alias("shingles"), F.min("component").alias("low"), F.max("component").alias("high"), F.sum(F.shiftright(F.xxhash64("node"), 20)).alias("s"), F.sum(F.shiftright(F.xxhash64("node", F.lit(1)), 20)).alias("t"))
        .where("low <> high")
    )
    # many bands give the same members; each set of members is compared once
    once = open_.groupBy("m", "s", "t").agg(F.min("bucket").alias("bucket"), F.any_value("shingles").alias("shingles"))
    blocks = F.greatest(F.ceil(F.col("m") / block), F.ceil(F.col("shingles") / BLOCK_SHINGLES)).cast("int")
    rows = placed.join(once.select("bucket", "m", "shingles"), "bucket").withColumn("g", blocks).withColumn("own", F.pmod(F.xxhash64("node", F.lit(5)), F.col("g")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("g") - 1)))
    rows = rows.select("bucket", F.least("own", "other").alias("p"), F.greatest("own", "other").alias("q"), "node", "component").join(sets, "node")

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(links_in_block(frame, similarity), columns=["a", "b"])

    return rows.groupBy("bucket", "p", "q").applyInPandas(compare, "a binary, b binary")


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The documents without near-duplicates: of each class the row of the least (doc_id, text_hash), columns as given."""
    kept = near_duplicates(docs, **options).where("kept").groupBy(F.col("doc_id").alias("__ev_id"), F.col("text_hash").alias("__ev_hash")).agg(F.count("*").alias("__ev_rows"))
    kept = cut(kept)
    docs = docs.withColumn("__ev_row_hash", F.xxhash64(text_or_empty()))
    joined = docs.join(kept, docs["doc_id"].cast("long").eqNullSafe(F.col("__ev_id")) & (F.col("__ev_row_hash") == F.col("__ev_hash")), "left_semi")
    if not kept.where("__ev_rows > 1").isEmpty():  # rows that repeat both doc_id and text are one document
        joined = joined.dropDuplicates(["doc_id", "__ev_row_hash"])
    return joined.drop("__ev_row_hash")
