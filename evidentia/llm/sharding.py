"""Shards by balanced label propagation: linked documents move towards their neighbours' shards under quotas.

Documents are linked if their texts are equal or share any line of at least `LINE_CHARS` characters. Equal texts are
one node, and a line is a hub between nodes, so a group of any size costs as many links as it has members; lines that
no other node has are dropped before the first round. Each round joins nodes to their hubs: a hub votes for the shard that most of its rows are
in, a node wishes to move to the shard that gets most votes, and a shard takes in so many of those who wish (by a hash
of node and round) as its quota has room for. Only counts by shard reach the driver.

Last, shards are levelled to differ by one row at most (law `rows`): groups of equal texts stay as far as a shard's
even share goes, and single texts, with what a share could not hold, fill the shards in the order of their own.

Cases: a null text counts as no bytes and is equal to other null or empty texts; null and repeated doc_ids stay as
rows; texts are read whole; no rows give no rows; other columns are ignored. Rows that share id and text are
interchangeable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import cut, numbered, text_or_empty

SHARDS = 40
ROUNDS = 4
#: A shard may hold this much more than an even share while nodes move.
SLACK = 1.1
LINE_CHARS = 30
#: Nodes of a hub that meet it in one task, and tasks that a hub's nodes go to before they are counted.
PART, SALTS = 512, 8
_FINE = 1 << 20


def linked(docs: DataFrame) -> DataFrame:
    """doc_id, size, text_crc32, node (of equal texts) and hubs of each row."""
    text = text_or_empty()
    long_lines = F.filter(F.split(text, "\n"), lambda x: F.length(x) >= LINE_CHARS)
    hubs = F.array_distinct(F.transform(long_lines, lambda x: F.xxhash64(x)))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.concat(F.hex(F.xxhash64(text)), F.hex(F.xxhash64(F.lit(11), text))).alias("node"),
        hubs.alias("hubs"),
    )


def propagate(nodes: DataFrame, *, shards: int, rounds: int, slack: float) -> DataFrame:
    """(node, rows, label) from rows (node, rows, hubs): the shard that each node ends in before levelling."""
    links = nodes.select("node", "rows", F.explode("hubs").alias("hub"))
    shared = links.groupBy("hub").agg(F.count("*").alias("n")).where("n > 1").select("hub", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    # a hub's nodes are dealt into parts, so that a line that very many share meets them in as many tasks
    dealt = links.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    links = dealt.join(shared.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["hub", "salt"]).drop("salt")
    links = cut(links.withColumn("part", F.pmod(F.xxhash64("node"), "parts").cast("int")))
    # nodes that share their least hub begin together
    least = links.groupBy("node").agg(F.min("hub").alias("hub"))
    labels = cut(nodes.select("node", "rows").join(least, "node", "left").select("node", "rows", F.pmod(F.xxhash64(F.coalesce(F.col("hub").cast("string"), "node")), F.lit(shards)).cast("int").alias("label")))
    total = labels.agg(F.sum("rows")).first()[0] or 0
    for round_ in range(rounds):
        placed = links.join(labels.select("node", "label"), "node")
        by_shard = placed.groupBy("hub", "parts", "label").agg(F.sum("rows").alias("n"))
        favourite = by_shard.groupBy("hub", "parts").agg(F.max(F.struct("n", F.col("label").alias("to"))).alias("best"))
        favourite = favourite.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "best.*")
        votes = links.join(favourite, ["hub", "part"]).groupBy("node", "to").agg(F.count("*").alias("votes"), F.sum("n").alias("n"))
        wish = votes.groupBy("node").agg(F.max(F.struct("votes", "n", "to")).alias("wish")).select("node", F.col("wish.to").alias("to"))
        wished = cut(labels.join(wish, "node", "left").withColumn("to", F.coalesce("to", "label")))
        load = dict(wished.groupBy("label").agg(F.sum("rows")).collect())
        demand = dict(wished.where("to <> label").groupBy("to").agg(F.sum("rows")).collect())
        if not demand:
            break
        open_ = {s: max(0.0, slack * total / shards - load.get(s, 0)) / d for s, d in demand.items()}
        share = F.element_at(F.create_map(*[F.lit(x) for s, o in open_.items() for x in (s, min(1.0, o))]), F.col("to"))
        drawn = F.pmod(F.xxhash64("node", F.lit(round_)), F.lit(_FINE)) / _FINE
        labels = wished.select("node", "rows", F.when((F.col("to") != F.col("label")) & (drawn < share), F.col("to")).otherwise(F.col("label")).alias("label"))
    return labels.select("node", "rows", "label")


def sharded(docs: DataFrame, *, shards: int = SHARDS, rounds: int = ROUNDS, slack: float = SLACK) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, node, law, shard and slot (its place in the shard from 0)."""
    rows = linked(docs)
    nodes = rows.groupBy("node").agg(F.count("*").alias("rows"), F.any_value("hubs").alias("hubs"))
    labels = propagate(nodes, shards=shards, rounds=rounds, slack=slack)
    group = F.col("rows") > 1
    kept = rows.select("doc_id", "size", "text_crc32", "node").join(labels.withColumn("single", ~group).drop("rows"), "node")
    placed = cut(numbered(kept, ["single", "label", "node", "doc_id"], "place"))
    counts = {(r["single"], r["label"]): r["n"] for r in placed.groupBy("single", "label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    quota = [(k + 1) * total // shards - k * total // shards for k in range(shards)]
    grouped = [counts.get((False, k), 0) for k in range(shards)]
    before, room, filled = [0], [0], [min(g, q) for g, q in zip(grouped, quota, strict=True)]
    for k in range(shards):
        before.append(before[-1] + grouped[k])
        room.append(room[-1] + quota[k] - filled[k])

    def of(values: list[int], at: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v).cast("long") for v in values]), at + 1)

    # groups of equal texts stay where they are as far as the shard's even share goes; all other rows fill the shards
    placed = placed.withColumn("slot", F.col("place") - of(before, F.col("label")))
    stays = ~F.col("single") & (F.col("slot") < of(quota, F.col("label")))
    columns = ["doc_id", "size", "text_crc32", "node", "label"]
    settled = placed.where(stays).select(*columns[:-1], F.col("label").alias("shard"), "slot")
    loose = numbered(placed.where(~stays).select(*columns), ["label", "node", "doc_id"], "k")
    ends = F.array(*[F.lit(v).cast("long") for v in room[1:]])
    loose = loose.withColumn("shard", F.size(F.filter(ends, lambda e: e <= F.col("k"))))
    loose = loose.select(*columns[:-1], "shard", (of(filled, F.col("shard")) + F.col("k") - of(room, F.col("shard"))).alias("slot"))
    return settled.unionByName(loose).withColumn("law", F.lit("rows"))
