"""The trie of conversations' prefixes, with subtree sums by heavy-path decomposition.

A conversation's turns are numbered in their order, rebuilt conversations are laid out turn by turn, and each prefix
gets a name: its length and a rolling hash of its turns' digests modulo the prime 2**127 - 1. Rolling hashes of
neighbouring stretches can be joined, so that a conversation of any length is hashed in several tasks (`scan.py`). A
node is a group of equal names.

Every node chooses the child with most members (the smaller conv_id in a tie); these heavy edges make paths. A light
edge at least halves the members, so no root path crosses more light edges than the logarithm of the conversations.
A node's path and its level (the light edges above it) come from a running value along any conversation through it. The
paths' totals then go up in rounds, deepest level first: a path's total is what its nodes have plus the totals of the
light paths that hang on them. Last, one running sum from each path's end to its top gives all subtree sums at once.

Digests of the members that end at a node are taken over a stream of their ids in order: ranges of (node, id) first
write chunks of ids, and a node's chunks are hashed one after another, so no task holds a node's ids.

Cases: rows without a conv_id belong to no conversation and are left out; a null role or text is empty; a null turn
comes first; turns that tie are ordered by the digest of their role and text; rows that repeat are turns of their own;
c % 20 of a negative id is taken from 0 to 19; texts are read whole; a conversation of no turns is a member of the
root; no conversations give no nodes, not even a root; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import cut, parallelism
from evidentia.llm.scan import running

#: Conversations of a family of this many ids begin with turns of its first; at most this many turns less one.
FAMILY, HEADS = 20, 4
_PRIME = (1 << 127) - 1
_BASE = int.from_bytes(hashlib.sha256(b"prefix names").digest()[:15], "big")
#: Ids in a chunk of a node's members.
CHUNK = 4096
_EMPTY = hashlib.sha256(b"").hexdigest()


def _name(value: tuple[int, int]) -> bytes:
    return value[0].to_bytes(4, "big") + value[1].to_bytes(16, "big")


def ranked(conversations: DataFrame) -> DataFrame:
    """(conv_id, rank, digest, words): every turn with its place from 1 in its conversation."""
    role, text = F.coalesce(F.col("role"), F.lit("")), F.coalesce(F.col("text"), F.lit(""))
    digest = F.unhex(F.substring(F.sha2(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 32))
    turns = conversations.where("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), digest.alias("digest"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long").alias("words")
    )
    return running(
        turns, "conv_id", [F.col("turn").asc_nulls_first(), "digest"], [], zero=0, step=lambda v, _: v + 1, join=lambda a, b: a + b, emit=lambda _, v: (v,), out={"rank": "long"}
    ).drop("turn")


def heads_of(conv_id: Column) -> Column:
    """The number of turns that a conversation takes from the first of its family."""
    return F.crc32(conv_id.cast("string").cast("binary")) % HEADS


def rebuilt(turns: DataFrame) -> DataFrame:
    """(conv_id, part, place, digest, words): rebuilt conversations, each with a row without digest as its beginning."""
    turns = cut(turns)
    each = turns.select("conv_id").distinct()
    begin = each.select("conv_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("digest"), F.lit(0).cast("long").alias("words"))
    first = turns.where((F.col("rank") < HEADS) & (F.pmod("conv_id", F.lit(FAMILY)) == 0)).withColumnRenamed("conv_id", "first")
    taken = each.withColumn("first", F.col("conv_id") - F.pmod("conv_id", F.lit(FAMILY))).join(first, "first").where(F.col("rank") <= heads_of(F.col("conv_id")))
    own = turns.where(F.col("rank") > heads_of(F.col("conv_id")))
    parts = [begin] + [p.select("conv_id", F.lit(i).alias("part"), F.col("rank").alias("place"), "digest", "words") for i, p in ((1, taken), (2, own))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def prefixes(turns: DataFrame) -> DataFrame:
    """(conv_id, depth, node, parent, words): a row per prefix of each conversation, the empty one included."""

    def step(value: tuple[int, int], row: tuple) -> tuple[int, int]:
        if row[0] is None:
            return value
        return value[0] + 1, (value[1] * _BASE + int.from_bytes(row[0], "big")) % _PRIME

    def join(a: tuple[int, int], b: tuple[int, int]) -> tuple[int, int]:
        return a[0] + b[0], (a[1] * pow(_BASE, b[0], _PRIME) + b[1]) % _PRIME

    named = running(
        turns, "conv_id", ["part", "place"], ["digest"], zero=(0, 0), step=step, join=join,
        emit=lambda a, b: (b[0], _name(b), None if b[0] == 0 else _name(a)), out={"depth": "long", "node": "binary", "parent": "binary"},
    )
    return named.select("conv_id", "depth", "node", "parent", "words")


def _paths(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, path, level, above, parent_conv_id) of all nodes: a path is named by its top, level counts the light edges
    above it, and above is the parent's path. The parent is the row before in any conversation through the node."""
    marks = nodes.select("node", F.col("conv_id").alias("owner"), "light")
    marked = rows.select("conv_id", "depth", "node").join(marks, "node")
    walked = running(
        marked, "conv_id", ["depth"], ["node", "light", "owner"], zero=(None, 0, None),
        step=lambda v, r: (r[0], v[1] + 1, r[2]) if r[1] else (v[0], v[1], r[2]),
        join=lambda a, b: (b[0] or a[0], a[1] + b[1], a[2] if b[2] is None else b[2]),
        emit=lambda a, b: (b[0], b[1], a[0], a[2]), out={"path": "binary", "level": "int", "above": "binary", "parent_conv_id": "long"},
    )
    return walked.where("conv_id = owner").select("node", "path", "level", "above", "parent_conv_id")


def _totals(nodes: DataFrame) -> DataFrame:
    """(path, parent, saved, leaves): what each path and all that hangs on it have, and the node that it hangs on."""
    sums = nodes.groupBy("path", "level").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"))
    paths = cut(sums.join(nodes.where("node = path").select("path", "parent", "above"), "path"))
    deepest = paths.agg(F.max("level")).first()[0] or 0
    done = below = None
    for level in range(deepest, 0, -1):
        here = paths.where(F.col("level") == level)
        if below is not None:
            hung = below.groupBy(F.col("above").alias("path")).agg(F.sum("saved").alias("more"), F.sum("leaves").alias("more_leaves"))
            here = here.join(hung, "path", "left").select(
                "path", "level", (F.col("saved") + F.coalesce("more", F.lit(0))).alias("saved"), (F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).alias("leaves"), "parent", "above"
            )
        below = cut(here.select("path", "level", "saved", "leaves", "parent", "above"))
        done = below if done is None else done.unionByName(below)
    return paths if done is None else done


def trie(turns: DataFrame) -> DataFrame:
    """A row per node: node, conv_id, depth, parent, parent_conv_id, n_convs, words, n_children, n_leaves, saved_tokens
    and ends_sha256."""
    rows = cut(prefixes(turns))
    nodes = rows.groupBy("node").agg(F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"), F.max("parent").alias("parent"), F.count("*").alias("n_convs"), F.max("words").alias("words"))
    nodes = cut(nodes)
    largest = F.max(F.struct("n_convs", (-F.col("conv_id")).alias("c"), "node"))["node"]
    children = cut(nodes.where("parent IS NOT NULL").groupBy("parent").agg(F.count("*").alias("n_children"), largest.alias("heavy")))
    nodes = nodes.join(children.select(F.col("parent").alias("node"), "n_children"), "node", "left").join(children.select(F.col("heavy").alias("node"), F.lit(False).alias("light")), "node", "left")
    nodes = nodes.select(
        "node", "conv_id", "depth", "parent", "n_convs", "words", F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("light", F.lit(True)).alias("light"),
        ((F.col("n_convs") - 1) * F.col("words")).alias("saved"), F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaves"),
    )
    nodes = cut(nodes)
    nodes = cut(nodes.join(_paths(rows, nodes), "node"))
    hung = _totals(nodes).where("parent IS NOT NULL").groupBy(F.col("parent").alias("node")).agg(F.sum("saved").alias("more"), F.sum("leaves").alias("more_leaves"))
    whole = nodes.join(hung, "node", "left").withColumns({"saved": F.col("saved") + F.coalesce("more", F.lit(0)), "leaves": F.col("leaves") + F.coalesce("more_leaves", F.lit(0))})
    whole = running(
        whole.select("node", "path", "depth", "saved", "leaves"), "path", [F.col("depth").desc()], ["saved", "leaves"], zero=(0, 0), step=lambda v, r: (v[0] + r[0], v[1] + r[1]),
        join=lambda a, b: (a[0] + b[0], a[1] + b[1]), emit=lambda _, v: v, out={"saved_tokens": "long", "n_leaves": "long"},
    )
    whole = nodes.select("node", "conv_id", "depth", "parent", "parent_conv_id", "n_convs", "words", "n_children").join(whole.select("node", "saved_tokens", "n_leaves"), "node")
    ends = rows.groupBy("conv_id").agg(F.max_by("node", "depth").alias("node"))
    return whole.join(_end_digests(ends), "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(_EMPTY)))


def _end_digests(ends: DataFrame) -> DataFrame:
    """(node, ends_sha256) from (conv_id, node): the digest of each node's ids in ascending order, joined by commas."""

    def chunks(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, ids = None, []
        for frame in frames:
            out = []
            for n, c in zip(frame["node"], frame["conv_id"], strict=True):
                if ids and (n != node or len(ids) == CHUNK):
                    out.append((node, ids[0], ",".join(map(str, ids))))
                    ids = []
                node = n
                ids.append(c)
            yield pd.DataFrame(out, columns=["node", "least", "ids"])
        if ids:
            yield pd.DataFrame([(node, ids[0], ",".join(map(str, ids)))], columns=["node", "least", "ids"])

    def digests(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, state = None, None
        for frame in frames:
            out = []
            for n, ids in zip(frame["node"], frame["ids"], strict=True):
                if state is None or n != node:
                    if state is not None:
                        out.append((node, state.hexdigest()))
                    node, state = n, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            yield pd.DataFrame(out, columns=["node", "ends_sha256"])
        if state is not None:
            yield pd.DataFrame([(node, state.hexdigest())], columns=["node", "ends_sha256"])

    n = parallelism(ends.sparkSession)
    chunked = ends.repartitionByRange(n, "node", "conv_id").sortWithinPartitions("node", "conv_id").mapInPandas(chunks, "node binary, least long, ids string")
    return chunked.repartition(n, "node").sortWithinPartitions("node", "least").mapInPandas(digests, "node binary, ends_sha256 string")


def digest(nodes: DataFrame) -> DataFrame:
    """The nodes without names and words."""
    return nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


#: The same in SQL: prefixes are lists of whole turns, and subtree sums join each node to all of its prefixes.
ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS rank
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, conv_id - ((conv_id % 20) + 20) % 20 AS base, xor(list_reduce(list_concat([4294967295::BIGINT], [ascii(b)::BIGINT FOR b IN string_split(conv_id::VARCHAR, '')]),
    lambda a, b: list_reduce([xor(a, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, y: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295) % 4 AS heads
  FROM (SELECT DISTINCT conv_id FROM t)
), laid AS (
  SELECT c.conv_id, 1 AS part, t.rank, t.role, t.text FROM c JOIN t ON t.conv_id = c.base AND t.rank <= c.heads
  UNION ALL
  SELECT c.conv_id, 2, t.rank, t.role, t.text FROM c JOIN t ON t.conv_id = c.conv_id AND t.rank > c.heads
), whole AS (
  SELECT c.conv_id, coalesce(list({'role': l.role, 'text': l.text} ORDER BY l.part, l.rank) FILTER (WHERE l.conv_id IS NOT NULL), []) AS turns
  FROM c LEFT JOIN laid l ON l.conv_id = c.conv_id GROUP BY c.conv_id
), prefixes AS (
  SELECT conv_id, len(turns) AS n, d AS depth, list_slice(turns, 1, d) AS node FROM (SELECT *, unnest(range(0, len(turns) + 1)) AS d FROM whole)
), nodes AS MATERIALIZED (
  SELECT node, min(conv_id) AS conv_id, any_value(depth) AS depth, count(*) AS n_convs,
    (count(*) - 1) * coalesce(len(regexp_extract_all(any_value(node[depth].text), '[^\x20\x09-\x0D]+')), 0) AS saved,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = depth), '')) AS ends_sha256
  FROM prefixes GROUP BY node
), children AS MATERIALIZED (
  SELECT list_slice(node, 1, depth - 1) AS parent, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1
), below AS (
  SELECT list_slice(n.node, 1, d) AS node, sum(n.saved) AS saved, count(*) FILTER (WHERE c.parent IS NULL) AS leaves
  FROM (SELECT *, unnest(range(0, depth + 1)) AS d FROM nodes) n LEFT JOIN children c ON c.parent = n.node GROUP BY 1
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n_children, 0) AS n_children, b.leaves AS n_leaves,
  b.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN below b ON b.node = n.node LEFT JOIN children c ON c.parent = n.node
LEFT JOIN nodes p ON n.depth > 0 AND p.node = list_slice(n.node, 1, n.depth - 1)
"""
