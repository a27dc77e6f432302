"""Helpers shared by the text operators: lineage cuts, ordered numbering and ordered neighbours."""

from __future__ import annotations

import tempfile
from bisect import bisect_right
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, as a whole URI; one of our own only where that is unset."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir")
    if not named:
        named = sc.getCheckpointDir() or f"file://{tempfile.mkdtemp(prefix='evidentia-checkpoints-')}"
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    path = sc._jvm.org.apache.hadoop.fs.Path(named)
    whole = path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString().rstrip("/")
    return whole if "://" in whole else whole.replace("file:/", "file:///", 1)


def cut(df: DataFrame) -> DataFrame:
    """The same rows from reliable checkpoint files: later actions neither recompute nor depend on executors' disks."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def exists(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this library has written in the shared folder."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def parallelism(spark: SparkSession) -> int:
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)


#: Rows of a batch that goes to Python; texts are whole, so batches of Spark's default size can be very large.
BATCH_ROWS = 1000
_DEFAULT_BATCH_ROWS = "10000"


def in_small_batches(df: DataFrame) -> DataFrame:
    """The same frame, after a session that still has Spark's default batch size for Python has got a smaller one."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if df.sparkSession.conf.get(key) == _DEFAULT_BATCH_ROWS:
        df.sparkSession.conf.set(key, str(BATCH_ROWS))
    return df


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def numbered(df: DataFrame, order: list, index: str) -> DataFrame:
    """Adds `index`: the row's place from 0 in the order given, without a one-task window.

    Rows are range-partitioned and sorted, each partition numbers its own rows, and the partitions' sizes (one
    small row each) give the offsets. Rows that tie in every order column are numbered in any order.
    """
    spark = df.sparkSession
    parts = (
        df.repartitionByRange(parallelism(spark), *order)
        .sortWithinPartitions(*order)
        .withColumn("__ev_pid", F.spark_partition_id())
        .withColumn("__ev_at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    )
    parts = cut(parts)
    rows, at = [], 0
    for pid, n in sorted(tuple(r) for r in parts.groupBy("__ev_pid").agg(F.count("*")).collect()):
        rows.append((pid, at))
        at += n
    offsets = spark.createDataFrame(rows, "__ev_pid int, __ev_from long")
    out = parts.join(F.broadcast(offsets), "__ev_pid").withColumn(index, F.col("__ev_from") + F.col("__ev_at"))
    return out.drop("__ev_pid", "__ev_at", "__ev_from")


#: Bytes of a block of rows that stand together in an order; keys that are drawn at first to part the blocks, a quarter
#: as many blocks as keys; and keys that are drawn at most, where bytes ask for more blocks than that.
BLOCK_BYTES = 64 << 20
DRAWN_KEYS = 1 << 14
MOST_KEYS = 1 << 18


def with_neighbours(
    df: DataFrame, key: str, size: Column, map_block: Callable, schema: str, *, before: bool = True, wrap: bool = False, ties: list | None = None, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """Runs `map_block` over the rows in ascending order of `key`, dealt into contiguous blocks, a task each.

    Every block also gets a copy of the row that follows its last one (with `wrap`, the order is a ring) and, with
    `before`, of the row before its first one, so that at most two rows per block travel twice. `map_block` takes an
    iterator of frames in which a block's rows stand together: the row before (__ev_role -1), own rows (0) in the
    order of `key` and `ties`, the row after (1); it streams and never holds a block. Rows that share the key of a
    block's first or last row all travel with it, so the row after is the first, and the row before the last, of its
    role. Blocks hold about `block_bytes` by `size`, but are at least as many as shuffle partitions. They begin at
    keys that one pass draws, at most DRAWN_KEYS of them, so that the rows after blocks are known without another
    pass; any draw gives the same result. Where that is too few for the bytes, a second pass draws four keys a block,
    at most MOST_KEYS (with 100 TB, a block has 1.5 GB, which its task streams).
    """
    spark = df.sparkSession
    shared_dir(spark)
    keys = df.select(F.col(key).alias("k"), size.cast("long").alias("size"))

    def draw(n: int) -> list[tuple]:
        parts = keys.groupBy(F.pmod(F.xxhash64("k"), F.lit(n)).alias("b"))
        found = parts.agg(F.max_by("k", F.xxhash64("k", F.lit(1))).alias("k"), F.sum("size").alias("size"), F.min("k").alias("low"))
        return sorted(tuple(r) for r in found.select("k", "size", "low").collect())

    drawn = draw(DRAWN_KEYS)
    first = min((r[2] for r in drawn), default=None)
    total = sum(r[1] for r in drawn)
    wanted = max(parallelism(spark), -(-total // block_bytes))
    if wanted > DRAWN_KEYS // 4:
        wanted = min(wanted, MOST_KEYS // 4)
        drawn = draw(4 * wanted)
    splits, held = [], 0
    for k, bytes_, _ in drawn:
        if held * wanted >= total * (len(splits) + 1) and k > first:
            splits.append(k)
        held += bytes_
    last = len(splits)

    @F.pandas_udf("int")
    def block_of(values: pd.Series) -> pd.Series:
        return pd.Series([bisect_right(splits, v) for v in values], dtype="int32")

    # a split is a key of the table, so the first row of a block is the one "after" the block before it
    after = {k: i for i, k in enumerate(splits)}
    if wrap and drawn:
        after[first] = last
    earlier = {}
    if before:
        ends = sorted(tuple(r) for r in df.select(key).groupBy(block_of(key)).agg(F.max(key)).collect())
        earlier = {k: (b + 1) % (last + 1) for b, k in ends if b < last or wrap}

    @F.pandas_udf("array<struct<__ev_block:int,__ev_role:int>>")
    def places(values: pd.Series) -> pd.Series:
        out = []
        for v in values:
            own = [{"__ev_block": bisect_right(splits, v), "__ev_role": 0}]
            if v in after:
                own.append({"__ev_block": after[v], "__ev_role": 1})
            if v in earlier:
                own.append({"__ev_block": earlier[v], "__ev_role": -1})
            out.append(own)
        return pd.Series(out)

    dealt = df.withColumn("__ev_place", F.explode(places(key))).select("*", "__ev_place.*").drop("__ev_place")
    dealt = dealt.repartitionById(last + 1, F.col("__ev_block")).sortWithinPartitions("__ev_block", "__ev_role", key, *(ties or []))
    return dealt.mapInPandas(map_block, schema)
