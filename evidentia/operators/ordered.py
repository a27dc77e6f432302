"""Running sums in the order of a value, without one task per group or one task for all."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.streaming.monitor import checkpoint_folder

def same_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], prefix: str = "__k_") -> tuple[DataFrame, Column]:
    """The right side with its keys renamed, and the condition that all keys are equal, NULL being equal to NULL."""
    right = right.withColumnsRenamed({k: prefix + k for k in keys})
    return right, reduce(lambda a, b: a & b, [left[k].eqNullSafe(right[prefix + k]) for k in keys])


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys that may be NULL, a NULL being equal to a NULL; the right side brings its other columns."""
    right, same = same_keys(left, right, keys)
    return left.join(right, same).drop(*[f"__k_{k}" for k in keys])


def in_ranges(df: DataFrame, keys: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The rows with `__range`, the number of the range of (keys, order) that they stand in; written once.

    Spark cuts the ranges from a sample, as many as shuffle partitions, so that they grow with neither the data's skew
    over groups nor over values; rows that are equal in all of them stand in one."""
    spark = df.sparkSession
    folder = f"{checkpoint_folder(spark)}-ranges"
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    df.repartitionByRange(n, *keys, *order).withColumn("__range", F.spark_partition_id()).write.parquet(folder)
    return spark.read.schema(T.StructType([*df.schema.fields, T.StructField("__range", T.IntegerType())])).parquet(folder)


def _with_offsets(placed: DataFrame, keys: Sequence[str], sums: dict[str, Column]) -> DataFrame:
    """Adds __<name>_low, the sum over lower ranges of the group, and <name>_all, the group's, of each of `sums`."""
    by_range = placed.groupBy(*keys, "__range").agg(*[F.sum(c).alias(n) for n, c in sums.items()])
    group = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    below = group.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_range.select(*keys, "__range", *[F.coalesce(F.sum(n).over(below), F.lit(0)).alias(f"__{n}_low") for n in sums], *[F.sum(n).over(group).alias(f"{n}_all") for n in sums])
    return join_same(placed, offsets, [*keys, "__range"])


def running_sums(spread: DataFrame, keys: Sequence[str], value: str, counts: Sequence[str]) -> DataFrame:
    """For rows (keys, value, counts) with one row per value of a group: <count>_before, the sum over lower values of
    the group, and <count>_all, the group's sum.

    Rows are cut into ranges of (keys, value). Sums by range (a row for each group and range that it has) give what lies
    below a range; within a range a window adds the rest."""
    placed = _with_offsets(in_ranges(spread, keys, [value]), keys, {c: F.col(c) for c in counts})
    inside = Window.partitionBy(*keys, "__range").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    before = [(F.col(f"__{c}_low") + F.coalesce(F.sum(c).over(inside), F.lit(0))).alias(f"{c}_before") for c in counts]
    return placed.select(*spread.columns, *before, *[F.col(f"{c}_all") for c in counts])


def row_numbers(df: DataFrame, keys: Sequence[str], order: Sequence[Column], name: str) -> DataFrame:
    """Adds the row's number in its group, as row_number does, with a group of any size in as many tasks as it has
    ranges. Rows that tie in `order` must not matter to the caller, as with row_number."""
    placed = _with_offsets(in_ranges(df, keys, order), keys, {"__one": F.lit(1)})
    inside = Window.partitionBy(*keys, "__range").orderBy(*order)
    return placed.select(*df.columns, (F.col("____one_low") + F.row_number().over(inside)).alias(name))
