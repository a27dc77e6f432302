"""Text lines with their numbers, and what needs numbers: errors that name a line, and files paired line by line.

Lines are numbered without a shuffle of the text. A first pass counts the lines of each split of a file and writes a
row per split; the counts of the splits before it are a split's offset, and a line's place in its split is its row's
place in the task that reads it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.streaming.monitor import checkpoint_folder

#: Splits up to which their table is sent to all tasks; more of them are joined like any table.
BROADCAST_SPLITS = 1_000_000
_SPLIT = ["path", "split", "task"]


def _rows(spark: SparkSession, path: str, skip_blank: bool) -> DataFrame:
    """path, split (its first byte), task and row (a line's place in its task's rows) and value of each line."""
    rows = spark.read.option("recursiveFileLookup", True).text(path)
    rows = rows.select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), "value")
    rows = rows.where(F.col("value").rlike(r"\S")) if skip_blank else rows
    rows = rows.withColumn("row", F.monotonically_increasing_id())
    return rows.withColumn("task", F.shiftright("row", 33))


def _splits(spark: SparkSession, rows: DataFrame, bad: Column) -> DataFrame:
    """A row per split: before (lines of all splits before it), in_file (those of its file), first and bad (rows)."""
    folder = f"{checkpoint_folder(spark)}-{uuid.uuid4().hex[:8]}"
    counted = rows.groupBy(*_SPLIT).agg(F.count("*").alias("n"), F.min("row").alias("first"), F.min(F.when(bad, F.col("row"))).alias("bad"))
    counted.write.parquet(folder)
    counted = spark.read.schema("path string, split long, task long, n long, first long, bad long").parquet(folder)
    earlier = Window.orderBy("path", "split").rowsBetween(Window.unboundedPreceding, -1)
    placed = counted.withColumn("before", F.coalesce(F.sum("n").over(earlier), F.lit(0)))
    return placed.withColumn("in_file", F.col("before") - F.min("before").over(Window.partitionBy("path")))


def _numbered(spark: SparkSession, path: str, skip_blank: bool, bad: Column) -> tuple[DataFrame, DataFrame]:
    rows = _rows(spark, path, skip_blank)
    splits = _splits(spark, rows, bad)
    side = splits.select(*_SPLIT, "first", "before", "in_file")
    side = F.broadcast(side) if splits.count() <= BROADCAST_SPLITS else side
    found = rows.join(side, _SPLIT, "left")
    # files that change between the passes are an error, not other numbers
    at = F.when(F.col("first").isNull(), F.raise_error(F.concat(F.lit("files have changed: "), "path")).cast("long")).otherwise(F.col("row") - F.col("first") + 1)
    return found.select("path", (F.col("in_file") + at).alias("line"), (F.col("before") + at).alias("place"), "value"), splits


def numbered_lines(spark: SparkSession, path: str, *, skip_blank: bool = False) -> DataFrame:
    """path, line (from 1 in its file), place (from 1 over all files in the order of their paths) and value.

    With `skip_blank`, lines of white space alone are left out and not counted."""
    return _numbered(spark, path, skip_blank, F.lit(False))[0]


def numbered_json_lines(spark: SparkSession, path: str, schema: str, *, strict: bool = True) -> DataFrame:
    """path, line and the schema's columns of files of JSON lines, without blank lines.

    strict: raises ValueError with path:line of the first line that holds no object of the schema's kinds; else such
    lines are dropped."""
    fields = T._parse_datatype_string(schema)
    parsed = F.from_json("value", T.StructType([*fields.fields, T.StructField("__bad", T.StringType())]), {"columnNameOfCorruptRecord": "__bad"})
    wrong = F.col("value").rlike(r"\S") & parsed["__bad"].isNotNull()
    lines, splits = _numbered(spark, path, False, wrong if strict else F.lit(False))
    if strict:
        first = splits.where("bad is not null").select("path", (F.col("in_file") + F.col("bad") - F.col("first") + 1).alias("line")).orderBy("path", "line").first()
        if first:
            raise ValueError(f"no JSON object at {first.path}:{first.line}")
    rows = lines.where(F.col("value").rlike(r"\S")).withColumn("__r", parsed)
    return rows.where("__r.__bad is null").select("path", "line", *[F.col("__r")[f.name].alias(f.name) for f in fields.fields])


def paired_lines(spark: SparkSession, left: str, right: str, *, strict: bool = False) -> DataFrame:
    """place, left and right: the lines of two sets of files side by side, blank lines not counted.

    Without `strict`, what one side has more is left out, as a warning's count of both would tell; with it, ValueError."""
    sides = [_numbered(spark, path, True, F.lit(False)) for path in (left, right)]
    if strict:
        n, m = ((s.agg(F.sum("n")).first()[0] or 0) for _, s in sides)
        if n != m:
            raise ValueError(f"{left} has {n} lines, {right} has {m}")
    a, b = (s.select("place", F.col("value").alias(name)) for (s, _), name in zip(sides, ("left", "right"), strict=True))
    return a.join(b, "place")
