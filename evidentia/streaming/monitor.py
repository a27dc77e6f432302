"""Structured Streaming: log progress, latest status by key, throughput, and windows over event time."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from evidentia.operators.progress import latest_status, parsed_log
from evidentia.sources.tail import tailed_lines


def checkpoint_folder(spark: SparkSession) -> str:
    """A new folder for a query's progress under the cluster's checkpoint folder, if it names one."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.mkdtemp(prefix="evidentia-stream-")
    return f"{named.rstrip('/')}/stream-{uuid.uuid4().hex}"


def stream_parquet(spark: SparkSession, path: str, schema: T.StructType, files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).parquet(path)


def stream_log(spark: SparkSession, folder: str, suffix: str = "") -> DataFrame:
    """Parsed progress of growing log files: each line once, as soon as it has ended; see `tailed_lines`."""
    return parsed_log(tailed_lines(spark, folder, suffix).select("value")).where("step is not null or total is not null or loss is not null")


def counts_by_key(events: DataFrame, key: str) -> DataFrame:
    """Running counts, first and last time of each key."""
    return events.groupBy(key).agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


def _watermarked(events: DataFrame, at: str, late: str) -> tuple[DataFrame, str]:
    """Events with a watermark, which needs times with a zone (the session's), and the kind of time that they have."""
    return events.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late), dict(events.dtypes)[at]


def tumbling(events: DataFrame, at: str, width: str, late: str, keys: list[str]) -> DataFrame:
    """Counts by event-time windows with a watermark for late rows."""
    marked, kind = _watermarked(events, at, late)
    windowed = marked.groupBy(F.window(at, width).alias("w"), *keys).agg(F.count("*").alias("n"))
    return windowed.select(F.col("w.start").cast(kind).alias("window_start"), *keys, "n")


def sessions(events: DataFrame, at: str, gap: str, late: str, key: str) -> DataFrame:
    """Sessions of a key that a gap ends."""
    marked, kind = _watermarked(events, at, late)
    found = marked.groupBy(F.session_window(at, gap).alias("w"), key).agg(F.count("*").alias("n"))
    return found.select(key, F.col("w.start").cast(kind).alias("session_start"), F.col("w.end").cast(kind).alias("session_end"), "n")


def upsert_status(updates: DataFrame, table: str, key: str, at: str, status: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends each batch's latest status of its keys to a table (or a folder of Parquet files), of which `current_status` reads the latest of all.

    Nothing is overwritten, so a stop at any moment loses no row, and replaying a batch changes no result."""

    def merge(batch: DataFrame, batch_id: int) -> None:
        new = latest_status(batch.select(key, at, status), key, at, status).write.mode("append")
        new.parquet(table) if "/" in table else new.saveAsTable(table)

    return updates.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def current_status(spark: SparkSession, table: str, key: str, at: str, status: str) -> DataFrame:
    """The latest status of each key."""
    held = spark.read.parquet(table) if "/" in table else spark.read.table(table)
    return latest_status(held.select(key, at, status), key, at, status)


def drained(df: DataFrame, name: str, checkpoint: str, mode: str = "complete", act: Callable[[StreamingQuery], None] | None = None, cool_down: str | None = None) -> DataFrame:
    """Runs a stream over all that is there now and reads the result from files beside its checkpoint.

    In complete mode the last batch's files are the result, else those of all batches; a batch that is written again
    replaces its own. With `cool_down` (such as 2 seconds) the stream goes on, a batch at most so often, until `act`
    stops it."""
    folder = f"{checkpoint}-result"

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/batch={batch_id}")

    started = df.writeStream.foreachBatch(keep).queryName(name).outputMode(mode).option("checkpointLocation", checkpoint)
    query = started.trigger(**({"processingTime": cool_down} if cool_down else {"availableNow": True})).start()
    if act:
        act(query)
    query.awaitTermination()
    result = df.sparkSession.read.schema(T.StructType([*df.schema.fields, T.StructField("batch", T.LongType())])).parquet(folder)
    if mode == "complete":
        result = result.join(F.broadcast(result.agg(F.max("batch").alias("__last"))), F.col("batch") == F.col("__last")).drop("__last")
    return result.drop("batch")
