"""Progress of runs from log lines, finished files and status events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.functions.extract import progress


def throughput(df: DataFrame, keys: Sequence[str], at: str, total: int | Column, newest: int = 50) -> DataFrame:
    """done, rate per second over the newest completions, and the seconds that the rest will take."""
    w = Window.partitionBy(*keys).orderBy(F.desc(at))
    recent = df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= newest)
    micros = F.unix_micros(F.col(at).cast("timestamp"))
    span = (F.max(micros) - F.min(micros)) / 1e6
    rate = recent.groupBy(*keys).agg(F.try_divide(F.count("*") - 1, span).alias("rate"))
    done = df.groupBy(*keys).agg(F.count("*").alias("done"))
    total = F.lit(total) if isinstance(total, int) else total
    left = F.greatest(total - F.col("done"), F.lit(0))
    return done.join(rate, list(keys)).withColumn("eta_seconds", F.try_divide(left, F.col("rate")))


def latest_status(df: DataFrame, key: str, at: str, status: str) -> DataFrame:
    """The newest status of each key; error outlives what comes at the same time, then done, then running."""
    rank = F.when(F.col(status) == "error", 2).when(F.col(status) == "done", 1).otherwise(0)
    return df.groupBy(key).agg(F.max_by(status, F.struct(at, rank)).alias(status), F.max(at).alias(at))


def run_state(status: Column, finished: Column, failed: Column) -> Column:
    """running, done or error of a run from what is known of its process and its files."""
    return F.when(failed, "error").when(finished, "done").when(F.coalesce(status, F.lit("")) == "running", "running").otherwise("waiting")


def parsed_log(lines: DataFrame, text: str = "value") -> DataFrame:
    """Lines of a training log with step, total, loss, elapsed and remaining seconds."""
    return lines.withColumn("p", progress(F.col(text))).select(*lines.columns, "p.*")


def newest_points(df: DataFrame, keys: Sequence[str], at: str, n: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(at))
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= n).drop("__rn")


def unfinished(tasks: DataFrame, outputs: DataFrame, key: str) -> DataFrame:
    """Tasks without a non-empty output."""
    return tasks.join(outputs.where(F.col("length") > 0).select(key), key, "left_anti")
