"""Queries of numbered lines, followed logs, timed statuses and event-time windows, each with the same query in SQL."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.functions import extract as X
from evidentia.queries import _query, _t
from evidentia.record_queries import _folder
from evidentia.sources import lines, tail
from evidentia.streaming import monitor, status


@_query("""SELECT o_orderkey, o_orderpriority, row_number() OVER (PARTITION BY o_orderkey % 16 ORDER BY o_orderkey) AS line FROM orders""")
def numbered_json(spark, sf_dir):
    """JSON lines of sixteen files with the number of each line in its file."""
    folder = _folder(spark)
    rows = _t(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority", (F.col("o_orderkey") % 16).alias("part"))
    rows.repartition(16, "part").sortWithinPartitions("part", "o_orderkey").write.partitionBy("part").json(folder)
    return lines.numbered_json_lines(spark, folder, "o_orderkey bigint, o_orderpriority string").drop("path")


@_query("SELECT o_orderkey % 4 AS part, count(*) AS kept, max(o_orderkey) AS last FROM orders WHERE o_custkey % 5 <> 0 GROUP BY 1")
def numbered_json_tolerant(spark, sf_dir):
    """Lines of which every fifth customer's is cut; the rest is read."""
    folder = _folder(spark)
    line = F.concat(F.lit('{"k": '), F.col("o_orderkey"), F.when(F.col("o_custkey") % 5 == 0, "").otherwise("}"))
    _t(spark, sf_dir, "orders").select(line.alias("value")).write.text(folder)
    read = lines.numbered_json_lines(spark, folder, "k bigint", strict=False)
    return read.groupBy((F.col("k") % 4).alias("part")).agg(F.count("*").alias("kept"), F.max("k").alias("last"))


@_query("""WITH a AS (SELECT 'p' || o_orderkey AS l, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders),
b AS (SELECT 'm' || c_custkey AS r, row_number() OVER (ORDER BY c_custkey DESC) AS place FROM customer)
SELECT place, l AS left, r AS right FROM a JOIN b USING (place)""")
def paired_files(spark, sf_dir):
    """Two sets of files of different lengths, with blank lines, side by side in the order of their lines."""
    folder = _folder(spark)
    left = _t(spark, sf_dir, "orders").repartitionByRange(8, "o_orderkey").sortWithinPartitions("o_orderkey")
    left.select(F.concat(F.lit("p"), "o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, "\n").otherwise(""))).write.text(f"{folder}/left")
    right = _t(spark, sf_dir, "customer").repartitionByRange(3, F.desc("c_custkey")).sortWithinPartitions(F.desc("c_custkey"))
    right.select(F.concat(F.lit("m"), "c_custkey")).write.text(f"{folder}/right")
    return lines.paired_lines(spark, f"{folder}/left", f"{folder}/right")


def _append(rows: DataFrame, folder: str, begin: str, end: str) -> None:
    """Appends each file's values (file, at, value) to it, a task a file, between `begin` and `end`."""

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(folder)
        open_, n = {}, 0
        for frame in frames:
            for name, values in frame.groupby("file", sort=False)["value"]:
                first = name not in open_
                if first:
                    store.create_dir(root, recursive=True)
                    open_[name] = store.open_append_stream(f"{root}/{name}")
                open_[name].write(((begin if first else "\n") + "\n".join(values)).encode())
                n += len(values)
        for out in open_.values():
            out.write(end.encode())
            out.close()
        yield pd.DataFrame({"n": [n]})

    rows.repartition(8, "file").sortWithinPartitions("file", "at").mapInPandas(write, "n long").agg(F.sum("n")).collect()


@_query("SELECT event_id, (event_id % 100 + 1)::BIGINT AS step, 200::BIGINT AS total, CASE WHEN event_id % 3 = 0 THEN 0.5::DOUBLE END AS loss FROM events")
def followed_log(spark, sf_dir):
    """Logs that grow between two triggers of a stream, the first of which ends amid a line: each line comes once."""
    folder = _folder(spark)
    k = F.col("event_id")
    value = F.concat(F.lit("#"), k, F.lit("  1%|x| "), k % 100 + 1, F.lit("/200 [00:01<00:02, s]"), F.when(k % 3 == 0, "{'loss': '0.5'}").otherwise(""))
    rows = _t(spark, sf_dir, "events").select(F.concat(F.lit("run"), k % 8, F.lit(".log")).alias("file"), k.alias("at"), value.alias("value"), (k % 5 < 3).alias("early"))
    logs = f"{folder}/logs"
    _append(rows.where("early"), logs, "", "")
    read = lambda: monitor.drained(tail.tailed_lines(spark, logs, ".log", 1 << 16), "followed", f"{folder}/place", mode="append")
    read()
    _append(rows.where("not early"), logs, "\n", "\n")
    found = read().select(F.regexp_extract("value", r"^#(\d+)", 1).cast("bigint").alias("event_id"), X.progress(F.col("value")).alias("p"))
    return found.select("event_id", "p.step", "p.total", "p.loss")


_QUIET, _FORGET = 7200, 36000


@_query(f"""WITH e AS (
  SELECT user_id, ts, event_id, CASE event_id % 5 WHEN 0 THEN 'done' WHEN 1 THEN 'error' ELSE 'running' END AS status, epoch_us(ts) AS us FROM events
), o AS (
  SELECT *, lag(status) OVER w AS was, lag(us) OVER w AS before, lead(us) OVER w AS after FROM e
  WINDOW w AS (PARTITION BY user_id ORDER BY us, CASE status WHEN 'running' THEN 1 WHEN 'done' THEN 2 ELSE 3 END)
), g AS (
  SELECT *, CASE WHEN was = 'running' THEN CASE WHEN before + {_QUIET}000000 < us THEN before + {_QUIET}000000 END ELSE before END + {_FORGET}000000 < us AS anew,
    CASE status WHEN 'running' THEN 1 WHEN 'done' THEN 2 ELSE 3 END AS rank FROM o
), l AS (
  SELECT *, sum(coalesce(anew, false)::INT) OVER (PARTITION BY user_id ORDER BY us, rank) AS life FROM g
), s AS (
  SELECT *, max(CASE WHEN status = 'running' THEN us END) OVER (PARTITION BY user_id, life ORDER BY us, rank) AS begun FROM l
), c AS (
  SELECT user_id, status, us, begun, CASE WHEN status <> 'running' THEN us END AS ended, NULL AS error FROM s
  UNION ALL
  SELECT user_id, 'error', us + {_QUIET}000000, begun, us + {_QUIET}000000, 'silent' FROM s
  WHERE status = 'running' AND us + {_QUIET}000000 < coalesce(after, (SELECT max(us) FROM e))
)
SELECT user_id, status, us AS at_us, begun AS started_us, ended AS ended_us, error, count(*) AS n FROM c GROUP BY ALL""")
def timed_statuses(spark, sf_dir):
    """Every change of each user's status; a running one of which nothing is heard for two hours is in error."""
    events = monitor.stream_parquet(spark, f"{sf_dir}/event[s].parquet", _t(spark, sf_dir, "events").schema)
    k = F.col("event_id") % 5
    updates = events.select("user_id", "ts", F.when(k == 0, "done").when(k == 1, "error").otherwise("running").alias("status"))
    folder = _folder(spark)
    found = monitor.drained(status.status_changes(updates, "user_id", "ts", "status", silence=_QUIET, forget=_FORGET), "timed", f"{folder}/place", mode="append")
    us = [F.unix_micros(F.col(c).cast("timestamp")).alias(n) for c, n in (("ts", "at_us"), ("started_at", "started_us"), ("ended_at", "ended_us"))]
    return found.select("user_id", "status", *us, "error").groupBy("user_id", "status", "at_us", "started_us", "ended_us", "error").agg(F.count("*").alias("n"))


@_query("SELECT time_bucket(INTERVAL '6 hours', ts) AS window_start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def streamed_windows(spark, sf_dir):
    events = monitor.stream_parquet(spark, f"{sf_dir}/event[s].parquet", _t(spark, sf_dir, "events").schema)
    return monitor.drained(monitor.tumbling(events, "ts", "6 hours", "1 day", ["event_type"]), "windows", f"{_folder(spark)}/place")


@_query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL '3 hours' THEN 0 ELSE 1 END AS opens FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts RANGE UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '3 hours' AS session_end, count(*) AS n FROM s GROUP BY user_id, k""")
def streamed_sessions(spark, sf_dir):
    events = monitor.stream_parquet(spark, f"{sf_dir}/event[s].parquet", _t(spark, sf_dir, "events").schema)
    return monitor.drained(monitor.sessions(events, "ts", "3 hours", "1 day", "user_id"), "sessions", f"{_folder(spark)}/place")
