"""Numbered and paired lines, tailed logs and statuses with timers."""

import os
import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from evidentia.sources import lines, tail
from evidentia.streaming import monitor, status


def test_lines_are_numbered_over_splits_and_files(spark, tmp_path):
    rng = random.Random(1)
    want = []
    for name in ("b", "a"):
        text = [f"{name}{i} " + "x" * rng.randrange(40) if rng.random() > 0.1 else rng.choice(["", "  ", "\t"]) for i in range(3000)]
        (tmp_path / f"{name}.txt").write_text("\n".join(text) + ("\n" if name == "a" else ""))
        want.append((name, text))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        rows = lines.numbered_lines(spark, f"file://{tmp_path}")
        assert rows.rdd.getNumPartitions() > 5
        got = {(os.path.basename(r.path)[0], r.line): (r.place, r.value) for r in rows.collect()}
        place = 0
        for name, text in sorted(want):
            for i, line in enumerate(text, 1):
                place += 1
                assert got.pop((name, i)) == (place, line)
        assert not got
        kept = lines.numbered_lines(spark, f"file://{tmp_path}", skip_blank=True).orderBy("place").collect()
        assert [r.value for r in kept] == [x for _, text in sorted(want) for x in text if x.strip()] and [r.place for r in kept] == list(range(1, len(kept) + 1))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_the_first_malformed_line_is_named(spark, tmp_path):
    good = [f'{{"k": {i}, "s": "x"}}' for i in range(500)]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "rows.jsonl").write_text("\n".join([*good[:200], "", *good[200:]]))
    path = f"file://{tmp_path}/in"
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2k")
    try:
        got = lines.numbered_json_lines(spark, path, "k bigint, s string").orderBy("line").collect()
        assert [r.k for r in got] == list(range(500)) and [r.line for r in got] == [*range(1, 201), *range(202, 502)]
        for bad in ('{"k": 1', '{"k": "word"}', "[1]", "3"):
            (tmp_path / "in" / "rows.jsonl").write_text("\n".join([*good[:321], bad, *good[:50], "{", *good]))
            with pytest.raises(ValueError, match=r"rows\.jsonl:322$"):
                lines.numbered_json_lines(spark, path, "k bigint, s string")
            assert lines.numbered_json_lines(spark, path, "k bigint, s string", strict=False).count() == 871
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_lines_of_two_files_are_paired(spark, tmp_path):
    for name, n in (("p", 50), ("m", 47)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.txt").write_text("\n\n".join(f"{name}{i}" for i in range(n)) + "\n")
    p, m = f"file://{tmp_path}/p", f"file://{tmp_path}/m"
    got = lines.paired_lines(spark, p, m).orderBy("place").collect()
    assert [(r.place, r.left, r.right) for r in got] == [(i + 1, f"p{i}", f"m{i}") for i in range(47)]
    with pytest.raises(ValueError, match="50 lines"):
        lines.paired_lines(spark, p, m, strict=True)
    assert lines.paired_lines(spark, p, p, strict=True).where("left = right").count() == 50


@pytest.mark.parametrize("piece", [7, 64, 1 << 20])
def test_appended_lines_arrive_once(spark, tmp_path, piece):
    """Lines between two triggers, a half line, carriage returns, a new file, a restart, and a replaced file."""
    logs, place = tmp_path / "logs", f"{tmp_path}/cp{piece}"
    (logs / "sub").mkdir(parents=True)
    got = []

    def trigger():
        before = len(got)
        stream = tail.tailed_lines(spark, f"file://{logs}", ".log", piece)
        query = stream.writeStream.foreachBatch(lambda b, _: got.extend((os.path.basename(r.path), r.at, r.value) for r in b.collect())).option("checkpointLocation", place).trigger(availableNow=True).start()
        query.awaitTermination()
        return sorted(got[before:])

    def append(name, data):
        with open(logs / name, "ab") as f:
            f.write(data)

    append("a.log", b"one\ntwo\nhal")
    append("a.txt", b"other\n")
    assert trigger() == [("a.log", 0, "one"), ("a.log", 4, "two")]
    append("a.log", "f ünd\n\n  1%|x\r 2%|xx\r\nend".encode())
    append("sub/b.log", b"\nfirst" + b"x" * 100 + b"\n")
    whole = "half ünd".encode()
    at = 8 + len(whole) + 2
    assert trigger() == [("a.log", 8, "half ünd"), ("a.log", at, "  1%|x"), ("a.log", at + 7, " 2%|xx"), ("b.log", 1, "first" + "x" * 100)]
    assert trigger() == []
    append("a.log", b"ed\n")
    assert [v for _, _, v in trigger()] == ["ended"]
    (logs / "a.log").write_bytes(b"anew\n")
    assert trigger() == [("a.log", 0, "anew")]
    assert len(got) == 8


def test_log_progress_follows_the_file(spark, tmp_path):
    (tmp_path / "run").mkdir()
    log = tmp_path / "run" / "train.log"
    log.write_text("start\n 10%|#| 1/10 [00:01<00:09, s]\r")
    read = lambda: monitor.drained(monitor.stream_log(spark, f"file://{tmp_path}/run"), "follow", f"file://{tmp_path}/place", mode="append").select("step").orderBy("step").collect()
    assert [r.step for r in read()] == [1]
    with log.open("a") as f:
        f.write(" 20%|#| 2/10 [00:02<00:08, s]\r{'loss': '0.5'}\n")
    assert [r.step for r in read()] == [None, 1, 2]


def by_hand(events, silence, forget, end):
    """The changes of each key, update by update; `end` is the last watermark."""
    out, keys = [], {}
    for key, at, to, why in sorted(events, key=lambda e: (e[0], e[1], ("running", "done", "error").index(e[2]) if e[2] in status.STATUSES else -1)):
        s = keys.setdefault(key, {"now": None, "started": None, "seen": None, "ended": None})
        if s["now"] == "running" and s["seen"] + silence < at:
            s["now"], s["ended"] = "error", s["seen"] + silence
            out.append((key, "error", s["ended"], s["started"], s["ended"], "silent"))
        if s["ended"] is not None and s["ended"] + forget < at:
            s["now"] = s["started"] = s["ended"] = None
        s["seen"] = at
        if to in status.STATUSES:
            s["now"] = to
            s["started"] = at if to == "running" else s["started"]
            s["ended"] = None if to == "running" else at
            out.append((key, to, at, s["started"], s["ended"], why if to == "error" else None))
    for key, s in keys.items():
        if s["now"] == "running" and s["seen"] + silence < end:
            out.append((key, "error", s["seen"] + silence, s["started"], s["seen"] + silence, "silent"))
    return sorted(out, key=repr)


@pytest.mark.parametrize("files", [1, 6])
def test_statuses_change_by_updates_and_by_silence(spark, tmp_path, files):
    rng = random.Random(6)
    start = datetime(2024, 1, 1, tzinfo=timezone.utc)
    events = sorted(((f"k{rng.randrange(9)}", rng.randrange(20_000), rng.choice(["running", "running", "done", "error", "alive"]), "oom") for _ in range(300)), key=lambda e: e[1])
    events += [("last", 20_500, "alive", None)]
    size = -(-len(events) // files)
    for i in range(files):
        part = [(k, start + timedelta(seconds=t), s, e) for k, t, s, e in events[i * size : (i + 1) * size]]
        spark.createDataFrame(part, "key string, ts timestamp, status string, error string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/u")
    schema = spark.read.parquet(f"{tmp_path}/u").schema
    stream = monitor.stream_parquet(spark, f"file://{tmp_path}/u", schema, 1)
    changes = status.status_changes(stream, "key", "ts", "status", silence=600, forget=900, error="error")
    found = monitor.drained(changes, f"status{files}", f"file://{tmp_path}/cp", mode="append").collect()
    second = lambda t: None if t is None else int(t.replace(tzinfo=timezone.utc).timestamp() - start.timestamp())
    got = sorted(((r.key, r.status, second(r.ts), second(r.started_at), second(r.ended_at), r.error) for r in found), key=repr)
    assert got == by_hand(events, 600, 900, 20_500)


def test_status_of_null_keys_and_late_updates(spark, tmp_path):
    rows = [(None, 5, "running"), ("a", None, "running"), ("a", 10, "running"), ("a", 10, "done"), ("a", 10, "error"), ("b", 7, None)]
    df = spark.createDataFrame(rows, "key string, s int, status string").select("key", F.timestamp_seconds("s").alias("ts"), "status")
    df.write.parquet(f"{tmp_path}/u")
    stream = monitor.stream_parquet(spark, f"file://{tmp_path}/u", df.schema)
    found = monitor.drained(status.status_changes(stream, "key", "ts", "status", silence=60, forget=60), "odd", f"file://{tmp_path}/cp", mode="append").collect()
    assert [r.status for r in found] == ["running", "done", "error"] and {r.key for r in found} == {"a"}


def test_statuses_take_no_columns_that_they_can_do_without(spark, tmp_path):
    spark.createDataFrame([("a", "2024-01-01 00:00:00", "running")], "key string, ts string, status string").write.parquet(f"{tmp_path}/in")
    stream = monitor.stream_parquet(spark, f"{tmp_path}/in", spark.read.parquet(f"{tmp_path}/in").schema).withColumn("ts", F.to_timestamp("ts"))
    found = status.status_changes(stream, "key", "ts", "status", silence=60, forget=60)
    plan = found._jdf.queryExecution().analyzed().toString()
    given = plan[plan.index("FlatMapGroupsInPandasWithState") :].splitlines()[1]
    assert "AS rank" in given and "AS status" not in given and "AS error" not in given, given
    rows = monitor.drained(found, "few", f"file://{tmp_path}/cp", mode="append").collect()
    assert [(r.key, r.status, r.ended_at, r.error) for r in rows] == [("a", "running", None, None)]
