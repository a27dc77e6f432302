import json
import time

import pytest
from pyspark.sql import functions as F

from evidentia.sources import readers as R
from evidentia.sources import sinks as K
from evidentia.streaming import monitor


def write(folder, name, text):
    path = folder / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text, encoding="utf-8")
    return str(path)


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*(order or df.columns[:1])).collect()]


def test_json_lines(spark, tmp_path):
    good = write(tmp_path, "a.jsonl", '{"i": 1, "p": true}\n\n{"i": 2, "p": "unknown"}\n')
    assert rows(R.json_lines(spark, good, "i int, p string")) == [(1, "true"), (2, "unknown")]
    bad = write(tmp_path, "b.jsonl", '{"i": 1}\n{"i": oops\n{"i": 3}\n')
    assert rows(R.json_lines(spark, bad, "i int", mode="tolerant")) == [(1,), (3,)]
    with pytest.raises(Exception, match="(?i)malformed"):
        R.json_lines(spark, bad, "i int").collect()
    assert R.json_lines(spark, str(tmp_path / "none.jsonl"), "i int", optional=True).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        R.json_lines(spark, str(tmp_path / "none.jsonl"), "i int")


def test_json_arrays_and_maps(spark, tmp_path):
    assert rows(R.json_array(spark, write(tmp_path, "a.json", '[{"i": 1},\n {"i": 2}]'), "i int")) == [(1,), (2,)]
    for name, text in (("b", '[{"i": 1}]'), ("c", '{"data": [{"i": 1}]}'), ("d", '{"examples": [{"i": 1}]}')):
        assert rows(R.wrapped_array(spark, write(tmp_path, f"{name}.json", text), "struct<i:int>")) == [(1,)]
    path = write(tmp_path, "m.json", '{"x/1.png": {"g": 2}, "y/2.png": {"g": 0}}')
    assert rows(R.json_map(spark, path, "struct<g:int>")) == [("x/1.png", 2), ("y/2.png", 0)]


def test_entity_documents(spark, tmp_path):
    write(tmp_path, "d/e1/doc.json", '{"lesions": {"HE": {"count": 3}}, "macula": {"center": [1, 2]}}')
    write(tmp_path, "d/e2/doc.json", '{"lesion_analysis": {"he": {"count": 4}}, "macula": {"center": {"x": 5, "y": 6}}}')
    write(tmp_path, "d/e3/doc.json", "")
    write(tmp_path, "d/e4/doc.json", "[1]")
    docs = R.entity_documents(spark, f"{tmp_path}/d/*/doc.json")
    got = docs.select("entity", R.any_path(F.col("doc"), ["$.lesions.HE.count", "$.lesion_analysis.he.count"], "int"), R.point(F.col("doc"), "$.macula.center"), "error")
    assert [(e, n, p and tuple(p), x is None) for e, n, p, x in rows(got, "entity")] == [("e1", 3, (1.0, 2.0), True), ("e2", 4, (5.0, 6.0), True), ("e4", None, None, False)]


def test_tables_in_text(spark, tmp_path):
    path = write(tmp_path, "a.csv", "﻿id_code,diagnosis\na, 2\nb,x\n,1\n")
    assert rows(R.aliased_csv(spark, path, {"id": (("image", "id_code"), "string"), "grade": (("level", "diagnosis"), "int"), "none": (("zz",), "int")}), "grade", "id") == [("b", None, None), (None, 1, None), ("a", 2, None)]
    path = write(tmp_path, "b.csv", "﻿img1,3\nimg2,bad\n")
    assert rows(R.plain_csv(spark, path, [("name", "string"), ("grade", "int")], required=["grade"])) == [("img1", 3)]
    path = write(tmp_path, "c.txt", "a/img.1.jpg 4\nbroken\nb.png   0 extra\n")
    assert rows(R.spaced_list(spark, path)) == [("b", 0), ("img.1", 4)]
    df = spark.createDataFrame([("x GRADE: 3 y",), ("GRADE: none",)], "t string")
    assert rows(R.labels_in_text(df, "t").select("grade")) == [(3,)]


def test_listings_logs_and_metrics(spark, tmp_path):
    for name in ("f/train/a_MA.png", "f/train/b_HE.png", "f/x.txt"):
        write(tmp_path, name, "x")
    listing = R.keyed_listing(R.file_listing(spark, f"{tmp_path}/f", "*.png"), r"([^/]+)/([^/_]+)_([A-Z]+)\.png$", ["split", "stem_key", "kind"])
    assert rows(listing.select("stem_key", "split", "kind")) == [("a", "train", "MA"), ("b", "train", "HE")]
    log = write(tmp_path, "run.log", " 1%| 1/90 [00:01<01:29]\r 2%| 2/90 [00:02<01:28]\n{'loss': 0.5}\n")
    assert R.log_lines(spark, log).count() == 3
    write(tmp_path, "m/one/metrics.json", json.dumps({"n": 3}, indent=1))
    assert rows(R.metric_files(spark, f"{tmp_path}/m/*/metrics.json", "n long")) == [("one", 3)]
    assert R.settings(spark, write(tmp_path, "s.yaml", "a: 1 # c\nb: 'x'\n  nested: 2\n# no\n")) == {"a": "1", "b": "x"}


def test_checked_rows(spark):
    df = spark.createDataFrame([(1, [1, 2, 3, 4])], "i int, box array<int>")
    assert R.checked(df, ["i"], {"box": 4}).count() == 1
    with pytest.raises(Exception, match="box has another length"):
        R.checked(df, [], {"box": 3}).collect()
    with pytest.raises(Exception, match="i is missing"):
        R.checked(spark.createDataFrame([(None,)], "i int"), ["i"]).collect()


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "é", None), (2, "b", "x")], "i int, s string, o string")
    K.write_json_lines(df, f"{tmp_path}/out", by=("s",))
    K.write_json_lines(df, f"{tmp_path}/out", append=True, by=("s",))
    assert spark.read.json(f"{tmp_path}/out").count() == 4
    K.write_with_errors(df, F.col("o") == "x", f"{tmp_path}/good", f"{tmp_path}/bad")
    assert spark.read.json(f"{tmp_path}/good").count() == 1 and spark.read.json(f"{tmp_path}/bad").count() == 1
    assert json.loads(K.as_document(df, ["i"])) == [{"i": 1, "s": "é", "o": None}, {"i": 2, "s": "b", "o": "x"}]
    with pytest.raises(ValueError, match="more than 1"):
        K.as_document(df, ["i"], most=1)
    K.register(f"{tmp_path}/registry.json", "a", {"file": "x"})
    assert K.register(f"{tmp_path}/registry.json", "b", {"file": "y"}) == {"a": {"file": "x"}, "b": {"file": "y"}}


def test_streamed_counts_and_windows_equal_batch(spark, tmp_path):
    import datetime as dt

    start = dt.datetime(2024, 1, 1)
    events = [(i, start + dt.timedelta(minutes=7 * i), f"u{i % 3}") for i in range(60)]
    df = spark.createDataFrame(events, "event_id int, ts timestamp, user string")
    df.repartition(4).write.parquet(f"{tmp_path}/events")
    stream = monitor.stream_parquet(spark, f"{tmp_path}/events", df.schema, files_per_trigger=1)
    got = monitor.drained(monitor.counts_by_key(stream, "user"), "t_counts", monitor.checkpoint_folder(spark))
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, monitor.counts_by_key(df, "user").collect()))
    windows = monitor.drained(monitor.tumbling(stream, "ts", "1 hour", "1 day", ["user"]), "t_windows", monitor.checkpoint_folder(spark))
    want = df.groupBy(F.window("ts", "1 hour").alias("w"), "user").count().select("w.start", "user", "count")
    assert sorted(map(tuple, windows.collect())) == sorted(map(tuple, want.collect()))
    found = monitor.drained(monitor.sessions(stream, "ts", "10 minutes", "1 day", "user"), "t_sessions", monitor.checkpoint_folder(spark))
    assert found.count() == 60


def test_streamed_log_and_status(spark, tmp_path):
    write(tmp_path, "logs/a.log", " 1%| 1/90 [00:01<01:29, x]\r 2%| 2/90 [00:02<01:28, x]\n")
    out = monitor.drained(monitor.stream_log(spark, f"{tmp_path}/logs"), "t_log", monitor.checkpoint_folder(spark), mode="append")
    assert sorted(r.step for r in out.collect()) == [1, 2]
    table = f"status_{int(time.time())}"
    updates = spark.createDataFrame([("a", 1, "running"), ("a", 2, "done"), ("b", 1, "error")], "k string, at int, status string")
    updates.coalesce(1).write.parquet(f"{tmp_path}/u")
    stream = monitor.stream_parquet(spark, f"{tmp_path}/u", updates.schema)
    for _ in range(2):
        monitor.upsert_status(stream, table, "k", "at", "status", f"{tmp_path}/cp").awaitTermination()
    assert sorted(map(tuple, monitor.current_status(spark, table, "k", "at", "status").select("k", "status").collect())) == [("a", "done"), ("b", "error")]
