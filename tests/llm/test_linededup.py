import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from evidentia.llm import linededup
from evidentia.llm.queries import op12_levelled_line_runs

SPACES = " \t\n\x0b\f\r"


def brute(rows, min_chars=20, min_docs=3):
    """(doc_id, n_lines, n_dropped, kept text) of each row, by dictionaries."""

    def key(line):
        return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(SPACES))

    holders = defaultdict(list)
    for doc_id, text in rows:
        for k in {key(line) for line in (text or "").split("\n")}:
            if len(k) >= min_chars:
                holders[k].append(-1 if doc_id is None else doc_id)
    out = []
    for doc_id, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            held = holders.get(key(line), [])
            if not (len(held) >= min_docs and (-1 if doc_id is None else doc_id) < max(held)):
                kept.append(line)
        out.append((doc_id, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


def rows_of(df):
    found = linededup.without_repeated_lines(df).select("doc_id", "n_lines", "n_dropped", "text").collect()
    return sorted(map(tuple, found), key=repr)


@pytest.fixture(scope="module")
def lines():
    rng = random.Random(5)
    pool = [f"A Line of Prose, number {i}, long enough to count" for i in range(30)] + ["short", "", "  ", "twenty chars exactly", "nineteen characters"]
    rows = []
    for i in range(60):
        own = [rng.choice(["", " ", "\t\x0b"]) + rng.choice([str, str.upper, str.lower])(rng.choice(pool)) + rng.choice(["", "\r", " \f"]) for _ in range(rng.randint(1, 9))]
        rows.append((i, "\n".join(own)))
    long = "\n".join([f"a long text's own line {i} of twenty thousand" for i in range(20_000)] + [pool[0]] * 3)
    rows += [(100, None), (101, ""), (102, "\n"), (103, long), (7, rows[7][1]), (7, rows[7][1]), (None, rows[3][1]), (None, pool[1]), (104, "Ä" + pool[2]), (105, "ä" + pool[2]), (106, "É" * 20), (107, "É" * 20), (108, "É" * 20), (109, "é" * 20)]
    return rows


def test_equals_brute_force(spark, lines):
    df = spark.createDataFrame(lines, "doc_id long, text string").repartition(3)
    assert rows_of(df) == sorted(brute(lines), key=repr)


def test_a_null_id_keeps_only_what_no_other_holds(spark):
    line = "a line that is long enough for a key"
    rows = [(None, line), (None, line), (None, line)]
    assert {r[2] for r in rows_of(spark.createDataFrame(rows, "doc_id long, text string"))} == {0}
    assert sorted(r[2] for r in rows_of(spark.createDataFrame([*rows, (-5, line)], "doc_id long, text string"))) == [0, 1, 1, 1]


@pytest.mark.parametrize(("batches", "fanout"), [(1, 2), (5, 2), (7, 3)])
def test_runs_hold_every_key_that_can_still_change(spark, lines, batches, fanout):
    """Whatever the batches and levels, the merged runs tell the frequent keys and the last document of each."""
    df = spark.createDataFrame(lines, "doc_id long, text string")
    hashed = linededup.hashed_lines(df, min_chars=20, batches=batches).cache()
    runs = linededup.Runs(spark, fanout=fanout)
    for b in range(batches):
        runs.add(linededup.counted(hashed.where(F.col("batch") == b)))
        assert all(len(level) < fanout for level in runs.levels)
    want = linededup.counted(hashed).where("docs >= 3").select("h1", "h2", "last")
    assert sorted(map(tuple, runs.frequent().collect())) == sorted(map(tuple, want.collect()))
    runs.close()
    assert not [t for t in spark.catalog.listTables() if t.name.startswith("evidentia_run_")]


def test_settled_keys_are_not_added_again(spark):
    rows = [(i, "the same long line in every document") for i in range(40)]
    hashed = linededup.hashed_lines(spark.createDataFrame(rows, "doc_id long, text string"), min_chars=20, batches=1)
    runs = linededup.Runs(spark)
    runs.add(linededup.counted(hashed))
    earlier = linededup.counted(linededup.hashed_lines(spark.createDataFrame([(3, rows[0][1])], "doc_id long, text string"), min_chars=20, batches=1))
    runs.add(earlier)
    assert runs.frequent().count() == 1 and runs._merged(runs.names()).first()["docs"] == 40
    later = linededup.counted(linededup.hashed_lines(spark.createDataFrame([(99, rows[0][1])], "doc_id long, text string"), min_chars=20, batches=1))
    runs.add(later)
    assert runs.frequent().first()["last"] == 99
    runs.close()


def test_plan_is_native_and_runs_merge_without_shuffle(spark, lines):
    df = spark.createDataFrame(lines, "doc_id long, text string")
    found = linededup.without_repeated_lines(df)
    assert "Python" not in found._jdf.queryExecution().toString() and "Arrow" not in found._jdf.queryExecution().toString()
    runs = linededup.Runs(spark, fanout=9)
    for half in (0, 1):
        runs.add(linededup.counted(linededup.hashed_lines(df.where(F.col("doc_id") % 2 == half), min_chars=20, batches=1)))
    assert "Exchange" not in runs._merged(runs.names())._jdf.queryExecution().executedPlan().toString()
    runs.close()


def test_odd_rows_and_other_columns(odd, none):
    found = linededup.without_repeated_lines(odd)
    assert found.count() == 5 and "bucket" in found.columns and "score" in found.columns
    assert linededup.without_repeated_lines(none).count() == 0


def test_query_digest(spark, lines, tmp_path):
    spark.createDataFrame(lines, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, op12_levelled_line_runs(spark, str(tmp_path)).collect()), key=repr)
    assert got == sorted(((i, n, d, hashlib.sha256(t.encode()).hexdigest()) for i, n, d, t in brute(lines)), key=repr)
