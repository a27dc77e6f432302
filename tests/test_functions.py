import hashlib
import json
import math

import pytest
from pyspark.sql import functions as F

from evidentia.functions import columns as C
from evidentia.functions import extract as X


def one(spark, rows, ddl, **columns):
    return [tuple(r) for r in spark.createDataFrame(rows, ddl).select(*[c.alias(n) for n, c in columns.items()]).collect()]


def test_lenient_casts(spark):
    got = one(spark, [(x,) for x in ["3", " 4.9 ", "-2.5", "1e3", "nan", "inf", "x", "", None]], "t string", i=C.lenient_int(F.col("t")))
    assert [g[0] for g in got] == [3, 4, -2, 1000, None, None, None, None, None]


def test_finite_and_sentinel(spark):
    got = one(spark, [(1.5, -1), (math.nan, 2), (math.inf, None), (None, 0)], "x double, g int", f=C.finite(F.col("x")), g=C.null_sentinel(F.col("g"), -1))
    assert got == [(1.5, None), (None, 2), (None, None), (None, 0)]


def test_bucket_edges(spark):
    rows = [(x,) for x in [None, 0, 1, 3, 4, 10, 11]]
    got = one(spark, rows, "n int", four=C.bucket(F.col("n"), C.COUNT_FOUR), three=C.bucket(F.col("n"), C.COUNT_THREE, missing=None))
    assert got == [("unknown", None), ("none", None), ("few", "single"), ("few", "few"), ("some", "few"), ("some", "many"), ("many", "many")]


def test_confidences(spark):
    got = one(spark, [(4, 300.0), (20, 10.0)], "c int, a double", lin=C.linear_confidence(F.col("c"), F.col("a")), log=C.log_confidence(F.col("c"), F.col("a"), 50.0))
    assert got[0][0] == 0.5 and got[1][0] == 1.0
    want = min(1, math.log1p(300 / 50) / math.log1p(10)) * min(1, math.log1p(4) / math.log1p(20))
    assert abs(got[0][1] - want) < 1e-12


def test_geometry(spark):
    rows = [(0.0, 0.0, 3.0, 4.0, r) for r in (5.0, 6.0, 0.5, None, 0.0)]
    args = [F.col(c) for c in "abcde"]
    got = one(spark, rows, "a double, b double, c double, d double, e double", r=C.radial_geometry(*args), v=C.vertical_geometry(args[1], args[3], args[4]))
    assert [(tuple(r), v) for r, v in got] == [((True, None), True), ((False, "too_near"), True), ((False, "too_far"), False), ((False, "missing"), False), ((False, "missing"), False)]


def test_tri_state_and_flags(spark):
    got = one(spark, [("TRUE",), (" no ",), ("maybe",), (None,)], "s string", t=C.tri_state(F.col("s")), f=C.flag_set({"b": F.col("s").isNull(), "a": F.lit(True), "c": F.col("s") == "TRUE"}))
    assert got == [("present", ["a", "c"]), ("absent", ["a"]), ("unknown", ["a"]), ("unknown", ["a", "b"])]


def test_sha1_bucket(spark):
    key = "set::all::abc"
    digest = hashlib.sha1(key.encode()).hexdigest()
    got = one(spark, [(key,)], "k string", a=C.sha1_bucket(F.col("k")), b=C.sha1_bucket(F.col("k"), 12))
    assert got == [(int(digest[:8], 16) % 100, int(digest[:12], 16) % 100)]


def test_area_edges(spark):
    got = one(spark, [(x,) for x in (None, 0.0, 299.9, 300.0, 1500.0)], "a double", b=C.bucket(F.col("a"), C.AREA_FIXED), t=C.threshold_bucket(F.col("a"), F.lit(299.9), F.lit(300.0)))
    assert got == [("unknown", None), ("none", None), ("small", "small"), ("medium", "medium"), ("large", "large")]


def test_quadrants_keep_tie_order(spark):
    rows = [(0, 0, 0, 0), (3, 0, 0, 0), (2, 2, 0, 0), (9, 1, 1, 1), (2, 2, 2, 2), (0, 1, 1, 0), (3, 3, 4, 0)]
    counts = dict(zip(C.QUADRANTS, map(F.col, "abcd"), strict=True))
    got = one(spark, rows, "a int, b int, c int, d int", q=C.quadrant_code(counts), p=C.quadrant_prose(counts))
    assert [g[0] for g in got] == [None, "ST_only", "ST+SN", "ST_pred", "4Q", "SN+IT", "IT+ST+SN"]
    assert got[2][1] == "distributed in the superior-temporal and superior-nasal quadrants"
    assert got[6][1] == "distributed across 3 quadrants (inferior-temporal, superior-temporal, superior-nasal)"


def test_options(spark):
    rows = [(["d", "c", "a"], "a", "B"), (["x"], "a", "E")]
    o = F.col("o")
    got = one(spark, rows, "o array<string>, v string, l string", letter=C.option_letter(o, F.col("v")), value=C.option_value(o, F.col("l")), lines=C.option_lines(o))
    assert got == [("C", "c", "A. d\nB. c\nC. a"), (None, None, "A. x")]


def test_multiset_and_tags(spark):
    got = one(spark, [(["a", "b", "a"], ["a", "a", "b"]), (["a"], ["a", "a"])], "x array<string>, y array<string>", s=C.same_multiset(F.col("x"), F.col("y")), t=C.tag(F.col("x")[0], {"a": "Alpha"}))
    assert got == [(True, "Alpha"), (False, "Alpha")]


def test_markers_and_objects(spark):
    nested = 'pre {"a": {"b": 1}, "s": "}"} post {x}'
    rows = [(nested,), ("no object",), ('{"a": 1}',), (None,), ('{"open": ',)]
    got = one(spark, rows, "t string", b=X.first_object(F.col("t")).cast("string"), g=X.greedy_object(F.col("t")), z=X.lazy_object(F.col("t")), s=X.is_strict_object(F.col("t")))
    assert got[0] == ('{"a":{"b":1},"s":"}"}', '{"a": {"b": 1}, "s": "}"} post {x}', '{"a": {"b": 1}', False)
    assert got[1] == (None, None, None, False) and got[3][0] is None and got[4][0] is None
    assert got[2] == ('{"a":1}', '{"a": 1}', '{"a": 1}', True)
    assert json.loads(got[0][0])["s"] == "}"


def test_fenced_objects_fall_through(spark):
    """A fence that does not parse hides no later object, and all flat objects are tried."""
    rows = [('```json {"a": } ``` 【JSON】 {"dr_grade": 2}\n\nx',), ('{"dr_grade": } then {"dr_grade": 3}',), ('```json\n{"dr_grade": 1}\n``` {"dr_grade": 4}',), ('{"other": 1}',)]
    assert one(spark, rows, "t string", f=X.fenced_object(F.col("t"))) == [('{"dr_grade": 2}',), ('{"dr_grade": 3}',), ('{"dr_grade": 1}',), (None,)]


def test_objects_after_the_marker(spark):
    rows = [('{"a": 1} [Structured Output] {"b": 2} tail',), ('{"a": 1} [Structured Output] none',), ('{"a": 1, "a": 2} {x}',)]
    assert one(spark, rows, "t string", o=X.first_object(F.col("t")).cast("string")) == [('{"b":2}',), ('{"a":1}',), ('{"a":2}',)]


def test_fixed_point_is_pythons(spark):
    import random

    rng = random.Random(1)
    values = [0.125, 0.375, 2.675, 0.435, 0.445, 1.005, -0.015, 0.0, 1e9 + 0.005, 123456.785, *(rng.randrange(10**6) / 1000 for _ in range(2000)), *(rng.random() * 10 ** rng.randrange(8) for _ in range(500))]
    got = one(spark, [(v,) for v in values], "v double", a=X.fixed_point(F.col("v")), b=X.fixed_point(F.col("v"), 0), c=X.fixed_point(F.col("v"), 1))
    assert got == [(f"{v:.2f}", f"{v:.0f}", f"{v:.1f}") for v in values]

@pytest.mark.parametrize(("text", "strict"), [('{"a":1}', True), ('{"a":1} x', False), ("{'a':1}", False), ('{"a":NaN}', True), ('{"a":1,"a":2}', True), ("[1]", False)])
def test_strict_json_is_pythons(spark, text, strict):
    assert one(spark, [(text,)], "t string", s=X.is_strict_object(F.col("t"))) == [(strict,)]


def test_grades_and_letters(spark):
    rows = [("Grade 1 【结论】 DR Grade 3",), ('{"dr_grade": 2} DR Grade 4',), ("grade 9",), ("Answer: (c)",), ("none of it",), ("just 4 here",)]
    t = F.col("t")
    got = one(spark, rows, "t string", a=X.grade(t), b=X.grade(t, "benchmark"), c=X.grade(t, "format"), d=X.grade(t, "training"), lt=X.letter(t), f=X.has_forbidden(t))
    assert [g[:4] for g in got] == [(3, 3, 3, 1), (2, 2, 4, 4), (None,) * 4, (None,) * 4, (None,) * 4, (None, None, None, 4)]
    assert [g[4] for g in got] == [None, None, None, "C", None, None] and [g[5] for g in got] == [True, True, False, False, False, False]


def test_fenced_objects(spark):
    rows = [('```json\n{"a": 1}\n``` {"dr_grade": 2}',), ('x 【JSON】 {"b": 1}\n\nrest',), ('see {"dr_grade": 3} end',), ("none",)]
    got = one(spark, rows, "t string", o=X.fenced_object(F.col("t")))
    assert [g[0] for g in got] == ['{"a": 1}', '{"b": 1}', '{"dr_grade": 3}', None]


def test_key_values(spark):
    got = one(spark, [("a: 1\nb:x:y\nplain\na: 2",), ("",)], "t string", m=X.key_values(F.col("t")), n=X.name_list(F.lit("B, A,NONE,,A")))
    assert got == [({"a": "2", "b": "x:y"}, ["A", "B"]), ({}, ["A", "B"])]


def test_paths_and_durations(spark):
    rows = [("data/x/img.0.png", "01:02"), ("name", "1:02:03"), ("a/.hidden", "x")]
    got = one(spark, rows, "p string, d string", s=X.path_stem(F.col("p")), w=X.without_prefix(F.col("p"), "data/"), d=X.duration_seconds(F.col("d")))
    assert got == [("img.0", "x/img.0.png", 62), ("name", "name", 3723), (".hidden", "a/.hidden", None)]


def test_progress_lines(spark):
    rows = [("37%|x| 12/345 [01:02<03:04, 1.2it/s]",), ("{'loss': 0.25, 'lr': 1}",), ("Total optimization steps = 791",), ("idle",)]
    got = one(spark, rows, "t string", p=X.progress(F.col("t")))
    assert [tuple(g[0]) for g in got] == [(12, 345, None, 62, 184), (None, None, 0.25, None, None), (None, 791, None, None, None), (None,) * 5]


def test_tokens_and_sections(spark):
    got = one(spark, [([5, 6, 0, 0],), ([7],)], "i array<int>", t=X.trimmed_tokens(F.col("i"), 0), s=X.has_sections(F.lit("## A\ntext"), ["## A", "## B"]))
    assert got == [([5, 6], 0.5), ([7], 0.5)]


def test_compact_json_keeps_nulls_and_letters(spark):
    assert one(spark, [("é", None)], "a string, b int", j=X.compact_json(F.struct("a", "b"))) == [('{"a":"é","b":null}',)]


def test_deep_keys_and_templates(spark):
    rows = [('{"a": {"x": 1}, "y": {"b": {"x": 2}}, "z": [{"q": "é"}]}',), ('[{"x": null}, {"x": 3}]',), ("broken",), (None,)]
    got = one(spark, rows, "t string", x=X.first_key("x")("t"), q=X.first_key("q", "none")("t"))
    assert got == [("1", '"é"'), ("3", None), (None, None), (None, None)]
    assert one(spark, [("A", None)], "a string, b int", r=X.rendered("<{a}|{b}>", a=F.col("a"), b=F.col("b"))) == [("<A|>",)]


def test_kept_measure(spark):
    rows = [(10.0, 2, 1), (10.0, 2, 0), (1.0, 2, 1), (None, 2, 1), (10.0, 0, None)]
    got = one(spark, rows, "a double, n int, g int", k=C.kept_measure(F.col("a"), F.col("n"), 5.0, F.col("g")))
    assert [g[0] for g in got] == [True, False, False, False, False]
