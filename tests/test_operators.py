import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from evidentia.operators import aggregates as A
from evidentia.operators import joins as J
from evidentia.operators import metrics as M
from evidentia.operators import progress as P
from evidentia.operators import reshape as R
from evidentia.operators import rules as L
from evidentia.operators import sampling as S
from evidentia.operators import sets as U
from evidentia.plans import curation


def frame(spark, rows, ddl):
    return spark.createDataFrame(rows, ddl)


def rows_of(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


# metrics


def test_published_binary_counts(spark):
    counts = frame(spark, [("MA", 79, 98, 45, 3), ("HE", 168, 11, 26, 20), ("EX", 171, 52, 0, 2), ("SE", 42, 182, 0, 1)], "k string, tp long, fp long, fn long, tn long")
    assert abs(M.macro(M.binary_metrics(counts)).first()["macro_f1"] - 0.6523827528) < 1e-9


def test_published_confusion_matrix(spark):
    table = [[24, 2, 4, 0, 0], [8, 10, 11, 1, 0], [1, 2, 19, 7, 1], [1, 0, 14, 13, 2], [0, 0, 12, 9, 9]]
    pairs = [(g, p) for g, row in enumerate(table) for p, n in enumerate(row) for _ in range(n)]
    matrix = M.confusion_matrix(frame(spark, pairs, "g int, p int"), F.col("g"), F.col("p"), range(5))
    assert M.accuracy(matrix).first()["accuracy"] == 0.5
    assert abs(M.class_metrics(matrix).agg(F.avg("f1")).first()[0] - 0.4977344877) < 1e-9
    assert abs(M.weighted_kappa(matrix, 5).first()["qwk"] - 0.7348484848) < 1e-9


def test_zero_rules_and_f1_modes(spark):
    counts = frame(spark, [("errors", 0, 3, 2, 1), ("nothing", 0, 0, 0, 4)], "k string, tp long, fp long, fn long, tn long")
    get = lambda **o: {r.k: r.f1 for r in M.binary_metrics(counts, **o).collect()}
    assert get() == {"errors": 0.0, "nothing": None}
    assert get(f1_mode="harmonic") == {"errors": None, "nothing": None}
    assert get(zero=0.0) == {"errors": 0.0, "nothing": 0.0}


@pytest.mark.parametrize(
    ("policy", "want"),
    [("strict", "fn fp fn fp fn fp tp tn"), ("lenient", "- - fn tn fn tn tp tn"), ("joint", "fn tn fn tn fn tn tp tn"), ("relaxed", "fn fp fn fp tp fp tp tn"), ("general", "- - fn tn fn tn tp tn")],
)
def test_error_policies(spark, policy, want):
    cases = [(g, p, parsed, right) for parsed, right, p in [(False, True, True), (True, True, None), (True, False, True)] for g in (True, False)] + [(True, True, True, True), (False, False, True, True)]
    df = frame(spark, [(i, *c) for i, c in enumerate(cases)], "i int, g boolean, p boolean, parsed boolean, ok boolean")
    cell = M.outcome(F.col("g"), F.col("p"), policy=policy, parsed=F.col("parsed"), right_target=F.col("ok"))
    assert [r[0] or "-" for r in df.orderBy("i").select(cell).collect()] == want.split()


def test_auc_equals_all_pairs(spark):
    rng = random.Random(1)
    rows = [(g, int(rng.random() < 0.4), rng.randrange(6)) for g in ("a", "b") for _ in range(60)] + [("one", 1, 3)]
    got = {r.k: r.auc for r in M.auc(frame(spark, rows, "k string, y int, s int"), "y", "s", ["k"]).collect()}
    for k in ("a", "b"):
        pos, neg = ([s for g, y, s in rows if g == k and y == v] for v in (1, 0))
        want = sum((p > n) + (p == n) / 2 for p in pos for n in neg) / len(pos) / len(neg)
        assert abs(got[k] - want) < 1e-12
    assert got["one"] is None


def test_observed_or_fixed_labels(spark):
    matrix = M.confusion_matrix(frame(spark, [(0, 0), (0, 1)], "g int, p int"), F.col("g"), F.col("p"), range(3))
    assert M.class_metrics(matrix).count() == 3 and M.class_metrics(matrix, labels="observed").count() == 2
    assert matrix.agg(F.sum("n")).first()[0] == 2


# aggregates


def test_nearest_rank_rounds_half_to_even(spark):
    df = frame(spark, [("a", x) for x in (1, 2, 3, 4)] + [("b", 7), ("b", None)], "k string, x int")
    got = {r.k: (r.n, r.p50) for r in A.nearest_rank(df, ["k"], "x", [50]).collect()}
    assert got == {"a": (4, 3), "b": (1, 7)}
    rng = random.Random(2)
    values = [rng.randrange(9) for _ in range(101)]
    got = A.nearest_rank(frame(spark, [(v,) for v in values], "x int"), [], "x", [0, 10, 33, 90, 99, 100]).first()
    assert [got[f"p{p}"] for p in (0, 10, 33, 90, 99, 100)] == [sorted(values)[round(p / 100 * 100)] for p in (0, 10, 33, 90, 99, 100)]


def test_small_groups_have_no_threshold(spark):
    df = frame(spark, [("a", float(x)) for x in range(30)] + [("b", 1.0), ("b", -1.0)], "k string, x double")
    got = A.above_group_percentile(df, ["k"], "x", 90)
    assert sorted(r.x for r in got.where("k = 'a'").collect()) == [26.0, 27.0, 28.0, 29.0]
    assert [r.x for r in got.where("k = 'b'").collect()] == [1.0]


def test_linear_quantiles(spark):
    got = A.linear_quantiles(frame(spark, [(x,) for x in (1, 2, 3, 4, 10)], "x int"), [], "x", (1 / 3,), ("q",)).first()["q"]
    assert abs(got - 7 / 3) < 1e-9


def test_entity_map(spark):
    rows = [(1, "a", "absent", 1), (1, "a", "present", 2), (1, "b", "unknown", 3), (2, "a", "unknown", 4), (2, "a", "absent", 5)]
    got = {r.e: (r.states, r.conflicts, r.duplicates) for r in A.entity_map(frame(spark, rows, "e int, k string, s string, o int"), "e", "k", "s", "o").collect()}
    assert got == {1: ({"a": "present", "b": "unknown"}, 1, 1), 2: ({"a": "unknown"}, 1, 1)}


def test_examples_are_bounded(spark):
    df = frame(spark, [(i % 2, i) for i in range(20)], "k int, i int")
    assert rows_of(A.examples(df, ["k"], [F.col("i")], 2), "i") == [(0, 0), (1, 1), (0, 2), (1, 3)]


# sampling


def test_cyclic_take(spark):
    df = frame(spark, [("a",), ("b",), ("c",)], "x string")
    got = S.cyclic_take(df.withColumn("k", F.lit(1)), ["k"], [F.col("x")], 7).orderBy("cycle", "x")
    assert [r.x for r in got.collect()] == list("abcabca")


def test_round_robin_equals_the_procedure(spark):
    rng = random.Random(3)
    for _ in range(6):
        rows = [(rng.randrange(5), i) for i in range(rng.randint(1, 14))]
        views, quota, used, want, p = rng.randint(1, 4), rng.randint(1, 25), Counter(), [], 0
        while len(want) < quota and p < views:
            for e, i in rows:
                if len(want) < quota and used[e] < views:
                    used[e] += 1
                    want.append((p, i, used[e]))
            p += 1
        got = S.round_robin_views(frame(spark, rows, "e int, i int"), "e", [F.col("i")], views, quota)
        assert sorted((r["pass"], r.i, r.view_index) for r in got.collect()) == sorted(want)


def test_tier_mix_backfills(spark):
    rows = [("S0", i) for i in range(3)] + [("S1", 10 + i) for i in range(20)]
    got = S.tier_mix(frame(spark, rows, "t string, i int").withColumn("k", F.lit(0)), ["k"], "t", [("S0", 0.5), ("S1", 0.5)], [F.col("i")], 12)
    kept = [(r.t, r.i, r.phase) for r in got.collect()]
    assert len(kept) == 12 and sum(t == "S0" for t, _, _ in kept) == 3
    assert sum(p == 1 for _, _, p in kept) == 3
    twice = S.tier_mix(frame(spark, rows[:3], "t string, i int").withColumn("k", F.lit(0)), ["k"], "t", [("S0", 1.0)], [F.col("i")], 7)
    assert Counter(r.i for r in twice.collect()) == {0: 3, 1: 2, 2: 2}


def test_splits_do_not_depend_on_partitions(spark):
    df = frame(spark, [(i, f"s{i % 3}") for i in range(200)], "i int, s string")
    split = lambda d: rows_of(S.hash_split(d, F.col("i").cast("string"), 30, override=F.when(F.col("s") == "s1", "val")), "i")
    assert split(df) == split(df.repartition(7))
    assert all(r[2] == "val" for r in split(df) if r[1] == "s1")


def test_split_propagation_is_disjoint(spark):
    df = frame(spark, [(e, i) for i in range(40) for e in (i % 9,)], "e int, i int")
    got = S.propagate_split(df, "e", F.col("i") == 13)
    assert {r.e for r in got.where("split = 'val'").collect()} == {13 % 9}


def test_budgets(spark):
    df = frame(spark, [(c, i) for c in "abc" for i in range(10)], "c string, i int")
    budgets = frame(spark, [("a", 3), ("b", 0)], "c string, budget int")
    assert Counter(r.c for r in S.capped(df, budgets, "c", [F.col("i")]).collect()) == {"a": 3, "c": 10}
    assert S.even_budgets("abc", 8) == [("a", 3), ("b", 3), ("c", 2)]
    assert S.share_budgets([("a", 0.35), ("b", 0.15), ("c", 0.5)], 10) == [("a", 4), ("b", 2), ("c", 4)]
    assert Counter(r.c for r in S.take_budgets(df, "c", [("a", 12), ("b", 2)], [F.col("i")]).collect()) == {"a": 12, "b": 2}
    with pytest.raises(ValueError, match="c has 10 of 11"):
        S.require_quota(df, "c", [("a", 10), ("c", 11)])
    assert S.require_quota(df, "c", [("a", 10)]) is df


def test_balanced(spark):
    df = frame(spark, [(i, i < 4) for i in range(30)], "i int, p boolean").withColumn("k", F.lit(1))
    assert Counter(r.p for r in S.balanced(df, ["k"], F.col("p"), [F.col("i")]).collect()) == {True: 4, False: 4}
    assert Counter(r.p for r in S.balanced(df, ["k"], F.col("p"), [F.col("i")], ratio=4).collect()) == {True: 4, False: 16}


def test_candidate_selection(spark):
    df = frame(spark, [("a", 0.5, 0.9), ("b", 0.6, 0.7), ("c", 0.6, 0.8), ("d", 0.9, 0.1)], "name string, f1 double, recall double")
    assert rows_of(S.select_candidate(df, F.col("recall") > 0.5, ["f1", "recall"])) == [("c", 0.6, 0.8)]
    assert rows_of(S.select_candidate(df, F.col("recall") > 2, ["f1"])) == []


# joins, rules, sets, shapes


def test_positional_zip(spark):
    a, b = frame(spark, [(0, "x"), (1, "y")], "idx int, a string"), frame(spark, [(0, "p")], "idx int, b string")
    assert rows_of(J.zip_by_place(a, b, "idx")) == [(0, "x", "p")]
    with pytest.raises(Exception, match="idx 1"):
        J.zip_by_place(a, b, "idx", strict=True).collect()
    assert J.zip_by_place(a, a.withColumnRenamed("a", "b"), "idx", strict=True).count() == 2


def test_priority_sources(spark):
    left = frame(spark, [(1,), (2,), (3,)], "k int")
    a, b = frame(spark, [(1, "a1")], "k int, v string"), frame(spark, [(1, "b1"), (2, "b2")], "k int, v string")
    assert rows_of(J.first_of(left, [("a", a), ("b", b)], ["k"], "v", default="-"), "k") == [(1, "a1", "a"), (2, "b2", "b"), (3, "-", "missing")]
    assert rows_of(J.fill_missing(frame(spark, [(1, None), (2, "own")], "k int, v string"), b, ["k"], "v"), "k") == [(1, "b1"), (2, "own")]


def test_hard_negatives(spark):
    rows = [(1, "MA", "absent"), (1, "HE", "present"), (2, "MA", "absent"), (2, "HE", "absent"), (3, "MA", "present"), (3, "HE", "present")]
    got = J.hard_negatives(frame(spark, rows, "e int, k string, s string"), "e", "k", "s", {"MA": ["HE"], "HE": ["MA"]})
    assert {(r.e, r.k) for r in got.where("is_hard").collect()} == {(1, "MA")}


def test_rules_see_values_from_before(spark):
    df = frame(spark, [(1, "present", 2), (2, "present", 9)], "i int, s string, n int")
    first = [L.Rule("low", F.col("n") < 5, {"s": F.lit("unknown")}), L.Rule("any", F.col("s") == "present")]
    second = [L.Rule("gone", F.col("s") == "unknown")]
    got = {r.i: (r.s, r.flags) for r in L.apply_stages(df, [first, second]).collect()}
    assert got == {1: ("unknown", ["any", "gone", "low"]), 2: ("present", ["any"])}


def test_decision_list_takes_the_first_step(spark):
    steps = [("A", F.col("n") > 5, {"w": F.lit("big")}), ("B", F.col("n") > 1, {})]
    got = frame(spark, [(9,), (3,), (0,)], "n int").select("n", L.decision_list(steps, {"w": F.lit("-")}).alias("d")).select("n", "d.*")
    assert rows_of(got, "n") == [(0, None, "-"), (3, "B", "-"), (9, "A", "big")]


def test_sets(spark):
    a, b = frame(spark, [(1, "x"), (2, "y")], "k int, v string"), frame(spark, [(2, "z"), (3, None)], "k int, v string")
    assert rows_of(U.later_wins([a, b], ["k"]), "k") == [(1, "x"), (2, "z"), (3, None)]
    assert rows_of(U.overlap_audit({"a": a, "b": b, "c": a.limit(0)}, "k"), "left", "right") == [("a", "b", 1), ("a", "c", 0), ("b", "c", 0)]
    tagged = U.tagged_union({"a": a, "b": b.drop("v")})
    assert tagged.where("origin = 'b' and v is null").count() == 2
    mixed = U.mixture([("a", a, 0.25), ("b", b, 0.75)], 8, [F.col("k")])
    assert Counter(r.component for r in mixed.collect()) == {"a": 2, "b": 6}
    assert rows_of(U.keys_difference(a.select("k"), b.select("k"))) == [(1,)] and U.keys_union(a.select("k"), b.select("k")).count() == 3


def test_shapes(spark):
    df = frame(spark, [(1, {"a": (1, "x"), "b": (2, "y")})], "i int, m map<string,struct<n:int,t:string>>")
    assert rows_of(R.unpivot_map(df, ["i"], "m"), "kind") == [(1, "a", 1, "x"), (1, "b", 2, "y")]
    full = R.complete(frame(spark, [(1, "a", "present")], "i int, k string, s string"), ["i"], "k", ["a", "b"], {"s": F.lit("absent")})
    assert rows_of(full, "k") == [(1, "a", "present"), (1, "b", "absent")]
    chat = R.conversation(frame(spark, [(1, 2, "b", "two"), (1, 1, "a", "one")], "c int, turn int, role string, text string"), "c", "turn", "role", "text").first()
    assert [(m.role, m.content) for m in chat.messages] == [("a", "one"), ("b", "two")]
    out = R.aligned(frame(spark, [(1, "x")], "a int, extra string"), spark.createDataFrame([], "a long, b string").schema)
    assert out.columns == ["a", "b"] and rows_of(out) == [(1, None)]
    sft = R.sft_rows(frame(spark, [("r1", "q")], "rid string, q string"), F.lit("s"), F.col("q"), F.lit("a"), F.array(F.lit("p")), ["rid"]).first()
    assert [m.role for m in sft.messages] == ["system", "user", "assistant"] and sft.meta.rid == "r1" and all("r1" not in m.content for m in sft.messages)
    copies = J.expand_copies(frame(spark, [("r", "p0")], "rid string, path string"), "rid", frame(spark, [("r", ["p1", "p2"])], "rid string, ps array<string>"), ["rid"], "ps", "path")
    assert [(r.rid, r.path) for r in copies.orderBy("copy").collect()] == [("r", "p0"), ("r__aug1", "p1"), ("r__aug2", "p2")]


def test_progress(spark):
    import datetime as dt

    start = dt.datetime(2024, 1, 1)
    df = frame(spark, [("a", start + dt.timedelta(seconds=2 * i)) for i in range(100)], "k string, at timestamp")
    got = P.throughput(df, ["k"], "at", 150).first()
    assert (got.done, got.rate, got.eta_seconds) == (100, 0.5, 100.0)
    status = frame(spark, [("a", start, "running"), ("a", start, "error"), ("b", start, "done")], "k string, at timestamp, s string")
    assert {r.k: r.s for r in P.latest_status(status, "k", "at", "s").collect()} == {"a": "error", "b": "done"}
    tasks, outputs = frame(spark, [("a",), ("b",), ("c",)], "k string"), frame(spark, [("a", 5), ("b", 0)], "k string, length long")
    assert sorted(r.k for r in P.unfinished(tasks, outputs, "k").collect()) == ["b", "c"]


def test_curation_plan_never_leaks(spark):
    docs = frame(spark, [(i, f"s{i % 5}", 100 * i) for i in range(80)], "doc_id long, source string, n_chars long")
    labels = frame(spark, [(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(70)], "doc_id long, quality int, toxic int")
    rows = curation.clean(curation.facts(docs, labels, "doc_id", ["quality", "toxic"]), [], [("S0", F.col("state") != "unknown")])
    out = curation.training_and_validation(rows, "doc_id", F.col("source"), 40, "x")
    by = {s: {r.doc_id for r in out.where(F.col("split") == s).collect()} for s in ("train", "val")}
    assert not by["train"] & by["val"]
    counts = Counter((r.kind, r.state) for r in out.where("split = 'train'").collect())
    assert all(counts[k, "present"] == counts[k, "absent"] for k in ("quality", "toxic"))
    metrics = {n: curation.score(rows, F.col("n_chars") > n, "kind") for n in (0, 4000)}
    table = curation.candidate_metrics({str(n): m for n, m in metrics.items()})
    assert curation.choose(table, table.where("name = '0'"), curation.Gate({"macro_recall": 0.0}, ("macro_f1",))).first()["name"] == "0"


def test_replay_ratio_and_quotas(spark):
    base = frame(spark, [(100, "a", True)], "i int, c string, p boolean")
    more = frame(spark, [(i, "ab"[i % 2], i % 5 == 0) for i in range(40)], "i int, c string, p boolean")
    out = S.replay_mix(base, more, ["c"], F.col("p"), [F.col("i")], 3).collect()
    assert Counter((r.role, r.p) for r in out) == {("replay", True): 1, ("added", True): 6, ("added", False): 6}
    classes = frame(spark, [(c, i) for c, n in (("x", 4), ("y", 20), ("z", 1)) for i in range(n)], "c string, i int")
    assert Counter(r.c for r in S.ratio_capped(classes, "c", "x", [("y", 2.0), ("z", 3.0)], [F.col("i")]).collect()) == {"x": 4, "y": 8, "z": 1}
    twice = classes.union(classes)
    used = S.quotas_with_roles(twice, "c", ["i"], [("y", "repair", 3), ("y", "anchor", 4)], [F.col("i")]).collect()
    assert sorted((r.role, r.i) for r in used) == [("anchor", 3), ("anchor", 4), ("anchor", 5), ("anchor", 6), ("repair", 0), ("repair", 1), ("repair", 2)]


def test_rounds_differ_and_are_whole(spark):
    df = frame(spark, [(1, i) for i in range(8)], "k int, i int")
    out = S.reshuffled_cycles(df, ["k"], F.col("i"), [F.col("i")], 20, "s").collect()
    assert Counter(r.cycle for r in out) == {0: 8, 1: 8, 2: 4}
    assert {r.i for r in out if r.cycle == 1} == set(range(8))


def test_plan_arguments(spark):
    assert curation.parse_plan(["MA:3:4", "HE:5", "EX"], (1, 2)) == {"MA": (3, 4), "HE": (5, 2), "EX": (1, 2)}
    with pytest.raises(ValueError, match="not CLASS"):
        curation.parse_plan([":3"])
    df = frame(spark, [(i,) for i in range(6)], "g int")
    assert rows_of(curation.selected(df, "g", "1, 3", [F.col("g")], 1)) == [(1,)] and curation.selected(df, "g", "all").count() == 6


def test_metrics_document(spark):
    counts = frame(spark, [("MA", 79, 98, 45, 3), ("HE", 168, 11, 26, 20), ("NV", 1, 1, 1, 1)], "k string, tp long, fp long, fn long, tn long")
    doc = M.metrics_document(M.binary_metrics(counts), "k", {"main": ["MA", "HE"], "rare": ["NV"]}).first()
    assert doc.n == 454 and sorted(doc.by_class) == ["HE", "MA", "NV"] and doc.by_class["NV"].tp == 1
    assert doc.rare_macro.f1 == 0.5 and abs(doc.main_macro.recall - (79 / 124 + 168 / 194) / 2) < 1e-12


def test_row_numbers_and_running_sums_over_ranges(spark):
    """A group with most rows, groups of one, NULL keys, both directions, and as many ranges as partitions."""
    from evidentia.operators import ordered

    rng = random.Random(11)
    rows = [(g, rng.randrange(10_000), i) for g, n in (("big", 700), ("small", 3), ("one", 1), (None, 40)) for i in range(n)]
    df = spark.createDataFrame(rows, "g string, v int, i int").repartition(3)
    for order, sign in ((F.desc("v"), -1), (F.col("v"), 1)):
        got = {(r.g, r.v, r.i): r.rn for r in ordered.row_numbers(df, ["g"], [order, F.col("i")], "rn").collect()}
        for g in ("big", "small", "one", None):
            own = sorted((r for r in rows if r[0] == g), key=lambda r: (sign * r[1], r[2]))
            assert [got[r] for r in own] == list(range(1, len(own) + 1))
    spread = df.groupBy("g", "v").agg(F.count("*").alias("c"))
    run = ordered.running_sums(spread, ["g"], "v", ["c"])
    for r in run.collect():
        own = [x[1] for x in rows if x[0] == r.g]
        assert (r.c_before, r.c_all) == (sum(v < r.v for v in own), len(own))
    assert run.count() == spread.count()
    scans = ordered.running_sums(spread, [], "v", ["c"])._jdf.queryExecution().optimizedPlan().toString()
    assert "LogicalRDD" not in scans  # the input is read once, before
    assert ordered.row_numbers(df.limit(0), ["g"], [F.col("v")], "rn").count() == 0
