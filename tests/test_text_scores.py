"""Answer likeness and likelihood against plain counting."""

import math
import os
import random
from collections import Counter

import duckdb
import pytest

import __spark_entry__
from evidentia.operators import likelihood, similarity


def table(a, b):
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    return best[-1][-1]


def test_common_subsequence_equals_the_table():
    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcü漢") for _ in range(rng.randrange(90))) for _ in range(2))
        assert similarity.common_subsequence(a, b) == table(a, b)
    assert similarity.common_subsequence("ab" * 20_000, "ba" * 20_000) == 39_999


def scores(a, b):
    """BLEU with misses smoothed in turn, and ROUGE, as they are defined."""
    def shared(n):
        x, y = (Counter(s[i : i + n] for i in range(len(s) - n + 1)) for s in (a, b))
        return sum((x & y).values())

    logs, misses = 0.0, 0
    for n in range(1, 5):
        possible = max(1, len(a) - n + 1)
        if shared(n):
            logs += math.log(shared(n) / possible)
        else:
            misses += 1
            logs += math.log(1 / (2**misses * possible))
    bleu = 0.0 if not a or not shared(1) else (1.0 if len(a) > len(b) else math.exp(1 - len(b) / len(a))) * math.exp(logs / 4)
    f1 = lambda s, x, y: 2 * s / (x + y) if s else 0.0
    rouge = [f1(shared(n), max(0, len(a) - n + 1), max(0, len(b) - n + 1)) for n in (1, 2)]
    return [round(100 * v, 4) for v in (bleu, *rouge, f1(table(a, b), len(a), len(b)))]


def test_scores(spark):
    rng = random.Random(2)
    pairs = [("".join(rng.choice("abcd ü漢") for _ in range(rng.randrange(25))), "".join(rng.choice("abcd ü漢") for _ in range(rng.randrange(25)))) for _ in range(150)]
    pairs += [("same text", "same text"), ("", ""), ("", "x"), ("x", ""), ("ab", "ba"), (None, None), (None, "a"), ("a", None), ("abc", "xyz")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "id int, answer string, reference string")
    for r in similarity.text_similarity(df, "answer", "reference").collect():
        want = scores(r.answer or "", r.reference or "")
        assert [r.bleu_4, r.rouge_1, r.rouge_2, r.rouge_l] == pytest.approx(want, abs=1.5e-4), (r.answer, r.reference)


def test_likelihood(spark):
    rng = random.Random(3)
    vocabulary = "red green blue one two three .".split()
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(12))) for _ in range(60)] + [None, "  \t "]
    counts, total = Counter(), 0
    for t in texts:
        w = (t or "").split()
        total += len(w)
        for n in (1, 2, 3):
            counts.update(tuple(w[i : i + n]) for i in range(len(w) - n + 1))

    def p(run):
        if len(run) == 1:
            return counts[run] / total if counts[run] else 1 / (total + 1)
        return counts[run] / counts[run[:-1]] if counts[run] else 0.4 * p(run[1:])

    rows = [(i, " ".join(rng.choice([*vocabulary, "new"]) for _ in range(rng.randrange(4))), " ".join(rng.choice([*vocabulary, "odd"]) for _ in range(rng.randrange(6)))) for i in range(80)] + [(100, None, "red red"), (101, "red", None)]
    model = likelihood.ngram_model(spark.createDataFrame([(t,) for t in texts], "text string"), "text")
    got = {r.id: (r.n_words, r.score) for r in likelihood.candidate_likelihood(spark.createDataFrame(rows, "id int, q string, a string"), ["id"], "q", "a", model).collect()}
    for i, q, a in rows:
        before, said = (q or "").split()[-2:], (a or "").split()
        whole = before + said
        logs = [math.log(p(tuple(whole[max(0, len(before) + k - 2) : len(before) + k + 1]))) for k in range(len(said))]
        assert got[i][0] == len(said)
        assert got[i][1] is None if not logs else got[i][1] == pytest.approx(sum(logs) / len(logs))
    empty = likelihood.ngram_model(spark.createDataFrame([], "text string"), "text")
    assert likelihood.candidate_likelihood(spark.createDataFrame(rows, "id int, q string, a string"), ["id"], "q", "a", empty).count() == 82


def test_model_of_asked_ngrams(spark):
    texts = spark.createDataFrame([("a b a b c",), ("b",), (None,)], "text string")
    asked = spark.createDataFrame([(g,) for g in ("a", "a b", "a b c", "b c x", "b c", "b", "z")], "gram string")
    got = sorted(map(tuple, likelihood.ngram_model(texts, "text", only=asked).collect()))
    assert got == [(0, "", 6), (1, "a", 2), (1, "b", 3), (2, "a b", 2), (2, "b c", 1), (3, "a b c", 1)]
    asked = likelihood.asked_grams(spark.createDataFrame([("p a b", "c a")], "q string, a string"), "q", "a")
    assert sorted(r.gram for r in asked.collect()) == ["a", "a b", "a b c", "b", "b c", "b c a", "c", "c a"]


def test_context_that_no_answer_has(spark):
    texts = spark.createDataFrame([("x b c",), ("b d",), ("c",)], "text string")
    rows = spark.createDataFrame([(1, "w x b", "c b d"), (2, "", "b d q")], "id int, q string, a string")
    models = [likelihood.ngram_model(texts, "text"), likelihood.ngram_model(texts, "text", only=likelihood.asked_grams(rows, "q", "a")), likelihood.model_for(texts, "text", rows, "q", "a")]
    got = [sorted(map(tuple, likelihood.candidate_likelihood(rows, ["id"], "q", "a", m).collect())) for m in models]
    want = [(1, (math.log(1 / 1) + math.log(0.16 * 2 / 6) + math.log(0.4 * 1 / 2)) / 3), (2, (math.log(2 / 6) + math.log(1 / 2) + math.log(0.16 / 7)) / 3)]
    for scores in got:
        assert [(r[0], r[2]) for r in scores] == [(i, pytest.approx(s)) for i, s in want]


def test_scores_of_odd_conversations_equal_the_sql(spark, tmp_path):
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choice("red green blue one two , .".split()) for _ in range(rng.randrange(n)))
    texts = [(i, say(30)) for i in range(60)] + [(60, None), (61, " \t "), (62, "x b c")]
    turns = [(c, t, "user", say(9)) for c in range(12) for t in range(4) if (c, t) != (3, 2)]
    # a prompt and an answer without text, an answer of white space, a repeated row, a context of its own, a long answer
    turns += [(20, 0, "user", None), (20, 1, "user", "red one"), (20, 2, "user", None), (21, 0, "user", "one"), (21, 1, "user", " \n"), (21, 2, "user", "two")]
    turns += [(22, 0, "user", "red two"), (22, 0, "user", "red two"), (22, 1, "user", "green"), (23, 0, "user", "w x b"), (23, 1, "user", "c"), (24, 0, "user", "one"), (24, 1, "user", say(20) + " red" * 3000)]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(turns, "conv_id long, turn int, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    for name in ("answer_likelihood", "likelihood_auc"):
        found = con.execute(__spark_entry__.oracle_sql()[name])
        columns = [d[0] for d in found.description]
        got = [tuple(r[c] for c in columns) for r in __spark_entry__.queries()[name](spark, str(tmp_path)).collect()]
        assert sorted(got) == sorted(found.fetchall())


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="needs the driver's tables")
def test_likelihood_takes_little_disk(spark, tmp_path_factory):
    sf, env = "/root/testdata/sf0.01", spark.sparkContext._jvm.org.apache.spark.SparkEnv.get()
    shared = spark.sparkContext.getConf().get("spark.checkpoint.dir").removeprefix("file://")

    def held():
        files = env.blockManager().diskBlockManager().getAllFiles()
        local = {files.apply(i).getPath(): files.apply(i).length() for i in range(files.size())}
        return local | {f"{d}/{x}": os.path.getsize(f"{d}/{x}") for d, _, names in os.walk(shared) for x in names}

    before = held()
    assert __spark_entry__.queries()["likelihood_auc"](spark, sf).count() == 1
    size = sum(n for f, n in held().items() if f not in before)
    assert size < 3 * sum(os.path.getsize(f"{sf}/{t}.parquet") for t in ("documents", "conversations"))
