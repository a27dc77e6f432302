import random

import numpy as np
import pytest

import corpus_pipeline
from evidentia.llm import pii
from evidentia.llm import queries as text_queries

from .conftest import edited, prose
from .test_neardup import brute
from .test_tokens import check_pieces


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """documents, labels and benchmark with cases planted in known places."""
    rng = random.Random(12)
    rows, labels = [], []
    item = prose(rng, 40)
    for i in range(160):
        text = prose(rng, rng.randint(30, 120)).capitalize() + "."
        kind = "plain"
        if i % 10 == 3:
            text, kind = " ".join(w + "***" for w in text.split()), "junk"
        elif i % 10 == 5:
            text = edited(rng, rows[i - 1][1], 1) if len(rows[i - 1][1].split()) > 60 else rows[i - 1][1]
        elif i % 20 == 7:
            text = f"{text} {item} {prose(rng, 20)}"
        elif i % 20 == 9:
            text = f"{text} write to jo.{i}@mail.example.com today"
        rows.append((i, text, "en", f"s{i % 4}", len(text), "x"))
        labels.append((i, int(kind != "junk"), 0))
    folder = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, extra string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return str(folder), {r[0]: r[1] for r in rows}, item


def test_stages_one_by_one(spark, tables):
    folder, texts, item = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "minhash_near_dedup", "benchmark_decontamination", "pii", "packing"]
    for name, stage in corpus_pipeline.STAGES:
        before = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
        out = stage(spark, docs, folder)
        if name == "packing":
            check_pieces(out.collect(), before)
            break
        assert out.columns == docs.columns
        after = {r.doc_id: r.text for r in out.select("doc_id", "text").collect()}
        if name == "quality_classifier":
            junk = {i for i in texts if i % 10 == 3}
            assert len(junk & set(after)) <= 2 and len(after) >= 0.95 * (len(texts) - len(junk))
        elif name == "minhash_near_dedup":
            assert set(after) == set(brute(before.items()).values())
        elif name == "benchmark_decontamination":
            assert set(after) == {i for i, t in before.items() if item not in t}
        else:
            assert set(after) == set(before)
            model = pii.trained()
            assert after == {i: pii.masked(t, next(pii.all_spans([t], model))[1]) for i, t in before.items()}
        docs = out


def test_run_equals_its_stages_and_the_query(spark, tables):
    folder = tables[0]
    rows = [tuple(r) for r in corpus_pipeline.run(spark, folder).drop("ids").collect()]
    again = [tuple(r) for r in text_queries.queries()["pipeline"](spark, folder).drop("ids").collect()]
    assert sorted(rows) == sorted(again) and len(rows) > 90
    assert np.unique([r[0] for r in rows]).size > 90


def test_odd_and_empty_inputs(spark, tables, odd, none):
    folder = tables[0]
    for given in (odd, none):
        docs = given
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, folder)
            assert name == "packing" or out.columns == docs.columns
            docs = out
        assert docs.count() >= 0
