import random
import re
from collections import Counter, defaultdict

import numpy as np

from evidentia.llm import neardup
from evidentia.llm.graph import components

from .conftest import prose


def shingles(text):
    words = re.findall(r"\w+", (text or "").lower())
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def brute(rows, similarity=0.8):
    sets = defaultdict(list)
    for i, t in rows:
        s = shingles(t)
        sets[s if s else ("raw", t or "")].append(i)
    keys, parent = list(sets), {k: k for k in sets}

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for n, a in enumerate(keys):
        for b in keys[:n]:
            if isinstance(a, frozenset) and isinstance(b, frozenset) and len(a & b) >= similarity * len(a | b) - 1e-9:
                parent[root(a)] = root(b)
    groups = defaultdict(list)
    for k in keys:
        groups[root(k)] += sets[k]
    return {i: min(g) for g in groups.values() for i in g}


def test_classes_equal_brute_force(docs, corpus):
    got = {r.doc_id: r for r in neardup.near_duplicates(docs).collect()}
    assert {i: r.class_id for i, r in got.items()} == brute(corpus)
    sizes = Counter(r.class_id for r in got.values())
    assert all(r.class_size == sizes[r.class_id] for r in got.values())
    assert sum(r.kept for r in got.values()) == len(sizes)


def test_links_beyond_a_buckets_centre(spark, corpus):
    """Near copies of one text that are not all near each other, in blocks smaller than the group."""
    base = corpus[8][1].split()
    rows = []
    for i in range(60):
        words = list(base)
        words[(7 * i) % len(words)] = f"a{i}"
        words[(11 * i + 3) % len(words)] = f"b{i}"
        rows.append((i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(docs, block=16).collect()}
    assert got == brute(rows)


def test_pairs_that_differ_in_counts(spark):
    """A passage that one copy repeats many times lowers the probability Jaccard, not the Jaccard similarity."""
    rng, rows = random.Random(4), []
    for i in range(60):
        head, passage = prose(rng, 64), prose(rng, 64)
        rows.append((2 * i, f"{head} {passage} {prose(rng, 12)}"))
        rows.append((2 * i + 1, f"{head} {' '.join([passage] * 50)} {prose(rng, 12)}"))
    truth = brute(rows)
    assert len(set(truth.values())) == 60
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in neardup.near_duplicates(docs).collect()} == truth


def test_one_of_each_keeps_columns(docs, corpus):
    kept = neardup.one_of_each(docs)
    assert kept.columns == docs.columns
    truth = brute(corpus)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(truth.values()))


def test_odd_rows(odd, none):
    found = neardup.near_duplicates(odd).collect()
    assert len(found) == 5
    assert neardup.one_of_each(odd).count() == 4
    assert neardup.near_duplicates(none).count() == 0
    assert neardup.one_of_each(none).columns == none.columns


def test_register_agreement_is_probability_jaccard():
    rng = np.random.default_rng(0)
    shared, a, b = (rng.integers(1, 1 << 62, n, dtype=np.int64).astype(np.uint64) for n in (60, 30, 10))
    weights = dict(zip(shared.tolist(), rng.uniform(1, 3, 60), strict=True))
    make = lambda extra: (np.concatenate((shared, extra)), np.array([*weights.values(), *np.full(len(extra), 1.5)]))
    x, y = make(a), make(b)
    registers = neardup.probminhash([x, y], 4000)
    wx, wy = dict(zip(x[0].tolist(), x[1], strict=True)), dict(zip(y[0].tolist(), y[1], strict=True))
    expected = 0.0
    for d in wx.keys() & wy.keys():
        expected += 1 / sum(max(wx.get(e, 0) / wx[d], wy.get(e, 0) / wy[d]) for e in wx.keys() | wy.keys())
    assert abs((registers[0] == registers[1]).mean() - expected) < 0.03


def test_components_of_a_path(spark):
    n = 50
    edges = spark.createDataFrame([(i, i + 1) for i in range(n)] + [(100, 101), (100, 100)], "a long, b long")
    got = {r.node: r.component for r in components(edges).collect()}
    assert got == {**{i: 0 for i in range(n + 1)}, 100: 100, 101: 100}
