import hashlib
import math
import random

import numpy as np
import pytest

from evidentia.llm import clustering
from evidentia.llm.queries import op13_weighted_lloyd


def brute(rows, k=40, rounds=5, size=64):
    """(vec_id, cluster, distance, cluster_inertia, inertia, digest) by Python's integers over all vectors."""
    kept = []
    for vec_id, v in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v):
            kept.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in v]))
    first = sorted(kept, key=lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1]))
    centroids = [q for _, q in first[:k]]

    def nearest(q):
        return min((sum((a - b) ** 2 for a, b in zip(q, c, strict=True)), i) for i, c in enumerate(centroids))

    for _ in range(rounds):
        groups = {}
        for _, q in kept:
            groups.setdefault(nearest(q)[1], []).append(q)
        for i, g in groups.items():
            centroids[i] = [sum(col) // len(g) for col in zip(*g, strict=True)]
    found = [(vec_id, *nearest(q)[::-1]) for vec_id, q in kept]
    inertia = {}
    for _, c, d in found:
        inertia[c] = inertia.get(c, 0) + d
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, inertia[c], sum(inertia.values()), digests[c]) for i, c, d in found), key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)


@pytest.fixture(scope="module")
def vectors():
    rng = random.Random(8)
    some = [[rng.gauss(0, 0.2) for _ in range(64)] for _ in range(120)]
    rows = [(i, v, i % 3) for i, v in enumerate(some)]
    rows += [(500 + i, some[3], 0) for i in range(200)] + [(1000 + i, [x + 0.001 for x in some[i]], None) for i in range(20)]
    bad = [None, [], some[0][:63], [*some[0], 0.0], [None, *some[0][1:]], [math.nan, *some[0][1:]], [math.inf, *some[0][1:]], [-math.inf, *some[0][1:]]]
    rows += [(2000 + i, v, 1) for i, v in enumerate(bad)]
    return [*rows, (None, some[5], 1), (7, some[8], 1), (7, some[7], 1), (3000, [0.0] * 64, 1), (3001, [-0.0] * 64, 1), (3002, [-1e-9] * 64, 1)]


def tuples(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_equals_brute_force(spark, vectors, tmp_path):
    frame(spark, vectors).write.parquet(f"{tmp_path}/embeddings.parquet")
    assert tuples(op13_weighted_lloyd(spark, str(tmp_path))) == brute([r[:2] for r in vectors])


@pytest.mark.parametrize("scale", [1e3, 1e5, 1e8])
def test_large_components_are_exact(spark, scale):
    rng = random.Random(2)
    rows = [(i, [float(np.float32(rng.gauss(0, scale))) for _ in range(4)], 0) for i in range(60)]
    got = clustering.clustered(frame(spark, rows), k=7, size=4).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
    assert tuples(got) == [(*r[:2], *(min(x, (1 << 63) - 1) for x in r[2:5]), r[5]) for r in brute([r[:2] for r in rows], k=7, size=4)]


def test_fewer_vectors_than_centroids_and_ties(spark):
    rows = [(i, [float(i // 2)] * 64, 0) for i in range(6)]
    got = clustering.clustered(frame(spark, rows))
    assert got.select("distance").distinct().collect()[0][0] == 0
    assert tuples(got.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")) == brute([r[:2] for r in rows])


def test_distinct_vectors_alone_are_assigned(spark, vectors):
    own = clustering.quantised(frame(spark, vectors))
    distinct = own.groupBy("q").count()
    assert distinct.count() < own.count() - 190


def test_odd_tables(spark):
    assert clustering.clustered(frame(spark, []).limit(0)).count() == 0
    assert clustering.clustered(frame(spark, [(1, None, 1), (2, [1.0], 1)])).count() == 0
    clash = spark.createDataFrame([(1, [0.5] * 64, 3, "x", 9)], "vec_id long, embedding array<float>, cluster int, q string, n long")
    assert clustering.clustered(clash).select("cluster", "distance").first() == (0, 0)
