"""Centroid clustering of vectors by weighted deduplication.

Vectors are quantised to integers and identical ones are grouped, with how often each occurs. Lloyd's rounds run on the
distinct vectors alone: a task gives every distinct vector to its nearest centroid and sums the vectors of each
centroid times their multiplicities, so that a round sends at most one row per task and centroid. All sums and
distances are integers, so the result doesn't depend on how rows are dealt. Last, the distinct vectors' assignments are
joined back to the vec_ids.

A vector is kept if it has `size` components, none null or non-finite; a component x becomes floor(256 * x). The first
centroids are the `k` kept vectors with the smallest sha256 of "2:<vec_id>". A round gives each vector to the nearest
centroid (squared Euclidean distance, the smaller number in a tie) and moves each centroid that has vectors to the
floor of their componentwise mean.

The distinct vectors' rows never meet in one task; centroids (k vectors) are the only thing that the driver holds or
sends to all tasks. A vector of which there are very many copies is counted in each partition before it is shuffled.

Cases: null, short and long vectors, and those with a null, NaN or infinite component, are left out; a null vec_id
counts as the empty text for the first centroids and stays a row; rows with the same vec_id are rows of their own, in
the order of their vectors where the first centroids tie; fewer kept vectors than `k` give fewer centroids; equal
centroids keep their numbers, and the later ones stay empty; no kept vector gives no rows. Components of 2**55 or more
are held at the largest long, sums beyond 38 digits raise an error, and distances beyond a long are given as the largest
long. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import cut

SIZE = 64
K = 40
ROUNDS = 5
SCALE = 256
SEED = "2"
_MOST = (1 << 63) - 1
#: Magnitudes of components up to which distances are exact in doubles and in longs; beyond, Python's integers are used.
_IN_DOUBLES, _IN_LONGS = 1 << 20, 1 << 27


def quantised(vectors: DataFrame, *, size: int = SIZE) -> DataFrame:
    """(vec_id, q) of the vectors that are kept."""
    x = F.col("embedding")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < F.lit(float("inf"))))
    kept = vectors.where(F.coalesce((F.size(x) == size) & finite, F.lit(False)))
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(x, lambda e: F.floor(e.cast("double") * SCALE).cast("long")).alias("q"))


def first_centroids(vectors: DataFrame, k: int, seed: str) -> list[list[int]]:
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit("")))
    return [list(r.q) for r in vectors.orderBy(F.sha2(named, 256), "q").limit(k).select("q").collect()]


def distances(q: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Squared distances of the rows of q to the centroids, exact."""
    most = max((int(np.abs(a.astype(object)).max()) if a.dtype == object else int(max(abs(int(a.max())), abs(int(a.min()))))) for a in (q, centroids))
    if most <= _IN_DOUBLES:
        a, b = q.astype(np.float64), centroids.astype(np.float64)
        return ((a * a).sum(1)[:, None] - 2 * (a @ b.T) + (b * b).sum(1)[None]).astype(np.int64)
    kind = np.int64 if most <= _IN_LONGS else object
    a, b = q.astype(kind), centroids.astype(kind)
    return np.stack([((a - c) ** 2).sum(1) for c in b], 1)


def _batches(frames: Iterable[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    for frame in frames:
        if len(frame):
            yield frame, np.stack(frame["q"].to_numpy()).astype(np.int64)


def _moved(distinct: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The centroids after one round over the distinct vectors (q, n)."""
    size = centroids.shape[1]

    def sums(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        totals: dict[int, np.ndarray] = {}
        counts: dict[int, int] = {}
        for frame, q in _batches(frames):
            nearest = np.argmin(distances(q, centroids), 1)
            n = frame["n"].to_numpy()
            exact = np.int64 if int(np.abs(q.astype(object)).max()) * int(n.sum()) < _MOST else object
            weighted = q.astype(exact) * n.astype(exact)[:, None]
            for c in np.unique(nearest):
                own = nearest == c
                totals[c] = totals.get(c, 0) + weighted[own].sum(0).astype(object)
                counts[c] = counts.get(c, 0) + int(n[own].sum())
        if totals:
            yield pd.DataFrame({"c": list(totals), "n": list(counts.values()), "s": [[Decimal(int(v)) for v in t] for t in totals.values()]})

    parts = distinct.mapInPandas(sums, "c int, n long, s array<decimal(38,0)>")
    added = parts.groupBy("c").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n"), *[F.sum(F.col("s")[i]).alias(f"s{i}") for i in range(size)])
    out = centroids.astype(object)
    for r in added.collect():  # a row per centroid
        out[r.c] = [int(r[f"s{i}"]) // int(r.n) for i in range(size)]
    return out


def assigned(distinct: DataFrame, centroids: np.ndarray) -> DataFrame:
    """(q, n, cluster, distance) of the distinct vectors."""

    def nearest(frames: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame, q in _batches(frames):
            far = distances(q, centroids)
            best = np.argmin(far, 1)
            own = far[np.arange(len(q)), best]
            yield frame.assign(cluster=best.astype(np.int32), distance=[min(int(d), _MOST) for d in own])

    return distinct.mapInPandas(nearest, "q array<long>, n long, cluster int, distance long")


def clustered(vectors: DataFrame, *, k: int = K, rounds: int = ROUNDS, seed: str = SEED, size: int = SIZE) -> DataFrame:
    """One row per kept vector: vec_id, cluster, distance, cluster_inertia, inertia, centroid and centroid_sha256."""
    spark = vectors.sparkSession
    own = quantised(vectors, size=size)
    distinct = cut(own.groupBy("q").agg(F.count("*").alias("n")))
    first = first_centroids(own, k, seed)
    if not first:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    centroids = np.array(first, dtype=object)
    for _ in range(rounds):
        centroids = _moved(distinct, centroids)
    found = cut(assigned(distinct, centroids))
    exact = (F.col("distance").cast("decimal(38,0)") * F.col("n").cast("decimal(38,0)")).cast("decimal(38,0)")
    inertia = {r.cluster: int(r.s) for r in found.groupBy("cluster").agg(F.sum(exact).alias("s")).collect()}  # a row per centroid
    total = min(sum(inertia.values()), _MOST)
    rows = []
    for c, values in enumerate(centroids):
        values = [int(v) for v in values]
        rows.append((c, min(inertia.get(c, 0), _MOST), total, values, hashlib.sha256(",".join(map(str, values)).encode()).hexdigest()))
    clusters = spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid array<long>, centroid_sha256 string")
    return own.join(found.drop("n"), "q").join(F.broadcast(clusters), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "centroid_sha256")


def oracle_sql(*, k: int = K, rounds: int = ROUNDS, seed: str = SEED, size: int = SIZE) -> str:
    """The same as SQL, round by round, over all vectors instead of distinct ones."""
    near = """
  SELECT id, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS d FROM (
    SELECT v.id, c.cluster, list_sum(list_transform(list_zip(v.q, c.q), lambda x: (x[1] - x[2]) * (x[1] - x[2])))::BIGINT AS d FROM v, c{r} c
  ) GROUP BY id"""
    out = f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS q FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
), c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('{seed}:' || coalesce(vec_id::VARCHAR, '')), q) - 1 AS cluster, q FROM v QUALIFY cluster < {k}
)"""
    for r in range(rounds):
        out += f""", a{r} AS MATERIALIZED ({near.format(r=r)}
), m{r} AS (
  SELECT cluster, list(m ORDER BY i) AS q FROM (
    SELECT a.cluster, i, (sum(v.q[i]) - ((sum(v.q[i]) % count(*)) + count(*)) % count(*)) // count(*) AS m
    FROM v JOIN a{r} a USING (id), range(1, {size} + 1) t(i) GROUP BY a.cluster, i) GROUP BY cluster
), c{r + 1} AS MATERIALIZED (SELECT c.cluster, coalesce(m.q, c.q)::BIGINT[] AS q FROM c{r} c LEFT JOIN m{r} m USING (cluster))"""
    return out + f""", a AS MATERIALIZED ({near.format(r=rounds)}
)
SELECT v.vec_id, a.cluster::INTEGER AS cluster, a.d AS distance, (sum(a.d) OVER (PARTITION BY a.cluster))::BIGINT AS cluster_inertia,
  (sum(a.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c.q, ',')) AS centroid_sha256
FROM v JOIN a USING (id) JOIN c{rounds} c ON c.cluster = a.cluster
"""
