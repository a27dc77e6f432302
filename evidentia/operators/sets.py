"""Unions with origins, mixtures by share, and audits of overlap."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators.sampling import cyclic_take


def tagged_union(parts: Mapping[str, DataFrame], name: str = "origin") -> DataFrame:
    """All rows of all parts with the part's name; columns that a part lacks are NULL."""
    tagged = [df.withColumn(name, F.lit(tag)) for tag, df in parts.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)


def later_wins(parts: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """One row per key, from the last part that has it (within a part its greatest row)."""
    numbered = [df.withColumn("__src", F.lit(i)) for i, df in enumerate(parts)]
    union = reduce(lambda a, b: a.unionByName(b), numbered)
    values = [c for c in parts[0].columns if c not in keys]
    best = union.groupBy(*keys).agg(F.max_by(F.struct(*values), F.struct("__src", *values)).alias("__v"))
    return best.select(*keys, *[F.col(f"__v.{v}").alias(v) for v in values])


def keys_union(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.union(b), parts).distinct()


def keys_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.exceptAll(b)


def overlap_audit(parts: Mapping[str, DataFrame], key: str) -> DataFrame:
    """For each pair of parts the number of keys that both have; one pass over all keys."""
    tagged = tagged_union({n: df.select(key) for n, df in parts.items()}, "__p").where(F.col(key).isNotNull())
    held = tagged.groupBy(key).agg(*[F.max((F.col("__p") == n).cast("int")).alias(f"__{i}") for i, n in enumerate(parts)])
    names = list(parts)
    pairs = list(combinations(range(len(names)), 2))
    counts = held.agg(*[F.coalesce(F.sum(F.col(f"__{i}") * F.col(f"__{j}")), F.lit(0)).alias(f"{i}_{j}") for i, j in pairs])
    rows = F.array(*[F.struct(F.lit(names[i]).alias("left"), F.lit(names[j]).alias("right"), F.col(f"{i}_{j}").alias("shared")) for i, j in pairs])
    return counts.select(F.explode(rows).alias("r")).select("r.*")


def mixture(parts: Sequence[tuple[str, DataFrame, float]], n: int, order: Sequence[Column], name: str = "component") -> DataFrame:
    """n rows by shares (rounded half to even, the last part fills up), each part cyclic in order; adds `cycle`."""
    sizes = [int(round(n * share)) for _, _, share in parts[:-1]]
    sizes.append(n - sum(sizes))
    whole = tagged_union({tag: df for tag, df, _ in parts}, name)
    want = F.lit(0)
    for (tag, _, _), size in zip(parts, sizes, strict=True):
        want = F.when(F.col(name) == tag, size).otherwise(want)
    return cyclic_take(whole, [name], order, want)
