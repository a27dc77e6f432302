"""Counters, rates, percentiles, summaries and histograms."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evidentia.operators.ordered import join_same, running_sums


def counter(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def counter_with_totals(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Counts by all keys, with subtotals from the right to the grand total (NULL keys; `level` counts those rolled up)."""
    return df.rollup(*keys).agg(F.count("*").alias("n"), F.grouping_id().cast("bigint").alias("level"))


def distinct_per_group(df: DataFrame, keys: Sequence[str], entity: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"), F.count_distinct(entity).alias("entities"))


def rates(df: DataFrame, key: str, conditions: dict[str, Column]) -> DataFrame:
    """Shares of rows overall (NULL key, `overall` true) and by group; an empty group has the denominator 1."""
    marked = df.select(key, *[F.coalesce(c, F.lit(False)).cast("bigint").alias(n) for n, c in conditions.items()])
    sums = marked.rollup(key).agg(F.count("*").alias("n"), *[(F.sum(n).cast("double") / F.greatest(F.count("*"), F.lit(1))).alias(n) for n in conditions], (F.grouping(key) == 1).alias("overall"))
    return sums


def nearest_rank(df: DataFrame, keys: Sequence[str], value: str, percents: Sequence[float], floor_n: int = 0) -> DataFrame:
    """For each group n and the values at the places round(p / 100 (n - 1)) of the sorted values, half to even.

    Values are first counted and then summed by ranges, so that no task has all of a group. Groups of fewer than
    `floor_n` values get 0.0.
    """
    spread = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    run = running_sums(spread, keys, value, ["c"])
    at = lambda p: F.bround(F.lit(float(p)) / 100 * (F.col("c_all") - 1)).cast("bigint")
    hit = lambda p: (at(p) >= F.col("c_before")) & (at(p) < F.col("c_before") + F.col("c"))
    out = run.groupBy(*keys).agg(F.max("c_all").alias("n"), *[F.max(F.when(hit(p), F.col(value))).alias(f"p{p:g}") for p in percents])
    if floor_n:
        out = out.withColumns({f"p{p:g}": F.when(F.col("n") < floor_n, 0.0).otherwise(F.col(f"p{p:g}")) for p in percents})
    return out


def summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """n, min, p50, p90, p99, max and mean of each group."""
    basic = df.where(F.col(value).isNotNull()).groupBy(*keys).agg(F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"))
    ranks = nearest_rank(df, keys, value, (50, 90, 99))
    return join_same(ranks, basic, keys) if keys else ranks.join(F.broadcast(basic), how="inner", on=F.lit(True))


def linear_quantiles(df: DataFrame, keys: Sequence[str], value: str, at: Sequence[float], names: Sequence[str]) -> DataFrame:
    """Exact quantiles with linear interpolation, from running sums as nearest_rank."""
    spread = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    run = running_sums(spread, keys, value, ["c"])

    def at_place(place: Column) -> Column:
        return F.max(F.when((place >= F.col("c_before")) & (place < F.col("c_before") + F.col("c")), F.col(value).cast("double")))

    places = [F.lit(float(q)) * (F.col("c_all") - 1) for q in at]
    ends = [x for i, p in enumerate(places) for x in (at_place(F.floor(p)).alias(f"__l{i}"), at_place(F.ceil(p)).alias(f"__h{i}"), F.max(p - F.floor(p)).alias(f"__p{i}"))]
    found = run.groupBy(*keys).agg(*ends)
    return found.select(*keys, *[(F.col(f"__l{i}") + (F.col(f"__h{i}") - F.col(f"__l{i}")) * F.col(f"__p{i}")).alias(n) for i, n in enumerate(names)])


def above_group_percentile(df: DataFrame, keys: Sequence[str], value: str, percent: float, floor_n: int = 25) -> DataFrame:
    """Rows at or above their group's nearest-rank percentile; groups that are too small have the threshold 0."""
    limits = nearest_rank(df, keys, value, (percent,), floor_n).withColumnRenamed(f"p{percent:g}", "threshold").drop("n")
    return join_same(df, limits, keys).where(F.col(value) >= F.col("threshold"))


def histogram(df: DataFrame, value: Column, low: float, high: float, bins: int, keys: Sequence[str] = (), log: bool = False) -> DataFrame:
    """Counts by equal bins from low to high, the last one closed; values outside are left out."""
    x = F.log1p(value) if log else value.cast("double")
    place = F.when(x == high, bins - 1).otherwise(F.floor((x - low) / (high - low) * bins)).cast("int")
    return df.withColumn("bin", place).where((F.col("bin") >= 0) & (F.col("bin") < bins)).groupBy(*keys, "bin").agg(F.count("*").alias("n"))


def edge_histogram(df: DataFrame, value: Column, edges: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Counts by bands [edge, next edge), the last one open."""
    band = F.lit(None).cast("int")
    for i, e in enumerate(edges):
        band = F.when(value >= e, i).otherwise(band)
    return df.withColumn("band", band).where(F.col("band").isNotNull()).groupBy(*keys, "band").agg(F.count("*").alias("n"))


def most_common(df: DataFrame, key: str, n: int = 20) -> DataFrame:
    """A top-n report; ties by key."""
    return counter(df, [key]).orderBy(F.desc("n"), key).limit(n)


def entity_map(df: DataFrame, entity: str, kind: str, state: str, order: str) -> DataFrame:
    """One row per entity with a map kind → state; present beats the rest, then the first row counts. Conflicts are
    kinds with different states, duplicates are rows beyond the first of their kind."""
    per = df.groupBy(entity, kind).agg(
        F.count("*").alias("c"),
        F.count_distinct(state).alias("d"),
        F.coalesce(F.max(F.when(F.col(state) == "present", F.col(state))), F.min_by(state, order)).alias("s"),
    )
    return per.groupBy(entity).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct(kind, "s")))).alias("states"),
        F.sum((F.col("d") > 1).cast("bigint")).alias("conflicts"),
        F.sum(F.col("c") - 1).alias("duplicates"),
    )


def examples(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """The first k rows of each group, as a report."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= k).drop("__rn")


def shares(df: DataFrame, keys: Sequence[str], band: str) -> DataFrame:
    """Distribution of a band overall and by keys (NULL keys for overall)."""
    counts = df.cube(*keys, band).agg(F.count("*").alias("n"), F.grouping_id().alias("g"), F.grouping(band).alias("b"))
    all_keys = (1 << len(keys)) - 1
    counts = counts.where((F.col("b") == 0) & (F.col("g").isin(0, all_keys << 1)))
    w = Window.partitionBy("g", *keys)
    return counts.select(*keys, band, "n", (F.col("n").cast("double") / F.sum("n").over(w)).alias("share"))


def conditional_sums(df: DataFrame, keys: Sequence[str], values: Sequence[str], when: dict[str, Column]) -> DataFrame:
    """Sums of several columns under several conditions, as <condition>_<column>."""
    return df.groupBy(*keys).agg(*[F.coalesce(F.sum(F.when(c, F.col(v))), F.lit(0)).alias(f"{n}_{v}") for n, c in when.items() for v in values])
