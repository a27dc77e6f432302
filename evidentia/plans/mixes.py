"""Mixtures of training rows: evidence buckets by shares, components with a fallback, and augmented copies.

All draws follow the order given, so that the same rows come out every time.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.operators.joins import expand_copies
from evidentia.operators.sampling import cyclic_take, share_budgets, take_budgets
from evidentia.operators.sets import tagged_union


def share_mix(rows: DataFrame, buckets: Sequence[tuple[str, Column, float]], order: Sequence[Column], total: int, name: str = "bucket") -> DataFrame:
    """`total` rows in buckets (name, condition, share): the first bucket whose condition holds has a row, each gives its
    share, cyclic where it has too few rows, and the last one what the others leave."""
    place = F.lit(None).cast("string")
    for bucket, condition, _ in reversed(buckets):
        place = F.when(condition, bucket).otherwise(place)
    return take_budgets(rows.withColumn(name, place), name, share_budgets([(b, s) for b, _, s in buckets], total), order)


def filled_mix(components: Mapping[str, tuple[DataFrame, int]], fallback: DataFrame, order: Sequence[str], name: str = "component") -> DataFrame:
    """Each component's number of rows, cyclic; a component without any row is filled from the fallback.

    `order` names columns that all frames have."""
    parts = {}
    for component, (rows, n) in components.items():
        none = rows.agg((F.count("*") == 0).alias("__none"))
        stand_in = fallback.join(F.broadcast(none), F.col("__none")).drop("__none")
        both = rows.unionByName(stand_in, allowMissingColumns=True).withColumn("__all", F.lit(0))
        parts[component] = cyclic_take(both, ["__all"], [F.col(c) for c in order], n).drop("__all")
    return tagged_union(parts, name)


def anchored_mix(rows: DataFrame, boundary: Column, repair: Column, order: Sequence[Column], *, n: int, boundary_share: float, repair_share: float, name: str = "component") -> DataFrame:
    """n rows: those at a boundary between classes and those that need repair by their shares, and anchors of the usual
    form for the rest."""
    return share_mix(rows, [("boundary", boundary, boundary_share), ("repair", repair, repair_share), ("anchor", F.lit(True), 1 - boundary_share - repair_share)], order, n, name)


def augmented_sample(rows: DataFrame, copies: DataFrame, identifier: str, on: Sequence[str], positive: Column, order: Sequence[Column], *, path: str, paths: str, per_class: int) -> DataFrame:
    """As many positives as negatives: scarce positives are first widened by their augmented copies, then both are cut to
    `per_class`, originals before copies, without a repeated row."""
    some = expand_copies(rows.where(positive), identifier, copies, on, paths, path)
    rest = rows.where(~F.coalesce(positive, F.lit(False))).withColumn("copy", F.lit(0)).withColumn(identifier, F.col(identifier).cast("string"))
    both = some.withColumn("side", F.lit("positive")).unionByName(rest.withColumn("side", F.lit("negative")))
    return take_budgets(both, "side", [("positive", per_class), ("negative", per_class)], [F.col("copy"), *order], cyclic=False)


def retemplated(rows: DataFrame, key: str, texts: Mapping[str, Column], text: str) -> DataFrame:
    """New texts by class; identity and class of each row stay, and with them the distribution of classes."""
    out = F.col(text)
    for name, value in texts.items():
        out = F.when(F.col(key) == name, value).otherwise(out)
    return rows.withColumn(text, out)


def eligible(rows: DataFrame, state: str, source: str, positive_sources: Sequence[str], negative_sources: Sequence[str], name: str = "label") -> DataFrame:
    """true or false for the rows whose source may vouch for their state, NULL for the rest."""
    yes = (F.col(state) == "present") & F.col(source).isin(*positive_sources)
    no = (F.col(state) == "absent") & F.col(source).isin(*negative_sources)
    return rows.withColumn(name, F.when(yes, True).when(no, False))
