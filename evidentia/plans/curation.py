"""Whole plans: facts to a training set without leaks, predictions to metrics, metrics to a chosen candidate."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.columns import stable_key, tri_state
from evidentia.operators.joins import against_baseline
from evidentia.operators.metrics import METRICS, binary_metrics, confusion_counts, macro, outcome
from evidentia.operators.reshape import unpivot
from evidentia.operators.rules import Rule, apply_stages, tiered
from evidentia.operators.sampling import balanced, hash_split, propagate_split, select_candidate, top_n


def facts(entities: DataFrame, labels: DataFrame, key: str, kinds: Sequence[str]) -> DataFrame:
    """A row per entity and kind with its tri-state; entities without a label are unknown."""
    long = unpivot(entities.join(labels.select(key, *kinds), key, "left"), entities.columns, kinds)
    return long.withColumn("state", tri_state(F.col("value"))).drop("value")


def clean(rows: DataFrame, stages: Sequence[Sequence[Rule]], tiers: Sequence[tuple[str, Column]]) -> DataFrame:
    """Rule sets in order, then the evidence tier; rows without a tier are dropped."""
    return apply_stages(rows, stages).withColumn("tier", tiered(tiers)).where("tier is not null")


def training_and_validation(rows: DataFrame, entity: str, group: Column, percent: int, salt: str, ratio: float = 1.0) -> DataFrame:
    """Splits by a hash of the group, keeps every entity on one side, and balances the training rows of each kind."""
    drawn = hash_split(rows, group, percent, name="drawn")
    placed = propagate_split(drawn, entity, F.col("drawn") == "val").drop("drawn")
    order = [stable_key(F.col(entity), F.col("kind"), salt=salt), F.col(entity)]
    train = balanced(placed.where("split = 'train'"), ["kind"], F.col("state") == "present", order, ratio)
    return train.unionByName(placed.where("split = 'val'"))


def score(rows: DataFrame, predicted: Column, by: str, policy: str = "strict") -> DataFrame:
    """Counts and metrics by kind of rows with a known state."""
    known = rows.where("state <> 'unknown'")
    return binary_metrics(confusion_counts(known, outcome(F.col("state") == "present", predicted, policy=policy), [by]))


@dataclass(frozen=True)
class Gate:
    """A candidate must stay within `slack` of the baseline in each guarded metric; the best by `by` is chosen."""

    guards: Mapping[str, float] = field(default_factory=lambda: {"macro_recall": 0.02})
    by: Sequence[str] = ("macro_f1", "macro_recall")


def choose(candidates: DataFrame, baseline: DataFrame, gate: Gate) -> DataFrame:
    """The chosen candidate's row, or none if no candidate passes."""
    beside = against_baseline(candidates, baseline, list(gate.guards))
    passes = F.lit(True)
    for metric, slack in gate.guards.items():
        passes = passes & F.coalesce(F.col(metric) >= F.col(f"base_{metric}") - slack, F.lit(False))
    return select_candidate(beside, passes, list(gate.by)).select(*candidates.columns)


def candidate_metrics(scored: Mapping[str, DataFrame]) -> DataFrame:
    """One row of macro metrics per named candidate."""
    rows = [macro(df, METRICS).withColumn("name", F.lit(name)) for name, df in scored.items()]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def quick_subset(rows: DataFrame, keys: Sequence[str], entity: str, n: int, salt: str = "quick") -> DataFrame:
    """A small fixed stratified subset for fast regression runs."""
    return top_n(rows, keys, [stable_key(F.col(entity), salt=salt), F.col(entity)], n)


def parse_plan(items: Sequence[str], default: tuple[int, int] = (0, 0)) -> dict[str, tuple[int, int]]:
    """CLASS:POSITIVE:NEGATIVE arguments as budgets; a missing number takes its default."""
    out = {}
    for item in items:
        name, *numbers = item.split(":")
        if not name or len(numbers) > 2:
            raise ValueError(f"not CLASS:POSITIVE:NEGATIVE: {item}")
        given = [int(n) for n in numbers]
        out[name] = (given[0] if given else default[0], given[1] if len(given) > 1 else default[1])
    return out


def parse_shares(items: Sequence[str]) -> dict[str, float]:
    """CLASS:NUMBER arguments, such as shares or thresholds."""
    out = {}
    for item in items:
        name, sep, number = item.partition(":")
        if not name or not sep:
            raise ValueError(f"not CLASS:NUMBER: {item}")
        out[name] = float(number)
    return out


def plan_rows(items: DataFrame, column: str, default: tuple[int, int] = (0, 0)) -> DataFrame:
    """name, positives and negatives of a table's CLASS:POSITIVE:NEGATIVE items, as `parse_plan` reads arguments; an item
    that is none fails the job."""
    parts = F.split(column, ":")
    whole = F.col(column).rlike(r"^[^:]+(:-?\d+){0,2}$")
    name = F.when(F.coalesce(whole, F.lit(False)), parts[0]).otherwise(F.raise_error(F.concat(F.lit("not CLASS:POSITIVE:NEGATIVE: "), F.coalesce(F.col(column), F.lit("NULL")))))
    number = lambda i: F.coalesce(F.try_element_at(parts, F.lit(i + 2)).try_cast("bigint"), F.lit(default[i]).cast("bigint"))
    return items.select(name.alias("name"), number(0).alias("positives"), number(1).alias("negatives"))


def selected(df: DataFrame, column: str, choice: str, order: Sequence[Column] = (), limit: int | None = None) -> DataFrame:
    """Rows by a list argument, `all` or integers with commas, and at most `limit` of them in the order given."""
    out = df if choice == "all" else df.where(F.col(column).isin(*[int(x) for x in choice.split(",") if x.strip()]))
    return out if limit is None else out.orderBy(*order).limit(limit)
