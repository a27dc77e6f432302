"""Cleaning rules and ordered decision lists, given as data and turned into column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evidentia.functions.columns import add_flags


@dataclass(frozen=True)
class Rule:
    """If `when` holds, columns take the values of `then` and the flag is added."""

    name: str
    when: Column
    then: Mapping[str, Column] = field(default_factory=dict)


def apply_rules(df: DataFrame, rules: Sequence[Rule], flags: str = "flags") -> DataFrame:
    """Applies all rules at once: conditions see the values from before, the first rule that sets a column wins, and
    every rule that holds leaves its flag."""
    changed: dict[str, Column] = {}
    for name in {c for r in rules for c in r.then}:
        value = F.col(name)
        for r in reversed([r for r in rules if name in r.then]):
            value = F.when(r.when, r.then[name]).otherwise(value)
        changed[name] = value
    held = F.col(flags) if flags in df.columns else F.array().cast("array<string>")
    changed[flags] = add_flags(held, {r.name: F.coalesce(r.when, F.lit(False)) for r in rules})
    return df.withColumns(changed)


def apply_stages(df: DataFrame, stages: Sequence[Sequence[Rule]], flags: str = "flags") -> DataFrame:
    """Rule sets in order, each seeing what the one before left."""
    for rules in stages:
        df = apply_rules(df, rules, flags)
    return df


def suppress(df: DataFrame, when: Column, state: str, source: str, reason: Column, to: str = "unknown") -> DataFrame:
    """Withdraws a state, keeping what it was: raw state and source, and why."""
    hit = F.coalesce(when, F.lit(False))
    return df.withColumns({
        f"raw_{state}": F.when(hit, F.col(state)),
        f"raw_{source}": F.when(hit, F.col(source)),
        "suppressed_reason": F.when(hit, reason),
        state: F.when(hit, to).otherwise(F.col(state)),
    })


def decision_list(steps: Sequence[tuple[str, Column, Mapping[str, Column]]], default: Mapping[str, Column], name: str = "step") -> Column:
    """A struct of the first step whose condition holds, with its further fields."""
    fields = list(default)
    packed = lambda step, values: F.struct(F.lit(step).alias(name), *[values.get(f, default[f]).alias(f) for f in fields])
    out = None
    for step, condition, values in steps:
        out = F.when(condition, packed(step, values)) if out is None else out.when(condition, packed(step, values))
    rest = packed(None, default)
    return rest if out is None else out.otherwise(rest)


def evidence_strength(state: Column, source: Column, strong_sources: Sequence[str], confidence: Column, least: float = 0.5) -> Column:
    """strong, weak, template, unknown or absent."""
    return (
        F.when(state == "absent", "absent")
        .when(state.isin("template_only", "possible_by_grade_template"), "template")
        .when((state == "present") & source.isin(*strong_sources), "strong")
        .when((state == "present") & (F.coalesce(confidence, F.lit(0.0)) >= least), "strong")
        .when(state == "present", "weak")
        .otherwise("unknown")
    )


def burden(df: DataFrame, entity: str, strength: Column, area: Column) -> DataFrame:
    """Points per entity (large 3, medium 2, other or small 1, weak 1) and their level: none, light, moderate, heavy."""
    points = F.when(strength == "strong", F.when(area == "large", 3).when(area == "medium", 2).otherwise(1)).when(strength == "weak", 1).otherwise(0)
    sums = df.groupBy(entity).agg(F.sum(points).alias("points"))
    level = F.when(F.col("points") == 0, "none").when(F.col("points") <= 2, "light").when(F.col("points") <= 5, "moderate").otherwise("heavy")
    return sums.withColumn("burden", level)


def usability(df: DataFrame, entity: str, uses: Mapping[str, Column], any_of: bool = True) -> DataFrame:
    """For each entity whether any (or every) of its rows fits a use."""
    pick = F.bool_or if any_of else F.bool_and
    return df.groupBy(entity).agg(*[pick(F.coalesce(c, F.lit(False))).alias(n) for n, c in uses.items()])


def tiered(tiers: Sequence[tuple[str, Column]]) -> Column:
    """The first tier whose condition holds, NULL (to be filtered out) if none does."""
    out = F.lit(None).cast("string")
    for name, condition in reversed(tiers):
        out = F.when(condition, name).otherwise(out)
    return out
