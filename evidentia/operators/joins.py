"""Look-ups as joins. Sides are left to Spark, which broadcasts what is small enough by its own measure."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def last_of_key(df: DataFrame, on: Sequence[str], order: Column | None = None) -> DataFrame:
    """One row per key, as a dictionary that is filled row by row holds it: the last in the order given, or else the
    greatest row. Keys are reduced in parts before their rows meet."""
    rest = [c for c in df.columns if c not in on]
    whole = F.struct(*rest) if rest else F.struct(F.lit(0).alias("__none"))
    place = F.struct(order, F.to_json(whole)) if order is not None else F.to_json(whole)
    return df.groupBy(*on).agg(F.max_by(whole, place).alias("__row")).select(*on, *[F.col("__row")[c].alias(c) for c in rest])


def enrich(left: DataFrame, right: DataFrame, on: Sequence[str], found: str = "found", keep: Column | None = None, *, order: Column | None = None, unique: bool = False) -> DataFrame:
    """Left outer join with a column that tells whether the right side has the key; `keep` limits the rows that look it up.

    A key that the right side repeats counts once (see `last_of_key`); `unique` says that none does."""
    marked = (right if unique else last_of_key(right, on, order)).withColumn("__hit", F.lit(True))
    if keep is None:
        out = left.join(marked, list(on), "left")
    else:
        renamed = marked.withColumnsRenamed({k: f"__r_{k}" for k in on})
        condition = keep
        for k in on:
            condition = condition & (left[k] == renamed[f"__r_{k}"])
        out = left.join(renamed, condition, "left").drop(*[f"__r_{k}" for k in on])
    return out.withColumn(found, F.coalesce("__hit", F.lit(False))).drop("__hit")


def first_of(left: DataFrame, sources: Sequence[tuple[str, DataFrame]], on: Sequence[str], value: str, default=None, origin: str = "origin", *, order: Column | None = None, unique: bool = False) -> DataFrame:
    """The value of the first source that has the key, and that source's name; repeated keys as in `enrich`."""
    out, values, names = left, [], []
    for i, (name, source) in enumerate(sources):
        column = f"__v{i}"
        source = source if unique else last_of_key(source, on, order)
        out = out.join(source.select(*on, F.col(value).alias(column)), list(on), "left")
        values.append(F.col(column))
        names.append(F.when(F.col(column).isNotNull(), name))
    return out.withColumn(value, F.coalesce(*values, F.lit(default))).withColumn(origin, F.coalesce(*names, F.lit("missing"))).drop(*[f"__v{i}" for i in range(len(sources))])


def fill_missing(left: DataFrame, right: DataFrame, on: Sequence[str], value: str, *, order: Column | None = None, unique: bool = False) -> DataFrame:
    """Looks a value up only where the row has none; repeated keys as in `enrich`."""
    side = (right if unique else last_of_key(right, on, order)).select(*on, F.col(value).alias("__fill"))
    return left.join(side, list(on), "left").withColumn(value, F.coalesce(value, "__fill")).drop("__fill")


def matched_and_not(left: DataFrame, right: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """The inner join, and the rows of the left side that it leaves out."""
    return left.join(right, list(on)), left.join(right.select(*on).distinct(), list(on), "left_anti")


def excluding(df: DataFrame, *key_sets: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose key is in none of the sets."""
    for keys in key_sets:
        df = df.join(keys.select(*on), list(on), "left_anti")
    return df


def including(df: DataFrame, keys: DataFrame, on: Sequence[str]) -> DataFrame:
    return df.join(keys.select(*on), list(on), "left_semi")


def zip_by_place(a: DataFrame, b: DataFrame, place: str, strict: bool = False) -> DataFrame:
    """Rows of two tables with the same place column; `strict` fails the job where only one table has a place."""
    if not strict:
        return a.join(b, place)
    joined = a.withColumn("__a", F.lit(True)).join(b.withColumn("__b", F.lit(True)), place, "full")
    odd = F.raise_error(F.concat(F.lit(f"only one side has {place} "), F.col(place).cast("string"))).cast("boolean")
    return joined.where(F.coalesce(F.col("__a") & F.col("__b"), odd)).drop("__a", "__b")


def hard_negatives(rows: DataFrame, entity: str, kind: str, state: str, confounders: Mapping[str, Sequence[str]], name: str = "is_hard") -> DataFrame:
    """Marks a negative row as hard if its entity has one of the kind's confounders present."""
    pairs = F.explode(F.create_map(*[x for k, v in confounders.items() for x in (F.lit(k), F.array(*map(F.lit, v)))]))
    spark = rows.sparkSession
    listed = spark.range(1).select(pairs.alias("__for", "__of")).select("__for", F.explode("__of").alias(kind))
    present = rows.where(F.col(state) == "present").select(entity, kind).join(F.broadcast(listed), kind).select(entity, F.col("__for").alias(kind)).distinct()
    marked = enrich(rows, present, [entity, kind], found="__conf")
    return marked.withColumn(name, F.col("__conf") & (F.col(state) == "absent")).drop("__conf")


def against_baseline(candidates: DataFrame, baseline: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each candidate beside the only row of a baseline, with the differences of the columns; the baseline is limited to
    one row, so the join is one row wide."""
    one = baseline.select(*[F.col(c).alias(f"base_{c}") for c in columns]).limit(1)
    out = candidates.join(F.broadcast(one), how="left", on=F.lit(True))
    return out.withColumns({f"delta_{c}": F.col(c) - F.col(f"base_{c}") for c in columns})


def compare_models(a: DataFrame, b: DataFrame, on: Sequence[str], columns: Sequence[str], names=("a", "b")) -> DataFrame:
    """Two metric tables side by side with differences."""
    left = a.select(*on, *[F.col(c).alias(f"{names[0]}_{c}") for c in columns])
    right = b.select(*on, *[F.col(c).alias(f"{names[1]}_{c}") for c in columns])
    return left.join(right, list(on)).withColumns({f"delta_{c}": F.col(f"{names[1]}_{c}") - F.col(f"{names[0]}_{c}") for c in columns})


def expand_copies(df: DataFrame, identifier: str, copies: DataFrame, on: Sequence[str], paths: str, path: str) -> DataFrame:
    """Each row and one more for each of its listed copies, numbered in the id and in `copy`."""
    joined = df.join(copies.select(*on, paths), list(on), "left")
    every = F.concat(F.array(F.col(path)), F.coalesce(F.col(paths), F.array().cast("array<string>")))
    out = joined.select(*[c for c in joined.columns if c not in (paths, path)], F.posexplode(every).alias("copy", path))
    return out.withColumn(identifier, F.when(F.col("copy") > 0, F.concat(F.col(identifier).cast("string"), F.lit("__aug"), F.col("copy"))).otherwise(F.col(identifier).cast("string")))


def first_by(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row per key: the first one in the order given."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")
