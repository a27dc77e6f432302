"""Shapes: unpivot, complete domains, message packing, schema alignment and renderings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def unpivot(df: DataFrame, keys: Sequence[str], columns: Sequence[str], name: str = "kind", value: str = "value") -> DataFrame:
    return df.unpivot(list(keys), list(columns), name, value)


def unpivot_map(df: DataFrame, keys: Sequence[str], column: str, name: str = "kind") -> DataFrame:
    """A row per entry of a map of structs, the struct's fields as columns."""
    return df.select(*keys, F.explode(column).alias(name, "__v")).select(*keys, name, "__v.*")


def complete(df: DataFrame, keys: Sequence[str], kind: str, domain: Sequence[str], defaults: Mapping[str, Column]) -> DataFrame:
    """Every entity with every member of a small fixed domain; members that are not there get the defaults."""
    grid = df.select(*keys).distinct().withColumn(kind, F.explode(F.array(*map(F.lit, domain))))
    return grid.join(df, [*keys, kind], "left").withColumns({c: F.coalesce(c, v) for c, v in defaults.items()})


def ordered_list(kinds: Mapping[str, Column]) -> Column:
    """The names whose conditions hold, in the order given."""
    return F.array_compact(F.array(*[F.when(c, F.lit(n)) for n, c in kinds.items()]))


def messages(*turns: tuple[str, Column]) -> Column:
    """An array of (role, content)."""
    return F.array(*[F.struct(F.lit(role).alias("role"), text.cast("string").alias("content")) for role, text in turns])


def conversation(df: DataFrame, key: str, turn: str, role: str, text: str) -> DataFrame:
    """One row per conversation with its messages in the order of turns."""
    packed = df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(turn, role, text))).alias("__m"))
    return packed.select(key, F.transform("__m", lambda m: F.struct(m[role].alias("role"), m[text].alias("content"))).alias("messages"))


def sft_rows(df: DataFrame, system: Column, user: Column, answer: Column, images: Column, meta: Sequence[str]) -> DataFrame:
    """messages of three turns, images, and provenance in meta alone: it never shows in the visible text."""
    return df.select(messages(("system", system), ("user", user), ("assistant", answer)).alias("messages"), images.alias("images"), F.struct(*meta).alias("meta"))


def stamped(df: DataFrame, **values) -> DataFrame:
    """Literal columns such as stage, component or role."""
    return df.withColumns({k: F.lit(v) for k, v in values.items()})


def stamped_struct(df: DataFrame, column: str, **values) -> DataFrame:
    out = F.col(column)
    for k, v in values.items():
        out = out.withField(k, F.lit(v))
    return df.withColumn(column, out)


def aligned(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Exactly the schema's columns: others are dropped, missing ones are NULL."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields])


def rewritten(df: DataFrame, task: str, payload: str, by_task: Mapping[str, Column]) -> DataFrame:
    """A new payload for the tasks listed; the rest stays."""
    out = F.col(payload)
    for name, value in by_task.items():
        out = F.when(F.col(task) == name, value).otherwise(out)
    return df.withColumn(payload, out)


def padded_id(number: Column, width: int, prefix: str = "") -> Column:
    return F.concat(F.lit(prefix), F.lpad(number.cast("string"), width, "0"))


def exploded_options(df: DataFrame, keys: Sequence[str], options: str) -> DataFrame:
    """A row per option with its letter."""
    return df.select(*keys, F.posexplode(options).alias("place", "option")).withColumn("letter", F.char((F.col("place") + 65).cast("int")))
