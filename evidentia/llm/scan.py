"""Running values within groups, without a group in one task.

Rows are range-partitioned by group and order, so a long group stands in several partitions. One pass takes what each
partition adds to its last group, the driver carries that over the partitions' borders (a small row per partition), and
a second pass gives every row its running value.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidentia.llm.common import cut, parallelism

_ARROW = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}


def _rows(batch: pa.RecordBatch, columns: list[str]) -> Iterator[tuple]:
    return zip(*(batch.column(c).to_pylist() for c in columns), strict=True)


def running(
    df: DataFrame, group: str, order: list, inputs: list[str], *, zero: Any, step: Callable[[Any, tuple], Any], join: Callable[[Any, Any], Any], emit: Callable[[Any, Any], tuple], out: dict[str, str]
) -> DataFrame:
    """Adds the columns `out` (name: type) to each row: emit(value before it, value after it).

    The value starts at `zero` in each group and goes from row to row, in ascending `group` and the `order` given, by
    `step` with the row's `inputs`. `join` gives the value of two neighbouring stretches of a group from those of both;
    step(v, row) must equal join(v, step(zero, row)). `group` has no nulls; rows that tie in `order` come in any order.
    Both passes stream: a task holds one batch of rows.
    """
    parts = df.repartitionByRange(parallelism(df.sparkSession), F.col(group), *order).sortWithinPartitions(group, *order)
    parts = cut(parts.withColumn("__ev_part", F.spark_partition_id()))  # checkpointed partitions keep their rows' order

    def stretches(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = first = last = value = None
        for batch in batches:
            for part, g, *row in _rows(batch, ["__ev_part", group, *inputs]):
                if value is None:
                    first = last = g
                    value = (zero,)
                elif g != last:
                    last, value = g, (zero,)
                value = (step(value[0], tuple(row)),)
        if value is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "kept": pa.array([pickle.dumps((first, last, value[0]))], pa.binary())})

    kept = parts.select("__ev_part", group, *(c for c in inputs if c != group)).mapInArrow(stretches, "part int, kept binary")
    carried: dict[int, tuple] = {}
    group_at, value_at = None, None
    for part, raw in sorted((r.part, bytes(r.kept)) for r in kept.collect()):  # a row per partition
        first, last, value = pickle.loads(raw)
        if value_at is not None and first == group_at:
            carried[part] = (first, value_at[0])
            value = join(value_at[0], value) if first == last else value
        group_at, value_at = last, (value,)

    def values(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, value, begun = None, zero, False
        for batch in batches:
            found: list[list] = [[] for _ in out]
            for part, g, *row in _rows(batch, ["__ev_part", group, *inputs]):
                if not begun:
                    at, value = carried.get(part, (g, zero))
                    begun = True
                if g != at:
                    at, value = g, zero
                after = step(value, tuple(row))
                for column, v in zip(found, emit(value, after), strict=True):
                    column.append(v)
                value = after
            own = [c for c in batch.schema.names if c != "__ev_part"]
            new = [pa.array(v, _ARROW[t]) for v, t in zip(found, out.values(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), *new], names=[*own, *out])

    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{c}` {t}" for c, t in out.items()])
    return parts.mapInArrow(values, schema)
