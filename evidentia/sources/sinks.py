"""Sinks: JSON lines, partitioned sets, errors beside results, one-row documents and a registry of data sets."""

from __future__ import annotations

import json
import uuid
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json_lines(df: DataFrame, path: str, *, append: bool = False, by: tuple[str, ...] = ()) -> None:
    """JSON lines with NULL fields kept, one folder per value of `by`."""
    writer = df.write.mode("append" if append else "overwrite").option("ignoreNullFields", "false")
    (writer.partitionBy(*by) if by else writer).json(path)


def write_with_errors(df: DataFrame, good: Column, path: str, errors: str) -> None:
    """Rows that pass go to `path`, the rest (also where the condition is NULL) to `errors`."""
    good = F.coalesce(good, F.lit(False))
    write_json_lines(df.where(good), path)
    write_json_lines(df.where(~good), errors)


def as_document(df: DataFrame, order: list[str], most: int = 10_000) -> str:
    """A small result as one JSON array in the order given; fails if it has more rows than `most`."""
    rows = df.orderBy(*order).select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"})).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows do not belong into one document")
    return "[" + ",".join(r[0] for r in rows) + "]"


def _hadoop(path: str):
    """Spark's session, file system classes and the path, in whatever store the path names."""
    spark = SparkSession.active()
    fs = spark._jvm.org.apache.hadoop.fs
    return spark, fs, fs.Path(path)


def write_document(path: str, content) -> None:
    """Writes one JSON document so that readers see the old or the new one, never a part."""
    spark, fs, target = _hadoop(path)
    conf = spark._jsc.hadoopConfiguration()
    part = fs.Path(f"{path}.{uuid.uuid4().hex}.part")
    out = target.getFileSystem(conf).create(part, True)
    out.write(bytearray(json.dumps(content, ensure_ascii=False, indent=2), "utf-8"))
    out.close()
    replace = spark.sparkContext._gateway.new_array(spark._jvm.org.apache.hadoop.fs.Options.Rename, 1)
    replace[0] = fs.Options.Rename.OVERWRITE
    fs.FileContext.getFileContext(target.getFileSystem(conf).getUri(), conf).rename(part, target, replace)


def write_counts(path: str, counts: Mapping[str, DataFrame], most: int = 10_000) -> dict:
    """Writes counters beside a data set as one document: by name, the counts by key (its columns but `n`, joined by ::).

    Counters are small; one with more keys than `most` fails."""
    content = {}
    for name, df in counts.items():
        keys = [c for c in df.columns if c != "n"]
        rows = df.select(F.concat_ws("::", *[F.coalesce(F.col(k).cast("string"), F.lit("")) for k in keys]).alias("k"), "n").orderBy("k").limit(most + 1).collect()
        if len(rows) > most:
            raise ValueError(f"more than {most} keys do not belong into one document")
        content[name] = {r.k: r.n for r in rows}
    write_document(path, content)
    return content


def register(path: str, name: str, entry: dict) -> dict:
    """Adds or replaces a data set in a registry file and returns the registry."""
    spark, _, target = _hadoop(path)
    known = {}
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        known = json.loads(spark.read.text(path, wholetext=True).first()[0])
    known[name] = entry
    write_document(path, known)
    return known
