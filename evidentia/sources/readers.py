"""Sources: JSON lines and arrays, one document per entity, CSV with aliases, lists, logs, listings and settings.

All readers return lazy frames with declared columns; files of one record per entity are read by Spark's text source,
never on the driver.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from evidentia.functions.columns import tri_state
from evidentia.functions.extract import key_values, path_stem


def _present(read, spark: SparkSession, schema: T.StructType) -> DataFrame:
    try:
        return read()
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], schema)


def json_lines(spark: SparkSession, path: str, schema: T.StructType | str, *, mode: str = "strict", optional: bool = False) -> DataFrame:
    """JSON lines. strict: a malformed line fails the job; tolerant: it is dropped; `optional`: no file, no rows."""
    schema = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    reader = spark.read.schema(schema).option("mode", {"strict": "FAILFAST", "tolerant": "DROPMALFORMED"}[mode])
    read = lambda: reader.json(path)
    return _present(read, spark, schema) if optional else read()


def json_array(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A file that holds one array of objects; other elements are dropped."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)


def wrapped_array(spark: SparkSession, path: str, schema: str, keys: Sequence[str] = ("data", "instances", "examples")) -> DataFrame:
    """Arrays of objects, bare or under one of the keys."""
    text = spark.read.text(path, wholetext=True).select("value")
    inner = [F.from_json("value", f"array<{schema}>")] + [F.from_json("value", f"struct<{k}:array<{schema}>>")[k] for k in keys]
    tried = [F.when(F.ltrim("value").startswith("["), inner[0])] + inner[1:]
    return text.select(F.explode(F.coalesce(*tried)).alias("r")).where("r is not null").select("r.*")


def json_map(spark: SparkSession, path: str, value: str, key: str = "path") -> DataFrame:
    """A file with one object of entries: a row per entry."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"map<string,{value}>")).alias(key, "v")).select(key, "v.*")


def entity_documents(spark: SparkSession, pattern: str) -> DataFrame:
    """entity (name of the parent folder), path, doc (VARIANT, NULL if it can't be read) and error.

    Spark skips files without a byte, so an entity with an empty file has no row: see `unfinished` for these."""
    text = spark.read.text(pattern, wholetext=True, recursiveFileLookup=True).select("value", F.col("_metadata.file_path").alias("path"))
    doc = F.try_parse_json("value")
    good = F.schema_of_variant(doc).startswith("OBJECT")
    return text.select(
        F.regexp_extract("path", r"([^/]+)/[^/]+$", 1).alias("entity"), "path",
        F.when(good, doc).alias("doc"), F.when(F.coalesce(good, F.lit(False)), F.lit(None)).otherwise("not a JSON object").alias("error"),
    )


def with_documents(rows: DataFrame, key: str, documents: DataFrame) -> DataFrame:
    """Rows with the document of their entity; doc is NULL where there is none or it can't be read."""
    return rows.join(documents.select(F.col("entity").alias(key), "doc"), key, "left")


def annotated_answers(conversations: DataFrame, key: Column, answer: Column, order: Column) -> DataFrame:
    """The annotation in the answer of each conversation by a key taken from its image path: the map of the answer's
    `key: value` lines, the last conversation of a key counting."""
    parsed = conversations.select(key.alias("key"), key_values(answer).alias("annotation"), order.alias("__o"))
    return parsed.where("key is not null").groupBy("key").agg(F.max_by("annotation", "__o").alias("annotation"))


def target_of(doc: Column) -> Column:
    """What a prediction is about, under any of its names."""
    return any_path(doc, ["$.target", "$.target_lesion", "$.lesion", "$.task.target"], "string")


def presence_of(doc: Column) -> Column:
    """present, absent or unknown from a flag, a word or a number under any of its names."""
    return tri_state(any_path(doc, ["$.present", "$.state", "$.is_present", "$.result.present"], "string"))


def any_path(doc: Column, paths: Sequence[str], kind: str) -> Column:
    """The value at the first of several paths of a VARIANT that holds one of the kind."""
    return F.coalesce(*[F.try_variant_get(doc, p, kind) for p in paths])


def point(doc: Column, path: str) -> Column:
    """(x, y) written as a list or as an object."""
    x = F.coalesce(F.try_variant_get(doc, f"{path}.x", "double"), F.try_variant_get(doc, f"{path}[0]", "double"))
    y = F.coalesce(F.try_variant_get(doc, f"{path}.y", "double"), F.try_variant_get(doc, f"{path}[1]", "double"))
    return F.when(x.isNotNull() & y.isNotNull(), F.struct(x.alias("x"), y.alias("y")))


def aliased_csv(spark: SparkSession, path: str, columns: Mapping[str, tuple[Sequence[str], str]]) -> DataFrame:
    """A CSV with a header in which a column may go by several names; values that do not cast are NULL."""
    raw = spark.read.option("header", True).csv(path)
    there = {c.lstrip("﻿").strip().lower(): c for c in raw.columns}
    out = []
    for name, (aliases, kind) in columns.items():
        held = [F.nullif(F.trim(F.col(f"`{there[a.lower()]}`")), F.lit("")) for a in aliases if a.lower() in there]
        out.append((F.coalesce(*held) if held else F.lit(None).cast("string")).try_cast(kind).alias(name))
    return raw.select(*out)


def plain_csv(spark: SparkSession, path: str, columns: Sequence[tuple[str, str]], required: Sequence[str] = ()) -> DataFrame:
    """A CSV without a header, safe against a byte-order mark; rows whose required columns do not cast are dropped."""
    raw = spark.read.csv(path, schema=", ".join(f"c{i} string" for i in range(len(columns))))
    clean = [F.trim(F.regexp_replace(F.col(f"c{i}"), "^﻿", "")).try_cast(kind).alias(name) for i, (name, kind) in enumerate(columns)]
    return raw.select(*clean).dropna(subset=list(required) or None) if required else raw.select(*clean)


def spaced_list(spark: SparkSession, path: str, value: str = "grade") -> DataFrame:
    """Lines `file value`: stem and integer value; lines that do not fit are dropped."""
    parts = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).select(path_stem(parts[0]).alias("stem"), F.try_element_at(parts, F.lit(2)).try_cast("int").alias(value))
    return rows.where(F.col(value).isNotNull())


def labels_in_text(df: DataFrame, text: str, pattern: str = r"GRADE:\s*(-?\d+)", name: str = "grade") -> DataFrame:
    return df.withColumn(name, F.regexp_extract(text, pattern, 1).try_cast("int")).where(F.col(name).isNotNull())


def file_listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, stem, length and modification time of all files below a folder, without their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", pattern).load(folder)
    return files.select("path", path_stem(F.col("path")).alias("stem"), "length", "modificationTime")


def keyed_listing(listing: DataFrame, pattern: str, names: Sequence[str]) -> DataFrame:
    """A listing with keys taken from the path by a pattern's groups; paths that do not match are dropped."""
    return listing.select("*", *[F.regexp_extract("path", pattern, i + 1).alias(n) for i, n in enumerate(names)]).where(F.col("path").rlike(pattern))


def metric_files(spark: SparkSession, pattern: str, schema: str) -> DataFrame:
    """Metric documents, named by their folder."""
    docs = spark.read.schema(schema).option("multiLine", True).json(pattern)
    return docs.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("name"), *[c for c in docs.columns if c != "name"])


def log_lines(spark: SparkSession, path: str) -> DataFrame:
    """Log lines with their file; carriage returns of progress bars part lines too."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("path"), F.explode(F.split("value", "\r")).alias("value")).where("value <> ''")


def checked(df: DataFrame, required: Sequence[str], lengths: Mapping[str, int] | None = None) -> DataFrame:
    """The rows, failing the job at a NULL in a required column or an array of another length."""
    out = df
    for c in required:
        out = out.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(f"{c} is missing").cast(df.schema[c].dataType)).otherwise(F.col(c)))
    for c, n in (lengths or {}).items():
        bad = F.col(c).isNotNull() & (F.size(c) != n)
        out = out.withColumn(c, F.when(bad, F.raise_error(f"{c} has another length than {n}").cast(df.schema[c].dataType)).otherwise(F.col(c)))
    return out


def violations(df: DataFrame, required: Sequence[str], lengths: Mapping[str, int] | None = None) -> DataFrame:
    """The rows that `checked` would fail at, with the names of what is wrong in `problems`."""
    found = [F.when(F.col(c).isNull(), F.lit(f"{c} is missing")) for c in required]
    found += [F.when(F.col(c).isNotNull() & (F.size(c) != n), F.lit(f"{c} has another length than {n}")) for c, n in (lengths or {}).items()]
    return df.withColumn("problems", F.array_compact(F.array(*found))).where(F.size("problems") > 0)


def settings(spark: SparkSession, path: str) -> dict[str, str]:
    """Top-level `key: value` lines of a settings file; a driver-side dictionary, not data."""
    lines = spark.read.text(path, wholetext=True).first()[0].splitlines()
    pairs = (line.split("#")[0].partition(":") for line in lines if line and not line[0].isspace())
    return {k.strip(): v.strip().strip("'\"") for k, sep, v in pairs if sep}
