"""Line dedup: lines that many documents hold stay only in the last of them.

Documents are dealt into batches. Of each batch, every line's key is hashed and counted once a document; the hashes go
to a store of sorted runs, one table per run, hash-bucketed and sorted so that runs merge without a shuffle of their own.
A batch is anti-joined with the runs: a key that a run already holds in enough documents, the last of them not before
the batch's, can't change any more and is not added again; all other keys of the batch become a new run of the lowest
level. When a level has `fanout` runs, they are merged into one run of the next level, which adds counts of the same
key. Last, all runs are merged, the keys with enough documents are joined to the lines, and each document gets its
dropped lines as places in it. Documents are shuffled once, whole; lines travel as hashes.

A key is the line without white space of `[\\x20\\x09-\\x0D]` at both ends, with A-Z in lower case. Keys of at least
`min_chars` code points that at least `min_docs` rows of documents hold are dropped wherever they occur, except in rows
with the largest doc_id that holds them (any number of times there).

Only DataFrame functions run. A hot line is counted in each partition before it is shuffled; Spark splits the partition
that joins it to its lines.

Cases: a null text is one empty line, as an empty one is; rows that repeat count as documents of their own and lose the
same lines; a null doc_id is smaller than any other, and rows without one keep a line only if no row with one holds it;
texts of any length are read whole, in time proportional to n log n of their lines; no rows give no rows; other columns
are ignored.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm.common import parallelism, remove, shared_dir, text_or_empty

MIN_CHARS = 20
MIN_DOCS = 3
#: Batches that a table at rest is dealt into, and runs of a level that are merged into one of the next.
BATCHES = 4
FANOUT = 2

_SPACES = " \t\n\x0b\f\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_HASH = ["h1", "h2"]
_ROW = ["doc_id", "t1", "t2"]


def key_of(line: Column) -> Column:
    """A line without white space at both ends and with A-Z in lower case."""
    return F.translate(F.btrim(line, F.lit(_SPACES)), _UPPER, _LOWER)


def lines_of(text: Column) -> Column:
    return F.split(text, "\n", -1)


def hashed_lines(docs: DataFrame, *, min_chars: int, batches: int) -> DataFrame:
    """batch, doc_id, t1, t2 (hashes of the text) and lines: (h1, h2, place) of all lines with long keys, sorted."""
    text = text_or_empty()
    keyed = F.transform(lines_of(text), lambda x, i: F.struct(i.alias("place"), key_of(x).alias("key")))
    long_ones = F.filter(keyed, lambda x: F.char_length(x["key"]) >= min_chars)
    hashes = F.transform(long_ones, lambda x: F.struct(F.xxhash64(x["key"]).alias("h1"), F.xxhash64(F.lit(11), x["key"]).alias("h2"), x["place"].alias("place")))
    return docs.select(
        F.pmod(F.xxhash64("doc_id"), F.lit(batches)).cast("int").alias("batch"),
        F.col("doc_id").cast("long").alias("doc_id"),
        F.xxhash64(text).alias("t1"),
        F.xxhash64(F.lit(11), text).alias("t2"),
        F.array_sort(hashes).alias("lines"),
    )


def counted(lines: DataFrame) -> DataFrame:
    """(h1, h2, docs, last): the rows that hold each key, and the largest doc_id among them."""

    def first_of_key(x: Column, i: Column) -> Column:
        before = F.get(F.col("lines"), i - 1)
        return (i == 0) | (before["h1"] != x["h1"]) | (before["h2"] != x["h2"])

    # lines are sorted by hash, so that a key's lines in one document stand together
    once = lines.select("doc_id", F.explode(F.filter("lines", first_of_key)).alias("x")).select("doc_id", "x.h1", "x.h2")
    return once.groupBy(*_HASH).agg(F.count("*").alias("docs"), F.max("doc_id").alias("last"))


class Runs:
    """A store of sorted runs of (h1, h2, docs, last), level by level.

    Runs are tables in the shared folder, bucketed and sorted by hash. A run that has been merged into another is
    dropped only after that other is written, so a failed merge can be tried again.
    """

    def __init__(self, spark: SparkSession, *, fanout: int = FANOUT, min_docs: int = MIN_DOCS):
        self.spark, self.fanout, self.min_docs = spark, fanout, min_docs
        self.buckets = parallelism(spark)
        self.levels: list[list[str]] = []
        self.folder = f"{shared_dir(spark)}/runs-{uuid.uuid4().hex}"

    def _write(self, rows: DataFrame) -> str:
        name = f"evidentia_run_{uuid.uuid4().hex}"
        rows.write.format("parquet").option("path", f"{self.folder}/{name}").bucketBy(self.buckets, *_HASH).sortBy(*_HASH).saveAsTable(name)
        return name

    def _merged(self, names: list[str]) -> DataFrame:
        # joined, not united: bucketed runs of the same keys merge by a sort-merge join without a shuffle
        rows = self.spark.table(names[0])
        for name in names[1:]:
            more = self.spark.table(name).withColumnsRenamed({"docs": "more", "last": "later"})
            total = F.coalesce("docs", F.lit(0)) + F.coalesce("more", F.lit(0))
            rows = rows.join(more, _HASH, "full").select(*_HASH, total.alias("docs"), F.greatest("last", "later").alias("last"))
        return rows

    def names(self) -> list[str]:
        return [n for level in self.levels for n in level]

    def add(self, batch: DataFrame) -> None:
        """Adds the keys of a batch (h1, h2, docs, last) that no run has settled, and merges full levels."""
        for name in self.names():
            settled = self.spark.table(name).where(F.col("docs") >= self.min_docs).withColumnRenamed("last", "settled")
            # a null last is a batch without ids, which changes nothing for a key that has settled
            batch = batch.join(settled.drop("docs"), (batch.h1 == settled.h1) & (batch.h2 == settled.h2) & (F.coalesce(batch["last"] <= settled.settled, batch["last"].isNull())), "left_anti")
        self._put(0, self._write(batch))

    def _put(self, level: int, name: str) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(name)
        if len(self.levels[level]) == self.fanout:
            full, merged = self.levels[level], self._write(self._merged(self.levels[level]))
            self.levels[level] = []
            self._put(level + 1, merged)
            self._drop(full)

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, f"{self.folder}/{name}")

    def frequent(self) -> DataFrame:
        """(h1, h2, last) of the keys that enough documents hold, over all runs."""
        return self._merged(self.names()).where(F.col("docs") >= self.min_docs).drop("docs")

    def close(self) -> None:
        """Drops the tables of all runs."""
        self._drop(self.names())
        self.levels = []


def dropped_places(lines: DataFrame, frequent: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, drop): by row of documents with dropped lines, an array that tells for each place if it goes."""
    each = lines.select(*_ROW, F.explode("lines").alias("x")).select(*_ROW, "x.*")
    gone = each.join(frequent, _HASH).where(F.coalesce(F.col("doc_id") < F.col("last"), F.col("last").isNotNull()))
    places = gone.groupBy(*_ROW).agg(F.array_sort(F.collect_set("place")).alias("places"))
    # from sorted places to one flag a line: so many that stay, then one that goes
    gap = F.transform("places", lambda p, i: F.concat(F.array_repeat(F.lit(False), p - F.coalesce(F.get(F.col("places"), i - 1), F.lit(-1)) - 1), F.array(F.lit(True))))
    return places.select(*_ROW, F.size("places").cast("long").alias("n_dropped"), F.flatten(gap).alias("drop"))


def without_repeated_lines(docs: DataFrame, *, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = BATCHES, fanout: int = FANOUT) -> DataFrame:
    """All rows and columns of documents with the lines that stay as text, and with n_lines (before) and n_dropped."""
    spark = docs.sparkSession
    path = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    hashed_lines(docs, min_chars=min_chars, batches=batches).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema("doc_id long, t1 long, t2 long, lines array<struct<h1: long, h2: long, place: int>>, batch int").parquet(path)
    runs = Runs(spark, fanout=fanout, min_docs=min_docs)
    for batch in range(batches):
        runs.add(counted(lines.where(F.col("batch") == batch)))
    frequent = f"{path}-frequent"
    runs.frequent().write.parquet(frequent)
    runs.close()
    drop = dropped_places(lines, spark.read.parquet(frequent))
    drop = drop.select(F.col("doc_id").alias("__ev_id"), F.col("t1").alias("__ev_t1"), F.col("t2").alias("__ev_t2"), F.col("n_dropped").alias("__ev_n"), F.col("drop").alias("__ev_drop"))
    text = text_or_empty()
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("__ev_id")) & (F.xxhash64(text) == F.col("__ev_t1")) & (F.xxhash64(F.lit(11), text) == F.col("__ev_t2"))
    joined = docs.join(drop, same, "left")
    kept = F.array_join(F.filter(lines_of(text), lambda x, i: ~F.coalesce(F.get(F.col("__ev_drop"), i), F.lit(False))), "\n")
    columns = [F.col(c) for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    return joined.select(
        *columns,
        F.when(F.col("__ev_n").isNull(), text).otherwise(kept).alias("text"),
        F.size(lines_of(text)).cast("long").alias("n_lines"),
        F.coalesce("__ev_n", F.lit(0)).alias("n_dropped"),
    )


#: The same in SQL over whole keys instead of hashes.
ORACLE_SQL = r"""
WITH lines AS (
  SELECT doc_id, id, unnest(string_split(body, chr(10))) AS line, unnest(range(len(string_split(body, chr(10))))) AS place
  FROM (SELECT doc_id, coalesce(text, '') AS body, row_number() OVER () AS id FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines
), frequent AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT id) >= 3
), judged AS (
  SELECT k.*, coalesce(k.doc_id < f.last, f.last IS NOT NULL) AS gone FROM keyed k LEFT JOIN frequent f ON k.key = f.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id, id
"""
