"""Progress of a folder that gets one document per entity: how many are there, how fast they come, what they say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions import columns as C
from evidentia.operators.aggregates import nearest_rank
from evidentia.operators.progress import throughput
from evidentia.plans.validated import MEASURED, PLACES, document_biomarkers, document_lesions
from evidentia.sources.readers import entity_documents, point
from evidentia.streaming.monitor import checkpoint_folder

#: Newest documents that give the rate, and that are summed up.
RATE_OF, RECENT = 50, 300


def _files(spark: SparkSession, pattern: str) -> DataFrame:
    """path and time of the files, without their content. A folder is listed in tasks, a pattern by the driver."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(pattern).select("path", "modificationTime")


def folder_progress(spark: SparkSession, pattern: str, total: int, newest: int = RATE_OF) -> DataFrame:
    """One row: total, done, missing, rate per second over the newest files, and the seconds that the rest will take."""
    files = _files(spark, pattern).withColumn("__all", F.lit(0))
    found = throughput(files, ["__all"], "modificationTime", total, newest)
    empty = spark.range(1).select(F.lit(0).alias("__all"))
    whole = empty.join(found, "__all", "left").select(F.lit(total).cast("bigint").alias("total"), F.coalesce("done", F.lit(0)).alias("done"), "rate", "eta_seconds")
    return whole.withColumn("missing", F.greatest(F.col("total") - F.col("done"), F.lit(0)))


def recent_documents(spark: SparkSession, pattern: str, n: int | None = RECENT) -> DataFrame:
    """entity, path and doc of the n newest documents, all with None; only these files are opened.

    The n paths pass the driver; n is a report's size, not the data's."""
    if n is None:
        return entity_documents(spark, pattern).select("entity", "path", "doc")
    newest = [r.path for r in _files(spark, pattern).orderBy(F.desc("modificationTime"), "path").limit(n).collect()]
    if not newest:
        return entity_documents(spark, pattern).select("entity", "path", "doc").limit(0)
    return entity_documents(spark, newest).select("entity", "path", "doc")


def summary_of_documents(docs: DataFrame) -> DataFrame:
    """One row: scanned (documents that can be read), the share with each measured lesion and its sums by quadrant, eyes,
    the shares with the vessels' flag and with disc and macula too far apart, and the middle of the biomarkers."""
    known = docs.where("doc IS NOT NULL").select(F.col("path").alias("record_id"), F.lit(None).cast("int").alias("grade"), "doc")
    # read by each of the joins and ranks below, so the files are opened once
    folder = checkpoint_folder(docs.sparkSession)
    known.write.parquet(folder)
    known = docs.sparkSession.read.schema(known.schema).parquet(folder)
    per = known.join(_lesions(known), "record_id", "left").join(document_biomarkers(known).drop("grade"), "record_id", "left")
    doc = F.col("doc")
    disc, macula = point(doc, "$.measurements.optic_disc_cup.disc.center"), point(doc, "$.measurements.macula.center")
    radius = F.try_variant_get(doc, "$.measurements.optic_disc_cup.disc.radius", "double")
    odd = F.coalesce(~C.vertical_geometry(disc["y"], macula["y"], radius) & disc.isNotNull() & macula.isNotNull() & radius.isNotNull(), F.lit(False))
    eye = F.lower("eye_side")
    share = lambda c: F.coalesce(F.avg(F.coalesce(c, F.lit(False)).cast("double")), F.lit(0.0))
    out = [F.count("*").alias("scanned"), share(F.col("vessel_qc")).alias("qc_rate"), share(odd).alias("odd_rate")]
    for name in MEASURED:
        out.append(share(F.col(f"{name}_n") > 0).alias(f"{name.lower()}_rate"))
        out += [F.coalesce(F.sum(f"{name}_{q}"), F.lit(0)).cast("bigint").alias(f"{name.lower()}_{q.lower()}") for q in PLACES]
    for side in ("left", "right"):
        out.append(F.count(F.when(eye == side, 1)).alias(f"eye_{side}"))
    out.append(F.count(F.when(~F.coalesce(eye.isin("left", "right"), F.lit(False)), 1)).alias("eye_unknown"))
    summed = per.agg(*out)
    for name in ("av_ratio", "cdr", "tortuosity"):
        ranks = nearest_rank(per, [], name, (10, 50, 90)).select(F.coalesce("n", F.lit(0)).alias(f"{name}_n"), *[F.col(f"p{p}").alias(f"{name}_p{p}") for p in (10, 50, 90)])
        summed = summed.join(F.broadcast(ranks), how="left", on=F.lit(True))
    return summed


def _lesions(known: DataFrame) -> DataFrame:
    rows = document_lesions(known).where("record_id IS NOT NULL")
    each = [F.max(F.when(F.col("lesion") == x, F.col("count"))).alias(f"{x}_n") for x in MEASURED]
    each += [F.max(F.when(F.col("lesion") == x, F.col(q))).alias(f"{x}_{q}") for x in MEASURED for q in PLACES]
    return rows.groupBy("record_id").agg(*each)
