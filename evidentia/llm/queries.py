"""The queries of the text operators, each over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.llm import clustering, decontam, fingerprint, licences, linededup, neardup, packing, pages, pii, prefixes, quality, sharding, sst


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lstm_crf_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: counts and digest of the patterns' spans, and all spans."""
    found = pii.personal_data(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans")


def op2_probminhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its class of near-duplicates, the class's size and whether the document is the one kept."""
    found = neardup.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "class_size", F.col("kept").alias("is_kept"))


def op3_licence_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its known licence sentences and its licences."""
    return licences.licensed(_table(spark, sf_dir, "documents"))


def op4_ffd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per piece of a document: its place in the document and in its packed sequence."""
    packed = packing.digest(packing.pack(_table(spark, sf_dir, "documents")))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op5_minhash_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document and benchmark item that it contains, with the share of the item's shingles."""
    return decontam.contained_items(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its quality score and decision."""
    found = quality.scored(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", "predicted")


def op7_sst_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document as read back from the shards."""
    read = sst.round_trip(_table(spark, sf_dir, "documents"))
    return read.select("doc_id", "start", "n_tokens", "ids_crc32")


def op8_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its size, checksum, shard and place in the shard."""
    found = sharding.sharded(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long"), F.lit(None).cast("int").alias("grown_shard"))


def op9_locally_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its fingerprint, its edited text's, and the likenesses to this and to the next document's."""
    return fingerprint.fingerprinted(_table(spark, sf_dir, "documents"))


def op10_page_differencing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per page: its main text."""
    return pages.extracted(_table(spark, sf_dir, "pages"))


def op11_heavy_path_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per node of the trie of the rebuilt conversations' prefixes: its members, children and subtree sums."""
    rebuilt = prefixes.rebuilt(prefixes.ranked(_table(spark, sf_dir, "conversations")))
    return prefixes.digest(prefixes.trie(rebuilt))


def op12_levelled_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document: its lines, how many were dropped, and the digest of the text that stays."""
    kept = linededup.without_repeated_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_weighted_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per kept vector: its cluster, distance, both inertias and its centroid's digest."""
    found = clustering.clustered(_table(spark, sf_dir, "embeddings"))
    return found.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the corpus pipeline."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        op1_lstm_crf_pii, op2_probminhash_dedup, op3_licence_sentences, op4_ffd_packing, op5_minhash_containment,
        op6_factorisation_machine, op7_sst_shards, op8_label_propagation, op9_locally_consistent, op10_page_differencing,
        op11_heavy_path_trie, op12_levelled_line_runs, op13_weighted_lloyd, pipeline,
    )
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_licence_sentences": licences.oracle_sql(), "op5_minhash_containment": decontam.ORACLE_SQL, "op11_heavy_path_trie": prefixes.ORACLE_SQL, "op12_levelled_line_runs": linededup.ORACLE_SQL, "op13_weighted_lloyd": clustering.oracle_sql()}
