"""The registered queries of this subpackage: one for each operator, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.session import ship

from . import cap_filters, decontaminate, gru_lm, language_bits, licenses, line_runs, ordinal, packing, shards, simhash


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents; links at 4 or fewer bits."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All licenses and notices found in whole documents."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 8 shards by rendezvous hashing of doc_id."""
    return shards.sharded(table(spark, sf_dir, "documents"))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade (0 toxic, 1 poor, 2 good), tail probabilities and selection of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = ordinal.train(docs, ordinal.ratings(table(spark, sf_dir, "labels")))
    out = ordinal.graded(docs, model)
    tails = F.col("quality_tails.tails")
    return out.select("doc_id", F.col("quality_tails.expected").alias("expected_grade"), tails[0].alias("p_grade_1_up"), tails[1].alias("p_grade_2_up"), F.col("quality_tails.selected").alias("selected"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without later copies of line runs of 50 words or more."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n"))).cast("long")
    out, _, removed = line_runs.without_repeats(docs.withColumn("n_lines", lines))
    return out.select("doc_id", "n_lines", F.col(removed).cast("long").alias("n_removed"), "text")


def op6_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of cosine 0.95 or more among all embeddings, and their components."""
    return cap_filters.near_vectors(table(spark, sf_dir, "embeddings"))


def op7_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigram and network scores of all documents, learnt from six sevenths of them."""
    return gru_lm.scores(table(spark, sf_dir, "documents"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents, learnt from two thirds of them."""
    return language_bits.languages(table(spark, sf_dir, "documents"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark words in all documents."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of at most 4096 tokens."""
    return packing.packed(table(spark, sf_dir, "documents"), tokenizer_path())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_simhash, op2_licenses, op3_sharding, op4_quality, op5_line_dedup, op6_near_vectors, op7_lm_scores, op8_language_id, op9_decontamination, op10_packing)}


def oracle_sql() -> dict[str, str]:
    return {"op5_line_dedup": line_runs.ORACLE, "op6_near_vectors": cap_filters.ORACLE, "op9_decontamination": decontaminate.ORACLE}
