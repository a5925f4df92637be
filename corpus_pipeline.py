"""A training-data pipeline over ``documents``: each stage calls one operator of ``pixelmill.llm``.

:func:`run` writes a stage's result, reads it again for the next and deletes what no later stage
reads.  Who calls stages on their own writes each result before calling the next stage: a stage
first deletes the tables that earlier stages of the same thread left and its own input doesn't read.
"""

from __future__ import annotations

import functools
import threading

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelmill.llm import decontaminate, line_runs, near_sets, ordinal, packing
from pixelmill.llm.queries import table, tokenizer_path
from pixelmill.llm.storage import drop, scope, tables_of, written


def _stage(order: int):
    """A stage whose result's tables stay until a later stage of the thread starts on other documents."""

    def wrap(work):
        @functools.wraps(work)
        def call(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
            if not hasattr(spark, "_stage_tables"):
                spark._stage_tables = {}
            left, me, needed = spark._stage_tables, threading.get_ident(), tables_of(spark, docs)
            for key in [k for k in left if k[0] == me and k[1] < order]:
                old = left.pop(key)
                drop(spark, [p for p in old if p not in needed])
                left[key] = [p for p in old if p in needed]
            out = work(spark, docs, sf_dir)
            left[me, order] = left.get((me, order), []) + tables_of(spark, out)
            return out

        return call

    return wrap


@_stage(0)
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents stay whose chance of the top grade (neither toxic nor poor) is one half or more."""
    model = ordinal.train(docs, ordinal.ratings(table(spark, sf_dir, "labels")))
    rated = ordinal.graded(docs, model)
    return rated.where(F.col(rated.columns[-1])["selected"]).select(docs.columns)


@_stage(1)
def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of line runs of 50 words or more are cut; documents of which nothing is left go."""
    out, _, removed = line_runs.without_repeats(docs)
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike(line_runs.WORD)
    kept = out.where((F.col(removed) == 0) | ~blank).select(docs.columns).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return kept


@_stage(2)
def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a five-word Jaccard similarity of 0.8 or more stays: that with the smallest doc_id."""
    return near_sets.one_of_each(docs)


@_stage(3)
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold ten consecutive words of a benchmark item go."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


@_stage(4)
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all remaining documents and their places in sequences of at most 4096 tokens."""
    return packing.packed(docs, tokenizer_path())


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packing_stage),
]

#: Hashing, the classifier and the tokenizer have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again; of a run that fails no table stays."""
    docs = table(spark, sf_dir, "documents")
    with scope() as made:
        try:
            for name, stage in STAGES[:-1]:
                docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
                kept = tables_of(spark, docs)
                drop(spark, [p for p in made if p not in kept])
            out = STAGES[-1][1](spark, docs, sf_dir)
            kept = tables_of(spark, out)
            drop(spark, [p for p in made if p not in kept])
            return out
        except BaseException:
            drop(spark, made)
            raise
