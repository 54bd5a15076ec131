"""The corpus pipeline: stages that each work on all that the one before kept."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqlake.llm.common import drop_table, fresh, materialize, table
from seqlake.llm.exactdedup import drop_exact_copies
from seqlake.llm.jaccard import drop_similar
from seqlake.llm.mixing import mix
from seqlake.llm.packing import pack, token_pieces
from seqlake.llm.quality import keep_good
from seqlake.llm.queries import TARGET_WEIGHTS, label_domains, trusted_ids, word_vocabulary


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity is within the limit of their language."""
    return keep_good(docs, trusted_ids(spark, sf_dir))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest id."""
    return drop_exact_copies(docs)


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of similar documents the one with the smallest id."""
    return drop_similar(docs)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the rates for the target weights say, good ones at least once; totals follow the rates."""
    mixed = mix(docs, label_domains(spark, docs, sf_dir), TARGET_WEIGHTS, anchor="good", floor=1.0)
    copies, (copy,) = mixed.columns[-1], fresh(mixed, "_copy")
    taken = mixed.where(F.col(copies) > 0)
    return taken.select(*docs.columns, F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias(copy)).drop(copy)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per token piece: its document, and the sequence and offset where it lies."""
    return pack(token_pieces(docs, word_vocabulary())).withColumnRenamed("id", "doc_id")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", quality_classifier),
    ("exact_dedup", exact_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("source_mixing", source_mixing),
    ("best_fit_packing", best_fit_packing),
]

#: Perplexities, components and packing are beyond SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:
            drop_table(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
