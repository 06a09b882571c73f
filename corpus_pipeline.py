"""The corpus pipeline: five stages over documents, each written as Parquet and read again by the next.

toxicity            documents that score as toxic go (labels are learned from, not required)
line_dedup          lines covered by later occurrences of repeated three-line windows go; a document that
                    has no words left by that goes too
near_dedup          of each group of near duplicates (five-word shingles, 80 %) one document stays
decontaminate       documents that contain a benchmark item go
mix                 the documents that the mix takes words of stay, with the words taken (the last stage)

Edge cases: a null or empty text is neither toxic, a repeat, a copy nor a leak, and the mix takes no words of it, so it
goes in the last stage; repeated rows are one document to line_dedup and near_dedup; rows without a doc_id stay in
near_dedup; the mix takes as much of each of several rows that repeat doc_id, source and size; empty tables give an empty
result; other columns pass through every stage, whatever their names (those that the last stage adds take the place of
columns of their names).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stemma.llm import decontaminate, line_dedup, mixing, near_dedup, toxicity
from stemma.llm._common import SPACE, n_words, read, shared_table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the toxic ones; the model learns from the labelled rows of docs outside the held-out fold."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, read(spark, sf_dir, "labels")))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs less their repeated passages, n_chars counted anew where a text changed."""
    own = {c: f"__input_{c}" for c in ("n_lines", "n_removed") if c in docs.columns}
    out = line_dedup.line_dedup(docs.withColumnsRenamed(own))
    empty = F.regexp_replace("text", SPACE, "") == ""
    out = out.where((F.col("n_removed") == 0) | ~empty)
    out = out.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return out.select(*[F.col(own.get(c, c)).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: the one with the smallest doc_id."""
    gone = near_dedup.near_dedup(docs, k=5).where(~F.col("kept") & F.col("doc_id").isNotNull()).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without those that contain a benchmark item."""
    return decontaminate.decontaminate(docs, read(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes words of, with size, source_size, target, taken and first_slot."""
    new = ["source_size", "target", "taken", "first_slot"]
    key = ["doc_id", "source", "size"]
    mixed = mixing.mix_sources(docs)[1].groupBy(*key).agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.ceil(F.avg("taken")).alias("taken"), F.min("first_slot").alias("first_slot"))
    mixed = mixed.where("taken > 0").select(*[F.col(c).alias(f"__mix_{c}") for c in key], *new)
    docs = docs.drop(*new).withColumn("size", n_words(F.col("text")))
    same = F.col("doc_id").eqNullSafe(F.col("__mix_doc_id")) & F.col("source").eqNullSafe(F.col("__mix_source")) & (F.col("size") == F.col("__mix_size"))
    return docs.join(mixed.hint("merge"), same).drop(*[f"__mix_{c}" for c in key])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("mix", mix),
]
#: SQL can't express the learned stage; tests hold the pipeline against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages applied to documents."""
    docs = read(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = shared_table(docs, f"stage-{name}")
    return docs
