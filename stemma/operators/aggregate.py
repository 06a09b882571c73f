"""Aggregations over corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.corpus import Corpus
from .structure import prefixed


def top_values(corpus: Corpus, feature: str, k: int) -> DataFrame:
    """value, n, rank of a feature's k commonest values, ties by value. A02."""
    by = corpus.feature(feature).groupBy(F.col(feature).alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return by.orderBy(F.desc("n"), "value").limit(k).withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n"), "value")))


def occurrence_counts(corpus: Corpus, feature: str, section_type: str) -> DataFrame:
    """section (its key), value, in_section, in_corpus for a slot feature. A04."""
    slot = corpus.feature(feature).select("corpus", F.col("node").alias("first_slot"), F.col(feature).alias("value"))
    s = prefixed(corpus.of_type(section_type).where("first_slot is not null"), "p")
    # sections of one level are few and don't overlap; their spans are spread by buckets of slots
    width = 4096
    s = s.withColumn("bucket", F.explode(F.sequence(F.expr(f"p_first_slot div {width}"), F.expr(f"p_last_slot div {width}"))))
    hit = slot.withColumn("bucket", F.expr(f"first_slot div {width}")).join(s, ["corpus", "bucket"]).where("first_slot between p_first_slot and p_last_slot")
    by = hit.groupBy(F.col("p_key").alias("section"), "value").agg(F.count(F.lit(1)).alias("in_section"))
    total = by.groupBy("value").agg(F.sum("in_section").alias("in_corpus"))
    return by.join(total, "value")


def slot_ranges(members: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_slots and ranges (lo, hi) of a node's slots; members has a row for each slot. S02 backwards."""
    w = Window.partitionBy(*keys).orderBy("slot")
    runs = members.distinct().withColumn("run", F.col("slot") - F.row_number().over(w))
    parts = runs.groupBy(*keys, "run").agg(F.min("slot").alias("lo"), F.max("slot").alias("hi"), F.count(F.lit(1)).alias("n"))
    return parts.groupBy(*keys).agg(F.sum("n").alias("n_slots"), F.array_sort(F.collect_list(F.struct("lo", "hi"))).alias("ranges"))
