"""Full-text search over an inverted index, in the plain configuration: lower case, runs of a-z and 0-9, no stemming."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TERM = "[a-z0-9]+"


def postings(fragments: DataFrame, key: str, text: str) -> DataFrame:
    """key, term, tf. Counted in two steps: inside the fragment by the map-side combine, then over the shuffle."""
    return fragments.select(key, F.explode(F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))).alias("term")).groupBy(key, "term").agg(F.count(F.lit(1)).alias("tf"))


def search(index: DataFrame, terms: list[str], limit: int) -> DataFrame:
    """The fragments that hold every term, by summed frequency; ties by key."""
    key = index.columns[0]
    hits = index.where(F.col("term").isin([t.lower() for t in terms])).groupBy(key).agg(F.sum("tf").alias("score"), F.count(F.lit(1)).alias("n")).where(F.col("n") == len(set(terms)))
    return hits.select(key, "score").orderBy(F.desc("score"), key).limit(limit)


def snippets(fragments: DataFrame, term: str) -> DataFrame:
    """fragments that hold the term, with snippet: its first line there, the term in <em>."""
    word = f"(?i:{re.escape(term)})"
    line = F.regexp_extract("text", rf"[^\n]*{word}[^\n]*", 0)
    return fragments.where(F.col("text").rlike(word)).withColumn("snippet", F.regexp_replace(line, f"({word})", "<em>$1</em>"))
