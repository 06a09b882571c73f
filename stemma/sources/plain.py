"""Plain text as units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def paragraphs(docs: DataFrame, text: str = "text") -> DataFrame:
    """A row for each paragraph: id is its raw number between blank lines; blank ones are skipped. S09."""
    keys = [c for c in docs.columns if c != text]
    parts = docs.select(*keys, F.posexplode(F.split(text, "\n\n", -1)).alias("id", text))
    return parts.where(F.col(text).rlike(r"[^\s]"))
