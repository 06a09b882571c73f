"""What the learned operators may leave out, and what they may not."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

pytest.importorskip("stemma.llm")
from stemma.llm import html_extract, language_id  # noqa: E402


def test_a_long_text_pushes_no_other_out():
    train = [(b"x", 0, 0)] * 5000 + [(b"y", 0, i) for i in range(1, 40)] + [(b"z", 1, i) for i in range(40, 43)]
    kept = language_id.bounded(train, 100)
    assert {i for _, _, i in kept} == set(range(43)) and len(kept) == 100
    assert language_id.bounded(train, len(train)) == train


def test_a_rare_language_is_sampled(spark):
    rows = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("text").alias("text"), F.when(F.col("id") % 10_000 == 7, "sv").otherwise("en").alias("lang"))
    found = language_id.sampled(rows, 50)
    assert sum(r["lang"] == "sv" for r in found) == 2 and len(found) == 50


def test_all_words_of_an_attribute_count():
    paths, texts, _ = html_extract.blocks("<body><div class='flex w-full items-center px-4 py-2 md-hidden sidebar'><p>Aside.</p></div><p>Text.</p></body>")
    assert texts == ["Aside.", "Text."] and [html_extract.away(p) for p in paths] == [True, False]
