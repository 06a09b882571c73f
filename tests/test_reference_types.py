"""References that name many types."""

from __future__ import annotations

from pyspark.sql import functions as F
from test_search import corpus  # noqa: F401

from stemma.functions import refs as R
from stemma.operators.reference import resolve


def test_misspelt_types_hide_no_other(spark, corpus):  # noqa: F811
    letters = "abcdefghijklmnopqrstuvwxyz"
    wrong = [f"B:1:2!x{a}{b}{c}1" for a in letters for b in letters for c in "xyz"]
    right = {"B:1:2!clause1": 16, "B:1:2!phrase1": 20, "B:1!sentence1": 13}
    asked = spark.createDataFrame([(r,) for r in [*wrong, *right]], "id string").select("id", R.parse(F.col("id")).alias("r"))
    got = {r["id"]: (r["node"], r["status"]) for r in resolve(corpus, asked, "0.1").collect()}
    assert {r: got[r] for r in right} == {r: (n, "resolved") for r, n in right.items()}
    assert {got[r] for r in wrong} == {(None, "type_not_in_section")}
