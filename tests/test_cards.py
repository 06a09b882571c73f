"""Cards of nodes whose sections have the same slots."""

from __future__ import annotations

from pyspark.sql import functions as F
from test_search import corpus  # noqa: F401

from stemma.operators import reading as D
from stemma.plans.corpus import Corpus


def contexts(corpus, *nodes):  # noqa: F811
    return {r["node"]: r["context"] for r in D.inspected(corpus, corpus.nodes.where(F.col("node").isin(*nodes)).select("node")).collect()}


def test_a_section_is_not_in_its_only_part(corpus):  # noqa: F811
    assert contexts(corpus, 25, 27) == {25: ["chapter", "sentence", "book"], 27: ["sentence", "book"]}  # both have the slots 9 to 12


def test_sections_of_one_order(spark):
    levels = ["region", "nation", "customer", "order"]
    rows = [("t", i, "item", i, i, 1, i) for i in (1, 2, 3)] + [("t", 4 + i, t, 1, 3, 3, 7) for i, t in enumerate(levels)]
    nodes = spark.createDataFrame(rows, "corpus string, node long, otype string, first_slot long, last_slot long, n_slots long, key long")
    slots = spark.createDataFrame([("t", i, "N", " ") for i in (1, 2, 3)], "corpus string, slot long, text string, after string")
    features = spark.createDataFrame([("t", "name", 4, "R", None), ("t", "name", 5, "N", None)], "corpus string, feature string, node long, value_str string, value_int long")
    edges = spark.createDataFrame([], "corpus string, feature string, src long, dst long, value string")
    one = Corpus(slots, nodes, features, edges, levels, {"region": "name", "nation": "name", "customer": "key", "order": "key"}, {}, "item")
    assert contexts(one, 1, 4, 6) == {1: ["order", "customer", "nation", "region"], 4: [], 6: ["nation", "region"]}
