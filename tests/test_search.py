"""The 12-slot fixture: search, structure and references against brute force and worked examples."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from stemma.functions import refs as R
from stemma.operators import search as S
from stemma.operators import structure as H
from stemma.plans.corpus import Corpus

WORDS = "Call me Ishmael . Some years ago , I sailed forth .".split()
SPANS = {13: (1, 4), 14: (5, 12), 15: (1, 4), 16: (5, 10), 17: (11, 12), 18: (1, 2), 19: (3, 3), 20: (5, 7), 21: (8, 10), 22: (11, 12), 23: (1, 4), 24: (5, 8), 25: (9, 12), 26: (1, 8), 27: (9, 12), 28: (1, 12)}
TYPES = {13: "sentence", 14: "sentence", 15: "clause", 16: "clause", 17: "clause", 18: "phrase", 19: "phrase", 20: "phrase", 21: "phrase", 22: "phrase", 23: "para", 24: "para", 25: "para", 26: "chapter", 27: "chapter", 28: "book"}


@pytest.fixture(scope="module")
def corpus(spark):
    slots = spark.createDataFrame([("m", i + 1, w, " ") for i, w in enumerate(WORDS)], "corpus string, slot long, text string, after string")
    rows = [("m", i + 1, "word", i + 1, i + 1, 1, i + 1) for i in range(12)] + [("m", n, TYPES[n], a, b, b - a + 1, n) for n, (a, b) in SPANS.items()]
    nodes = spark.createDataFrame(rows, "corpus string, node long, otype string, first_slot long, last_slot long, n_slots long, key long")
    f = [("m", "text", i + 1, w, None) for i, w in enumerate(WORDS)] + [("m", "para", 23, None, 1), ("m", "para", 24, None, 2), ("m", "para", 25, None, 1), ("m", "chapter", 26, None, 1), ("m", "chapter", 27, None, 2), ("m", "book", 28, "B", None)]
    features = spark.createDataFrame(f, "corpus string, feature string, node long, value_str string, value_int long")
    edges = spark.createDataFrame([("m", "mother", 16, 15, None)], "corpus string, feature string, src long, dst long, value string")
    return Corpus(slots, nodes, features, edges, ["book", "chapter", "para"], {"book": "book", "chapter": "chapter", "para": "para"}, {"para": "int", "chapter": "int"}, "word")


def tuples(found):
    return sorted(tuple(r[c] for c in S.result_nodes(found)) for r in found.collect())


def nodes_of(t):
    return [n for n, x in TYPES.items() if x == t] if t != "word" else list(range(1, 13))


def span(n):
    return SPANS.get(n, (n, n))


def inside(c, p):
    return span(p)[0] <= span(c)[0] and span(c)[1] <= span(p)[1] and c != p


@pytest.mark.parametrize("parent,child", [("sentence", "clause"), ("chapter", "phrase"), ("para", "word"), ("clause", "phrase")])
def test_containment_is_brute_force(corpus, parent, child):
    got = tuples(S.search(corpus, f"{parent}\n  {child}"))
    assert got == sorted((p, c) for p in nodes_of(parent) for c in nodes_of(child) if inside(c, p))


def test_relations(corpus):
    assert tuples(S.search(corpus, "phrase\n<: phrase")) == sorted((a, b) for a in nodes_of("phrase") for b in nodes_of("phrase") if span(a)[1] + 1 == span(b)[0])
    assert tuples(S.search(corpus, "sentence\n=: clause")) == [(13, 15)]
    over = lambda a, b: span(a)[0] <= span(b)[1] and span(b)[0] <= span(a)[1]
    assert tuples(S.search(corpus, "clause\n|| para")) == sorted((a, b) for a in nodes_of("clause") for b in nodes_of("para") if over(a, b))
    assert tuples(S.search(corpus, "clause\n-mother> clause")) == [(16, 15)]
    before = tuples(S.search(corpus, "sentence\n  phrase\n  < phrase"))
    assert before == sorted((s, a, b) for s in nodes_of("sentence") for a in nodes_of("phrase") for b in nodes_of("phrase") if inside(a, s) and inside(b, s) and span(a)[1] < span(b)[0])


def test_conditions_and_quantifiers(corpus):
    assert tuples(S.search(corpus, "word text~^[Ss]")) == [(5,), (10,)]
    assert tuples(S.search(corpus, "para para>1")) == [(24,)]
    assert tuples(S.search(corpus, "chapter\n/without/\n  word text=me\n/-/")) == [(27,)]
    assert tuples(S.search(corpus, "para\n/where/\n  word text=me\n/or/\n  word text=forth\n/-/")) == [(23,), (25,)]
    assert tuples(S.search(corpus, "word text=me\n/or/\nword text=ago")) == [(2,), (7,)]


@pytest.mark.parametrize("bad", ["", "word\nword", "word\n< word", "/where/\n  word\n/-/", "word text", "word\n/where/\n  word", "word\n/maybe/\n/-/"])
def test_bad_templates_are_errors(corpus, bad):
    with pytest.raises(S.TemplateError):
        S.search(corpus, bad)


def test_pages_cover_all_results_once(corpus):
    found = S.search(corpus, "sentence\n  word")
    seen, last = [], None
    while True:
        page = S.page(found, 5, last).collect()
        if not page:
            break
        seen += [(r["n1"], r["n2"]) for r in page]
        last = page[-1].asDict()
    assert sorted(seen) == tuples(found) and len(seen) == len(set(seen))


def test_text_sections_and_plans(corpus):
    assert {r["node"]: r["text"] for r in H.node_text(corpus, corpus.of_type("sentence")).collect()}[13] == "Call me Ishmael ."
    anchor = {r["node"]: r["section_node"] for r in H.enclosing_sections(corpus, corpus.of_type("clause")).collect()}
    assert anchor == {15: 23, 16: 24, 17: 25}
    plan = S.search(corpus, "chapter\n  clause")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


@pytest.mark.parametrize("ref,node,status", [("B", 28, "resolved"), ("B:2", 27, "resolved"), ("B:1:2", 24, "resolved"), ("B:1:2!clause1", 16, "resolved"), ("B:2:1!clause1", 17, "resolved"), ("B:2:1!clause2", None, "index_out_of_range"), ("B:1!clause2", 16, "resolved"), ("B:2!sentence1", None, "type_not_in_section"), ("X:1", None, "section_not_found"), ("m@9/B:1", None, "version_mismatch"), ("A::1", None, "invalid")])
def test_references(spark, corpus, ref, node, status):
    from stemma.operators.reference import resolve

    asked = spark.createDataFrame([(1, ref)], "id long, ref string").select("id", R.parse(F.col("ref")).alias("r"))
    assert [(r["node"], r["status"]) for r in resolve(corpus, asked, "0.1").collect()] == [(node, status)]


def test_serialize_resolves_back(spark, corpus):
    from stemma.operators.reference import resolve, serialize

    made = {r["node"]: r["ref"] for r in serialize(corpus, "clause", "m", "0.1").collect()}
    assert made[16] == "m@0.1/B:1:2!clause1"
    asked = spark.createDataFrame(list(made.items()), "id long, ref string").select("id", R.parse(F.col("ref")).alias("r"))
    assert {r["id"]: r["node"] for r in resolve(corpus, asked, "0.1").collect()} == {n: n for n in made}
