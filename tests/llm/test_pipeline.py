"""The pipeline against a brute-force version of its stages."""

from __future__ import annotations

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SF = "/root/testdata/sf0.001"


def shingles(text, k=5):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def test_stages_on_their_own_input(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stage(spark, docs, SF).cache()
        kept[name] = (before, docs)
        if name != "mix":
            assert docs.columns == before.columns
    # line dedup: brute force over windows in order
    before, after = (d.orderBy("doc_id").collect() for d in kept["line_dedup"])
    seen, left = set(), {}
    for r in before:
        lines = r["text"].split("\n")
        wins = [tuple(lines[i : i + 3]) for i in range(len(lines) - 2)]
        gone = set()
        for i, w in enumerate(wins):
            if not "".join(w).strip():
                continue
            if w in seen:
                gone |= {i, i + 1, i + 2}
            seen.add(w)
        text = "\n".join(x for i, x in enumerate(lines) if i not in gone)
        if not gone or text.strip():
            left[r["doc_id"]] = text
    assert {r["doc_id"]: r["text"] for r in after} == left
    # near duplicates: brute force over pairs
    before, after = (d.orderBy("doc_id").collect() for d in kept["near_dedup"])
    sets = {r["doc_id"]: shingles(r["text"]) for r in before}
    up = {i: i for i in sets}
    root = lambda x: x if up[x] == x else root(up[x])
    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    assert {r["doc_id"] for r in after} == {i for i in sets if root(i) == i}
    # decontamination: brute force over items
    items = [shingles(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    before, after = (d.collect() for d in kept["decontaminate"])
    clean = {r["doc_id"] for r in before if not any(s and 100 * len(s & shingles(r["text"])) >= 80 * len(s) for s in items)}
    assert {r["doc_id"] for r in after} == clean
    # toxicity takes out most of the labelled toxic documents and leaves the clean ones
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    before, after = ({r["doc_id"] for r in d.collect()} for d in kept["toxicity"])
    lost = before - after
    assert sum(toxic.get(i) == 0 for i in lost) <= 2
    # the mix
    assert kept["mix"][1].where("taken <= 0 or taken > 2 * size").count() == 0


def test_run_gives_the_same_rows(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0


def test_stages_on_odd_rows(spark):
    from pyspark.sql import functions as F

    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t", "en", "a", 3), (4, "one two three four five six", "en", "b", 9), (4, "one two three four five six", "en", "b", 9), (4, "other words of one id", "en", "b", 9), (None, "no id here at all", "fr", None, None), (5, "a\nb\nc\nd\ne", "en", None, 9), (6, "a\nb\nc\nx y", "en", None, 7), (7, "word " * 30_000, "en", "c", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit("9") for c in "n_lines n_removed h y c k a b rep component first_slot taken size __x".split()})
    for name, stage in corpus_pipeline.STAGES:
        after = stage(spark, docs, SF)
        if name == "mix":
            assert after.where("taken <= 0").count() == 0 and after.count() > 0
        else:
            assert after.columns == docs.columns and after.where("n_lines <> '9' or n_removed <> '9'").count() == 0
        assert stage(spark, docs.limit(0), SF).count() == 0
        if name == "near_dedup":
            assert after.where("doc_id is null").count() == 1 and after.where("doc_id = 4").count() == 3
        if name == "line_dedup":
            assert {r["doc_id"]: r["text"] for r in after.where("doc_id in (5, 6)").collect()} == {5: "a\nb\nc\nd\ne", 6: "x y"}
