"""The operators for training data: SQL, brute force, the tokenizer's own library, held-out accuracy, and edge cases."""

from __future__ import annotations

import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

pytest.importorskip("stemma.llm")
from stemma.llm import _common, decontaminate, html_extract, language_id, license_scan, line_dedup, mixing, near_dedup, quality, registry, token_count, toxicity  # noqa: E402

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long, extra string"


def frame(spark, rows):
    """rows: (doc_id, text) or longer."""
    return spark.createDataFrame([(tuple(r) + (None,) * 6)[:6] for r in rows], DOC)


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and white texts, repeated rows, a null id, a very long text, and a column more."""
    long_ = " ".join(f"w{i % 900}" for i in range(60_000))
    rows = [(1, None, None, None, None, None), (2, "", "en", "a", 0, "x"), (3, " \n\t", "en", "a", 3, None), (4, "one two three four five six", "en", "b", 9, None), (4, "one two three four five six", "en", "b", 9, None), (5, long_, None, "b", None, None), (None, "no id here at all", "fr", None, None, None), (6, "日本 😀", "en", "a", 4, None)]
    return frame(spark, rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_matches_sql(name, same_as_sql):
    same_as_sql(registry.QUERIES[name], registry.ORACLE[name])


# --- 1 line dedup -------------------------------------------------------------------------------------------
def test_line_dedup_keeps_the_first_occurrence(spark):
    d = frame(spark, [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\ny"), (3, "a\nb"), (4, "a\nb\nc\na\nb\nc"), (5, None), (6, "")])
    got = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in line_dedup.line_dedup(d).collect()}
    assert got == {1: ("a\nb\nc\nd", 4, 0), 2: ("x\ny", 5, 3), 3: ("a\nb", 2, 0), 4: ("", 6, 6), 5: (None, 0, 0), 6: ("", 1, 0)}


# --- 2 mixing -----------------------------------------------------------------------------------------------
def test_mix_meets_its_targets(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 90), "en", rng.choice("aaaaabc") if i % 50 else None) for i in range(900)]
    pieces, out = mixing.mix_sources(frame(spark, rows))
    by = {r["source"]: r for r in out.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("target"), F.max("source_size").alias("s")).collect()}
    assert all(abs(r["t"] - r["target"]) <= 1 and r["target"] <= 2 * r["s"] for r in by.values())
    assert out.where("taken > 2 * size").count() == 0 and out.count() == 900
    # the schedule interleaves: any tenth of it has about the mix's share of the hot source
    total = pieces.agg(F.sum(F.col("to_word") - F.col("from_word"))).first()[0]
    mid = pieces.agg(F.expr("percentile(slot, 0.5)")).first()[0]
    first = pieces.where((F.col("source") == "a") & (F.col("slot") < mid)).agg(F.sum(F.col("to_word") - F.col("from_word"))).first()[0]
    assert abs(first / (total / 2) - by["a"]["t"] / total) < 0.05


# --- 3 decontamination --------------------------------------------------------------------------------------
def test_leaks_are_brute_force(spark):
    rng = random.Random(5)
    words = lambda n: [f"w{rng.randint(0, 400)}" for _ in range(n)]
    items = [words(n) for n in (3, 7, 20, 33, 60)]
    docs = []
    for i in range(60):
        body = words(rng.randint(0, 400))
        it = list(items[i % 5])
        for _ in range(rng.choice([0, 0, 1, 3])):
            it[rng.randrange(len(it))] = "new"
        at = rng.randint(0, len(body))
        docs.append((i, " ".join(body[:at] + it + body[at:]).upper() if i % 2 else " ".join(body[:at] + it + body[at:])))
    b = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)] + [(90, ""), (91, None)], "item_id long, text string")
    sh = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    want = set()
    for i, t in docs:
        for k, w in enumerate(items):
            n = min(5, len(w))
            s = sh(w, n)
            if 100 * len(s & sh(t.lower().split(), n)) >= 80 * len(s):
                want.add((i, k))
    got = decontaminate.leaks(frame(spark, docs), b)
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == want and want
    assert {r["doc_id"] for r in decontaminate.decontaminate(frame(spark, docs), b).collect()} == set(range(60)) - {i for i, _ in want}


# --- 4 near duplicates --------------------------------------------------------------------------------------
def test_near_dedup_is_brute_force(spark):
    rng = random.Random(8)
    base = [[f"w{rng.randint(0, 3000)}" for _ in range(n)] for n in (5, 12, 40, 90, 147)]
    docs = []
    for i in range(400):
        w = list(base[i % 5])
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):  # copies with few and many edits, some far from all others
            k = rng.randrange(len(w))
            w[k : k + 1] = rng.choice([[], [f"n{rng.randint(0, 50)}"], [w[k], "the"]])
            w = w or ["x"]
        docs.append((i, " ".join(w)))
    docs += [(900, None), (901, ""), (902, "one two")]
    sets = {i: ({tuple(w[j : j + 4]) for j in range(len(w) - 3)} if len(w := (t or "").split()) >= 4 else {tuple(w)} if w else set()) for i, t in docs}
    up = {i: i for i in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    got = {r["doc_id"]: r for r in near_dedup.near_dedup(frame(spark, docs), k=4).collect()}
    assert {i: (len(sets[i]), root(i), root(i) == i) for i in ids} == {i: (r["n_shingles"], r["component_id"], r["kept"]) for i, r in got.items()}


def test_near_dedup_rows_that_repeat_an_id(spark):
    a, b = list("abcdefgh"), list("pqrstuvw")
    docs = [(1, " ".join(a)), (1, " ".join(b)), (2, " ".join(a + ["i"])), (3, " ".join(b + ["x"])), (5, " ".join(a)), (None, " ".join(b)), (6, "else"), (6, "else")]
    got = {(r["doc_id"], r["component_id"], r["kept"]) for r in near_dedup.near_dedup(frame(spark, docs), k=4).collect()}
    assert got == {(1, 1, True), (2, 1, False), (3, 1, False), (5, 1, False), (None, 1, False), (6, 6, True)}
    assert near_dedup.near_dedup(frame(spark, docs)).count() == len(docs)


def test_intermediate_tables_go(spark):
    import pathlib

    root = pathlib.Path(_common.shared_dir(spark).removeprefix("file:")) / f"stemma-{spark.sparkContext.applicationId}"
    before = {p.name for p in root.glob("*")}
    near_dedup.near_dedup(frame(spark, [(1, "a b c d e f"), (2, "a b c d e f")])).count()
    assert {p.name.split("-")[0] for p in root.glob("*") if p.name not in before} == {"near"}


def test_estimate_is_close():
    rng = np.random.default_rng(1)
    for share in (0.3, 0.8, 1.0):
        a = rng.integers(0, 2**63, 3000).astype(np.uint64)
        b = np.concatenate([a[: int(share * 3000)], rng.integers(0, 2**63, 3000 - int(share * 3000)).astype(np.uint64)])
        sig = near_dedup.registers(np.concatenate([np.unique(a), np.unique(b)]), np.array([0, 3000, 6000]))
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        assert abs(near_dedup.estimate(sig[:1], sig[1:], np.array([3000]), np.array([3000]))[0] - true) < 0.12


# --- 5 language ---------------------------------------------------------------------------------------------
def test_language_is_learned(spark):
    rng = random.Random(2)
    parts = {"aa": ["ka", "lo", "mi"], "bb": ["str", "gh", "ung"], "cc": ["éa", "ôu", "çi"]}
    rows = [(i, " ".join("".join(rng.choices(parts[g], k=3)) for _ in range(rng.randint(3, 40))), g) for i in range(300) for g in [list(parts)[i % 3]]]
    d = frame(spark, rows + [(900, None), (901, "123 ...")])
    got = {r["doc_id"]: r for r in language_id.identify(d, language_id.train(d)).collect()}
    held = [i for i in range(300) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(got[i]["held_out"] for i in held) and sum(got[i]["lang_pred"] == rows[i][2] for i in held) >= 0.95 * len(held)
    assert (got[900]["lang_pred"], got[900]["score"], got[901]["lang_pred"]) == ("und", 0.0, "und")
    empty = d.limit(0)
    assert language_id.identify(empty, language_id.train(empty)).count() == 0


# --- 6 toxicity ---------------------------------------------------------------------------------------------
def test_toxicity_misspellings_and_quotation(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghil", k=rng.randint(3, 8)))
    rows, marks = [], []
    for i in range(600):
        w = [word() for _ in range(rng.randint(5, 60))]
        bad = i % 6 == 0
        if bad:
            for _ in range(3):
                w.insert(rng.randint(0, len(w)), rng.choice(["zorbly", "quxxer", "vompit"]))
        rows.append((i, " ".join(w)))
        marks.append((i, int(bad)))
    d, l = frame(spark, rows), spark.createDataFrame(marks, "doc_id long, toxic int")
    m = toxicity.train(d, l)
    got = {r["doc_id"]: r for r in toxicity.score_toxicity(d, m).collect()}
    assert sum(got[i]["predicted"] == y for i, y in marks) >= 0.98 * 600
    s = lambda t: m.score(pa.array([t]))[0]
    assert s("you zorbli quxxerr") >= 0.5 > s("a clean text of words") and s("") < 0.5
    assert s('the word "zorbly" is a term') < s("the word zorbly is a term")
    assert {r["doc_id"] for r in toxicity.drop_toxic(d, m).collect()} == {i for i, r in got.items() if not r["predicted"]}
    assert set(toxicity.train(d, l.limit(0)).score(pa.array(["x", None]))) == {0.0}
    # quotation and abuse, on held-out texts
    held = [t for i, t in rows if zlib.crc32(str(i).encode()) % 5 == 0 and marks[i][1]]
    quoted = [m.quotation(t, i % 5) for i, t in enumerate(held)]
    assert (m.score(pa.array(held)) >= 0.5).mean() > 0.95 and (m.score(pa.array(quoted)) >= 0.5).mean() < 0.05
    assert s("don\u2019t zorbly can\u2019t quxxer dogs\u2019") >= 0.5 > s("\u00ab zorbly \u00bb")
    # texts of a batch don't see each other's marks
    assert m.score(pa.array(['say "', "zorbly", '" so']))[1] == s("zorbly")


def test_toxicity_bounds_and_clashing_names(spark):
    rows = [(i, ("zorbly " if i % 3 == 0 else "") + f"w{i} x y z") for i in range(60)] + [(7, "another text")]
    d = frame(spark, rows).withColumns({"h": F.lit(1), "_id": F.lit(2), "y": F.lit(3), "least": F.lit(4)})
    l = spark.createDataFrame([(i, int(i % 3 == 0), 9, 9) for i in range(60)], "doc_id long, toxic int, h int, _id int")
    assert toxicity.train(d, l).ready and toxicity.score_toxicity(d, toxicity.train(d, l)).count() == 61
    assert not toxicity.train(d, l, most=0).ready


@pytest.mark.parametrize("seed", range(3))
def test_automaton_is_edit_distance(seed):
    rng = random.Random(seed)
    terms = ["".join(rng.choices("abc", k=rng.randint(3, 7))) for _ in range(6)]
    a = toxicity.Automaton(terms, [])

    def near(x, y):
        if x == y:
            return True
        return abs(len(x) - len(y)) <= 1 and any(x[:i] + x[i + 1 :] == y or x[:i] == y[:i] and x[i + 1 :] == y[i + 1 :] or x == y[:i] + y[i + 1 :] for i in range(max(len(x), len(y))))

    for _ in range(400):
        w = "".join(rng.choices("abc", k=rng.randint(2, 8)))
        hit = len(a.run(np.array([ord(c) for c in w], np.uint32), np.array([0]), np.array([len(w)]))[0]) > 0
        assert hit == (w in terms or any(len(t) >= 5 and t[0] == w[0] and near(t, w) for t in terms)), (w, terms)


# --- 7 licenses ---------------------------------------------------------------------------------------------
def test_license_rules(spark):
    d = frame(spark, [(1, "Licensed under the MIT License."), (2, "CC BY-NC and Apache License, Version 2.0"), (3, None), (4, "SPDX-License-Identifier: GPL-3.0"), (5, "permit licensees")])
    got = {r["doc_id"]: r for r in license_scan.license_scan(d).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["base_labels"], got[1]["labels"]) == (1, 1, "mit", "mit")
    assert (got[2]["n_base"], got[2]["first_word"], got[2]["last_word"], got[2]["base_labels"]) == (2, 0, 4, "apache-2,cc-by-nc")
    assert (got[3]["n_words"], got[3]["labels"], got[3]["score"], got[5]["labels"]) == (0, "", 0.0, "")
    assert got[4]["labels"] == "gpl-3" and len(license_scan.rules()) > 300


GRANTS = {
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal": "mit",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided": "bsd",
    "// SPDX-License-Identifier: BSD-3-Clause": "bsd-3-clause",
    "Dual: Apache-2.0 or BSD-3-Clause.": "apache-2,bsd-3-clause",
    "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License": "gpl-3",
    "distributed under the GNU General Public License version 3": "gpl-3",
    "a cc by bike, with a ruby license plate": "",
    "CC BY 4.0": "cc-by",
    "Neither the name of the X nor the names of its contributors may be used to endorse or promote products derived from this software": "bsd-3-clause",
}


def test_license_signatures(spark):
    docs = list(enumerate(GRANTS)) + [(100, " " * 200_000 + "MIT license" + "-" * 200_000 + "x")]
    got = {r["doc_id"]: r["labels"] for r in license_scan.license_scan(frame(spark, docs)).collect()}
    assert got == dict(enumerate(GRANTS.values())) | {100: "mit"}


def test_license_rules_hold_their_keyword_and_an_anchor():
    for _, keyword, _, pattern, _, _ in license_scan.rules():
        fixed = re.sub(r"\(\?:( \(\?:[^)]*\) | [^() ]+ )\)\?|\(\?: \[\^ \]\+ \)\{0,12\}", "", pattern)  # without what is optional
        words = re.sub(r"\(\?:[^)]*\)", " ", fixed).split()
        choices = [c.split("|") for c in re.findall(r"\(\?:([^)]*)\)", fixed)]
        anchored = lambda t: any(a in t for a in license_scan.ANCHORS)
        assert keyword in words, pattern
        assert anchored(" ".join(words)) or "cc" in words or any(all(map(anchored, c)) for c in choices), pattern


# --- 8 html -------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def labeller():
    return html_extract.train([])


def test_html_blocks():
    paths, texts, links = html_extract.blocks('<div class="ad x">a</div><p>b &amp;<b>c\n d</b><br>e<p>f<script>var t="</p>";</script><a href="q>r">g</a></p>')
    assert texts == ["a", "b &c d", "e", "fg"] and paths[0] == ("div", ".ad", ".x") and links[3] > 0
    assert html_extract.blocks("<!-- x") == ([], [], []) and html_extract.blocks("")[1] == []


def test_html_article_only(labeller):
    page = "<html><body><nav><a href=/>home</a></nav><article><h1>Title</h1><p>One &lt;two&gt;.</p><p>Three.</p></article><div class='comments'><p>me too</p></div><footer>(c)</footer></body></html>"
    assert html_extract.extract([page, None, ""], labeller) == ["Title One <two>. Three.", "", ""]


def test_html_generated_pages(labeller):
    rng = random.Random(77)
    right = total = 0
    for _ in range(150):
        page, own = html_extract.generated_page(rng)
        x, n = html_extract.vectors([html_extract.blocks(page)])
        right += (labeller.label(x, n) == np.array(own, bool)).sum()
        total += len(own)
    assert right / total > 0.98


PAGES = [
    ("<html><body><div><h1>Title of it</h1><p>First paragraph with some words.</p><p>Second paragraph of the text, it goes on.</p></div></body></html>", "Title of it First paragraph with some words. Second paragraph of the text, it goes on."),
    ("<div><h1>Title</h1><p>First one.</p><p>Second one.</p></div>", "Title First one. Second one."),
    ("<html><body><div id='navigation'><a href=x>Start</a> <a href=y>Hilfe</a></div><div id='hauptteil'><p>Der Hund lief \u00fcber die Stra\u00dfe und sah ein Haus.</p></div><div class='fusszeile'>Impressum</div></body></html>", "Der Hund lief \u00fcber die Stra\u00dfe und sah ein Haus."),
    ("<body><div id='hauptteil'><p>Der Hund lief \u00fcber die Stra\u00dfe.</p></div></body>", "Der Hund lief \u00fcber die Stra\u00dfe."),
    ("<body><article><p>The text of the story.</p></article><ol id='disqus_thread'><li>Great post, thanks!</li><li>I do not agree with this at all.</li></ol></body>", "The text of the story."),
    ("<body><main><p>Ein Text.</p><ul><li>Punkt eins.</li></ul></main><section class='kommentare'><p>Toll!</p></section></body>", "Ein Text. Punkt eins."),
]


def test_html_pages_without_article_markup_and_of_other_languages(labeller):
    assert html_extract.extract([p for p, _ in PAGES], labeller) == [t for _, t in PAGES]


def test_html_of_the_test_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    import html as html_lib

    for r in html_extract.extract_text(pages).join(pages.drop("url"), "page_id").collect():
        inside = re.search(r"<article>(.*)</article>", r["html"], re.S)[1]
        assert r["text"] == " ".join(html_lib.unescape(re.sub(r"<(?:p|/p|br|h1|/h1)>", " ", inside).replace("<b>", "").replace("</b>", "")).split()), r["page_id"]
        assert r["n_chars"] == len(r["text"])


@pytest.mark.parametrize("text", ["<a " * 40_000, '<a ="> "' * 40_000, "<svg>" * 40_000, "<!--" * 40_000, "<p>" * 40_000, "</b>" * 40_000 + "<i>" * 40_000, "".join(f"<div class=c{i}>a" for i in range(4_000)), "=" * 40_000 + "<" * 40_000], ids=range(8))
def test_html_is_read_in_linear_time(text):
    import time

    began = time.process_time()
    html_extract.leaves(text)
    assert time.process_time() - began < 2


def test_long_sampled_pages_are_learned_in_windows():
    page = html_extract.leaves("<main>" + "<p>a b c</p>" * 1000 + "</main>")
    parts = list(html_extract.windows(page))
    assert [len(p[0]) for p in parts] == [400, 400, 200] and all(html_extract.said(q.all()) for p in parts for q in p[0])


def test_html_sample_is_bounded(spark):
    rows = [(i, "u", "<p>" + "x" * 100) for i in range(50)] + [(7, "u", "<p>another")] * 30 + [(None, "u", None), (99, "u", "y" * 10_000)]
    d = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert len(html_extract.sampled(d, 10)) == 10 and len(html_extract.sampled(d, 100)) == 51
    assert sum(map(len, html_extract.sampled(d, 100, 1000))) <= 1000 and html_extract.sampled(d.limit(0)) == []


def test_lstm_gradients():
    m = html_extract.Labeller(5, 3)
    rng = np.random.default_rng(0)
    x, mask, y = rng.standard_normal((2, 4, 5)).astype(np.float32), np.array([[1, 1, 1, 1], [1, 1, 0, 0]], bool), rng.random((2, 4)) > 0.5
    _, g = m.gradients(x, mask, y)
    for k in ("fx", "bh", "o"):
        i = (1, 0)
        w = m.w[k].astype(np.float64)
        eps = 1e-2
        m.w[k] = w.copy(); m.w[k][i] += eps; up = m.gradients(x, mask, y)[0]  # noqa: E702
        m.w[k] = w.copy(); m.w[k][i] -= eps; down = m.gradients(x, mask, y)[0]  # noqa: E702
        m.w[k] = w.astype(np.float32)
        assert abs((up - down) / (2 * eps) - g[k][i]) < 2e-3


# --- 9 tokens -----------------------------------------------------------------------------------------------
def test_token_counts_are_the_library_s(spark, odd):
    tokenizers, P = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    tok = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rng = random.Random(1)
    al = "ab 's\n\t’é1.,!<|>_日😀 'tdlrem    "
    texts = ["", "<|endoftext|>", "a<|endoftext|> b", "x" * 500, " " * 300 + "y", "it's they'll 'sss 's"] + ["".join(rng.choice(al) for _ in range(rng.randint(0, 50))) for _ in range(1500)]
    want = [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert token_count.transducer().counts(pa.array(texts)).tolist() == want
    got = {(r["doc_id"], r["n_tokens"], r["over_limit"]) for r in token_count.token_counts(odd).collect()}
    assert (1, 0, False) in got and any(i == 5 and over for i, _, over in got)


def test_token_counts_of_long_pre_tokens_and_texts():
    tokenizers, P = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    tok = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    rng = random.Random(6)
    texts = ["x" * 70_000, "ab" * 20_001, "-" * 9_999, " " * 9_000 + "y", "".join(rng.choices("abcdefgh", k=9_000)), "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(4_000)), "word another, it's 12 " * 60_000]
    want = [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    machine = token_count.transducer()
    assert machine.counts(pa.array(texts)).tolist() == want
    # a 10 MB word in bounded memory
    before = len(machine.states)
    assert machine.counts(pa.array(["x" * 10_000_000])).tolist() == [1_250_000] and len(machine.states) - before < 100


def test_token_states_are_bounded(monkeypatch):
    tokenizers, P = pytest.importorskip("tokenizers"), pytest.importorskip("public_tokenizers")
    tok = tokenizers.Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    monkeypatch.setattr(token_count, "MAX_STATES", 300)
    machine, rng = token_count.Transducer(P.path("byte_bpe_50k.json")), random.Random(7)
    texts = ["".join(rng.choices("abcdefghij é", k=rng.randint(0, 80))) for _ in range(400)] + ["".join(rng.choices("abcdefgh", k=6_000))]
    assert machine.counts(pa.array(texts)).tolist() == [len(e.ids) for e in tok.encode_batch(texts, add_special_tokens=False)]
    assert len(machine.states) < 3000


# --- 10 quality ---------------------------------------------------------------------------------------------
def test_repeat_words(spark):
    texts = ["a b c a b c", "a a a a", "a b c d", "a b", None, "x y z x y z q x y z"]
    got = [r["n_repeat_words"] for r in quality.measures(frame(spark, list(enumerate(texts)))).orderBy("doc_id").collect()]
    assert got == [6, 4, 0, 0, 0, 9]


# --- all ----------------------------------------------------------------------------------------------------
NAMES = {"line": lambda d: line_dedup.line_dedup(d), "mix": lambda d: mixing.mix_sources(d)[1], "near": lambda d: near_dedup.near_dedup(d), "lang": lambda d: language_id.identify(d, language_id.train(d)), "license": license_scan.license_scan, "tokens": token_count.token_counts, "quality": quality.quality_rules}


@pytest.mark.parametrize("name", sorted(NAMES))
def test_odd_rows_and_empty_tables(name, odd):
    assert NAMES[name](odd).count() == odd.count()
    assert NAMES[name](odd.limit(0)).count() == 0


CLASH = "a b c h k t y u v n id rep size start rank slot src key bucket text_hash n_shingles h1 h2 signature component labels score held_out kw norm rule first last base found least".split()


@pytest.mark.parametrize("name", sorted(NAMES))
def test_clashing_names_change_nothing(name, odd):
    plain = NAMES[name](odd)
    clash = NAMES[name](odd.withColumns({c: F.lit("9") for c in CLASH if c not in odd.columns}))
    shown = [c for c in plain.columns if c not in ("extra", "text")]
    key = lambda d: sorted(map(str, d.select(*shown).collect()))
    assert key(plain) == key(clash)


def test_odd_rows_in_learned_and_item_operators(spark, odd):
    clash = odd.withColumns({c: F.lit("9") for c in CLASH})
    items = spark.createDataFrame([(None, "one two three four five six"), (1, None), (2, ""), (3, "no id here at all"), (3, "no id here at all")], "item_id long, text string").withColumn("doc_id", F.lit(1))
    got = sorted(map(str, decontaminate.leaks(clash, items).select("doc_id", "item_id").collect()))
    assert got == ["Row(doc_id=4, item_id=None)", "Row(doc_id=None, item_id=3)"]
    assert decontaminate.decontaminate(clash, items).count() == odd.count() - 3
    assert decontaminate.leaks(odd.limit(0), items).count() == decontaminate.leaks(odd, items.limit(0)).count() == 0
    assert decontaminate.decontaminate(odd, items.limit(0)).count() == odd.count()
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, 1), (4, 0), (5, None), (None, 1), (6, 0)], "doc_id long, toxic int").withColumns({c: F.lit("9") for c in CLASH})
    model = toxicity.train(clash, labels)
    got = toxicity.score_toxicity(clash, model)
    assert got.count() == odd.count() and got.where("score < 0 or score > 1 or held_out is null").count() == 0
    assert toxicity.score_toxicity(odd.limit(0), toxicity.train(odd.limit(0), labels.limit(0))).count() == 0
    assert toxicity.drop_toxic(clash, model).columns == clash.columns
    pages = spark.createDataFrame([(1, None, None), (2, "u", ""), (2, "u", "<p>"), (None, "u", "<article><p>x y z.</p></article>"), (4, "u", "<p>" + "long text. " * 30_000)], "page_id long, url string, html string").withColumns({c: F.lit("9") for c in [*CLASH, "text", "n_chars"]})
    got = html_extract.extract_text(pages).collect()
    assert len(got) == 5 and all(r["n_chars"] == len(r["text"]) for r in got) and sum(r["text"] == "" for r in got) >= 3
    assert html_extract.extract_text(pages.limit(0)).count() == 0


def test_mix_of_a_doc_id_that_many_rows_repeat(spark, monkeypatch):
    monkeypatch.setattr(mixing, "_CHUNK", 16)
    rows = [(7, "w " * 3, "en", "a")] * 100 + [(7, "w " * 5, "en", "a")] * 40 + [(i, "w " * i, "en", "ab"[i % 2]) for i in range(30)]
    out = mixing.mix_sources(frame(spark, rows))[1].collect()
    by = {}
    for r in out:
        assert r["taken"] <= 2 * r["size"]
        t, want, n = by.get(r["source"], (0, 0, 0))
        by[r["source"]] = (t + r["taken"], r["target"], n + 1)
    assert len(out) == 170 and all(abs(t - want) <= 1 for t, want, _ in by.values())


def test_entry_works_without_the_subpackage(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parents[2]
    shutil.copytree(root / "stemma", tmp_path / "stemma", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(root / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; assert len(e.queries()) > 50 and not any(n.startswith('op') for n in e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={"PATH": "/usr/bin:/bin", "PYTHONPATH": str(tmp_path)})
    assert re.search("HAS_LLM", (root / "__spark_entry__.py").read_text())
