"""Feature files, gaps in nodes, references, scopes, ids and packages on worked examples."""

from __future__ import annotations

import io
import uuid
import zipfile

import pytest
from pyspark.sql import functions as F

from stemma.functions import ids as I
from stemma.functions import refs as R
from stemma.functions import text as X
from stemma.operators import curation as C
from stemma.operators import hierarchy as H
from stemma.operators import linking as L
from stemma.operators import reading as D
from stemma.operators import reference as Q
from stemma.operators import search as S
from stemma.operators import structure as T
from stemma.operators import versions as V
from stemma.sources import archive, tf

FILES = {
    "otype": "@node\n@valueType=str\n\n1-12\tword\n13-14\tsentence\n15-17\tclause\n18-22\tphrase\n23-25\tpara\n26-27\tchapter\nbook\n29\tgap\n",
    "oslots": "@edge\n@valueType=int\n\n1-4\n5-12\n1-4\n5-10\n11-12\n1-2\n3\n5-7\n8-10\n11-12\n1-4\n5-8\n9-12\n1-8\n9-12\n1-12\n1-2,5-7,11\n",
    "otext": "@config\n@fmt:text-orig-full={word}{trailer}\n@sectionTypes=book,chapter,para\n@sectionFeatures=book,chapter,para\n\n",
    "book": "@node\n@valueType=str\n\n28\tMoby-Dick: Or, The Whale\n",
    "chapter": "@node\n@valueType=int\n\n26\t1\n2\n",
    "para": "@node\n@valueType=int\n\n23\t1\n2\n1\n",
    "word": "@node\n@valueType=str\n\n" + "\n".join("Call me Ishmael . Some years ago , I sailed forth .".split()) + "\n",
    "trailer": "@node\n@valueType=str\n\n1-2,4-6,8-10,12\t \n",
    "mother": "@edge\n@edgeValues\n\n16\t15\told\n",
}


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    at = tmp_path_factory.mktemp("dataset")
    for name, text in FILES.items():
        (at / f"{name}.tf").write_text(text)
    return str(at)


@pytest.fixture(scope="module")
def corpus(spark, folder):
    return tf.load_corpus(spark, folder, "m")


def test_a_folder_becomes_a_corpus(spark, corpus, folder):
    assert (corpus.slot_type, corpus.section_types, corpus.value_types) == ("word", ["book", "chapter", "para"], {"chapter": "int", "para": "int"})
    spans = {r["node"]: (r["otype"], r["first_slot"], r["last_slot"], r["n_slots"]) for r in corpus.nodes.collect()}
    assert len(spans) == 29 and spans[16] == ("clause", 5, 10, 6) and spans[3] == ("word", 3, 3, 1) and spans[29] == ("gap", 1, 11, 6) and spans[28][0] == "book"
    text = T.node_text(corpus, corpus.of_type("sentence")).orderBy("node").collect()
    assert [r["text"] for r in text] == ["Call me Ishmael.", "Some years ago, I sailed forth."]
    assert corpus.edge_features.collect()[0].asDict() == {"corpus": "m", "feature": "mother", "src": 16, "dst": 15, "value": "old"}
    assert {r[0] for r in tf.load_corpus(spark, folder, "m", ["trailer"]).node_features.select("feature").distinct().collect()} == {"book", "chapter", "para", "word", "trailer"}


def test_round_trip_of_a_feature(corpus):
    one = corpus.node_features.where("feature = 'word'").select("node", F.col("value_str").alias("value"))
    rows = list(tf.node_rows("word", tf.write_feature(one)))
    assert [(lo, v) for _, lo, _, v, _ in rows] == [(i + 1, w) for i, w in enumerate("Call me Ishmael . Some years ago , I sailed forth .".split())]


def test_references_of_the_loaded_corpus(spark, corpus):
    b = "Moby-Dick%3A Or, The Whale"
    want = {f"{b}": (28, "resolved"), f"{b}:2": (27, "resolved"), f"{b}:1:2!clause1": (16, "resolved"), f"{b}:2:1!clause1": (17, "resolved"), f"{b}:2:1!clause2": (None, "index_out_of_range"), f"{b}:2!sentence1": (None, "type_not_in_section"), f"m@9/{b}:1": (None, "version_mismatch")}
    refs = spark.createDataFrame(list(enumerate(want)), "id long, s string").select("id", R.parse(F.col("s")).alias("r"))
    got = {r["id"]: (r["node"], r["status"]) for r in Q.resolve(corpus, refs, "0.1").collect()}
    assert got == dict(enumerate(want.values()))


def tuples(found):
    return sorted(tuple(r[c] for c in S.result_nodes(found)) for r in found.collect())


def test_gaps_count_in_containment(corpus):
    inside = {c for _, c in tuples(S.search(corpus, "gap\n  word"))}
    assert inside == {1, 2, 5, 6, 7, 11}
    assert tuples(S.search(corpus, "gap\n  phrase")) == [(29, 18), (29, 20)]
    assert tuples(S.search(corpus, "gap\n|| phrase")) == [(29, 18), (29, 20), (29, 22)]
    assert tuples(S.search(corpus, "gap\n=: clause")) == []
    pairs = T.embedding_pairs(corpus.of_type("gap"), corpus.of_type("phrase"))
    assert sorted(r["c_node"] for r in pairs.collect()) == [18, 20]


def test_results_with_references(corpus):
    got = S.references(corpus, S.search(corpus, "chapter\n  clause")).select("n1", "n2", "refs").collect()
    assert sorted((r[0], r[1], r[2]) for r in got) == [(26, 15, "Moby-Dick: Or, The Whale 1 | Moby-Dick: Or, The Whale 1 1"), (27, 17, "Moby-Dick: Or, The Whale 2 | Moby-Dick: Or, The Whale 2 1")]


def test_passages_and_pages(spark, corpus):
    assert sorted(r["node"] for r in D.passage_nodes(corpus).collect()) == [23, 24, 25]
    tops = corpus.nodes.where("node in (26, 25)")
    assert sorted((r["section"], r["node"]) for r in D.passage_nodes(corpus, tops).collect())[:1] and {r["node"] for r in D.passage_nodes(corpus, corpus.nodes.where("node = 26")).collect()} == {23, 24}
    page = D.content_page(corpus, D.passage_nodes(corpus), 1, 1).collect()
    assert [(r["node"], r["ref"], r["text"], r["total"], r["next_offset"]) for r in page] == [(24, "Moby-Dick: Or, The Whale 1 2", "Some years ago,", 3, 2)]


def test_scopes(spark, corpus):
    rows = [(1, "m", "word", 3, None, None, None), (2, "m", "word", 13, None, None, None), (3, "m", "passage", 26, None, 23, 24), (4, "m", "passage", 26, None, 24, 23), (5, "m", "passage", 26, None, 24, 25), (6, "m", "section", 13, None, None, None), (7, "m", "document", 28, None, None, None), (8, "m", "corpus", None, None, None, None), (9, "m", "passage", 27, None, 23, 24), (10, "m", "passage", 99, None, None, None), (11, "m", "section", 26, "book", None, None)]
    scopes = spark.createDataFrame(rows, "id long, corpus string, level string, node long, node_type string, start long, end long")
    errors = {r["id"]: r["error"] for r in C.scope_errors(corpus, scopes).collect()}
    assert errors == {2: "word scope needs a slot", 4: "reversed", 5: "crosses a section", 6: "not a section", 9: "anchor doesn't hold the range", 10: "unknown node", 11: "another type"}
    chosen = C.scope_nodes(corpus, scopes)
    got = {}
    for r in chosen.collect():
        got.setdefault(r["id"], set()).add(r["node"])
    assert got[1] == {3} and {23, 24, 18, 19, 20, 1, 8} <= got[3] and 26 not in got[3] and len(got[8]) == 29 and 28 in got[7]
    import hashlib

    hashes = {r["id"]: r["content_hash"] for r in C.scope_hash(corpus, chosen).collect()}
    assert hashes[1] == "sha256:" + hashlib.sha256(b"Ishmael").hexdigest() and hashes[3] == "sha256:" + hashlib.sha256(b"Call me Ishmael. Some years ago, ").hexdigest()


def test_untouched_hash(corpus):
    from dataclasses import replace

    def edited(node):
        return replace(corpus, node_features=corpus.node_features.withColumn("value_str", F.when((F.col("node") == node) & (F.col("feature") == "word"), "X").otherwise(F.col("value_str"))))

    h = lambda c: C.untouched_hash(c, ["word"], 3).first()[0]
    assert h(corpus) == h(edited(3)) != h(edited(4))


def test_fields_that_may_not_be_edited(spark):
    f = spark.createDataFrame([(x,) for x in ("gloss", "otype", "word", "1x", "nope")], "field string")
    got = {r[0]: r[1] for r in C.not_editable(f, ["gloss", "word"], ["{word}{trailer}"]).collect()}
    assert got == {"otype": "reserved", "word": "rendered", "1x": "not_a_name", "nope": "unknown"}


def test_structure_errors_of_deep_trees_and_cycles(spark):
    chain = [("s", i, i - 1 if i else None) for i in range(300)]
    rows = chain + [("s", 1000, 1001), ("s", 1001, 1002), ("s", 1002, 1000), ("s", 1003, 1000), ("s", 1004, 1004), ("s", 1005, 77777), ("s", 1006, 1005)]
    got = {(r["node"], r["error"]) for r in H.structure_errors(spark.createDataFrame(rows, "structure string, node long, parent long")).collect()}
    assert got == {(1000, "cycle"), (1001, "cycle"), (1002, "cycle"), (1003, "cycle"), (1004, "self_parent"), (1005, "missing_parent")}


def test_ids_and_offsets(spark):
    texts = ["a\U0001f600b", "plain", "", "\U0001f600\U0001f600"]
    d = spark.createDataFrame([(t, n) for t in texts for n in range(-1, 7)], "t string, n long")
    for r in d.select("t", "n", I.utf16_offset(F.col("t"), F.col("n")).alias("u"), I.scalar_offset(F.col("t"), F.col("n")).alias("s"), I.uuid5(F.col("t")).alias("id")).collect():
        units = lambda k, t=r["t"]: len(t[:k].encode("utf-16-be")) // 2
        assert r["u"] == (units(r["n"]) if 0 <= r["n"] <= len(r["t"]) else None)
        assert r["s"] == next((k for k in range(len(r["t"]) + 1) if units(k) == r["n"]), None)
        assert r["id"] == str(uuid.uuid5(uuid.NAMESPACE_URL, r["t"]))
    new = spark.range(50).select(I.uuid7(F.lit("2024-05-06 07:08:09").cast("timestamp")).alias("i")).collect()
    assert len({r[0] for r in new}) == 50 and all(uuid.UUID(r[0]).version == 7 and uuid.UUID(r[0]).variant == uuid.RFC_4122 for r in new)


def test_compact_tokens_of_four_digits(spark):
    t = spark.range(1).select(R.compact_token(F.lit("X_y"), [("bk", F.lit(7)), ("ch", F.lit(1234)), ("pa", F.lit(None).cast("int"))])).first()[0]
    assert t == "cox-y_bk007_ch1234"
    assert R is not None and spark.createDataFrame([(t,)], "t string").select(R.compact_levels(F.col("t"))).first()[0][1]["first"] == 1234


def test_slugs_and_names(spark):
    d = spark.createDataFrame([("A  b!", "J 1"), ("!!", "J 1"), ("x" * 200, "j")], "n string, j string")
    got = d.select(I.result_filename(F.col("n"), F.col("j")).alias("f"), I.document_slug(F.col("n")).alias("s")).collect()
    assert [(r["f"], r["s"]) for r in got] == [("a-b.corpus", "a-b"), ("j-1.corpus", "document"), ("x" * 200 + ".corpus", "x" * 128)]


def test_uploads_of_any_bytes(spark):
    rows = [(b"PK\x03\x04zz", "zip"), (b"%PDF-1.4", "pdf"), (b"<!DOCTYPE html>" + b"\xff\xfe\xc3" * 300, "html"), (b"<?xml?><a/>", "xml"), ("é".encode() * 600, "text"), (b"", None)]
    got = spark.createDataFrame([(r[0],) for r in rows], "c binary").select(archive.family(F.col("c")).alias("f")).collect()
    assert [r["f"] for r in got] == [f for _, f in rows]


def test_datasets_and_tei_in_zips(spark, corpus, tmp_path):
    def packed(files):
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w") as z:
            for n, t in files.items():
                z.writestr(n, t)
        return out.getvalue()

    data = packed({f"d/{v}/{n}.tf": t for v in ("0.9", "0.10", "0.10-beta") for n, t in FILES.items()} | {"__MACOSX/x": "n"})
    assert archive.latest_dataset([n for n, _ in archive.safe_members(data)]) == "d/0.10"
    loaded = archive.import_dataset(spark, data, f"file://{tmp_path}/in", "m")
    assert loaded.nodes.count() == corpus.nodes.count()
    zips = spark.createDataFrame([("z", packed({"b.xml": "<TEI/>", "a.XML": "<TEI>a</TEI>", ".c.xml": "n", "r.txt": "n"}))], "path string, content binary")
    assert [(r["member"], r["text"]) for r in archive.tei_members(zips).collect()] == [("a.XML", "<TEI>a</TEI>"), ("b.xml", "<TEI/>")]
    with pytest.raises(ValueError):
        archive.latest_dataset(["x/readme.md"])


def test_written_corpora(spark, corpus, tmp_path):
    from dataclasses import replace

    at = str(tmp_path / "out")
    archive.write_corpus(replace(corpus, nodes=corpus.nodes.drop("ranges")), at)
    archive.write_index(corpus, at, spark.createDataFrame([("m", "v1.0")], "corpus string, label string"))
    import os

    assert archive.layout_errors(os.listdir(at)) == [] and archive.layout_errors(["slots", "odd"]) == ["missing manifest", "missing nodes", "missing node_features", "missing edge_features", "unexpected odd"]
    (tmp_path / "a.corpus").write_bytes(b"1234")
    (tmp_path / "b.txt").write_bytes(b"1")
    assert [(r["path"].rsplit("/", 1)[1], r["size"]) for r in archive.stored(spark, str(tmp_path)).collect()] == [("a.corpus", 4)]
    archive.write_csv(D.stats(corpus).select("name", "value"), f"{at}-csv")
    assert spark.read.option("header", True).csv(f"{at}-csv").count() == 5


def test_folded_aliases(spark):
    streams = spark.createDataFrame([(1, "see JÓHN 3:16 and jn. 1:1")], "id long, text string")
    aliases = spark.createDataFrame([("John", "john"), ("Jn.", "john")], "alias string, work_id string")
    got = L.detect(streams, aliases, "id").orderBy("start").collect()
    assert [(r["exact"], r["chapter"], r["work_id"]) for r in got] == [("JÓHN 3:16", 3, "john"), ("jn. 1:1", 1, "john")]


def test_nested_milestones(spark):
    marks = [("d", "a", "start", 1), ("d", "b", "start", 3), ("d", "b", "end", 5), ("d", "a", "end", 9), ("d", "c", "start", 9), ("d", "c", "end", 12)]
    spans, errors = L.paired_milestones(spark.createDataFrame(marks, "doc string, id string, kind string, place long"))
    assert {r["id"] for r in spans.collect()} == {"a", "c"} and [(r["id"], r["error"]) for r in errors.collect()] == [("b", "nested")]


def test_html_streams(spark):
    d = spark.createDataFrame([("<div>a<p>b</p><p>c &amp; d<br>e</p></div><script>x</script>f",)], "h string")
    assert d.select(X.html_stream(F.col("h"))).first()[0] == "a\nb\nc & d\ne\nf"


def test_required_features():
    assert V.required_features(["book", "verse"], ["title", "n"], {"n": "int"}) == {"book": {"title": "str"}, "verse": {"n": "int"}}
    with pytest.raises(ValueError):
        V.required_features(["book"], [], {})


def test_files_arrive_as_units(spark, tmp_path):
    from stemma.streaming import ingest

    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.md").write_text("# One\n\ntext a\n")
    units = ingest.unit_stream(ingest.arriving(spark, f"file://{tmp_path}/in", "*.md"), "markdown")

    def run():
        q = units.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
        q.awaitTermination()
        return sorted((r["type"], r["label"] or r["text"]) for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run() == [("paragraph", "text a"), ("section", "One")]
    (tmp_path / "in" / "b.md").write_text("text b\n")
    assert run() == [("paragraph", "text a"), ("paragraph", "text b"), ("section", "One")]  # each file once
