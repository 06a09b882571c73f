"""Parsers, archives and streams on small fixtures."""

from __future__ import annotations

import io
import zipfile

import pytest

from stemma.sources import archive, markup, tf


def kinds(rows):
    return [(r["type"], r["label"], r["text"]) for r in rows]


def test_markdown_nests_sections_and_keeps_fences():
    rows = markup.markdown("# A\n\none\ntwo\n\n## B\n```\n# no heading\n```\n# C\nend")
    assert kinds(rows) == [("section", "A", None), ("paragraph", None, "one two"), ("section", "B", None), ("code", None, "# no heading"), ("section", "C", None), ("paragraph", None, "end")]
    assert [r["parent_id"] for r in rows] == [None, 0, 0, 2, None, 4]


def test_html_mixed_text_and_skipped_elements():
    rows = markup.html("<div>a<b>c</b>d<script>x</script></div>")
    assert kinds(rows) == [("div", None, None), ("text", None, "a"), ("b", None, None), ("text", None, "c"), ("text", None, "d")]


def test_xml_and_tei():
    assert kinds(markup.xml("<r><a x='1'>t</a><b/></r>")) == [("a", None, "t"), ("b", None, None)]
    assert kinds(markup.xml("<r>only</r>")) == [("r", None, "only")]
    rows = markup.tei("<TEI><text><body><div><head>One</head><p>Hi</p></div></body></text></TEI>")
    assert kinds(rows) == [("div", "One", None), ("p", None, "Hi")]


def test_epub():
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("META-INF/container.xml", "<container><rootfiles><rootfile full-path='o/c.opf'/></rootfiles></container>")
        z.writestr("o/c.opf", "<package xmlns:dc='http://purl.org/dc/elements/1.1/'><metadata><dc:title>T</dc:title></metadata><manifest><item id='c1' href='1.xhtml' media-type='application/xhtml+xml'/></manifest></package>")
        z.writestr("o/1.xhtml", "<html><body><p>Hello</p></body></html>")
    rows = markup.epub(data.getvalue())
    assert [r["type"] for r in rows] == ["chapter", "p", "text"] and rows[0]["attrs"]["title"] == "T"


def test_bad_documents_give_an_error_unit(spark):
    docs = spark.createDataFrame([(1, "<a><b></a>"), (2, None), (3, "<a/>")], "id long, x string")
    assert {(r["id"], r["type"]) for r in markup.units(docs, "xml", "id", "x").collect()} == {(1, "error"), (3, "a")}


def test_feature_files():
    text = "@node\n@valueType=int\n\n4\n3-4,7\t9\nx\n"
    assert list(tf.node_rows("n", text)) == [("n", 1, 1, None, 4), ("n", 3, 4, None, 9), ("n", 7, 7, None, 9), ("n", 8, 8, "x", None)]
    assert list(tf.slot_rows("@edge\n\n1-4\n5,7\n20\t8-9\n", 12)) == [(13, 1, 4), (14, 5, 5), (14, 7, 7), (20, 8, 9)]
    assert tf.unescape(r"a\tb\\n") == "a\tb\\n"
    with pytest.raises(ValueError):
        tf.otext("@config\n")
    assert tf.otext("@config\n@sectionTypes=book,chapter\n@sectionFeatures=book,chapter\n@fmt:x={w}\n")["section_types"] == ["book", "chapter"]


def test_archive_guards_and_versions():
    def packed(name, data="x"):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            z.writestr(name, data)
        return b.getvalue()

    assert archive.safe_members(packed("a/b.tf")) == [("a/b.tf", b"x")]
    for bad in ("../x", "/x", "a\\b"):
        with pytest.raises(ValueError):
            archive.safe_members(packed(bad))
    assert sorted(["1.10", "1.2", "2.0", "2.0-rc1"], key=archive.version_parts) == ["1.2", "1.10", "2.0-rc1", "2.0"]


def test_corpus_round_trip(spark, tmp_path):
    from stemma.plans.corpus import text_corpus

    docs = spark.createDataFrame([(1, "a b\n\nc", "en", "s"), (2, "d", "en", "s")], "doc_id long, text string, lang string, source string")
    c = text_corpus(docs)
    archive.write_corpus(c, str(tmp_path / "c"))
    back = archive.read_corpus(spark, str(tmp_path / "c"))
    assert sorted(map(tuple, back.nodes.select("node", "otype", "first_slot", "last_slot").collect())) == sorted(map(tuple, c.nodes.select("node", "otype", "first_slot", "last_slot").collect()))
    assert back.section_types == c.section_types and back.value_types == c.value_types


def test_streams(spark, tmp_path):
    from stemma.streaming import jobs as J

    rows = [(1, 1, "2024-01-01 00:00:00", "queued"), (2, 1, "2024-01-01 00:01:00", "started"), (2, 1, "2024-01-01 00:01:00", "started"), (3, 1, "2024-01-01 00:02:00", "succeeded"), (4, 1, "2024-01-01 00:03:00", "failed"), (5, 2, "2024-01-01 00:00:30", "queued")]
    events = spark.createDataFrame(rows, "event_id long, job long, ts string, kind string").selectExpr("event_id", "job", "cast(ts as timestamp) as ts", "kind")
    assert {r["job"]: r["status"] for r in J.job_states(events).collect()} == {1: "succeeded", 2: "queued"}
    events.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = J.stream_unique(stream).writeStream.format("memory").queryName("uniq").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("uniq").count() == 5
    q = J.stream_job_states(stream.withWatermark("ts", "1 minute")).writeStream.format("memory").queryName("states").outputMode("update").start()
    q.processAllAvailable()
    q.stop()
    assert [r["status"] for r in spark.table("states").where("job = 1").collect()] == ["queued", "running", "succeeded"]
