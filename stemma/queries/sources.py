"""Parsers and archives on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import standoff
from ..plans.corpus import read
from ..sources import archive, markup
from . import query


@query("html_units")
def html_units(spark, sf_dir):
    """The tag tree of every page; tests hold it against fixtures."""
    return markup.units(read(spark, sf_dir, "pages"), "html", "page_id", "html").select("page_id", "unit_id", "parent_id", "depth", "type", "text")


@query("html_unit_types", "SELECT 'li' AS type, count(*) AS n FROM (SELECT unnest(regexp_extract_all(html, '<li>')) FROM pages) UNION ALL SELECT 'article', count(*) FROM (SELECT unnest(regexp_extract_all(html, '<article>')) FROM pages) UNION ALL SELECT 'p', count(*) FROM (SELECT unnest(regexp_extract_all(html, '<p>')) FROM pages)")
def html_unit_types(spark, sf_dir):
    """S11, A01 on pages: units by type."""
    return html_units(spark, sf_dir).where("type in ('li', 'article', 'p')").groupBy("type").agg(F.count(F.lit(1)).alias("n"))


@query("markdown_units", "SELECT conv_id * 1000 + turn AS id, 2 AS n_units, upper(role) AS label FROM conversations WHERE text IS NOT NULL AND trim(text) <> ''")
def markdown_units(spark, sf_dir):
    """A heading and a paragraph for each turn."""
    c = read(spark, sf_dir, "conversations").where("trim(text) <> ''")
    md = F.concat(F.lit("# "), F.upper("role"), F.lit("\n\n"), F.regexp_replace("text", r"\s*\n\s*", " "))
    u = markup.units(c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), md.alias("md")), "markdown", "id", "md")
    return u.groupBy("id").agg(F.count(F.lit(1)).cast("int").alias("n_units"), F.max("label").alias("label"))


@query("xml_units", "SELECT o_orderkey AS id, count(*) AS n_units, min(l_returnflag) AS first_flag FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def xml_units(spark, sf_dir):
    """Orders written as XML and read back."""
    line = F.concat(F.lit("<line flag=\""), "l_returnflag", F.lit("\">"), F.col("l_partkey").cast("string"), F.lit("</line>"))
    x = read(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.concat(F.lit("<order>"), F.array_join(F.collect_list(line), ""), F.lit("</order>")).alias("xml"))
    u = markup.units(x, "xml", "id", "xml")
    return u.groupBy("id").agg(F.count(F.lit(1)).alias("n_units"), F.min(F.col("attrs")["flag"]).alias("first_flag"))


@query("upload_family", "SELECT page_id, 'html' AS family FROM pages")
def upload_family(spark, sf_dir):
    """What each page's bytes are."""
    return read(spark, sf_dir, "pages").select("page_id", archive.family(F.encode("html", "utf-8")).alias("family"))


@query("content_digests", "SELECT CAST(doc_id AS VARCHAR) AS path, sha256(text) AS sha256 FROM documents")
def content_digests(spark, sf_dir):
    """Checksums of members."""
    return archive.digests(read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("path"), F.encode("text", "utf-8").alias("content"))).select("path", "sha256")


@query("graph_rules", "SELECT 'n' || doc_id AS node, 'label:missing' AS error FROM labels WHERE quality = 0 UNION ALL SELECT 'n' || doc_id, 'parent:missing' FROM labels WHERE toxic = 1")
def graph_rules(spark, sf_dir):
    """All errors of all entities, not only the first."""
    nodes = read(spark, sf_dir, "labels").withColumn("node", F.concat(F.lit("n"), F.col("doc_id").cast("string")))
    return standoff.broken_rules(nodes, "node", {"label:missing": F.col("quality") == 0, "parent:missing": F.col("toxic") == 1})


@query("relational_round_trip", "SELECT o_custkey AS document, string_agg(o_orderstatus, '' ORDER BY o_orderkey) AS restored FROM orders GROUP BY 1")
def relational_round_trip(spark, sf_dir):
    """Documents exploded to rows and restored from them, in order."""
    doc = read(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("document")).agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("parts"))
    back = standoff.restored(standoff.rows_of(doc, "document", "parts"), "document")
    return back.select("document", F.array_join(F.transform("parts", lambda v: v["o_orderstatus"]), "").alias("restored"))


@query("shared_anchors", "SELECT l_partkey AS start, CASE WHEN l_linenumber = 1 THEN 'position' ELSE 'anchor' END AS kind, count(*) AS n FROM lineitem GROUP BY ALL")
def shared_anchors(spark, sf_dir):
    """A zero-length span is a position, others share an anchor for each span."""
    start = F.col("l_partkey").alias("start")
    spans = read(spark, sf_dir, "lineitem").select(start, F.when(F.col("l_linenumber") == 1, F.col("l_partkey")).otherwise(F.col("l_partkey") + 9).alias("stop"))
    return standoff.anchored(spans, [], "start", "stop").select("start", "kind", "n")


@query("structure_members", "SELECT 'source' AS structure, source AS parent, doc_id AS node, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS ordinal FROM documents UNION ALL SELECT 'language', lang, doc_id, row_number() OVER (PARTITION BY lang ORDER BY doc_id) FROM documents")
def structure_members(spark, sf_dir):
    """Independent structures over one text; members of a hot parent are numbered in two levels."""
    from ..plans.prefix import running_sum

    d = read(spark, sf_dir, "documents")
    both = F.explode(F.array(F.struct(F.lit("source").alias("structure"), F.col("source").alias("parent")), F.struct(F.lit("language").alias("structure"), F.col("lang").alias("parent"))))
    m = d.select("doc_id", both.alias("s")).select("s.structure", "s.parent", F.col("doc_id").alias("node"))
    return running_sum(m, ["structure", "parent"], F.expr("node div 4096"), ["node"], F.lit(1), "n").select("structure", "parent", "node", (F.col("n") + 1).alias("ordinal"))
