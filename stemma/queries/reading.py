"""Reading, identifiers and search results on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ids as I
from ..functions import text as X
from ..operators import reading as D
from ..operators import search as S
from ..plans.corpus import read, trade_corpus
from . import query
from .trade import sql

_REF = "r_name || ' ' || n_name || ' ' || c_custkey"
_NAMES = "customer u ON u.c_custkey = {} JOIN nation x ON u.c_nationkey = x.n_nationkey JOIN region y ON x.n_regionkey = y.r_regionkey"


@query("search_results", sql(f"SELECT c.node AS n1, o.node AS n2, r_name || ' ' || x.n_name || ' ' || c.key || ' | ' || r_name || ' ' || x.n_name || ' ' || c.key || ' ' || o.key AS refs FROM co c JOIN oo o ON o.o_custkey = c.key AND o.first_slot IS NOT NULL JOIN {_NAMES.format('c.key')} WHERE c.c_mktsegment = 'BUILDING' AND o.o_orderstatus = 'P'"))
def search_results(spark, sf_dir):
    """The references of all nodes of each result."""
    c = trade_corpus(spark, sf_dir)
    return S.references(c, S.search(c, "customer segment=BUILDING\n  order status=P")).select("n1", "n2", "refs")


@query("corpora", "SELECT lang AS corpus, count(DISTINCT doc_id) AS n_documents, lang = (SELECT min(lang) FROM documents) AS current FROM documents WHERE regexp_matches(text, '\\S') AND lang IS NOT NULL GROUP BY lang")
def corpora(spark, sf_dir):
    """The corpora of a load; the first is current."""
    d = read(spark, sf_dir, "documents").where(F.col("text").rlike(r"\S") & F.col("lang").isNotNull())
    from ..plans.corpus import Corpus

    nodes = d.select(F.col("lang").alias("corpus"), F.col("doc_id").alias("node"))
    none = spark.createDataFrame([], "corpus string")
    return D.corpora(Corpus(none, nodes, none, none, ["document"], {})).withColumnRenamed("n_nodes", "n_documents")


@query("format_samples", sql("SELECT 'flags' AS format, string_agg(l_returnflag || ' ', '' ORDER BY slot) AS sample FROM li WHERE slot <= 3 UNION ALL SELECT 'pairs', string_agg(l_returnflag || '/' || l_linestatus || ';', '' ORDER BY slot) FROM li WHERE slot <= 3"))
def format_samples(spark, sf_dir):
    """Each text format on the first three slots."""
    return D.format_samples(trade_corpus(spark, sf_dir), {"flags": "{flag} ", "pairs": "{flag}/{linestatus};"}).select("format", "sample")


@query("content_page", sql(f", p AS (SELECT o.*, row_number() OVER (PARTITION BY o_custkey ORDER BY first_slot, last_slot DESC, node) AS place, count(*) OVER (PARTITION BY o_custkey) AS total FROM oo o WHERE first_slot IS NOT NULL), t AS (SELECT o_orderkey, string_agg(l_returnflag, ' ' ORDER BY slot) AS text FROM li GROUP BY o_orderkey) SELECT c.node AS section, p.node, {_REF} || ' ' || p.key AS ref, t.text, p.n_slots AS n_tokens, p.place, p.total, CASE WHEN p.total > 3 THEN 3 END AS next_offset FROM p JOIN co c ON c.key = p.o_custkey JOIN t ON t.o_orderkey = p.key JOIN {_NAMES.format('p.o_custkey')} WHERE place BETWEEN 2 AND 3".replace(_REF, "r_name || ' ' || x.n_name || ' ' || u.c_custkey")))
def content_page(spark, sf_dir):
    """The second and third passage of every customer."""
    c = trade_corpus(spark, sf_dir)
    passages = D.passage_nodes(c, c.of_type("customer").where("first_slot is not null"))
    return D.content_page(c, passages, 1, 2).drop("corpus")


@query("node_cards", sql(f"SELECT n.node, n.otype, {_REF} AS ref, 'nation,region' AS context, c_mktsegment AS segment, CASE WHEN n.key % 10 = 0 THEN 'checked' END AS annotation FROM co n JOIN nation x ON (SELECT c_nationkey FROM customer u WHERE u.c_custkey = n.key) = x.n_nationkey JOIN region y ON x.n_regionkey = y.r_regionkey WHERE n.first_slot IS NOT NULL".replace("c_custkey AS ref", "n.key AS ref").replace("|| c_custkey", "|| n.key")))
def node_cards(spark, sf_dir):
    """Customers with their references, what encloses them, their features and annotations."""
    c = trade_corpus(spark, sf_dir)
    asked = c.of_type("customer").where("first_slot is not null").select("node", "key")
    notes = asked.where("key % 10 = 0").select("node", F.lit("checked").alias("note"))
    got = D.inspected(c, asked, notes)
    depth = F.regexp_replace("ref", r"^(\S.*) (\d+) \d+$", "$1 $2")  # its own reference, not that of its first order
    return got.select("node", "otype", depth.alias("ref"), F.array_join("context", ",").alias("context"), F.col("features")["segment"].alias("segment"), "annotation")


@query("contents", sql("SELECT 'section' AS kind, CAST(rg.node AS VARCHAR) AS name, r_name AS label, (SELECT count(*) FROM na WHERE n_regionkey = rg.key AND na.first_slot IS NOT NULL) AS n FROM rg WHERE first_slot IS NOT NULL UNION ALL SELECT 'type', otype, otype, count(*) FROM al GROUP BY otype"))
def contents(spark, sf_dir):
    """Top sections and types."""
    return D.contents(trade_corpus(spark, sf_dir)).where("kind = 'type' or label is not null").drop("corpus")


@query("stat_differences", sql("SELECT 'max_node' AS name, (SELECT max(node) FROM al) AS a, (SELECT max(node) FROM al WHERE otype <> 'order') AS b UNION ALL SELECT 'n_types', 5, 4 UNION ALL SELECT 'n_node_features', 8, 7"))
def stat_differences(spark, sf_dir):
    """A load against one that lost a type and a feature."""
    from dataclasses import replace

    c = trade_corpus(spark, sf_dir)
    less = replace(c, nodes=c.nodes.where("otype <> 'order'"), node_features=c.node_features.where("feature <> 'status'"))
    return D.stat_differences(D.stats(c), D.stats(less)).select("name", "a", "b")


@query("utf16_offsets", r"SELECT doc_id, length(text) // 2 AS scalar, length(left(text, length(text) // 2)) + length(regexp_replace(left(text, length(text) // 2), '[^\x{10000}-\x{10FFFF}]', '', 'g')) AS units FROM documents WHERE text IS NOT NULL")
def utf16_offsets(spark, sf_dir):
    """The middle of every text in UTF-16 units, and back."""
    t = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text", F.expr("cast(length(text) div 2 as bigint)").alias("half"))
    t = t.withColumn("units", I.utf16_offset(F.col("text"), F.col("half")))
    return t.select("doc_id", I.scalar_offset(F.col("text"), F.col("units")).alias("scalar"), "units")


@query("name_ids", "WITH h AS (SELECT c_custkey, sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode(c_name)) AS h FROM customer) SELECT c_custkey, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-' || substr('89ab', 1 + (strpos('0123456789abcdef', substr(h, 17, 1)) - 1) % 4, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12) AS id FROM h")
def name_ids(spark, sf_dir):
    """Ids by name."""
    return read(spark, sf_dir, "customer").select("c_custkey", I.uuid5(F.col("c_name")).alias("id"))


@query("canonical_json", """SELECT o_orderkey, '{"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}' AS json, 'sha256:' || sha256('{"priority":"' || o_orderpriority || '","status":"' || o_orderstatus || '"}') AS digest FROM orders""")
def canonical_json(spark, sf_dir):
    """Keys sorted, no spaces."""
    j = I.canonical_json(F.create_map(F.lit("status"), "o_orderstatus", F.lit("priority"), "o_orderpriority"))
    return read(spark, sf_dir, "orders").select("o_orderkey", j.alias("json"), I.digest(j).alias("digest"))


@query("file_names", "SELECT p_partkey, coalesce(nullif(trim(regexp_replace(lower(p_name), '[^a-z0-9]+', '-', 'g'), '-'), ''), 'job-' || p_partkey) || '.corpus' AS file, CASE WHEN p_size % 2 = 0 THEN 'conversion-jobs/job-' || p_partkey || '/v1.' || p_size || '.corpus' END AS snapshot FROM part")
def file_names(spark, sf_dir):
    """Names of results, and keys of snapshots for lawful labels."""
    job = F.concat(F.lit("job-"), F.col("p_partkey").cast("string"))
    label = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("v1."), F.col("p_size").cast("string"))).otherwise(F.lit("latest"))
    return read(spark, sf_dir, "part").select("p_partkey", I.result_filename(F.col("p_name"), job).alias("file"), I.snapshot_key(job, label).alias("snapshot"))


@query("language_names", "SELECT doc_id, CASE lang WHEN 'en' THEN 'english' WHEN 'fr' THEN 'french' WHEN 'de' THEN 'german' WHEN 'es' THEN 'spanish' ELSE coalesce(lower(lang), 'english') END AS name, CASE lang WHEN 'en' THEN 'ENG' WHEN 'fr' THEN 'FRA' WHEN 'de' THEN 'DEU' WHEN 'es' THEN 'SPA' ELSE coalesce(upper(lang), 'ENG') END AS iso, true AS is_tag FROM documents")
def language_names(spark, sf_dir):
    """The languages of documents, English by default."""
    d = read(spark, sf_dir, "documents").withColumn("l", I.language(F.col("lang")))
    return d.select("doc_id", "l.name", "l.iso", I.is_code(F.col("l.code"), "lang_tag").alias("is_tag"))


@query("typed_sections", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE n_name || '|' || c_custkey END AS sections, CASE WHEN c_custkey % 3 = 0 THEN 'not a number' END AS error FROM customer JOIN nation ON c_nationkey = n_nationkey")
def typed_sections(spark, sf_dir):
    """Labels cast to the types of their levels."""
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    asked = F.array("n_name", F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("x"), F.col("c_custkey").cast("string"))).otherwise(F.concat(F.lit("0"), F.col("c_custkey").cast("string"))))
    t = I.typed_sections(asked, ["str", "int"])
    return c.select("c_custkey", F.array_join(t["values"], "|").alias("sections"), t["error"].alias("error"))


@query("metadata_blocks", "SELECT c_custkey, c_name AS title, CASE WHEN c_custkey % 2 = 0 THEN '19' || (10 + c_custkey % 90) END AS year, 'u' || c_custkey AS uid, c_mktsegment AS publisher, CASE WHEN c_custkey % 2 = 0 THEN 0 ELSE 2 END AS n_authors FROM customer")
def metadata_blocks(spark, sf_dir):
    """The block of a manifest and a table of contents."""
    c = read(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    written = F.when(k % 2 == 0, F.concat(F.lit("19"), (k % 90 + 10).cast("string"), F.lit("-02-03"))).otherwise("c. 1800")
    manifest = F.create_map(F.lit("name"), F.col("c_name"), F.lit("written_date"), written)
    toc = F.create_map(F.lit("corpusId"), F.concat(F.lit("u"), k.cast("string")), F.lit("publisherId"), F.col("c_mktsegment"), F.lit("authorId"), F.when(k % 2 == 0, "").otherwise("a,b"))
    b = I.corpus_metadata(k.cast("string"), manifest, toc)
    return c.select("c_custkey", b["title"].alias("title"), b["year"].alias("year"), b["uid"].alias("uid"), b["publisher"].alias("publisher"), F.size(b["authors"]).alias("n_authors"))


@query("html_streams", "SELECT page_id, length(regexp_replace(html, '(?is)<style\\b.*?</style>|<script\\b.*?</script>|<!--.*?-->', '', 'g')) > 0 AS has_text, 0 AS n_doubled FROM pages")
def html_streams(spark, sf_dir):
    """Every page as one stream, without doubled line breaks."""
    p = read(spark, sf_dir, "pages").withColumn("s", X.html_stream(F.col("html")))
    return p.select("page_id", (F.length("s") > 0).alias("has_text"), (F.size(F.split("s", "\n\n")) - 1).alias("n_doubled"))


@query("anchor_parts", "WITH a AS (SELECT doc_id, unnest([0, length(text) // 3, 2 * (length(text) // 3)]) AS place, unnest(['a', 'b', 'c']) AS name, text FROM documents WHERE length(text) >= 3), s AS (SELECT *, lead(place) OVER (PARTITION BY doc_id ORDER BY place, name) AS stop FROM a) SELECT doc_id, name, md5(substr(text, place + 1, coalesce(stop, length(text)) - place)) AS part FROM s")
def anchor_parts(spark, sf_dir):
    """The text between empty anchors, the last to the end."""
    d = read(spark, sf_dir, "documents").where("length(text) >= 3").select("doc_id", "text")
    third = F.expr("cast(length(text) div 3 as bigint)")
    marks = d.select("doc_id", F.explode(F.array(*[F.struct((third * i).alias("place"), F.lit(n).alias("name")) for i, n in enumerate("abc")])).alias("x")).select("doc_id", "x.*")
    return X.between_anchors(d, marks, "doc_id").select("doc_id", "name", F.md5("part").alias("part"))


@query("sql_inserts", """SELECT 'INSERT INTO customer ("c_custkey", "c_name", "c_mktsegment") VALUES (' || c_custkey || ', ''' || c_name || ''', ' || CASE WHEN c_custkey % 5 = 0 THEN 'NULL' ELSE '''o''''' || c_mktsegment || '''' END || ');' AS statement FROM customer""")
def sql_inserts(spark, sf_dir):
    """Rows as statements, quotes doubled."""
    from ..sources import archive

    c = read(spark, sf_dir, "customer").select("c_custkey", "c_name", F.when(F.col("c_custkey") % 5 == 0, None).otherwise(F.concat(F.lit("o'"), "c_mktsegment")).alias("c_mktsegment"))
    return archive.inserts(c, "customer")


@query("package_errors", "SELECT CAST(doc_id AS VARCHAR) AS path, CASE doc_id % 7 WHEN 0 THEN 'missing' WHEN 1 THEN 'unlisted' ELSE 'changed' END AS error FROM documents WHERE text IS NOT NULL AND doc_id % 7 < 3")
def package_errors(spark, sf_dir):
    """Members against their manifest."""
    from ..sources import archive

    d = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.encode("text", "utf-8").alias("content"))
    manifest = archive.digests(d.where("doc_id % 7 <> 1").select("path", "content"))
    have = d.where("doc_id % 7 <> 0").select("path", F.when(F.col("doc_id") % 7 == 2, F.concat("content", F.encode(F.lit("."), "utf-8"))).otherwise(F.col("content")).alias("content"))
    return archive.package_errors(have, manifest)
