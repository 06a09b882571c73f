"""The relational content graph: trees by path, fragments, annotations, full-text search."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import fulltext as T
from ..operators import hierarchy as H
from ..plans.corpus import read
from . import query

#: cn: content nodes in SQL; edition 'trade' (region > nation > customer > order), by sibling position.
BASE = """
cn AS (
  SELECT 'trade' AS edition, 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent_id, 'geo:region' AS type, r_name AS code, CAST(row_number() OVER (ORDER BY r_regionkey) - 1 AS BIGINT) AS ordinal FROM region
  UNION ALL SELECT 'trade', 'n' || n_nationkey, 'r' || n_regionkey, 'geo:nation', n_name, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 FROM nation
  UNION ALL SELECT 'trade', 'c' || c_custkey, 'n' || c_nationkey, 'biz:customer', NULL, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 FROM customer
  UNION ALL SELECT 'trade', 'o' || o_orderkey, 'c' || o_custkey, 'biz:order', NULL, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 FROM orders
), ps AS (
  SELECT r.id, lpad(CAST(r.ordinal AS VARCHAR), 8, '0') AS path FROM cn r WHERE type = 'geo:region'
  UNION ALL SELECT n.id, lpad(CAST(r.ordinal AS VARCHAR), 8, '0') || '.' || lpad(CAST(n.ordinal AS VARCHAR), 8, '0') FROM cn n JOIN cn r ON n.parent_id = r.id WHERE n.type = 'geo:nation'
  UNION ALL SELECT c.id, lpad(CAST(r.ordinal AS VARCHAR), 8, '0') || '.' || lpad(CAST(n.ordinal AS VARCHAR), 8, '0') || '.' || lpad(CAST(c.ordinal AS VARCHAR), 8, '0') FROM cn c JOIN cn n ON c.parent_id = n.id JOIN cn r ON n.parent_id = r.id WHERE c.type = 'biz:customer'
  UNION ALL SELECT o.id, lpad(CAST(r.ordinal AS VARCHAR), 8, '0') || '.' || lpad(CAST(n.ordinal AS VARCHAR), 8, '0') || '.' || lpad(CAST(c.ordinal AS VARCHAR), 8, '0') || '.' || lpad(CAST(o.ordinal AS VARCHAR), 8, '0') FROM cn o JOIN cn c ON o.parent_id = c.id JOIN cn n ON c.parent_id = n.id JOIN cn r ON n.parent_id = r.id WHERE o.type = 'biz:order'
), nd AS (
  SELECT cn.*, ps.path, ordinal + 1 AS ref_ordinal FROM cn JOIN ps ON cn.id = ps.id
)
"""


def sql(body: str) -> str:
    return f"WITH {BASE.strip()}\n{body}"


def content_nodes(spark, sf_dir):
    """edition, id, parent_id, type, code, ordinal, ref_ordinal: a node for each region, nation, customer, order.

    Sibling positions are windows inside one parent; only customers of a nation can be many, and they are
    numbered in two levels.
    """
    from ..plans.prefix import running_sum

    def level(table, prefix, key, parent, kind, code, wide=False):
        df = read(spark, sf_dir, table)
        up = F.concat(F.lit(parent[0]), F.col(parent[1]).cast("string")) if parent else F.lit(None).cast("string")
        df = df.select(F.concat(F.lit(prefix), F.col(key).cast("string")).alias("id"), up.alias("parent_id"), F.lit(kind).alias("type"), (F.col(code) if code else F.lit(None).cast("string")).alias("code"), F.col(key).cast("long").alias("k"))
        if wide:
            df = running_sum(df, ["parent_id"], F.expr("k div 8192"), ["k"], F.lit(1), "ordinal")
        else:
            df = df.withColumn("ordinal", F.row_number().over(Window.partitionBy("parent_id").orderBy("k")).cast("long") - 1)
        return df.select(F.lit("trade").alias("edition"), "id", "parent_id", "type", "code", "ordinal", (F.col("ordinal") + 1).alias("ref_ordinal"))

    out = level("region", "r", "r_regionkey", None, "geo:region", "r_name")
    out = out.unionByName(level("nation", "n", "n_nationkey", ("r", "n_regionkey"), "geo:nation", "n_name"))
    out = out.unionByName(level("customer", "c", "c_custkey", ("n", "c_nationkey"), "biz:customer", None, True))
    return out.unionByName(level("orders", "o", "o_orderkey", ("c", "o_custkey"), "biz:order", None))


def with_paths(spark, sf_dir):
    nodes = content_nodes(spark, sf_dir)
    return nodes.join(H.rebuild_paths(nodes), ["edition", "id"])


@query("path_rebuild", sql("SELECT id, path FROM nd"))
def path_rebuild(spark, sf_dir):
    """Paths from parents and positions."""
    return H.rebuild_paths(content_nodes(spark, sf_dir)).select("id", "path")


@query("subtree_depth", sql("SELECT id, path FROM nd WHERE (path = '00000001' OR starts_with(path, '00000001.')) AND length(path) - length(replace(path, '.', '')) <= 2"))
def subtree_depth(spark, sf_dir):
    """H16 (Q1): two levels below a region."""
    return H.subtree(with_paths(spark, sf_dir), "00000001", 2).select("id", "path")


@query("breadcrumbs", sql("SELECT n.id, a.id AS ancestor, (length(n.path) - length(a.path)) // 9 AS up FROM nd n JOIN nd a ON starts_with(n.path, a.path || '.') WHERE n.type = 'biz:customer'"))
def breadcrumbs(spark, sf_dir):
    """H17 (Q2): ancestors of every customer, by an equi-join on path prefixes."""
    nodes = with_paths(spark, sf_dir)
    up = H.ancestors(nodes.where("type = 'biz:customer'")).join(nodes.select("edition", F.col("path").alias("ancestor_path"), F.col("id").alias("ancestor")), ["edition", "ancestor_path"])
    return up.join(nodes.select("edition", "path", "id"), ["edition", "path"]).select("id", "ancestor", F.col("up").cast("long").alias("up"))


@query("previous_next", sql("SELECT id, lag(path) OVER (PARTITION BY type ORDER BY path) AS prev_path, lead(path) OVER (PARTITION BY type ORDER BY path) AS next_path FROM nd WHERE type = 'geo:nation'"))
def previous_next(spark, sf_dir):
    """H18 (Q3)."""
    return H.neighbours(with_paths(spark, sf_dir).where("type = 'geo:nation'")).select("id", "prev_path", "next_path")


@query("path_range", sql("SELECT id, path FROM nd WHERE type = 'biz:customer' AND path >= '00000000.00000001' AND (path <= '00000002.00000001' OR starts_with(path, '00000002.00000001.'))"))
def path_range(spark, sf_dir):
    """H19 (Q4): from one nation to another, its subtree included."""
    return H.between(with_paths(spark, sf_dir), "biz:customer", "00000000.00000001", "00000002.00000001").select("id", "path")


@query("keyset_page", sql("SELECT id, path FROM nd WHERE type = 'biz:customer' AND path > '00000002.00000001.00000003' ORDER BY path LIMIT 26"))
def keyset_page(spark, sf_dir):
    """H20 (Q5): 25 after a cursor, and one more that tells of a next page."""
    return H.page_after(with_paths(spark, sf_dir).where("type = 'biz:customer'"), "00000002.00000001.00000003", 25).select("id", "path")


@query("reference_walk", sql("SELECT o.id FROM nd r JOIN nd n ON n.parent_id = r.id AND n.type = 'geo:nation' JOIN nd c ON c.parent_id = n.id AND c.type = 'biz:customer' AND c.ref_ordinal = 3 JOIN nd o ON o.parent_id = c.id AND o.type = 'biz:order' AND o.ref_ordinal = 2 WHERE r.code = 'EUROPE' AND n.ref_ordinal = 2"))
def reference_walk(spark, sf_dir):
    """H21 (Q6): EUROPE / second nation / third customer / second order."""
    steps = [("geo:region", "code", "EUROPE"), ("geo:nation", "ref_ordinal", 2), ("biz:customer", "ref_ordinal", 3), ("biz:order", "ref_ordinal", 2)]
    return H.walk_down(content_nodes(spark, sf_dir), steps).select("id")


@query("reference_levels", sql("SELECT id, ref_ordinal FROM nd WHERE type <> 'biz:order'"))
def reference_levels(spark, sf_dir):
    """Canonical numbers from positions."""
    return H.reference_levels(content_nodes(spark, sf_dir).where("type <> 'biz:order'").drop("ref_ordinal")).select("id", F.col("ref_ordinal").cast("long").alias("ref_ordinal"))


@query("subtree_annotations", sql("SELECT d.doc_id, nd.id AS target FROM labels d JOIN nd ON nd.id = 'c' || d.doc_id WHERE nd.path = '00000001' OR starts_with(nd.path, '00000001.')"))
def subtree_annotations(spark, sf_dir):
    """H22 (Q8): annotations (labels, on the customer of their number) in a region's subtree."""
    notes = read(spark, sf_dir, "labels").select("doc_id", F.concat(F.lit("c"), F.col("doc_id").cast("string")).alias("target"))
    inside = with_paths(spark, sf_dir).where(H.under(F.col("path"), "00000001")).select(F.col("id").alias("target"))
    return notes.join(inside, "target").select("doc_id", "target")


@query("structure_check", "SELECT 'p' || p_partkey % 7 AS structure, p_partkey AS node, CASE WHEN p_partkey = p_partkey // 2 * 2 AND p_partkey % 100 = 50 THEN 'missing_parent' ELSE 'self_parent' END AS error FROM part WHERE p_partkey % 100 IN (50, 99)")
def structure_check(spark, sf_dir):
    """Parts as trees; every hundredth has a parent that isn't there, another is its own."""
    part = read(spark, sf_dir, "part").select(F.concat(F.lit("p"), (F.col("p_partkey") % 7).cast("string")).alias("structure"), F.col("p_partkey").alias("node"))
    parent = F.when(F.col("node") % 100 == 50, F.lit(-1)).when(F.col("node") % 100 == 99, F.col("node"))
    return H.structure_errors(part.withColumn("parent", parent.cast("long")))


# --- conversations as transcripts ---------------------------------------------------------------------------
@query("transcript_turns", "SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS utterance, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS of_role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_role FROM conversations")
def transcript_turns(spark, sf_dir):
    """Utterances numbered in their session, and by role."""
    w, r = Window.partitionBy("conv_id").orderBy("turn"), Window.partitionBy("conv_id", "role").orderBy("turn")
    return read(spark, sf_dir, "conversations").select("conv_id", "turn", F.row_number().over(w).cast("long").alias("utterance"), F.row_number().over(r).cast("long").alias("of_role"), F.lag("role").over(w).alias("prev_role"))


@query("stream_offsets", "SELECT conv_id, turn, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, coalesce(sum(length(text) + 1) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(text) AS stop FROM conversations")
def stream_offsets(spark, sf_dir):
    """Parts joined to one stream by a separator of one character, with their offsets."""
    from ..functions.text import stream_parts

    return stream_parts(read(spark, sf_dir, "conversations"), ["conv_id"], "turn", "text", 1).select("conv_id", "turn", "start", "stop")


# --- full text ---------------------------------------------------------------------------------------------
@query("postings", r"SELECT term, count(DISTINCT doc_id) AS n_docs, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY term")
def postings(spark, sf_dir):
    """The inverted index of all documents, whatever their language, summed by term."""
    p = T.postings(read(spark, sf_dir, "documents"), "doc_id", "text")
    return p.groupBy("term").agg(F.count(F.lit(1)).alias("n_docs"), F.sum("tf").alias("n"))


@query("full_text_search", r"""WITH p AS (SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents) GROUP BY ALL),
 s AS (SELECT doc_id, sum(tf) AS score FROM p WHERE term IN ('licensed', 'under') GROUP BY doc_id HAVING count(*) = 2)
 SELECT doc_id, CAST(score AS BIGINT) AS score FROM s ORDER BY score DESC, doc_id LIMIT 20""")
def full_text_search(spark, sf_dir):
    """W13, L34 (Q7): documents with all terms, by summed frequency."""
    return T.search(T.postings(read(spark, sf_dir, "documents"), "doc_id", "text"), ["licensed", "under"], 20)


@query("snippets", r"SELECT doc_id, regexp_replace(regexp_extract(text, '[^\n]*(?i:licensed)[^\n]*'), '(?i:licensed)', '<em>\0</em>', 'g') AS snippet FROM documents WHERE regexp_matches(text, '(?i:licensed)')")
def snippets(spark, sf_dir):
    """The first line with the term, the term marked."""
    return T.snippets(read(spark, sf_dir, "documents"), "licensed").select("doc_id", "snippet")
