"""Structure, search and aggregation on the order hierarchy."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import search as S
from ..operators import structure as H
from ..plans.corpus import trade_corpus
from . import query

#: The hierarchy in SQL: li (slots with all keys), nd (nodes above the slots), it (nodes of the slots).
BASE = """
li AS (
  SELECT row_number() OVER (ORDER BY n_regionkey, n_nationkey, c_custkey, o_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS slot,
    n_regionkey, n_nationkey, c_custkey, o_orderkey, l.*
  FROM lineitem l JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
), sp AS (
  SELECT 'region' AS otype, CAST(n_regionkey AS BIGINT) AS key, min(slot) AS first_slot, max(slot) AS last_slot, count(*) AS n_slots FROM li GROUP BY ALL
  UNION ALL SELECT 'nation', n_nationkey, min(slot), max(slot), count(*) FROM li GROUP BY ALL
  UNION ALL SELECT 'customer', c_custkey, min(slot), max(slot), count(*) FROM li GROUP BY ALL
  UNION ALL SELECT 'order', o_orderkey, min(slot), max(slot), count(*) FROM li GROUP BY ALL
), ky AS (
  SELECT 1 AS o, 'region' AS otype, CAST(r_regionkey AS BIGINT) AS key FROM region UNION ALL SELECT 2, 'nation', n_nationkey FROM nation
  UNION ALL SELECT 3, 'customer', c_custkey FROM customer UNION ALL SELECT 4, 'order', o_orderkey FROM orders
), nd AS (
  SELECT ky.otype, ky.key, (SELECT max(slot) FROM li) + row_number() OVER (ORDER BY o, ky.key) AS node, first_slot, last_slot, coalesce(n_slots, 0) AS n_slots
  FROM ky LEFT JOIN sp ON ky.otype = sp.otype AND ky.key = sp.key
), it AS (
  SELECT 'item' AS otype, slot AS node, slot AS first_slot, slot AS last_slot, 1 AS n_slots, l_partkey AS key FROM li
), al AS (
  SELECT otype, node, first_slot, last_slot, n_slots, key FROM nd UNION ALL SELECT otype, node, first_slot, last_slot, n_slots, key FROM it
), co AS (SELECT nd.*, c_mktsegment, c_custkey FROM nd JOIN customer ON key = c_custkey WHERE otype = 'customer'
), oo AS (SELECT nd.*, o_orderstatus, o_orderpriority, o_custkey, o_orderkey FROM nd JOIN orders ON key = o_orderkey WHERE otype = 'order'
), na AS (SELECT nd.*, n_name, n_regionkey FROM nd JOIN nation ON key = n_nationkey WHERE otype = 'nation'
), rg AS (SELECT nd.*, r_name FROM nd JOIN region ON key = r_regionkey WHERE otype = 'region')
"""


def sql(body: str) -> str:
    return f"WITH {BASE.strip()}\n{body}"


def search_query(name: str, template: str, body: str, shape=None):
    """A template whose results are listed by node, or shaped by a result mode."""

    @query(name, sql(body))
    def run(spark, sf_dir):
        corpus = trade_corpus(spark, sf_dir)
        found = S.search(corpus, template)
        return shape(corpus, found) if shape else found.select(*S.result_nodes(found))

    run.__doc__ = f"The template:\n{template}"
    return run


# --- nodes and types ---------------------------------------------------------------------------------------
@query("node_table", sql("SELECT otype, node, first_slot, last_slot, n_slots, key FROM al"))
def node_table(spark, sf_dir):
    """Slots and nodes of the hierarchy (section 1.1)."""
    return trade_corpus(spark, sf_dir).nodes.drop("corpus")


@query("type_scan", sql("SELECT node, row_number() OVER (ORDER BY first_slot NULLS LAST, last_slot DESC NULLS LAST, node) AS rank FROM nd WHERE otype = 'customer'"))
def type_scan(spark, sf_dir):
    """The nodes of one type in canonical order."""
    return H.rank_nodes(trade_corpus(spark, sf_dir).of_type("customer")).select("node", "rank")


@query("type_counts", sql("SELECT otype, count(*) AS n FROM al GROUP BY otype"))
def type_counts(spark, sf_dir):
    """A01, describe_corpus."""
    return trade_corpus(spark, sf_dir).nodes.groupBy("otype").agg(F.count(F.lit(1)).alias("n"))


@query("type_statistics", sql("SELECT otype, count(*) AS n, CASE WHEN otype = 'item' THEN 1.0 ELSE round_even(avg(last_slot - first_slot + 1), 1) END AS mean_span, otype = 'item' AS is_slot FROM al GROUP BY otype"))
def type_statistics(spark, sf_dir):
    """A03, R10."""
    return H.type_statistics(trade_corpus(spark, sf_dir)).drop("corpus")


@query("corpus_stats", sql("SELECT (SELECT max(slot) FROM li) AS max_slot, (SELECT max(node) FROM al) AS max_node, (SELECT count(DISTINCT otype) FROM al) AS n_types, 8 AS n_node_features, 1 AS n_edge_features"))
def corpus_stats(spark, sf_dir):
    """A06, validate_corpus."""
    c = trade_corpus(spark, sf_dir)
    a = c.nodes.agg(F.max(F.when(F.col("otype") == c.slot_type, F.col("node"))).alias("max_slot"), F.max("node").alias("max_node"), F.countDistinct("otype").alias("n_types"))
    f = c.node_features.agg(F.countDistinct("feature").cast("int").alias("n_node_features"))
    e = c.edge_features.agg(F.countDistinct("feature").cast("int").alias("n_edge_features"))
    return a.join(f.withColumn("k", F.lit(1)), F.lit(True)).join(e, F.lit(True)).drop("k")


@query("feature_list", "SELECT * FROM (VALUES ('flag', 'node', 'str'), ('linestatus', 'node', 'str'), ('quantity', 'node', 'int'), ('linenumber', 'node', 'int'), ('name', 'node', 'str'), ('segment', 'node', 'str'), ('status', 'node', 'str'), ('priority', 'node', 'str'), ('next_part', 'edge', 'str')) AS t(feature, kind, value_type)")
def feature_list(spark, sf_dir):
    """P08, list_features: node and edge features with their value types."""
    c = trade_corpus(spark, sf_dir)
    node = c.node_features.groupBy("feature").agg(F.when(F.max(F.col("value_int").isNotNull()), "int").otherwise("str").alias("value_type")).withColumn("kind", F.lit("node"))
    edge = c.edge_features.select("feature").distinct().withColumns({"value_type": F.lit("str"), "kind": F.lit("edge")})
    return node.unionByName(edge).select("feature", "kind", "value_type")


@query("features_of_type", sql("SELECT 'order' AS otype, f AS feature, count(*) AS n FROM (SELECT unnest(['status', 'priority']) AS f FROM orders) GROUP BY f"))
def features_of_type(spark, sf_dir):
    """Features that have a value on nodes of a type."""
    c = trade_corpus(spark, sf_dir)
    return c.node_features.join(c.of_type("order").select("corpus", "node"), ["corpus", "node"], "left_semi").groupBy("feature").agg(F.count(F.lit(1)).alias("n")).withColumn("otype", F.lit("order"))


@query("feature_frequency", sql("SELECT c_mktsegment AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, c_mktsegment) AS rank FROM customer GROUP BY 1 QUALIFY rank <= 3"))
def feature_frequency(spark, sf_dir):
    """A02, describe_feature: the three commonest values; ties by value."""
    from ..operators.aggregate import top_values

    return top_values(trade_corpus(spark, sf_dir), "segment", 3)


@query("feature_lookup", sql("SELECT node, o_orderstatus AS status, o_orderpriority AS priority, CAST(NULL AS VARCHAR) AS segment FROM oo UNION ALL SELECT node, NULL, NULL, c_mktsegment FROM co"))
def feature_lookup(spark, sf_dir):
    """P02, R04, get_node_features: a wide table of features, null where not defined."""
    c = trade_corpus(spark, sf_dir)
    return c.with_features(c.nodes.where("otype in ('order', 'customer')"), ["status", "priority", "segment"]).select("node", "status", "priority", "segment")


@query("occurrences", sql("SELECT CAST(n_nationkey AS BIGINT) AS nation, l_returnflag AS value, count(*) AS in_section, CAST(sum(count(*)) OVER (PARTITION BY l_returnflag) AS BIGINT) AS in_corpus FROM li GROUP BY n_nationkey, l_returnflag"))
def occurrences(spark, sf_dir):
    """How often each value of a slot feature occurs, in the corpus and in each nation."""
    from ..operators.aggregate import occurrence_counts

    return occurrence_counts(trade_corpus(spark, sf_dir), "flag", "nation").withColumnRenamed("section", "nation")


# --- structure ----------------------------------------------------------------------------------------------
@query("embedded_nodes", sql("SELECT p.node AS customer, c.node AS order_node FROM co p JOIN oo c ON c.o_custkey = p.c_custkey WHERE c.first_slot IS NOT NULL"))
def embedded_nodes(spark, sf_dir):
    """Orders inside customers, by slots; the oracle joins keys."""
    c = trade_corpus(spark, sf_dir)
    return H.embedding_pairs(c.of_type("customer"), c.of_type("order")).select(F.col("p_node").alias("customer"), F.col("c_node").alias("order_node"))


@query("embedders", sql("""SELECT c.node, p.otype, p.node AS embedder, row_number() OVER (PARTITION BY c.node ORDER BY p.last_slot - p.first_slot, CASE p.otype WHEN 'customer' THEN 1 WHEN 'nation' THEN 2 ELSE 3 END) AS nearness
 FROM oo c JOIN customer cu ON c.o_custkey = cu.c_custkey JOIN nation n ON cu.c_nationkey = n.n_nationkey JOIN nd p ON (p.otype = 'customer' AND p.key = cu.c_custkey) OR (p.otype = 'nation' AND p.key = n.n_nationkey) OR (p.otype = 'region' AND p.key = n.n_regionkey)
 WHERE c.first_slot IS NOT NULL"""))
def embedders(spark, sf_dir):
    """What embeds each order, nearest first; equal spans by level."""
    from pyspark.sql import Window

    c = trade_corpus(spark, sf_dir)
    up = H.embedding_pairs(c.nodes.where("otype in ('region', 'nation', 'customer')"), c.of_type("order"))
    level = F.when(F.col("p_otype") == "customer", 1).when(F.col("p_otype") == "nation", 2).otherwise(3)
    near = F.row_number().over(Window.partitionBy("c_node").orderBy(F.col("p_last_slot") - F.col("p_first_slot"), level))
    return up.select(F.col("c_node").alias("node"), F.col("p_otype").alias("otype"), F.col("p_node").alias("embedder"), near.alias("nearness"))


@query("child_index", sql("SELECT p.node AS customer, c.node, row_number() OVER (PARTITION BY p.node ORDER BY c.first_slot, c.last_slot DESC, c.node) AS index FROM co p JOIN oo c ON c.o_custkey = p.c_custkey WHERE c.first_slot IS NOT NULL"))
def child_index(spark, sf_dir):
    """Anchored children with their number."""
    c = trade_corpus(spark, sf_dir)
    return H.anchored_children(c.of_type("customer"), c.of_type("order")).select(F.col("p_node").alias("customer"), F.col("c_node").alias("node"), "index")


@query("anchor_section", sql("SELECT it.node, oo.node AS section_node FROM li JOIN it ON li.slot = it.node JOIN oo ON oo.o_orderkey = li.o_orderkey"))
def anchor_section(spark, sf_dir):
    """The innermost section of each slot."""
    c = trade_corpus(spark, sf_dir)
    return H.enclosing_sections(c, c.of_type("item")).select("node", "section_node")


@query("heading_labels", sql("SELECT c.node, r_name AS region, n_name AS nation, c.key AS customer, concat_ws(' ', r_name, n_name, CAST(c.key AS VARCHAR)) AS ref, CAST(c.key AS VARCHAR) AS label FROM co c JOIN customer u ON c.key = u.c_custkey JOIN nation ON u.c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE c.first_slot IS NOT NULL"))
def heading_labels(spark, sf_dir):
    """Section labels of customers, as a reference and its last part."""
    c = trade_corpus(spark, sf_dir)
    c.section_types = ["region", "nation", "customer"]
    out = H.headings(c, c.of_type("customer").where("first_slot is not null"))
    return out.select("node", *c.section_types, H.section_ref(c.section_types).alias("ref"), F.element_at(F.array(*[F.col(x).cast("string") for x in c.section_types]), -1).alias("label"))


@query("section_index", sql("SELECT o_orderpriority AS priority, o_orderstatus AS status, arg_min(node, struct_pack(a := coalesce(first_slot, 4611686018427387904), b := -coalesce(last_slot, 0), c := node)) AS node FROM oo GROUP BY ALL"))
def section_index(spark, sf_dir):
    """The first node of each heading, where headings repeat."""
    c = trade_corpus(spark, sf_dir)
    return H.first_by_heading(c.with_features(c.of_type("order"), ["priority", "status"]), ["priority", "status"]).drop("corpus")


@query("top_sections", sql("SELECT p.node, count(c.node) AS child_count, least(count(c.node), 500) AS shown, count(c.node) > 500 AS truncated FROM na p LEFT JOIN customer u ON u.c_nationkey = p.key LEFT JOIN co c ON c.c_custkey = u.c_custkey AND c.first_slot IS NOT NULL GROUP BY p.node"))
def top_sections(spark, sf_dir):
    """H11."""
    return H.top_sections(trade_corpus(spark, sf_dir), "nation", "customer").drop("corpus")


@query("paged_children", sql("SELECT * FROM (SELECT p.node AS parent, c.node, row_number() OVER (PARTITION BY p.node ORDER BY c.first_slot, c.last_slot DESC, c.node) AS place, count(*) OVER (PARTITION BY p.node) AS total, CASE WHEN count(*) OVER (PARTITION BY p.node) > 20 THEN 20 END AS next_offset FROM na p JOIN customer u ON u.c_nationkey = p.key JOIN co c ON c.c_custkey = u.c_custkey WHERE c.first_slot IS NOT NULL) WHERE place > 10 AND place <= 20"))
def paged_children(spark, sf_dir):
    """The second page of ten children."""
    return H.paged_children(trade_corpus(spark, sf_dir), "nation", "customer", 10, 10).drop("corpus")


@query("slot_span", sql("SELECT node, last_slot - first_slot + 1 AS span, n_slots FROM nd WHERE first_slot IS NOT NULL"))
def slot_span(spark, sf_dir):
    """The span, which isn't the number of slots where a node has gaps."""
    return trade_corpus(spark, sf_dir).nodes.where("otype <> 'item' and first_slot is not null").select("node", (F.col("last_slot") - F.col("first_slot") + 1).alias("span"), "n_slots")


@query("slot_tokens", sql("SELECT oo.node, string_agg(l_returnflag, ' ' ORDER BY slot) AS text FROM oo JOIN li ON oo.o_orderkey = li.o_orderkey GROUP BY oo.node"))
def slot_tokens(spark, sf_dir):
    """The text of each order's slots."""
    c = trade_corpus(spark, sf_dir)
    return H.node_text(c, c.of_type("order")).drop("corpus")


@query("node_inspection", sql("SELECT c.node, c.otype, c.last_slot - c.first_slot + 1 AS span, c.c_mktsegment AS segment, n.node AS nation, (SELECT count(*) FROM co x WHERE x.c_mktsegment = c.c_mktsegment) AS n_same FROM co c JOIN customer u ON u.c_custkey = c.c_custkey JOIN na n ON n.key = u.c_nationkey WHERE c.first_slot IS NOT NULL"))
def node_inspection(spark, sf_dir):
    """Type, span, feature, context and occurrences of customers."""
    c = trade_corpus(spark, sf_dir)
    own = c.with_features(c.of_type("customer").where("first_slot is not null"), ["segment"])
    up = H.embedding_pairs(c.of_type("nation"), c.of_type("customer")).select(F.col("c_node").alias("node"), F.col("p_node").alias("nation"))
    same = c.feature("segment").groupBy("segment").agg(F.count(F.lit(1)).alias("n_same"))
    return own.join(up, "node").join(same, "segment").select("node", "otype", (F.col("last_slot") - F.col("first_slot") + 1).alias("span"), "segment", "nation", "n_same")


@query("discontinuous_nodes", sql("SELECT l_suppkey AS supplier, count(*) AS n_slots, count(*) FILTER (is_start) AS n_ranges FROM (SELECT l_suppkey, slot, slot - 1 IS DISTINCT FROM lag(slot) OVER (PARTITION BY l_suppkey ORDER BY slot) AS is_start FROM li) GROUP BY 1 HAVING count(*) FILTER (is_start) > 1"))
def discontinuous_nodes(spark, sf_dir):
    """Nodes over scattered slots (each supplier's), as ranges."""
    from ..operators.aggregate import slot_ranges
    from ..plans.corpus import trade_slots

    members = trade_slots(spark, sf_dir).select(F.col("l_suppkey").alias("supplier"), "slot")
    out = slot_ranges(members, ["supplier"])
    return out.where(F.size("ranges") > 1).select("supplier", "n_slots", F.size("ranges").cast("long").alias("n_ranges"))


# --- search -------------------------------------------------------------------------------------------------
search_query("search_nodes", "order status=F", "SELECT node AS n1 FROM oo WHERE o_orderstatus = 'F' AND first_slot IS NOT NULL")
search_query("search_regex", "customer segment~^(BUILD|AUTO)", "SELECT node AS n1 FROM co WHERE regexp_matches(c_mktsegment, '^(BUILD|AUTO)') AND first_slot IS NOT NULL")
search_query("search_not_equal", "order priority#1-URGENT", "SELECT node AS n1 FROM oo WHERE o_orderpriority <> '1-URGENT' AND first_slot IS NOT NULL")
search_query("search_numeric", "item quantity>45 linenumber<3", "SELECT slot AS n1 FROM li WHERE CAST(l_quantity AS BIGINT) > 45 AND l_linenumber < 3")
search_query("search_string_order", "customer segment<C", "SELECT node AS n1 FROM co WHERE c_mktsegment < 'C' AND first_slot IS NOT NULL")
search_query("search_defined", "nation ?name", "SELECT node AS n1 FROM na WHERE first_slot IS NOT NULL")
search_query(
    "search_containment", "customer segment=BUILDING\n  order status=F\n    item flag=R",
    "SELECT c.node AS n1, o.node AS n2, l.slot AS n3 FROM co c JOIN oo o ON o.o_custkey = c.c_custkey JOIN li l ON l.o_orderkey = o.o_orderkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F' AND l_returnflag = 'R'",
)
search_query(
    "search_adjacency", "order\n  item flag=R\n  <: item flag=A",
    "SELECT o.node AS n1, a.slot AS n2, b.slot AS n3 FROM oo o JOIN li a ON a.o_orderkey = o.o_orderkey JOIN li b ON b.slot = a.slot + 1 AND b.o_orderkey = a.o_orderkey WHERE a.l_returnflag = 'R' AND b.l_returnflag = 'A'",
)
search_query(
    "search_before", "order priority=1-URGENT\n  item flag=R\n  < item flag=N",
    "SELECT o.node AS n1, a.slot AS n2, b.slot AS n3 FROM oo o JOIN li a ON a.o_orderkey = o.o_orderkey JOIN li b ON b.o_orderkey = a.o_orderkey AND a.slot < b.slot WHERE o_orderpriority = '1-URGENT' AND a.l_returnflag = 'R' AND b.l_returnflag = 'N'",
)
search_query(
    "search_same_slots", "customer\n=: order",
    "SELECT c.node AS n1, o.node AS n2 FROM co c JOIN oo o ON o.first_slot = c.first_slot AND o.last_slot = c.last_slot",
)
search_query(
    "search_overlap", "nation name~^[A-C]\n|| customer segment=MACHINERY",
    "SELECT n.node AS n1, c.node AS n2 FROM na n JOIN customer u ON u.c_nationkey = n.key JOIN co c ON c.c_custkey = u.c_custkey WHERE regexp_matches(n_name, '^[A-C]') AND c.c_mktsegment = 'MACHINERY' AND c.first_slot IS NOT NULL",
)
search_query(
    "search_edge", "item flag=R\n-next_part> item flag=N",
    "SELECT a.slot AS n1, b.slot AS n2 FROM li a JOIN li b ON b.slot = a.slot + 1 WHERE b.l_partkey > a.l_partkey AND a.l_returnflag = 'R' AND b.l_returnflag = 'N'",
)
search_query(
    "search_without", "order status=O\n/without/\n  item flag=N\n/-/",
    "SELECT node AS n1 FROM oo WHERE o_orderstatus = 'O' AND first_slot IS NOT NULL AND NOT EXISTS (SELECT 1 FROM li WHERE li.o_orderkey = oo.o_orderkey AND l_returnflag = 'N')",
)
search_query(
    "search_where", "customer segment=FURNITURE\n/where/\n  order status=P\n    item quantity>40\n/-/",
    "SELECT node AS n1 FROM co c WHERE c_mktsegment = 'FURNITURE' AND EXISTS (SELECT 1 FROM oo o JOIN li ON li.o_orderkey = o.o_orderkey WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'P' AND CAST(l_quantity AS BIGINT) > 40)",
)
search_query(
    "search_with", "order\n/with/\n  item flag=R\n  <: item flag=R\n/-/",
    "SELECT node AS n1 FROM oo o WHERE EXISTS (SELECT 1 FROM li a JOIN li b ON b.slot = a.slot + 1 AND b.o_orderkey = a.o_orderkey WHERE a.o_orderkey = o.o_orderkey AND a.l_returnflag = 'R' AND b.l_returnflag = 'R')",
)
search_query(
    "search_or", "customer\n/where/\n  order status=P\n/or/\n  item quantity>49\n/-/",
    "SELECT node AS n1 FROM co c WHERE EXISTS (SELECT 1 FROM oo o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'P' AND o.first_slot IS NOT NULL) OR EXISTS (SELECT 1 FROM li WHERE li.c_custkey = c.c_custkey AND CAST(l_quantity AS BIGINT) > 49)",
)
search_query(
    "search_union", "order status=P\n/or/\norder priority=5-LOW",
    "SELECT node AS n1 FROM oo WHERE (o_orderstatus = 'P' OR o_orderpriority = '5-LOW') AND first_slot IS NOT NULL",
)
search_query("search_count", "order status=F\n  item flag=A", "SELECT count(*) AS n FROM oo JOIN li ON li.o_orderkey = oo.o_orderkey WHERE o_orderstatus = 'F' AND l_returnflag = 'A'", lambda c, r: S.count(r))
search_query(
    "search_statistics", "customer segment=BUILDING\n  order status=F",
    "SELECT unnest(['customer', 'order']) AS otype, count(*) AS n FROM co c JOIN oo o ON o.o_custkey = c.c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F' AND o.first_slot IS NOT NULL GROUP BY 1",
    S.statistics,
)
search_query(
    "search_passages", "order status=P\n  item quantity>45",
    "SELECT 'trade' AS corpus, oo.node, string_agg(l_returnflag, ' ' ORDER BY slot) AS text FROM oo JOIN li ON oo.o_orderkey = li.o_orderkey WHERE o_orderstatus = 'P' GROUP BY oo.node HAVING max(CAST(l_quantity AS BIGINT)) > 45",
    S.passages,
)
search_query(
    "search_export", "customer segment=BUILDING\n  order status=P",
    """, x AS (SELECT c.node AS n1, o.node AS n2, row_number() OVER (ORDER BY c.first_slot, c.last_slot DESC, c.node, o.first_slot, o.last_slot DESC, o.node) - 1 AS k FROM co c JOIN oo o ON o.o_custkey = c.c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'P' AND o.first_slot IS NOT NULL)
    SELECT 'trade' AS corpus, k AS result_index, 0 AS slot_index, n1 AS node, 'customer' AS otype, 'BUILDING' AS segment, CAST(NULL AS VARCHAR) AS status FROM x UNION ALL SELECT 'trade', k, 1, n2, 'order', NULL, 'P' FROM x""",
    lambda c, r: S.export(c, r, ["segment", "status"]),
)
search_query(
    "search_page", "customer segment=BUILDING\n  order status=F",
    "SELECT c.node AS n1, o.node AS n2 FROM co c JOIN oo o ON o.o_custkey = c.c_custkey WHERE c_mktsegment = 'BUILDING' AND o_orderstatus = 'F' AND o.first_slot IS NOT NULL ORDER BY c.first_slot, c.last_slot DESC, c.node, o.first_slot, o.last_slot DESC, o.node LIMIT 20 OFFSET 20",
    lambda c, r: _second_page(r),
)


def _second_page(results):
    """Twenty results after the first twenty, by the last row as cursor."""
    last = S.page(results, 20).collect()[-1].asDict()
    return S.page(results, 20, last).select("n1", "n2")
