"""References on the order hierarchy and on text."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import refs as R
from ..operators import reference as Q
from ..plans.corpus import read, trade_corpus
from ..plans.tables import kept
from . import query
from .trade import sql


def _three(spark, sf_dir):
    c = trade_corpus(spark, sf_dir)
    c.section_types = ["region", "nation", "customer"]
    return c


@query("reference_serialize", sql("SELECT o.node, 'trade@1/' || r_name || ':' || n_name || ':' || u.c_custkey || '!order' || row_number() OVER (PARTITION BY u.c_custkey ORDER BY o.first_slot, o.last_slot DESC, o.node) AS ref FROM oo o JOIN customer u ON u.c_custkey = o.o_custkey JOIN nation ON u.c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE o.first_slot IS NOT NULL"))
def reference_serialize(spark, sf_dir):
    """A durable reference for every order."""
    return Q.serialize(_three(spark, sf_dir), "order", "trade", "1")


@query("reference_resolve", sql("""SELECT CAST(u.c_custkey AS BIGINT) AS id, o.node, 'resolved' AS status FROM customer u JOIN (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY first_slot, last_slot DESC, node) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM oo WHERE first_slot IS NOT NULL) o ON o.o_custkey = u.c_custkey WHERE o.i IN (2, 3) AND o.n >= 3 AND u.c_custkey % 7 <> 0
 UNION ALL SELECT u.c_custkey, NULL, CASE WHEN u.c_custkey % 7 = 0 THEN 'version_mismatch' WHEN coalesce(o.n, 0) = 0 THEN 'section_not_found' ELSE 'index_out_of_range' END FROM customer u LEFT JOIN (SELECT o_custkey, count(*) AS n FROM oo WHERE first_slot IS NOT NULL GROUP BY 1) o ON o.o_custkey = u.c_custkey WHERE u.c_custkey % 7 = 0 OR coalesce(o.n, 0) < 3"""))
def reference_resolve(spark, sf_dir):
    """The second and third order of every customer, with errors as statuses; one in seven asks for another version."""
    u = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    version = F.when(F.col("c_custkey") % 7 == 0, "@9").otherwise("@1")
    ref = F.concat(F.lit("trade"), version, F.lit("/"), "r_name", F.lit(":"), "n_name", F.lit(":"), F.col("c_custkey").cast("string"), F.lit("!order2-3"))
    return Q.resolve(_three(spark, sf_dir), u.select(F.col("c_custkey").cast("long").alias("id"), R.parse(ref).alias("r")), "1")


@query("reference_parse", "SELECT * FROM (VALUES ('m@0.1/B%3A C:1:2!clause1', 'm', '0.1', 'B: C|1|2', 'clause', 1, 1, NULL), ('B:2', NULL, NULL, 'B|2', NULL, NULL, NULL, NULL), ('m/B:1!word3-5', 'm', NULL, 'B|1', 'word', 3, 5, NULL), ('urn:tf:m@2:B%20C:4', 'm', '2', 'B C|4', NULL, NULL, NULL, NULL), ('B!word0', NULL, NULL, 'B', 'word', 0, 0, 'index below 1'), ('B!word5-2', NULL, NULL, 'B', 'word', 5, 2, 'range ends before it starts'), ('A::1', NULL, NULL, 'A||1', NULL, NULL, NULL, 'empty section'), ('B!clause', NULL, NULL, 'B', NULL, NULL, NULL, 'bad selector')) AS t(ref, corpus, version, sections, target_type, start, stop, error)")
def reference_parse(spark, sf_dir):
    """The short and the URN form, and what is wrong with bad ones."""
    refs = ["m@0.1/B%3A C:1:2!clause1", "B:2", "m/B:1!word3-5", "urn:tf:m@2:B%20C:4", "B!word0", "B!word5-2", "A::1", "B!clause"]
    r = spark.createDataFrame([(x,) for x in refs], "ref string").withColumn("r", R.parse(F.col("ref")))
    return r.select("ref", "r.corpus", "r.version", F.array_join("r.sections", "|").alias("sections"), "r.target_type", F.col("r.start").cast("int").alias("start"), F.col("r.end").cast("int").alias("stop"), "r.error")


@query("reference_forms", "SELECT c_custkey, 'trade@1/' || n_name || ':' || c_custkey || '!order2' AS short, 'urn:tf:trade@1:' || replace(n_name, ' ', '%20') || ':' || c_custkey || '!order2' AS urn, n_name || ' ' || c_custkey || ' · order 2' AS label, n_name || ' ' || c_custkey || ' or2' AS compact, 'https://example.org/r/' || replace(replace(replace(replace(replace('trade@1/' || n_name || ':' || c_custkey || '!order2', '@', '%40'), '/', '%2F'), ' ', '%20'), ':', '%3A'), '!', '%21') AS url FROM customer JOIN nation ON c_nationkey = n_nationkey")
def reference_forms(spark, sf_dir):
    """Every form of one reference."""
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    r = R.parse(F.concat(F.lit("trade@1/"), "n_name", F.lit(":"), F.col("c_custkey").cast("string"), F.lit("!order2")))
    x = c.select("c_custkey", r.alias("r"))
    s = R.short(F.col("r"))
    return x.select("c_custkey", s.alias("short"), R.urn(F.col("r")).alias("urn"), R.label(F.col("r")).alias("label"), R.compact_label(F.col("r")).alias("compact"), R.share_url(s, "https://example.org/r/{ref}").alias("url"))


@query("compact_tokens", sql("SELECT c.node, 'cotrade-x_bk' || format('{:03d}', dense_rank() OVER (ORDER BY n_regionkey)) || '_ch' || format('{:03d}', row_number() OVER (PARTITION BY c_nationkey ORDER BY c.first_slot, c.node)) AS token, row_number() OVER (PARTITION BY c_nationkey ORDER BY c.first_slot, c.node) AS second FROM co c JOIN customer u ON u.c_custkey = c.key JOIN nation ON c_nationkey = n_nationkey WHERE c.first_slot IS NOT NULL"))
def compact_tokens(spark, sf_dir):
    """Positional tokens, and their numbers read back."""
    from ..operators.structure import anchored_children, rank_nodes

    c = trade_corpus(spark, sf_dir)
    nation = anchored_children(c.of_type("nation"), c.of_type("customer")).select(F.col("c_node").alias("node"), F.col("index").alias("i"))
    top = rank_nodes(c.of_type("region")).select(F.col("node").alias("region"), "rank")
    region = anchored_children(c.of_type("region"), c.of_type("customer")).select(F.col("c_node").alias("node"), F.col("p_node").alias("region")).join(top, "region")
    x = nation.join(region, "node")
    token = R.compact_token(F.lit("trade_x"), [("bk", F.col("rank")), ("ch", F.when(F.col("i") < 1000, F.col("i")).otherwise(F.col("i")))])
    return x.select("node", token.alias("token")).withColumn("second", F.element_at(R.compact_levels(F.col("token")), 2)["first"])


@query("human_references", "SELECT c_custkey, n_name || '|' || c_custkey || '|2' AS sections FROM customer JOIN nation ON c_nationkey = n_nationkey")
def human_references(spark, sf_dir):
    """C14: Book 1:2 as people write it, names with spaces included."""
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    parts = R.human(F.concat("n_name", F.lit(" "), F.col("c_custkey").cast("string"), F.lit(":2")), 3)
    return c.select("c_custkey", F.array_join(parts, "|").alias("sections"))


def _passages(spark, sf_dir, asked):
    """id, text for the customers asked, each named by a reference to its section."""
    from ..operators.structure import node_text

    c = _three(spark, sf_dir)
    u = asked.join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    ref = F.concat("r_name", F.lit(":"), "n_name", F.lit(":"), F.col("c_custkey").cast("string"))
    found = kept(Q.resolve(c, u.select(F.col("c_custkey").cast("long").alias("id"), R.parse(ref).alias("r")), "1").where("status = 'resolved'").select("node", "id"), "found")
    texts = node_text(c, kept(c.nodes.join(found.select("node").distinct(), "node"), "passages"))
    return texts.join(found, "node").select("id", "text")


@query("passages_by_reference", sql("SELECT c_custkey AS id, string_agg(l_returnflag, ' ' ORDER BY slot) AS text FROM li GROUP BY c_custkey"))
def passages_by_reference(spark, sf_dir):
    """The text of every customer's section, by its reference."""
    return _passages(spark, sf_dir, read(spark, sf_dir, "customer"))


@query("scheme_tokens", "SELECT * FROM (VALUES ('JHN', 'code', NULL, 'JHN'), ('3', 'ordinal', NULL, '3'), ('chapter-4', 'level-ordinal', 'chapter', '4'), ('page-0', 'code', NULL, 'page-0')) AS t(token, kind, level, value)")
def scheme_tokens(spark, sf_dir):
    """The three kinds of tokens of a canonical reference."""
    t = spark.createDataFrame([(x,) for x in ("JHN", "3", "chapter-4", "page-0")], "token string").withColumn("t", R.scheme_token(F.col("token")))
    return t.select("token", "t.kind", "t.level", "t.value")
