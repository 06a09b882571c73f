"""Curation, ledgers and the rules of corpus documents on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import curation as C
from ..operators import document_rules as R
from ..operators import versions as V
from ..plans.corpus import read, trade_corpus
from . import query
from .trade import sql


@query("staleness", "SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 'current' WHEN 1 THEN 'stale_version' WHEN 2 THEN 'stale_content' ELSE 'unknown' END AS status FROM orders")
def staleness(spark, sf_dir):
    """What was asked against the present version and text."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("h"))
    k = F.col("id") % 4
    asked = o.select("id", F.when(k == 1, "v1.0").otherwise("v1.1").alias("version"), F.when(k == 2, F.concat("h", F.lit("!"))).when(k == 0, F.lit(None).cast("string")).otherwise(F.col("h")).alias("content_hash"))
    return C.staleness(asked, o.where("id % 4 <> 3").select("id", F.lit("1.1").alias("version"), F.col("h").alias("content_hash")))


@query("plan_errors", "SELECT o_orderkey AS operation, CASE o_orderkey % 8 WHEN 0 THEN 'no_change' WHEN 1 THEN 'displaced_value' WHEN 2 THEN 'incomplete_draft' WHEN 3 THEN 'stale' WHEN 4 THEN 'not_a_new_version' END AS error FROM orders WHERE o_orderkey % 8 < 5")
def plan_errors(spark, sf_dir):
    """Every rule that a plan breaks."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("operation"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))
    k = F.col("operation") % 8
    old = F.when(k == 1, F.lit("?")).otherwise(F.col("s"))
    new = F.when(k == 0, F.col("s")).otherwise(F.lit("X"))
    diffs = o.select("operation", F.lit("status").alias("field"), old.alias("old"), new.alias("new"))
    cells = lambda status: o.select("operation", F.explode(F.array(F.struct(F.lit("status").alias("field"), status.alias("value")), F.struct(F.lit("priority").alias("field"), F.col("p").alias("value")))).alias("x")).select("operation", "x.*")
    after = cells(F.when(k == 2, F.lit("Y")).otherwise(new))
    n = F.col("operation").cast("string")
    heads = o.select("operation", F.when(k == 3, "v2.0").otherwise("v1.0").alias("base_version"), F.lit("h").alias("asked_hash"), F.lit("1.0").alias("before_version"), F.lit("h").alias("before_hash"), n.alias("before_revision"), F.concat(n, F.lit("a")).alias("before_digest"), F.when(k == 4, "v1.0").otherwise("1.1").alias("after_version"), F.concat(n, F.lit("r")).alias("after_revision"), F.concat(n, F.lit("b")).alias("after_digest"))
    return C.plan_errors(diffs, cells(F.col("s")), after, heads)


def _log(spark, sf_dir):
    """Each order as a change of its customer's value: from the one before it, but every seventh names a wrong old value."""
    from pyspark.sql import Window

    o = read(spark, sf_dir, "orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    before = F.coalesce(F.last(F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderkey")), True).over(w.rowsBetween(Window.unboundedPreceding, -1)).cast("string"), F.lit("start"))
    return o.select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("node"), F.when(F.col("o_orderkey") % 7 == 0, "?").otherwise(before).alias("old"), F.col("o_orderkey").cast("string").alias("new"))


def _cells(spark, sf_dir):
    return read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.lit("start").alias("value"))


@query("wal_apply", "SELECT c_custkey AS node, coalesce(CAST(max(o_orderkey) FILTER (o_orderkey % 7 <> 0) AS VARCHAR), 'start') AS value FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def wal_apply(spark, sf_dir):
    """A log applied in order; changes with another old value conflict."""
    return C.applied(_cells(spark, sf_dir), _log(spark, sf_dir))[0]


@query("wal_outcomes", "SELECT o_orderkey AS seq, o_custkey AS node, CASE WHEN o_orderkey % 7 = 0 THEN 'conflict' ELSE 'applied' END AS state FROM orders JOIN customer ON o_custkey = c_custkey")
def wal_outcomes(spark, sf_dir):
    """What became of each change."""
    return C.applied(_cells(spark, sf_dir), _log(spark, sf_dir))[1]


@query("wal_undo", "WITH a AS (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS k FROM orders WHERE o_orderkey % 7 <> 0) SELECT c_custkey AS node, coalesce(CAST(o_orderkey AS VARCHAR), 'start') AS value FROM customer LEFT JOIN a ON o_custkey = c_custkey AND k = 2")
def wal_undo(spark, sf_dir):
    """Each customer's last change that applied, taken back."""
    log = _log(spark, sf_dir)
    last = log.where("seq % 7 <> 0").groupBy("node").agg(F.max("seq").alias("seq"))
    back = C.undo(log, last.select("seq"), 1 << 40).drop("reverts")
    return C.applied(_cells(spark, sf_dir), log.unionByName(back))[0]


@query("scope_rules", sql("SELECT o.node AS id, CASE WHEN o.key % 5 = 0 THEN 'another type' WHEN o.key % 5 = 1 THEN 'not the outermost section' WHEN o.key % 5 = 2 THEN 'word scope needs a slot' WHEN o.key % 5 = 3 THEN 'only passages have ranges' END AS error FROM oo o WHERE o.key % 5 < 4"))
def scope_rules(spark, sf_dir):
    """Scopes that select nothing lawful, by the first rule they break."""
    c = trade_corpus(spark, sf_dir)
    k = F.col("key") % 5
    s = c.of_type("order").select(F.col("node").alias("id"), "corpus", F.when(k == 1, "document").when(k == 2, "word").otherwise("section").alias("level"), "node", F.when(k == 0, "customer").alias("node_type"), F.when(k == 3, F.col("node")).alias("start"), F.when(k == 3, F.col("node")).alias("end"))
    return C.scope_errors(c, s)


@query("scope_hashes", sql("SELECT customer AS id, 'sha256:' || sha256(string_agg(l_returnflag || ' ', '' ORDER BY slot)) AS content_hash FROM (SELECT o_orderkey AS k, o_custkey AS customer FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY first_slot, last_slot DESC, node) AS i, count(*) OVER (PARTITION BY o_custkey) AS n FROM oo WHERE first_slot IS NOT NULL) WHERE i BETWEEN 2 AND 3 AND n >= 3) JOIN li ON li.o_orderkey = k GROUP BY customer"))
def scope_hashes(spark, sf_dir):
    """The second to third order of each customer as a passage, and the hash of its text."""
    c = trade_corpus(spark, sf_dir)
    units = C.enclosing_units(c, spark.createDataFrame([("order",)], "otype string"))
    at = lambda i, name: units.where(F.col("place") == i).select("section", F.col("node").alias(name))
    s = at(2, "start").join(at(3, "end"), "section").join(c.of_type("customer").select(F.col("node").alias("section"), F.col("key").alias("id")), "section")
    scopes = s.select("id", F.lit("trade").alias("corpus"), F.lit("passage").alias("level"), F.col("start").alias("node"), F.lit(None).cast("string").alias("node_type"), "start", "end")
    return C.scope_hash(c, C.scope_nodes(c, scopes))


@query("entitlements", "SELECT c_custkey AS user, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS item, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS version FROM customer WHERE c_custkey % 2 = 0 OR c_custkey % 3 <> 0 UNION ALL SELECT c_custkey, 'old', 1 FROM customer WHERE c_custkey % 2 = 1 AND c_custkey % 3 = 0")
def entitlements(spark, sf_dir):
    """Sets replaced as a whole, where the version is the expected one."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user"))
    now = c.select("user", F.lit("old").alias("item"), F.lit(1).alias("version"))
    new = c.where("user % 3 = 0").select("user", F.array(F.lit("new")).alias("items"), F.lit(2).alias("version"), F.when(F.col("user") % 2 == 0, 1).otherwise(7).alias("expected"))
    return C.replaced(now, new)


@query("timeline", "SELECT c_custkey AS corpus, 'v1.0' AS label, 'Converted' AS title, '2001' AS at, true AS current FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders) UNION ALL SELECT o_custkey, 'v1.' || (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1), o_orderstatus, CAST(o_orderkey AS VARCHAR), o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) FROM orders")
def timeline(spark, sf_dir):
    """The recorded history, or one row from the manifest."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = read(spark, sf_dir, "orders")
    h = o.select(F.col("o_custkey").alias("corpus"), F.concat(F.lit("v1."), (F.row_number().over(w) - 1).cast("string")).alias("label"), F.col("o_orderstatus").alias("title"), F.col("o_orderkey").cast("string").alias("at"), (F.col("o_orderkey") == F.max("o_orderkey").over(Window.partitionBy("o_custkey"))).alias("current"))
    m = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("corpus"), F.lit("v1.0").alias("version"), F.lit("2001").alias("written_date"))
    return C.timeline(h, m)


@query("restored_history", "SELECT label, current FROM (SELECT 'v1.' || (row_number() OVER (ORDER BY o_orderkey) - 1) AS label, false AS current FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders)) UNION ALL SELECT 'v1.' || count(*), true FROM orders WHERE o_custkey = (SELECT min(o_custkey) FROM orders)")
def restored_history(spark, sf_dir):
    """An earlier version restored on top of the history of the first customer that has one."""
    h = timeline(spark, sf_dir).join(read(spark, sf_dir, "orders").agg(F.min("o_custkey").alias("corpus")), "corpus")
    first = h.first()["corpus"]
    return C.restored(h.withColumn("corpus", F.col("corpus").cast("string")), str(first), "v1.0", "now").select("label", "current")


@query("discoveries", "SELECT o_custkey AS id, CASE WHEN count(*) = 1 THEN 'found' WHEN count(*) = 2 THEN 'identified' ELSE 'selected' END AS state, CASE WHEN count(*) >= 2 THEN 'w' END AS work, CAST(least(count(*), 3) AS INT) AS n, CAST(greatest(count(*) - 3, 0) AS INT) AS refused FROM orders GROUP BY 1")
def discoveries(spark, sf_dir):
    """A customer's orders as events of a discovery, each sent twice; further selections are refused."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = read(spark, sf_dir, "orders").withColumn("i", F.row_number().over(w))
    action = F.when(F.col("i") == 1, "register").when(F.col("i") == 2, "identify").otherwise("select")
    e = o.select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("id"), F.col("i").alias("seq"), action.alias("action"), F.when(F.col("i") == 2, "w").alias("work"))
    return C.discoveries(e.unionByName(e))


@query("ledger_states", "WITH e AS (SELECT o_custkey, least(count(*), 5) AS n FROM orders GROUP BY 1) SELECT o_custkey AS reference_id, CAST(n AS BIGINT) AS version, CASE WHEN n % 2 = 1 THEN 'published' ELSE 'withdrawn' END AS publication FROM e")
def ledger_states(spark, sf_dir):
    """Publications and withdrawals in turn, events sent twice; from the sixth on the expected version is wrong."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = read(spark, sf_dir, "orders").withColumn("i", F.row_number().over(w).cast("long"))
    e = o.select(F.col("o_orderkey").alias("event_id"), F.col("o_custkey").alias("reference_id"), F.col("i").alias("seq"), F.when(F.col("i") <= 5, F.col("i") - 1).otherwise(0).alias("expected_version"), F.when(F.col("i") % 2 == 1, "publish").otherwise("withdraw").alias("kind"))
    return C.ledger(e.unionByName(e))


@query("own_drafts", "SELECT o_orderkey AS id, CAST((SELECT count(*) FROM orders WHERE o_orderpriority = '1-URGENT') AS INT) AS total FROM orders WHERE o_orderpriority = '1-URGENT' ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10 OFFSET 5")
def own_drafts(spark, sf_dir):
    """A page of an owner's drafts, the latest first."""
    d = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("owner"), F.col("o_orderdate").alias("updated_at"))
    return C.drafts(d, "1-URGENT", 5, 10).select("id", "total")


# --- versions ---------------------------------------------------------------------------------------------
@query("scheme_targets", "WITH e AS (SELECT o_custkey, o_orderpriority AS t, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders), f AS (SELECT o_custkey, t, min(i) AS i FROM e WHERE i BETWEEN 2 AND 5 AND o_custkey IN (SELECT o_custkey FROM e WHERE i = 5) GROUP BY ALL) SELECT c_custkey AS id, string_agg(t, ',' ORDER BY i) AS targets FROM customer LEFT JOIN f ON o_custkey = c_custkey GROUP BY c_custkey")
def scheme_targets(spark, sf_dir):
    """The targets from the second key to the fifth, in order; none where a key is missing."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    e = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scheme"), F.row_number().over(w).alias("ordinal"), F.col("o_orderpriority").alias("target")).withColumn("key", F.concat(F.lit("k"), F.col("ordinal").cast("string")))
    asked = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("scheme"), F.lit("k2").alias("start_key"), F.lit("k5").alias("end_key"))
    return V.scheme_targets(e, asked).select("id", F.array_join("targets", ",").alias("targets"))


@query("page_decisions", "WITH p AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS page, o_orderstatus AS s, o_orderpriority AS p FROM orders) SELECT o_custkey AS candidate, CASE WHEN bool_or(s = 'P') OR count(*) <> 3 THEN 'rejected' WHEN bool_or(p = '5-LOW') THEN 'pending-review' ELSE 'accepted' END AS decision FROM p GROUP BY 1")
def page_decisions(spark, sf_dir):
    """Documents of three pages: unreadable, missing and surplus pages reject, unverified ones ask for review."""
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    o = read(spark, sf_dir, "orders")
    content = F.when(F.col("o_orderstatus") == "P", "unreadable").when(F.col("o_orderpriority") == "5-LOW", "unverified").otherwise("satisfactory")
    p = o.select(F.col("o_custkey").alias("candidate"), (F.row_number().over(w) - 1).alias("page"), content.alias("content"), F.lit("verified").alias("reading_order"), F.lit("seen").alias("evidence"))
    return V.page_decisions(p, 3)


@query("section_roles", "SELECT p_partkey, CASE p_size % 6 WHEN 0 THEN 'verse' WHEN 1 THEN 'chapter' WHEN 2 THEN 'book' WHEN 3 THEN 'chapter' WHEN 4 THEN 'chapter' END AS role FROM part")
def section_roles(spark, sf_dir):
    """Roles by type, attribute and heading level."""
    k = F.col("p_size") % 6
    kind = F.when(k == 0, "Verse").when(k.isin(1, 2, 3), "div").when(k == 4, "section").otherwise("p")
    attribute = F.when(k == 1, "chapter").when(k == 2, "BOOK").when(k == 3, "surah")
    return read(spark, sf_dir, "part").select("p_partkey", V.section_role(kind, attribute, F.when(k == 4, "1").otherwise("2")).alias("role"))


@query("settled_categories", "SELECT p_partkey AS corpus, CASE WHEN p_size % 4 = 3 THEN ['document', 'book', 'book'][1 + p_partkey % 3] ELSE ['document', 'book', 'book'][1 + least(p_partkey % 3, p_size % 4)] END AS category, p_size % 4 <> 3 AND p_size % 4 > least(p_partkey % 3, 1) AS warning FROM part")
def settled_categories(spark, sf_dir):
    """Requests for more structure than there is are lowered, under a ceiling of books."""
    names = F.array(*[F.lit(x) for x in V.CATEGORIES])
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("corpus"), F.element_at(names, (F.col("p_partkey") % 3 + 1).cast("int")).alias("detected"), F.when(F.col("p_size") % 4 < 3, F.element_at(names, (F.least(F.col("p_size") % 4, F.lit(2)) + 1).cast("int"))).alias("requested"))
    return V.settled_category(p, "book")


# --- corpus documents --------------------------------------------------------------------------------------
def _document(spark, sf_dir):
    """The order hierarchy as the tables of a corpus document, with faults by key."""
    c, o = read(spark, sf_dir, "customer"), read(spark, sf_dir, "orders")
    ck, ok = F.col("c_custkey"), F.col("o_orderkey")
    s = lambda p, k: F.concat(F.lit(p), k.cast("string"))
    records = c.select(F.lit("works").alias("table"), s("w", ck).alias("id")).unionByName(c.where("c_custkey % 50 = 0").select(F.lit("works").alias("table"), s("w", ck).alias("id")))
    links = o.select(s("r", ok).alias("source"), F.when(ok % 40 == 0, F.lit("gone")).otherwise(s("w", F.col("o_custkey"))).alias("target"), F.lit("works").alias("kind"))
    revisions = o.select(s("r", ok).alias("id"), s("w", F.col("o_custkey")).alias("edition"), F.when(ok % 30 == 0, F.lit(0)).otherwise(ok).cast("long").alias("sequence"), F.when(ok % 20 == 0, s("r", ok)).alias("previous"))
    streams = o.select(s("s", ok).alias("id"), s("r", ok).alias("revision"), F.lit(1).alias("ord"), F.col("o_orderpriority").alias("text"))
    anchors = o.select(s("a", ok).alias("id"), s("r", F.when(ok % 25 == 0, ok + 1).otherwise(ok)).alias("revision"))
    segments = o.select(s("a", ok).alias("anchor"), F.explode(F.array(F.struct(F.lit(1).alias("ordinal"), F.lit(0).alias("start"), F.lit(3).alias("stop")), F.struct(F.lit(2).alias("ordinal"), F.when(ok % 10 == 0, 2).otherwise(3).alias("start"), F.when(ok % 15 == 0, 99).otherwise(5).alias("stop")))).alias("x"), s("s", ok).alias("stream")).select("anchor", "x.*", "stream")
    return {"records": records, "links": links, "revisions": revisions, "streams": streams, "anchors": anchors, "segments": segments}


@query("document_violations", """
SELECT 'w' || c_custkey AS subject, 'identity:duplicate' AS code FROM customer WHERE c_custkey % 50 = 0
UNION ALL SELECT 'r' || o_orderkey, 'link:works' FROM orders WHERE o_orderkey % 40 = 0
UNION ALL SELECT min('r' || o_orderkey), 'revision:duplicate-sequence' FROM orders WHERE o_orderkey % 30 = 0 GROUP BY o_custkey HAVING count(*) > 1
UNION ALL SELECT 'r' || o_orderkey, 'revision:invalid-predecessor' FROM orders WHERE o_orderkey % 20 = 0
UNION ALL SELECT 'a' || o_orderkey, 'anchor:revision' FROM orders, (SELECT unnest([1, 2])) WHERE o_orderkey % 25 = 0
UNION ALL SELECT 'a' || o_orderkey, 'anchor:bounds' FROM orders WHERE o_orderkey % 15 = 0
UNION ALL SELECT 'a' || o_orderkey, 'anchor:overlap-or-order' FROM orders WHERE o_orderkey % 10 = 0""")
def document_violations(spark, sf_dir):
    """Identities, links, revisions, streams and anchors of a corpus document."""
    return R.violations(_document(spark, sf_dir), "bundle", list(R.CAPABILITIES))


@query("scheme_violations", """
SELECT 's' || c_custkey AS subject, 'scheme:scope' AS code FROM customer WHERE c_custkey % 10 = 0
UNION ALL SELECT 's' || c_custkey, 'scheme:duplicate-key-or-order' FROM customer WHERE c_custkey % 7 = 0
UNION ALL SELECT 'q' || c_custkey, 'resolution:availability' FROM customer WHERE c_custkey % 4 = 3
UNION ALL SELECT 'q' || c_custkey, 'resolution:missing-reason' FROM customer WHERE c_custkey % 4 = 3
UNION ALL SELECT 'q' || c_custkey, 'resolution:targets' FROM customer WHERE c_custkey % 4 = 1
UNION ALL SELECT 'q' || c_custkey, 'resolution:resolvable' FROM customer WHERE c_custkey % 4 = 2""")
def scheme_violations(spark, sf_dir):
    """Citation schemes and resolutions."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"))
    s = lambda p: F.concat(F.lit(p), F.col("k").cast("string"))
    k = F.col("k")
    editions = c.select(s("e").alias("id"), s("w").alias("work"))
    revisions = c.select(s("r").alias("id"), s("e").alias("edition"), F.lit(1).alias("sequence"), F.lit(None).cast("string").alias("previous"))
    nodes = c.select(F.explode(F.array(s("n"), s("m"))).alias("id"), s("r").alias("revision"))
    schemes = c.select(s("s").alias("id"), s("r").alias("revision"), s("e").alias("edition"), F.when(k % 10 == 0, "other").otherwise(s("w")).alias("work"), F.lit("1").alias("version"))
    entry = lambda key, ord_, t: F.struct(F.lit(key).alias("key"), F.lit(ord_).alias("ord"), F.array(t).alias("targets"))
    entries = c.select(s("s").alias("scheme"), F.explode(F.array(entry("a", 1, s("n")), entry("b", 2, s("m")))).alias("x")).select("scheme", "x.*")
    entries = entries.unionByName(c.where("k % 7 = 0").select(s("s").alias("scheme"), F.lit("z").alias("key"), F.lit(2).alias("ord"), F.array(s("m")).alias("targets")))
    none = F.array().cast("array<string>")
    targets = F.when(k % 4 == 0, F.array(s("n"), s("m"))).when(k % 4 == 1, F.array(s("m"), s("n"))).otherwise(none)
    resolutions = c.select(s("q").alias("id"), s("s").alias("scheme"), s("e").alias("edition"), s("r").alias("revision"), F.lit("1").alias("version"), F.lit("a").alias("start_key"), F.lit("b").alias("end_key"),
        F.when(k % 4 < 2, "resolved").when(k % 4 == 2, "unresolved").otherwise("unavailable").alias("status"), targets.alias("targets"), F.array().cast("array<array<string>>").alias("candidates"), F.when(k % 4 == 2, "none").alias("reason"))
    return R.violations({"editions": editions, "revisions": revisions, "nodes": nodes, "schemes": schemes, "entries": entries, "resolutions": resolutions}, "bundle", [])
