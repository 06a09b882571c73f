"""Citations, revisions, versions and integrity findings on the driver's tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import linking as L
from ..operators import standoff
from ..operators import versions as V
from ..plans.corpus import read, trade_corpus
from . import query
from .trade import sql

_STREAM = "'In ' || c_name || ' see John ' || (c_custkey % 21 + 1) || ':' || (c_custkey % 30 + 1) || CASE WHEN c_custkey % 2 = 0 THEN '–' || (c_custkey % 30 + 3) ELSE '' END || ' and Mk. 1:' || (c_custkey % 9) || '.'"


def _streams(spark, sf_dir):
    k = F.col("c_custkey")
    text = F.concat(F.lit("In "), "c_name", F.lit(" see John "), (k % 21 + 1).cast("string"), F.lit(":"), (k % 30 + 1).cast("string"), F.when(k % 2 == 0, F.concat(F.lit("–"), (k % 30 + 3).cast("string"))).otherwise(""), F.lit(" and Mk. 1:"), (k % 9).cast("string"), F.lit("."))
    return read(spark, sf_dir, "customer").select(k.alias("id"), text.alias("text"))


@query("citation_detection", f"""WITH s AS (SELECT c_custkey AS id, {_STREAM} AS text FROM customer),
 d AS (SELECT id, text, c, v, w, strpos(text, 'John ') - 1 AS start FROM (SELECT id, text, id % 21 + 1 AS c, id % 30 + 1 AS v, CASE WHEN id % 2 = 0 THEN id % 30 + 3 ELSE id % 30 + 1 END AS w FROM s)),
 m AS (SELECT id, text, strpos(text, 'Mk. ') - 1 AS start FROM s WHERE id % 9 <> 0)
 SELECT id, start, 'John ' || c || ':' || v || CASE WHEN id % 2 = 0 THEN '–' || w ELSE '' END AS exact, c AS chapter, v AS first, w AS last, k AS work_id, k <> 'x' AS ambiguous FROM d, (SELECT unnest(['john-a', 'john-b']) AS k)
 UNION ALL SELECT id, start, 'Mk. 1:' || id % 9, 1, id % 9, id % 9, 'mark', false FROM m""")
def citation_detection(spark, sf_dir):
    """Citations with their offsets; one name stands for two works, verse 0 is none."""
    aliases = spark.createDataFrame([("John", "john-a"), ("Jn.", "john-a"), ("john", "john-b"), ("Mk", "mark")], "alias string, work_id string")
    return L.detect(_streams(spark, sf_dir), aliases, "id").select("id", "start", "exact", "chapter", "first", "last", "work_id", "ambiguous")


@query("catalog_identify", "WITH n AS (SELECT p_partkey, concat_ws(' ', p_name, p_type, p_brand, p_size) AS name FROM part) SELECT p.p_partkey AS id, name, q.p_partkey AS work_id FROM n p JOIN n q USING (name)")
def catalog_identify(spark, sf_dir):
    """Every part against the whole catalog, by full names, of which few are shared."""
    part = read(spark, sf_dir, "part").select("p_partkey", F.concat_ws(" ", "p_name", "p_type", "p_brand", F.col("p_size").cast("string")).alias("name"))
    return L.identify(part.select("name", F.col("p_partkey").alias("work_id")), part.select(F.col("p_partkey").alias("id"), "name"))


@query("resolve_status", "SELECT c_custkey AS id, coalesce(n, 0) AS n, CASE WHEN n IS NULL THEN 'unresolved' WHEN open = 0 THEN 'unavailable' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status FROM customer LEFT JOIN (SELECT o_custkey, count(*) AS n, count(*) FILTER (o_orderstatus <> 'P') AS open FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) ON o_custkey = c_custkey")
def resolve_status(spark, sf_dir):
    """Requests against their candidates (urgent orders; pending ones aren't available)."""
    c = read(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("key"), F.col("o_orderkey").alias("target"), (F.col("o_orderstatus") != "P").alias("available"))
    return L.resolution(read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("key")), c)


@query("alignment_fallback", "SELECT c_custkey AS id, coalesce(s.s_suppkey, t.s_suppkey) AS target, CASE WHEN s.s_suppkey IS NOT NULL THEN 'direct' WHEN t.s_suppkey IS NOT NULL THEN 'aligned' ELSE 'none' END AS via FROM customer LEFT JOIN supplier s ON s.s_suppkey = c_custkey LEFT JOIN supplier t ON t.s_suppkey = c_custkey - 50")
def alignment_fallback(spark, sf_dir):
    """A second chance by alignment where the edition lacks the passage."""
    s = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("key"), F.col("s_suppkey").alias("target"))
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_custkey").alias("key"))
    return standoff.aligned(c, s, c.select("key", (F.col("key") - 50).alias("aligned")))


@query("mapping_overlap", "SELECT a.event_id AS hit, b.event_id AS mapping FROM events a JOIN events b ON a.user_id = b.user_id AND a.event_id % 100 < b.event_id % 100 + 20 AND b.event_id % 100 < a.event_id % 100 + 5 WHERE a.event_type = 'purchase' AND b.event_type <> 'purchase'")
def mapping_overlap(spark, sf_dir):
    """Spans of one stream (a user's events) that overlap others, by buckets."""
    e = read(spark, sf_dir, "events").withColumn("at", F.col("event_id") % 100)
    hits = e.where("event_type = 'purchase'").select(F.col("user_id").alias("doc"), F.col("event_id").alias("hit"), F.col("at").alias("start"), (F.col("at") + 5).alias("stop"))
    maps = e.where("event_type <> 'purchase'").select(F.col("user_id").alias("doc"), F.col("event_id").alias("mapping"), F.col("at").alias("m_start"), (F.col("at") + 20).alias("m_stop"))
    return L.overlapping_mappings(hits, maps, 16).select("hit", "mapping")


@query("current_revision", "SELECT o_custkey AS reference_id, max(o_orderkey) AS version, arg_max(o_orderstatus, o_orderkey) AS status FROM orders GROUP BY 1")
def current_revision(spark, sf_dir):
    """The latest version of each reference (orders as a customer's revisions)."""
    log = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("reference_id"), F.col("o_orderkey").alias("version"), F.col("o_orderstatus").alias("status"))
    return L.current(log)


@query("apply_actions", """WITH s AS (SELECT c_custkey AS id, c_custkey % 4 AS version, CASE c_custkey % 3 WHEN 0 THEN 'pending' WHEN 1 THEN 'approved' ELSE 'rejected' END AS review, CASE WHEN c_custkey % 6 = 1 THEN 'published' ELSE 'draft' END AS publication,
  CASE c_custkey % 5 WHEN 0 THEN 'approve' WHEN 1 THEN 'publish' WHEN 2 THEN 'withdraw' WHEN 3 THEN 'reopen' ELSE 'reject' END AS action, CASE WHEN c_custkey % 10 = 7 THEN 99 ELSE c_custkey % 4 END AS expected FROM customer),
 t AS (SELECT *, CASE action WHEN 'approve' THEN review = 'pending' AND publication = 'draft' WHEN 'reject' THEN review = 'pending' AND publication = 'draft' WHEN 'publish' THEN review = 'approved' AND publication = 'draft' WHEN 'withdraw' THEN review = 'approved' AND publication = 'published' ELSE true END AS allowed,
  CASE action WHEN 'approve' THEN 'approved' WHEN 'reject' THEN 'rejected' WHEN 'reopen' THEN 'pending' ELSE review END AS r2, CASE action WHEN 'publish' THEN 'published' WHEN 'withdraw' THEN 'withdrawn' WHEN 'reopen' THEN 'draft' ELSE publication END AS p2 FROM s),
 u AS (SELECT *, CASE WHEN expected <> version THEN 'stale' WHEN NOT allowed THEN 'forbidden' WHEN r2 = review AND p2 = publication THEN 'noop' ELSE 'ok' END AS status FROM t)
 SELECT id AS reference_id, action, status, version + (status = 'ok')::INT AS version, CASE WHEN status = 'ok' THEN r2 ELSE review END AS review, CASE WHEN status = 'ok' THEN p2 ELSE publication END AS publication FROM u""")
def apply_actions(spark, sf_dir):
    """Transitions with optimistic versions."""
    k = F.col("c_custkey")
    c = read(spark, sf_dir, "customer")
    review = F.when(k % 3 == 0, "pending").when(k % 3 == 1, "approved").otherwise("rejected")
    state = c.select(k.alias("reference_id"), (k % 4).alias("version"), review.alias("review"), F.when(k % 6 == 1, "published").otherwise("draft").alias("publication"))
    action = F.when(k % 5 == 0, "approve").when(k % 5 == 1, "publish").when(k % 5 == 2, "withdraw").when(k % 5 == 3, "reopen").otherwise("reject")
    acts = c.select(k.alias("reference_id"), action.alias("action"), F.when(k % 10 == 7, 99).otherwise(k % 4).alias("expected_version"))
    return L.apply_actions(state, acts)


@query("approved_snapshot", "SELECT o_orderkey AS id, row_number() OVER (ORDER BY o_orderkey) AS place FROM orders WHERE o_orderstatus = 'P'")
def approved_snapshot(spark, sf_dir):
    """Approved references, numbered in the order of their ids."""
    from ..plans.prefix import running_sum

    ok = read(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("id"))
    return running_sum(ok, [], F.expr("id div 65536"), ["id"], F.lit(1), "n").select("id", (F.col("n") + 1).alias("place"))


@query("import_plan", "SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'create' WHEN p_partkey % 3 = 1 THEN 'unchanged' ELSE 'conflict' END AS decision FROM part")
def import_plan(spark, sf_dir):
    """Create, unchanged or conflict by digest."""
    p = read(spark, sf_dir, "part")
    new = p.select(F.col("p_partkey").alias("id"), F.sha2("p_name", 256).alias("digest"))
    old = p.where("p_partkey % 3 <> 0").select(F.col("p_partkey").alias("id"), F.sha2(F.when(F.col("p_partkey") % 3 == 1, F.col("p_name")).otherwise(F.col("p_type")), 256).alias("digest"))
    return L.import_plan(new, old)


@query("ledger_replay", "SELECT l_suppkey AS event_id, count(DISTINCT sha256(l_returnflag || '')) AS n FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_returnflag) > 1")
def ledger_replay(spark, sf_dir):
    """Ids that came back with other content."""
    e = read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("event_id"), F.sha2("l_returnflag", 256).alias("digest"))
    return L.replay_safe(e)[1]


@query("delivery_receipts", "SELECT o_orderkey AS reference_id, count(*) AS n, max(l_shipdate) AS last_at FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_returnflag = 'R' GROUP BY 1")
def delivery_receipts(spark, sf_dir):
    """Receipts summed for each delivered reference."""
    r = read(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy(F.col("l_orderkey").alias("reference_id")).agg(F.count(F.lit(1)).alias("n"), F.max("l_shipdate").alias("last_at"))
    return r.join(read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("reference_id")), "reference_id", "left_semi")


@query("archive_diff", "SELECT CAST(d.doc_id AS VARCHAR) AS path, CASE WHEN doc_id % 11 = 0 THEN 'added' WHEN doc_id % 11 = 1 THEN 'removed' ELSE 'modified' END AS change FROM documents d WHERE doc_id % 11 IN (0, 1, 2)")
def archive_diff(spark, sf_dir):
    """Full outer by path, with size and checksum."""
    d = read(spark, sf_dir, "documents")
    entry = lambda e, text: e.select(F.col("doc_id").cast("string").alias("path"), F.length(text).alias("size"), F.crc32(text).alias("crc"))
    return L.archive_diff(entry(d.where("doc_id % 11 <> 0"), F.col("text")), entry(d.where("doc_id % 11 <> 1"), F.when(F.col("doc_id") % 11 == 2, F.concat("text", F.lit("."))).otherwise(F.col("text"))))


@query("node_findings", sql("SELECT node, 'OSLOTS_EMPTY' AS code FROM nd WHERE first_slot IS NULL UNION ALL SELECT node, 'FEATURE_MISSING' FROM oo WHERE o_orderpriority = '3-MEDIUM' UNION ALL SELECT node, 'FEATURE_TYPE' FROM oo"))
def node_findings(spark, sf_dir):
    """Empty nodes, a required feature that some lack, and one of the wrong type."""
    c = trade_corpus(spark, sf_dir)
    top = c.slots.agg(F.max("slot")).first()[0]
    bad = c.node_features.where(~((F.col("feature") == "priority") & (F.col("value_str") == "3-MEDIUM")))
    return L.node_findings(c.nodes, bad, top, c.slot_type, {"order": {"priority": "str", "status": "int"}})


@query("segment_errors", "SELECT * FROM (SELECT l_orderkey AS anchor, l_linenumber AS ordinal, CASE WHEN stop > 60 THEN 'anchor:bounds' WHEN lag(stop) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) > start THEN 'anchor:overlap-or-order' END AS error FROM (SELECT DISTINCT l_orderkey, l_linenumber, l_linenumber * 8 - l_orderkey % 5 AS start, l_linenumber * 8 + l_orderkey % 5 + 1 AS stop FROM lineitem)) WHERE error IS NOT NULL")
def segment_errors(spark, sf_dir):
    """Order and bounds of segments."""
    k, n = F.col("l_orderkey"), F.col("l_linenumber")
    s = read(spark, sf_dir, "lineitem").select(k.alias("anchor"), n.alias("ordinal"), (n * 8 - k % 5).alias("start"), (n * 8 + k % 5 + 1).alias("stop"), F.lit(60).alias("size")).distinct()
    return L.segment_errors(s)


_MARKS = "m AS (SELECT user_id AS doc, event_id // 4 AS id, count(*) FILTER (event_id % 4 < 2) AS s, count(*) FILTER (event_id % 4 >= 2) AS e, min(event_id) FILTER (event_id % 4 < 2) AS start, max(event_id) FILTER (event_id % 4 >= 2) AS stop FROM events GROUP BY 1, 2)"


def _every_mark(spark, sf_dir):
    """Every event as a marker: the first two of four open a span, the other two close it."""
    k = F.col("event_id")
    return read(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.expr("event_id div 4").alias("id"), F.when(k % 4 < 2, "start").otherwise("end").alias("kind"), k.alias("place"))


@query("milestone_spans", f"WITH {_MARKS} SELECT doc, id, start, stop FROM m WHERE s = 1 AND e = 1")
def milestone_spans(spark, sf_dir):
    """Spans from markers, every event being one."""
    return L.paired_milestones(_every_mark(spark, sf_dir))[0]


@query("milestone_errors", f"WITH {_MARKS} SELECT doc, id, CASE WHEN s > 1 OR e > 1 THEN 'duplicate' WHEN e = 0 THEN 'unclosed' ELSE 'unmatched' END AS error FROM m WHERE s <> 1 OR e <> 1")
def milestone_errors(spark, sf_dir):
    """Markers without their pair, and repeated ones, every event being a marker."""
    return L.paired_milestones(_every_mark(spark, sf_dir))[1]


@query("version_label", "SELECT source AS corpus, 'v1.' || (count(*) + 1) AS next FROM documents GROUP BY source")
def version_label(spark, sf_dir):
    """The next label after v1.n, by number and not by text."""
    d = read(spark, sf_dir, "documents").select(F.col("source").alias("corpus"), F.row_number().over(Window.partitionBy("source").orderBy("doc_id")).alias("n"))
    return V.next_label(d.select("corpus", F.concat(F.lit("v1."), F.col("n").cast("string")).alias("label")))


@query("history_current", "SELECT o_custkey AS corpus, o_orderkey AS version, o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) AS current FROM orders")
def history_current(spark, sf_dir):
    """Exactly one current row in each history."""
    return V.mark_current(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("corpus"), F.col("o_orderkey").alias("version")))


@query("annotation_merge", "SELECT user_id AS node, arg_max(event_type, event_id) AS note, max(event_id) AS updated FROM events GROUP BY user_id")
def annotation_merge(spark, sf_dir):
    """The latest annotation of each node."""
    e = read(spark, sf_dir, "events").select(F.col("user_id").alias("node"), F.col("event_type").alias("note"), F.col("event_id").alias("updated"))
    return V.latest(e, ["node"], "updated")


@query("manifest_patch", "SELECT c_custkey AS id, 'title' AS key, c_name AS value FROM customer WHERE c_custkey % 2 = 1 UNION ALL SELECT c_custkey, 'title', 'renamed' FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, 'size', CAST(c_nationkey AS VARCHAR) FROM customer")
def manifest_patch(spark, sf_dir):
    """A patch of key-value rows; only the editable key is taken over."""
    c = read(spark, sf_dir, "customer")
    base = c.select(F.col("c_custkey").alias("id"), F.explode(F.map_from_arrays(F.array(F.lit("title"), F.lit("size")), F.array("c_name", F.col("c_nationkey").cast("string")))).alias("key", "value"))
    patch = c.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("id"), F.explode(F.map_from_arrays(F.array(F.lit("title"), F.lit("size")), F.array(F.lit("renamed"), F.lit("0")))).alias("key", "value"))
    return V.patch(base, patch, ["title"])


@query("edit_feature", "SELECT c_custkey AS node, CASE WHEN c_custkey % 10 = 0 THEN 'EDITED' ELSE c_mktsegment END AS value FROM customer")
def edit_feature(spark, sf_dir):
    """A new version of a feature with some values replaced."""
    c = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("node"), F.col("c_mktsegment").alias("value"))
    return V.edited(c, c.where("node % 10 = 0").select("node", F.lit("EDITED").alias("value")))


@query("wal_reconcile", "SELECT o_orderkey AS operation, CASE WHEN o_orderkey % 4 = 0 THEN 'pending' WHEN o_orderkey % 4 = 1 THEN 'undone' ELSE 'applied' END AS state FROM orders")
def wal_reconcile(spark, sf_dir):
    """Intents against receipts and later reverts."""
    o = read(spark, sf_dir, "orders")
    intents = o.select(F.col("o_orderkey").alias("operation"))
    receipts = o.where("o_orderkey % 4 <> 0").select(F.col("o_orderkey").alias("operation"))
    reverts = o.where("o_orderkey % 4 = 1").select(F.col("o_orderkey").alias("operation"))
    return V.reconcile(intents, receipts, reverts)


@query("scheme_range", "SELECT o_custkey AS scheme, count(DISTINCT o_orderpriority) AS n_targets FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i FROM orders) WHERE i BETWEEN 2 AND 5 GROUP BY 1")
def scheme_range(spark, sf_dir):
    """Distinct targets between two keys of a scheme."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    e = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("scheme"), F.col("o_orderpriority").alias("target"), F.row_number().over(w).alias("ordinal"))
    return V.scheme_range(e, 2, 5)


@query("page_acceptance", "SELECT o_custkey AS candidate, CASE WHEN bool_or(o_orderstatus = 'P') THEN 'rejected' WHEN bool_or(o_orderpriority = '5-LOW') THEN 'pending-review' ELSE 'accepted' END AS decision FROM orders GROUP BY 1")
def page_acceptance(spark, sf_dir):
    """A fatal page rejects, a soft one asks for review."""
    o = read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("candidate"), (F.col("o_orderstatus") == "P").alias("fatal"), (F.col("o_orderpriority") == "5-LOW").alias("soft"))
    return V.acceptance(o)


@query("category", "SELECT l_orderkey AS corpus, CASE WHEN count(*) FILTER (l_linestatus = 'F') > 0 AND count(*) FILTER (l_returnflag = 'R') > 0 THEN 'religious' WHEN count(*) FILTER (l_returnflag = 'R') >= 2 OR count(*) FILTER (l_returnflag = 'A') > 0 THEN 'book' ELSE 'document' END AS category FROM lineitem GROUP BY 1")
def category(spark, sf_dir):
    """A corpus's category from the roles of its units."""
    role = F.when(F.col("l_linestatus") == "F", "verse")
    other = F.when(F.col("l_returnflag") == "R", "chapter").when(F.col("l_returnflag") == "A", "book")
    u = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("corpus"), F.explode(F.array_compact(F.array(role, other, F.lit("text")))).alias("role"))
    return V.category(u)


@query("sampled_values", "SELECT p_partkey AS node, p_brand AS a, CASE WHEN p_partkey % 200 = 1 THEN 'other' ELSE p_brand END AS b FROM part WHERE (p_partkey - 1) % greatest(1, (SELECT max(p_partkey) FROM part) // 100) = 0 AND p_partkey % 200 = 1")
def sampled_values(spark, sf_dir):
    """A stride over all nodes, compared between two loads."""
    p = read(spark, sf_dir, "part")
    a, b = p.select(F.col("p_partkey").alias("node"), F.col("p_brand").alias("value")), p.select(F.col("p_partkey").alias("node"), F.when(F.col("p_partkey") % 200 == 1, "other").otherwise(F.col("p_brand")).alias("value"))
    return V.sample_mismatches(a, b, 100)


@query("owner_visibility", "SELECT o_orderkey AS job, o_custkey % 5 = 0 OR o_custkey % 5 = 3 AS visible FROM orders")
def owner_visibility(spark, sf_dir):
    """Jobs without an owner, and one's own."""
    owner = F.when(F.col("o_custkey") % 5 == 0, None).otherwise((F.col("o_custkey") % 5).cast("string"))
    return read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), V.visible(owner, F.lit("3")).alias("visible"))


@query("scope_nodes", sql("SELECT node, o_custkey AS customer FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY first_slot, last_slot DESC, node) AS i FROM oo WHERE first_slot IS NOT NULL) WHERE i BETWEEN 2 AND 4"))
def scope_nodes(spark, sf_dir):
    """The siblings from one unit to another, in document order."""
    from ..operators.structure import anchored_children

    c = trade_corpus(spark, sf_dir)
    kids = anchored_children(c.of_type("customer"), c.of_type("order")).where("index between 2 and 4")
    return kids.select(F.col("c_node").alias("node"), F.col("p_key").alias("customer"))


@query("keyset_by_time", "SELECT event_id, ts FROM events WHERE (ts, event_id) < (SELECT (ts, event_id) FROM (SELECT ts, event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 1 OFFSET 100)) ORDER BY ts DESC, event_id DESC LIMIT 51")
def keyset_by_time(spark, sf_dir):
    """A page after a (time, id) cursor, newest first."""
    e = read(spark, sf_dir, "events").select("event_id", "ts")
    cursor = e.orderBy(F.desc("ts"), F.desc("event_id")).offset(100).limit(1).first()
    return V.page_before(e, "ts", "event_id", cursor["ts"], cursor["event_id"], 50)


@query("job_listing", "SELECT event_id, place, total FROM (SELECT event_id, row_number() OVER (ORDER BY ts DESC, event_id DESC) AS place, count(*) OVER () AS total FROM events) WHERE place > 20 AND place <= 40")
def job_listing(spark, sf_dir):
    """Newest first, an offset page with the total."""
    return V.listing(read(spark, sf_dir, "events"), "ts", "event_id", 20, 20).select("event_id", "place", "total")
