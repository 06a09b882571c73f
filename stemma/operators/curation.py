"""Scopes, stale checks, change plans, their application and undoing, drafts and entitlements."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.corpus import Corpus, canonical_order
from ..plans.tables import cut
from .structure import embedding_pairs

LEVELS = ("word", "passage", "section", "document", "corpus")
_NAME = r"^[A-Za-z_][A-Za-z0-9_]*$"


def _plain(version: Column) -> Column:
    return F.regexp_replace(version, "^v", "")


def staleness(asked: DataFrame, now: DataFrame) -> DataFrame:
    """id, status of what was asked (id, version, content_hash, which may be null) against the present (id, version,
    content_hash): unknown, stale_version (a leading v doesn't count), stale_content or current. L20."""
    both = asked.join(now.select("id", F.col("version").alias("v2"), F.col("content_hash").alias("h2")), "id", "left")
    status = F.when(F.col("v2").isNull(), "unknown").when(_plain(F.col("version")) != _plain(F.col("v2")), "stale_version").when(F.col("content_hash") != F.col("h2"), "stale_content").otherwise("current")
    return both.select("id", status.alias("status"))


def plan_errors(diffs: DataFrame, before: DataFrame, after: DataFrame, heads: DataFrame) -> DataFrame:
    """operation, error: each rule that a plan of changes breaks. diffs (operation, field, old, new); before and after
    (operation, field, value); heads (operation, base_version, asked_hash, before_version, before_hash, before_revision,
    before_digest, after_version, after_revision, after_digest). L21."""
    twice = diffs.groupBy("operation", "field").agg(F.count(F.lit(1)).alias("n")).where("n > 1 or field is null or field = ''").select("operation", F.lit("field_not_once").alias("error"))
    idle = diffs.where(F.col("old").eqNullSafe(F.col("new"))).select("operation", F.lit("no_change").alias("error"))
    was = before.select("operation", "field", F.col("value").alias("was"), F.lit(True).alias("there"))
    displaced = diffs.join(was, ["operation", "field"], "left").where(F.col("there").isNull() | ~F.col("old").eqNullSafe(F.col("was"))).select("operation", F.lit("displaced_value").alias("error"))
    want = was.join(diffs.select("operation", "field", "new", F.lit(True).alias("set")), ["operation", "field"], "full_outer").select("operation", "field", F.when(F.col("set"), F.col("new")).otherwise(F.col("was")).alias("want"), F.lit(True).alias("asked"))
    got = after.select("operation", "field", "value", F.lit(True).alias("have"))
    other = want.join(got, ["operation", "field"], "full_outer").where(F.col("asked").isNull() | F.col("have").isNull() | ~F.col("want").eqNullSafe(F.col("value"))).select("operation", F.lit("incomplete_draft").alias("error"))
    stale = (_plain(F.col("base_version")) != _plain(F.col("before_version"))) | (F.col("asked_hash") != F.col("before_hash"))
    same = (F.col("before_revision") == F.col("after_revision")) | (F.col("before_digest") == F.col("after_digest")) | (_plain(F.col("before_version")) == _plain(F.col("after_version")))
    head = heads.select("operation", F.explode(F.array_compact(F.array(F.when(stale, "stale"), F.when(same, "not_a_new_version")))).alias("error"))
    return twice.unionByName(idle).unionByName(displaced).unionByName(other).unionByName(head).distinct()


def applied(feature: DataFrame, log: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(feature, outcomes) of a log of changes (seq, node, old, new) to a feature (node, value): a change applies where the
    value before it, after all earlier ones of the node that applied, is its old one; others conflict. outcomes: seq, node,
    state. A node's changes are folded in order, in one pass. L22."""
    steps = F.array_sort(F.collect_list(F.struct("seq", "old", "new"))).alias("steps")
    both = log.groupBy("node").agg(steps).join(feature, "node", "full_outer")
    start = F.struct(F.col("value").alias("value"), F.array().cast("array<struct<seq:bigint,ok:boolean>>").alias("done"))

    def step(a, x):
        ok = a["value"].eqNullSafe(x["old"])
        return F.struct(F.when(ok, x["new"]).otherwise(a["value"]).alias("value"), F.array_append(a["done"], F.struct(x["seq"].cast("long").alias("seq"), ok.alias("ok"))).alias("done"))

    folded = both.select("node", F.when(F.col("steps").isNull(), start).otherwise(F.aggregate("steps", start, step)).alias("r"))
    out = folded.select("node", "r.value")
    state = F.when(F.col("x.ok"), "applied").otherwise("conflict")
    return out, folded.select("node", F.explode("r.done").alias("x")).select("x.seq", "node", state.alias("state"))


def undo(log: DataFrame, operations: DataFrame, first_seq: int) -> DataFrame:
    """Changes that take back the operations asked: old and new exchanged, the latest first, numbered from first_seq. They
    go through `applied` like all others, so that later edits of the same node make them conflict. L22."""
    back = log.join(operations.select("seq"), "seq", "left_semi")
    place = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("seq")))
    return back.select((F.lit(first_seq) + place - 1).cast("long").alias("seq"), "node", F.col("new").alias("old"), F.col("old").alias("new"), F.col("seq").alias("reverts"))


def not_editable(fields: DataFrame, known: list[str], formats: list[str]) -> DataFrame:
    """field, reason of those that may not be edited: not a name, reserved, shown by a text format, or unknown. P14."""
    shown = sorted({w for f in formats for part in re.findall(r"\{([^}]+)\}", f) for w in re.findall(r"[A-Za-z_]\w*", part)})
    reason = F.when(~F.col("field").rlike(_NAME), "not_a_name").when(F.col("field").isin("otype", "oslots", "otext"), "reserved").when(F.col("field").isin(shown), "rendered").when(~F.col("field").isin(known), "unknown")
    return fields.select("field", reason.alias("reason")).where("reason is not null")


def scope_errors(corpus: Corpus, scopes: DataFrame) -> DataFrame:
    """id, error of scopes (id, corpus, level, node, node_type, start, end) that select nothing lawful: the first rule broken. P13."""
    kinds = corpus.nodes.select("node", "otype")
    top = corpus.slots.agg(F.max("slot")).first()[0] or 0
    of = lambda c, a: kinds.select(F.col("node").alias(c), F.col("otype").alias(a))
    s = scopes.join(of("node", "t"), "node", "left").join(of("start", "ts"), "start", "left").join(of("end", "te"), "end", "left")
    ranged = F.col("start").isNotNull() | F.col("end").isNotNull()
    level, sections = F.col("level"), corpus.section_types
    error = (
        F.when(~level.isin(*LEVELS), "unknown level")
        .when((level == "corpus") & (F.col("node").isNotNull() | ranged | F.col("node_type").isNotNull()), "corpus scope with a node")
        .when(level == "corpus", F.lit(None).cast("string"))
        .when(F.col("t").isNull(), "unknown node")
        .when(F.col("node_type").isNotNull() & (F.col("node_type") != F.col("t")), "another type")
        .when((level == "word") & (F.col("node") > top), "word scope needs a slot")
        .when((level != "word") & (F.col("node") <= top), "structural scope needs a node")
        .when((level == "section") & ~F.col("t").isin(sections), "not a section")
        .when((level == "document") & (F.col("t") != F.lit(sections[0] if sections else "")), "not the outermost section")
        .when(ranged & (level != "passage"), "only passages have ranges")
        .when(ranged & (F.col("ts").isNull() | F.col("te").isNull() | (F.col("ts") != F.col("te")) | (F.col("start") <= top) | (F.col("end") <= top)), "endpoints of one structural type")
    )
    s = cut(s.withColumn("error", error))
    asked = s.where("error is null and level = 'passage' and start is not null").select("id", "node", "start", "end", F.col("ts").alias("unit"))
    homes = enclosing_units(corpus, asked.select(F.col("unit").alias("otype")).distinct())
    home = lambda c, a: homes.select(F.col("node").alias(c), F.col("section").alias(a), F.col("place").alias(f"{a}_place"))
    r = asked.join(home("start", "p1"), "start", "left").join(home("end", "p2"), "end", "left")
    spans = corpus.nodes.select("node", "first_slot", "last_slot")
    r = r.join(spans.toDF("start", "f1", "l1"), "start").join(spans.toDF("end", "f2", "l2"), "end").join(spans.toDF("node", "f0", "l0"), "node")
    inside = (F.col("f0") <= F.least("f1", "f2")) & (F.col("l0") >= F.greatest("l1", "l2"))
    e2 = F.when(F.col("p1").isNull() | F.col("p2").isNull(), "no enclosing section").when(F.col("p1") != F.col("p2"), "crosses a section").when(F.col("p2_place") < F.col("p1_place"), "reversed").when((F.col("node") != F.col("start")) & ~inside, "anchor doesn't hold the range")
    return cut(s.select("id", "error").where("error is not null").unionByName(r.select("id", e2.alias("error")).where("error is not null")))


def enclosing_units(corpus: Corpus, types: DataFrame) -> DataFrame:
    """node, section, place: for nodes of the types (otype), their innermost section of another type, and their place there."""
    nodes = corpus.nodes.join(types, "otype", "left_semi").where("first_slot is not null")
    sections = corpus.nodes.where(F.col("otype").isin(corpus.section_types))
    depth = F.array_position(F.array(*[F.lit(t) for t in corpus.section_types]), F.col("p_otype"))
    pairs = embedding_pairs(sections, nodes).where("p_otype <> c_otype")
    best = pairs.groupBy("c_node").agg(F.max_by(F.struct("p_node", "c_first_slot", "c_last_slot", "c_otype"), depth).alias("x"))
    order = Window.partitionBy("x.p_node", "x.c_otype").orderBy("x.c_first_slot", F.desc("x.c_last_slot"), "c_node")
    return cut(best.select(F.col("c_node").alias("node"), F.col("x.p_node").alias("section"), F.row_number().over(order).alias("place")))


def scope_nodes(corpus: Corpus, scopes: DataFrame) -> DataFrame:
    """id, node: all nodes that lawful scopes select: the node or the siblings from start to end, and what lies in them; for
    a corpus scope all nodes. P13."""
    scopes = cut(scopes)
    good = cut(scopes.join(scope_errors(corpus, scopes).select("id"), "id", "left_anti"))
    whole = good.where("level = 'corpus'").select("id", "corpus").join(corpus.nodes.select("corpus", "node"), "corpus").select("id", "node")
    ranged = good.where("level = 'passage' and start is not null")
    units = enclosing_units(corpus, corpus.nodes.join(ranged.select(F.col("start").alias("node")), "node", "left_semi").select("otype").distinct())
    types = corpus.nodes.select("node", "otype")
    units = cut(units.join(types, "node"))
    a = ranged.select("id", "start", "end").join(units.select(F.col("node").alias("start"), "section", "otype", F.col("place").alias("lo")), "start").join(units.select(F.col("node").alias("end"), F.col("place").alias("hi")), "end")
    siblings = a.select("id", "section", "otype", "lo", "hi").join(units, ["section", "otype"]).where("place between lo and hi").select("id", "node")
    roots = cut(good.where("node is not null and (start is null or level <> 'passage')").select("id", "node").unionByName(siblings))
    tops = corpus.nodes.where(F.col("otype") != corpus.slot_type).join(roots, "node")
    inner = embedding_pairs(tops, corpus.nodes.withColumn("id", F.lit(None).cast(dict(roots.dtypes)["id"]))).where("p_otype <> c_otype or p_node <> c_node").select(F.col("p_id").alias("id"), F.col("c_node").alias("node"))
    return roots.unionByName(inner).distinct().unionByName(whole)


def scope_hash(corpus: Corpus, chosen: DataFrame) -> DataFrame:
    """id, content_hash: sha256 of the text of each scope's slots (id, node), each once, in order, nothing trimmed. A12."""
    words = chosen.select("id", F.col("node").alias("slot")).distinct().join(corpus.slots.select("slot", "text", "after"), "slot")
    parts = words.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("slot", F.concat("text", F.coalesce("after", F.lit(""))).alias("t")))).alias("p"))
    return parts.select("id", F.concat(F.lit("sha256:"), F.sha2(F.array_join(F.transform("p", lambda x: x["t"]), ""), 256)).alias("content_hash"))


def untouched_hash(corpus: Corpus, fields: list[str], node: int) -> DataFrame:
    """hash: one number over all features and edges but the edited cells (the fields of one node), whatever the order of rows.
    Digests of rows add up, so no task holds them all. A13."""
    rows = corpus.node_features.where(~(F.col("feature").isin(fields) & (F.col("node") == node))).select(F.lit("node").alias("k"), "feature", "node", F.coalesce("value_str", F.col("value_int").cast("string")).alias("v"))
    edges = corpus.edge_features.select(F.lit("edge").alias("k"), "feature", F.col("src").alias("node"), F.to_json(F.struct("dst", "value")).alias("v"))
    h = lambda i: F.conv(F.substring(F.sha2(F.to_json(F.struct("k", "feature", "node", "v")), 256), 1 + 12 * i, 12), 16, 10).cast("decimal(38,0)")
    sums = rows.unionByName(edges).agg(*[F.coalesce(F.sum(h(i)), F.lit(0)).alias(f"s{i}") for i in range(4)], F.count(F.lit(1)).alias("n"))
    return sums.select(F.sha2(F.concat_ws(",", *[F.col(c).cast("string") for c in sums.columns]), 256).alias("hash"))


def drafts(rows: DataFrame, owner: str, offset: int, limit: int) -> DataFrame:
    """A page of an owner's drafts (id, owner, updated_at, ...), the latest first, with total. R11."""
    own = rows.where(F.col("owner") == owner)
    page = own.orderBy(F.desc("updated_at"), F.desc("id")).offset(offset).limit(max(1, min(limit, 100)))
    return page.withColumn("total", F.lit(own.count()))


def replaced(current: DataFrame, snapshots: DataFrame) -> DataFrame:
    """current (user, item, version) where each user of snapshots (user, items, version, expected) has exactly the snapshot's
    items; a user whose version isn't the expected one keeps what was there. L12."""
    have = current.groupBy("user").agg(F.max("version").alias("have"))
    fresh = snapshots.join(have, "user", "left").where(F.col("expected").eqNullSafe(F.col("have")))
    kept = current.join(fresh.select("user"), "user", "left_anti")
    return kept.unionByName(fresh.select("user", F.explode("items").alias("item"), "version").distinct())


def timeline(history: DataFrame, manifests: DataFrame) -> DataFrame:
    """corpus, label, title, at, current: the recorded history; for a corpus without one, one row from its manifest. L25."""
    none = manifests.join(history.select("corpus").distinct(), "corpus", "left_anti")
    made = none.select("corpus", F.coalesce("version", F.lit("v1.0")).alias("label"), F.lit("Converted").alias("title"), F.col("written_date").alias("at"), F.lit(True).alias("current"))
    return history.select("corpus", "label", "title", "at", "current").unionByName(made)


def restored(history: DataFrame, corpus: str, label: str, at: str) -> DataFrame:
    """history with a row that restores an earlier label: nothing is rewound, the new version is the current one. L28."""
    own = history.where(F.col("corpus") == corpus)
    if own.where(F.col("label") == label).isEmpty():
        raise ValueError(f"{label} is no version of {corpus}")
    n = F.nullif(F.regexp_extract("label", r"^v1\.(\d+)$", 1), F.lit("")).cast("long")
    row = own.agg(F.concat(F.lit("v1."), (F.coalesce(F.max(n), F.lit(-1)) + 1).cast("string")).alias("label")).select(F.lit(corpus).alias("corpus"), "label", F.lit(f"Restored {label}").alias("title"), F.lit(at).alias("at"), F.lit(True).alias("current"))
    return history.withColumn("current", F.when(F.col("corpus") == corpus, F.lit(False)).otherwise(F.col("current"))).unionByName(row)


#: action of a discovery -> (states it is allowed in, state after it).
DISCOVERY = {"identify": (("found", "identified"), "identified"), "select": (("identified",), "selected"), "reject": (("found", "identified", "selected"), "rejected"), "refresh": (("found", "identified", "selected", "rejected"), "found")}


def discoveries(log: DataFrame) -> DataFrame:
    """id, state, work, n, refused: what a log of events (event_id, id, seq, action, work) makes of each discovery. An event
    id counts once; an action that its state doesn't allow is refused and changes nothing. L10."""
    once = log.groupBy("event_id", "id").agg(F.min(F.struct("seq", "action", "work")).alias("e"))
    steps = once.groupBy("id").agg(F.array_sort(F.collect_list("e")).alias("steps"))
    start = F.struct(F.lit(None).cast("string").alias("state"), F.lit(None).cast("string").alias("work"), F.lit(0).alias("n"), F.lit(0).alias("refused"))

    def step(a, e):
        ok, to = (e["action"] == "register") & a["state"].isNull(), F.when(e["action"] == "register", "found")
        for action, (allowed, after) in DISCOVERY.items():
            ok = ok | ((e["action"] == action) & F.coalesce(a["state"].isin(*allowed), F.lit(False)))
            to = to.when(e["action"] == action, after)
        return F.struct(F.when(ok, to).otherwise(a["state"]).alias("state"), F.when(ok, F.coalesce(e["work"], a["work"])).otherwise(a["work"]).alias("work"), (a["n"] + ok.cast("int")).alias("n"), (a["refused"] + (~ok).cast("int")).alias("refused"))

    return steps.select("id", F.aggregate("steps", start, step).alias("r")).select("id", "r.*")


def ledger(events: DataFrame) -> DataFrame:
    """reference_id, version, publication of an append-only ledger of events (event_id, reference_id, expected_version, kind:
    publish or withdraw): an event id counts once, and an event with another version than the present one is passed over. L09."""
    once = events.groupBy("event_id", "reference_id").agg(F.min(F.struct("seq", "expected_version", "kind")).alias("e"))
    steps = once.groupBy("reference_id").agg(F.array_sort(F.collect_list("e")).alias("steps"))
    start = F.struct(F.lit(0).cast("long").alias("version"), F.lit("draft").alias("publication"))

    def step(a, e):
        ok = (e["expected_version"] == a["version"]) & (((e["kind"] == "publish") & (a["publication"] != "published")) | ((e["kind"] == "withdraw") & (a["publication"] == "published")))
        return F.struct((a["version"] + ok.cast("long")).alias("version"), F.when(ok, F.when(e["kind"] == "publish", "published").otherwise("withdrawn")).otherwise(a["publication"]).alias("publication"))

    return steps.select("reference_id", F.aggregate("steps", start, step).alias("r")).select("reference_id", "r.*")


def ranked(nodes: DataFrame) -> DataFrame:
    """nodes in canonical order by corpus, for callers that page through a scope."""
    return nodes.withColumn("rank", F.row_number().over(Window.partitionBy("corpus").orderBy(*canonical_order())))
