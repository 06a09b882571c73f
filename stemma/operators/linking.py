"""Citation detection, identification, resolution and revisions, as tables.

References live in an append-only log keyed (reference_id, version); the current one is the latest version.
Optimistic writes are judged against that log as a whole: concurrency control is the table format's task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A citation: name, then chapter:verse with an optional end in the chapter; nothing that goes on after it.
#: Fixed by the detector's contract: no compound lists, no ranges across chapters, no letters or digits at the ends.
CITATION = r"(?<![\p{L}\p{N}])((?:[1-3] )?\p{L}[\p{L}\p{M}]*\.?) ([1-9][0-9]*):([1-9][0-9]*)(?:[-–]([1-9][0-9]*))?(?![\p{L}\p{N}:–-]|[,;] ?[0-9])"


def detect(streams: DataFrame, aliases: DataFrame, key: str, text: str = "text") -> DataFrame:
    """key, start, exact, work_id, chapter, first, last, ambiguous: a row for each citation and each work of its alias. L01.

    streams are scanned once; the alias table (alias, work_id) joins on the folded name, and the planner decides by
    its size whether to broadcast it.
    """
    pattern = F.lit(CITATION)
    got = lambda i: F.regexp_extract_all(text, pattern, F.lit(i))
    # pieces between matches give each match its offset
    hits = F.arrays_zip(got(0).alias("exact"), got(1).alias("name"), got(2).alias("c"), got(3).alias("v"), got(4).alias("w"), F.split(text, CITATION, -1).alias("gap"))
    found = streams.where(F.col(text).rlike(CITATION)).select(key, F.posexplode(hits).alias("k", "x"))
    before = Window.partitionBy(key).orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("x.gap") + F.coalesce(F.length("x.exact"), F.lit(0))
    found = found.withColumn("start", (F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("x.gap")).cast("long")).where("x.exact is not null")
    first, last = F.col("x.v").cast("long"), F.coalesce(F.nullif(F.col("x.w"), F.lit("")).cast("long"), F.col("x.v").cast("long"))
    found = found.select(key, "start", "x.exact", fold("x.name").alias("alias"), F.col("x.c").cast("long").alias("chapter"), first.alias("first"), last.alias("last")).where("last >= first")
    works = aliases.select(fold("alias").alias("alias"), "work_id").distinct()
    works = works.withColumn("ambiguous", F.count(F.lit(1)).over(Window.partitionBy("alias")) > 1)
    return found.join(works, "alias").drop("alias")


def fold(name: str) -> Column:
    """Without a final stop, in a collation to which case, accents and compatible forms are alike. C24."""
    return F.collate(F.rtrim(name, F.lit(".")), "UNICODE_CI_AI")


def identify(catalog: DataFrame, names: DataFrame) -> DataFrame:
    """Exact matches of names (id, name) in a catalog (name, work_id); collisions are all kept. L02."""
    return names.join(catalog, "name").select("id", "name", "work_id")


def resolution(requests: DataFrame, candidates: DataFrame) -> DataFrame:
    """id, n, status of requests (id, key) against candidates (key, target, available). L03.

    No candidate: unresolved. Some, but none available: unavailable. One available: resolved. Several: ambiguous.
    """
    by = candidates.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("available"), 1)).alias("open"))
    status = F.when(F.col("n").isNull(), "unresolved").when(F.col("open") == 0, "unavailable").when(F.col("n") == 1, "resolved").otherwise("ambiguous")
    return requests.join(by, "key", "left").select("id", F.coalesce("n", F.lit(0)).alias("n"), status.alias("status"))


def overlapping_mappings(hits: DataFrame, mappings: DataFrame, width: int = 256) -> DataFrame:
    """hits (doc, start, stop) with each mapping (doc, m_start, m_stop, ...) that shares a character. L04, A10 of streams."""
    spread = lambda d, a, b: d.withColumn("bucket", F.explode(F.sequence(F.expr(f"{a} div {width}"), F.expr(f"greatest({a}, {b} - 1) div {width}"))))
    both = spread(hits, "start", "stop").join(spread(mappings, "m_start", "m_stop"), ["doc", "bucket"])
    return both.where(f"start < m_stop and m_start < stop and bucket = greatest(start div {width}, m_start div {width})").drop("bucket")


def current(log: DataFrame, key: str = "reference_id") -> DataFrame:
    """The latest version of each reference, by one aggregation. W06."""
    value = F.struct(*[c for c in log.columns if c not in (key, "version")])
    best = log.groupBy(key).agg(F.max("version").alias("version"), F.max_by(value, "version").alias("v"))
    return best.select(key, "version", "v.*")


#: action -> (from review, from publication, to review, to publication); None: any, or unchanged.
TRANSITIONS = {
    "approve": ("pending", "draft", "approved", None), "reject": ("pending", "draft", "rejected", None), "publish": ("approved", "draft", None, "published"),
    "withdraw": ("approved", "published", None, "withdrawn"), "reopen": (None, None, "pending", "draft"), "edit": (None, "draft", "pending", None),
}


def apply_actions(state: DataFrame, actions: DataFrame) -> DataFrame:
    """One action for each reference against its current state (reference_id, version, review, publication): a row with
    status ok, stale (another version was expected), noop or forbidden, and the state after it. L05, L06."""
    a = F.col("action")
    allowed, review, publication = F.lit(False), F.col("review"), F.col("publication")
    for name, (r, p, to_r, to_p) in TRANSITIONS.items():
        ok = (a == name) & (F.lit(True) if r is None else F.col("review") == r) & (F.lit(True) if p is None else F.col("publication") == p)
        allowed = allowed | ok
        review = F.when(a == name, F.lit(to_r) if to_r else F.col("review")).otherwise(review)
        publication = F.when(a == name, F.lit(to_p) if to_p else F.col("publication")).otherwise(publication)
    both = state.join(actions, "reference_id").withColumns({"to_review": review, "to_publication": publication})
    same = (F.col("to_review") == F.col("review")) & (F.col("to_publication") == F.col("publication"))
    status = F.when(F.col("expected_version") != F.col("version"), "stale").when(~allowed, "forbidden").when(same, "noop").otherwise("ok")
    both = both.withColumn("status", status)
    done = F.col("status") == "ok"
    return both.select("reference_id", "action", "status", (F.col("version") + done.cast("int")).alias("version"), F.when(done, F.col("to_review")).otherwise(F.col("review")).alias("review"), F.when(done, F.col("to_publication")).otherwise(F.col("publication")).alias("publication"))


def import_plan(incoming: DataFrame, store: DataFrame) -> DataFrame:
    """id, decision: create, unchanged or conflict, by content digest. L08."""
    both = incoming.select("id", F.col("digest").alias("new")).join(store.select("id", F.col("digest").alias("old")), "id", "left")
    return both.select("id", F.when(F.col("old").isNull(), "create").when(F.col("old") == F.col("new"), "unchanged").otherwise("conflict").alias("decision"))


def replay_safe(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(events, one for each event_id; ids that came back with other content). L09, L11, M08."""
    by = events.groupBy("event_id").agg(F.min("digest").alias("digest"), F.countDistinct("digest").alias("n"))
    return by.where("n = 1").select("event_id", "digest"), by.where("n > 1").select("event_id", "n")


def archive_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """path, change: added, removed or modified by (size, crc). L27."""
    b, a = before.toDF("path", "size_b", "crc_b"), after.toDF("path", "size_a", "crc_a")
    both = b.join(a, "path", "full_outer")
    change = F.when(F.col("size_b").isNull(), "added").when(F.col("size_a").isNull(), "removed").when((F.col("size_b") != F.col("size_a")) | (F.col("crc_b") != F.col("crc_a")), "modified")
    return both.select("path", change.alias("change")).where("change is not null")


def node_findings(nodes: DataFrame, features: DataFrame, max_slot: int, slot_type: str, required: dict[str, dict[str, str]]) -> DataFrame:
    """node, code: the integrity rules of nodes (node, otype, first_slot, last_slot) and their required features
    (type -> feature -> str or int) over features (node, feature, value_str, value_int). One scan of each. L18, L19."""
    n = nodes.withColumns({"missing": F.trim(F.coalesce("otype", F.lit(""))) == "", "slot": F.col("node") <= max_slot})
    rules = F.array(
        F.when(F.col("missing"), "OTYPE_MISSING"),
        F.when(~F.col("missing") & (F.col("slot") != (F.col("otype") == slot_type)), "OTYPE_SLOT_MISMATCH"),
        F.when(~F.col("missing") & ~F.col("slot") & F.col("first_slot").isNull(), "OSLOTS_EMPTY"),
        F.when(~F.col("missing") & ~F.col("slot") & ((F.col("first_slot") < 1) | (F.col("last_slot") > max_slot)), "OSLOTS_INVALID"),
    )
    found = n.select("node", F.explode(F.array_compact(rules)).alias("code"))
    pairs = [(t, f, k) for t, fs in required.items() for f, k in fs.items()]
    if pairs:
        need = nodes.sparkSession.createDataFrame(pairs, "otype string, feature string, kind string")
        asked = nodes.join(F.broadcast(need), "otype").select("node", "feature", "kind")  # the required list is a constant
        have = asked.join(features, ["node", "feature"], "left")
        code = F.when(F.col("value_str").isNull() & F.col("value_int").isNull(), "FEATURE_MISSING").when((F.col("kind") == "str") & F.col("value_str").isNull() | (F.col("kind") == "int") & F.col("value_int").isNull(), "FEATURE_TYPE")
        found = found.unionByName(have.select("node", code.alias("code")).where("code is not null"))
    return found


def segment_errors(segments: DataFrame) -> DataFrame:
    """anchor, ordinal, error of ordered segments (anchor, ordinal, start, stop, size): bounds, or overlap or order. L29, W05."""
    w = Window.partitionBy("anchor").orderBy("ordinal")
    last = F.lag("stop").over(w)
    error = F.when((F.col("start") < 0) | (F.col("stop") > F.col("size")) | (F.col("start") >= F.col("stop")), "anchor:bounds").when(last > F.col("start"), "anchor:overlap-or-order")
    return segments.withColumn("error", error).where("error is not null").select("anchor", "ordinal", "error")


def paired_milestones(marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(doc, id, start, stop of spans; doc, id, error) from marks (doc, id, kind start or end, place): repeated,
    lone and reversed marks are errors, and so is a span that another one cuts or that begins inside another: spans follow
    each other. S31."""
    by = marks.groupBy("doc", "id").agg(F.count(F.when(F.col("kind") == "start", 1)).alias("s"), F.count(F.when(F.col("kind") == "end", 1)).alias("e"), F.min(F.when(F.col("kind") == "start", F.col("place"))).alias("start"), F.max(F.when(F.col("kind") == "end", F.col("place"))).alias("stop"))
    error = F.when((F.col("s") > 1) | (F.col("e") > 1), "duplicate").when(F.col("e") == 0, "unclosed").when(F.col("s") == 0, "unmatched").when(F.col("stop") < F.col("start"), "reversed")
    by = by.withColumn("error", error)
    reach = Window.partitionBy("doc").orderBy("start", "stop", "id").rowsBetween(Window.unboundedPreceding, -1)
    good = by.where("error is null").withColumn("error", F.when(F.max("stop").over(reach) > F.col("start"), "nested"))
    by = by.where("error is not null").unionByName(good)
    return by.where("error is null").select("doc", "id", "start", "stop"), by.where("error is not null").select("doc", "id", "error")
