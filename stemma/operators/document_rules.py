"""The rules of standoff corpus documents, as queries over their tables: subject and code of all that is broken. L29.

A document's tables, of which any may be left out:

    records(table, id)                                        everything with an id of its own
    links(source, target, kind)                               kind: the table that target must be in, or null
    endpoints(source, bundle, target)                         targets of annotations, relations and contributions
    editions(id, work), members(collection, ord, work, edition)
    revisions(id, edition, sequence, previous)
    streams(id, revision, ord, text)
    anchors(id, revision), segments(anchor, ordinal, stream, start, stop)
    nodes(id, revision, type, features, anchor, stream, offset), profiles(revision, types, features)
    structures(id, revision, name), structure_members(structure, node, parent, ord)
    marks(owner, start, stop, text)
    schemes(id, revision, edition, work, version), entries(scheme, key, ord, targets)
    resolutions(id, scheme, edition, revision, version, start_key, end_key, status, targets, candidates, reason)
    capabilities(name)                                        those that the document requires

Every rule is an aggregation, a window inside one parent or an equi-join; none compares all with all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .hierarchy import structure_errors

#: Fixed types of the core vocabulary.
CORE_TYPES = ("core:document", "core:section", "core:heading", "core:paragraph", "core:sentence", "core:clause", "core:word", "core:verse", "core:page", "core:figure", "core:milestone")
#: Fixed capabilities of a reader.
CAPABILITIES = ("core:text", "core:anchors", "core:structures", "core:references", "core:relations", "core:annotations", "core:positions")
_SURROGATE = r"[\x{D800}-\x{DFFF}]"

Tables = dict[str, DataFrame]


def _found(df: DataFrame, subject: str | Column, code: str | Column) -> DataFrame:
    subject = F.col(subject) if isinstance(subject, str) else subject
    return df.select(subject.cast("string").alias("subject"), (F.lit(code) if isinstance(code, str) else code).alias("code"))


def _twice(df: DataFrame, keys: list[str], subject: str, code: str) -> DataFrame:
    """Groups of keys with more than one row, by their first subject."""
    return _found(df.groupBy(*keys).agg(F.min(subject).alias("s"), F.count(F.lit(1)).alias("n")).where("n > 1"), "s", code)


def identity(t: Tables, bundle: str) -> list[DataFrame]:
    return [_twice(t["records"], ["id"], "id", "identity:duplicate"), _found(t["records"].where(F.col("id") == bundle), "id", "identity:bundle-collision")]


def links(t: Tables) -> list[DataFrame]:
    there = t["records"].groupBy("id").agg(F.collect_set("table").alias("tables"))
    both = t["links"].join(there.withColumnRenamed("id", "target"), "target", "left")
    bad = both.where(F.col("tables").isNull() | (F.col("kind").isNotNull() & ~F.array_contains("tables", F.col("kind"))))
    return [_found(bad, "source", F.concat(F.lit("link:"), F.coalesce("kind", F.lit("any"))))]


def endpoints(t: Tables, bundle: str, external: DataFrame | None = None) -> list[DataFrame]:
    """external: bundle, id of other documents that are at hand; endpoints in others aren't checked."""
    e = t["endpoints"]
    local = e.where(F.coalesce("bundle", F.lit(bundle)) == bundle).where(F.col("target") != bundle)
    out = [_found(local.join(t["records"].select(F.col("id").alias("target")), "target", "left_anti"), "source", "endpoint:missing-local")]
    if external is not None:
        away = e.where(F.col("bundle") != bundle).where(F.col("bundle") != F.col("target")).join(external.select("bundle").distinct(), "bundle", "left_semi")
        out.append(_found(away.join(external.select("bundle", F.col("id").alias("target")), ["bundle", "target"], "left_anti"), "source", "endpoint:missing-external"))
    return out


def capabilities(t: Tables, known: list[str]) -> list[DataFrame]:
    return [_found(t["capabilities"].where(~F.col("name").isin(known)), "name", "capability:unsupported-required")]


def collections(t: Tables) -> list[DataFrame]:
    m = t["members"]
    other = m.where("edition is not null").join(t["editions"].select(F.col("id").alias("edition"), F.col("work").alias("w")), "edition", "left").where(~F.col("work").eqNullSafe(F.col("w")))
    return [_twice(m, ["collection", "ord"], "collection", "collection:duplicate-order"), _found(other, "collection", "collection:edition-work")]


def revisions(t: Tables) -> list[DataFrame]:
    r = t["revisions"]
    p = r.select(F.col("id").alias("previous"), F.col("edition").alias("pe"), F.col("sequence").alias("ps"))
    wrong = r.where("previous is not null").join(p, "previous", "left").where("not (pe <=> edition and coalesce(ps < sequence, false))")
    return [_twice(r, ["edition", "sequence"], "id", "revision:duplicate-sequence"), _found(wrong, "id", "revision:invalid-predecessor")]


def streams(t: Tables) -> list[DataFrame]:
    s = t["streams"]
    return [_twice(s, ["revision", "ord"], "id", "stream:duplicate-order"), _found(s.where(F.col("text").rlike(_SURROGATE)), "id", "text:surrogate")]


def anchors(t: Tables) -> list[DataFrame]:
    s = t["streams"].select(F.col("id").alias("stream"), F.col("revision").alias("sr"), F.col("ord").alias("so"), F.length("text").alias("size"))
    seg = t["segments"].join(t["anchors"].select(F.col("id").alias("anchor"), "revision"), "anchor").join(s, "stream", "left")
    w = Window.partitionBy("anchor").orderBy("ordinal")
    seg = seg.withColumns({"po": F.lag(F.coalesce("so", F.lit(-1))).over(w), "pe": F.lag("stop").over(w), "so": F.coalesce("so", F.lit(-1))})
    rules = F.array_compact(F.array(
        F.when(~F.col("sr").eqNullSafe(F.col("revision")), "anchor:revision"),
        F.when((F.col("start") < 0) | (F.col("start") >= F.col("stop")) | (F.col("stop") > F.coalesce("size", F.lit(0))), "anchor:bounds"),
        F.when(F.col("po").isNotNull() & ~((F.col("so") > F.col("po")) | ((F.col("so") == F.col("po")) & (F.col("start") >= F.col("pe")))), "anchor:overlap-or-order"),
    ))
    return [_found(seg.select("anchor", F.explode(rules).alias("code")), "anchor", F.col("code"))]


def nodes(t: Tables) -> list[DataFrame]:
    p = t["profiles"].groupBy("revision").agg(F.flatten(F.collect_list("types")).alias("ptypes"), F.flatten(F.collect_list("features")).alias("pfeatures"))
    a = t["anchors"].select(F.col("id").alias("anchor"), F.col("revision").alias("ar"))
    s = t["streams"].select(F.col("id").alias("stream"), F.col("revision").alias("sr"), F.length("text").alias("size"))
    n = t["nodes"].join(p, "revision", "left").join(a, "anchor", "left").join(s, "stream", "left")
    declared = lambda have, x: F.coalesce(F.array_contains(have, x), F.lit(False))
    own = F.col("type").isin(*CORE_TYPES) | (~F.col("type").startswith("core:") & declared(F.col("ptypes"), F.col("type")))
    loose = F.exists(F.coalesce("features", F.array().cast("array<string>")), lambda f: ~f.startswith("core:") & ~declared(F.col("pfeatures"), f))
    rules = F.array_compact(F.array(
        F.when(~own, "profile:undeclared-type"), F.when(loose, "profile:undeclared-feature"),
        F.when(F.col("anchor").isNotNull() & ~F.col("ar").eqNullSafe(F.col("revision")), "node:anchor-revision"),
        F.when(F.col("stream").isNotNull() & ~F.col("sr").eqNullSafe(F.col("revision")), "position:revision"),
        F.when(F.col("stream").isNotNull() & (F.col("offset") > F.coalesce("size", F.lit(0))), "position:bounds"),
    ))
    out = [_found(n.select("id", F.explode(rules).alias("code")), "id", F.col("code"))]
    if "capabilities" in t:
        asked = t["capabilities"].where("name = 'core:positions'").agg(F.count(F.lit(1)).alias("k"))
        placed = t["nodes"].where("stream is not null").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("m")).where("m > 0")
        out.append(_found(placed.withColumn("k0", F.lit(0)).join(asked.withColumnRenamed("k", "k0"), "k0"), "id", "position:capability"))
    return out


def structures(t: Tables) -> list[DataFrame]:
    s, m = t["structures"], t["structure_members"]
    r = m.join(s.select(F.col("id").alias("structure"), "revision"), "structure").join(t["nodes"].select(F.col("id").alias("node"), F.col("revision").alias("nr")), "node", "left")
    tree = structure_errors(m.select("structure", "node", "parent").distinct())
    code = F.when(F.col("error") == "missing_parent", "structure:missing-parent").otherwise("structure:cycle")
    return [
        _twice(s, ["revision", "name"], "id", "structure:duplicate-name"), _twice(m, ["structure", "node"], "node", "structure:duplicate-node"),
        _twice(m, ["structure", "parent", "ord"], "node", "structure:duplicate-sibling-order"),
        _found(r.where(~F.col("nr").eqNullSafe(F.col("revision"))), "node", "structure:revision"), _found(tree, "node", code),
    ]


def marks(t: Tables) -> list[DataFrame]:
    return [_found(t["marks"].where("start < 0 or start >= stop or stop > length(text)"), "owner", "annotation:mark-bounds")]


def schemes(t: Tables) -> list[DataFrame]:
    s, e = t["schemes"], t["entries"]
    rev, ed = t["revisions"].select(F.col("id").alias("revision"), F.col("edition").alias("re")), t["editions"].select(F.col("id").alias("edition"), F.col("work").alias("ew"))
    scope = s.join(rev, "revision", "left").join(ed, "edition", "left").where("not (re <=> edition and ew <=> work)")
    targets = e.select("scheme", F.explode("targets").alias("node")).distinct().join(s.select(F.col("id").alias("scheme"), "revision"), "scheme").join(t["nodes"].select(F.col("id").alias("node"), F.col("revision").alias("nr")), "node", "left")
    twice = _twice(e, ["scheme", "key"], "scheme", "scheme:duplicate-key-or-order").unionByName(_twice(e, ["scheme", "ord"], "scheme", "scheme:duplicate-key-or-order")).distinct()
    return [_found(scope, "id", "scheme:scope"), twice, _found(targets.where(~F.col("nr").eqNullSafe(F.col("revision"))), "scheme", "scheme:target-revision")]


def resolutions(t: Tables) -> list[DataFrame]:
    r, s = t["resolutions"], t["schemes"]
    own = s.select(F.col("id").alias("scheme"), F.struct("edition", "revision", "version").alias("own"))
    r = r.join(own, "scheme", "left").withColumn("there", F.coalesce(F.col("own") == F.struct("edition", "revision", "version"), F.lit(False)))
    e = t["entries"].select("scheme", "key", F.col("ord").alias("ordinal"), F.posexplode("targets").alias("p", "target"))
    # the order of targets is that of their entries, and of each entry's own list
    e = e.select("scheme", "key", "ordinal", F.col("target"), (F.col("ordinal") * 1_000_000 + F.col("p")).alias("place"))
    asked = r.where("there").select("id", "scheme", "start_key", F.coalesce("end_key", "start_key").alias("end_key"))
    place = t["entries"].select("scheme", "key", F.col("ord").alias("ordinal")).distinct()
    ends = asked.join(place.toDF("scheme", "start_key", "lo"), ["scheme", "start_key"], "left").join(place.toDF("scheme", "end_key", "hi"), ["scheme", "end_key"], "left").select("id", (F.col("lo") <= F.col("hi")).alias("range"))
    want = _targets(e, asked, place)
    r = r.join(ends, "id", "left").join(want, "id", "left").withColumn("range", F.coalesce("range", F.lit(False)))
    status, n = F.col("status"), F.size("targets")
    rules = F.array_compact(F.array(
        F.when(F.col("there") != (status != "unavailable"), "resolution:availability"),
        F.when((status == "resolved") & ~F.col("range"), "resolution:range"),
        F.when((status == "resolved") & F.col("want").isNotNull() & (F.col("want") != F.col("targets")), "resolution:targets"),
        F.when((status != "resolved") & (n > 0), "resolution:nonresolved-targets"),
        F.when((status != "resolved") & (F.coalesce("reason", F.lit("")) == ""), "resolution:missing-reason"),
        F.when((F.size("candidates") >= 2) != (status == "ambiguous"), "resolution:candidates"),
        F.when((status == "unresolved") & F.col("range"), "resolution:resolvable"),
    ))
    out = [_found(r.select("id", F.explode(rules).alias("code")), "id", F.col("code"))]
    named = r.select("id", "revision", F.explode(F.array_distinct(F.concat("targets", F.flatten("candidates")))).alias("node"))
    scope = named.join(t["nodes"].select(F.col("id").alias("node"), F.col("revision").alias("nr")), "node", "left").where(~F.col("nr").eqNullSafe(F.col("revision")))
    return [*out, _found(scope, "id", "resolution:target-scope")]


def _targets(e: DataFrame, asked: DataFrame, place: DataFrame) -> DataFrame:
    """id, want: the targets between the keys of each range, each once, as first named."""
    span = asked.join(place.toDF("scheme", "start_key", "lo"), ["scheme", "start_key"]).join(place.toDF("scheme", "end_key", "hi"), ["scheme", "end_key"])
    inside = span.join(e, "scheme").where("ordinal between lo and hi")
    first = inside.groupBy("id", "target").agg(F.min("place").alias("p"))
    return first.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("p", "target"))).alias("x")).select("id", F.transform("x", lambda v: v["target"]).alias("want"))


def violations(t: Tables, bundle: str, known: list[str], external: DataFrame | None = None) -> DataFrame:
    """subject, code: all that a document breaks, of the rules whose tables are there."""
    needs = [
        (("records",), lambda: identity(t, bundle)), (("records", "links"), lambda: links(t)), (("records", "endpoints"), lambda: endpoints(t, bundle, external)),
        (("capabilities",), lambda: capabilities(t, known)), (("members", "editions"), lambda: collections(t)), (("revisions",), lambda: revisions(t)),
        (("streams",), lambda: streams(t)), (("anchors", "segments", "streams"), lambda: anchors(t)), (("nodes", "profiles", "anchors", "streams"), lambda: nodes(t)),
        (("structures", "structure_members", "nodes"), lambda: structures(t)), (("marks",), lambda: marks(t)), (("schemes", "entries", "revisions", "editions", "nodes"), lambda: schemes(t)),
        (("resolutions", "schemes", "entries", "nodes"), lambda: resolutions(t)),
    ]
    parts = [p for tables, rule in needs if all(x in t for x in tables) for p in rule()]
    return reduce(DataFrame.unionByName, parts)
