"""Versions, manifests, edits and lists, as operations on append-only tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def next_label(labels: DataFrame) -> DataFrame:
    """corpus, next: v1.(n + 1) after the highest v1.n; other labels don't count. W07."""
    n = F.nullif(F.regexp_extract("label", r"^v1\.(\d+)$", 1), F.lit("")).cast("long")
    return labels.groupBy("corpus").agg(F.concat(F.lit("v1."), (F.coalesce(F.max(n), F.lit(-1)) + 1).cast("string")).alias("next"))


def mark_current(history: DataFrame) -> DataFrame:
    """history (corpus, version) with current: true for the last version of each corpus. L26."""
    last = history.groupBy("corpus").agg(F.max("version").alias("last"))
    return history.join(last, "corpus").withColumn("current", F.col("version") == F.col("last")).drop("last")


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row of each key with the highest order. L24."""
    rest = F.struct(*[c for c in rows.columns if c not in keys])
    return rows.groupBy(*keys).agg(F.max_by(rest, order).alias("v")).select(*keys, "v.*")


def patch(base: DataFrame, changes: DataFrame, editable: list[str]) -> DataFrame:
    """base (id, key, value) with the values of changes for editable keys. R08."""
    new = changes.where(F.col("key").isin(editable)).select("id", "key", F.col("value").alias("new"), F.lit(True).alias("set"))
    out = base.join(new, ["id", "key"], "full_outer")
    return out.select("id", "key", F.when(F.col("set"), F.col("new")).otherwise(F.col("value")).alias("value"))


def edited(feature: DataFrame, edits: DataFrame) -> DataFrame:
    """A feature (node, value) with edits applied: a new version, the old one untouched. L23."""
    new = edits.select("node", F.col("value").alias("new"), F.lit(True).alias("set"))
    return feature.join(new, "node", "full_outer").select("node", F.when(F.col("set"), F.col("new")).otherwise(F.col("value")).alias("value"))


def reconcile(intents: DataFrame, receipts: DataFrame, reverts: DataFrame) -> DataFrame:
    """operation, state: pending without a receipt, undone with a revert, else applied. L22."""
    out = intents.join(receipts.withColumn("done", F.lit(True)), "operation", "left").join(reverts.withColumn("back", F.lit(True)), "operation", "left")
    return out.select("operation", F.when(F.col("done").isNull(), "pending").when(F.col("back"), "undone").otherwise("applied").alias("state"))


def scheme_targets(entries: DataFrame, asked: DataFrame) -> DataFrame:
    """id, targets of ranges (id, scheme, start_key, end_key) in schemes (scheme, key, ordinal, target): the targets from one
    key to the other, each once, in the order in which they are first named; null where a key is missing or they are reversed. L30."""
    place = entries.select("scheme", "key", "ordinal").distinct()
    ends = asked.join(place.toDF("scheme", "start_key", "lo"), ["scheme", "start_key"], "left").join(place.toDF("scheme", "end_key", "hi"), ["scheme", "end_key"], "left")
    inside = ends.where("lo <= hi").join(entries.select("scheme", "ordinal", "target"), "scheme").where("ordinal between lo and hi")
    first = inside.groupBy("id", "target").agg(F.min("ordinal").alias("o"))
    lists = first.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("o", "target"))).alias("x")).select("id", F.transform("x", lambda v: v["target"]).alias("targets"))
    return ends.select("id").join(lists, "id", "left")


def scheme_range(entries: DataFrame, first: int, last: int) -> DataFrame:
    """scheme, n_targets between two places of each scheme (scheme, ordinal, target). L30."""
    return entries.where(F.col("ordinal").between(first, last)).groupBy("scheme").agg(F.countDistinct("target").alias("n_targets"))


def acceptance(pages: DataFrame) -> DataFrame:
    """candidate, decision from its pages (candidate, fatal, soft). L31."""
    by = pages.groupBy("candidate").agg(F.max("fatal").alias("f"), F.max("soft").alias("s"))
    return by.select("candidate", F.when(F.col("f"), "rejected").when(F.col("s"), "pending-review").otherwise("accepted").alias("decision"))


def page_flags(pages: DataFrame, n_pages: int) -> DataFrame:
    """candidate, code, fatal: what the pages (candidate, page from 0, content, reading_order, evidence) of a document of
    n_pages break. Content is satisfactory, blank-confirmed, unreadable or unverified. L31."""
    page = F.array_compact(F.array(
        F.when(F.col("content") == "unreadable", F.struct(F.lit("insufficient-content").alias("code"), F.lit(True).alias("fatal"))),
        F.when(F.col("reading_order") == "material-failure", F.struct(F.lit("material-reading-order-failure").alias("code"), F.lit(True).alias("fatal"))),
        F.when(F.col("content").isin("satisfactory", "blank-confirmed") & (F.coalesce("evidence", F.lit("")) == ""), F.struct(F.lit("missing-quality-evidence").alias("code"), F.lit(False).alias("fatal"))),
        F.when((F.col("content") == "unverified") | ((F.col("content") != "blank-confirmed") & (F.col("reading_order") == "unverified")), F.struct(F.lit("quality-unverified").alias("code"), F.lit(False).alias("fatal"))),
    ))
    own = pages.select("candidate", F.explode(page).alias("x")).select("candidate", "x.code", "x.fatal")
    by = pages.groupBy("candidate").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("page").alias("d"), F.countDistinct(F.when(F.col("page").between(0, n_pages - 1), F.col("page"))).alias("inside"))
    whole = F.array_compact(F.array(F.when((F.col("n") > F.col("d")) | (F.col("inside") < F.col("d")), "invalid-page-coverage"), F.when(F.col("inside") < n_pages, "missing-pages")))
    return own.unionByName(by.select("candidate", F.explode(whole).alias("code")).withColumn("fatal", F.lit(True)))


def page_decisions(pages: DataFrame, n_pages: int) -> DataFrame:
    """candidate, decision of all candidates that have pages. L31."""
    flags = page_flags(pages, n_pages).groupBy("candidate").agg(F.max("fatal").alias("f"))
    both = pages.select("candidate").distinct().join(flags, "candidate", "left")
    return both.select("candidate", F.when(F.col("f"), "rejected").when(F.col("f").isNotNull(), "pending-review").otherwise("accepted").alias("decision"))


def section_role(kind: Column, attribute: Column, level: Column) -> Column:
    """verse, chapter, book or null, from a unit's type, its type attribute (a surah is a chapter) and a heading's level. P12."""
    k, a = F.lower(kind), F.lower(F.coalesce(attribute, F.lit("")))
    role = F.when((k == "verse") | (a == "verse"), "verse").when((k == "chapter") | (a == "chapter"), "chapter").when((k == "book") | (a == "book"), "book")
    return role.when(a == "surah", "chapter").when((k == "section") & (level == "1"), "chapter")


#: Categories from the least structure to the most.
CATEGORIES = ("document", "book", "religious")


def settled_category(found: DataFrame, highest: str = "religious") -> DataFrame:
    """corpus, category, warning of rows (corpus, detected, requested): a request for at most the structure that is there
    holds; one for more is lowered, with a warning. L33."""
    rank = lambda c: F.array_position(F.array(*[F.lit(x) for x in CATEGORIES]), c)
    detected = F.when(rank(F.col("detected")) > rank(F.lit(highest)), F.lit(highest)).otherwise(F.col("detected"))
    more = F.col("requested").isNotNull() & (rank(F.col("requested")) > rank(detected))
    return found.select("corpus", F.when(F.col("requested").isNull() | more, detected).otherwise(F.col("requested")).alias("category"), F.coalesce(more, F.lit(False)).alias("warning"))


def required_features(section_types: list[str], section_features: list[str], value_types: dict[str, str]) -> dict[str, dict[str, str]]:
    """type -> feature -> str or int: the labels that a corpus's own sections must have. L19."""
    if len(section_types) != len(section_features):
        raise ValueError("the section types and their features differ in number")
    return {t: {f: value_types.get(f, "str")} for t, f in zip(section_types, section_features, strict=True)}


def category(units: DataFrame) -> DataFrame:
    """corpus, category from the roles of its units: religious with verses and chapters, book with two chapters or a book. A09."""
    n = lambda r: F.count(F.when(F.col("role") == r, 1))
    by = units.groupBy("corpus").agg(n("verse").alias("v"), n("chapter").alias("c"), n("book").alias("b"))
    return by.select("corpus", F.when((F.col("v") > 0) & (F.col("c") > 0), "religious").when((F.col("c") >= 2) | (F.col("b") > 0), "book").otherwise("document").alias("category"))


def sample_mismatches(a: DataFrame, b: DataFrame, n: int) -> DataFrame:
    """node, a, b where two loads (node, value) differ on a stride of about n nodes. A08."""
    top = a.agg(F.max("node")).first()[0] or 0
    stride = max(1, top // n)
    pick = lambda d, name: d.where((F.col("node") - 1) % stride == 0).select("node", F.col("value").alias(name))
    return pick(a, "a").join(pick(b, "b"), "node", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))


def visible(owner: Column, subject: Column) -> Column:
    """Either side without identity, or the same. P11."""
    return owner.isNull() | subject.isNull() | (owner == subject)


def page_before(rows: DataFrame, time: str, key: str, at, last, limit: int) -> DataFrame:
    """The rows before a (time, key) cursor, newest first, one more than the limit if there are more. W11."""
    older = (F.col(time) < F.lit(at)) | ((F.col(time) == F.lit(at)) & (F.col(key) < F.lit(last)))
    return rows.where(older).orderBy(F.desc(time), F.desc(key)).limit(limit + 1)


def listing(rows: DataFrame, time: str, key: str, offset: int, limit: int) -> DataFrame:
    """A page of rows, newest first, with place and total; only offset + limit rows are sorted. W09."""
    total = rows.count()
    top = rows.orderBy(F.desc(time), F.desc(key)).limit(offset + limit)
    place = F.row_number().over(Window.orderBy(F.desc(time), F.desc(key)))
    return top.withColumns({"place": place, "total": F.lit(total)}).where(F.col("place") > offset)
