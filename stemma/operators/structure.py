"""Containment, order and sections of slot graphs, as joins.

Containment has no equi key of its own. The larger interval is spread over the buckets of `width` slots
that it touches, the smaller one has the bucket of its first slot: an equi-join with the exact condition as
residual, and each pair once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.corpus import Corpus, canonical_order


def prefixed(nodes: DataFrame, p: str) -> DataFrame:
    """nodes with every column but corpus renamed to p_<name>."""
    return nodes.select("corpus", *[F.col(c).alias(f"{p}_{c}") for c in nodes.columns if c != "corpus"])


def held(p: str, c: str, p_span: str, c_span: str) -> str:
    """SQL: does every range of c lie in one of p? Nodes without gaps have null ranges, and their span counts."""
    one = lambda x, span: f"coalesce({x}, array(named_struct('lo', {span.split(',')[0]}, 'hi', {span.split(',')[1]})))"
    return f"({p} is null or forall({one(c, c_span)}, x -> exists({p}, y -> y.lo <= x.lo and x.hi <= y.hi)))"


def bucket_width(parents: DataFrame) -> int:
    """About the mean span of the parents, so that each touches few buckets. One small aggregation."""
    mean = parents.agg(F.avg(F.col("last_slot") - F.col("first_slot") + 1)).first()[0]
    return max(1, int(mean or 1))


def embedding_pairs(parents: DataFrame, children: DataFrame, width: int | None = None) -> DataFrame:
    """(corpus, p_*, c_*): each parent with each other node all of whose slots it has; a column ranges of both tells gaps. H01, H02."""
    width = width or bucket_width(parents)
    p = prefixed(parents.where("first_slot is not null"), "p").withColumn("bucket", F.explode(F.sequence(F.expr(f"p_first_slot div {width}"), F.expr(f"p_last_slot div {width}"))))
    c = prefixed(children.where("first_slot is not null"), "c").withColumn("bucket", F.expr(f"c_first_slot div {width}"))
    inside = "p_first_slot <= c_first_slot and c_last_slot <= p_last_slot and p_node <> c_node"
    if "ranges" in parents.columns and "ranges" in children.columns:
        inside += " and " + held("p_ranges", "c_ranges", "p_first_slot,p_last_slot", "c_first_slot,c_last_slot")
    return p.join(c, ["corpus", "bucket"]).where(inside).drop("bucket")


def overlap_pairs(left: DataFrame, right: DataFrame, width: int | None = None) -> DataFrame:
    """(corpus, p_*, c_*): pairs that share a slot. Both sides spread; a pair counts in the later of their first buckets. T06."""
    width = width or bucket_width(left)
    spread = lambda d, a: prefixed(d.where("first_slot is not null"), a).withColumn("bucket", F.explode(F.sequence(F.expr(f"{a}_first_slot div {width}"), F.expr(f"{a}_last_slot div {width}"))))
    both = "p_first_slot <= c_last_slot and c_first_slot <= p_last_slot and p_node <> c_node"
    once = f"bucket = greatest(p_first_slot div {width}, c_first_slot div {width})"
    return spread(left, "p").join(spread(right, "c"), ["corpus", "bucket"]).where(f"{both} and {once}").drop("bucket")


def anchored_children(parents: DataFrame, children: DataFrame, width: int | None = None) -> DataFrame:
    """(corpus, p_*, c_*, index): nodes whose first slot lies in the parent, numbered from 1 for each type. H03, H04."""
    width = width or bucket_width(parents)
    p = prefixed(parents.where("first_slot is not null"), "p").withColumn("bucket", F.explode(F.sequence(F.expr(f"p_first_slot div {width}"), F.expr(f"p_last_slot div {width}"))))
    c = prefixed(children.where("first_slot is not null"), "c").withColumn("bucket", F.expr(f"c_first_slot div {width}"))
    pairs = p.join(c, ["corpus", "bucket"]).where("c_first_slot between p_first_slot and p_last_slot and p_node <> c_node").drop("bucket")
    order = [F.col("c_first_slot"), F.col("c_last_slot").desc(), F.col("c_node")]
    return pairs.withColumn("index", F.row_number().over(Window.partitionBy("corpus", "p_node", "c_otype").orderBy(*order)))


def enclosing_sections(corpus: Corpus, nodes: DataFrame, width: int = 256) -> DataFrame:
    """nodes with section_node: for each, the innermost section that holds its first slot; sections of one
    level don't overlap, so at most one of each level matches. H05, H06."""
    sections = corpus.nodes.where(F.col("otype").isin(corpus.section_types))
    depth = F.array_position(F.array(*[F.lit(t) for t in corpus.section_types]), F.col("otype")).alias("depth")
    s = sections.where("first_slot is not null").select("corpus", F.col("node").alias("section_node"), F.col("first_slot").alias("s_first"), F.col("last_slot").alias("s_last"), depth)
    s = s.withColumn("bucket", F.explode(F.sequence(F.expr(f"s_first div {width}"), F.expr(f"s_last div {width}"))))
    n = nodes.withColumn("bucket", F.expr(f"first_slot div {width}"))
    found = n.join(s, ["corpus", "bucket"]).where("first_slot between s_first and s_last")
    best = found.groupBy("corpus", "node").agg(F.max_by("section_node", "depth").alias("section_node"))
    return nodes.join(best, ["corpus", "node"], "left")


def headings(corpus: Corpus, nodes: DataFrame, width: int = 256) -> DataFrame:
    """corpus, node and a column for each section level: the label of the section that holds the node's
    first slot. H08."""
    base = out = nodes.select("corpus", "node", "first_slot")
    for level in corpus.section_types:
        name = corpus.section_features[level]
        section = corpus.of_type(level)
        label = corpus.feature(name).withColumnRenamed(name, "label") if name != "key" else section.select("corpus", "node", F.col("key").alias("label"))
        s = section.where("first_slot is not null").select("corpus", "node", "first_slot", "last_slot").join(label, ["corpus", "node"])
        s = s.select("corpus", F.col("label").alias(level), F.col("first_slot").alias("s_first"), F.col("last_slot").alias("s_last"))
        s = s.withColumn("bucket", F.explode(F.sequence(F.expr(f"s_first div {width}"), F.expr(f"s_last div {width}"))))
        # from the nodes themselves, so that the plan grows with the levels and not with their powers
        hit = base.withColumn("bucket", F.expr(f"first_slot div {width}")).join(s, ["corpus", "bucket"]).where("first_slot between s_first and s_last").select("corpus", "node", level)
        out = out.join(hit, ["corpus", "node"], "left")
    return out.drop("first_slot")


def section_ref(levels: list[str]) -> Column:
    """The parts of a heading joined by spaces, nulls dropped; the node's number where none is known. H09."""
    text = F.concat_ws(" ", *[F.col(x).cast("string") for x in levels])
    return F.coalesce(F.nullif(text, F.lit("")), F.col("node").cast("string"))


def first_by_heading(labelled: DataFrame, keys: list[str]) -> DataFrame:
    """keys and node: the first node in canonical order of those with the same heading. H07."""
    order = F.struct(F.coalesce("first_slot", F.lit(2**62)), -F.coalesce("last_slot", F.lit(0)), F.col("node"))
    return labelled.groupBy("corpus", *keys).agg(F.min_by("node", order).alias("node"))


def node_text(corpus: Corpus, nodes: DataFrame, width: int | None = None) -> DataFrame:
    """corpus, node, text: the texts and gaps of a node's slots in order, trailing space trimmed. H15, A10."""
    slot = corpus.slots.select("corpus", F.col("slot").alias("node"), F.col("slot").alias("first_slot"), F.col("slot").alias("last_slot"), "text", "after")
    width = width or bucket_width(nodes)
    p = prefixed(nodes.select("corpus", "node", "first_slot", "last_slot").where("first_slot is not null"), "p").withColumn("bucket", F.explode(F.sequence(F.expr(f"p_first_slot div {width}"), F.expr(f"p_last_slot div {width}"))))
    c = prefixed(slot, "c").withColumn("bucket", F.expr(f"c_first_slot div {width}"))
    pairs = p.join(c, ["corpus", "bucket"]).where("c_first_slot between p_first_slot and p_last_slot")
    parts = pairs.groupBy("corpus", F.col("p_node").alias("node")).agg(F.array_sort(F.collect_list(F.struct("c_node", "c_text", "c_after"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda x: F.concat(x["c_text"], x["c_after"])), "")
    return parts.select("corpus", "node", F.rtrim(text).alias("text"))


def type_statistics(corpus: Corpus) -> DataFrame:
    """otype, n, mean_span (one decimal, half to even), is_slot for each corpus and type. A03."""
    by = corpus.nodes.groupBy("corpus", "otype").agg(F.count(F.lit(1)).alias("n"), F.avg(F.col("last_slot") - F.col("first_slot") + 1).alias("m"))
    mean = F.when(F.col("otype") == corpus.slot_type, F.lit(1.0)).otherwise(F.bround("m", 1))
    return by.select("corpus", "otype", "n", mean.alias("mean_span"), (F.col("otype") == corpus.slot_type).alias("is_slot"))


def top_sections(corpus: Corpus, parent_type: str, child_type: str, limit: int = 500) -> DataFrame:
    """corpus, node, child_count, shown, truncated for each top section. H11."""
    pairs = embedding_pairs(corpus.of_type(parent_type), corpus.of_type(child_type))
    by = pairs.groupBy("corpus", F.col("p_node").alias("node")).agg(F.count(F.lit(1)).alias("child_count"))
    out = corpus.of_type(parent_type).select("corpus", "node").join(by, ["corpus", "node"], "left").withColumn("child_count", F.coalesce("child_count", F.lit(0)))
    return out.withColumn("shown", F.least("child_count", F.lit(limit))).withColumn("truncated", F.col("child_count") > limit)


def paged_children(corpus: Corpus, parent_type: str, child_type: str, offset: int, limit: int) -> DataFrame:
    """Children number offset+1 .. offset+limit of each parent, with total and next_offset. H12, W10."""
    pairs = embedding_pairs(corpus.of_type(parent_type), corpus.of_type(child_type))
    w = Window.partitionBy("corpus", "p_node")
    order = [F.col("c_first_slot"), F.col("c_last_slot").desc(), F.col("c_node")]
    pairs = pairs.withColumn("place", F.row_number().over(w.orderBy(*order))).withColumn("total", F.count(F.lit(1)).over(w))
    page = pairs.where((F.col("place") > offset) & (F.col("place") <= offset + limit))
    nxt = F.when(F.col("total") > offset + limit, F.lit(offset + limit))
    return page.select("corpus", F.col("p_node").alias("parent"), F.col("c_node").alias("node"), "place", "total", nxt.alias("next_offset"))


def rank_nodes(nodes: DataFrame) -> DataFrame:
    """rank in canonical order within corpus and type. W01."""
    return nodes.withColumn("rank", F.row_number().over(Window.partitionBy("corpus", "otype").orderBy(*canonical_order())))
