"""Resolving references to nodes and back, as joins. C07-C10, R03, L36."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.corpus import Corpus
from ..plans.tables import kept
from .structure import anchored_children


def section_nodes(corpus: Corpus) -> DataFrame:
    """corpus, path (labels from the top, joined by a unit separator), node, otype, depth for each section, first wins.

    Level by level: a section's path is that of the section above, found by its first slot, and its own label.
    """
    from .structure import first_by_heading

    out = above = None
    width = 256
    for i, level in enumerate(corpus.section_types):
        name = corpus.section_features[level]
        nodes = corpus.of_type(level).where("first_slot is not null").select("corpus", "node", "first_slot", "last_slot", "key")
        here = nodes.withColumn("label", F.col("key").cast("string")) if name == "key" else nodes.join(corpus.feature(name).withColumnRenamed(name, "label"), ["corpus", "node"])
        here = here.withColumn("label", F.col("label").cast("string"))
        if above is None:
            here = here.withColumn("path", F.col("label"))
        else:
            up = above.select("corpus", F.col("path").alias("up"), F.col("first_slot").alias("s_first"), F.col("last_slot").alias("s_last")).withColumn("bucket", F.explode(F.sequence(F.expr(f"s_first div {width}"), F.expr(f"s_last div {width}"))))
            here = here.withColumn("bucket", F.expr(f"first_slot div {width}")).join(up, ["corpus", "bucket"]).where("first_slot between s_first and s_last")
            here = here.withColumn("path", F.concat("up", F.lit("\u001f"), "label"))
        above = here.select("corpus", "node", "first_slot", "last_slot", "path")
        above = kept(above, f"paths-{i}")
        first = first_by_heading(above, ["path"]).withColumns({"otype": F.lit(level), "depth": F.lit(i + 1)})
        out = first if out is None else out.unionByName(first)
    return out


def resolve(corpus: Corpus, refs: DataFrame, version: str | None = None) -> DataFrame:
    """refs (id, r: a parsed reference) with node and status: resolved, invalid, version_mismatch, section_not_found,
    type_not_in_section or index_out_of_range; a range gives a row for each node."""
    sections = section_nodes(corpus).select(F.col("path").alias("_path"), F.col("node").alias("section_node"))
    asked = kept(refs.withColumn("_path", F.array_join("r.sections", "\u001f")).join(sections, "_path", "left").withColumn("_type", F.col("r.target_type")), "asked")
    # only the sections and types that are asked for are numbered: the corpus has few types, references may name any others
    inside = asked.where("_type is not null and section_node is not null").select(F.col("section_node").alias("node"), F.col("_type").alias("otype"))
    parents = corpus.nodes.where(F.col("otype").isin(corpus.section_types)).join(inside.select("node").distinct(), "node", "left_semi").select("corpus", "node", "otype", "first_slot", "last_slot")
    wanted = [r[0] for r in corpus.nodes.select("otype").distinct().join(inside.select("otype").distinct(), "otype", "left_semi").collect()]
    kids = anchored_children(parents, corpus.nodes.where(F.col("otype").isin(wanted)), 256).select(F.col("p_node").alias("section_node"), F.col("c_otype").alias("_type"), F.col("c_node").alias("kid"), "index")
    kids = kept(kids, "kids")
    sizes = kids.groupBy("section_node", "_type").agg(F.count(F.lit(1)).alias("n_kids"))
    asked = asked.join(sizes, ["section_node", "_type"], "left")
    status = (
        F.when(F.col("r.error").isNotNull(), "invalid")
        .when(F.col("r.version").isNotNull() & (F.col("r.version") != F.lit(version)), "version_mismatch")
        .when(F.col("section_node").isNull(), "section_not_found")
        .when(F.col("_type").isNull(), "resolved")
        .when(F.col("n_kids").isNull(), "type_not_in_section")
        .when(F.col("r.end") > F.col("n_kids"), "index_out_of_range")
        .otherwise("resolved")
    )
    asked = asked.withColumn("status", status)
    plain = asked.where("_type is null or status <> 'resolved'").select("id", F.when(F.col("status") == "resolved", F.col("section_node")).alias("node"), "status")
    hit = asked.where("_type is not null and status = 'resolved'").withColumn("index", F.explode(F.sequence(F.col("r.start").cast("int"), F.col("r.end").cast("int")))).join(kids, ["section_node", "_type", "index"])
    return plain.unionByName(hit.select("id", F.col("kid").alias("node"), "status"))


def serialize(corpus: Corpus, otype: str, corpus_id: str, version: str | None = None) -> DataFrame:
    """node, ref for every node of a type that isn't a section: its innermost section and its number there. C08."""
    from ..functions.refs import short
    from .structure import enclosing_sections

    nodes = corpus.of_type(otype).where("first_slot is not null")
    inner = enclosing_sections(corpus, nodes).select("corpus", "node", "section_node")
    parents = corpus.nodes.where(F.col("otype").isin(corpus.section_types)).select("corpus", "node", "otype", "first_slot", "last_slot")
    index = anchored_children(parents, nodes, 256).select(F.col("p_node").alias("section_node"), F.col("c_node").alias("node"), "index")
    paths = section_nodes(corpus).select(F.col("node").alias("section_node"), "path")
    out = inner.join(index, ["section_node", "node"]).join(paths, "section_node")
    r = F.struct(F.lit(corpus_id).alias("corpus"), F.lit(version).cast("string").alias("version"), F.split("path", "\u001f").alias("sections"), F.lit(otype).alias("target_type"), F.col("index").cast("long").alias("start"), F.col("index").cast("long").alias("end"))
    return out.withColumn("r", r).select("node", short(F.col("r")).alias("ref"))
