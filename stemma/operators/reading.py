"""Corpora, formats, passages and nodes as a reader asks for them."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import text_format
from ..plans.corpus import Corpus, canonical_order
from ..plans.tables import cut
from .structure import embedding_pairs, headings, node_text, section_ref, type_statistics

#: What names a word, the first that a corpus has. A05.
IDENTITY = ("lemma", "lex", "word", "form", "text")


def corpora(corpus: Corpus, current: str | None = None) -> DataFrame:
    """corpus, n_nodes, current: the corpora of a load; the first in order is current where none is named. R01."""
    by = corpus.nodes.groupBy("corpus").agg(F.count(F.lit(1)).alias("n_nodes"))
    name = current or by.agg(F.min("corpus")).first()[0]
    return by.withColumn("current", F.col("corpus") == F.lit(name))


def select(corpus: Corpus, names: list[str]) -> Corpus:
    """A load with these corpora only: the others are unloaded. R01."""
    keep = lambda d: d.where(F.col("corpus").isin(names))
    return Corpus(keep(corpus.slots), keep(corpus.nodes), keep(corpus.node_features), keep(corpus.edge_features), corpus.section_types, corpus.section_features, corpus.value_types, corpus.slot_type)


def format_samples(corpus: Corpus, formats: dict[str, str], n: int = 3) -> DataFrame:
    """corpus, format, sample: each text format on the first n slots of each corpus. R02."""
    names = sorted({f for t in formats.values() for f in re.findall(r"\{(\w+)\}", t)})
    first = corpus.nodes.where((F.col("otype") == corpus.slot_type) & (F.col("node") <= n)).select("corpus", "node")
    wide = corpus.with_features(first, names)
    shown = F.array(*[F.struct(F.lit(k).alias("format"), text_format(t, {x: F.col(x) for x in names}).alias("t")) for k, t in sorted(formats.items())])
    rows = wide.select("corpus", "node", F.explode(shown).alias("x")).select("corpus", "node", "x.*")
    parts = rows.groupBy("corpus", "format").agg(F.array_sort(F.collect_list(F.struct("node", "t"))).alias("p"))
    return parts.select("corpus", "format", F.array_join(F.transform("p", lambda x: x["t"]), "").alias("sample"))


def finest_type(corpus: Corpus) -> str:
    """The type above the slots with the shortest spans on average. H13."""
    stats = type_statistics(corpus).where("not is_slot").groupBy("otype").agg(F.avg("mean_span").alias("m"))
    found = stats.orderBy("m", F.desc("otype")).first()
    return found["otype"] if found else corpus.slot_type


def passage_nodes(corpus: Corpus, sections: DataFrame | None = None) -> DataFrame:
    """(section, node): the passages to read. Of the whole corpus, its lowest section level, or its finest type where it has
    one level; of sections (node), the lowest level inside, else the finest type inside, else the section itself. H13."""
    levels, finest = corpus.section_types, finest_type(corpus)
    if sections is None:
        return corpus.of_type(levels[-1] if len(levels) > 1 else finest).select("corpus", F.lit(None).cast("long").alias("section"), "node")
    tops = corpus.nodes.join(sections.select("node").distinct(), "node")
    inside = lambda t: embedding_pairs(tops, corpus.of_type(t)).where(F.lit(True) if t != levels[-1] else F.col("p_otype") != levels[-1]).select("corpus", F.col("p_node").alias("section"), F.col("c_node").alias("node"))
    low = inside(levels[-1]) if levels else None
    fine = inside(finest)
    if low is not None:
        fine = fine.join(low.select("section").distinct(), "section", "left_anti")
    both = fine if low is None else low.unionByName(fine)
    alone = tops.select("corpus", F.col("node").alias("section")).join(both.select("section").distinct(), "section", "left_anti")
    return both.unionByName(alone.select("corpus", "section", F.col("section").alias("node")))


def content_page(corpus: Corpus, passages: DataFrame, offset: int, limit: int = 50) -> DataFrame:
    """corpus, section, node, ref, text, n_tokens, place, total, next_offset: passages (corpus, section, node) number offset+1
    to offset+limit (200 at most) of each section, in canonical order. R06."""
    limit, offset = max(1, min(limit, 200)), max(0, offset)
    nodes = passages.join(corpus.nodes.select("corpus", "node", "first_slot", "last_slot", "n_slots"), ["corpus", "node"])
    w = Window.partitionBy("corpus", "section")
    page = nodes.withColumn("place", F.row_number().over(w.orderBy(*canonical_order()))).withColumn("total", F.count(F.lit(1)).over(w))
    page = cut(page.where((F.col("place") > offset) & (F.col("place") <= offset + limit)))
    heads = headings(corpus, page.select("corpus", "node", "first_slot").distinct())
    refs = heads.select("corpus", "node", section_ref(corpus.section_types).alias("ref"))
    text = node_text(corpus, page.select("corpus", "node", "first_slot", "last_slot").distinct())
    next_ = F.when(F.col("total") > offset + limit, F.lit(offset + limit)).alias("next_offset")
    out = page.join(refs, ["corpus", "node"]).join(text, ["corpus", "node"], "left")
    return out.select("corpus", "section", "node", "ref", F.coalesce("text", F.lit("")).alias("text"), F.col("n_slots").alias("n_tokens"), "place", "total", next_)


def inspected(corpus: Corpus, nodes: DataFrame, annotations: DataFrame | None = None) -> DataFrame:
    """corpus, node, otype, is_slot, first_slot, last_slot, ref, text, features (a map), context (the types around it, nearest
    first; of the same slots, the deeper section first) and annotation of nodes (node). annotations: node, note. R07."""
    n = cut(corpus.nodes.join(nodes.select("node").distinct(), "node").select("corpus", "node", "otype", "first_slot", "last_slot", *(["ranges"] if "ranges" in corpus.nodes.columns else [])))
    wide = corpus.node_features.join(n.select("corpus", "node"), ["corpus", "node"], "left_semi")
    wide = wide.groupBy("corpus", "node").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("feature", F.coalesce("value_str", F.col("value_int").cast("string")))))).alias("features"))
    above = embedding_pairs(corpus.nodes.where(F.col("otype") != corpus.slot_type).select(*n.columns), n)
    # a section with the same slots as one of a level further down lies around it, not in it
    level = lambda c: F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(t) for t in corpus.section_types]).cast("array<string>"), F.col(c)), F.lit(0)), F.lit(len(corpus.section_types) + 1))
    above = above.withColumn("p_level", level("p_otype")).where(~F.col("p_otype").isin(corpus.section_types) | ~F.col("c_otype").isin(corpus.section_types) | (F.col("p_level") <= level("c_otype")))
    order = F.struct((F.col("p_last_slot") - F.col("p_first_slot")).alias("span"), (-F.col("p_level")).alias("level"), F.col("p_node").alias("node"), F.col("p_otype").alias("otype"))
    chain = above.groupBy("corpus", F.col("c_node").alias("node")).agg(F.array_sort(F.collect_list(order)).alias("c")).select("corpus", "node", F.transform("c", lambda x: x["otype"]).alias("context"))
    heads = headings(corpus, n.select("corpus", "node", "first_slot"))
    refs = heads.select("corpus", "node", section_ref(corpus.section_types).alias("ref"))
    out = n.join(refs, ["corpus", "node"], "left").join(node_text(corpus, n), ["corpus", "node"], "left").join(wide, ["corpus", "node"], "left").join(chain, ["corpus", "node"], "left")
    note = annotations if annotations is not None else n.limit(0).select("node", F.lit(None).cast("string").alias("note"))
    out = out.join(note.select("node", F.col("note").alias("annotation")), "node", "left")
    return out.select("corpus", "node", "otype", (F.col("otype") == corpus.slot_type).alias("is_slot"), "first_slot", "last_slot", "ref", "text", "features", F.coalesce("context", F.array().cast("array<string>")).alias("context"), "annotation")


def contents(corpus: Corpus) -> DataFrame:
    """corpus, kind, name, label, n: an index: a row for each top section with the number of sections right below it (kind
    section), and one for each type with its number of nodes (kind type). R10."""
    top, rest = corpus.section_types[0], corpus.section_types[1:2]
    heads = headings(corpus, corpus.of_type(top)).select("corpus", "node", F.col(top).cast("string").alias("label"))
    if rest:
        below = embedding_pairs(corpus.of_type(top), corpus.of_type(rest[0])).groupBy("corpus", F.col("p_node").alias("node")).agg(F.count(F.lit(1)).alias("n"))
        heads = heads.join(below, ["corpus", "node"], "left")
    else:
        heads = heads.withColumn("n", F.lit(0))
    sections = heads.select("corpus", F.lit("section").alias("kind"), F.col("node").cast("string").alias("name"), "label", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    types = type_statistics(corpus).select("corpus", F.lit("type").alias("kind"), F.col("otype").alias("name"), F.col("otype").alias("label"), "n")
    return sections.unionByName(types)


def stats(corpus: Corpus) -> DataFrame:
    """corpus, name, value: highest slot and node, numbers of types, node features and edge features. A06."""
    n = corpus.nodes.groupBy("corpus").agg(F.max(F.when(F.col("otype") == corpus.slot_type, F.col("node"))).alias("max_slot"), F.max("node").alias("max_node"), F.countDistinct("otype").alias("n_types"))
    f = corpus.node_features.groupBy("corpus").agg(F.countDistinct("feature").alias("n_node_features"))
    e = corpus.edge_features.groupBy("corpus").agg(F.countDistinct("feature").alias("n_edge_features"))
    names = ["max_slot", "max_node", "n_types", "n_node_features", "n_edge_features"]
    wide = n.join(f, "corpus", "left").join(e, "corpus", "left")
    return wide.select("corpus", F.explode(F.array(*[F.struct(F.lit(x).alias("name"), F.coalesce(x, F.lit(0)).cast("long").alias("value")) for x in names])).alias("x")).select("corpus", "x.*")


def stat_differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """corpus, name, a, b where the stats of two loads differ. A07."""
    both = a.toDF("corpus", "name", "a").join(b.toDF("corpus", "name", "b"), ["corpus", "name"], "full_outer")
    return both.where(~F.col("a").eqNullSafe(F.col("b")))


