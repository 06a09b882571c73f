"""Trees by path: nodes carry `path`, the zero-padded sibling positions joined by dots (width 8), so that
document order is string order and a subtree is a prefix. H16-H25.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.tables import cut

WIDTH = 8


def pad(ordinal: Column) -> Column:
    text = ordinal.cast("string")
    return F.when(F.length(text) < WIDTH, F.lpad(text, WIDTH, "0")).otherwise(text)


def under(path: Column, top: Column | str) -> Column:
    """Is path at or below top?"""
    top = F.lit(top) if isinstance(top, str) else top
    return (path == top) | path.startswith(F.concat(top, F.lit(".")))


def depth(path: Column) -> Column:
    return F.length(path) - F.length(F.translate(path, ".", ""))


def subtree(nodes: DataFrame, top: str, levels: int) -> DataFrame:
    """Nodes at or below a path, at most `levels` deeper. H16."""
    return nodes.where(under(F.col("path"), top) & (depth(F.col("path")) <= depth(F.lit(top)) + levels))


def ancestors(nodes: DataFrame) -> DataFrame:
    """edition, path, ancestor_path, up for every node: prefixes of its own path, by string functions alone. H17."""
    parts = F.split("path", r"\.")
    up = F.explode(F.sequence(F.lit(1), F.size(parts) - 1)).alias("k")
    found = nodes.where(F.col("path").contains(".")).select("edition", "path", parts.alias("parts"), up)
    return found.select("edition", "path", F.array_join(F.slice("parts", 1, F.col("k")), ".").alias("ancestor_path"), (F.size("parts") - F.col("k")).alias("up"))


def neighbours(nodes: DataFrame) -> DataFrame:
    """nodes with prev_path and next_path: the node before and after at the same level. H18."""
    w = Window.partitionBy("edition", "type").orderBy("path")
    return nodes.withColumns({"prev_path": F.lag("path").over(w), "next_path": F.lead("path").over(w)})


def between(nodes: DataFrame, level: str, start: str, end: str) -> DataFrame:
    """Nodes of a level from a start path to an end path, the end's subtree included. H19."""
    p = F.col("path")
    return nodes.where((F.col("type") == level) & (p >= start) & ((p <= end) | under(p, end)))


def page_after(nodes: DataFrame, cursor: str | None, limit: int) -> DataFrame:
    """The next nodes in path order, one more than the limit if there are more. H20."""
    found = nodes.where(F.col("path") > cursor) if cursor else nodes
    return found.orderBy("path").limit(limit + 1)


def walk_down(nodes: DataFrame, steps: list[tuple[str, str, object]]) -> DataFrame:
    """edition, id: the node that a canonical reference names; a step is (type, "code" or "ref_ordinal", value). H21."""
    found = None
    for kind, by, value in steps:
        here = nodes.where((F.col("type") == kind) & (F.col(by) == F.lit(value))).select("edition", "id", "parent_id")
        found = here.select("edition", "id") if found is None else here.join(found.toDF("edition", "parent_id"), ["edition", "parent_id"]).select("edition", "id")
    return found


def rebuild_paths(nodes: DataFrame) -> DataFrame:
    """edition, id, path from parent and ordinal alone: one join for each level, each computed once. H23."""
    below = nodes.select("edition", "id", "parent_id", "ordinal")
    level = cut(nodes.where("parent_id is null").select("edition", "id", pad(F.col("ordinal")).alias("path")))
    out = level
    while not level.isEmpty():
        up = level.select("edition", F.col("id").alias("parent_id"), F.col("path").alias("up"))
        level = cut(below.join(up, ["edition", "parent_id"]).select("edition", "id", F.concat_ws(".", "up", pad(F.col("ordinal"))).alias("path")))
        out = out.unionByName(level)
    return out


def reference_levels(nodes: DataFrame) -> DataFrame:
    """nodes with ref_ordinal: from 1 among the siblings of a type. H24, W02."""
    return nodes.withColumn("ref_ordinal", F.row_number().over(Window.partitionBy("edition", "parent_id", "type").orderBy("ordinal")))


def structure_errors(members: DataFrame) -> DataFrame:
    """structure, node, error: missing_parent, self_parent or cycle (of any length, or hanging on one). H25.

    Every node looks one step up, then two, four and so on, until it sees where its way ends: at a root or at a missing
    parent. The rounds are as many as the logarithm of the depth; whoever sees no end is on a cycle or hangs on one.
    """
    ids = members.select("structure", F.col("node").alias("parent"), F.lit(True).alias("there")).distinct()
    end = F.when(F.col("parent").isNull(), "root").when(F.col("there").isNull(), "missing")
    seen = cut(members.join(ids, ["structure", "parent"], "left").select("structure", "node", F.col("parent").alias("up"), end.alias("end"), (end == "missing").alias("first")))
    first = seen.where("first").select("structure", "node", F.lit("missing_parent").alias("error"))
    owners = members.select("structure", "node", (F.col("node") == F.col("parent")).alias("own"))
    open_ = seen.where("end is null").count()
    while open_:
        above = seen.select("structure", F.col("node").alias("up"), F.col("up").alias("up2"), F.col("end").alias("end2"))
        both = seen.join(above, ["structure", "up"], "left")
        seen = cut(both.select("structure", "node", F.when(F.col("end").isNull(), F.col("up2")).alias("up"), F.coalesce("end", "end2").alias("end")).distinct())
        left = seen.where("end is null").count()
        if left == open_:
            break
        open_ = left
    error = F.when(F.col("own"), "self_parent").otherwise("cycle")
    return first.unionByName(seen.where("end is null").join(owners, ["structure", "node"]).select("structure", "node", error.alias("error")))
