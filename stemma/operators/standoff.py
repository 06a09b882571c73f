"""Documents as rows and back, anchors and positions, rules of graphs, and second chances by alignment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def rows_of(documents: DataFrame, key: str, parts: str) -> DataFrame:
    """key, ordinal and the fields of each part of documents (key, parts: an array of structs), in order. S33."""
    return documents.select(key, F.posexplode(parts).alias("ordinal", "part")).select(key, "ordinal", "part.*")


def restored(rows: DataFrame, key: str, parts: str = "parts") -> DataFrame:
    """key, parts: the inverse of rows_of; nothing is lost but documents without parts. S33."""
    fields = [c for c in rows.columns if c not in (key, "ordinal")]
    listed = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("ordinal", F.struct(*fields).alias("part")))).alias("x"))
    return listed.select(key, F.transform("x", lambda v: v["part"]).alias(parts))


def anchored(spans: DataFrame, keys: list[str], start: str, stop: str) -> DataFrame:
    """keys, start, stop, kind, n: equal spans share an anchor, a zero-length one is a position; n nodes use it. S34."""
    kind = F.when(F.col(start) == F.col(stop), "position").otherwise("anchor")
    return spans.groupBy(*keys, start, stop).agg(F.count(F.lit(1)).alias("n")).withColumn("kind", kind)


def broken_rules(entities: DataFrame, key: str, rules: dict[str, Column]) -> DataFrame:
    """key, error: every rule that an entity breaks, not only the first; rules: the condition of each error. S24."""
    found = F.array_compact(F.array(*[F.when(condition, F.lit(code)) for code, condition in rules.items()]))
    return entities.select(key, F.explode(found).alias("error"))


def aligned(asked: DataFrame, targets: DataFrame, alignments: DataFrame) -> DataFrame:
    """id, target, via of what is asked (id, key): the target (key, target) itself, else that of the key it is aligned with
    (key, aligned), else none. L35."""
    direct = asked.join(targets.select("key", F.col("target").alias("a")), "key", "left")
    other = alignments.join(targets.select(F.col("key").alias("aligned"), F.col("target").alias("b")), "aligned").groupBy("key").agg(F.min("b").alias("b"))
    both = direct.join(other, "key", "left")
    via = F.when(F.col("a").isNotNull(), "direct").when(F.col("b").isNotNull(), "aligned").otherwise("none")
    return both.select("id", F.coalesce("a", "b").alias("target"), via.alias("via"))


def within(groups: DataFrame, key: str, value: str, allowed: list) -> DataFrame:
    """key, within: are all values of a group among those allowed? One aggregation. X04."""
    return groups.groupBy(key).agg(F.coalesce(F.bool_and(F.col(value).isin(allowed)), F.lit(True)).alias("within"))


def group_state(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """key, state: a digest of all rows of a group, whatever order they are read in. A13."""
    row = F.sha2(F.concat_ws("|", *[F.col(f).cast("string") for f in fields]), 256)
    return rows.groupBy(key).agg(F.sha2(F.array_join(F.array_sort(F.collect_list(row)), ""), 256).alias("state"))
