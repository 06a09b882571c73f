"""Mixing sources to target weights, by a low-discrepancy schedule. DataFrame operations only.

Each source's documents are shuffled (order of a digest of doc_id) into one stream of words, which is
cut into blocks of equal length and read again from the start after its end. Slot k of the schedule
has the van der Corput point of k (its bits reversed); the point falls into one source's share of the
cumulative weights; the slot's rank among that source's slots picks the block.

Scale: ranks and word positions are prefix sums over a source that may hold a third of all rows. They
are taken in two levels, within about sqrt(rows) digest ranges and over the ranges' totals, so no task
sorts a whole source; rows that repeat source, doc_id and size are one group until they are placed, so no
task holds a doc_id that a third of the rows repeat. Texts are read once, for their sizes; only (id,
source, size) rows move. Windows over sources hold one short row for each.

Edge cases: a null text has size 0 and takes nothing; an empty table gives an empty result; a null
source is a source of its own, ranked last; rows that repeat a doc_id are each a document; columns
other than doc_id, text and source are ignored by the schedule, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import n_words, read, shared_table

#: Weights by source, in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: Words of the mix, as a share of all words.
SHARE = 1.5
#: A source is read this many times at most.
EPOCHS = 2
#: Blocks in the mix for each document, on average.
BLOCKS_PER_DOC = 2
_CHUNK = 4096


def _shuffle_key(doc_id: Column) -> Column:
    return F.md5(F.concat(F.lit("mix-"), F.coalesce(doc_id.cast("string"), F.lit("")))) 


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """One row for each source: src (rank from 0), source, source_size, n_docs, target.

    Targets are the water level: weight * level, but epochs * size at most, with the level such that
    they add up to the share of all words. Sources whose cap is reached form a prefix in the order of
    cap / weight, so the level follows from running sums. Its windows hold one row per source.
    """
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.array(*[F.lit(float(x)) for x in weights])
    by = by.withColumn("src", F.row_number().over(order) - 1).withColumn("weight", F.element_at(w, (F.col("src") % len(weights) + 1).cast("int")))
    by = by.withColumn("cap", F.col("source_size") * F.lit(float(epochs)))
    whole = Window.partitionBy()
    filled = Window.orderBy(F.col("cap") / F.col("weight"), "src").rowsBetween(Window.unboundedPreceding, -1)
    by = (
        by.withColumn("total", F.sum("source_size").over(whole) * F.lit(share))
        .withColumn("all_weight", F.sum("weight").over(whole))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(filled), F.lit(0.0)))
        .withColumn("weight_before", F.coalesce(F.sum("weight").over(filled), F.lit(0.0)))
    )
    by = by.withColumn("full", F.col("cap") * (F.col("all_weight") - F.col("weight_before")) <= F.col("weight") * (F.col("total") - F.col("cap_before")))
    level = (F.first("total").over(whole) - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(whole), F.lit(0.0))) / F.nullif(
        F.first("all_weight").over(whole) - F.coalesce(F.sum(F.when(F.col("full"), F.col("weight"))).over(whole), F.lit(0.0)), F.lit(0.0)
    )
    by = by.withColumn("target", F.when(F.col("full"), F.col("cap")).otherwise(level * F.col("weight")))
    return by.select("src", "source", "source_size", "n_docs", "target")


def _prefix(df: DataFrame, group: str, bucket: str, order: list, value: Column, name: str) -> DataFrame:
    """Adds name: the sum of value over the rows of the same group that come earlier in the order of
    (bucket, order). Two levels: no window holds more than one bucket, or one row for each bucket."""
    inner = Window.partitionBy(group, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(group).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = df.groupBy(group, bucket).agg(F.sum(value).alias("_sum"))
    sums = sums.select(group, bucket, F.coalesce(F.sum("_sum").over(outer), F.lit(0)).alias("_before"))
    df = df.withColumn("_inner", F.coalesce(F.sum(value).over(inner), F.lit(0)))
    return df.join(sums.hint("merge"), [group, bucket]).withColumn(name, (F.col("_before") + F.col("_inner")).cast("long")).drop("_before", "_inner", bucket)


def schedule(sources: DataFrame, block: int, bits: int, n_blocks: int, bucket_bits: int) -> DataFrame:
    """Slots (src, rank, slot): slot is the place in the schedule, rank the block of the source.

    sources has src, n_slots, slots_before. The points of slots 0 .. 2**bits - 1 are all multiples of
    2**-bits, so the slots of a source are found by going through the points of its share and
    reversing their bits: no join of slots with shares. 2**bits is at least twice the blocks, so each
    share holds enough points; a source's first n_slots slots count.
    """
    ratio = float(2**bits) / max(n_blocks, 1)
    at = sources.select("src", "n_slots", F.floor(F.col("slots_before") * F.lit(ratio)).alias("lo"), F.floor((F.col("slots_before") + F.col("n_slots")) * F.lit(ratio)).alias("hi"))
    at = at.where("hi > lo").withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(hi - lo - 1) div {_CHUNK}"))))
    at = at.repartition("src", "chunk").withColumn("point", F.explode(F.sequence(F.col("lo") + F.col("chunk") * _CHUNK, F.least(F.col("hi") - 1, F.col("lo") + F.col("chunk") * _CHUNK + _CHUNK - 1))))
    slot = F.conv(F.reverse(F.lpad(F.bin("point"), bits, "0")), 2, 10).cast("long")
    at = at.select("src", "n_slots", slot.alias("slot")).withColumn("_bucket", F.shiftright("slot", max(0, bits - bucket_bits)))
    ranked = _prefix(at, "src", "_bucket", ["slot"], F.lit(1), "rank")
    return ranked.where("rank < n_slots").select("src", "rank", "slot")


def _each_row(groups: DataFrame) -> DataFrame:
    """A row for each of the n documents of a group, one after another from start on; those of large groups are dealt out."""
    few, many = groups.where(f"n <= {_CHUNK}"), groups.where(f"n > {_CHUNK}")
    many = many.withColumn("_chunk", F.explode(F.expr(f"sequence(0, (n - 1) div {_CHUNK})"))).repartition("src", "start", "_chunk")
    rows = few.withColumn("_i", F.explode(F.expr("sequence(0, n - 1)"))).unionByName(many.withColumn("_i", F.explode(F.expr(f"sequence(_chunk * {_CHUNK}, least(n - 1, _chunk * {_CHUNK} + {_CHUNK - 1}))"))).drop("_chunk"))
    return rows.withColumn("start", F.col("start") + F.col("_i") * F.col("size")).drop("_i", "n")


def mix_sources(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> tuple[DataFrame, DataFrame]:
    """(pieces, documents): pieces are the mix, one row for each slot and document in its block (slot,
    source, doc_id, from_word, to_word: words of the document, from 0, epoch); documents has doc_id,
    source, size, source_size, target, taken, first_slot for each document."""
    sizes = shared_table(docs.select("doc_id", "source", n_words(F.col("text")).alias("size")), "mix-sizes")
    sources = shared_table(source_targets(sizes, weights, share, epochs).coalesce(1), "mix-sources")
    n, mixed = sources.agg(F.sum("n_docs"), F.sum("target")).first()
    n, mixed = n or 0, mixed or 0.0
    block = max(1, int(mixed / max(1, BLOCKS_PER_DOC * n)))
    ends = Window.orderBy("src").rowsBetween(Window.unboundedPreceding, -1)
    sources = sources.withColumn("cap_words", F.round("target").cast("long")).withColumn("n_slots", F.ceil(F.col("cap_words") / F.lit(block)))
    sources = sources.withColumn("slots_before", F.coalesce(F.sum("n_slots").over(ends), F.lit(0)))
    n_blocks = sources.agg(F.sum("n_slots")).first()[0] or 0
    bits = max(1, (2 * n_blocks).bit_length())
    bucket_bits = max(1, n.bit_length() // 2)
    slots = shared_table(schedule(sources, block, bits, n_blocks, bucket_bits), "mix-slots")  # as a table its size is known

    key = _shuffle_key(F.col("doc_id"))
    found = sizes.alias("d").join(sources.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.doc_id", "d.source", "d.size", "s.src", "s.source_size", "s.target", "s.cap_words", key.alias("_key"))
    found = found.groupBy("doc_id", "source", "size", "src", "source_size", "target", "cap_words", "_key").agg(F.count(F.lit(1)).alias("n"))
    found = found.withColumn("_bucket", F.shiftright(F.conv(F.substring("_key", 1, 8), 16, 10).cast("long"), 32 - min(32, bucket_bits)))
    groups = shared_table(_prefix(found, "src", "_bucket", ["_key", "doc_id", "size"], F.col("size") * F.col("n"), "start").drop("_key"), "mix-groups")
    placed = shared_table(_each_row(groups), "mix-placed")
    epoch = F.explode(F.sequence(F.lit(0), F.lit(epochs - 1)))
    parts = placed.where("size > 0").select("src", "source", "doc_id", "size", "start", "source_size", "cap_words", epoch.alias("epoch"))
    parts = parts.withColumn("at", F.col("epoch") * F.col("source_size") + F.col("start")).where("at < cap_words")
    parts = parts.withColumn("rank", F.explode(F.sequence(F.expr(f"at div {block}"), F.expr(f"(least(at + size, cap_words) - 1) div {block}"))))
    lo, hi = F.greatest(F.col("at"), F.col("rank") * block), F.least(F.col("at") + F.col("size"), (F.col("rank") + 1) * block, F.col("cap_words"))
    pieces = parts.join(slots, ["src", "rank"]).select("slot", "src", "source", "doc_id", "size", "start", (lo - F.col("at")).alias("from_word"), (hi - F.col("at")).alias("to_word"), "epoch")
    taken = pieces.groupBy("src", "doc_id", "size", "start").agg(F.sum(F.col("to_word") - F.col("from_word")).alias("taken"), F.min("slot").alias("first_slot"))
    taken = taken.withColumnsRenamed({"doc_id": "_id", "size": "_size", "start": "_start", "src": "_src"})
    same = (F.col("src") == F.col("_src")) & F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("size") == F.col("_size")) & (F.col("start") == F.col("_start"))
    out = placed.join(taken.hint("merge"), same, "left").select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "first_slot")
    return pieces.drop("src", "size", "start"), out


def op2_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes all documents; see mix_sources."""
    return mix_sources(read(spark, sf_dir, "documents"))[1].select("doc_id", "size", "source_size", "target", "taken")


#: The same by closed form: a document's share of the first target words of the shuffled stream read twice.
OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS src FROM d GROUP BY source
), w AS (
  SELECT *, CASE src % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS weight, source_size * 2.0::DOUBLE AS cap FROM s
), f AS (
  SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS total, sum(weight) OVER () AS all_weight,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS cap_before,
    coalesce(sum(weight) OVER (ORDER BY cap / weight, src ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weight_before FROM w
), g AS (
  SELECT *, cap * (all_weight - weight_before) <= weight * (total - cap_before) AS is_full FROM f
), t AS (
  SELECT source, source_size, CASE WHEN is_full THEN cap ELSE
    (total - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0)) / nullif(all_weight - coalesce(sum(CASE WHEN is_full THEN weight END) OVER (), 0), 0) * weight END AS target FROM g
), p AS (
  SELECT d.doc_id, d.size, CAST(t.source_size AS BIGINT) AS source_size, t.target, CAST(round(t.target) AS BIGINT) AS cap_words,
    coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix-' || coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CAST(least(size, greatest(0, cap_words - start)) + least(size, greatest(0, cap_words - source_size - start)) AS BIGINT) AS taken
FROM p
"""
