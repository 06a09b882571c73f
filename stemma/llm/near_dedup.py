"""Near duplicates by HyperMinHash signatures, banding, exact verification and connected components.

Signature: the shingle hashes of a text fall into REGISTERS buckets; of each bucket's least hash the
register keeps the count of leading zeros and MANTISSA bits after the first one (16 bits in all). Empty
registers copy a full one by a fixed pseudo-random choice, so short texts band like long ones. BANDS bands
of 6 registers are the join keys: a pair at 80 % shares none of them with a chance of about 5e-7.

Candidates: texts with equal sets form a class with a number of its own, so exact copies never pair up and
classes, not doc_ids, are what is linked. In a bucket (band and key), the smallest member, the pivot p, is
compared with every other: pairs grow with the members, not with their square. The estimate of the Jaccard
similarity, corrected for registers that agree by chance, drops pairs far below the limit; the rest are
confirmed on full sets.

Where the members of a bucket still lie in several components, exact bounds decide, without a cap. With u
shingles that no such class outside its component has, a partner of A there has at most 1.25 |A| - 2.25 u
shingles; where that is less than 0.8 |A|, A is done. The others are compared with their bucket's hub p, the
member with the most links so far. Two members A and B besides it can then only be linked in two ways, and
both are looked up:
  (i) they share a shingle that p lacks. In the order "shingles that p lacks, rare ones first, then those of
      p", the first shared one is among the first |A| - ceil(0.8 |A|) + 1 of A, and of B likewise: an equi-join
      on (p, shingle), which also holds the sizes, and what comes after that place, to what they allow.
  (ii) all they share is in p. Then |A & B| <= |A & p| and |A | B| >= |B| + |A - p|, and the same with A and B
      exchanged, which leaves few pairs.
So a group of copies with thousands of edits, near the limit or beyond it, costs about its own length.

Scale: one pass over the texts writes 600 bytes a document; bands move 8-byte keys. Signatures and texts
move only for classes in candidate pairs, picked by a broadcast filter of bounded size and then by an exact
join. Components come from min-label rounds with pointer jumping over the link table; nothing about
documents is collected. Skew (a class or bucket with a third of all rows) is met by map-side minima and by
joins whose large side adaptive execution can split. All tables but the two that the result reads are
deleted when it is built.

Edge cases: a null or empty text, or one without words, has an empty set and is linked with nothing; fewer
words than a shingle count as one shingle; rows that repeat a doc_id are one document of several texts, so
what is linked with any of them is in its component; a null doc_id joins its class but is never kept and
names no component (a class of such rows alone has a null one); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from . import _words
from ._common import Tables, bounded_batches, in_parts, narrow, read

REGISTERS, BANDS, MANTISSA = 288, 48, 10
ROWS = REGISTERS // BANDS
#: Least short rows of a task, and least pairs to estimate or to compare.
SHORT, PAIRS, TEXTS = 50_000, 5_000, 500
PERCENT = 80
#: The estimate's standard deviation is at most 0.024 at 80 %; pairs more than six of them below go.
SLACK = 0.15
#: Below this many shingles, copied registers widen the estimate: such pairs are always confirmed.
SMALL = 64
_U = np.uint64
_DONORS = np.random.default_rng(7).integers(0, REGISTERS, (256, REGISTERS))
_SIGNED = "doc_id long, text_hash long, n_shingles long, h1 long, h2 long, signature binary"


def registers(sets: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of REGISTERS 16-bit registers for each set; zeros for an empty one."""
    n = len(offsets) - 1
    owner = np.repeat(np.arange(n), np.diff(offsets))
    low = np.full(n * REGISTERS, 1 << 57, _U)
    bucket = ((sets >> _U(32)) * _U(REGISTERS) >> _U(32)).astype(np.int64)
    np.minimum.at(low, owner * REGISTERS + bucket, _words.mix(sets) >> _U(7))
    full = low < _U(1 << 57)
    m, e = np.frexp(low.astype(np.float64) + 1)
    reg = ((58 - np.minimum(e, 57)) << MANTISSA) | ((m * 2 - 1) * (1 << MANTISSA)).astype(np.int64)
    reg = np.where(full, reg, 0).astype(np.uint16).reshape(n, REGISTERS)
    todo = np.flatnonzero((reg == 0).any(1) & (reg != 0).any(1))
    part, was = reg[todo].copy(), reg[todo]
    for donors in _DONORS:
        if not len(todo) or not (part == 0).any():
            break
        part = np.where(part == 0, was[:, donors], part)
    rest = np.flatnonzero((part == 0).any(1))
    if len(rest):
        first = was[rest, (was[rest] != 0).argmax(1)]
        part[rest] = np.where(part[rest] == 0, first[:, None], part[rest])
    reg[todo] = part
    return reg


def _sign(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, sets, offsets in _words.shingle_sets(batch.column(2), k):
                n = len(offsets) - 1
                size = np.diff(offsets)
                add = lambda x: np.diff(np.concatenate([[_U(0)], np.cumsum(x, dtype=_U)])[offsets])  # noqa: B023, E731
                rows = registers(sets, offsets).tobytes()
                wide = REGISTERS * 2
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(i, n), batch.column(1).slice(i, n), pa.array(size, pa.int64()), pa.array(add(_words.mix(sets + _U(1))).view(np.int64)), pa.array(add(_words.mix(sets ^ _U(0x5851F42D4C957F2D))).view(np.int64)),
                    pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(n + 1, dtype=np.int32) * wide), pa.py_buffer(rows)]),
                ], names=["doc_id", "text_hash", "n_shingles", "h1", "h2", "signature"])

    return run


def signatures(docs: DataFrame, k: int) -> DataFrame:
    """doc_id, text_hash, n_shingles, h1 and h2 (a digest of the set), signature."""
    return docs.select(F.col("doc_id").cast("long"), F.xxhash64("text"), "text").mapInArrow(_sign(k), _SIGNED)


def estimate(a: np.ndarray, b: np.ndarray, na: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """Jaccard similarity by equal registers, less those that are expected to agree by chance."""
    ratio = na / nb
    chance = 0.169919487159739093975315012348 * 2.0**-MANTISSA * 4 * ratio / (1 + ratio) ** 2
    return (((a == b) & (a > 0)).mean(1) - chance) / (1 - chance)


def _table(column: pa.Array) -> np.ndarray:
    raw = pc.cast(column, pa.binary(REGISTERS * 2)) if not pa.types.is_fixed_size_binary(column.type) else column
    return np.frombuffer(raw.buffers()[1], np.uint16)[raw.offset * REGISTERS : (raw.offset + len(raw)) * REGISTERS].reshape(-1, REGISTERS)


def _likely(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if not x.num_rows:
                continue
            na, nb = x.column("na").to_numpy(), x.column("nb").to_numpy()
            near = estimate(_table(x.column("sa")), _table(x.column("sb")), na, nb) >= percent / 100 - SLACK
            keep = (near | (np.minimum(na, nb) < SMALL)) & (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb))
            yield x.select(["a", "b"]).filter(pa.array(keep))

    return run


def likely_pairs(pairs: DataFrame, heads: DataFrame, percent: int, n: int) -> DataFrame:
    """The pairs (a, b), n of them, whose sizes and estimate allow the similarity. heads: c, n_shingles, signature."""
    some = narrow(heads.select("c", "n_shingles", "signature"), F.xxhash64("c"), members(pairs), F.xxhash64("c"))
    both = pairs.join(some.toDF("b", "nb", "sb").hint("merge"), "b").join(some.toDF("a", "na", "sa").hint("merge"), "a")
    return in_parts(both.select("a", "b", "na", "nb", "sa", "sb"), n, PAIRS).mapInArrow(_likely(percent), "a long, b long")


def members(pairs: DataFrame) -> DataFrame:
    """c: the classes in pairs (a, b)."""
    return pairs.select("a").union(pairs.select("b")).distinct().toDF("c")


def _compare(k: int, percent: int):
    def sets(ids: pa.Array, texts: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
        """The place of each row's set among the sets, and the sets: neighbours with one id share one."""
        row = ids.to_numpy()
        new = np.concatenate([[True], row[1:] != row[:-1]])
        own = [s[o[i] : o[i + 1]] for _, s, o in _words.shingle_sets(texts.filter(pa.array(new)), k) for i in range(len(o) - 1)]
        return np.cumsum(new) - 1, own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if not x.num_rows:
                continue
            (at, sa), (bt, sb) = sets(x.column("a"), x.column("ta")), sets(x.column("b"), x.column("tb"))
            shared = np.zeros(x.num_rows, np.int64)
            for i in range(x.num_rows):
                p, q = sa[at[i]], sb[bt[i]]
                if len(p):
                    shared[i] = (p[np.minimum(np.searchsorted(p, q), len(p) - 1)] == q).sum()
            size = lambda t, s: pa.array(np.array([len(y) for y in s], np.int64)[t])
            yield pa.RecordBatch.from_arrays([x.column("a"), x.column("b"), size(at, sa), size(bt, sb), pa.array(shared)], names=["a", "b", "na", "nb", "shared"])

    return run


def compare(pairs: DataFrame, texts: DataFrame, k: int, percent: int, n: int) -> DataFrame:
    """a, b, na, nb (sizes of their full shingle sets) and shared of pairs (a, b), n of them."""
    both = pairs.join(texts.toDF("b", "tb").hint("merge"), "b").join(texts.toDF("a", "ta").hint("merge"), "a")
    return in_parts(both.select("a", "b", "ta", "tb"), n, TEXTS).mapInArrow(_compare(k, percent), "a long, b long, na long, nb long, shared long")


def linked(percent: int) -> str:
    return f"shared > 0 and 100 * shared >= {percent} * (na + nb - shared)"


def components(links: DataFrame, table: Tables) -> DataFrame:
    """c, component: the least class reachable, for each class in links (a, b). Min-label rounds with pointer jumping."""
    edges = table(in_parts(links.select("a", "b").union(links.select("b", "a")).distinct().toDF("u", "v"), table.rows["links"], SHORT), "edges")
    few = lambda d: in_parts(d, table.rows["edges"], SHORT)
    first = edges.groupBy("u").agg(F.least("u", F.min("v")).alias("l"))
    labels = table(few(first.join(first.toDF("l", "ll"), "l").select("u", F.least("l", "ll").alias("l"))), "labels")
    changed = table.rows["labels"]
    while changed:
        least = edges.join(labels.toDF("v", "lv"), "v").groupBy("u").agg(F.min("lv").alias("ln"))
        near = labels.join(least, "u").select("u", F.col("l").alias("old"), F.least("l", "ln").alias("l"))
        far = near.join(labels.toDF("l", "ll"), "l", "left")
        seen = Observation("changed")
        new = far.select("u", F.least("l", F.coalesce("ll", "l")).alias("l"), "old").observe(seen, F.count_if(F.col("l") != F.col("old")).alias("changed"))
        labels = table(few(new.select("u", "l")), "labels")
        changed = seen.get["changed"]
    return labels.toDF("c", "component")


def near_dedup(docs: DataFrame, k: int = 5, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each document; see the module's text."""
    spark = docs.sparkSession
    bounded_batches(spark)
    with Tables(spark) as table:
        signed = table(signatures(docs, k), "signatures")
        key = ["h1", "h2", "n_shingles"]
        row = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("row")
        ids = signed.where("n_shingles > 0").groupBy(*key).agg(row).select(*key, "row.no_id", F.col("row.doc_id").alias("rep"), "row.text_hash")
        # numbers follow the least doc_id, so a component's least class has its least doc_id
        order = ["no_id", "rep", "h1", "h2", "n_shingles"]
        ids = table(ids.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("c", F.monotonically_increasing_id()).drop("no_id"), "ids")
        heads = signed.where("n_shingles > 0").groupBy(*key).agg(F.first("signature").alias("signature"))
        heads = table(heads.join(ids.hint("merge"), key).select("c", "rep", "text_hash", "n_shingles", "signature"), "classes")
        rows = table.keep(signed.join(ids.drop("text_hash").hint("merge"), key, "left").select("doc_id", "n_shingles", "c", "rep"), "near-rows")
        by = components(links(docs, rows, heads, k, percent, table), table)  # of the table named links
        named = by.join(ids.select(F.col("c").alias("component"), F.col("rep").alias("component_id")), "component")
        by = table.keep(named.select("c", "component_id"), "near-components")
    component = F.coalesce("component_id", "rep", "doc_id")
    return rows.join(by.hint("merge"), "c", "left").select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept"))


def shared_ids(rows: DataFrame) -> DataFrame:
    """(a, b): classes of rows that repeat a doc_id with different texts."""
    several = rows.where("c is not null and doc_id is not null").groupBy("doc_id").agg(F.min("c").alias("a"), F.max("c").alias("z")).where("a < z")
    return rows.join(several.hint("merge"), "doc_id").where("c <> a").select("a", F.col("c").alias("b")).distinct()


def links(docs: DataFrame, rows: DataFrame, heads: DataFrame, k: int, percent: int, table: Tables) -> DataFrame:
    """(a, b): links between classes, enough of them for the components of all. rows: doc_id and c; heads: the classes."""
    key = lambda i: F.xxhash64(i, F.substring("signature", i * (2 * ROWS) + 1, F.lit(2 * ROWS)))
    banded = heads.select("c", F.explode(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), key)).alias("k"))
    pivots = table(banded.groupBy("k").agg(F.min("c").alias("pivot"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"), "pivots")
    banded = table(narrow(banded, F.col("k"), pivots, F.col("k")).join(pivots.hint("merge"), "k"), "buckets")
    n = table.rows["buckets"]
    fresh = table(in_parts(banded.where("c <> pivot").select(F.col("pivot").alias("a"), F.col("c").alias("b")).distinct(), n, SHORT), "fresh")
    likely = table(likely_pairs(fresh, heads, percent, table.rows["fresh"]), "likely")
    texts = with_texts(docs, heads, members(likely), None, table)
    found = table(compare(likely, texts, k, percent, table.rows["likely"]).where(linked(percent)).select("a", "b").union(shared_ids(rows)), "links")
    by = components(found, table)
    open_ = unresolved(banded, by, table, n)
    if not table.rows["unresolved"]:
        return found
    # peel: shingles that only classes of its own component have bound how large a partner from another can be
    texts = with_texts(docs, heads, open_.select("c").distinct(), texts, table)
    own = table(with_components(shingle_rows(texts.join(open_.select("c").distinct(), "c", "left_semi"), k), by), "shingles")
    wide = own.groupBy("t").agg(F.min("component").alias("lo"), F.max("component").alias("hi"), F.count(F.lit(1)).alias("df")).where("lo < hi").select("t", "df")
    shingle = table(own.join(wide.hint("merge"), "t").select("c", "t", "df"), "wide")
    alone = own.groupBy("c").agg(F.count(F.lit(1)).alias("n")).join(shingle.groupBy("c").agg(F.count(F.lit(1)).alias("w")), "c", "left")
    size = sizes(heads, open_, alone.select("c", (F.col("n") - F.coalesce("w", F.lit(0))).alias("alone")), percent, table)
    open_ = unresolved(open_.join(size.select("c"), "c"), by, table, table.rows["unresolved"])
    if not table.rows["unresolved"]:
        return found
    degree = members_degree(found)
    hubs = open_.join(degree, "c", "left").groupBy("k").agg(F.max(F.struct(F.coalesce("degree", F.lit(0)).alias("d"), (-F.col("c")).alias("i"))).alias("hub")).select("k", (-F.col("hub.i")).alias("a"))
    met = table(in_parts(open_.join(hubs, "k").where("c <> a").select("a", F.col("c").alias("b")).distinct(), table.rows["unresolved"], SHORT), "met")
    seen = table(compare(met, texts, k, percent, table.rows["met"]), "seen")
    found = table(found.union(seen.where(linked(percent)).select("a", "b")), "links")
    by = components(found, table)
    group = with_components(seen.withColumnRenamed("b", "c"), by).join(size.select("c", "n", "alone", "most"), "c")
    group = table(in_parts(group.join(by.toDF("a", "hub_component"), "a", "left"), table.rows["met"], SHORT), "group")
    extra = table(inside_pairs(group, percent, table).union(outside_pairs(group, shingle, percent, table)).distinct(), "extra")
    likely = table(likely_pairs(extra, heads, percent, table.rows["extra"]), "likely")
    return table(found.union(compare(likely, texts, k, percent, table.rows["likely"]).where(linked(percent)).select("a", "b")), "links")


def members_degree(found: DataFrame) -> DataFrame:
    """c, degree: the number of links of each class."""
    return found.select("a").union(found.select("b")).groupBy(F.col("a").alias("c")).agg(F.count(F.lit(1)).alias("degree"))


def sizes(heads: DataFrame, rows: DataFrame, alone: DataFrame, percent: int, table: Tables) -> DataFrame:
    """c, n, alone, most of the classes in rows that can have a partner: most is its largest size, given alone
    shingles that the partner can't have."""
    some = rows.select("c").distinct()
    size = narrow(heads.select("c", F.col("n_shingles").alias("n")), F.xxhash64("c"), some, F.xxhash64("c"))
    size = size.join(some, "c").join(alone, "c", "left")
    size = size.select("c", "n", F.coalesce("alone", F.lit(0)).alias("alone"), F.expr(f"(100 * n - {100 + percent} * coalesce(alone, 0)) div {percent}").alias("most"))
    return table(in_parts(size.where(f"most >= ({percent} * n + 99) div 100"), table.rows["unresolved"], SHORT), "sizes")


def unresolved(rows: DataFrame, by: DataFrame, table: Tables, n: int) -> DataFrame:
    """The rows (k, c, pivot), n of them, of buckets whose members besides the pivot lie in several components."""
    named = with_components(rows, by)
    several = named.where("c <> pivot").groupBy("k").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("k")
    return table(in_parts(rows.join(several, "k", "left_semi").select("k", "c", "pivot"), n, SHORT), "unresolved")


def _explode(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ids = x.column(0)
            for i, sets, offsets in _words.shingle_sets(x.column(1), k):
                owner = np.repeat(np.arange(i, i + len(offsets) - 1), np.diff(offsets))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(owner)), pa.array(sets.view(np.int64))], names=["c", "t"])

    return run


def shingle_rows(texts: DataFrame, k: int) -> DataFrame:
    """c, t: each distinct shingle of each text."""
    return texts.select("c", "text").mapInArrow(_explode(k), "c long, t long")


def with_components(rows: DataFrame, by: DataFrame) -> DataFrame:
    """rows with the component of each class, itself if it has no link."""
    return rows.join(by, "c", "left").withColumn("component", F.coalesce("component", "c"))


def with_texts(docs: DataFrame, heads: DataFrame, wanted: DataFrame, texts: DataFrame | None, table: Tables) -> DataFrame:
    """texts (c, text) with a text of all wanted classes (c)."""
    if texts is not None:
        wanted = table(in_parts(wanted.join(texts.select("c"), "c", "left_anti"), table.rows["unresolved"], SHORT), "wanted")
        if not table.rows["wanted"]:
            return texts
    some = narrow(heads.select("c", "rep", "text_hash"), F.xxhash64("c"), wanted, F.xxhash64("c")).join(wanted, "c", "left_semi")
    # a row without an id is known by its text alone
    some = table(some.select("c", F.coalesce("rep", F.lit(0)).cast("long").alias("id"), "text_hash"), "wanted")
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64("text").alias("text_hash"), "text")
    rows = narrow(rows, F.xxhash64("id", "text_hash"), some, F.xxhash64("id", "text_hash"))
    rows = rows.groupBy("id", "text_hash").agg(F.first("text").alias("text"))
    more = table(rows.join(some.hint("merge"), ["id", "text_hash"]).select("c", "text"), "texts")
    return more if texts is None else texts.union(more)


def inside_pairs(seen: DataFrame, percent: int, table: Tables) -> DataFrame:
    """(a, b): pairs of case (ii). seen: a is the hub, c the member, with sizes, shared and component. Both sides are
    tables, so that adaptive execution can split a hub's members at each join."""
    within = seen.where(f"100 * shared >= {percent} * nb").select("a", F.col("c").alias("b"), "nb", "shared", (F.col("nb") - F.col("shared")).alias("more"), "component", F.expr(linked(percent)).alias("near"))
    rows = table.rows["group"]
    least = within.groupBy("a").agg(F.min("nb").alias("least"))
    x = table(within.where("not near").join(least, "a").where(f"100 * shared >= {percent} * (least + more)").drop("least", "near").transform(in_parts, rows, SHORT), "inside")
    most = x.groupBy("a").agg(F.max(F.expr(f"100 * shared div {percent} - more")).alias("top"))
    y = table(within.drop("near").join(most, "a").where("nb <= top").drop("top").toDF("a", "b2", "nb2", "shared2", "more2", "component2").transform(in_parts, rows, SHORT), "partners")
    both = x.join(y.hint("merge"), "a").where(f"b <> b2 and component <> component2 and 100 * shared >= {percent} * (nb2 + more) and 100 * shared2 >= {percent} * (nb + more2)")
    return both.select(F.least("b", "b2").alias("a"), F.greatest("b", "b2").alias("b"))


def outside_pairs(seen: DataFrame, shingle: DataFrame, percent: int, table: Tables) -> DataFrame:
    """(a, b): pairs of case (i), of members of which one at least isn't in the hub's component. shingle (c, t, df)
    has what classes of several components have. A pair counts at its first common shingle only."""
    keyed = seen.select("a", "c", "n", "alone", "most", "component", "hub_component").join(shingle.hint("merge"), "c")
    keyed = keyed.join(shingle.select(F.col("c").alias("a"), "t").hint("merge"), ["a", "t"], "left_anti")
    rare = Window.partitionBy("a", "c").orderBy("df", "t")
    keyed = keyed.withColumn("place", F.row_number().over(rare)).where(f"place <= n - ({percent} * n + 99) div 100 - alone + 1")
    keyed = keyed.withColumn("before", F.collect_list("t").over(rare.rowsBetween(Window.unboundedPreceding, -1)))
    # left: what the class can share from here on, t included
    left = (F.col("n") - F.col("alone") - F.col("place") + 1).alias("left")
    keyed = table(keyed.select("a", "t", "c", "n", "most", left, "component", F.coalesce(F.col("component") != F.col("hub_component"), F.lit(True)).alias("out"), "before"), "keyed")
    several = keyed.groupBy("a", "t").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("a", "t")
    keyed = table(keyed.join(several.hint("merge"), ["a", "t"], "left_semi"), "keyed")
    x, y = keyed.where("out").toDF("a", "t", "b", "n", "most", "left", "p", "out", "before"), keyed.toDF("a", "t", "b2", "n2", "most2", "left2", "p2", "out2", "before2")
    both = x.join(y.hint("merge"), ["a", "t"]).where(f"p <> p2 and n <= most2 and n2 <= most and (b < b2 or not out2) and {100 + percent} * least(left, left2) >= {percent} * (n + n2) and not arrays_overlap(before, before2)")
    return both.select(F.least("b", "b2").alias("a"), F.greatest("b", "b2").alias("b"))


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near duplicates among all documents, on shingles of four words; see near_dedup."""
    return near_dedup(read(spark, sf_dir, "documents"), k=4)
