"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item is found in a document if at least PERCENT % of its word shingles (five words; an item of
fewer words is one shingle, its whole sequence) occur there, however long the document is.

Index: items are partitioned by the size of their shingle sets, a power of two each. An item's sketch is
the q least hashes of its set, where q is what its partition's size needs: of n shingles, more than
n - ceil(t n) can't all be missing at containment t, so the n - ceil(t n) + 1 least hashes hold one that
occurs in the document. No item that qualifies is missed, at any document length. A document's hashes are
looked up in the sorted sketch hashes; candidates are verified by exact containment of the full sets.

Scale: documents are read once per block of items and nothing of them is shuffled; the verdict is taken
where the text is. A block of items has about BLOCK_BYTES of text by construction, and only its sketches
and sets are broadcast; a larger benchmark takes more blocks, each compared with all documents.

Edge cases: null or empty texts, on either side, are found nowhere; an empty documents or benchmark table
gives an empty result; an item without an id is found as well, as a null item_id; repeated items and documents give each pair of ids once; other columns are ignored
(pairs) or pass through unchanged (filter).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _words
from ._common import bounded_batches, read

K, PERCENT = 5, 80
#: Text of the items that are looked up at a time.
BLOCK_BYTES = 4 << 20


class Index:
    """Sketches and sets of a block of items, by the shingle length that they need."""

    def __init__(self, ids: list[int | None], texts: list[str], k: int = K, percent: int = PERCENT):
        self.k, self.percent = k, percent
        self.ids = ids
        self.sets: list[np.ndarray] = []
        column = pa.array(texts, pa.large_string())
        raw, offsets = _words.buffers(column)
        h, first = _words.word_hashes(raw, offsets)
        length = np.minimum(np.diff(first), k)
        for _, s, o in _words.shingle_sets(column, k):
            self.sets += [s[o[i] : o[i + 1]] for i in range(len(o) - 1)]
        self.by_length = {}
        for n in sorted(set(length.tolist()) - {0}):
            items = np.flatnonzero(length == n)
            hashes = [self.sketch(self.sets[i]) for i in items]
            values = np.concatenate(hashes)
            owners = np.repeat(items, [len(x) for x in hashes])
            order = np.argsort(values, kind="stable")
            self.by_length[n] = (values[order], owners[order])

    def sketch(self, s: np.ndarray) -> np.ndarray:
        """The least hashes of a set, as many as the upper size of its partition needs."""
        upper = 1 << (len(s) - 1).bit_length() if len(s) else 0
        return s[: upper - -(-upper * self.percent // 100) + 1]

    def found(self, column: pa.Array) -> Iterator[tuple[int, int, int]]:
        """(row, item's place, shared shingles) for each item that a text of the column contains."""
        raw, offsets = _words.buffers(column)
        for i, j in _words.slices(offsets):
            h, first = _words.word_hashes(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            for n, (values, owners) in self.by_length.items():
                sh, owner = _words.shingles(h, first, self.k) if n == self.k else self.runs(h, first, n)
                at = np.searchsorted(values, sh)
                at[at == len(values)] = 0
                hit = np.flatnonzero(values[at] == sh)
                if not len(hit):
                    continue
                last = np.searchsorted(values, sh[hit], side="right")
                count = last - at[hit]
                items = owners[np.repeat(at[hit] - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())]
                pairs = np.unique(np.stack([np.repeat(owner[hit], count), items], 1), axis=0)
                cut = np.searchsorted(owner, np.arange(j - i + 1))
                text, own = -1, None
                for row, item in pairs:
                    if row != text:
                        text, own = row, np.unique(sh[cut[row] : cut[row + 1]])
                    s = self.sets[item]
                    place = np.searchsorted(own, s)
                    place[place == len(own)] = 0
                    shared = int((own[place] == s).sum())
                    if 100 * shared >= self.percent * len(s):
                        yield i + int(row), int(item), shared

    def runs(self, h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of runs of n words, as an item of n words has it."""
        text = np.repeat(np.arange(len(first) - 1), np.diff(first))
        if len(h) < n:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        m = len(h) - n + 1
        out = np.full(m, n, np.uint64) * np.uint64(0xA0761D6478BD642F)
        for j in range(n):
            out += h[j : j + m] * _words._PLACE[j]
        inside = text[:m] == text[n - 1 :]
        return _words.mix(out[inside]), text[:m][inside]


def indexes(benchmark: DataFrame, k: int = K, percent: int = PERCENT) -> Iterator[Index]:
    """An Index for each block of items."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // BLOCK_BYTES)
    for b in range(n):
        block = items.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b) if n > 1 else items
        rows = sorted(block.distinct().toLocalIterator(), key=lambda r: (r[0] is None, r[0] or 0, r[1]))
        if rows:
            yield Index([r[0] for r in rows], [r[1] for r in rows], k, percent)


def leaks(docs: DataFrame, benchmark: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """doc_id, item_id, n_shared, n_shingles (the item's), containment: each item that a document contains."""
    spark = docs.sparkSession
    bounded_batches(spark)
    schema = "doc_id long, item_id long, n_shared long, n_shingles long"
    out = spark.createDataFrame([], schema)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    for index in indexes(benchmark, k, percent):
        shared = spark.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            for x in batches:
                hits = list(index.found(x.column(1)))
                if hits:
                    row, item, n = zip(*hits)
                    yield pa.RecordBatch.from_arrays([x.column(0).take(pa.array(row)).cast(pa.int64()), pa.array([index.ids[i] for i in item], pa.int64()), pa.array(n, pa.int64()), pa.array([len(index.sets[i]) for i in item], pa.int64())], names=["doc_id", "item_id", "n_shared", "n_shingles"])

        out = out.union(texts.mapInArrow(run, schema))
    return out.distinct().withColumn("containment", F.col("n_shared") / F.col("n_shingles"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """docs without those that contain an item. One pass for each block; no shuffle."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index("text")
    for index in indexes(benchmark, k, percent):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for x in batches:
                clean = np.ones(x.num_rows, bool)
                clean[[row for row, _, _ in shared.value.found(x.column(at))]] = False
                yield x.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item in each document that contains it; see leaks."""
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


#: Shingles as text, joined whole: for the small tables only.
OP3_SQL = r"""
WITH i AS (
  SELECT item_id, ws, least(5, len(ws)) AS k FROM (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM benchmark) WHERE len(ws) > 0
), s AS (
  SELECT DISTINCT item_id, k, array_to_string(ws[p:p + k - 1], ' ') AS sh FROM (SELECT item_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM i)
), z AS (
  SELECT item_id, count(*) AS n FROM s GROUP BY item_id
), d AS (
  SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents WHERE text IS NOT NULL
), e AS (
  SELECT DISTINCT doc_id, k, array_to_string(ws[p:p + k - 1], ' ') AS sh
  FROM (SELECT doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) AS p FROM d, (SELECT DISTINCT k FROM i) WHERE len(ws) >= k)
), c AS (
  SELECT e.doc_id, s.item_id, count(*) AS n_shared FROM e JOIN s ON e.sh = s.sh AND e.k = s.k GROUP BY ALL
)
SELECT c.doc_id, c.item_id, n_shared, z.n AS n_shingles, n_shared / z.n AS containment FROM c JOIN z ON c.item_id = z.item_id WHERE 100 * n_shared >= 80 * z.n
"""
