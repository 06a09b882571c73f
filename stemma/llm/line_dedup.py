r"""Line dedup over overlapping three-line windows. DataFrame operations only.

Lines are the \n-separated parts of a text. Every three consecutive lines form a window; a window that
holds a character other than white space counts. Of equal windows in the whole corpus, the first in the
order of (doc_id, text digest, line number) stays; the lines that any later occurrence covers go, the
covered positions of a document merged. Every removed line's wording still stands at an earlier place.

Scale: windows travel as two 64-bit hashes and a position, never as text. The repeated windows come from
an aggregation with map-side combine; a window that a third of the corpus shares is one row there, and
the join back streams its occurrences, which adaptive execution can split. Texts are shuffled once, by
document, to meet their own covered positions.

Edge cases: a null or empty text, and one of fewer than three lines, stays as it is; an empty table gives
an empty result; rows that repeat doc_id and text are one document and get the same result; rows with one
doc_id and different texts are different documents; other columns pass through, and names that clash with
n_lines or n_removed are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import let, read

WINDOW = 3


def _windows(docs: DataFrame, width: int) -> DataFrame:
    """__line_id, __line_text (digest), pos, h1, h2 for each window."""
    lines = F.split("text", "\n", -1)

    def of(ls):
        starts = F.when(F.size(ls) >= width, F.sequence(F.lit(0), F.size(ls) - width)).otherwise(F.array().cast("array<int>"))
        part = lambda i: [F.get(ls, i + k) for k in range(width)]
        hashed = F.transform(starts, lambda i: F.struct(i.alias("pos"), F.xxhash64(*part(i)).alias("h1"), F.xxhash64(F.lit(7), *part(i)[::-1]).alias("h2"), F.concat(*part(i)).rlike(r"\S").alias("full")))
        return F.filter(hashed, lambda w: w["full"])

    found = docs.select(F.col("doc_id").alias("__line_id"), F.xxhash64("text").alias("__line_text"), F.explode(let(lines, of)).alias("w"))
    return found.select("__line_id", "__line_text", "w.pos", "w.h1", "w.h2")


def covered_lines(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """__line_id, __line_text, __line_covered: the sorted line numbers that later occurrences of repeated windows cover."""
    windows = _windows(docs, width)
    place = F.struct("__line_id", "__line_text", "pos")
    repeated = windows.groupBy("h1", "h2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    later = windows.join(repeated, ["h1", "h2"]).where(~place.eqNullSafe(F.col("first")))
    starts = later.groupBy("__line_id", "__line_text").agg(F.collect_set("pos").alias("starts"))
    covered = F.array_sort(F.array_distinct(F.flatten(F.transform("starts", lambda s: F.array(*[s + k for k in range(width)])))))
    return starts.select("__line_id", "__line_text", covered.alias("__line_covered"))


def line_dedup(docs: DataFrame, width: int = WINDOW) -> DataFrame:
    """docs with text less its covered lines, and n_lines, n_removed."""
    covered = covered_lines(docs, width)
    out = docs.withColumn("__line_digest", F.xxhash64("text")).join(covered, F.col("doc_id").eqNullSafe(F.col("__line_id")) & (F.col("__line_digest") == F.col("__line_text")), "left")
    n = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n", -1)))
    left = let(
        F.split("text", "\n", -1),
        lambda ls: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("__line_covered")), lambda i: F.get(ls, i)), "\n"),
    )
    gone = F.when(F.col("__line_covered").isNull(), 0).otherwise(F.size("__line_covered"))
    out = out.withColumn("n_lines", n.cast("long")).withColumn("n_removed", gone.cast("long"))
    out = out.withColumn("text", F.when(F.col("__line_covered").isNull(), F.col("text")).otherwise(left))
    return out.drop("__line_digest", "__line_id", "__line_text", "__line_covered")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the text that is left, for each document."""
    return line_dedup(read(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_removed", "text")


OP1_SQL = r"""
WITH d AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents
), w AS (
  SELECT doc_id, pos - 1 AS pos, ls[pos] || chr(10) || ls[pos + 1] || chr(10) || ls[pos + 2] AS win
  FROM (SELECT doc_id, ls, unnest(range(1, len(ls) - 1)) AS pos FROM d)
), c AS (
  SELECT doc_id, pos, row_number() OVER (PARTITION BY win ORDER BY doc_id, pos) AS k FROM w WHERE regexp_matches(win, '\S')
), g AS (
  SELECT DISTINCT doc_id, pos + o AS pos FROM c, (SELECT unnest([0, 1, 2]) AS o) WHERE k > 1
), l AS (
  SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS pos FROM d
), k AS (
  SELECT l.doc_id, count(*) AS n_lines, count(g.pos) AS n_removed, string_agg(CASE WHEN g.pos IS NULL THEN l.line END, chr(10) ORDER BY l.pos) AS left_text
  FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id
)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed,
  CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.left_text, '') END AS text
FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
