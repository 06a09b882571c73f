r"""License scans by ordered signature rules. DataFrame operations only.

A text is lower-cased (A-Z) and its words, [^\x00-\x2F\x3A-\x60\x7B-\x7F]+, are written with a space on
either side, " w1  w2  w3 ", so that a rule is a regular expression over whole words. The rules, some three
hundred, were written by hand (license_rules): sentences of license texts and notices first, then names
with their versions, then short names; each is tried only on texts that hold its keyword, and texts without
any of the anchors are not normalized at all. A detection inside the interval of another is suppressed, as is the one of
lower priority where two intervals are equal; partly overlapping ones both stay. The three base phrases
are rules too and are never suppressed.

Scale: one pass finds words and anchors inside the row; only detections (rule, position) and word counts
are shuffled, by document. The rules are a constant in the plan.

Edge cases: a null or empty text has no words, no labels and score 0; an empty table gives an empty
result; rows that repeat doc_id and text are one document, each with the same result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import let, read
from .license_rules import RULES

_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Over the raw text in lower case: any rule's match holds one of these, or "cc" and "by" with a gap between them.
ANCHORS = ("licen", "spdx", "gpl", "bsd", "apache", "mpl", "epl", "software", "hereby", "copyright", "domain", "creative", "cc0", "redistribut", "exception", "permission", "consortium", "proprietary", "unauthorized", "perl", "wtfpl", "gfdl", "cddl", "eupl", "openrail")
CC_BY = "cc" + _GAP + "by"

#: Base phrases and their labels.
BASE = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
BASE_WEIGHT = 0.9


def _pattern(words: str) -> str:
    out = ""
    for w in re.findall(r"\([^)]*\)\??|\S+", words):
        body = w.removesuffix("?")
        body = f" {'(?:' + body[1:-1].replace(' ', '  ') + ')' if body[0] == '(' else body} "
        out += "(?: [^ ]+ ){0,12}" if w == "..." else f"(?:{body})?" if w[-1] == "?" else body
    return out


def rules() -> list[tuple[int, str, str, str, float, bool]]:
    """(priority, keyword, label, pattern, weight, base), the most particular first; the base phrases before all."""
    found = [(words.split()[-2] if label == "mit" else words.split()[0], label, _pattern(words), BASE_WEIGHT, True) for words, label in BASE]
    for line in RULES.strip().split("\n"):
        label, keyword, weight, words = line.split("; ")
        found.append((keyword, label, _pattern(words), float(weight), False))
    return [(i, *x) for i, x in enumerate(found)]


def detections(docs: DataFrame) -> DataFrame:
    """_id, _text, rule, label, weight, base, first, last (word numbers from 0): one row for each match of each rule."""
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    norm = F.concat(F.lit(" "), F.trim(F.regexp_replace(lower, _GAP, "  ")), F.lit(" "))
    keywords = sorted({r[1] for r in rules()})
    anchored = let(F.lower("text"), lambda t: F.exists(F.array(*[F.lit(a) for a in ANCHORS]), lambda a: F.contains(t, a)) | (F.contains(t, F.lit("cc")) & t.rlike(CC_BY)))
    found = docs.where(F.col("text").isNotNull() & anchored).select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_text"), norm.alias("norm"))
    found = found.withColumn("kw", F.explode(let(F.col("norm"), lambda t: F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(t, F.concat(F.lit(" "), k, F.lit(" ")))))))
    table = found.sparkSession.createDataFrame(rules(), "rule int, kw string, label string, pattern string, weight double, base boolean")
    found = found.join(F.broadcast(table), "kw")  # constant: one row for each rule
    found = found.withColumn("hits", F.regexp_extract_all("norm", F.col("pattern"), F.lit(0))).where(F.size("hits") > 0)
    found = found.withColumn("gaps", F.split("norm", F.col("pattern"), -1))
    found = found.select("_id", "_text", "rule", "label", "weight", "base", F.posexplode(F.arrays_zip("hits", "gaps")).alias("k", "x")).where(F.col("x.hits").isNotNull())
    found = found.withColumn("n_hit", F.expr("(length(x.hits) - length(translate(x.hits, ' ', ''))) div 2")).withColumn("n_gap", F.expr("(length(x.gaps) - length(translate(x.gaps, ' ', ''))) div 2"))
    before = Window.partitionBy("_id", "_text", "rule").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    found = found.withColumn("first", F.col("n_gap") + F.coalesce(F.sum(F.col("n_gap") + F.col("n_hit")).over(before), F.lit(0)))
    return found.select("_id", "_text", "rule", "label", "weight", "base", "first", (F.col("first") + F.col("n_hit") - 1).alias("last"))


def suppress(found: DataFrame) -> DataFrame:
    """The detections that no other contains, and all base ones."""
    earlier = Window.partitionBy("_id", "_text").orderBy(F.col("first"), F.col("last").desc(), "rule").rowsBetween(Window.unboundedPreceding, -1)
    return found.withColumn("reach", F.max("last").over(earlier)).where(F.col("base") | F.col("reach").isNull() | (F.col("reach") < F.col("last"))).drop("reach")


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each document."""
    found = suppress(detections(docs).distinct())
    base = F.col("base")
    joined = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    by_doc = found.groupBy("_id", "_text").agg(
        F.count(F.when(base, 1)).alias("n_base"), F.min(F.when(base, F.col("first"))).alias("first_word"), F.max(F.when(base, F.col("first"))).alias("last_word"),
        joined(F.when(base, F.col("label"))).alias("base_labels"), joined("label").alias("labels"), F.max("weight").alias("score"),
    )
    words = F.coalesce(F.regexp_count("text", F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")), F.lit(0)).cast("long")
    out = docs.select("doc_id", words.alias("n_words"), F.xxhash64("text").alias("_h"))
    out = out.join(by_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_h") == F.col("_text")), "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_base", F.lit(0)).cast("long").alias("n_base"), F.col("first_word").cast("long"), F.col("last_word").cast("long"),
        F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"),
    )


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scans all documents; see license_scan."""
    return license_scan(read(spark, sf_dir, "documents"))


def _sql() -> str:
    table = ",\n    ".join(f"({i}, '{kw}', '{label}', '{pattern}', {weight}::DOUBLE, {base})" for i, kw, label, pattern, weight, base in rules())
    gap = _GAP
    return rf"""
WITH r(rule, kw, label, pattern, weight, base) AS (VALUES
    {table}
), d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), n AS (
  SELECT doc_id, len(regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS n_words,
    ' ' || trim(regexp_replace(t, '{gap}', '  ', 'g')) || ' ' AS norm FROM d
), m AS (
  SELECT doc_id, rule, label, weight, base, norm, regexp_extract_all(norm, pattern) AS hits, string_split_regex(norm, pattern) AS gaps
  FROM n JOIN r ON contains(norm, ' ' || kw || ' ')
), x AS (
  SELECT doc_id, rule, label, weight, base, unnest(hits) AS hit, unnest(gaps[1:len(hits)]) AS gap, generate_subscripts(hits, 1) AS k FROM m WHERE len(hits) > 0
), p AS (
  SELECT *, (length(hit) - length(replace(hit, ' ', ''))) // 2 AS n_hit, (length(gap) - length(replace(gap, ' ', ''))) // 2 AS n_gap FROM x
), f AS (
  SELECT *, n_gap + coalesce(sum(n_gap + n_hit) OVER (PARTITION BY doc_id, rule ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS first FROM p
), s AS (
  SELECT *, first + n_hit - 1 AS last FROM f
), q AS (
  SELECT *, max(last) OVER (PARTITION BY doc_id ORDER BY first, last DESC, rule ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM s
), a AS (
  SELECT doc_id, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(weight) AS score
  FROM q WHERE base OR reach IS NULL OR reach < last GROUP BY doc_id
)
SELECT n.doc_id, CAST(n_words AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0) AS score
FROM n LEFT JOIN a ON n.doc_id = a.doc_id
"""


OP7_SQL = _sql()
