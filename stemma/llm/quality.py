r"""Quality rules with adaptive thresholds from mergeable quantile sketches. DataFrame operations only.

A document's measures are whole numbers (rates in thousandths). A sketch is a count of documents for each
bin of a measure; bins keep the six leading bits of the value, so a quantile read from them is at most one
part in 32 too low. Such sketches merge by adding counts, whatever the order, so results never depend on
the partitioning. Each (lang, source) has its own sketches; one of fewer than MIN_DOCS documents reads
those of its language instead, merged over sources, and a small language reads those of the corpus.

A measure's limit is q75 + SPREADS * max(q75 - q25, its least spread); mean word length has a lower limit
by the same rule. A document within all limits is kept.

Scale: measures are taken inside the row, without a shuffle; texts never move. Sketches pre-aggregate on
the map side, so a group with a third of all rows arrives as a few hundred bins a task. The thresholds
have one row for each (lang, source).

Edge cases: a null text has no words and fails the base rules; an empty table gives an empty result; null
lang or source is a group of its own; repeated rows each count and each get a row; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import SPACE, WORD, let, read, shared_table

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MIN_DOCS = 100
SPREADS = 3
#: Measure -> least spread that its limit allows for.
MEASURES = {"symbol_rate": 15, "dup_line_rate": 120, "repeat_rate": 100, "upper_rate": 60, "word_length": 60}


def _repeat_words(words: Column) -> Column:
    """Words that lie in three-word windows found twice or more in the text. In-row, n log n."""

    def marked(ws):
        starts = F.when(F.size(ws) >= 3, F.sequence(F.lit(0), F.size(ws) - 3)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.struct(F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2)).alias("h"), i.alias("p")))

    def covered(starts):
        gap = lambda p, i: F.least(F.lit(3), F.coalesce(F.get(starts, i + 1) - p, F.lit(3)))
        return F.aggregate(F.transform(starts, gap), F.lit(0).cast("long"), lambda a, x: a + x)

    def repeated(found):
        twice = lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False)))
        starts = let(F.sort_array(found), lambda s: F.sort_array(F.transform(twice(s), lambda x: x["p"])))
        none = F.size(F.array_distinct(F.transform(found, lambda x: x["h"]))) == F.size(found)
        return F.when(none, F.lit(0).cast("long")).otherwise(let(starts, covered))

    return let(let(words, marked), repeated)


def measures(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source, the base counts and MEASURES."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    lines = lambda t: F.filter(F.split(t, "\n", -1), lambda x: x.rlike(WORD))
    dup = let(lines(text), lambda ls: F.struct(F.size(ls).alias("n"), (F.size(ls) - F.size(F.array_distinct(ls))).alias("dup")))
    own = let(words, lambda ws: F.struct(F.size(ws).cast("long").alias("n"), _repeat_words(ws).alias("r")))
    out = docs.select(
        "doc_id", "lang", "source", own.alias("w"), dup.alias("l"),
        F.length(F.translate(text, " \t\n\x0b\x0c\r", "")).cast("long").alias("word_chars"),
        (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.length(text) - F.length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))).cast("long").alias("n_upper"),
    )
    out = out.select("doc_id", "lang", "source", F.col("w.n").alias("n_words"), "word_chars", "n_symbols", F.col("l.dup").cast("long").alias("n_dup_lines"), F.col("w.r").alias("n_repeat_words"), "n_upper", F.col("l.n").cast("long").alias("n_lines"))
    rate = lambda x, y: F.expr(f"1000 * {x} div greatest({y}, 1)")
    return out.withColumns({
        "symbol_rate": rate("n_symbols", "word_chars"), "dup_line_rate": rate("n_dup_lines", "n_lines"), "repeat_rate": rate("n_repeat_words", "n_words"),
        "upper_rate": rate("n_upper", "word_chars"), "word_length": F.expr("100 * word_chars div greatest(n_words, 1)"),
    }).drop("n_upper", "n_lines")


def sketches(found: DataFrame) -> DataFrame:
    """lang, source, measure, bin, n: sketches of the documents of each group. Merge by adding n."""
    pairs = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), F.col(k).alias("v")) for k in MEASURES]))
    at = found.select("lang", "source", pairs.alias("m")).select("lang", "source", "m.measure", "m.v")
    shift = "greatest(length(bin(v)) - 6, 0)"
    return at.withColumn("bin", F.expr(f"shiftleft(shiftright(v, {shift}), {shift})")).groupBy("lang", "source", "measure", "bin").agg(F.count(F.lit(1)).alias("n"))


def _quartiles(sketch: DataFrame, keys: list[str]) -> DataFrame:
    """keys, measure, docs, q25, q75."""
    merged = sketch.groupBy(*keys, "measure", "bin").agg(F.sum("n").alias("n"))
    up = Window.partitionBy(*keys, "measure").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    merged = merged.withColumn("upto", F.sum("n").over(up)).withColumn("docs", F.sum("n").over(Window.partitionBy(*keys, "measure")))
    q = lambda p: F.min(F.when(F.col("upto") * 4 >= F.col("docs") * p, F.col("bin")))
    return merged.groupBy(*keys, "measure").agg(F.max("docs").alias("docs"), q(1).alias("q25"), q(3).alias("q75"))


def thresholds(sketch: DataFrame, min_docs: int = MIN_DOCS, spreads: int = SPREADS) -> DataFrame:
    """lang, source, and for each measure its limit hi_<measure>, and lo_word_length."""
    own, by_lang, whole = (_quartiles(sketch, k) for k in (["lang", "source"], ["lang"], []))
    a, b, c = own.alias("a"), by_lang.alias("b"), whole.alias("c")
    both = a.join(b, F.col("a.lang").eqNullSafe(F.col("b.lang")) & (F.col("a.measure") == F.col("b.measure"))).join(c, F.col("a.measure") == F.col("c.measure"))
    pick = lambda x: F.when(F.col("a.docs") >= min_docs, F.col(f"a.{x}")).when(F.col("b.docs") >= min_docs, F.col(f"b.{x}")).otherwise(F.col(f"c.{x}"))
    least = reduce(lambda e, k: e.when(F.col("a.measure") == k, F.lit(MEASURES[k])), MEASURES, F.when(F.lit(False), 0))
    both = both.select("a.lang", "a.source", "a.measure", pick("q25").alias("q25"), pick("q75").alias("q75"), least.alias("least"))
    both = both.withColumn("room", F.greatest(F.col("q75") - F.col("q25"), F.col("least")) * spreads)
    hi = lambda k: F.max(F.when(F.col("measure") == k, F.col("q75") + F.col("room"))).alias(f"hi_{k}")
    return both.groupBy("lang", "source").agg(*[hi(k) for k in MEASURES], F.max(F.when(F.col("measure") == "word_length", F.col("q25") - F.col("room"))).alias("lo_word_length"))


def quality_rules(docs: DataFrame) -> DataFrame:
    """The measures of each document, base_failed and kept."""
    found = shared_table(measures(docs), "quality")
    limits = thresholds(sketches(found)).withColumnsRenamed({"lang": "_lang", "source": "_source"})
    out = found.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * 50)
    within = reduce(lambda x, k: x & (F.col(k) <= F.col(f"hi_{k}")), MEASURES, F.col("word_length") >= F.col("lo_word_length"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & within).drop("_lang", "_source")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures and verdicts of all documents; see quality_rules."""
    return quality_rules(read(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _sql() -> str:
    values = ", ".join(f"('{k}', {v})" for k, v in MEASURES.items())
    pairs = " UNION ALL ".join(f"SELECT doc_id, lang, source, '{k}' AS measure, {k} AS v FROM m" for k in MEASURES)
    quart = lambda keys: f"""SELECT {keys} measure, max(docs) AS docs, min(CASE WHEN upto * 4 >= docs THEN bin END) AS q25, min(CASE WHEN upto * 4 >= docs * 3 THEN bin END) AS q75
  FROM (SELECT *, sum(n) OVER (PARTITION BY {keys} measure ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY {keys} measure) AS docs
        FROM (SELECT {keys} measure, bin, count(*) AS n FROM b GROUP BY ALL)) GROUP BY {keys} measure"""  # noqa: E731
    return rf"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d
), g AS (
  SELECT doc_id, p, ws[p] || ' ' || ws[p + 1] || ' ' || ws[p + 2] AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS p FROM w)
), r AS (
  SELECT doc_id, count(DISTINCT p + o) AS n FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, win) AS k FROM g), (SELECT unnest([0, 1, 2]) AS o) WHERE k > 1 GROUP BY doc_id
), c AS (
  SELECT w.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(r.n, 0) AS BIGINT) AS n_repeat_words, length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS n_upper, len(ls) AS n_lines
  FROM w LEFT JOIN r ON w.doc_id = r.doc_id
), m AS (
  SELECT *, 1000 * n_symbols // greatest(word_chars, 1) AS symbol_rate, 1000 * n_dup_lines // greatest(n_lines, 1) AS dup_line_rate, 1000 * n_repeat_words // greatest(n_words, 1) AS repeat_rate,
    1000 * n_upper // greatest(word_chars, 1) AS upper_rate, 100 * word_chars // greatest(n_words, 1) AS word_length FROM c
), p AS (
  {pairs}
), b AS (
  SELECT lang, source, measure, (v >> greatest(length(bin(v)) - 6, 0)::INT) << greatest(length(bin(v)) - 6, 0)::INT AS bin FROM p
), q1 AS (
  {quart("lang, source,")}
), q2 AS (
  {quart("lang,")}
), q3 AS (
  {quart("")}
), l AS (
  SELECT q1.lang, q1.source, q1.measure, CASE WHEN q1.docs >= {MIN_DOCS} THEN q1.q25 WHEN q2.docs >= {MIN_DOCS} THEN q2.q25 ELSE q3.q25 END AS q25,
    CASE WHEN q1.docs >= {MIN_DOCS} THEN q1.q75 WHEN q2.docs >= {MIN_DOCS} THEN q2.q75 ELSE q3.q75 END AS q75, least_spread
  FROM q1 JOIN q2 ON q1.lang IS NOT DISTINCT FROM q2.lang AND q1.measure = q2.measure JOIN q3 ON q1.measure = q3.measure
    JOIN (VALUES {values}) AS s(measure, least_spread) ON s.measure = q1.measure
), h AS (
  SELECT p.doc_id, p.lang, p.source, bool_and(v <= q75 + {SPREADS} * greatest(q75 - q25, least_spread) AND (p.measure <> 'word_length' OR v >= q25 - {SPREADS} * greatest(q75 - q25, least_spread))) AS within
  FROM p JOIN l ON p.lang IS NOT DISTINCT FROM l.lang AND p.source IS NOT DISTINCT FROM l.source AND p.measure = l.measure GROUP BY ALL
)
SELECT m.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words) AND within AS kept
FROM m JOIN h ON m.doc_id = h.doc_id
"""


OP10_SQL = _sql()
