"""Tokens, scalar functions and aggregations on the documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import aggregate as A
from ..operators import search as S
from ..operators import structure as H
from ..operators import standoff
from ..plans.corpus import read, text_corpus, text_lines, text_slots, text_tokens
from . import query

#: tk: every word with its slot, in SQL.
BASE = r"""
ln AS (
  SELECT lang AS corpus, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents
), tw AS (
  SELECT corpus, doc_id, line_no, unnest(regexp_extract_all(line, '(\S+)(\s*)', 1)) AS text, unnest(regexp_extract_all(line, '(\S+)(\s*)', 2)) AS after, generate_subscripts(regexp_extract_all(line, '(\S+)(\s*)', 1), 1) AS word_no FROM ln
), tk AS (
  SELECT *, row_number() OVER (PARTITION BY corpus ORDER BY doc_id, line_no, word_no) AS slot FROM tw
)
"""


def sql(body: str) -> str:
    return f"WITH {BASE.strip()}\n{body}"


def docs(spark, sf_dir):
    return read(spark, sf_dir, "documents")


@query("tokenize", sql("SELECT corpus, doc_id, line_no, word_no, text, after FROM tk"))
def tokenize(spark, sf_dir):
    """Words with the gaps that follow."""
    return text_tokens(docs(spark, sf_dir))


@query("text_slots", sql("SELECT corpus, slot, text, after FROM tk"))
def text_slots_query(spark, sf_dir):
    """Section 1.1: dense slot numbers in each corpus, without a one-task window."""
    return text_slots(docs(spark, sf_dir)).select("corpus", "slot", "text", "after")


@query("text_types", sql("SELECT corpus, otype, count(*) AS n FROM (SELECT corpus, 'word' AS otype FROM tk UNION ALL SELECT DISTINCT corpus, 'line' || doc_id || '-' || line_no FROM tk UNION ALL SELECT DISTINCT corpus, 'document' || doc_id FROM tk) CROSS JOIN LATERAL (SELECT regexp_extract(otype, '^[a-z]+') AS o) GROUP BY ALL").replace("SELECT corpus, otype, count(*) AS n FROM", "SELECT corpus, o AS otype, count(*) AS n FROM").replace("GROUP BY ALL", "GROUP BY corpus, o"))
def text_types(spark, sf_dir):
    """A01 on the text corpora, one for each language. R01: their list is the distinct corpus column."""
    return text_corpus(docs(spark, sf_dir)).nodes.groupBy("corpus", "otype").agg(F.count(F.lit(1)).alias("n"))


@query("text_search", sql("SELECT b.corpus, a.slot AS first_word, b.slot AS second_word FROM tk a JOIN tk b ON b.corpus = a.corpus AND b.slot = a.slot + 1 AND a.doc_id = b.doc_id AND a.line_no = b.line_no WHERE a.text = 'Licensed' AND b.text = 'under'"))
def text_search(spark, sf_dir):
    """T02, T03 on text: two words in a row in one line."""
    found = S.search(text_corpus(docs(spark, sf_dir)), "line\n  word text=Licensed\n  <: word text=under")
    return found.select("corpus", F.col("n2").alias("first_word"), F.col("n3").alias("second_word"))


@query("line_text", sql("SELECT corpus, doc_id, line_no, rtrim(string_agg(text || after, '' ORDER BY word_no)) AS text FROM tk WHERE doc_id % 10 = doc_id % 10 GROUP BY ALL"))
def line_text(spark, sf_dir):
    """The text of every line from its slots, by an ordered aggregation."""
    by = text_tokens(docs(spark, sf_dir)).groupBy("corpus", "doc_id", "line_no").agg(F.array_sort(F.collect_list(F.struct("word_no", "text", "after"))).alias("w"))
    return by.select("corpus", "doc_id", "line_no", F.rtrim(F.array_join(F.transform("w", lambda x: F.concat(x["text"], x["after"])), "")).alias("text"))


@query("word_frequency", sql("SELECT corpus, value, n, rank FROM (SELECT corpus, text AS value, count(*) AS n, row_number() OVER (PARTITION BY corpus ORDER BY count(*) DESC, text) AS rank FROM tk GROUP BY corpus, text) WHERE rank <= 20"))
def word_frequency(spark, sf_dir):
    """The twenty commonest words of each corpus; ranks only over aggregated words."""
    by = text_tokens(docs(spark, sf_dir)).groupBy("corpus", F.col("text").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    return by.withColumn("rank", F.row_number().over(Window.partitionBy("corpus").orderBy(F.desc("n"), "value"))).where("rank <= 20")


@query("occurrences_in_section", sql("SELECT doc_id, text, count(*) AS in_document, sum(count(*)) OVER (PARTITION BY corpus, text) AS in_corpus FROM tk WHERE text IN ('the', 'de', 'der', 'que') GROUP BY corpus, doc_id, text").replace("sum(count(*))", "CAST(sum(count(*))").replace("corpus, text) AS in_corpus", "corpus, text) AS BIGINT) AS in_corpus"))
def occurrences_in_section(spark, sf_dir):
    """Conditional counts, by two aggregations that combine on the map side."""
    by = text_tokens(docs(spark, sf_dir)).where(F.col("text").isin("the", "de", "der", "que")).groupBy("corpus", "doc_id", "text").agg(F.count(F.lit(1)).alias("in_document"))
    total = by.groupBy("corpus", "text").agg(F.sum("in_document").alias("in_corpus"))
    return by.join(total, ["corpus", "text"]).select("doc_id", "text", "in_document", "in_corpus")


@query("content_hash", "SELECT doc_id, sha256(array_to_string(regexp_extract_all(text, '\\S+'), ' ')) AS content_hash FROM documents")
def content_hash(spark, sf_dir):
    """A digest of a scope's text over its slots in order."""
    return docs(spark, sf_dir).select("doc_id", F.sha2(F.array_join(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0)), " "), 256).alias("content_hash"))


@query("plain_paragraphs", "SELECT doc_id, pos - 1 AS id, p AS text FROM (SELECT doc_id, unnest(string_split(replace(text, '.' || chr(10), '.' || chr(10) || chr(10)), chr(10) || chr(10))) AS p, generate_subscripts(string_split(replace(text, '.' || chr(10), '.' || chr(10) || chr(10)), chr(10) || chr(10)), 1) AS pos FROM documents) WHERE trim(p, ' ' || chr(9) || chr(10) || chr(13)) <> ''")
def plain_paragraphs(spark, sf_dir):
    """Paragraphs between blank lines (made here after a line's last stop), blank ones skipped, raw numbers kept."""
    from ..sources.plain import paragraphs

    return paragraphs(docs(spark, sf_dir).select("doc_id", F.replace("text", F.lit(".\n"), F.lit(".\n\n")).alias("text"))).select("doc_id", F.col("id").cast("long").alias("id"), "text")


@query("blank_line_spans", "SELECT doc_id, coalesce(sum(length(p) + 1) OVER w, 0) AS start, coalesce(sum(length(p) + 1) OVER w, 0) + length(p) AS stop FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents) WINDOW w AS (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")
def blank_line_spans(spark, sf_dir):
    """The spans of a text's parts, which give the text back without loss."""
    parts = docs(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("pos", "p"))
    return X.stream_parts(parts, ["doc_id"], "pos", "p", 1).select("doc_id", "start", "stop")


@query("span_decode", "SELECT o_orderkey, CAST(string_split(s, '-')[1] AS BIGINT) AS lo, CAST(string_split(s, '-')[-1] AS BIGINT) AS hi FROM (SELECT o_orderkey, unnest(string_split(o_orderkey || '-' || (o_orderkey + 3) || ',' || (o_orderkey + 7), ',')) AS s FROM orders)")
def span_decode(spark, sf_dir):
    """Span lists such as 4-7,11."""
    k = F.col("o_orderkey")
    spec = F.concat(k.cast("string"), F.lit("-"), (k + 3).cast("string"), F.lit(","), (k + 7).cast("string"))
    return read(spark, sf_dir, "orders").select("o_orderkey", F.explode(X.span_bounds(spec)).alias("s")).select("o_orderkey", "s.lo", "s.hi")


@query("node_ranges", "SELECT doc_id, lo, max(line_no) AS hi FROM (SELECT *, min(line_no) OVER (PARTITION BY doc_id, run) AS lo FROM (SELECT doc_id, line_no, line_no - row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS run FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM documents) WHERE length(line) > 60)) GROUP BY doc_id, run, lo")
def node_ranges(spark, sf_dir):
    """A node's slots as ranges, gaps kept (a document's lines of over 60 characters)."""
    long_ = text_lines(docs(spark, sf_dir)).where(F.length("line") > 60).select("doc_id", F.col("line_no").alias("slot"))
    return A.slot_ranges(long_, ["doc_id"]).select("doc_id", F.explode("ranges").alias("r")).select("doc_id", F.col("r.lo").cast("long").alias("lo"), F.col("r.hi").cast("long").alias("hi"))


@query("percent_encoding", "SELECT page_id, replace(replace(replace(replace(replace(url, '%', '%25'), ':', '%3A'), '/', '%2F'), '!', '%21'), '@', '%40') AS encoded, url AS decoded FROM pages")
def percent_encoding(spark, sf_dir):
    """A round trip of URLs as section values."""
    e = X.percent_encode(F.col("url"))
    return read(spark, sf_dir, "pages").select("page_id", e.alias("encoded"), X.percent_decode(e).alias("decoded"))


@query("slugs", "SELECT p_partkey, trim(regexp_replace(lower(p_name || ' / ' || p_type), '[^a-z0-9]+', '-', 'g'), '-') AS slug, replace(lower(replace(p_type, ' ', '_')), '_', '-') AS corpus_slug FROM part")
def slugs(spark, sf_dir):
    """C11, C15."""
    p = read(spark, sf_dir, "part")
    return p.select("p_partkey", X.slugify(F.concat("p_name", F.lit(" / "), "p_type")).alias("slug"), X.corpus_slug(F.replace("p_type", F.lit(" "), F.lit("_"))).alias("corpus_slug"))


@query("file_stems", r"SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace('/in/My_file ' || page_id || '.tar.gz', '^.*[/\\]', ''), '\.[A-Za-z0-9]{1,6}$', ''), '[\s_]+', ' ', 'g')) AS stem FROM pages")
def file_stems(spark, sf_dir):
    """C16."""
    return read(spark, sf_dir, "pages").select("page_id", X.clean_stem(F.concat(F.lit("/in/My_file "), F.col("page_id").cast("string"), F.lit(".tar.gz"))).alias("stem"))


@query("display_names", "SELECT page_id, coalesce(nullif(trim(CASE WHEN page_id % 3 = 0 THEN '  ' ELSE url END), ''), nullif(trim(CASE WHEN page_id % 2 = 0 THEN NULL ELSE 'page' END), ''), CAST(page_id AS VARCHAR)) AS name FROM pages")
def display_names(spark, sf_dir):
    """The first that is filled of label, id and number."""
    label = F.when(F.col("page_id") % 3 == 0, F.lit("  ")).otherwise(F.col("url"))
    other = F.when(F.col("page_id") % 2 == 0, F.lit(None)).otherwise(F.lit("page"))
    return read(spark, sf_dir, "pages").select("page_id", X.first_filled(label, other, F.col("page_id").cast("string")).alias("name"))


@query("normalized_space", r"SELECT page_id, length(trim(regexp_replace(html, '\s+', ' ', 'g'))) AS n FROM pages")
def normalized_space(spark, sf_dir):
    """C26."""
    return read(spark, sf_dir, "pages").select("page_id", F.length(X.normalize_space(F.col("html"))).cast("long").alias("n"))


@query("years", r"SELECT o_orderkey, regexp_extract('placed on ' || strftime(o_orderdate, '%Y-%m-%d'), '(\d{4})', 1) AS year FROM orders")
def years(spark, sf_dir):
    """C13."""
    return read(spark, sf_dir, "orders").select("o_orderkey", X.year(F.concat(F.lit("placed on "), F.date_format("o_orderdate", "yyyy-MM-dd"))).alias("year"))


@query("text_format", "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, coalesce(l_returnflag, '') || '/' || coalesce(l_linestatus, '') || ' ' AS text FROM lineitem")
def text_format(spark, sf_dir):
    """A format template over slot features."""
    t = X.text_format("{flag}/{status} ", {"flag": F.col("l_returnflag"), "status": F.col("l_linestatus")})
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", t.alias("text"))


@query("version_order", "SELECT * FROM (VALUES ('0.9', 1), ('1.0-alpha', 2), ('1.0-beta', 3), ('1.0', 4), ('1.2', 5), ('1.10', 6), ('2.0-rc1', 7), ('2.0', 8)) AS t(version, place)")
def version_order(spark, sf_dir):
    """Numeric parts by number, a pre-release before its release."""
    names = spark.createDataFrame([(v,) for v in ("1.10", "1.2", "2.0", "1.0", "1.0-beta", "0.9", "2.0-rc1", "1.0-alpha")], "version string")
    return names.select("version", F.row_number().over(Window.orderBy(X.version_key(F.col("version")))).alias("place"))


@query("flipped_boxes", "SELECT p_partkey, 100.0 - (p_size + 10.0) AS y, 10.0 AS height FROM part")
def flipped_boxes(spark, sf_dir):
    """Boxes of parts from the top left."""
    size = F.col("p_size").cast("double")
    box = X.flipped_box(size, size, size + 5.0, size + 10.0, F.lit(100.0))
    return read(spark, sf_dir, "part").select("p_partkey", box.alias("b")).select("p_partkey", "b.y", "b.height")


@query("verified_anchors", "SELECT doc_id, length(text) > 20 AND doc_id % 5 <> 0 AS holds FROM documents WHERE length(text) > 20")
def verified_anchors(spark, sf_dir):
    """Quotes at their place, with context; every fifth quote is altered."""
    d = docs(spark, sf_dir).where(F.length("text") > 20)
    quote = F.when(F.col("doc_id") % 5 == 0, F.concat(F.substring("text", 6, 9), F.lit("\u0001"))).otherwise(F.substring("text", 6, 10))
    ok = X.verified_anchor(F.col("text"), F.lit(5), F.lit(15), quote, F.substring("text", 1, 5), F.substring("text", 16, 32))
    return d.select("doc_id", ok.alias("holds"))


@query("metadata_flatten", "SELECT c_custkey, coalesce(nullif(trim(CASE WHEN c_custkey % 4 = 0 THEN '' ELSE c_name END), ''), 'Untitled') AS title, c_mktsegment || '; ' || c_nationkey AS subjects FROM customer")
def metadata_flatten(spark, sf_dir):
    """Lists joined by "; ", Untitled where a title is blank."""
    title = F.when(F.col("c_custkey") % 4 == 0, F.lit("")).otherwise(F.col("c_name"))
    return read(spark, sf_dir, "customer").select("c_custkey", X.first_filled(title, F.lit("Untitled")).alias("title"), F.array_join(F.array("c_mktsegment", F.col("c_nationkey").cast("string")), "; ").alias("subjects"))


@query("json_filter", "SELECT event_id, json_extract_string(props, '$.k') AS k FROM events WHERE props IS NOT NULL AND json_extract_string(props, '$.k') IS NOT NULL")
def json_filter(spark, sf_dir):
    """A field of a JSON column."""
    k = F.get_json_object("props", "$.k")
    return read(spark, sf_dir, "events").where(k.isNotNull()).select("event_id", k.alias("k"))


@query("json_counts", "SELECT event_type, count(*) FILTER (json_extract_string(props, '$.k') IS NOT NULL) AS with_k, count(*) AS n FROM events GROUP BY event_type")
def json_counts(spark, sf_dir):
    """Conditional counts over JSON."""
    return read(spark, sf_dir, "events").groupBy("event_type").agg(F.count(F.get_json_object("props", "$.k")).alias("with_k"), F.count(F.lit(1)).alias("n"))


@query("having_count", "SELECT l_orderkey, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_suppkey FROM lineitem) GROUP BY l_orderkey HAVING count(*) > 3")
def having_count(spark, sf_dir):
    """Orders that cross more than three suppliers."""
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey").distinct().groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n")).where("n > 3")


@query("first_seen_distinct", "SELECT o_custkey, string_agg(o_orderstatus, ',' ORDER BY k) AS seen FROM (SELECT o_custkey, o_orderstatus, min(o_orderkey) AS k FROM orders GROUP BY ALL) GROUP BY o_custkey")
def first_seen_distinct(spark, sf_dir):
    """Distinct values in the order of their first place."""
    by = read(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderstatus"))).alias("x"))
    return by.select("o_custkey", F.array_join(X.mark_duplicates(F.transform("x", lambda v: v["o_orderstatus"])), ",").alias("seen"))


@query("set_difference", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def set_difference(spark, sf_dir):
    """Members that are missing."""
    return read(spark, sf_dir, "customer").select("c_custkey").join(read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@query("set_intersection", "SELECT n_nationkey AS k FROM nation INTERSECT SELECT s_nationkey FROM supplier")
def set_intersection(spark, sf_dir):
    """X05."""
    return read(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k")).intersect(read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k")))


@query("set_union", "SELECT c_nationkey AS k FROM customer WHERE c_acctbal < 0 UNION SELECT s_nationkey FROM supplier WHERE s_acctbal < 0")
def set_union(spark, sf_dir):
    """Candidates of two branches, each once."""
    a = read(spark, sf_dir, "customer").where("c_acctbal < 0").select(F.col("c_nationkey").alias("k"))
    return a.union(read(spark, sf_dir, "supplier").where("s_acctbal < 0").select("s_nationkey")).distinct()


@query("subset_test", "SELECT o_custkey, bool_and(o_orderstatus IN ('F', 'O')) AS within FROM orders GROUP BY o_custkey")
def subset_test(spark, sf_dir):
    """Is a set within another?"""
    return standoff.within(read(spark, sf_dir, "orders"), "o_custkey", "o_orderstatus", ["F", "O"])


@query("section_rollup", "SELECT r_name, n_name, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ROLLUP (r_name, n_name)")
def section_rollup(spark, sf_dir):
    """A21 (an extension): counts by section and all above it."""
    c = read(spark, sf_dir, "customer").join(read(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(read(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    return c.rollup("r_name", "n_name").agg(F.count(F.lit(1)).alias("n"))


@query("approximate_distinct")
def approximate_distinct(spark, sf_dir):
    """A22 (an extension): distinct words of each corpus by a mergeable sketch."""
    return text_tokens(docs(spark, sf_dir)).groupBy("corpus").agg(F.approx_count_distinct("text", 0.02).alias("n_words"))


@query("archive_totals", "SELECT source, count(*) AS files, CAST(sum(n_chars) AS BIGINT) AS size FROM documents GROUP BY source")
def archive_totals(spark, sf_dir):
    """Number and size of a source's files."""
    return docs(spark, sf_dir).groupBy("source").agg(F.count(F.lit(1)).alias("files"), F.sum("n_chars").alias("size"))


@query("untouched_hash", "SELECT l_orderkey, sha256(string_agg(sha256(l_linenumber || '|' || l_partkey || '|' || l_returnflag), '' ORDER BY sha256(l_linenumber || '|' || l_partkey || '|' || l_returnflag))) AS state FROM lineitem GROUP BY l_orderkey")
def untouched_hash(spark, sf_dir):
    """A digest of everything in a group, whatever the order it is read in."""
    return standoff.group_state(read(spark, sf_dir, "lineitem"), "l_orderkey", ["l_linenumber", "l_partkey", "l_returnflag"])


@query("fragment_split", "SELECT doc_id, start, substr(text, start + 1, coalesce(lead(start) OVER (PARTITION BY doc_id ORDER BY start), length(text)) - start) AS part FROM (SELECT doc_id, text, unnest(range(0, length(text), 500)) AS start FROM documents)")
def fragment_split(spark, sf_dir):
    """a text split at region starts, each part up to the next."""
    d = docs(spark, sf_dir).where(F.length("text") > 0).select("doc_id", "text", F.explode(F.expr("sequence(0, length(text) - 1, 500)")).alias("start"))
    stop = F.coalesce(F.lead("start").over(Window.partitionBy("doc_id").orderBy("start")), F.length("text"))
    return d.select("doc_id", F.col("start").cast("long").alias("start"), F.expr("substring(text, start + 1)").alias("rest"), stop.alias("stop")).select("doc_id", "start", F.expr("substring(rest, 1, cast(stop - start as int))").alias("part"))


@query("type_statistics_text", sql("SELECT corpus, 'line' AS otype, count(*) AS n, round_even(avg(n), 1) AS mean_span, false AS is_slot FROM (SELECT corpus, doc_id, line_no, count(*) AS n FROM tk GROUP BY ALL) GROUP BY corpus"))
def type_statistics_text(spark, sf_dir):
    """A03 on text: mean line length in words, one decimal, half to even."""
    return H.type_statistics(text_corpus(docs(spark, sf_dir))).where("otype = 'line'")
