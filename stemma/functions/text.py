"""Scalar functions on text, as Column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def tokens(text: Column) -> Column:
    """Array of (text, after): runs of other than white space with the gap that follows. C01, W04."""
    pattern = F.lit(r"(\S+)(\s*)")
    return F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("text"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("after"))


def percent_encode(value: Column, urn: bool = False) -> Column:
    """% : / ! @ (and the space in a URN) as %XX. C04."""
    marks = [("%", "%25"), (":", "%3A"), ("/", "%2F"), ("!", "%21"), ("@", "%40")] + ([(" ", "%20")] if urn else [])
    return reduce(lambda c, m: F.replace(c, F.lit(m[0]), F.lit(m[1])), marks, value)


def percent_decode(value: Column) -> Column:
    """The inverse; a plus sign stays a plus sign. C05."""
    return F.coalesce(F.try_url_decode(F.replace(value, F.lit("+"), F.lit("%2B"))), value)


def slugify(value: Column) -> Column:
    """Lower case, runs of other characters as one hyphen, none at the ends. C15."""
    return F.regexp_replace(F.regexp_replace(F.lower(value), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def corpus_slug(value: Column) -> Column:
    """C11."""
    return F.replace(F.lower(value), F.lit("_"), F.lit("-"))


def clean_stem(filename: Column) -> Column:
    """A file's name without folder and extension, separators as single spaces. C16."""
    stem = F.regexp_replace(F.regexp_replace(filename, r"^.*[/\\]", ""), r"\.[A-Za-z0-9]{1,6}$", "")
    return F.trim(F.regexp_replace(stem, r"[\s_]+", " "))


def first_filled(*values: Column) -> Column:
    """The first that isn't null or blank. C17, W03, A05."""
    return F.coalesce(*[F.nullif(F.trim(v), F.lit("")) for v in values])


def normalize_space(value: Column) -> Column:
    """C26."""
    return F.trim(F.regexp_replace(value, r"\s+", " "))


def year(value: Column) -> Column:
    """The first four digits in a row. C13."""
    return F.nullif(F.regexp_extract(value, r"(\d{4})", 1), F.lit(""))


def text_format(template: str, columns: dict[str, Column]) -> Column:
    """A template such as {word}{trailer} over a slot's features, missing ones empty. R05."""
    import re

    parts = [F.coalesce(columns[p[1:-1]].cast("string"), F.lit("")) if p.startswith("{") else F.lit(p) for p in re.split(r"(\{\w+\})", template) if p]
    return F.concat(*parts)


def version_key(name: Column) -> Column:
    """Sorts versions: numeric parts by number, a pre-release before its release. S18."""
    core, rest = F.regexp_extract(name, r"(\d+(?:\.\d+)*)", 1), F.regexp_extract(name, r"\d+(?:\.\d+)*[.\-]?([A-Za-z].*)$", 1)
    numbers = F.transform(F.split(core, r"\."), lambda x: F.lpad(x, 12, "0"))
    return F.concat(F.array_join(numbers, "."), F.when(rest == "", F.lit("~")).otherwise(F.concat(F.lit("!"), rest)))


def stream_parts(parts: DataFrame, key: list[str], order: str, text: str, separator: int) -> DataFrame:
    """parts with start and stop: offsets in the stream that joins a key's texts by separators of that length. S35, S36."""
    before = Window.partitionBy(*key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.length(text) + separator).over(before), F.lit(0)).cast("long")
    return parts.withColumn("start", start).withColumn("stop", F.col("start") + F.length(text))


def span_bounds(spec: Column) -> Column:
    """Array of (lo, hi) of a span list such as 1-4,7. S02."""
    def one(part):
        ends = F.split(part, "-")
        lo = F.element_at(ends, 1).cast("long")
        return F.struct(lo.alias("lo"), F.element_at(ends, -1).cast("long").alias("hi"))

    return F.transform(F.split(spec, ","), one)


def mark_duplicates(values: Column) -> Column:
    """Distinct values in the order of their first place. A18."""
    return F.array_distinct(values)


def flipped_box(left: Column, bottom: Column, right: Column, top: Column, height: Column) -> Column:
    """A box with its origin at the bottom left, from the top left. C32."""
    return F.struct(left.alias("x"), (height - top).alias("y"), (right - left).alias("width"), (top - bottom).alias("height"))


def verified_anchor(text: Column, start: Column, stop: Column, exact: Column, before: Column, after: Column, context: int = 32) -> Column:
    """Does a text anchor hold: its quote at its place, with what stands around it? C23. Offsets from 0, half open."""
    here = F.substring(text, start + 1, stop - start) == exact
    lo = F.greatest(start - context, F.lit(0))
    return here & (F.substring(text, lo + 1, start - lo) == before) & (F.substring(text, stop + 1, F.lit(context)) == after)


#: Fixed elements that end a line, and those whose text doesn't count.
LINE_ELEMENTS = "address article aside blockquote dd div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table tr ul".split()
_SILENT = "script style noscript template".split()


def html_stream(html: Column) -> Column:
    """The text of a page as one stream: a line break where a block begins or ends, unless there is one; br breaks too. S37."""
    bare = F.regexp_replace(html, r"(?s)<!--.*?-->", "")
    for name in _SILENT:
        bare = F.regexp_replace(bare, rf"(?is)<{name}\b[^>]*>.*?</{name}\s*>", "")
    broken = F.regexp_replace(bare, r"(?i)</?(?:" + "|".join(LINE_ELEMENTS) + r"|br)\b[^>]*>", "\n")
    text = F.regexp_replace(F.regexp_replace(broken, r"<[^>]*>", ""), r"\n+", "\n")
    for name, mark in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&copy;", "\u00a9"), ("&middot;", "\u00b7"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
        text = F.replace(text, F.lit(name), F.lit(mark))
    return F.regexp_replace(text, r"^\n|\n$", "")


def between_anchors(streams, anchors, key: str, text: str = "text"):
    """key, name, part: of streams (key, text) with empty anchors (key, name, place), the text from each anchor to the next one,
    which isn't part of it; the last runs to the end. C31."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy("place", "name")
    spans = anchors.withColumn("stop", F.lead("place").over(w)).join(streams.select(key, text), key)
    stop = F.coalesce("stop", F.length(text))
    return spans.select(key, "name", F.substring(text, (F.col("place") + 1).cast("int"), (stop - F.col("place")).cast("int")).alias("part"))
