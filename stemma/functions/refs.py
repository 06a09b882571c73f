"""Citations as strings: corpus[@version]/section:section!type1-3, and urn:tf:corpus@version:... forms.

Every function is a Column expression, so millions of references are parsed in the scan that reads them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import percent_decode, percent_encode

_CORPUS = r"^([A-Za-z0-9_.\-]+)(?:@([A-Za-z0-9_.\-]+))?$"
_SELECTOR = r"^([A-Za-z_][A-Za-z0-9_]*?)(\d+)(?:-(\d+))?$"


def _part(c: Column, pattern: str, group: int) -> Column:
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))


def parse(ref: Column) -> Column:
    """struct(corpus, version, sections, target_type, start, end, error). error is null for a good reference. C02, C03."""
    s = F.trim(ref)
    urn = s.startswith("urn:tf:")
    bare = F.when(urn, F.substring(s, 8, F.lit(2**30))).otherwise(s)
    cut = F.when(urn, F.instr(bare, ":")).otherwise(F.instr(bare, "/"))
    head = F.when(cut > 0, F.substring(bare, F.lit(1), cut - 1))
    rest = F.when(cut > 0, F.substring(bare, cut + 1, F.lit(2**30))).otherwise(bare)
    bang = F.instr(rest, "!")
    path = F.when(bang > 0, F.substring(rest, F.lit(1), bang - 1)).otherwise(rest)
    selector = F.when(bang > 0, F.substring(rest, bang + 1, F.lit(2**30)))
    sections = F.transform(F.split(path, ":", -1), lambda x: percent_decode(x))
    start = _part(selector, _SELECTOR, 2).try_cast("long")
    end = F.coalesce(_part(selector, _SELECTOR, 3).try_cast("long"), start)
    error = (
        F.when(ref.isNull() | (s == ""), "empty")
        .when(urn & (cut == 0), "no section path")
        .when(head.isNotNull() & ~head.rlike(_CORPUS), "bad corpus id")
        .when(selector.isNotNull() & ~selector.rlike(_SELECTOR), "bad selector")
        .when(start < 1, "index below 1")
        .when(end < start, "range ends before it starts")
        .when(path == "", "missing section path")
        .when(F.exists(sections, lambda x: x == ""), "empty section")
    )
    return F.struct(
        _part(head, _CORPUS, 1).alias("corpus"), _part(head, _CORPUS, 2).alias("version"), sections.alias("sections"),
        _part(selector, _SELECTOR, 1).alias("target_type"), start.alias("start"), end.alias("end"), error.alias("error"),
    )


def selector(target_type: Column, start: Column, end: Column) -> Column:
    one = F.concat(F.lit("!"), target_type, start.cast("string"))
    return F.when(target_type.isNull(), "").when(start == end, one).otherwise(F.concat(one, F.lit("-"), end.cast("string")))


def short(r: Column) -> Column:
    """The short form of a parsed reference. C08."""
    version = F.when(r["version"].isNotNull(), F.concat(F.lit("@"), r["version"])).otherwise("")
    head = F.when(r["corpus"].isNotNull(), F.concat(r["corpus"], version, F.lit("/"))).otherwise("")
    body = F.array_join(F.transform(r["sections"], lambda x: percent_encode(x)), ":")
    return F.concat(head, body, selector(r["target_type"], r["start"], r["end"]))


def urn(r: Column) -> Column:
    """The URN form; null without a corpus. C03."""
    version = F.when(r["version"].isNotNull(), F.concat(F.lit("@"), r["version"])).otherwise("")
    body = F.array_join(F.transform(r["sections"], lambda x: percent_encode(x, urn=True)), ":")
    return F.concat(F.lit("urn:tf:"), r["corpus"], version, F.lit(":"), body, selector(r["target_type"], r["start"], r["end"]))


def section_label(sections: Column) -> Column:
    """First level, a space, the others joined by colons."""
    rest = F.array_join(F.slice(sections, F.lit(2), F.greatest(F.size(sections) - 1, F.lit(0))), ":")
    return F.when(F.size(sections) == 1, F.element_at(sections, 1)).otherwise(F.concat(F.element_at(sections, 1), F.lit(" "), rest))


def label(r: Column) -> Column:
    """For people: Deut 4:2 · clause 1. C12."""
    t, i, j = r["target_type"], r["start"].cast("string"), r["end"].cast("string")
    sel = F.when(r["start"] == r["end"], F.concat(t, F.lit(" "), i)).otherwise(F.concat(t, F.lit("s "), i, F.lit("-"), j))
    return F.when(t.isNull(), section_label(r["sections"])).otherwise(F.concat(section_label(r["sections"]), F.lit(" · "), sel))


#: Fixed abbreviations of node types; others take their first two letters.
ABBREVIATIONS = {"word": "wo", "phrase": "ph", "clause": "cl", "sentence": "st", "paragraph": "pa", "para": "pa", "verse": "vs", "line": "ln", "chapter": "ch", "book": "bk"}


def compact_label(r: Column) -> Column:
    """For a pill: Deut 4:2 cl1. C12."""
    short_of = F.create_map(*[F.lit(x) for kv in ABBREVIATIONS.items() for x in kv])
    t = F.coalesce(F.try_element_at(short_of, r["target_type"]), F.lower(F.substring(r["target_type"], 1, 2)))
    sel = F.concat(t, r["start"].cast("string"), F.when(r["start"] == r["end"], "").otherwise(F.concat(F.lit("-"), r["end"].cast("string"))))
    return F.when(r["target_type"].isNull(), section_label(r["sections"])).otherwise(F.concat(section_label(r["sections"]), F.lit(" "), sel))


def share_url(ref: Column, template: str) -> Column:
    """The template with {ref} percent-encoded in full. C12."""
    return F.replace(F.lit(template), F.lit("{ref}"), F.replace(F.url_encode(ref), F.lit("+"), F.lit("%20")))


def human(ref: Column, levels: int) -> Column:
    """Sections of `Book 1:2`: the last word splits at its colons, the rest is the first level; null if it has too many. C14."""
    s = F.trim(ref)
    book, numbers = F.regexp_extract(s, r"^(.*\S)\s+([0-9]+(?::[0-9]+)*)$", 1), F.regexp_extract(s, r"^(.*\S)\s+([0-9]+(?::[0-9]+)*)$", 2)
    parts = F.when(numbers != "", F.concat(F.array(book), F.split(numbers, ":"))).otherwise(F.array(s))
    return F.when((s != "") & (F.size(parts) <= levels), parts)


def scheme_token(token: Column) -> Column:
    """struct(kind, level, value) of a token of a canonical reference: ordinal, level-ordinal or code. C25."""
    level = r"^([a-z][a-z0-9]*)-([1-9][0-9]*)$"
    kind = F.when(token.rlike(r"^[0-9]+$"), "ordinal").when(token.rlike(level), "level-ordinal").otherwise("code")
    return F.struct(kind.alias("kind"), _part(token, level, 1).alias("level"), F.coalesce(_part(token, level, 2), token).alias("value"))


def _at_least_three(digits: Column) -> Column:
    return F.when(F.length(digits) < 3, F.lpad(digits, 3, "0")).otherwise(digits)


def compact_token(corpus: Column, ordinals: list[tuple[str, Column]]) -> Column:
    """co<corpus>_bk001_ch002...: ordinals padded to three digits at least, levels that are null left out. C09."""
    parts = [F.when(o.isNotNull(), F.concat(F.lit(p), _at_least_three(o.cast("string")))) for p, o in ordinals]
    return F.concat_ws("_", F.concat(F.lit("co"), F.replace(F.lower(corpus), F.lit("_"), F.lit("-"))), *parts)


def compact_levels(token: Column) -> Column:
    """Array of struct(prefix, first, last) of a compact token. C10."""
    found = F.regexp_extract_all(token, F.lit(r"_((?:bk|ch|pa|st|cl|ph|wo)\d+(?:-\d+)?)"), F.lit(1))

    def one(x):
        i = F.regexp_extract(x, r"^[a-z]+(\d+)", 1).cast("long")
        return F.struct(F.substring(x, 1, 2).alias("prefix"), i.alias("first"), F.coalesce(F.nullif(F.regexp_extract(x, r"-(\d+)$", 1), F.lit("")).cast("long"), i).alias("last"))

    return F.transform(found, one)
