"""Identifiers, file names, codes and offsets, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import slugify

#: Fixed by RFC 9562: the name space of URLs.
NAMESPACE_URL = "6ba7b8119dad11d180b400c04fd430c8"
#: Fixed suffixes of archives, and of graphs.
ARCHIVE_SUFFIXES = (".corpus", ".cusx", ".ctei")
GRAPH_SUFFIX = ".graph.json"
#: Fixed codes of languages with their English name and three-letter code.
LANGUAGES = {
    "en": ("english", "ENG"), "eng": ("english", "ENG"), "fr": ("french", "FRA"), "fra": ("french", "FRA"), "fre": ("french", "FRA"),
    "de": ("german", "DEU"), "deu": ("german", "DEU"), "ger": ("german", "DEU"), "he": ("hebrew", "HEB"), "heb": ("hebrew", "HEB"),
    "grc": ("ancient greek", "GRC"), "el": ("greek", "ELL"), "ell": ("greek", "ELL"), "la": ("latin", "LAT"), "lat": ("latin", "LAT"),
    "ar": ("arabic", "ARA"), "ara": ("arabic", "ARA"), "es": ("spanish", "SPA"), "spa": ("spanish", "SPA"), "it": ("italian", "ITA"),
    "ita": ("italian", "ITA"), "pt": ("portuguese", "POR"), "por": ("portuguese", "POR"), "ru": ("russian", "RUS"), "rus": ("russian", "RUS"),
    "zh": ("chinese", "ZHO"), "zho": ("chinese", "ZHO"), "ja": ("japanese", "JPN"), "jpn": ("japanese", "JPN"), "ko": ("korean", "KOR"),
    "kor": ("korean", "KOR"), "nl": ("dutch", "NLD"), "nld": ("dutch", "NLD"),
}
#: Fixed grammar of codes in the canonical graph: name -> (pattern, most characters).
CODES = {
    "lang_tag": (r"^[A-Za-z]{2,3}(-[A-Za-z0-9]{1,8})*$", None), "slug": (r"^[a-z0-9][a-z0-9-]*$", 128), "script": (r"^[A-Z][a-z]{3}$", None),
    "code": (r"^[A-Za-z0-9][A-Za-z0-9._-]*$", 64), "type": (r"^[a-z][a-z0-9_-]*:[a-z][a-z0-9_-]*$", None),
    "version": (r"^(0|[1-9]\d*)\.(0|[1-9]\d*)\.(0|[1-9]\d*)(-[0-9A-Za-z.-]+)?(\+[0-9A-Za-z.-]+)?$", None),
}


def canonical_json(pairs: Column) -> Column:
    """A map of strings as JSON with sorted keys, without spaces, other characters than ASCII as they are. C20."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(pairs))))


def digest(text: Column) -> Column:
    """sha256:<hex>. C19, C20."""
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def _uuid(hex32: Column) -> Column:
    part = lambda i, n: F.substring(hex32, i, n)
    return F.concat_ws("-", part(1, 8), part(9, 4), part(13, 4), part(17, 4), part(21, 12))


def _variant(digit: Column) -> Column:
    """The digit with its two leading bits set to 10."""
    return F.lower(F.hex((F.conv(digit, 16, 10).cast("int") % 4 + 8).cast("int")))


def uuid5(name: Column, namespace: str = NAMESPACE_URL) -> Column:
    """The name-based id: the same for the same name. C21."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace)), F.encode(name, "utf-8")))
    return _uuid(F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), _variant(F.substring(h, 17, 1)), F.substring(h, 18, 15)))


def uuid7(at: Column) -> Column:
    """A new id that sorts by time, to the millisecond; not the same when computed again, so write it once. C21."""
    r = F.replace(F.uuid(), F.lit("-"), F.lit(""))
    return _uuid(F.concat(F.lpad(F.lower(F.hex(F.unix_millis(at))), 12, "0"), F.lit("7"), F.substring(r, 1, 3), _variant(F.substring(r, 4, 1)), F.substring(r, 17, 15)))


def operation_id(*parts: Column) -> Column:
    """The id of an operation by its parts, null ones included, written as a JSON list. L22, C21."""
    shown = [F.coalesce(F.regexp_replace(F.to_json(F.array(p.cast("string"))), r"^\[|\]$", ""), F.lit("null")) for p in parts]
    return uuid5(F.concat(F.lit("["), F.concat_ws(", ", *[F.when(p.isNull(), F.lit("null")).otherwise(s) for p, s in zip(parts, shown, strict=True)]), F.lit("]")))


def utf16_offset(text: Column, scalar: Column) -> Column:
    """The place of a code point in UTF-16 units; null beyond the text. C22."""
    return F.when((scalar >= 0) & (scalar <= F.length(text)), F.octet_length(F.encode(F.substring(text, F.lit(1), scalar.cast("int")), "UTF-16BE")) / 2).cast("long")


def scalar_offset(text: Column, units: Column) -> Column:
    """The place of a UTF-16 unit in code points; null beyond the text, or between the halves of a pair. C22."""
    raw = F.encode(text, "UTF-16BE")
    next_ = F.conv(F.hex(F.substring(raw, (units * 2 + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    inside = next_.between(0xDC, 0xDF)  # the second half of a pair comes next
    place = F.length(F.decode(F.substring(raw, F.lit(1), (units * 2).cast("int")), "UTF-16BE"))
    return F.when((units >= 0) & (units * 2 <= F.octet_length(raw)) & ~F.coalesce(inside, F.lit(False)), place).cast("long")


def slug_or_id(name: Column, job: Column) -> Column:
    """The slug of a name; of the job's id where the name has none. C15."""
    return F.coalesce(*[F.nullif(slugify(c), F.lit("")) for c in (name, job)], job)


def document_slug(title: Column) -> Column:
    """A slug of 128 characters at most; `document` where the title has none. C15."""
    return F.coalesce(F.nullif(F.regexp_replace(F.substring(slugify(title), 1, 128), "-+$", ""), F.lit("")), F.lit("document"))


def result_filename(name: Column, job: Column, suffix: str = ".corpus") -> Column:
    """C18."""
    if suffix not in (*ARCHIVE_SUFFIXES, GRAPH_SUFFIX):
        raise ValueError(f"unknown suffix {suffix!r}")
    return F.concat(slug_or_id(name, job), F.lit(suffix))


def snapshot_key(job: Column, label: Column, suffix: str = ".corpus") -> Column:
    """conversion-jobs/<job>/<label><suffix>; null for a label that isn't v and numbers, or a job id that is a path. C18."""
    safe = F.trim(label).rlike(r"^v[0-9.]+$") & (job != "") & ~job.rlike(r"[/\\]|\.\.")
    return F.when(safe & F.lit(suffix in ARCHIVE_SUFFIXES), F.concat(F.lit("conversion-jobs/"), job, F.lit("/"), F.trim(label), F.lit(suffix)))


def language(value: Column) -> Column:
    """struct(name, iso, code): of a code or an English name; English where there is none. C27."""
    asked = F.replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), F.lit("_"), F.lit("-"))
    first = {}
    for code, (name, _) in LANGUAGES.items():
        first.setdefault(name, code)
    table = lambda pairs: F.create_map(*[F.lit(x) for kv in pairs for x in kv])
    code = F.coalesce(F.try_element_at(table(first.items()), asked), F.nullif(asked, F.lit("")), F.lit("en"))
    base = F.substring_index(code, "-", 1)
    name = F.coalesce(F.try_element_at(table([(k, v[0]) for k, v in LANGUAGES.items()]), base), base)
    iso = F.coalesce(F.try_element_at(table([(k, v[1]) for k, v in LANGUAGES.items()]), base), F.upper(base))
    return F.struct(name.alias("name"), iso.alias("iso"), code.alias("code"))


def is_code(value: Column, kind: str) -> Column:
    """Does value follow the grammar of its kind? C28."""
    pattern, most = CODES[kind]
    return F.coalesce(value.rlike(pattern) & (F.lit(most is None) | (F.length(value) <= (most or 0))), F.lit(False))


def typed_sections(sections: Column, types: list[str]) -> Column:
    """struct(values, error): labels as they are kept for levels of type str or int; too many, or no number: an error. C06."""
    kinds = F.array(*[F.lit(t) for t in types])
    number = lambda x: F.regexp_replace(F.trim(x), r"^\+?(-?)0*(\d)", "$1$2")
    values = F.zip_with(F.slice(kinds, F.lit(1), F.least(F.size(sections), F.lit(len(types)))), F.slice(sections, F.lit(1), F.lit(len(types))), lambda t, x: F.when(t == "int", F.when(F.trim(x).rlike(r"^[+-]?\d+$"), number(x))).otherwise(x))
    error = F.when(F.size(sections) > len(types), "too many levels").when(F.exists(values, lambda v: v.isNull()), "not a number")
    return F.struct(F.when(error.isNull(), values).alias("values"), error.alias("error"))


def corpus_metadata(corpus_id: Column, manifest: Column, toc: Column) -> Column:
    """The block that a reference carries, of the maps of a manifest and a table of contents. C13."""
    of = lambda m, k: F.try_element_at(m, F.lit(k))
    written = of(manifest, "written_date")
    year = F.when(F.substring(written, 1, 4).rlike(r"^\d{4}$"), F.substring(written, 1, 4))
    authors = F.when(F.coalesce(of(toc, "authorId"), F.lit("")) == "", F.array().cast("array<string>")).otherwise(F.split(of(toc, "authorId"), ","))
    some = lambda c: F.nullif(c, F.lit(""))
    return F.struct(
        corpus_id.alias("corpusId"), F.coalesce(some(of(manifest, "uid")), some(of(toc, "corpusId"))).alias("uid"), of(manifest, "name").alias("title"), of(manifest, "description").alias("description"),
        of(manifest, "version").alias("version"), of(manifest, "language").alias("language"), of(manifest, "languageCode").alias("languageCode"), of(manifest, "type").alias("type"),
        of(manifest, "category").alias("category"), year.alias("year"), some(written).alias("writtenDate"), authors.alias("authors"), some(of(toc, "publisherId")).alias("publisher"),
    )
