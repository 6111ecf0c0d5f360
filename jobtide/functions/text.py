"""Text columns: normalisation, skill matching, HTML to text, URLs.

Everything here is built from Spark's own functions, so rows never leave the JVM.
"""

from __future__ import annotations

import html.entities
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from jobtide.taxonomy import Taxonomy

SPACE = r"[\t-\r\x1c-\x20\x85\p{Z}]"
NOT_WORD = r"[^\p{L}\p{N}_]+"


def unicode_pattern(pattern: str) -> str:
    """The pattern with Unicode-aware word boundaries and classes on every supported JVM."""
    return "(?U)" + pattern


def strip(col: Column) -> Column:
    """Trim of every kind of white space, not only blanks."""
    return F.regexp_replace(col, rf"^{SPACE}+|{SPACE}+$", "")


def blank_to_null(col: Column) -> Column:
    return F.nullif(col, F.lit(""))


def skill_text(*cols: Column) -> Column:
    """The searchable text of a record: non-null fields joined by a blank, list bars opened up."""
    return F.concat_ws(" ", *[F.translate(c.cast("string"), "|", " ") for c in cols])


def normalize_skill_text(col: Column) -> Column:
    out = F.regexp_replace(col, r"(?i)c\+\+", " cpp ")
    out = F.regexp_replace(out, "(?i)c#", " csharp ")
    out = F.replace(out, F.lit("&"), F.lit(" and "))
    out = F.regexp_replace(out, "[/_+-]", " ")
    out = F.regexp_replace(out, rf"{SPACE}+", " ")
    return F.lower(F.trim(out))


def match_skills(normalized: Column, taxonomy: Taxonomy) -> Column:
    """Skills found in a normalised text, as ``array<struct<skill, category, terms, confidence>>``.

    Each pattern begins with known words, so the text is cut into words once and intersected with all of those
    first words; a skill's patterns run only where one of its words is present. Patterns are literals, each
    in a branch of its own, and so are compiled once and not row by row. The array is ordered by lower-cased skill name.
    """
    skills = sorted((s for s in taxonomy.skills if s.patterns), key=lambda s: s.name.lower())
    firsts = [s.first_words() for s in skills]
    words = sorted({w for found in firsts for w in found or ()})
    present = F.array_intersect(F.split(normalized, NOT_WORD), F.array(*[F.lit(w) for w in words]).cast("array<string>"))

    def matched(here: Column) -> Column:
        rows = []
        for skill, found in zip(skills, firsts, strict=True):
            terms = F.concat(*[F.regexp_extract_all(normalized, F.lit(unicode_pattern(p)), F.lit(0)) for p in skill.patterns])
            row = F.struct(F.lit(skill.name).alias("skill"), F.lit(skill.category).alias("category"), terms.alias("terms"))
            rows.append(row if found is None else F.when(F.arrays_overlap(here, F.array(*[F.lit(w) for w in found])), row))
        return F.array(*rows)

    # the words of a text are bound to a name by the outer array, so they are cut out once
    matches = F.element_at(F.transform(F.array(present), matched), 1)
    tidy = F.transform(
        F.filter(matches, lambda m: F.size(m["terms"]) > 0),
        lambda m: F.struct(m["skill"], m["category"], F.array_sort(F.array_distinct(F.transform(m["terms"], lambda t: F.trim(t)))).alias("terms")),
    )
    return F.transform(
        tidy,
        lambda m: F.struct(
            m["skill"].alias("skill"), m["category"].alias("category"), m["terms"].alias("terms"), match_confidence(F.size(m["terms"])).alias("confidence")
        ),
    )


def match_confidence(n_terms: Column) -> Column:
    return F.bround(F.least(F.lit(1.0), F.lit(0.65) + F.lit(0.1) * n_terms), 2)


def mean_confidence(matches: Column) -> Column:
    total = F.aggregate(matches, F.lit(0.0), lambda acc, m: acc + m["confidence"])
    return F.when(F.size(matches) > 0, F.bround(total / F.size(matches), 2)).otherwise(F.lit(0.0))


def list_text(values: Column, separator: str = "|") -> Column:
    """Array to the delimited text used at the sinks."""
    return F.concat_ws(separator, values)


def text_list(col: Column, separator: str = "|") -> Column:
    """Delimited text to an array, blank entries dropped; null gives an empty array."""
    parts = F.split(F.coalesce(col, F.lit("")), re.escape(separator))
    return F.filter(parts, lambda x: F.trim(x) != "")


# --- HTML ---------------------------------------------------------------------------------------

_MARKUP = (
    r"(?is)<!--.*?-->|<script\b[^>]*>.*?</script\s*>|<style\b[^>]*>.*?</style\s*>"
    r"|<template\b[^>]*>.*?</template\s*>|</?[a-z!?][^>]*>"
)
_ENTITY = r"&#?[A-Za-z0-9]+;"


def _entity_text(entity: Column) -> Column:
    """Text of one entity such as ``&eacute;`` or ``&#233;``; unknown ones stay as they are."""
    named = F.create_map(*[x for n, cp in html.entities.name2codepoint.items() for x in (F.lit(f"&{n};"), F.lit(cp))])
    hexadecimal = F.conv(F.regexp_extract(entity, "^&#[xX]([0-9A-Fa-f]{1,6});$", 1), 16, 10)
    decimal = F.regexp_extract(entity, "^&#([0-9]{1,7});$", 1)
    code = F.coalesce(
        F.element_at(named, entity),
        hexadecimal.try_cast("int"),
        decimal.try_cast("int"),
        F.when(entity == "&apos;", F.lit(39)),
    )
    valid = (code > 0) & (code <= 0x10FFFF) & ~code.between(0xD800, 0xDFFF)
    return F.when(valid, F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")).otherwise(entity)


def unescape(col: Column) -> Column:
    """Decode HTML entities.  Entities that stand for ``&`` go last, so nothing is decoded twice."""
    found = F.array_distinct(F.regexp_extract_all(col, F.lit(_ENTITY), F.lit(0)))
    pairs = F.transform(found, lambda e: F.struct(e.alias("e"), _entity_text(e).alias("t")))

    def apply(text: Column, chosen: Column) -> Column:
        return F.aggregate(chosen, text, lambda acc, p: F.replace(acc, p["e"], p["t"]))

    plain = apply(col, F.filter(pairs, lambda p: p["t"] != "&"))
    done = apply(plain, F.filter(pairs, lambda p: p["t"] == "&"))
    return F.when(F.contains(col, F.lit("&")), done).otherwise(col)


def html_to_text(col: Column) -> Column:
    """Text nodes of a page, each stripped, joined by one blank; null gives an empty string.

    Comments, scripts, styles and templates carry no text.
    """
    nodes = F.split(F.coalesce(col, F.lit("")), _MARKUP)
    texts = F.transform(nodes, lambda n: strip(unescape(n)))
    return F.array_join(F.filter(texts, lambda t: t != ""), " ")


def html_lines(col: Column) -> Column:
    """Text nodes of a page as an array of lines."""
    nodes = F.split(F.coalesce(col, F.lit("")), _MARKUP)
    lines = F.flatten(F.transform(nodes, lambda n: F.split(unescape(n), r"\r\n|[\n\r]")))
    return F.filter(F.transform(lines, strip), lambda t: t != "")


# --- URLs ---------------------------------------------------------------------------------------

def url_host(url: Column) -> Column:
    """Network location of a URL in lower case without a leading ``www.``; empty when there is none."""
    location = F.regexp_extract(F.coalesce(url, F.lit("")), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#]*)", 1)
    return F.regexp_replace(F.lower(location), r"^www\.", "")


def trusted_host(host: Column, allowed: list[str]) -> Column:
    """True for an allowed domain and for any subdomain of one."""
    names = "|".join(re.escape(d) for d in sorted(set(allowed)))
    return host.rlike(rf"(^|\.)({names})$")


def normalized_url(url: Column) -> Column:
    """URL as compared for duplicates: stripped, lower case, no trailing slashes."""
    return F.regexp_replace(F.lower(strip(F.coalesce(url, F.lit("")))), "/+$", "")


def slug(col: Column, default: str) -> Column:
    out = F.regexp_replace(F.regexp_replace(F.lower(col), "[^a-z0-9]+", "-"), "^-+|-+$", "")
    return F.coalesce(blank_to_null(out), F.lit(default))
