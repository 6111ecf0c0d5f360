"""Role classification and the parsing of free-text hiring posts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.functions.text import SPACE, html_lines, unicode_pattern
from jobtide.taxonomy import lookup
from jobtide.values import roles

Rule = tuple[str, str, tuple[str, ...]]


def builtin_rules() -> list[Rule]:
    return list(roles.ROLE_RULES)


def first_match(text: Column, patterns: Sequence[str]) -> Column:
    """Position of the first pattern found in the text, or null.

    A chain of literal patterns: each is compiled once per task and evaluation stops at a hit.
    """
    chain = None
    for position, pattern in enumerate(patterns):
        hit = text.rlike(unicode_pattern(pattern))
        chain = F.when(hit, F.lit(position)) if chain is None else chain.when(hit, F.lit(position))
    return chain if chain is not None else F.lit(None).cast("int")


def normalize_title(title: Column) -> Column:
    words = F.translate(F.coalesce(title, F.lit("")), "_-", "  ")
    return F.lower(F.trim(F.regexp_replace(words, rf"{SPACE}+", " ")))


def role_number(title: Column, rules: Sequence[Rule] | None = None) -> Column:
    """Number of the role a title belongs to, for :func:`role_name` and :func:`role_family`."""
    rules = builtin_rules() if rules is None else rules
    text = normalize_title(title)
    number = first_match(text, ["|".join(f"(?:{p})" for p in patterns) for _, _, patterns in rules])
    fallback = F.lit(len(rules) + len(roles.ROLE_FALLBACKS))
    for offset, (words, _, _) in reversed(list(enumerate(roles.ROLE_FALLBACKS))):
        present = F.lit(False)
        for word in words:
            present = present | F.contains(text, F.lit(word))
        fallback = F.when(present, F.lit(len(rules) + offset)).otherwise(fallback)
    return F.coalesce(number, fallback)


def _labels(rules: Sequence[Rule] | None) -> list[tuple[str, str]]:
    rules = builtin_rules() if rules is None else rules
    named = [(name, family) for name, family, _ in rules]
    return named + [(name, family) for _, name, family in roles.ROLE_FALLBACKS] + [roles.ROLE_DEFAULT]


def role_name(number: Column, rules: Sequence[Rule] | None = None) -> Column:
    return F.get(F.array(*[F.lit(n) for n, _ in _labels(rules)]), number)


def role_family(number: Column, rules: Sequence[Rule] | None = None) -> Column:
    return F.get(F.array(*[F.lit(f) for _, f in _labels(rules)]), number)


def with_role(
    df: DataFrame,
    title: str,
    rules: Sequence[Rule] | None = None,
    name: str = "role_category",
    family: str = "role_family",
) -> DataFrame:
    """Add the role name and family of a title.  The rule chain is evaluated once per row."""
    numbered = df.withColumn("_role", role_number(F.col(title), rules))
    return numbered.withColumns(
        {name: role_name(F.col("_role"), rules), family: role_family(F.col("_role"), rules)}
    ).drop("_role")


def recode_role(role: Column) -> Column:
    """Replace retired role labels."""
    return F.coalesce(lookup(roles.LEGACY_ROLES, role), role)


def recode_family(role: Column, family: Column) -> Column:
    """Family of a possibly retired role label, as the warehouse model fills it."""
    known = lookup(roles.LEGACY_FAMILIES, role, "Other Technology")
    return F.coalesce(F.nullif(family, F.lit("")), known)


def mentions_technology(text: Column) -> Column:
    return F.lower(text).rlike(unicode_pattern("|".join(f"(?:{p})" for p in roles.TECHNOLOGY_POST_PATTERNS)))


def is_technology_job(title: Column, description: Column) -> Column:
    """A title of a known family is enough; otherwise title and description are searched."""
    known = role_family(role_number(title)) != "Other Technology"
    return known | mentions_technology(F.concat_ws(" ", F.coalesce(title, F.lit("")), description))


def hiring_title(text: Column) -> Column:
    labels = roles.HIRING_TITLES
    position = first_match(F.lower(text), [pattern for _, pattern in labels])
    named = F.get(F.array(*[F.lit(label) for label, _ in labels]), position)
    number = role_number(text)
    classified = F.when(role_family(number) != "Other Technology", role_name(number))
    return F.coalesce(named, classified, F.lit(roles.HIRING_TITLE_DEFAULT))


def hiring_company(comment_html: Column, author: Column) -> Column:
    first_line = F.get(html_lines(comment_html), F.lit(0))
    company = F.trim(F.get(F.split(first_line, r"\s*\|\s*", 2), F.lit(0)))
    poster = F.concat(F.lit("HN poster "), F.nullif(author, F.lit("")))
    short = F.when((company != "") & (F.length(company) <= 100), company)
    return F.coalesce(short, poster, F.lit("HN employer"))


def hiring_location(text: Column) -> Column:
    head = F.slice(F.split(text, r"\|"), 1, 4)
    parts = F.filter(F.transform(head, lambda p: F.trim(p)), lambda p: p != "")
    rest = F.when(F.size(parts) > 1, F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1))))
    where = F.filter(rest, lambda p: p.rlike(r"(?iU)\b(remote|hybrid|onsite|on-site)\b"))
    return F.coalesce(
        F.substring(F.get(where, F.lit(0)), 1, 100),
        F.when(text.rlike(r"(?iU)\bremote\b"), F.lit("Remote")),
        F.substring(F.get(parts, F.lit(1)), 1, 100),
        F.lit("Unspecified"),
    )


def remote_type(location: Column, description: Column) -> Column:
    text = F.lower(F.concat_ws(" ", location, description))
    return (
        F.when(text.rlike(r"(?U)\bremote\b"), F.lit("Remote"))
        .when(text.rlike(r"(?U)\bhybrid\b"), F.lit("Hybrid"))
        .otherwise(F.lit("On-site"))
    )


def first_keyword(text: Column, rules: Sequence[tuple[str, Sequence[str]]]) -> Column:
    """Label of the first rule with a keyword inside the lower-cased text, or null."""
    lowered = F.lower(text)
    chain = None
    for label, words in rules:
        hit = F.lit(False)
        for word in words:
            hit = hit | F.contains(lowered, F.lit(word))
        chain = F.when(hit, F.lit(label)) if chain is None else chain.when(hit, F.lit(label))
    return chain
