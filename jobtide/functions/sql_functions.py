"""Functions for SQL users: score labels, roles, skills of a text as rows, and role families as an aggregate.

Labels and roles are SQL functions that Spark inlines. A table function and a grouped aggregate need Python; both get
Arrow batches, and the aggregate is meant for the distinct families of a key, which are few.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from jobtide.functions.roles import builtin_rules
from jobtide.functions.scoring import SQL_FUNCTIONS
from jobtide.functions.text import unicode_pattern
from jobtide.taxonomy import Taxonomy, builtin
from jobtide.values import roles


class SkillMatcher:
    """The skills of one text, as :func:`jobtide.functions.text.match_skills` finds them in a column."""

    def __init__(self, taxonomy: Taxonomy) -> None:
        self.skills = sorted((s for s in taxonomy.skills if s.patterns), key=lambda s: s.name.lower())
        self.patterns = [[re.compile(p) for p in s.patterns] for s in self.skills]
        self.always = [k for k, s in enumerate(self.skills) if s.first_words() is None]
        self.by_word: dict[str, list[int]] = {}
        for k, skill in enumerate(self.skills):
            for word in skill.first_words() or ():
                self.by_word.setdefault(word, []).append(k)

    @staticmethod
    def normalized(text: str) -> str:
        text = re.sub(r"c\+\+", " cpp ", text, flags=re.IGNORECASE)
        text = re.sub("c#", " csharp ", text, flags=re.IGNORECASE).replace("&", " and ")
        return re.sub(r"\s+", " ", re.sub("[/_+-]", " ", text)).strip().lower()

    def matches(self, text: str | None) -> Iterator[tuple[str, str, list[str], float]]:
        text = self.normalized((text or "").replace("|", " "))
        words = set(re.findall(r"\w+", text))
        for k in sorted({*self.always, *(k for w in words & self.by_word.keys() for k in self.by_word[w])}):
            terms = sorted({m.group().strip() for p in self.patterns[k] for m in p.finditer(text)})
            if terms:
                yield self.skills[k].name, self.skills[k].category, terms, round(min(1.0, 0.65 + 0.1 * len(terms)), 2)


def extract_skills_function(taxonomy: Taxonomy):
    """A table function: one row for each skill of a text."""

    class ExtractSkills:
        def __init__(self) -> None:
            self.matcher = SkillMatcher(taxonomy)

        def eval(self, text: str) -> Iterator[tuple]:
            yield from self.matcher.matches(text)

    return F.udtf(ExtractSkills, returnType="skill string, category string, terms array<string>, confidence double", useArrow=True)


class _SplitItems:
    def eval(self, text: str, separator: str) -> Iterator[tuple[int, str]]:
        for position, item in enumerate((text or "").split(separator)):
            if item.strip():
                yield position, item.strip()


def _families(values: pd.Series) -> str:
    names = {name.strip() for value in values.dropna() for name in value.split("|")}
    return " | ".join(sorted(names - {""}))


def _role_functions() -> dict[str, str]:
    title = r"lower(trim(regexp_replace(translate(coalesce(title, ''), '_-', '  '), r'\s+', ' ')))"
    bodies = {}
    for function, pick in (("classify_role", 0), ("classify_role_family", 1)):
        whens = [
            f"WHEN {title} RLIKE r'{unicode_pattern('|'.join(f'(?:{p})' for p in rule[2]))}' THEN '{rule[pick]}'" for rule in builtin_rules()
        ]
        for words, name, family in roles.ROLE_FALLBACKS:
            test = " OR ".join(f"contains({title}, '{w}')" for w in words)
            whens.append(f"WHEN {test} THEN '{(name, family)[pick]}'")
        bodies[function] = f"(title STRING) RETURNS STRING RETURN CASE {' '.join(whens)} ELSE '{roles.ROLE_DEFAULT[pick]}' END"
    return bodies


def register(spark: SparkSession, taxonomy: Taxonomy | None = None) -> list[str]:
    """Register all of them for a session, under the names given back.

    ``opportunity_label(index)``, ``gap_status(gap)``, ``classify_role(title)`` and ``classify_role_family(title)`` give a value;
    ``extract_skills(text)`` and ``split_items(text, separator)`` give rows, for a lateral join; ``role_families(text)`` is an aggregate.
    """
    labels = {**SQL_FUNCTIONS, **_role_functions()}
    for name, body in labels.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{body}")
    spark.udtf.register("extract_skills", extract_skills_function(taxonomy or builtin()))
    spark.udtf.register("split_items", F.udtf(_SplitItems, returnType="position int, item string"))
    spark.udf.register("role_families", F.pandas_udf(_families, "string"))
    return [*labels, "extract_skills", "split_items", "role_families"]
