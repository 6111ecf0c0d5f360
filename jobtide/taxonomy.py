"""The skill taxonomy as a parameter object and as small DataFrames.

Operators take a :class:`Taxonomy`, so callers and tests can swap the built-in one for their own.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobtide.literals import literal_frame
from jobtide.values import occupations as occ
from jobtide.values import skills as sk

DEFAULT_FAMILY = "Other Technology"
DEFAULT_ROLE = "Technology professional"
DEFAULT_CATEGORY = "Other"
DEFAULT_SIGNAL = (50, 50, 50, "Stable")

# a pattern that starts with one plain word, followed by a word end
_PLAIN_FIRST_WORD = re.compile(r"\\b([a-z0-9]+)(?:\\b|\\\.| |\[, \]\+)")


@dataclass(frozen=True)
class Skill:
    name: str
    category: str = DEFAULT_CATEGORY
    patterns: tuple[str, ...] = ()
    families: tuple[str, ...] = ()
    roles: tuple[str, ...] = ()
    growth: int = 50
    salary: int = 50
    saturation: int = 50
    direction: str = "Stable"

    def first_words(self) -> tuple[str, ...] | None:
        """Words of which at least one stands in any matching text, or None when not known."""
        found: list[str] = []
        for pattern in self.patterns:
            plain = _PLAIN_FIRST_WORD.match(pattern)
            if pattern in sk.FIRST_WORDS:
                found.extend(sk.FIRST_WORDS[pattern])
            elif plain:
                found.append(plain.group(1))
            else:
                return None
        return tuple(dict.fromkeys(found))


@dataclass(frozen=True)
class Occupation:
    soc_code: str
    title: str
    wage: int
    outlook: str
    openings: int
    growth: float
    bls_url: str
    onet_url: str


@dataclass(frozen=True)
class Taxonomy:
    skills: tuple[Skill, ...]
    category_families: dict[str, tuple[str, ...]] = field(default_factory=dict)
    job_roles: dict[str, tuple[str, ...]] = field(default_factory=dict)
    occupations: tuple[Occupation, ...] = ()
    skill_occupations: dict[str, tuple[str, ...]] = field(default_factory=dict)
    examples: dict[str, tuple[str, ...]] = field(default_factory=dict)

    def families(self, skill: Skill) -> tuple[str, ...]:
        return skill.families or self.category_families.get(skill.category, (DEFAULT_FAMILY,))

    def roles(self, skill: Skill) -> str:
        return " | ".join(skill.roles or self.job_roles.get(skill.name, (DEFAULT_ROLE,)))

    def attributes(self, spark: SparkSession) -> DataFrame:
        """One row per skill: category, market signal, role families and target roles."""
        schema = (
            "skill string, category string, growth_signal int, salary_signal int, saturation_score int, "
            "market_direction string, target_job_roles string, role_families string"
        )
        data = [
            (s.name, s.category, s.growth, s.salary, s.saturation, s.direction, self.roles(s), "|".join(self.families(s)))
            for s in self.skills
        ]
        return literal_frame(spark, data, schema)

    def occupation_frame(self, spark: SparkSession) -> DataFrame:
        schema = (
            "soc_code string, title string, wage long, outlook string, openings long, growth double, "
            "bls_url string, onet_url string"
        )
        return literal_frame(spark, [tuple(vars(o).values()) for o in self.occupations], schema)

    def profile_frame(self, spark: SparkSession) -> DataFrame:
        """One row per skill and occupation, with the occupation's position in the profile."""
        data = [
            (skill, position, soc)
            for skill, codes in self.skill_occupations.items()
            for position, soc in enumerate(codes)
        ]
        return literal_frame(spark, data, "skill string, position int, soc_code string")

    def example_frame(self, spark: SparkSession) -> DataFrame:
        data = [(skill, n, name) for skill, names in self.examples.items() for n, name in enumerate(names)]
        return literal_frame(spark, data, "skill string, position int, workplace_example string")


@lru_cache(maxsize=1)
def builtin() -> Taxonomy:
    core = [Skill(name, category, patterns, (), (), *signal) for name, category, patterns, signal in sk.CORE_SKILLS]
    technology = [Skill(*row, *signal) for *row, signal in sk.TECHNOLOGY_SKILLS]
    return Taxonomy(
        skills=tuple(core + technology),
        category_families=sk.CATEGORY_FAMILIES,
        job_roles=sk.TARGET_JOB_ROLES,
        occupations=tuple(Occupation(*row) for row in occ.OCCUPATIONS),
        skill_occupations=occ.SKILL_OCCUPATIONS,
        examples=occ.WORKPLACE_EXAMPLES,
    )


def lookup(mapping: dict[str, str], key, default=None):
    """Column lookup in a small literal mapping; null or missing keys give ``default``."""
    if not mapping:
        return F.lit(default)
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    found = F.element_at(F.create_map(*pairs), key)
    return found if default is None else F.coalesce(found, F.lit(default))
