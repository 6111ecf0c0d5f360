"""Landed third-party payloads to job, course and certification columns."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from jobtide.functions import json_walk
from jobtide.functions import roles as rl
from jobtide.functions.scalars import epoch_to_date, safe_int, salary_range, stable_id
from jobtide.functions.text import blank_to_null, html_to_text
from jobtide.operators.certifications import target_roles
from jobtide.operators.dedupe import dedupe_by_key, latest_matching
from jobtide.operators.trends import latest_per_group
from jobtide.values import catalogs

JOB_FIELDS = "external_id title company location remote_type salary_min salary_max description posted_at url".split()
COURSE_FIELDS = (
    "external_id title platform level rating duration_minutes description subjects roles products last_modified url"
).split()

# declared shapes of the landed files
ADZUNA = (
    "id string, title string, company struct<display_name:string>, location struct<display_name:string>, "
    "salary_min double, salary_max double, description string, created string, redirect_url string, ordinal bigint"
)
ARBEITNOW = (
    "slug string, title string, company_name string, location string, remote boolean, description string, "
    "created_at bigint, url string, ordinal bigint"
)
REMOTIVE = (
    "id string, title string, company_name string, candidate_required_location string, description string, "
    "publication_date string, url string, ordinal bigint"
)
STORY = "objectID string, title string, created_at string"
COMMENT = "objectID string, parent_id string, author string, created_at string, comment_text string"
VIDEO = "query string, id struct<videoId:string>, snippet struct<title:string,description:string,publishedAt:string>"
MODULE = (
    "uid string, title string, summary string, url string, last_modified string, levels array<string>, "
    "subjects array<string>, roles array<string>, products array<string>, duration_in_minutes int, ordinal bigint"
)
INDEX = "name string, type string, html_url string, path string"
REPOSITORY = (
    "topic string, id bigint, full_name string, name string, html_url string, archived boolean, pushed_at string, "
    "description string, topics array<string>, language string, stargazers_count int, updated_at string"
)
ISSUE = (
    "repository string, number int, title string, html_url string, labels array<struct<name:string>>, updated_at string, "
    "pull_request struct<url:string>"
)


def _or(col: Column, default: str) -> Column:
    return F.coalesce(blank_to_null(col), F.lit(default))


def _limited(df: DataFrame, limit: int | None, *order: Column) -> DataFrame:
    return df if limit is None else df.orderBy(*order).limit(limit)


def normalize_adzuna(df: DataFrame, limit: int | None = None, fallback_url: str = "") -> DataFrame:
    place = F.col("location.display_name")
    rows = _limited(dedupe_by_key(df, F.asc("ordinal")), limit, F.asc("ordinal"))
    return rows.select(
        F.coalesce(blank_to_null(F.col("id")), stable_id(F.col("title"), F.col("redirect_url"))).alias("external_id"),
        _or(F.col("title"), "Unknown role").alias("title"),
        _or(F.col("company.display_name"), "Unknown").alias("company"),
        _or(place, "Unknown").alias("location"),
        rl.remote_type(F.coalesce(place, F.lit("")), F.coalesce("description", F.lit(""))).alias("remote_type"),
        safe_int(F.col("salary_min")).alias("salary_min"),
        safe_int(F.col("salary_max")).alias("salary_max"),
        html_to_text(F.col("description")).alias("description"),
        F.col("created").alias("posted_at"),
        _or(F.col("redirect_url"), fallback_url).alias("url"),
    )


def normalize_arbeitnow(df: DataFrame, limit: int | None = None, fallback_url: str = "") -> DataFrame:
    texts = df.withColumn("text", html_to_text(F.col("description")))
    rows = _limited(texts.where(rl.is_technology_job(F.col("title"), F.col("text"))), limit, F.asc("ordinal"))
    place = _or(F.col("location"), "Unknown")
    return rows.select(
        F.coalesce(blank_to_null(F.col("slug")), stable_id(F.col("title"), F.col("url"))).alias("external_id"),
        _or(F.col("title"), "Unknown role").alias("title"),
        _or(F.col("company_name"), "Unknown").alias("company"),
        place.alias("location"),
        F.when(F.col("remote"), F.lit("Remote")).otherwise(rl.remote_type(place, F.col("text"))).alias("remote_type"),
        F.lit(None).cast("bigint").alias("salary_min"),
        F.lit(None).cast("bigint").alias("salary_max"),
        F.col("text").alias("description"),
        epoch_to_date(F.col("created_at")).alias("posted_at"),
        _or(F.col("url"), fallback_url).alias("url"),
    )


def normalize_remotive(df: DataFrame, limit: int | None = None, fallback_url: str = "") -> DataFrame:
    rows = _limited(dedupe_by_key(df, F.asc("ordinal")), limit, F.asc("ordinal"))
    return rows.select(
        F.coalesce(blank_to_null(F.col("id")), stable_id(F.col("title"), F.col("url"))).alias("external_id"),
        _or(F.col("title"), "Unknown role").alias("title"),
        _or(F.col("company_name"), "Unknown").alias("company"),
        _or(F.col("candidate_required_location"), "Remote").alias("location"),
        F.lit("Remote").alias("remote_type"),
        F.lit(None).cast("bigint").alias("salary_min"),
        F.lit(None).cast("bigint").alias("salary_max"),
        html_to_text(F.col("description")).alias("description"),
        F.col("publication_date").alias("posted_at"),
        _or(F.col("url"), fallback_url).alias("url"),
    )


def latest_hiring_story(stories: DataFrame) -> DataFrame:
    wanted = blank_to_null(F.col("objectID")).isNotNull() & F.contains(F.lower(F.coalesce("title", F.lit(""))), F.lit("who is hiring"))
    return latest_matching(stories, wanted, F.desc("created_at"), F.desc("objectID"))


def normalize_hiring_thread(stories: DataFrame, comments: DataFrame, limit: int | None = None) -> DataFrame:
    """Technology posts among the top-level comments of the latest hiring thread."""
    story = latest_hiring_story(stories).select("objectID").scalar()
    posts = comments.where(F.col("parent_id") == story).withColumn("text", html_to_text(F.col("comment_text")))
    posts = posts.where(rl.mentions_technology(F.col("text")))
    posts = _limited(posts, limit, F.desc("created_at"), F.desc("objectID"))
    object_id = F.coalesce(blank_to_null(F.col("objectID")), stable_id(F.col("text")))
    place = rl.hiring_location(F.col("text"))
    pay = salary_range(F.col("text"))
    return posts.select(
        object_id.alias("external_id"),
        rl.hiring_title(F.col("text")).alias("title"),
        rl.hiring_company(F.col("comment_text"), F.col("author")).alias("company"),
        place.alias("location"),
        rl.remote_type(place, F.col("text")).alias("remote_type"),
        pay["low"].alias("salary_min"),
        pay["high"].alias("salary_max"),
        F.col("text").alias("description"),
        F.col("created_at").alias("posted_at"),
        F.concat(F.lit("https://news.ycombinator.com/item?id="), object_id).alias("url"),
    )


def normalize_video_search(df: DataFrame, fallback: DataFrame | None = None) -> DataFrame:
    """Videos of a search; the fallback catalog only when the search found none."""
    video = F.col("id.videoId")
    found = df.where(blank_to_null(video).isNotNull()).select(
        F.concat(F.lit("youtube-"), video).alias("external_id"),
        F.col("snippet.title").alias("title"),
        F.lit("YouTube Learning").alias("platform"),
        F.lit("Video").alias("level"),
        F.lit(None).cast("double").alias("rating"),
        F.lit(None).cast("int").alias("duration_minutes"),
        F.concat(F.coalesce("snippet.title", F.lit("None")), F.lit(". "), F.coalesce("snippet.description", F.lit("None"))).alias("description"),
        F.translate("query", " ", "|").alias("subjects"),
        F.lit("data-analyst|data-engineer|data-scientist").alias("roles"),
        F.lit("").alias("products"),
        F.col("snippet.publishedAt").alias("last_modified"),
        F.concat(F.lit("https://www.youtube.com/watch?v="), video).alias("url"),
    )
    if fallback is None:
        return found
    return found.unionByName(fallback.select(*COURSE_FIELDS).where(~found.select("external_id").limit(1).exists()))


def is_relevant_module() -> Column:
    """A known subject, product or keyword makes a module relevant; roles alone never do."""

    def words(name: str) -> Column:
        return F.transform(F.coalesce(F.col(name), F.array().cast("array<string>")), lambda x: F.lower(F.trim(x)))

    def overlaps(name: str, known: list[str]) -> Column:
        return F.arrays_overlap(words(name), F.array(*[F.lit(k) for k in known]))

    text = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")), F.concat_ws(" ", words("products"))))
    keywords = "|".join(re.escape(k) for k in catalogs.MODULE_TEXT_KEYWORDS)
    return overlaps("subjects", catalogs.MODULE_SUBJECTS) | overlaps("products", catalogs.MODULE_PRODUCTS) | text.rlike(keywords)


def normalize_modules(df: DataFrame, limit: int | None = None) -> DataFrame:
    rows = _limited(df.where(F.coalesce(is_relevant_module(), F.lit(False))), limit, F.asc("ordinal"))
    return rows.select(
        F.col("uid").alias("external_id"),
        "title",
        F.lit("Microsoft Learn").alias("platform"),
        F.concat_ws(", ", "levels").alias("level"),
        F.lit(None).cast("double").alias("rating"),
        F.col("duration_in_minutes").alias("duration_minutes"),
        F.col("summary").alias("description"),
        *[F.concat_ws("|", c).alias(c) for c in ("subjects", "roles", "products")],
        "last_modified",
        "url",
    )


def found_tracks(index: DataFrame, tracks: DataFrame) -> DataFrame:
    """Known tracks whose file stands in the curriculum index."""
    files = index.where(F.col("type") == "file").select(
        F.col("name").alias("filename"), F.coalesce("html_url", F.lit("")).alias("repository_url"),
        F.coalesce("path", F.lit("")).alias("repository_path"),
    ).dropDuplicates(["filename"])
    return files.join(tracks, "filename")


def normalize_curriculum(index: DataFrame, tracks: DataFrame) -> DataFrame:
    rows = found_tracks(index, tracks)
    return rows.select(
        F.concat(F.lit("freecodecamp-"), F.col("slug")).alias("external_id"),
        "title",
        F.lit("freeCodeCamp Curriculum").alias("platform"),
        F.lit("Self-paced").alias("level"),
        F.lit(None).cast("double").alias("rating"),
        F.lit(None).cast("int").alias("duration_minutes"),
        F.concat(F.lit("Project-based freeCodeCamp curriculum for "), F.col("skill"), F.lit(".")).alias("description"),
        "subjects", "roles", "products",
        F.lit(None).cast("string").alias("last_modified"),
        F.concat(F.lit("https://www.freecodecamp.org/learn/"), F.col("slug"), F.lit("/")).alias("url"),
    )


def normalize_learning_repos(repos: DataFrame, topics: DataFrame) -> DataFrame:
    """The most starred acceptable repository per topic."""
    name_words = F.split(F.lower(F.coalesce("name", F.lit(""))), "[-_.]")
    acceptable = (
        ~F.coalesce("archived", F.lit(False))
        & F.coalesce("full_name", F.lit("")).rlike(r"^[A-Za-z0-9_.-]+/[A-Za-z0-9_.-]+$")
        & F.arrays_overlap(name_words, F.array(F.lit("awesome"), F.lit("roadmap")))
        & (F.lower(F.regexp_extract(F.coalesce("html_url", F.lit("")), "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)) == "github.com")
    )
    first = latest_per_group(repos.where(acceptable), ["topic"], F.desc("stargazers_count"), F.asc("full_name"))
    return first.select("topic", "id", "full_name", "html_url", "pushed_at").join(topics, "topic").select(
        F.concat(F.lit("github-learning-"), F.coalesce(F.col("id").cast("string"), F.col("full_name"))).alias("external_id"),
        F.concat(F.col("skill"), F.lit(" learning path: "), F.col("full_name")).alias("title"),
        F.lit("GitHub Learning Paths").alias("platform"),
        F.lit("Community curated").alias("level"),
        F.lit(None).cast("double").alias("rating"),
        F.lit(None).cast("int").alias("duration_minutes"),
        F.concat(F.lit("Recently maintained curated repository for learning "), F.col("skill"), F.lit(".")).alias("description"),
        "subjects", "roles",
        F.col("topic").alias("products"),
        F.col("pushed_at").alias("last_modified"),
        F.col("html_url").alias("url"),
    )


# --- credentials --------------------------------------------------------------------------------

def _first(values: Column) -> Column:
    return F.get(F.filter(values, lambda v: F.coalesce(v, F.lit("")) != ""), F.lit(0))


def _either(json: Column, *keys: str) -> Column:
    fields = F.from_json(json, "map<string,string>")
    empty = ("", "[]", "{}", "null", "false", "0")
    return _first(F.transform(F.array(*[F.lit(k) for k in keys]), lambda k: F.when(~F.element_at(fields, k).isin(*empty), F.element_at(fields, k))))


def unwrap_results(responses: DataFrame, column: str = "value") -> DataFrame:
    """One row per resource of a search response: the entry's resource, or the entry itself."""
    results = F.from_json(_either(F.col(column), "Results", "results"), "array<string>")
    entries = responses.select(F.explode(results).alias("entry")).where(F.col("entry").rlike(r"^\s*\{"))
    resource = F.coalesce(_either(F.col("entry"), "Resource", "resource"), F.col("entry"))
    return entries.select(resource.alias("resource")).where(F.col("resource").rlike(r"^\s*\{"))


def normalize_credentials(resources: DataFrame, verified: str, rules=catalogs.CREDENTIAL_KEYWORDS) -> DataFrame:
    """Registry resources with a name and a tracked skill as certification rows."""
    r = F.col("resource")
    found = json_walk.texts(
        r, name=("ceterms:name", "name"), description=("ceterms:description", "description"), page=("ceterms:subjectWebpage", "subjectWebpage")
    )
    provider = json_walk.organizations(r, ("ceterms:ownedBy", "ceterms:offeredBy", "ownedBy", "offeredBy"), ("ceterms:name", "name"))
    staged = resources.select(r, found.alias("found"), provider.alias("provider")).select("resource", "found.*", "provider")
    tagged = staged.withColumn("skill", rl.first_keyword(F.concat_ws(" ", "name", "description"), rules)).where(
        (F.col("name") != "") & F.col("skill").isNotNull()
    )
    return tagged.select(
        "skill",
        F.col("name").alias("certification_name"),
        F.coalesce(blank_to_null(F.col("provider")), F.lit("Credential Engine publisher")).alias("provider"),
        F.lit("Not listed").alias("level"),
        F.lit("Not listed").alias("free_or_paid"),
        F.lit(None).cast("double").alias("estimated_cost_usd"),
        target_roles(F.col("skill")).alias("target_roles"),
        F.coalesce(blank_to_null(F.col("page")), _either(r, "@id"), F.lit("https://credentialfinder.org/")).alias("url"),
        F.lit(72).alias("priority_score"),
        F.lit("credential_engine_registry").alias("source_name"),
        F.lit("live_verified").alias("source_confidence"),
        F.lit(verified).cast("date").alias("last_verified"),
    )
