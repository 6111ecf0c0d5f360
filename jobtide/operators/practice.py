"""Beginner-friendly issues to practise a skill on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from jobtide.functions.text import slug
from jobtide.operators.trends import latest_per_group
from jobtide.taxonomy import lookup
from jobtide.values import catalogs

LABELS = ("good first issue", "help wanted")


def topic_for_skill(skill: Column) -> Column:
    return F.coalesce(lookup(catalogs.TOPIC_ALIASES, skill), slug(skill, "data-engineering"))


def rank_practice_issues(repos: DataFrame, issues: DataFrame, limit: int = 8, repo_limit: int = 5) -> DataFrame:
    """The first ``limit`` issues per skill.

    ``repos`` carries a skill column, ``issues`` a repository name.  The order is label, stars of the
    repository, time of the last update; per repository and label only the latest ``min(10, limit)``
    issues are considered, pull requests left out afterwards, and an issue counts once.
    """
    top_repos = repos.where(~F.coalesce(F.col("archived"), F.lit(False))).withColumn(
        "repo_rank", F.row_number().over(W.partitionBy("skill").orderBy(F.desc("stargazers_count"), F.asc("full_name")))
    ).where(F.col("repo_rank") <= repo_limit)

    names = F.transform("labels", lambda l: l["name"])
    labelled = issues.withColumn("label_names", names).withColumn(
        "label_rank",
        F.explode(F.filter(
            F.array(*[F.when(F.array_contains(names, label), F.lit(n)) for n, label in enumerate(LABELS)]),
            lambda x: x.isNotNull(),
        )),
    )
    page = W.partitionBy("repository", "label_rank").orderBy(F.desc("updated_at"), F.asc("html_url"))
    listed = labelled.withColumn("page_rank", F.row_number().over(page)).where(F.col("page_rank") <= min(10, limit))
    # repositories and page rows are few per group by now, so this join cannot fan out
    joined = top_repos.select(
        "skill", "repo_rank", F.col("full_name").alias("repository"), F.col("html_url").alias("repository_url"),
        F.col("description").alias("repository_description"), F.array_join("topics", " | ").alias("repository_topics"),
        "language", F.coalesce("stargazers_count", F.lit(0)).alias("stars"), F.col("updated_at").alias("repository_updated_at"),
    ).join(
        listed.where(F.col("pull_request").isNull()).select(
            "repository", "label_rank", "page_rank", F.col("number").alias("issue_number"), F.col("title").alias("issue_title"),
            F.col("html_url").alias("issue_url"), F.array_join("label_names", " | ").alias("issue_labels"),
            F.col("updated_at").alias("issue_updated_at"),
        ),
        "repository",
    )
    order = [F.asc("label_rank"), F.asc("repo_rank"), F.asc("page_rank")]
    once = latest_per_group(joined, ["skill", "issue_url"], *order)
    ranked = once.withColumn("rank", F.row_number().over(W.partitionBy("skill").orderBy(*order)))
    return ranked.where(F.col("rank") <= limit).select(
        "skill", "rank", "repository", "repository_url", "repository_description", "repository_topics", "language", "stars",
        "repository_updated_at", "issue_number", "issue_title", "issue_url", "issue_labels",
        F.get(F.array(*[F.lit(x) for x in LABELS]), F.col("label_rank")).alias("practice_label"), "issue_updated_at",
        F.lit("github_public_api").alias("source_name"), F.lit("live_verified").alias("source_confidence"),
    )
