"""Source names, confidence labels, source views, source modes and trusted domains.  Fixed values."""

CONFIDENCE_LABELS = ("live_verified", "live_broad", "curated_demo", "fallback_learning", "test_source")
DEFAULT_CONFIDENCE = "test_source"

# Source ; confidence
SOURCE_CONFIDENCE = {
    "microsoft_learn_catalog": "live_verified",
    "freecodecamp_curriculum": "live_verified",
    "github_learning_paths": "live_broad",
    "adzuna_jobs": "live_verified",
    "arbeitnow_jobs": "live_verified",
    "remotive_jobs": "live_verified",
    "hackernews_who_is_hiring": "live_broad",
    "curated_data_jobs": "curated_demo",
    "curated_technology_jobs": "curated_demo",
    "startup_data_jobs": "curated_demo",
    "enterprise_analytics_jobs": "curated_demo",
    "open_course_catalog": "curated_demo",
    "official_learning_catalog": "curated_demo",
    "vendor_docs_catalog": "curated_demo",
    "university_open_catalog": "curated_demo",
    "youtube_learning": "fallback_learning",
    "seed_course_listings": "fallback_learning",
    "seed_job_postings": "test_source",
}

# View -> (job sources, course sources); None means every source.
SOURCE_VIEWS = {
    "demo": (
        ("seed_job_postings", "curated_data_jobs", "curated_technology_jobs", "startup_data_jobs", "enterprise_analytics_jobs"),
        ("seed_course_listings", "open_course_catalog", "official_learning_catalog", "vendor_docs_catalog", "university_open_catalog"),
    ),
    "live": (
        ("adzuna_jobs", "arbeitnow_jobs", "remotive_jobs", "hackernews_who_is_hiring"),
        ("microsoft_learn_catalog", "freecodecamp_curriculum", "github_learning_paths"),
    ),
    "curated": (
        ("curated_data_jobs", "curated_technology_jobs", "startup_data_jobs", "enterprise_analytics_jobs"),
        ("open_course_catalog", "official_learning_catalog", "vendor_docs_catalog", "university_open_catalog"),
    ),
    "all": (None, None),
}

# Job mode aliases -> ordered sources.
JOB_MODES = {
    ("seed",): ("seed_job_postings",),
    ("curated", "curated_data", "portfolio"): ("curated_data_jobs", "curated_technology_jobs"),
    ("startup", "startup_data"): ("startup_data_jobs",),
    ("enterprise", "enterprise_analytics"): ("enterprise_analytics_jobs",),
    ("adzuna", "adzuna_jobs"): ("adzuna_jobs",),
    ("arbeitnow", "arbeitnow_jobs"): ("arbeitnow_jobs",),
    ("remotive", "remotive_jobs"): ("remotive_jobs",),
    ("hn", "hackernews", "hackernews_who_is_hiring"): ("hackernews_who_is_hiring",),
    ("job_apis", "official_apis", "api_jobs"): ("adzuna_jobs", "arbeitnow_jobs", "remotive_jobs", "hackernews_who_is_hiring"),
    ("all", "all_demo", "portfolio_all", "five_sources"): (
        "curated_data_jobs", "curated_technology_jobs", "startup_data_jobs", "enterprise_analytics_jobs",
        "adzuna_jobs", "arbeitnow_jobs", "remotive_jobs", "hackernews_who_is_hiring",
    ),
}

# Course mode aliases -> ordered sources.
COURSE_MODES = {
    ("seed",): ("seed_course_listings",),
    ("open", "open_catalog", "curated_open"): ("open_course_catalog",),
    ("vendor", "vendor_docs"): ("vendor_docs_catalog",),
    ("university", "university_open"): ("university_open_catalog",),
    ("youtube", "youtube_learning"): ("youtube_learning",),
    ("freecodecamp", "freecodecamp_curriculum"): ("freecodecamp_curriculum",),
    ("github_learning", "github_learning_paths", "roadmaps"): ("github_learning_paths",),
    ("hybrid", "portfolio", "multi"): (
        "seed_course_listings", "open_course_catalog", "vendor_docs_catalog", "university_open_catalog", "official_learning_catalog",
    ),
    ("all", "all_demo", "portfolio_all", "five_sources"): (
        "youtube_learning", "open_course_catalog", "official_learning_catalog", "vendor_docs_catalog",
        "university_open_catalog", "microsoft_learn_catalog", "freecodecamp_curriculum", "github_learning_paths",
    ),
    ("official_live", "live_learning"): ("microsoft_learn_catalog", "freecodecamp_curriculum", "github_learning_paths"),
    ("microsoft_open", "microsoft_hybrid"): ("microsoft_learn_catalog", "open_course_catalog"),
    ("microsoft", "microsoft_learn", "learn"): ("microsoft_learn_catalog",),
}

# Hosts whose postings and courses count as trusted.
TRUSTED_JOB_DOMAINS = [
    "adzuna.com", "arbeitnow.com", "example.com", "news.ycombinator.com", "remotive.com", "www.adzuna.com", "www.arbeitnow.com", "www.remotive.com",
]
TRUSTED_COURSE_DOMAINS = [
    "cloud.google.com", "docs.docker.com", "docs.github.com", "docs.python.org", "docs.pytorch.org", "fastapi.tiangolo.com", "kafka.apache.org", "numpy.org",
    "pandas.pydata.org", "postgresql.org", "scikit-learn.org", "skillbuilder.aws", "spark.apache.org", "www.postgresql.org", "tensorflow.org", "www.tensorflow.org",
    "airflow.apache.org", "databricks.com", "deeplearning.ai", "docs.getdbt.com", "docs.snowflake.com", "edx.org", "example.com", "freecodecamp.org", "github.com",
    "kaggle.com", "learn.microsoft.com", "ocw.mit.edu", "youtube.com", "www.youtube.com", "developer.mozilla.org", "developer.hashicorp.com", "dotnet.microsoft.com",
    "huggingface.co", "kubernetes.io", "learn.mongodb.com", "mlflow.org", "netacad.com", "nextjs.org", "nodejs.org", "opencv.org", "oracle.com", "owasp.org",
    "playwright.dev", "react.dev", "redhat.com", "servicenow.com", "spring.io", "typescriptlang.org",
]
