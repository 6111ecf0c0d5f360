"""Small built-in catalogs (job samples, course catalogs, tracks, topics, certifications).

Every table below is a set of fixed values.  A row is a tuple in the order of the named columns.
"""

JOB_COLUMNS = "external_id title company location remote_type salary_min salary_max posted_at url description".split()

# Sample jobs per source.
SEED_JOBS = [
    ("job-001", "Data Engineer", "Northstar Analytics", "New York, NY", "Hybrid", 110000, 145000, "2026-06-20", "https://example.com/jobs/data-engineer-001",
     "Build Python and SQL pipelines with Airflow, dbt, PostgreSQL, and AWS."),
    ("job-002", "Data Analyst", "BrightCart", "Remote", "Remote", 78000, 98000, "2026-06-18", "https://example.com/jobs/data-analyst-002",
     "Analyze ecommerce KPIs with SQL, Python, Power BI, Excel, and A/B testing."),
    ("job-003", "Data Scientist", "CareMap AI", "Boston, MA", "On-site", 125000, 165000, "2026-06-16", "https://example.com/jobs/data-scientist-003",
     "Train machine learning models using Python, pandas, scikit-learn, NLP, and cloud data platforms."),
]
STARTUP_JOBS = [
    ("startup-job-001", "Analytics Engineer", "PulseMetrics", "Remote", "Remote", 118000, 152000, "2026-06-22", "https://example.com/jobs/startup-analytics-engineer-001",
     "Own dbt models, SQL transformations, Snowflake marts, Python data checks, and BI-ready semantic layers."),
    ("startup-job-002", "Product Data Scientist", "SignalCart", "San Francisco CA", "Hybrid", 140000, 185000, "2026-06-21", "https://example.com/jobs/startup-product-data-scientist-002",
     "Use Python, SQL, statistics, A/B testing, forecasting, machine learning, and dashboards to explain product growth."),
    ("startup-job-003", "Data Platform Engineer", "Lakehouse Labs", "Austin TX", "Hybrid", 135000, 172000, "2026-06-19", "https://example.com/jobs/startup-data-platform-engineer-003",
     "Build Spark and Databricks pipelines with AWS, Docker, APIs, Airflow, data quality checks, and lakehouse governance."),
]
ENTERPRISE_JOBS = [
    ("enterprise-job-001", "Senior BI Developer", "Northwind Financial", "Chicago IL", "Hybrid", 105000, 138000, "2026-06-20", "https://example.com/jobs/enterprise-bi-developer-001",
     "Develop Power BI dashboards, DAX measures, SQL Server models, data visualization standards, and executive KPI reporting."),
    ("enterprise-job-002", "Cloud Data Engineer", "Orion Health Systems", "Boston MA", "On-site", 128000, 164000, "2026-06-18", "https://example.com/jobs/enterprise-cloud-data-engineer-002",
     "Deliver Azure Data Factory, Azure, SQL, Python, APIs, data modeling, ETL, and data quality controls for analytics teams."),
    ("enterprise-job-003", "Responsible AI Data Analyst", "Civic Insight Group", "Washington DC", "Remote", 98000, 126000, "2026-06-17", "https://example.com/jobs/enterprise-responsible-ai-analyst-003",
     "Analyze GenAI, LLMs, NLP, responsible AI, SQL, Python, data quality, model governance, and Tableau reporting workflows."),
]

COURSE_COLUMNS = "external_id title platform level rating duration_minutes description subjects roles products last_modified url".split()

# Sample and catalog courses per source.
SEED_COURSES = [
    ("course-001", "SQL for Data Analytics", "Open Learning Catalog", "Beginner", 4.7, None,
     "Learn SQL joins, aggregations, window functions, dashboards, and analytics workflows.", None, None, None, None, "https://example.com/courses/sql-analytics"),
    ("course-002", "Modern Data Engineering with Python", "Open Learning Catalog", "Intermediate", 4.6, None,
     "Build ETL pipelines with Python, pandas, PostgreSQL, Airflow, APIs, and data quality checks.", None, None, None, None, "https://example.com/courses/python-data-engineering"),
    ("course-003", "Power BI Dashboard Design", "Open Learning Catalog", "Beginner", 4.5, None,
     "Create Power BI reports, DAX measures, KPI cards, and executive dashboards.", None, None, None, None, "https://example.com/courses/power-bi-dashboard-design"),
]
VIDEO_COURSES = [
    ("youtube-python-data-engineering", "Python Data Engineering Tutorial", "YouTube Learning", "Beginner", None, None,
     "Video tutorial covering Python, APIs, ETL, pandas, SQL, PostgreSQL, and data pipelines.",
     "python|etl|apis|data-engineering|sql", "data-engineer|data-analyst", "python|postgresql|pandas", "2026-06-01", "https://www.youtube.com/results?search_query=python+data+engineering+tutorial"),
    ("youtube-power-bi-dashboard", "Power BI Full Course for Data Analysts", "YouTube Learning", "Beginner", None, None,
     "Video course covering Power BI, DAX, dashboards, KPI reporting, data visualization, and analytics.",
     "power-bi|data-visualization|dashboarding|analytics", "data-analyst|bi-analyst", "power-bi", "2026-06-01", "https://www.youtube.com/results?search_query=power+bi+full+course+data+analyst"),
    ("youtube-sql-analytics", "SQL for Data Analytics Course", "YouTube Learning", "Beginner", None, None,
     "Video course covering SQL, joins, window functions, data modeling, analytics, and interview practice.",
     "sql|analytics|data-modeling", "data-analyst|analytics-engineer", "sql|postgresql", "2026-06-01", "https://www.youtube.com/results?search_query=sql+for+data+analytics+course"),
    ("youtube-airflow-dbt", "Airflow and dbt Data Pipeline Tutorial", "YouTube Learning", "Intermediate", None, None,
     "Video tutorial covering Airflow, dbt, Docker, orchestration, ELT, data quality, and analytics engineering.",
     "airflow|dbt|docker|elt|data-quality", "data-engineer|analytics-engineer", "airflow|dbt|docker", "2026-06-01", "https://www.youtube.com/results?search_query=airflow+dbt+data+pipeline+tutorial"),
]
OPEN_COURSES = [
    ("open-course-python-data-analysis", "Python for Data Analysis", "Open Course Catalog", "Beginner", None, 480,
     "Learn Python, pandas, NumPy, visualization, APIs, and data cleaning for analytics projects.",
     "python|data-analysis|pandas|numpy|apis", "data-analyst|data-scientist", "python|pandas", "2026-01-15", "https://www.freecodecamp.org/learn/data-analysis-with-python/"),
    ("open-course-sql-analytics", "SQL Analytics and Databases", "Open Course Catalog", "Beginner", None, 360,
     "Practice SQL, joins, aggregations, PostgreSQL, data modeling, and analytics-ready query patterns.",
     "sql|databases|data-modeling|analytics", "data-analyst|data-engineer|analytics-engineer", "postgresql|sql", "2026-02-10", "https://www.kaggle.com/learn/intro-to-sql"),
    ("open-course-bi-dashboarding", "Business Intelligence Dashboarding", "Open Course Catalog", "Intermediate", None, 300,
     "Design KPI dashboards with Power BI, Tableau, data visualization, DAX-style measures, and storytelling.",
     "business-intelligence|data-visualization|dashboards", "data-analyst|bi-analyst|bi-developer", "power-bi|tableau", "2026-03-05", "https://learn.microsoft.com/training/powerplatform/power-bi"),
    ("open-course-modern-data-engineering", "Modern Data Engineering Foundations", "Open Course Catalog", "Intermediate", None, 540,
     "Build ETL and ELT pipelines with Airflow, dbt, Docker, APIs, data quality checks, and cloud warehouses.",
     "data-engineering|etl|elt|data-quality|orchestration", "data-engineer|analytics-engineer", "airflow|dbt|docker", "2026-04-12", "https://github.com/DataTalksClub/data-engineering-zoomcamp"),
    ("open-course-cloud-data-platforms", "Cloud Data Platforms", "Open Course Catalog", "Intermediate", None, 420,
     "Compare AWS, Azure, GCP, Snowflake, Databricks, Spark, and lakehouse patterns for data platforms.",
     "cloud|data-engineering|big-data|lakehouse", "cloud-data-engineer|data-platform-engineer", "aws|azure|gcp|snowflake|databricks|spark", "2026-05-20", "https://www.databricks.com/learn/training/home"),
    ("open-course-genai-analytics", "Generative AI for Data Workflows", "Open Course Catalog", "Intermediate", None, 360,
     "Apply GenAI, LLMs, NLP, responsible AI, and APIs to analytics automation and data products.",
     "generative-ai|machine-learning|nlp|responsible-ai", "data-scientist|ai-engineer|analytics-engineer", "llms|apis", "2026-06-01", "https://www.deeplearning.ai/short-courses/"),
]
VENDOR_COURSES = [
    ("vendor-docs-airflow-orchestration", "Apache Airflow Orchestration Tutorial", "Vendor Docs Catalog", "Intermediate", None, 240,
     "Learn Airflow DAGs, data pipelines, scheduling, retries, orchestration, and data engineering operations.",
     "airflow|data-engineering|orchestration|data-pipelines", "data-engineer|analytics-engineer", "airflow", "2026-03-15", "https://airflow.apache.org/docs/apache-airflow/stable/tutorial/index.html"),
    ("vendor-docs-dbt-fundamentals", "dbt Fundamentals", "Vendor Docs Catalog", "Intermediate", None, 300,
     "Build dbt models, tests, documentation, SQL transformations, semantic layers, and analytics engineering workflows.",
     "dbt|sql|analytics-engineering|data-quality", "analytics-engineer|data-engineer", "dbt", "2026-04-18", "https://docs.getdbt.com/guides"),
    ("vendor-docs-snowflake-lakehouse", "Snowflake Data Engineering Guides", "Vendor Docs Catalog", "Intermediate", None, 360,
     "Use Snowflake, SQL, data modeling, ELT, data quality, and warehouse optimization for analytics-ready data.",
     "snowflake|sql|elt|data-modeling", "data-engineer|analytics-engineer", "snowflake", "2026-05-08", "https://docs.snowflake.com/en/guides"),
]
UNIVERSITY_COURSES = [
    ("university-open-statistics", "Statistics and Inference for Data Science", "University Open Catalog", "Beginner", None, 600,
     "Study statistics, forecasting, experimentation, A/B testing, regression, and uncertainty for data science decisions.",
     "statistics|forecasting|experimentation|data-science", "data-scientist|data-analyst|product-analyst", "statistics", "2026-01-30", "https://www.edx.org/learn/statistics"),
    ("university-open-ml", "Machine Learning Foundations", "University Open Catalog", "Intermediate", None, 720,
     "Learn machine learning, Python, scikit-learn, PyTorch, NLP, model evaluation, and responsible AI concepts.",
     "machine-learning|python|nlp|responsible-ai", "data-scientist|ml-engineer|ai-engineer", "python|scikit-learn|pytorch", "2026-02-28", "https://ocw.mit.edu/search/?q=machine%20learning"),
    ("university-open-data-visualization", "Data Visualization and Storytelling", "University Open Catalog", "Beginner", None, 420,
     "Design data visualization, dashboards, Tableau, Power BI, charts, and executive communication for analytics users.",
     "data-visualization|business-intelligence|analytics", "data-analyst|bi-analyst", "tableau|power-bi", "2026-03-22", "https://ocw.mit.edu/search/?q=data%20visualization"),
]

TRACK_COLUMNS = "filename slug title skill subjects roles products".split()

# Curriculum tracks, matched to the curriculum index by file name.
CURRICULUM_TRACKS = [
    ("python-v9.yml", "python-v9", "Python Certification", "Python", "python|programming|data-analysis", "data-analyst|data-engineer|data-scientist", "python"),
    ("relational-databases-v9.yml", "relational-databases-v9", "Relational Databases Certification", "SQL", "sql|relational-databases|postgresql", "data-analyst|data-engineer|analytics-engineer", "sql|postgresql"),
    ("data-analysis-with-python.yml", "data-analysis-with-python", "Data Analysis with Python Certification", "pandas", "python|pandas|numpy|data-analysis", "data-analyst|data-scientist", "python|pandas|numpy"),
    ("data-visualization.yml", "data-visualization", "Data Visualization Certification", "Data Visualization", "data-visualization|d3|dashboards", "data-analyst|bi-analyst", "d3"),
    ("machine-learning-with-python.yml", "machine-learning-with-python", "Machine Learning with Python Certification", "Machine Learning", "machine-learning|python|tensorflow", "data-scientist|ml-engineer", "python|tensorflow"),
    ("back-end-development-and-apis-v9.yml", "back-end-development-and-apis-v9", "Back End Development and APIs Certification", "APIs", "apis|backend-development|databases", "data-engineer|backend-data-engineer", "apis"),
    ("responsive-web-design-v9.yml", "responsive-web-design-v9", "Responsive Web Design Certification", "HTML", "html|css|responsive-web-design|accessibility", "frontend-engineer|full-stack-engineer", "html|css"),
    ("javascript-algorithms-and-data-structures-v8.yml", "javascript-algorithms-and-data-structures-v8", "JavaScript Algorithms and Data Structures Certification", "JavaScript", "javascript|algorithms|data-structures|programming", "frontend-engineer|full-stack-engineer|software-engineer", "javascript"),
    ("front-end-development-libraries.yml", "front-end-development-libraries", "Front End Development Libraries Certification", "React", "react|frontend|javascript|web-development", "frontend-engineer|full-stack-engineer", "react|javascript"),
    ("information-security-v7.yml", "information-security", "Information Security Certification", "Cybersecurity", "cybersecurity|information-security|python|secure-development", "security-analyst|security-engineer", "python"),
    ("quality-assurance-v7.yml", "quality-assurance", "Quality Assurance Certification", "Test Automation", "quality-assurance|test-automation|javascript|apis", "qa-automation-engineer|software-engineer", "javascript|apis"),
]

TOPIC_COLUMNS = "skill topic subjects roles".split()

# Learning-path topics.
LEARNING_TOPICS = [
    ("Data Pipelines", "data-engineering", "data-engineering|etl|data-pipelines", "data-engineer|analytics-engineer"),
    ("Airflow", "apache-airflow", "airflow|orchestration|data-pipelines", "data-engineer|analytics-engineer"),
    ("dbt", "dbt", "dbt|sql|analytics-engineering", "analytics-engineer|data-engineer"),
    ("Machine Learning", "machine-learning", "machine-learning|python|modeling", "data-scientist|ml-engineer"),
    ("Power BI", "power-bi", "power-bi|business-intelligence|data-visualization", "data-analyst|bi-analyst"),
    ("Snowflake", "snowflake", "snowflake|data-warehouse|sql", "data-engineer|analytics-engineer"),
    ("Kubernetes", "kubernetes", "kubernetes|containers|cloud|devops", "platform-engineer|devops-engineer|cloud-engineer"),
    ("Terraform", "terraform", "terraform|infrastructure-as-code|cloud|devops", "cloud-engineer|devops-engineer|platform-engineer"),
    ("Cybersecurity", "cybersecurity", "cybersecurity|information-security|secure-development", "security-analyst|security-engineer"),
    ("Software Engineering", "software-engineering", "software-engineering|programming|architecture", "software-engineer|backend-engineer|frontend-engineer"),
]

CERTIFICATION_COLUMNS = "skill certification_name provider level free_or_paid estimated_cost_usd target_roles url priority_score".split()

# Built-in certifications.
BUILTIN_CERTIFICATIONS = [
    ("SQL", "HackerRank SQL Certificate", "HackerRank", "Beginner", "Free", 0.0, "Data Analyst | BI Analyst | Analytics Engineer", "https://www.hackerrank.com/skills-verification/sql_basic", 82),
    ("Tableau", "Tableau Desktop Specialist", "Tableau", "Beginner", "Paid", 100.0, "BI Analyst | Data Visualization Specialist", "https://www.tableau.com/learn/certification/desktop-specialist", 72),
    ("dbt", "dbt Analytics Engineering Certification", "dbt Labs", "Intermediate", "Paid", 200.0, "Analytics Engineer | Data Engineer", "https://www.getdbt.com/certifications/analytics-engineering", 86),
    ("Snowflake", "SnowPro Core Certification", "Snowflake", "Intermediate", "Paid", 175.0, "Data Engineer | Warehouse Engineer", "https://www.snowflake.com/en/data-cloud-academy/certifications/", 80),
    ("Databricks", "Databricks Certified Data Engineer Associate", "Databricks", "Intermediate", "Paid", 200.0, "Data Engineer | Lakehouse Engineer", "https://www.databricks.com/learn/certification/data-engineer-associate", 82),
]

SUPPORTED_COLUMNS = "type source mode source_confidence use".split()

# The sources a pipeline run can read.
SUPPORTED_SOURCES = [
    ("Jobs", "Adzuna Jobs API", "adzuna", "live_verified", "Official job API. Requires free app id/key in .env."),
    ("Jobs", "Arbeitnow Job API", "arbeitnow", "live_verified", "Public no-key JSON job API."),
    ("Jobs", "Remotive Jobs API", "remotive", "live_verified", "Official remote-jobs JSON API."),
    ("Jobs", "HN Who's Hiring via Algolia", "hn", "live_broad", "Official read API for top-level data-role posts in the latest monthly hiring thread."),
    ("Jobs", "Sample Data Jobs", "curated", "curated_demo", "Local jobs with full data-role descriptions."),
    ("Jobs", "Startup Data Jobs", "startup", "curated_demo", "Small startup-style data job feed."),
    ("Jobs", "Enterprise Analytics Jobs", "enterprise", "curated_demo", "Small enterprise BI and cloud analytics feed."),
    ("Courses", "Seed Courses", "seed", "fallback_learning", "Offline smoke-test course data."),
    ("Courses", "YouTube Learning", "youtube", "fallback_learning", "Free video learning source. Uses API key when configured."),
    ("Courses", "Open Course Catalog", "open_catalog", "curated_demo", "Learning links that are easy to reproduce locally."),
    ("Courses", "Microsoft Learn Catalog", "microsoft", "live_verified", "Live public Microsoft Learn catalog API."),
    ("Courses", "freeCodeCamp Curriculum", "freecodecamp", "live_verified", "Official structured curriculum index for free data and programming tracks."),
    ("Courses", "GitHub Learning Paths", "github_learning", "live_broad", "Recently maintained awesome lists and roadmaps for tracked skills."),
    ("Courses", "Vendor Docs Catalog", "vendor_docs", "curated_demo", "Vendor documentation and training resources."),
    ("Courses", "University Open Catalog", "university_open", "curated_demo", "Open statistics, ML, and visualization resources."),
    ("Certifications", "Credential Engine Registry", "credential_engine or all", "live_verified", "Optional CTDL credential search. Requires an approved account and API key."),
    ("Certifications", "Cloud Certification Catalog", "curated", "curated_demo", "Manually verified AWS, Microsoft, and Google Cloud credentials."),
]

# Ordered keyword rules that give a credential its skill.
CREDENTIAL_KEYWORDS = [
    ("Microsoft Fabric", ("microsoft fabric", "fabric data engineer")),
    ("Power BI", ("power bi", "business intelligence")),
    ("Machine Learning", ("machine learning", "ml engineer")),
    ("Data Pipelines", ("data engineering", "data engineer", "data pipeline")),
    ("Data Visualization", ("data visualization", "data visualisation")),
    ("Database Administration", ("database administrator", "database administration", "dba")),
    ("Kubernetes", ("kubernetes", "cloud native")),
    ("Terraform", ("terraform", "infrastructure as code")),
    ("Cybersecurity", ("cybersecurity", "cyber security", "information security")),
    ("Networking", ("network engineer", "network administration", "ccna")),
    ("Linux", ("linux", "system administrator", "system administration")),
    ("JavaScript", ("javascript", "web development")),
    ("React", ("react developer", "frontend development")),
    ("Software Engineering", ("software engineer", "software development")),
    ("ITIL", ("itil", "it service management")),
    ("SQL", ("sql", "relational database")),
    ("Python", ("python",)),
    ("AWS", ("aws", "amazon web services")),
    ("Azure", ("azure",)),
    ("GCP", ("google cloud", "gcp")),
]

# Target roles of a certification, by skill.
CREDENTIAL_ROLES = {
    "Microsoft Fabric": "Fabric Data Engineer | Analytics Engineer",
    "Power BI": "Data Analyst | BI Analyst",
    "Machine Learning": "ML Engineer | Data Scientist",
    "Data Pipelines": "Data Engineer | Analytics Engineer",
    "Data Visualization": "Data Analyst | BI Analyst",
    "SQL": "Data Analyst | Data Engineer | Analytics Engineer",
    "Python": "Data Analyst | Data Scientist | Data Engineer",
    "AWS": "Cloud Data Engineer | Data Platform Engineer",
    "Azure": "Azure Data Engineer | Cloud Data Engineer",
    "GCP": "Cloud Data Engineer | Data Platform Engineer",
    "Database Administration": "Database Administrator | Database Reliability Engineer",
    "Kubernetes": "Platform Engineer | DevOps Engineer | Cloud Engineer",
    "Terraform": "Cloud Engineer | DevOps Engineer | Platform Engineer",
    "Cybersecurity": "Security Analyst | Security Engineer",
    "Networking": "Network Engineer | Network Administrator",
    "Linux": "Systems Administrator | Platform Engineer",
    "JavaScript": "Frontend Engineer | Full Stack Engineer",
    "React": "Frontend Engineer | Full Stack Engineer",
    "Software Engineering": "Software Engineer | Backend Engineer",
    "ITIL": "Technology Consultant | IT Service Manager",
}

# Repository topic of a skill where it is not simply the skill's slug.
TOPIC_ALIASES = {
    "Airflow": "apache-airflow",
    "AWS": "aws",
    "Azure": "azure",
    "Azure Data Factory": "azure-data-factory",
    "Data Visualization": "data-visualization",
    "dbt": "dbt",
    "Deep Learning": "deep-learning",
    "GCP": "google-cloud",
    "GenAI": "generative-ai",
    "LLMs": "large-language-models",
    "Machine Learning": "machine-learning",
    "Microsoft Fabric": "microsoft-fabric",
    "NLP": "natural-language-processing",
    "NoSQL": "nosql",
    "Power BI": "power-bi",
    "Responsible AI": "responsible-ai",
    "SQL Server": "sql-server",
}

# Keyword sets that make a learning module relevant.
MODULE_SUBJECTS = [
    "data-analysis", "data-engineering", "data-science", "machine-learning", "artificial-intelligence", "databases", "analytics", "visualization", "software-development",
    "web-development", "app-development", "cloud-computing", "devops", "cybersecurity", "security", "networking", "system-administration", "infrastructure",
]
MODULE_ROLES = [
    "data-analyst", "data-engineer", "data-scientist", "ai-engineer", "developer", "software-engineer", "cloud-engineer", "devops-engineer", "security-engineer",
    "security-operations-analyst", "network-engineer", "database-administrator", "administrator", "solution-architect", "technology-consultant",
]
MODULE_PRODUCTS = [
    "azure-machine-learning", "azure-sql-database", "azure-databricks", "azure-synapse-analytics", "power-bi", "fabric", "microsoft-fabric",
]
MODULE_TEXT_KEYWORDS = [
    "analytics", "data analysis", "data analytics", "data engineering", "data science", "database", "machine learning",
    "python", "sql", "power bi", "fabric", "azure synapse", "spark", "software development", "software engineering",
    "web development", "javascript", "typescript", "react", "node.js", "java", ".net", "cloud computing", "devops",
    "kubernetes", "terraform", "cybersecurity", "information security", "networking", "system administration",
    "database administration", "oracle database", "it service management", "solution architecture",
]
