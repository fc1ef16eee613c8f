"""Vocabularies, weights, labels and orders that results depend on.

Nothing here is computed; every list is in its natural order.
"""

from __future__ import annotations

# Closed value sets of the data model.
FUNDING_STAGES = ("seed", "series_a", "series_b", "series_c", "series_d_plus", "public", "unknown")
SIGNAL_TYPES = (
    "funding", "founder_post", "ats_greenhouse", "ats_lever", "ats_ashby", "career_page",
    "github_spike", "blog_post", "news", "yc_jobs", "wellfound",
)
ROLE_TYPES = (
    "backend", "fullstack", "ai_ml", "infra", "platform", "distributed", "frontend", "mobile", "data", "unknown",
)
OUTREACH_STATUSES = (
    "identified", "drafted", "sent", "responded", "screening", "interviewing", "offer", "closed",
)
EXECUTION_STATUSES = ("tracking", "reached_out", "applied", "follow_up", "interview", "offer", "closed")

# Title words per role type; the first type with a hit wins.
ROLE_TYPE_WORDS = (
    ("ai_ml", ("machine learning", "ml engineer", "ai engineer", "llm", "applied ai")),
    ("infra", ("infrastructure", "infra", "sre", "reliability", "devops", "platform")),
    ("distributed", ("distributed", "systems engineer", "storage", "database")),
    ("fullstack", ("full stack", "fullstack", "full-stack")),
    ("backend", ("backend", "back-end", "back end", "server", "api")),
    ("frontend", ("frontend", "front-end", "react", "vue", "ui engineer")),
    ("backend", ("software engineer", "software developer")),
)

# Title words per seniority; the first level with a hit wins.
SENIORITY_WORDS = (
    ("principal", ("principal", "distinguished", "fellow")),
    ("staff", ("staff", "architect")),
    ("lead", ("lead",)),
    ("senior", ("senior", " sr ")),
    ("junior", ("junior", " jr ", "associate", "entry")),
)

TARGET_TITLE_WORDS = (
    "software engineer", "backend engineer", "backend developer", "full stack", "fullstack", "full-stack",
    "infrastructure engineer", "platform engineer", "distributed systems", "systems engineer", "ai engineer",
    "ml engineer", "machine learning", "applied ai", "llm engineer", "site reliability", "sre",
)
# Extra target titles and role types of the accelerator listing.
LISTING_TITLE_WORDS = (
    "founding engineer", "founding full stack", "founding ai engineer", "founding backend",
    "platform engineer", "reliability engineer", "software engineer",
)
LISTING_ROLE_TYPES = (
    "android", "backend", "data science", "devops", "embedded systems", "engineering manager", "frontend",
    "full stack", "ios", "machine learning", "qa engineer", "robotics", "hardware", "electrical", "mechanical",
    "bioengineering", "chemical engineering",
)
LISTING_ROLE_TYPE_MAP = {
    "backend": "backend", "full stack": "fullstack", "frontend": "frontend", "machine learning": "ai_ml",
    "data science": "data", "devops": "infra", "engineering manager": "platform", "android": "mobile",
    "ios": "mobile",
}

# Technology vocabularies.
LANGUAGES = (
    "go", "golang", "rust", "python", "typescript", "javascript", "java", "kotlin", "scala", "c++", "ruby",
    "elixir", "swift",
)
FRAMEWORKS = (
    "fastapi", "django", "flask", "gin", "axum", "actix", "rails", "spring", "grpc", "graphql", "rest", "trpc",
    "nextjs", "react",
)
INFRA_TOOLS = (
    "kubernetes", "k8s", "docker", "terraform", "aws", "gcp", "azure", "postgres", "postgresql", "mysql", "redis",
    "kafka", "rabbitmq", "elasticsearch", "clickhouse", "s3", "lambda", "firecracker", "wasm", "webassembly",
    "cuda", "triton", "ray", "spark",
)
INFRA_REPO_WORDS = (
    "infra", "platform", "deploy", "k8s", "helm", "terraform", "ops", "gateway", "proxy", "runtime", "scheduler",
    "agent",
)

# Remote words in a location, per source.
REMOTE_WORDS = {
    "greenhouse": ("remote", "anywhere", "distributed"),
    "ashby": ("remote", "anywhere", "distributed", "worldwide"),
    "listing": ("remote", "anywhere", "worldwide"),
    "career_page": ("remote", "anywhere", "distributed"),
}
US_WORDS = ("us", "united states", "america", "usa")

# Board token patterns, tried in order.
BOARD_TOKEN_PATTERNS = {
    "greenhouse": (
        r"(?i)https?://boards\.greenhouse\.io/([a-z0-9_-]+)",
        r"(?i)https?://job-boards\.greenhouse\.io/([a-z0-9_-]+)",
        r"(?i)https?://boards-api\.greenhouse\.io/v1/boards/([a-z0-9_-]+)",
        r"(?i)[?&]for=([a-z0-9_-]+)",
    ),
    "ashby": (
        r"""(?i)https?://jobs\.ashbyhq\.com/([^"'/?#\s]+)""",
        r"""(?i)https?://api\.ashbyhq\.com/posting-api/job-board/([^"'/?#\s]+)""",
    ),
}
EXCLUDED_DISCOVERY_HOST = "workatastartup.com"

# Hints that a link or a page is about open jobs.
CAREER_LINK_WORDS = ("career", "careers", "jobs", "join", "open-roles", "work-with-us", "workwithus")
CAREER_ANCHOR_WORDS = ("career", "careers", "jobs", "join", "open roles", "open positions")
CAREER_URL_WORDS = ("career", "careers", "jobs", "greenhouse", "lever", "ashby", "workable")
CAREER_PAGE_WORDS = (
    "open roles", "open positions", "job openings", "join our team", "greenhouse.io", "jobs.ashbyhq.com",
    "jobs.lever.co", "workable.com",
)
CANONICAL_URL_WORDS = ("career", "careers", "jobs")
JOB_HREF_WORDS = (
    "/job", "/career", "/role", "/opening", "/position", "lever.co", "greenhouse.io", "ashby", "workable",
)

# Feed entry lexicon: phrase -> weight.
HIRING_PHRASES = {
    "we're hiring": 36.0, "we are hiring": 36.0, "hiring": 24.0, "join us": 18.0, "join our team": 18.0,
    "open roles": 20.0, "careers": 14.0, "come work": 20.0, "we raised and are hiring": 28.0,
    "we're growing": 16.0, "team is growing": 16.0, "engineering team": 14.0, "eng org": 14.0,
}
ENGINEERING_PHRASES = {
    "backend": 8.0, "distributed systems": 12.0, "platform": 8.0, "infra": 8.0, "infrastructure": 8.0,
    "systems": 6.0, "developer tools": 10.0, "database": 8.0, "ai": 4.0, "ml": 4.0, "staff engineer": 14.0,
    "senior engineer": 10.0, "principal engineer": 14.0,
}
DOWNRANK_PHRASES = {
    "customer story": -18.0, "case study": -18.0, "webinar": -12.0, "podcast": -10.0, "event recap": -10.0,
    "product roundup": -6.0,
}
TITLE_BONUS_WORDS = ("hiring", "careers", "join", "engineering")
HIRING_GATE_WORDS = ("hiring", "join", "careers", "open roles")

# Funding news.
FUNDING_ROUND_BASE = {
    "seed": 45.0, "pre-seed": 30.0, "series a": 70.0, "series b": 80.0, "series c": 65.0, "series d": 50.0,
    "growth": 55.0,
}
FUNDING_SECTOR_WORDS = (
    "ai", "ml", "infrastructure", "platform", "developer tools", "devtools", "database", "api", "backend", "cloud",
    "security", "data", "analytics", "fintech", "b2b", "saas", "open source",
)
FUNDING_NEWS_WORDS = ("raise", "raised", "funding", "fund", "seed", "series", "investment")
FUNDING_BRIEF_NEWS_WORDS = ("raises", "funding", "series", "seed")
FUNDING_ROUNDUP_WORDS = ("raises", "raised", "series", "seed", "funding")
FUNDING_ANCHOR_WORDS = ("raises", "raised", "series", "seed", "funding", "investment")
# Shared by the two patterns that read a company before its verb.
DEAL_VERBS = (
    "raises?", "raised", "secures?", "secured", "closes?", "closed", "lands?", "landed", "captures?", "captured",
    "charts?", "charted", "wins?", "won", "nabs?", "nabbed", r"locks\s+down", r"locked\s+down",
)

# Labels.
SIGNAL_TYPE_LABELS = {
    "funding": "Funding Event", "founder_post": "Founder Post", "ats_greenhouse": "ATS — Greenhouse",
    "ats_lever": "ATS — Lever", "ats_ashby": "ATS — Ashby", "career_page": "Career Page Diff",
    "github_spike": "GitHub Activity", "blog_post": "Engineering Blog", "yc_jobs": "YC Jobs",
    "wellfound": "Wellfound", "news": "News",
}
EXECUTION_LABELS = {
    "tracking": "Tracking", "reached_out": "Reached out", "applied": "Applied", "follow_up": "Follow-up due",
    "interview": "Interview", "offer": "Offer", "closed": "Closed",
}

# Signal score by type: (base, horizon in days).
SIGNAL_DECAY = {
    "founder_post": (80.0, 14), "ats_greenhouse": (65.0, 30), "ats_lever": (65.0, 30), "ats_ashby": (65.0, 30),
    "career_page": (60.0, 14), "blog_post": (35.0, 30),
}
# Scores that a source gives to every one of its signals.
SOURCE_SCORES = {
    "greenhouse_job": 65.0, "yc_job": 55.0, "portfolio_remote": 60.0, "portfolio_onsite": 57.0,
    "page_added": 72.0, "page_removed": 25.0, "batch_posting": 88.0, "new_repo": 45.0,
}

# Console weights.
CONSOLE_SIGNAL_WEIGHT = {"founder_post": 30, "career_page": 24, "funding": 18, "github_spike": 10}
CONSOLE_OTHER_SIGNAL_WEIGHT = 6
STAGE_ORDINAL = {
    "unknown": 0.0, "seed": 1.0, "series_a": 2.0, "series_b": 3.0, "series_c": 4.0, "series_d_plus": 5.0,
    "public": 6.0,
}
# Text words per role family when a company has no open role.
FAMILY_WORDS = (
    ("frontend", ("frontend", "react")),
    ("ai_ml", ("ai", "ml", "gpu")),
    ("distributed", ("distributed", "database", "storage")),
    ("infra", ("infra", "platform", "kubernetes")),
)
