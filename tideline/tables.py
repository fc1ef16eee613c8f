"""Domain tables over the driver tables.

Each view is one SELECT that Spark and DuckDB both run, so a query and its check
start from the same rows. ``Tables`` gives them as DataFrames; ``check_sql``
puts them in front of a query text as CTEs.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

DRIVER_TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
)

# The instant all registered queries look back from. Fixed value.
AS_OF = "2024-01-20 23:59:59.999999"
AS_OF_DATE = "2024-01-20"


class Dialect:
    """The few expressions the two engines spell differently."""

    def __init__(self, name: str):
        self.spark = name == "spark"

    def days(self, earlier: str, later: str) -> str:
        """Whole elapsed days, floored."""
        if self.spark:
            whole = f"datediff({later}, {earlier})"
            return f"({whole} - CASE WHEN {earlier} + make_dt_interval({whole}) > {later} THEN 1 ELSE 0 END)"
        return f"CAST(floor((epoch_us({later}) - epoch_us({earlier})) / 86400000000.0) AS INTEGER)"

    @property
    def now(self) -> str:
        return f"TIMESTAMP_NTZ '{AS_OF}'" if self.spark else f"TIMESTAMP '{AS_OF}'"

    def ts(self, text: str) -> str:
        return f"TIMESTAMP_NTZ '{text}'" if self.spark else f"TIMESTAMP '{text}'"

    def text(self, expr: str) -> str:
        return f"CAST({expr} AS STRING)" if self.spark else f"CAST({expr} AS VARCHAR)"

    def at_days(self, base: str, days: str) -> str:
        """``base`` plus a number of days."""
        return f"({base} + make_dt_interval({days}))" if self.spark else f"({base} + to_days(CAST({days} AS INTEGER)))"

    def list(self, *items: str) -> str:
        return f"array({', '.join(items)})" if self.spark else f"[{', '.join(items)}]"


def _companies(d: Dialect) -> str:
    return f"""
    SELECT c_custkey AS company_id, c_name AS name,
      replace(replace(replace(lower(c_name), ' ', '-'), '.', '-'), ',', '') AS slug,
      CASE c_mktsegment WHEN 'BUILDING' THEN 'seed' WHEN 'FURNITURE' THEN 'series_a' WHEN 'MACHINERY' THEN 'series_b'
        WHEN 'HOUSEHOLD' THEN 'series_c' ELSE 'unknown' END AS funding_stage,
      CASE WHEN c_acctbal > 0 THEN CAST(floor(c_acctbal * 10000 + 0.5) AS DOUBLE) END AS funding_amount_usd,
      CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE c_custkey % 400 END AS headcount,
      CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE c_custkey % 120 END AS engineering_headcount,
      c_nationkey % 2 = 0 AS remote_us,
      c_custkey % 7 = 0 AS on_watchlist,
      CASE WHEN c_custkey % 7 = 0 AND c_custkey % 4 <> 0
        THEN {d.at_days(d.ts('2023-12-25 08:00:00'), 'c_custkey % 25')} END AS watchlist_added_at,
      CAST(c_custkey % 50 AS INTEGER) AS watchlist_priority,
      CAST(c_custkey * 37 % 1000 AS DOUBLE) / 10 AS fit_score,
      CAST(c_custkey * 53 % 1000 AS DOUBLE) / 10 AS urgency_score,
      greatest(0, least(100, floor(c_acctbal / 10 + 0.5) / 10)) AS composite_score,
      CASE c_custkey % 5 WHEN 0 THEN 'go' WHEN 1 THEN 'python' WHEN 2 THEN 'rust' WHEN 3 THEN 'typescript'
        ELSE 'java' END AS stack_language,
      CASE c_custkey % 4 WHEN 0 THEN 'fastapi' WHEN 1 THEN 'react' WHEN 2 THEN 'grpc' ELSE 'rails' END AS stack_framework,
      CASE c_custkey % 6 WHEN 0 THEN 'kubernetes' WHEN 1 THEN 'docker' WHEN 2 THEN 'postgres' WHEN 3 THEN 'aws'
        WHEN 4 THEN 'redis' ELSE 'kafka' END AS stack_infra,
      lower(c_mktsegment) AS tagline,
      n_name AS hq_country
    FROM {{customer}} JOIN {{nation}} ON c_nationkey = n_nationkey"""


def _roles(d: Dialect) -> str:
    return f"""
    SELECT o_orderkey AS role_id, o_custkey AS company_id,
      concat('https://jobs.example/', {d.text('o_orderkey')}) AS url,
      concat(CASE o_orderkey % 5 WHEN 0 THEN 'Senior ' WHEN 1 THEN 'Staff ' WHEN 2 THEN 'Junior ' WHEN 3 THEN 'Lead ' ELSE '' END,
        CASE o_orderpriority WHEN '1-URGENT' THEN 'Backend Engineer' WHEN '2-HIGH' THEN 'ML Engineer'
          WHEN '3-MEDIUM' THEN 'Infrastructure Engineer' WHEN '5-LOW' THEN 'Frontend Developer' ELSE 'Recruiter' END) AS title,
      o_orderdate + INTERVAL 8217 DAYS AS first_seen_at,
      CASE WHEN o_orderstatus = 'F' AND last_ship IS NOT NULL
        THEN greatest(last_ship, o_orderdate) + INTERVAL 8217 DAYS END AS removed_at,
      CASE o_orderpriority WHEN '1-URGENT' THEN 'backend' WHEN '2-HIGH' THEN 'ai_ml' WHEN '3-MEDIUM' THEN 'infra'
        WHEN '5-LOW' THEN 'frontend' ELSE 'unknown' END AS role_type,
      CASE o_orderkey % 4 WHEN 0 THEN 'ats_greenhouse' WHEN 1 THEN 'ats_ashby' WHEN 2 THEN 'career_page'
        ELSE 'yc_jobs' END AS source,
      CASE o_orderkey % 5 WHEN 0 THEN 'senior' WHEN 1 THEN 'staff' WHEN 2 THEN 'junior' WHEN 3 THEN 'lead' ELSE 'mid' END AS seniority,
      o_orderkey % 3 = 0 AS is_remote_us,
      least(o_totalprice / 5000, 100) AS fit_score
    FROM {{orders}} LEFT JOIN
      (SELECT l_orderkey, max(l_shipdate) AS last_ship FROM {{lineitem}} GROUP BY l_orderkey) AS shipped
      ON o_orderkey = l_orderkey"""


def _role_state(d: Dialect) -> str:
    return f"""
    SELECT role_id, company_id, url, title, first_seen_at, removed_at, role_type, source, seniority, is_remote_us,
      is_remote_us AS is_remote, fit_score,
      removed_at IS NULL OR removed_at > {d.now} AS is_active,
      {d.days('first_seen_at', d.now)} AS days_open
    FROM {{roles}} WHERE first_seen_at <= {d.now}"""


def _signals(d: Dialect) -> str:
    return f"""
    SELECT event_id AS signal_id, user_id AS company_id,
      CASE event_type WHEN 'signup' THEN 'ats_greenhouse' WHEN 'error' THEN 'github_spike' WHEN 'click' THEN 'career_page'
        WHEN 'view' THEN 'founder_post' ELSE 'funding' END AS type,
      concat(event_type, ' ', props) AS headline,
      concat('https://news.example/', {d.text('event_id')}) AS source_url,
      ts AS signal_date,
      least(value / 4.9, 100) AS score,
      CASE WHEN event_type = 'purchase' THEN CAST(floor(value * 1000000 + 0.5) AS DOUBLE) END AS funding_amount_usd,
      CASE WHEN event_type = 'purchase' THEN
        CASE event_id % 4 WHEN 0 THEN 'seed' WHEN 1 THEN 'series a' WHEN 2 THEN 'series b' ELSE NULL END END AS funding_round
    FROM {{events}}"""


def _funding_history(d: Dialect) -> str:
    return """
    SELECT company_id, signal_date AS announced_at, funding_round AS round_type, funding_amount_usd AS amount_usd,
      'funding' AS source, source_url
    FROM {signals} WHERE type = 'funding'"""


def _role_skills(d: Dialect) -> str:
    return """
    SELECT l_orderkey AS role_id, l_linenumber AS pos,
      CASE p_size % 12 WHEN 0 THEN 'Go' WHEN 1 THEN 'Python' WHEN 2 THEN 'Rust' WHEN 3 THEN 'Kubernetes' WHEN 4 THEN 'Java'
        WHEN 5 THEN 'TypeScript' WHEN 6 THEN 'Postgres' WHEN 7 THEN 'gRPC' WHEN 8 THEN 'Scala' WHEN 9 THEN 'Docker'
        WHEN 10 THEN 'Redis' ELSE 'Ruby' END AS skill
    FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"""


def _outreach(d: Dialect) -> str:
    return f"""
    SELECT doc_id AS outreach_id, doc_id AS company_id,
      CASE WHEN quality = 1 AND toxic = 0 THEN 'sent' WHEN quality = 1 THEN 'responded' WHEN toxic = 0 THEN 'drafted'
        ELSE 'closed' END AS status,
      CASE WHEN doc_id % 9 = 0 THEN NULL ELSE {d.at_days(d.ts('2024-01-10 12:00:00'), 'doc_id % 20')} END AS follow_up_due
    FROM {{labels}}"""


def _execution_events(d: Dialect) -> str:
    return f"""
    SELECT conv_id * 1000 + turn AS event_id, conv_id AS company_id,
      CASE (conv_id + turn) % 7 WHEN 0 THEN 'tracking' WHEN 1 THEN 'reached_out' WHEN 2 THEN 'applied' WHEN 3 THEN 'follow_up'
        WHEN 4 THEN 'interview' WHEN 5 THEN 'offer' ELSE 'closed' END AS status,
      CASE WHEN length(text) % 3 = 0 THEN NULL ELSE concat('note ', {d.text('length(text)')}) END AS notes,
      CASE WHEN role = 'user' THEN concat('Engineer ', {d.text('conv_id')}) END AS target_role_title,
      CASE WHEN turn % 2 = 1 THEN {d.at_days(d.ts('2024-01-12 09:00:00'), 'turn + conv_id % 15')} END AS follow_up_due,
      {d.at_days(d.ts('2024-01-02 10:30:00'), 'turn')} AS occurred_at
    FROM {{conversations}}"""


def _commits(d: Dialect) -> str:
    return """
    SELECT event_id AS commit_id, user_id AS company_id, event_type AS repo, ts AS committed_at FROM {events}"""


def _snapshot_jobs(d: Dialect) -> str:
    return """
    SELECT l_suppkey AS company_id, extract(YEAR FROM l_shipdate) AS crawl,
      concat(p_name, CASE p_size % 4 WHEN 0 THEN ' Software Engineer' WHEN 1 THEN ' platform engineer' WHEN 2 THEN ' SRE'
        ELSE ' accountant' END) AS title,
      l_returnflag AS location, concat('https://careers.example/', lower(p_type)) AS url
    FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"""


VIEWS = {
    "companies": _companies,
    "roles": _roles,
    "role_state": _role_state,
    "signals": _signals,
    "funding_history": _funding_history,
    "role_skills": _role_skills,
    "outreach": _outreach,
    "execution_events": _execution_events,
    "commits": _commits,
    "snapshot_jobs": _snapshot_jobs,
}


def _names_in(sql: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", sql)))


class Tables:
    """Driver tables and domain views of one data folder, as lazy DataFrames."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        self._known: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._known:
            if name in VIEWS:
                sql = VIEWS[name](Dialect("spark"))
                inputs = {n: getattr(self, n) for n in _names_in(sql)}
                self._known[name] = self.spark.sql(sql, **inputs)
            elif name in DRIVER_TABLES:
                self._known[name] = self.spark.read.parquet(f"{self.folder}/{name}.parquet")
            else:
                raise AttributeError(name)
        return self._known[name]


def check_sql(body: str) -> str:
    """``body`` for DuckDB with the views it names as leading CTEs."""
    duck = Dialect("duckdb")
    ordered: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if name not in ordered and re.search(rf"\b{name}\b", text):
                own = VIEWS[name](duck)
                need(" ".join(_names_in(own)))
                ordered.append(name)

    need(body)
    ctes = []
    for name in ordered:
        own = VIEWS[name](duck)
        ctes.append(f"{name} AS ({own.format(**{n: n for n in _names_in(own)})})")
    body = body.strip()
    if not ctes:
        return body
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(ctes) + ",\n" + body[5:]
    return "WITH " + ",\n".join(ctes) + "\n" + body
