"""Schemas of state tables and staging frames, as DDL."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

STACK = "struct<languages:array<string>,frameworks:array<string>,infra:array<string>>"
SEQ = "struct<landed:bigint,pos:int>"

STAGED_COMPANY = (
    "name string, website string, career_page_url string, github_org string, description string, funding_stage string,"
    "funding_amount_usd double, last_funding_date timestamp_ntz, hq_city string, hq_country string,"
    f"remote_friendly boolean, remote_us boolean, headcount int, tech_stack {STACK}, seq {SEQ}"
)
STAGED_SIGNAL = (
    "company_name string, type string, headline string, detail string, source_url string, raw_content string,"
    "signal_date timestamp_ntz, score double, funding_amount_usd double, funding_round string,"
    f"github_commit_count bigint, github_repo_name string, poster_handle string, seq {SEQ}"
)
STAGED_ROLE = (
    "company_name string, title string, url string, source string, description_raw string, role_type string,"
    "seniority string, is_remote boolean, is_remote_us boolean, location string, external_id string,"
    f"tech_stack {STACK}, required_skills array<string>, ingest_source string, seq {SEQ}"
)

TABLES = {
    "companies": (
        "company_id string, name string, slug string, website string, career_page_url string, github_org string,"
        "description string, tagline string, funding_stage string, funding_amount_usd double,"
        "last_funding_date timestamp_ntz, headcount int, engineering_headcount int, hq_city string, hq_country string,"
        f"remote_friendly boolean, remote_us boolean, tech_stack {STACK}, fit_score double, urgency_score double,"
        "composite_score double, on_watchlist boolean, watchlist_added_at timestamp_ntz, watchlist_priority int,"
        "updated_at timestamp_ntz, last_signal_at timestamp_ntz"
    ),
    "signals": (
        "signal_id string, company_id string, type string, headline string, detail string, source_url string,"
        "raw_content string, signal_date timestamp_ntz, score double, funding_amount_usd double, funding_round string,"
        "github_commit_count bigint, github_repo_name string, poster_handle string, dedup_key string,"
        "ingested_at timestamp_ntz, signal_day date"
    ),
    "roles": (
        "role_id string, company_id string, title string, url string, source string, external_id string, role_type string,"
        "seniority string, is_remote boolean, is_remote_us boolean, location string, description_raw string,"
        f"tech_stack {STACK}, required_skills array<string>, fit_score double, is_active boolean,"
        "first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, removed_at timestamp_ntz, days_open int,"
        "ingest_source string"
    ),
    "outreach": (
        "outreach_id string, company_id string, contact_role string, status string, sent_at timestamp_ntz,"
        "responded_at timestamp_ntz, follow_up_due timestamp_ntz, notes string, created_at timestamp_ntz"
    ),
    "execution_events": (
        "event_id string, company_id string, status string, label string, notes string, target_role_title string,"
        "target_role_url string, follow_up_due timestamp_ntz, occurred_at timestamp_ntz"
    ),
    "ingest_runs": (
        "run_id string, source string, status string, started_at timestamp_ntz, finished_at timestamp_ntz,"
        "records_found bigint, records_new bigint, error_message string"
    ),
    "career_page_snapshots": (
        "company_name string, page_url string, page_hash string, captured_at timestamp_ntz,"
        "jobs array<struct<title:string,url:string,location:string,description:string>>"
    ),
    "funding_history": (
        "company_id string, announced_at timestamp_ntz, round_type string, amount_usd double,"
        "lead_investors array<string>, source string, source_url string"
    ),
    "signal_facts": (
        "company_id string, round struct<signal_date:timestamp_ntz,col2:double,amount:double>, founder_post_date timestamp_ntz,"
        "spike_date timestamp_ntz, spike_sigma double, has_founder_post boolean, has_engineering_blog boolean"
    ),
    "role_daily": (
        "company_id string, active_roles_total bigint, active_remote_roles_total bigint, new_roles_7d bigint,"
        "new_roles_30d bigint, removed_roles_30d bigint, as_of_date date"
    ),
}

# Column a table's folders are partitioned by.
PARTITIONS = {"signals": "signal_day", "role_daily": "as_of_date", "feature_snapshots": "as_of_date"}


def empty(spark: SparkSession, table: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[table])


def conform(df: DataFrame, ddl: str) -> DataFrame:
    """``df`` with exactly the columns of ``ddl``; missing ones are null."""
    wanted = StructType.fromDDL(ddl)
    return df.select(
        *[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in wanted]
    )


@dataclass(frozen=True)
class Staged:
    """The three staging frames that every normaliser gives."""

    source: str
    companies: DataFrame
    signals: DataFrame
    roles: DataFrame

    @staticmethod
    def of(source: str, companies: DataFrame, signals: DataFrame | None = None, roles: DataFrame | None = None) -> "Staged":
        spark = companies.sparkSession
        none = lambda ddl: spark.createDataFrame([], ddl)
        return Staged(
            source,
            conform(companies, STAGED_COMPANY),
            conform(signals, STAGED_SIGNAL) if signals is not None else none(STAGED_SIGNAL),
            conform(roles.withColumn("ingest_source", F.lit(source)), STAGED_ROLE) if roles is not None else none(STAGED_ROLE),
        )


def combined(parts: list[Staged]) -> Staged:
    """All sources as one batch."""
    fold = lambda name: reduce(DataFrame.unionByName, [getattr(p, name) for p in parts])
    return Staged("all", fold("companies"), fold("signals"), fold("roles"))
