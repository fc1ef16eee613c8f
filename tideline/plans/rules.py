"""Watchlist and outreach rules over all companies."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.clock import age_days, instant, shift
from tideline.functions.numbers import clamp, count_where
from tideline.operators.ranking import best_role, best_signal


@dataclass(frozen=True)
class RuleSettings:
    """Thresholds. The defaults are fixed values."""

    watch_min_score: float = 72.0
    watch_min_roles: int = 1
    watch_min_signals: int = 1
    stale_days: int = 14
    stale_max_score: float = 60.0
    stale_max_roles: int = 0
    stale_max_signals: int = 0
    outreach_min_score: float = 84.0
    follow_up_days: int = 3
    default_contact: str = "engineering lead"


OPEN_DRAFT_STATUSES = ("identified", "drafted", "sent")
LEAD_ROLE_TYPES = ("infra", "distributed", "backend")


def rule_inputs(companies: DataFrame, role_state: DataFrame, signals: DataFrame, as_of: str) -> DataFrame:
    """One row per company: counts and flags of active roles and of the signals
    since 30 days ago, and the role and signal an outreach refers to."""
    now = instant(as_of)
    active = role_state.where("is_active")
    recent = signals.where(F.col("signal_date") >= shift(now, days=-30))
    kind = F.col("type")
    by_role = active.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("roles"),
        count_where(F.coalesce("days_open", F.lit(0)) <= 3).alias("fresh_roles"),
        F.bool_or(F.col("role_type").isin(*LEAD_ROLE_TYPES)).alias("lead_role"),
        best_role(F.col("title")).alias("top_role"),
    )
    by_signal = recent.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("signals"),
        F.bool_or(kind == "founder_post").alias("founder"),
        F.bool_or(kind == "funding").alias("funding"),
        F.bool_or(F.lower(F.coalesce("headline", F.lit(""))).contains("recruit")).alias("recruiter"),
        best_signal(F.col("headline")).alias("top_signal"),
    )
    no = F.lit(False)
    return (
        companies.join(by_role, "company_id", "left")
        .join(by_signal, "company_id", "left")
        .withColumns({c: F.coalesce(c, F.lit(0)) for c in ("roles", "fresh_roles", "signals")})
        .withColumns({c: F.coalesce(c, no) for c in ("lead_role", "founder", "funding", "recruiter")})
        .withColumn("composite_score", F.coalesce("composite_score", F.lit(0.0)))
        .withColumn("was_watched", F.coalesce("on_watchlist", no))
    )


def watch_priority() -> Column:
    """R3"""
    base = clamp(F.floor(F.col("composite_score") + 0.5), 0, 100)
    extra = (
        F.least(F.lit(12), F.col("fresh_roles") * 4)
        + F.when(F.col("founder"), 10).otherwise(0)
        + F.when(F.col("funding"), 6).otherwise(0)
        + F.when(F.col("remote_us"), 4).otherwise(0)
    )
    return clamp(base + extra, 0, 100).cast("int")


def contact_role(settings: RuleSettings) -> Column:
    """R5"""
    return (
        F.when(F.col("founder"), "founder")
        .when(F.col("recruiter"), "recruiter")
        .when(F.col("lead_role"), "engineering lead")
        .otherwise(settings.default_contact)
    )


def apply_rules(
    companies: DataFrame, role_state: DataFrame, signals: DataFrame, outreach: DataFrame, as_of: str,
    settings: RuleSettings = RuleSettings(),
) -> DataFrame:
    """Every company with the decisions of this run as columns."""
    s, now = settings, instant(as_of)
    score, roles, hits = F.col("composite_score"), F.col("roles"), F.col("signals")
    worth = (score >= s.watch_min_score) & (roles >= s.watch_min_roles) & (hits >= s.watch_min_signals)
    watched_days = age_days(F.col("watchlist_added_at"), now)
    stale = (
        F.col("was_watched")
        & F.coalesce(watched_days >= s.stale_days, F.lit(False))
        & (score <= s.stale_max_score)
        & (roles <= s.stale_max_roles)
        & (hits <= s.stale_max_signals)
    )
    decided = rule_inputs(companies, role_state, signals, as_of).withColumns(
        {"watchlist_add": worth & ~F.col("was_watched"), "watchlist_remove": ~worth & stale}
    )
    decided = decided.withColumn("now_watched", (F.col("was_watched") | F.col("watchlist_add")) & ~F.col("watchlist_remove"))
    decided = decided.withColumns(
        {
            "priority": F.when(F.col("now_watched"), watch_priority()),
            "outreach_wanted": F.col("now_watched") & (score >= s.outreach_min_score) & (roles >= 1) & (hits >= 1),
        }
    )
    open_drafts = outreach.where(F.col("status").isin(*OPEN_DRAFT_STATUSES)).select(
        "company_id", F.lit(True).alias("has_open_draft")
    ).distinct()
    decided = decided.join(open_drafts, "company_id", "left")
    # Taking a company off the list also resets its stored priority to 0.
    return decided.withColumns(
        {
            "priority_change": F.coalesce(F.col("now_watched") & (F.col("priority") != F.coalesce("watchlist_priority", F.lit(0))), F.lit(False)),
            "outreach_create": F.col("outreach_wanted") & F.col("has_open_draft").isNull(),
        }
    ).drop("has_open_draft")


def watchlist_actions(decided: DataFrame) -> DataFrame:
    """Companies whose watch state or priority changes."""
    action = F.when(F.col("watchlist_add"), "add").when(F.col("watchlist_remove"), "remove").when(F.col("priority_change"), "reprioritise")
    return decided.where(action.isNotNull()).select("company_id", action.alias("action"), "now_watched", "priority")


def outreach_actions(decided: DataFrame, as_of: str, settings: RuleSettings = RuleSettings()) -> DataFrame:
    """Outreach drafts to create."""
    return decided.where("outreach_create").select(
        "company_id",
        contact_role(settings).alias("contact_role"),
        "top_role",
        "top_signal",
        shift(instant(as_of), days=settings.follow_up_days).alias("follow_up_due"),
    )


def run_summary(decided: DataFrame) -> DataFrame:
    """A15"""
    return decided.agg(
        F.count(F.lit(1)).alias("companies_scanned"),
        count_where(F.col("watchlist_add")).alias("watchlist_added"),
        count_where(F.col("watchlist_remove")).alias("watchlist_removed"),
        count_where(F.col("priority_change")).alias("priority_updated"),
        count_where(F.col("outreach_create")).alias("outreach_created"),
    )
