"""Typed filters over the entity tables (F1-F12). A filter value outside the
closed set of its column is ignored, as an unset one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import lexicons as lex
from tideline.functions.clock import age_days, instant, shift
from tideline.functions.text import board_token, contains_any, url_host
from tideline.operators.ranking import role_order, signal_order


def _known(column: str, value: str | None, allowed: tuple[str, ...]) -> Column | None:
    return F.col(column) == value if value in allowed else None


def _apply(df: DataFrame, conditions: list[Column | None]) -> DataFrame:
    for c in conditions:
        if c is not None:
            df = df.where(c)
    return df


def with_role_type(companies: DataFrame, role_state: DataFrame, role_type: str) -> DataFrame:
    """Companies having an active role of the type, each once."""
    having = role_state.where(F.col("is_active") & (F.col("role_type") == role_type))
    return companies.join(having.select("company_id"), "company_id", "left_semi")


def ranked_companies(
    companies: DataFrame, role_state: DataFrame | None = None, stage: str | None = None, remote_us: bool | None = None,
    min_score: float = 0.0, role_type: str | None = None, watchlist_only: bool = False, search: str | None = None,
    limit: int | None = 50, offset: int = 0,
) -> DataFrame:
    """F1, L1, Q9: every filter first, then order, offset and limit. Without a
    limit the order is left to the reader of the table."""
    out = _apply(
        companies,
        [
            F.col("composite_score") >= min_score,
            _known("funding_stage", stage, lex.FUNDING_STAGES),
            None if remote_us is None else F.col("remote_us") == remote_us,
            F.col("on_watchlist") if watchlist_only else None,
            F.lower("name").contains(search.lower()) if search else None,
        ],
    )
    if role_type in lex.ROLE_TYPES and role_state is not None:
        out = with_role_type(out, role_state, role_type)
    if limit is None:
        return out
    return out.orderBy(F.desc("composite_score"), "company_id").offset(offset).limit(limit)


def recent_signals(
    signals: DataFrame, as_of: str, company_id=None, signal_type: str | None = None, min_score: float = 0.0,
    hours: int = 24 * 7,
) -> DataFrame:
    """F2"""
    return _apply(
        signals,
        [
            F.col("signal_date") >= shift(instant(as_of), hours=-hours),
            F.col("score") >= min_score,
            None if company_id is None else F.col("company_id") == company_id,
            _known("type", signal_type, lex.SIGNAL_TYPES),
        ],
    )


def best_signals(signals: DataFrame, limit: int = 50) -> DataFrame:
    """L2"""
    return signals.orderBy(*signal_order()).limit(limit)


def active_roles(
    role_state: DataFrame, company_id=None, role_type: str | None = None, remote_us: bool | None = None, min_fit: float = 0.0
) -> DataFrame:
    """F3"""
    return _apply(
        role_state,
        [
            F.col("is_active"),
            F.col("fit_score") >= min_fit,
            None if company_id is None else F.col("company_id") == company_id,
            _known("role_type", role_type, lex.ROLE_TYPES),
            None if remote_us is None else F.col("is_remote_us") == remote_us,
        ],
    )


def best_roles(roles: DataFrame, limit: int = 50) -> DataFrame:
    """L3"""
    return roles.orderBy(*role_order()).limit(limit)


def recent_of_type(signals: DataFrame, as_of: str, signal_type: str, days: int) -> DataFrame:
    """F4"""
    return signals.where((F.col("type") == signal_type) & (F.col("signal_date") >= shift(instant(as_of), days=-days)))


def brief_candidates(
    companies: DataFrame, as_of: str, min_score: float = 70.0, max_age_hours: int = 24, limit: int = 12
) -> DataFrame:
    """Companies whose brief is missing or stale, best first; companies
    without a signal sort first among equals, as in PostgreSQL."""
    written = F.col("ai_brief_generated_at")
    stale = F.col("ai_brief").isNull() | written.isNull() | (written < shift(instant(as_of), hours=-max_age_hours))
    return (
        companies.where((F.col("composite_score") >= min_score) & stale)
        .orderBy(F.desc("composite_score"), F.desc_nulls_first("last_signal_at"), "company_id")
        .limit(limit)
    )


DUE_STATUSES = ("sent", "drafted")


def outreach_due(outreach: DataFrame, as_of: str, days_ahead: int = 1) -> DataFrame:
    """F6"""
    return outreach.where(
        (F.col("follow_up_due") <= shift(instant(as_of), days=days_ahead)) & F.col("status").isin(*DUE_STATUSES)
    )


def follow_up_due(execution: DataFrame, as_of: str) -> DataFrame:
    """F7"""
    return execution.where((F.col("status") == "follow_up") & (F.col("follow_up_due") <= instant(as_of)))


def resolve_references(refs: DataFrame, companies: DataFrame) -> DataFrame:
    """a table of references (column ``ref``), each an id, a slug or a name in
    any case, to company ids; null when nothing fits. One key per join side: the
    references are matched against the union of the three keys."""
    keys = companies.select(
        "company_id",
        F.inline(
            F.array(
                F.struct(F.lit(0).alias("prio"), F.col("company_id").cast("string").alias("key")),
                F.struct(F.lit(1).alias("prio"), F.col("slug").alias("key")),
                F.struct(F.lit(2).alias("prio"), F.lower("name").alias("key")),
            )
        ),
    )
    by_key = keys.groupBy("key", "prio").agg(F.min("company_id").alias("company_id")).select(
        "key", F.struct("prio", "company_id").alias("hit")
    )
    probe = refs.select(
        "ref", F.explode(F.array_distinct(F.array(F.col("ref"), F.lower("ref")))).alias("key")
    )
    found = (
        probe.join(by_key, "key")
        # Ids and slugs are matched as written, names in any case.
        .where((F.col("hit.prio") == 2) | (F.col("key") == F.col("ref")))
        .groupBy("ref")
        .agg(F.min("hit").alias("hit"))
    )
    return refs.join(found, "ref", "left").select(*[refs[c] for c in refs.columns], F.col("hit.company_id").alias("company_id"))


# --- console filters (F10) ----------------------------------------------------

# Role focus and stack tags that satisfy each quick filter. Fixed values.
QUICK_FILTERS = {
    "backend": (("backend", "fullstack"), ("go", "python", "api")),
    "ai_ml": (("ai_ml",), ("gpu", "cuda", "llm", "pytorch")),
    "infrastructure": (("infra", "distributed"), ("k8s", "grpc", "docker")),
    "frontend": (("frontend",), ()),
}
OUTREACH_ACTIONS = ("reach_out", "apply_now")
OUTREACH_EXECUTION = ("reached_out", "applied", "follow_up", "interview")


def quick_filter(name: str) -> Column:
    if name == "remote_us":
        return F.col("remote")
    if name not in QUICK_FILTERS:
        return F.lit(True)
    focus, tags = QUICK_FILTERS[name]
    hit = F.col("role_focus").isin(*focus)
    if tags:
        lowered = F.transform("stack_tags", lambda s: F.lower(s))
        hit = hit | F.arrays_overlap(lowered, F.array(*map(F.lit, tags)))
    return hit


def section_filter(name: str) -> Column:
    if name == "watchlist":
        return F.col("watchlisted")
    if name == "alerts":
        return F.col("urgency").isin("critical", "high")
    if name == "outreach":
        return F.col("action_state").isin(*OUTREACH_ACTIONS) | F.coalesce(
            F.col("execution_status").isin(*OUTREACH_EXECUTION), F.lit(False)
        )
    return F.lit(True)


def opportunities_matching(
    opportunities: DataFrame, section: str = "all", filters: tuple[str, ...] = (), search: str = ""
) -> DataFrame:
    """F10"""
    out = opportunities.where(section_filter(section))
    needle = search.strip().lower()
    if needle:
        text = F.concat_ws(" ", "company_name", "company_tagline", "primary_role_title", "summary", F.array_join("stack_tags", " "))
        out = out.where(F.lower(text).contains(needle))
    for name in filters:
        out = out.where(quick_filter(name))
    return out


# --- discovery (F11, F12) -------------------------------------------------------


def discovery_candidates(candidates: DataFrame, tracked: DataFrame, board: str) -> DataFrame:
    """companies (name, website, career_page_url) worth looking up on a job
    board: not tracked, no board token known, not hosted on the excluded listing.
    ``board`` is a token pattern set or 'career_page', which instead wants a
    website and no known career page."""
    site, page = F.coalesce("website", F.lit("")), F.coalesce("career_page_url", F.lit(""))
    out = candidates.where((F.col("name") != "") & ((site != "") | (page != "")))
    if board == "career_page":
        out = out.where((site != "") & (page == ""))
    else:
        out = out.where(board_token(page, lex.BOARD_TOKEN_PATTERNS[board], board == "greenhouse").isNull())
    host = F.coalesce(url_host(site), F.lit(""))
    known = tracked.select(F.lower("name").alias("_name")).distinct()
    return (
        out.where(~host.endswith(lex.EXCLUDED_DISCOVERY_HOST))
        .withColumn("_name", F.lower("name"))
        .join(known, "_name", "left_anti")
        .drop("_name")
    )


def is_recent(ts: Column, now: Column, days: int = 2) -> Column:
    """F12"""
    return F.coalesce(age_days(ts, now) <= days, F.lit(False))


def looks_like_career_page(html: Column, url: Column) -> Column:
    """P10"""
    return contains_any(F.lower(url), lex.CAREER_URL_WORDS) | contains_any(F.lower(html), lex.CAREER_PAGE_WORDS)


def canonical_page_url(original: Column, final: Column) -> Column:
    """P10: keep the original address when only that one looks like a career page."""
    before = contains_any(F.lower(original), lex.CANONICAL_URL_WORDS)
    after = contains_any(F.lower(final), lex.CANONICAL_URL_WORDS)
    return F.when(before & ~after, original).otherwise(final)
