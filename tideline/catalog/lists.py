"""Filters, joins, top-k lists and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.catalog.registry import query
from tideline.functions import lexicons as lex
from tideline.operators import filters, joins, ranking
from tideline.plans import reports
from tideline.tables import AS_OF, Dialect, Tables

D = Dialect("duckdb")
NOW = D.now


@query(
    "ranked_companies",
    """SELECT company_id, name, composite_score FROM companies c
    WHERE composite_score >= 20 AND remote_us AND lower(name) LIKE '%customer#0%'
      AND company_id IN (SELECT company_id FROM role_state WHERE is_active AND role_type = 'backend')
    ORDER BY composite_score DESC, company_id LIMIT 100 OFFSET 10""",
)
def ranked_companies(t: Tables):
    return filters.ranked_companies(
        t.companies, t.role_state, stage="no such stage", remote_us=True, min_score=20.0, role_type="backend",
        search="Customer#0", limit=100, offset=10,
    ).select("company_id", "name", "composite_score")


@query(
    "watchlist_companies",
    """SELECT company_id, funding_stage, composite_score FROM companies WHERE on_watchlist AND funding_stage = 'seed' AND composite_score >= 0""",
)
def watchlist_companies(t: Tables):
    return filters.ranked_companies(t.companies, stage="seed", watchlist_only=True, limit=None).select(
        "company_id", "funding_stage", "composite_score"
    )


@query(
    "recent_signals_named",
    f"""SELECT signal_id, s.company_id, coalesce(c.name, '') AS company_name, type, score, signal_date
    FROM signals s LEFT JOIN companies c USING (company_id)
    WHERE signal_date >= {NOW} - INTERVAL 168 HOURS AND score >= 10 ORDER BY score DESC, signal_date DESC, signal_id LIMIT 200""",
)
def recent_signals_named(t: Tables):
    best = filters.best_signals(filters.recent_signals(t.signals, AS_OF, min_score=10.0), 200)
    return joins.with_company_name(best, t.companies).select("signal_id", "company_id", "company_name", "type", "score", "signal_date")


@query(
    "active_roles_best",
    """SELECT r.role_id, r.company_id, c.name AS company_name, r.fit_score, r.days_open FROM role_state r JOIN companies c USING (company_id)
    WHERE is_active AND r.fit_score >= 30 AND role_type = 'infra' AND is_remote_us ORDER BY r.fit_score DESC, days_open, role_id LIMIT 150""",
)
def active_roles_best(t: Tables):
    best = filters.best_roles(filters.active_roles(t.role_state, role_type="infra", remote_us=True, min_fit=30.0), 150)
    return joins.with_company_name(best, t.companies).select("role_id", "company_id", "company_name", "fit_score", "days_open")


@query(
    "typed_recent_signals",
    f"""SELECT signal_id, type, signal_date FROM signals WHERE (type = 'funding' AND signal_date >= {NOW} - INTERVAL 30 DAYS)
      OR (type = 'founder_post' AND signal_date >= {NOW} - INTERVAL 14 DAYS)""",
)
def typed_recent_signals(t: Tables):
    funding = filters.recent_of_type(t.signals, AS_OF, "funding", 30)
    founder = filters.recent_of_type(t.signals, AS_OF, "founder_post", 14)
    return funding.unionByName(founder).select("signal_id", "type", "signal_date")


BRIEF_SQL = f"""WITH last AS (SELECT company_id, max(signal_date) AS last_signal_at FROM signals GROUP BY company_id),
    briefed AS (SELECT c.*, last_signal_at,
        CASE WHEN company_id % 3 <> 0 THEN 'text' END AS ai_brief,
        CASE WHEN company_id % 5 <> 0 THEN TIMESTAMP '2024-01-19 20:00:00' + to_hours(CAST(company_id % 12 AS INTEGER)) END AS ai_brief_generated_at
      FROM companies c LEFT JOIN last USING (company_id)),
    picked AS (SELECT * FROM briefed WHERE composite_score >= 50
        AND (ai_brief IS NULL OR ai_brief_generated_at IS NULL OR ai_brief_generated_at < {NOW} - INTERVAL 24 HOURS)
      ORDER BY composite_score DESC, last_signal_at DESC NULLS FIRST, company_id LIMIT 40)"""


def _briefed(t: Tables):
    last = t.signals.groupBy("company_id").agg(F.max("signal_date").alias("last_signal_at"))
    written = F.expr("TIMESTAMP_NTZ '2024-01-19 20:00:00' + make_dt_interval(0, company_id % 12)")
    return t.companies.join(last, "company_id", "left").withColumns(
        {
            "ai_brief": F.when(F.col("company_id") % 3 != 0, "text"),
            "ai_brief_generated_at": F.when(F.col("company_id") % 5 != 0, written),
            "tech_stack": F.struct(
                F.array("stack_language").alias("languages"),
                F.array("stack_framework").alias("frameworks"),
                F.array("stack_infra").alias("infra"),
            ),
        }
    )


@query("brief_candidates", BRIEF_SQL + " SELECT company_id, composite_score, last_signal_at FROM picked")
def brief_candidates(t: Tables):
    return filters.brief_candidates(_briefed(t), AS_OF, min_score=50.0, limit=40).select(
        "company_id", "composite_score", "last_signal_at"
    )


@query(
    "brief_context",
    BRIEF_SQL
    + """, sig AS (SELECT company_id, string_agg(replace(type, '_', ' ') || ': ' || headline, ' / ' ORDER BY rn) AS recent_signals FROM (
        SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY signal_date DESC, signal_id) AS rn FROM signals) AS x
      WHERE rn <= 5 GROUP BY company_id),
    rol AS (SELECT company_id, string_agg(title, ' / ' ORDER BY rn) AS open_roles, count(*) AS n FROM (
        SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY first_seen_at DESC, role_id) AS rn FROM role_state WHERE is_active) AS x
      WHERE rn <= 5 GROUP BY company_id)
    SELECT p.company_id, coalesce(recent_signals, '') AS recent_signals, coalesce(open_roles, '') AS open_roles,
      CAST(coalesce(n, 0) AS INTEGER) AS active_role_count,
      stack_language || ', ' || stack_framework || ', ' || stack_infra AS visible_stack,
      CASE WHEN urgency_score >= 80 THEN 'critical' WHEN urgency_score >= 60 THEN 'high' WHEN urgency_score >= 35 THEN 'medium' ELSE 'low' END AS urgency_label
    FROM picked p LEFT JOIN sig USING (company_id) LEFT JOIN rol USING (company_id)""",
)
def brief_context(t: Tables):
    picked = filters.brief_candidates(_briefed(t), AS_OF, min_score=50.0, limit=40)
    return reports.brief_context(picked, t.signals, t.role_state).select(
        "company_id",
        F.array_join("recent_signals", " / ").alias("recent_signals"),
        F.array_join("open_roles", " / ").alias("open_roles"),
        "active_role_count",
        "visible_stack",
        "urgency_label",
    )


@query(
    "outreach_due",
    f"""SELECT outreach_id, company_id, status, follow_up_due FROM outreach
    WHERE follow_up_due <= {NOW} + INTERVAL 1 DAY AND status IN ('sent', 'drafted')""",
)
def outreach_due(t: Tables):
    return filters.outreach_due(t.outreach, AS_OF).orderBy("follow_up_due", "outreach_id")


EXECUTION_SQL = """WITH e AS (SELECT * FROM execution_events),
    state AS (SELECT company_id, arg_max(status, (occurred_at, event_id)) AS status,
        arg_max(notes, (occurred_at, event_id)) FILTER (WHERE notes IS NOT NULL AND notes <> '') AS notes,
        arg_max(target_role_title, (occurred_at, event_id)) FILTER (WHERE target_role_title IS NOT NULL) AS target_role_title,
        arg_max(follow_up_due, (occurred_at, event_id)) FILTER (WHERE follow_up_due IS NOT NULL) AS follow_up_due,
        max(occurred_at) AS last_event_at, min(occurred_at) AS created_at, count(*) AS event_count
      FROM e GROUP BY company_id)"""


@query("execution_state", EXECUTION_SQL + " SELECT * FROM state")
def execution_state(t: Tables):
    return ranking.execution_state(t.execution_events)


@query("follow_up_due", EXECUTION_SQL + f" SELECT company_id, follow_up_due FROM state WHERE status = 'follow_up' AND follow_up_due <= {NOW}")
def follow_up_due(t: Tables):
    return filters.follow_up_due(ranking.execution_state(t.execution_events), AS_OF).select("company_id", "follow_up_due")


@query(
    "execution_cards",
    EXECUTION_SQL
    + """, h AS (SELECT company_id, string_agg(status || '|' || strftime(occurred_at, '%Y-%m-%d %H:%M'), ' ' ORDER BY rn) AS events FROM (
        SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY occurred_at DESC, event_id DESC) AS rn FROM e) AS x WHERE rn <= 12 GROUP BY company_id)
    SELECT s.company_id, coalesce(c.name, '') AS company_name, s.status,
      CASE s.status WHEN 'tracking' THEN 'Tracking' WHEN 'reached_out' THEN 'Reached out' WHEN 'applied' THEN 'Applied'
        WHEN 'follow_up' THEN 'Follow-up due' WHEN 'interview' THEN 'Interview' WHEN 'offer' THEN 'Offer' ELSE 'Closed' END AS status_label, h.events
    FROM state s LEFT JOIN companies c USING (company_id) JOIN h USING (company_id)""",
)
def execution_cards(t: Tables):
    return reports.execution_cards(t.execution_events, t.companies).select(
        "company_id", "company_name", "status", "status_label", F.array_join("events", " ").alias("events")
    )


@query(
    "reference_lookup",
    """WITH refs AS (SELECT CASE o_orderkey % 3 WHEN 0 THEN CAST(o_custkey AS VARCHAR) WHEN 1 THEN 'customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0')
        ELSE 'CUSTOMER#' || lpad(CAST(o_custkey * 2 AS VARCHAR), 9, '0') END AS ref FROM orders)
    SELECT ref, company_id, count(*) AS n FROM (
      SELECT r.ref, coalesce(a.company_id, b.company_id, c.company_id) AS company_id FROM refs r
      LEFT JOIN companies a ON CAST(a.company_id AS VARCHAR) = r.ref LEFT JOIN companies b ON b.slug = r.ref
      LEFT JOIN companies c ON lower(c.name) = lower(r.ref)) AS x GROUP BY ref, company_id""",
)
def reference_lookup(t: Tables):
    refs = t.orders.select(
        F.expr(
            """CASE o_orderkey % 3 WHEN 0 THEN CAST(o_custkey AS STRING) WHEN 1 THEN concat('customer#', lpad(CAST(o_custkey AS STRING), 9, '0'))
            ELSE concat('CUSTOMER#', lpad(CAST(o_custkey * 2 AS STRING), 9, '0')) END"""
        ).alias("ref")
    )
    counted = refs.groupBy("ref").agg(F.count(F.lit(1)).alias("n"))
    return filters.resolve_references(counted, t.companies).select("ref", "company_id", "n")


@query(
    "latest_signal",
    """SELECT company_id, signal_id, type, signal_date FROM (
      SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY signal_date DESC, signal_id) AS rn FROM signals) AS x WHERE rn = 1""",
)
def latest_signal(t: Tables):
    return ranking.latest_signal(t.signals).select("company_id", "signal_id", "type", "signal_date")


@query(
    "topk_signals_per_company",
    """SELECT company_id, rank, signal_id, score FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY company_id ORDER BY score DESC, signal_date DESC, signal_id) AS INTEGER) AS rank FROM signals) AS x WHERE rank <= 10""",
)
def topk_signals_per_company(t: Tables):
    return ranking.top_signals(t.signals, 10).select("company_id", "rank", "signal_id", "score")


@query(
    "topk_roles_per_company",
    """SELECT company_id, rank, role_id, fit_score FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY company_id ORDER BY fit_score DESC, days_open, role_id) AS INTEGER) AS rank
      FROM role_state WHERE is_active) AS x WHERE rank <= 20""",
)
def topk_roles_per_company(t: Tables):
    return ranking.top_roles(t.role_state, 20).select("company_id", "rank", "role_id", "fit_score")


@query(
    "stats_card",
    EXECUTION_SQL
    + f""" SELECT (SELECT count(*) FROM companies) AS companies_total, (SELECT count(*) FROM companies WHERE on_watchlist) AS companies_watchlist,
      (SELECT avg(fit_score) FROM companies) AS avg_fit_score, (SELECT count(*) FROM role_state WHERE is_active) AS open_roles,
      (SELECT count(*) FROM signals) AS signals_total, (SELECT count(*) FROM signals WHERE signal_date >= {NOW} - INTERVAL 24 HOURS) AS signals_last_24h,
      (SELECT count(*) FROM outreach WHERE follow_up_due <= {NOW} + INTERVAL 1 DAY AND status IN ('sent', 'drafted'))
        + (SELECT count(*) FROM state WHERE status = 'follow_up' AND follow_up_due <= {NOW}) AS outreach_due""",
)
def stats_card(t: Tables):
    execution = ranking.execution_state(t.execution_events)
    return reports.stats_card(t.companies, t.role_state, t.signals, t.outreach, execution, None, AS_OF)


@query(
    "digest_companies",
    """WITH top AS (SELECT * FROM companies ORDER BY composite_score DESC, company_id LIMIT 5),
    best AS (SELECT company_id, string_agg(headline, ' · ' ORDER BY rn) AS signals FROM (
      SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY score DESC, signal_date DESC, signal_id) AS rn FROM signals) AS x WHERE rn <= 2 GROUP BY company_id)
    SELECT company_id, name, composite_score AS score, tagline, funding_stage, coalesce(signals, '') AS signals,
      CASE WHEN urgency_score >= 75 THEN 'critical' WHEN urgency_score >= 50 THEN 'high' WHEN urgency_score >= 25 THEN 'medium' ELSE 'low' END AS urgency
    FROM top LEFT JOIN best USING (company_id)""",
)
def digest_companies(t: Tables):
    return reports.digest_companies(t.companies, t.signals)


@query(
    "digest_signals",
    f"""SELECT signal_id, type, name AS company_name, headline, score, signal_date FROM signals JOIN companies USING (company_id)
    WHERE signal_date >= {NOW} - INTERVAL 24 HOURS AND score >= 0 ORDER BY score DESC, signal_date DESC, signal_id LIMIT 6""",
)
def digest_signals(t: Tables):
    return reports.digest_signals(t.signals, t.companies, AS_OF)


@query(
    "digest_totals",
    f"""SELECT (SELECT count(*) FROM companies) AS companies, (SELECT count(*) FROM role_state WHERE is_active) AS roles,
      (SELECT count(*) FROM signals WHERE signal_date >= {NOW} - INTERVAL 24 HOURS) AS new_signals,
      (SELECT count(*) FROM outreach WHERE follow_up_due <= {NOW} + INTERVAL 1 DAY AND status IN ('sent', 'drafted')) AS outreach_due""",
)
def digest_totals(t: Tables):
    return reports.digest_totals(t.companies, t.role_state, t.signals, t.outreach, AS_OF)


TYPE_LABELS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lex.SIGNAL_TYPE_LABELS.items())


@query(
    "signal_cards",
    f"""SELECT signal_id, name AS company_name, CASE type {TYPE_LABELS} END AS type_label,
      CASE WHEN score >= 75 THEN 'high' WHEN score >= 50 THEN 'medium' ELSE 'low' END AS score_variant, headline
    FROM signals JOIN companies USING (company_id)""",
)
def signal_cards(t: Tables):
    return reports.signal_cards(t.signals, t.companies).select("signal_id", "company_name", "type_label", "score_variant", "headline")


@query(
    "company_cards",
    f"""SELECT company_id, coalesce(r.n, 0) AS open_roles, coalesce(s.n, 0) AS signal_count,
      CASE WHEN funding_amount_usd <> 0 THEN printf('$%.0fM %s', funding_amount_usd / 1e6, funding_stage)
        WHEN funding_stage <> 'unknown' THEN upper(substr(funding_stage, 1, 1)) || CASE funding_stage WHEN 'seed' THEN 'eed'
          ELSE 'eries ' || upper(substr(funding_stage, 8, 1)) END ELSE '' END AS funding_label,
      CASE funding_stage WHEN 'seed' THEN 'Seed' WHEN 'series_a' THEN 'Series A' WHEN 'series_b' THEN 'Series B' WHEN 'series_c' THEN 'Series C'
        ELSE 'Unverified' END AS stage_label
    FROM companies LEFT JOIN (SELECT company_id, count(*) AS n FROM role_state WHERE is_active GROUP BY company_id) AS r USING (company_id)
      LEFT JOIN (SELECT company_id, count(*) AS n FROM signals WHERE signal_date >= {NOW} - INTERVAL 168 HOURS AND score >= 0 GROUP BY company_id) AS s USING (company_id)""",
)
def company_cards(t: Tables):
    return reports.company_cards(t.companies, t.role_state, t.signals, AS_OF).select(
        "company_id", "open_roles", "signal_count", "funding_label", "stage_label"
    )
