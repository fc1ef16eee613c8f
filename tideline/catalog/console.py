"""Console scoring, opportunities and details."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.catalog.registry import query
from tideline.functions import lexicons as lex
from tideline.operators import filters, ranking
from tideline.plans import console, reports
from tideline.tables import AS_OF, Dialect, Tables

D = Dialect("duckdb")
NOW = D.now
PROFILE = console.Candidate()
WORDS = ", ".join(f"'{w}'" for w in PROFILE.preferred_skills)
TYPE_LABELS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lex.SIGNAL_TYPE_LABELS.items())

STAGE_LABEL = """CASE funding_stage WHEN 'seed' THEN 'Seed' WHEN 'series_a' THEN 'Series A' WHEN 'series_b' THEN 'Series B'
  WHEN 'series_c' THEN 'Series C' ELSE 'Unverified' END"""
WEIGHT = "CASE type WHEN 'founder_post' THEN 30 WHEN 'career_page' THEN 24 WHEN 'funding' THEN 18 WHEN 'github_spike' THEN 10 ELSE 6 END"
# Families in a company's text, when it has no role.
TEXT = "lower(concat_ws(' ', tagline, tagline || ' team', stack_language, stack_framework, stack_infra))"


def _in_text(words) -> str:
    return "(" + " OR ".join(f"contains({TEXT}, '{w}')" for w in words) + ")"


TEXT_FOCUS = "CASE " + " ".join(f"WHEN {_in_text(words)} THEN '{name}'" for name, words in lex.FAMILY_WORDS) + " ELSE 'backend' END"
TEXT_FITS = (
    "(" + " + ".join(f"CASE WHEN {_in_text(words)} THEN 1 ELSE 0 END" for name, words in lex.FAMILY_WORDS if name in PROFILE.preferred_roles)
    + " + CASE WHEN " + " OR ".join(_in_text(words) for _, words in lex.FAMILY_WORDS) + " THEN 0 ELSE 1 END)"
)
PERCENT = f"""CASE WHEN signal_date > {NOW} - INTERVAL 6 HOURS THEN 145 WHEN signal_date > {NOW} - INTERVAL 24 HOURS THEN 120
  WHEN signal_date > {NOW} - INTERVAL 72 HOURS THEN 100 ELSE 65 END"""

SCORE_SQL = f"""WITH seen AS (SELECT *, {WEIGHT} * {PERCENT} AS hundredths FROM signals WHERE signal_date >= {NOW} - INTERVAL 168 HOURS AND score >= 0),
    active AS (SELECT * FROM role_state WHERE is_active),
    s AS (SELECT company_id, sum(hundredths) AS hundredths, count(*) AS n_signals, bool_or(type = 'founder_post') AS founder,
        arg_max(headline, (signal_date, -signal_id)) AS latest_signal FROM seen GROUP BY company_id),
    r AS (SELECT company_id, sum(CASE WHEN days_open <= 2 THEN 22 WHEN days_open <= 7 THEN 14 WHEN days_open <= 14 THEN 7 ELSE 3 END) AS points,
        count(*) AS n_roles, count(*) FILTER (WHERE days_open <= 2) AS fresh,
        count(DISTINCT role_type) FILTER (WHERE role_type IN ('backend', 'distributed', 'infra', 'platform', 'ai_ml')) AS fits,
        arg_min(title, (-fit_score, days_open, role_id)) AS top_title, arg_min(role_type, (-fit_score, days_open, role_id)) AS top_type,
        arg_min(days_open, (-fit_score, days_open, role_id)) AS top_days,
        arg_min(role_type, (-fit_score, days_open, role_id)) FILTER (WHERE days_open <= 2) AS fresh_type
      FROM active GROUP BY company_id),
    words AS (SELECT company_id, lower(skill) AS w FROM active JOIN role_skills USING (role_id)
      UNION SELECT company_id, unnest([stack_language, stack_framework, stack_infra]) FROM companies),
    k AS (SELECT company_id, count(DISTINCT w) FILTER (WHERE w IN ({WORDS})) AS n_skills FROM words GROUP BY company_id),
    base AS (SELECT c.*, {STAGE_LABEL} AS stage_label,
        CASE WHEN urgency_score >= 75 THEN 'critical' WHEN urgency_score >= 50 THEN 'high' WHEN urgency_score >= 25 THEN 'medium' ELSE 'low' END AS urgency,
        coalesce(hundredths, 0) AS hundredths, coalesce(n_signals, 0) AS n_signals, coalesce(founder, false) AS founder, latest_signal,
        coalesce(points, 0) AS points, coalesce(n_roles, 0) AS n_roles, coalesce(fresh, 0) AS fresh, coalesce(n_skills, 0) AS n_skills,
        CASE WHEN r.company_id IS NOT NULL THEN fits ELSE {TEXT_FITS} END AS fits,
        top_title, top_type, top_days, fresh_type
      FROM companies c LEFT JOIN s USING (company_id) LEFT JOIN r USING (company_id) LEFT JOIN k USING (company_id)),
    parts AS (SELECT *, least(hundredths / 100.0, 100.0) AS signal_strength, least(points + n_roles * 4, 100) AS hiring_velocity,
        greatest(0.0, least(100.0, floor(fit_score + 0.5))) AS base_fit,
        CASE urgency WHEN 'critical' THEN 100 WHEN 'high' THEN 82 WHEN 'medium' THEN 64 ELSE 42 END AS urgency_points,
        CASE WHEN founder THEN 92 WHEN n_roles > 0 THEN 72 ELSE 38 END AS accessibility,
        CASE WHEN fits > 0 THEN least(18, fits * 8) ELSE 0 END + CASE WHEN founder THEN 4 ELSE 0 END AS fit_boost,
        least(20, n_skills * 5) AS skill_boost,
        CASE WHEN stage_label <> 'Unverified' THEN 10 ELSE 0 END AS stage_boost,
        CASE WHEN remote_us THEN 12 ELSE 0 END AS remote_boost, CASE WHEN remote_us THEN 0 ELSE 20 END AS penalty
      FROM base),
    scored AS (SELECT *, fit_boost + skill_boost + stage_boost + remote_boost - penalty AS personal,
        CAST(greatest(1, least(99, floor(CAST(signal_strength AS DOUBLE) * 0.28::DOUBLE + hiring_velocity * 0.24::DOUBLE + CAST(base_fit AS DOUBLE) * 0.18::DOUBLE
          + urgency_points * 0.15::DOUBLE + accessibility * 0.10::DOUBLE
          + greatest(-25, least(25, fit_boost + skill_boost + stage_boost + remote_boost - penalty)) + 0.5))) AS INTEGER) AS score
      FROM parts)"""


def cards(t: Tables):
    companies = t.companies.withColumns(
        {
            "description": F.concat("tagline", F.lit(" team")),
            "tech_stack": F.struct(
                F.array("stack_language").alias("languages"),
                F.array("stack_framework").alias("frameworks"),
                F.array("stack_infra").alias("infra"),
            ),
        }
    )
    return reports.company_cards(companies, t.role_state, t.signals, AS_OF)


def scored(t: Tables):
    return console.score_opportunities(cards(t), t.role_state, t.signals, AS_OF, t.role_skills, PROFILE)


def execution(t: Tables):
    return ranking.execution_state(t.execution_events)


@query(
    "opportunity_scores",
    SCORE_SQL
    + """ SELECT company_id, score, CAST(signal_strength AS DOUBLE) AS signal_strength, hiring_velocity, CAST(base_fit AS DOUBLE) AS base_fit, urgency_points, accessibility,
      greatest(0, least(100, 50 + personal)) AS personalization,
      CASE WHEN n_signals >= 4 AND n_roles >= 2 THEN 'high' WHEN n_signals >= 2 OR n_roles >= 1 THEN 'medium' ELSE 'low' END AS confidence,
      CASE WHEN score >= 85 THEN '+14' WHEN score >= 75 THEN '+9' WHEN score >= 65 THEN '+5' ELSE '+2' END AS score_delta FROM scored""",
)
def opportunity_scores(t: Tables):
    return scored(t).select(
        "company_id", "score", "signal_strength", "hiring_velocity", "base_fit", "urgency_points", "accessibility",
        "personalization", "confidence", "score_delta",
    )


@query("personalization", SCORE_SQL + " SELECT company_id, fit_boost, skill_boost, stage_boost, remote_boost, 0 AS target_boost, penalty FROM scored")
def personalization(t: Tables):
    return scored(t).select("company_id", *console.PERSONAL_PARTS, "penalty")


EVIDENCE_SQL = (
    SCORE_SQL
    + f""", sig AS (SELECT company_id, 0 AS place, row_number() OVER (PARTITION BY company_id ORDER BY contribution DESC, score DESC, signal_date DESC, signal_id) AS item,
        label, contribution FROM (SELECT s.*, greatest(1, floor(s.hundredths / 100.0 * 0.28 + 0.5)) AS contribution,
          CASE type WHEN 'founder_post' THEN 'Founder hiring signal' WHEN 'funding' THEN CASE WHEN stage_label <> 'Unverified' THEN stage_label || ' funding announcement'
            ELSE 'Funding momentum' END WHEN 'github_spike' THEN 'GitHub activity spike' WHEN 'career_page' THEN 'Fresh hiring signal'
            ELSE CASE type {TYPE_LABELS} END END AS label FROM seen s JOIN base USING (company_id)) AS x),
    ev AS (SELECT company_id, place, item, label, contribution FROM sig
      UNION ALL SELECT company_id, 1, 0, CASE WHEN fresh = 1 THEN 'Fresh ' || replace(fresh_type, 'ai_ml', 'ai ml') || ' role'
          WHEN fresh > 0 THEN fresh || ' roles opened in 48 hours' ELSE n_roles || ' active hiring roles' END,
          CASE WHEN fresh > 0 THEN least(24, floor(fresh * 22 * 0.24 + 0.5)) ELSE greatest(4, floor(hiring_velocity * 0.18 + 0.5)) END FROM scored WHERE n_roles > 0
      UNION ALL SELECT company_id, 2, 0, CASE WHEN remote_us THEN 'Remote U.S. fit confirmed' ELSE 'Remote mismatch penalty' END, CASE WHEN remote_us THEN 12 ELSE -20 END FROM scored
      UNION ALL SELECT company_id, 3, 0, CASE WHEN n_skills > 0 THEN 'Strong stack overlap' ELSE 'Strong stack fit' END,
          greatest(6, CASE WHEN n_skills > 0 THEN skill_boost ELSE floor(base_fit * 0.1 + 0.5) END) FROM scored WHERE n_skills > 0 OR base_fit >= 75
      UNION ALL SELECT company_id, 4, 0, 'Preferred ' || stage_label || ' stage', 10 FROM scored WHERE stage_boost > 0),
    ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY company_id ORDER BY abs(contribution) DESC, place, item) AS INTEGER) AS rank FROM ev)"""
)


@query("score_evidence", EVIDENCE_SQL + " SELECT company_id, rank, label, CAST(contribution AS INTEGER) AS contribution FROM ranked WHERE rank <= 6")
def score_evidence(t: Tables):
    return console.evidence(scored(t), t.signals, t.role_state, AS_OF, PROFILE).select("company_id", "rank", "label", "contribution")


@query(
    "score_reasons",
    EVIDENCE_SQL
    + """ SELECT company_id, string_agg(label, ' | ' ORDER BY n) AS score_reasons FROM (
      SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY contribution DESC, place, item) AS n FROM ev WHERE contribution > 0) AS x
    WHERE n <= 4 GROUP BY company_id""",
)
def score_reasons(t: Tables):
    rows = console.evidence(scored(t), t.signals, t.role_state, AS_OF, PROFILE)
    return console.reasons(rows).select("company_id", F.array_join("score_reasons", " | ").alias("score_reasons"))


CLUES_SQL = """places AS (SELECT company_id, clue, min(place) AS place FROM (
        SELECT company_id, unnest([stack_language, stack_framework, stack_infra]) AS clue, unnest([(0, 0.0::DOUBLE, 0, 0::BIGINT, 0), (0, 0.0::DOUBLE, 0, 0::BIGINT, 1), (0, 0.0::DOUBLE, 0, 0::BIGINT, 2)]) AS place FROM companies
        UNION ALL SELECT company_id, skill, (1, -fit_score, days_open, role_id, pos) FROM role_state JOIN role_skills USING (role_id) WHERE is_active) AS x
      GROUP BY company_id, clue),
    clues AS (SELECT company_id, clue, CAST(row_number() OVER (PARTITION BY company_id ORDER BY place, clue) AS INTEGER) AS rank FROM places)"""


@query("tech_clues", f"WITH {CLUES_SQL} SELECT company_id, rank, clue FROM clues WHERE rank <= 6")
def tech_clues(t: Tables):
    return console.tech_clues(cards(t), t.role_state, t.role_skills).select("company_id", "rank", "clue")


OPPS_SQL = (
    SCORE_SQL
    + ", "
    + CLUES_SQL
    + f""", x AS (SELECT company_id, arg_max(status, (occurred_at, event_id)) AS execution_status FROM execution_events GROUP BY company_id),
    tags AS (SELECT company_id, string_agg(clue, ',' ORDER BY rank) AS stack_tags, list(lower(clue)) AS tag_list FROM clues WHERE rank <= 4 GROUP BY company_id),
    o1 AS (SELECT s.*, stack_tags, tag_list, execution_status,
        CASE WHEN founder THEN 'reach_out' WHEN top_days <= 2 THEN 'apply_now' WHEN n_roles = 0 THEN 'early_signal'
          WHEN lower(coalesce(latest_signal, '')) LIKE '%founder%' THEN 'reach_out' WHEN urgency = 'critical' THEN 'apply_now'
          WHEN n_signals >= 5 THEN 'high_leverage' ELSE 'early_signal' END AS action_state
      FROM scored s LEFT JOIN tags USING (company_id) LEFT JOIN x USING (company_id)),
    opps AS (SELECT *, CASE execution_status WHEN 'reached_out' THEN 'follow_up_outreach' WHEN 'applied' THEN 'follow_up_application'
          WHEN 'follow_up' THEN 'send_follow_up' WHEN 'interview' THEN 'prepare_interview' WHEN 'offer' THEN 'review_offer' WHEN 'closed' THEN 'closed'
          ELSE CASE WHEN founder THEN 'reach_out_leadership' WHEN top_title IS NOT NULL THEN CASE WHEN top_days <= 2 THEN 'apply_fresh_role' ELSE 'apply_active_role' END
            ELSE 'company_' || action_state END END AS next_action,
        CASE WHEN top_title IS NULL THEN {TEXT_FOCUS}
          WHEN top_type = 'unknown' THEN 'backend' ELSE top_type END AS role_focus FROM o1)"""
)


def opps(t: Tables):
    clues = console.tech_clues(cards(t), t.role_state, t.role_skills)
    return console.opportunities(scored(t), clues, execution(t))


@query(
    "opportunities",
    OPPS_SQL
    + """ SELECT company_id, score, top_title AS primary_role_title, role_focus, action_state, next_action, urgency, stage_label, n_signals AS signal_count,
      n_roles AS open_roles, latest_signal, on_watchlist AS watchlisted, execution_status, stack_tags FROM opps""",
)
def opportunities(t: Tables):
    return opps(t).select(
        "company_id", "score", "primary_role_title", "role_focus", "action_state", "next_action", "urgency", "stage_label",
        "signal_count", "open_roles", "latest_signal", "watchlisted", "execution_status", F.array_join("stack_tags", ",").alias("stack_tags"),
    )


@query(
    "ranked_opportunities",
    OPPS_SQL + " SELECT company_id, score, CAST(row_number() OVER (ORDER BY score DESC, company_id) AS INTEGER) AS rank FROM opps ORDER BY rank LIMIT 50",
)
def ranked_opportunities(t: Tables):
    return console.ranked_opportunities(opps(t), 50).select("company_id", "score", "rank")


@query(
    "filtered_opportunities",
    OPPS_SQL
    + """ SELECT company_id, score FROM opps WHERE (action_state IN ('reach_out', 'apply_now') OR execution_status IN ('reached_out', 'applied', 'follow_up', 'interview'))
      AND remote_us AND (role_focus IN ('infra', 'distributed') OR list_has_any(tag_list, ['k8s', 'grpc', 'docker'])) AND lower(concat_ws(' ', name, tagline, top_title, tagline || ' team', replace(stack_tags, ',', ' '))) LIKE '%engineer%'""",
)
def filtered_opportunities(t: Tables):
    return filters.opportunities_matching(opps(t), "outreach", ("remote_us", "infrastructure"), " Engineer ").select("company_id", "score")


@query(
    "prioritised_queue",
    OPPS_SQL + " SELECT company_id, n_roles AS open_roles, score, n_signals AS signal_count FROM opps WHERE urgency IN ('critical', 'high') AND (n_roles > 0 OR n_signals > 1 OR score >= 50)",
)
def prioritised_queue(t: Tables):
    alerts = filters.opportunities_matching(opps(t), "alerts")
    return ranking.prioritised(alerts).select("company_id", "open_roles", "score", "signal_count")


@query(
    "command_metrics",
    OPPS_SQL
    + """ SELECT count(*) AS opportunities, sum(n_roles) AS open_roles, count(*) FILTER (WHERE urgency IN ('critical', 'high')) AS high_priority,
      count(*) FILTER (WHERE on_watchlist) AS watchlisted, sum(n_signals) AS signals_today FROM opps""",
)
def command_metrics(t: Tables):
    return console.command_metrics(opps(t))


@query(
    "detail_open_roles",
    """SELECT company_id, rank, role_id, title, role_type, days_open, CASE WHEN days_open <= 2 THEN 'fresh' WHEN days_open <= 10 THEN 'open' ELSE 'competitive' END AS status FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY company_id ORDER BY fit_score DESC, days_open, role_id) AS INTEGER) AS rank FROM role_state WHERE is_active) AS x WHERE rank <= 5""",
)
def detail_open_roles(t: Tables):
    return console.open_role_rows(t.role_state)


@query(
    "detail_timeline",
    f"""SELECT company_id, rank, signal_id, CASE type WHEN 'funding' THEN 'FUNDING' WHEN 'founder_post' THEN 'FOUNDER' WHEN 'github_spike' THEN 'ENGINEERING'
      WHEN 'career_page' THEN 'DIRECT' ELSE 'HIGH' END AS label, headline, CASE type {TYPE_LABELS} END AS source FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY company_id ORDER BY score DESC, signal_date DESC, signal_id) AS INTEGER) AS rank FROM signals
      WHERE signal_date >= {NOW} - INTERVAL 168 HOURS AND score >= 0) AS x WHERE rank <= 4""",
)
def detail_timeline(t: Tables):
    return console.timeline_rows(t.signals, AS_OF)


@query(
    "detail_breakdown",
    SCORE_SQL
    + """ SELECT company_id, unnest(['Signal strength', 'Hiring velocity', 'Personal fit', 'Personalization']) AS label,
      unnest([CAST(signal_strength AS DOUBLE), CAST(hiring_velocity AS DOUBLE), CAST(base_fit AS DOUBLE), CAST(greatest(0, least(100, 50 + personal)) AS DOUBLE)]) AS value FROM scored""",
)
def detail_breakdown(t: Tables):
    return console.score_breakdown(scored(t))


@query(
    "live_feed",
    "SELECT signal_id, score, signal_date FROM signals ORDER BY score DESC, signal_date DESC, signal_id LIMIT 30",
)
def live_feed(t: Tables):
    return console.latest_feed(t.signals).select("signal_id", "score", "signal_date")
