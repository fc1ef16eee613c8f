"""Scores, rules and training rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.catalog.registry import query
from tideline.catalog.rollups import GRID
from tideline.functions import lexicons as lex
from tideline.operators import ranking
from tideline.plans import dataset, rules, scoring
from tideline.tables import AS_OF, Dialect, Tables

D = Dialect("duckdb")
NOW = D.now
PROFILE = scoring.Profile()


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def half_up(x: str, digits: int = 1) -> str:
    scale = 10**digits
    return f"CAST(floor(({x}) * {scale}.0 + 0.5) / {scale}.0 AS DOUBLE)"


def decay(ts: str, horizon: int, floor_zero: bool = False) -> str:
    age = D.days(ts, NOW)
    if floor_zero:
        age = f"greatest({age}, 0)"
    return f"greatest(0.0, 1.0 - {age} / {horizon}.0)"


SCORES_SQL = f"""WITH active AS (SELECT * FROM role_state WHERE is_active),
    by_role AS (SELECT company_id, max(first_seen_at) AS last_role, max(days_open) AS oldest, count(*) AS active_roles,
        max(CASE role_type {" ".join(f"WHEN '{d}' THEN {(6 - i) * 4}" for i, d in enumerate(PROFILE.preferred_domains))} ELSE 5 END) AS domain
      FROM active GROUP BY company_id),
    by_skill AS (SELECT company_id,
        count(DISTINCT CASE WHEN lower(skill) IN ({quoted(PROFILE.primary_skills)}) THEN lower(skill) END) AS prim,
        count(DISTINCT CASE WHEN lower(skill) IN ({quoted(PROFILE.secondary_skills)}) THEN lower(skill) END) AS sec
      FROM active JOIN role_skills USING (role_id) GROUP BY company_id),
    by_signal AS (SELECT company_id,
        max(CASE WHEN type = 'funding' THEN signal_date END) AS funded_at,
        arg_max(funding_amount_usd, signal_date) FILTER (WHERE type = 'funding') AS funded,
        max(CASE WHEN type = 'founder_post' THEN signal_date END) AS founder_at,
        max(CASE WHEN type = 'github_spike' THEN signal_date END) AS spike_at,
        max(CASE WHEN type = 'github_spike' THEN score / 10 END) AS sigma
      FROM signals GROUP BY company_id),
    parts AS (SELECT c.company_id,
        CASE WHEN coalesce(prim, 0) + coalesce(sec, 0) = 0 THEN 5.0
          ELSE least(coalesce(prim, 0) * 8, 28) + least(coalesce(sec, 0) * 2, 7) END AS stack_match,
        CASE WHEN domain IS NULL THEN 8.0 ELSE least(domain, 25) END AS domain_match,
        (CASE WHEN remote_us THEN 8.0 ELSE 0.0 END)
          + (CASE WHEN funding_stage IN ({quoted(PROFILE.preferred_stages)}) THEN 4.0 ELSE 0.0 END)
          + (CASE WHEN headcount <> 0 AND headcount < 100 THEN 3.0 ELSE 0.0 END) AS culture_proxy,
        CASE WHEN funded_at IS NULL THEN 0.0 ELSE
          (CASE WHEN coalesce(funded, 0) = 0 OR funded >= 50000000 THEN 30.0 WHEN funded >= 20000000 THEN 26.0 ELSE 20.0 END)
          * {decay("funded_at", 60, True)} END AS funding_points,
        CASE WHEN founder_at IS NULL THEN 0.0 ELSE 25.0 * {decay("founder_at", 14)} END AS founder_post_points,
        CASE WHEN last_role IS NULL THEN 0.0 ELSE 20.0 * {decay("last_role", 30)} END AS new_role_points,
        CASE WHEN oldest BETWEEN 20 AND 60 THEN least(15.0 * ((oldest - 20) / 40.0), 15.0) WHEN oldest > 60 THEN 5.0 ELSE 0.0 END AS role_aging_points,
        CASE WHEN spike_at IS NULL OR sigma < 2.0 THEN 0.0
          ELSE (5.0 + least((sigma - 2.0) * 2, 5.0)) * {decay("spike_at", 7)} END AS github_points,
        coalesce(active_roles, 0) AS active_roles
      FROM companies c LEFT JOIN by_role USING (company_id) LEFT JOIN by_skill USING (company_id) LEFT JOIN by_signal USING (company_id)),
    totals AS (SELECT *, least(stack_match + domain_match + 15.0 + culture_proxy, 100.0) AS fit_total,
        least(funding_points + founder_post_points + new_role_points + role_aging_points + github_points, 100.0) AS urgency_total
      FROM parts),
    scored AS (SELECT *, {half_up("fit_total")} AS fit, {half_up("urgency_total")} AS urgency,
        {half_up("fit_total * 0.6 + urgency_total * 0.4")} AS composite,
        CASE WHEN urgency_total >= 75 THEN 'critical' WHEN urgency_total >= 50 THEN 'high' WHEN urgency_total >= 25 THEN 'medium' ELSE 'low' END AS label
      FROM totals)"""


def _scored(t: Tables):
    inputs = scoring.scoring_inputs(t.companies, t.role_state, t.signals, t.role_skills)
    return scoring.score_companies(inputs, AS_OF)


@query("fit_scores", SCORES_SQL + " SELECT company_id, CAST(stack_match AS DOUBLE) AS stack_match, CAST(domain_match AS DOUBLE) AS domain_match, CAST(culture_proxy AS DOUBLE) AS culture_proxy, CAST(fit AS DOUBLE) AS fit_score FROM scored")
def fit_scores(t: Tables):
    return _scored(t).select("company_id", "stack_match", "domain_match", "culture_proxy", "fit_score")


URGENCY_COLUMNS = "funding_points, founder_post_points, new_role_points, role_aging_points, github_points"


@query(
    "urgency_scores",
    SCORES_SQL + f" SELECT company_id, {URGENCY_COLUMNS}, urgency AS urgency_score, label AS urgency_label FROM scored",
)
def urgency_scores(t: Tables):
    return _scored(t).select("company_id", *scoring.URGENCY_PARTS, "urgency_score", "urgency_label")


@query("composite_scores", SCORES_SQL + " SELECT company_id, composite AS composite_score, active_roles FROM scored")
def composite_scores(t: Tables):
    return scoring.rescore(t.companies, t.role_state, t.signals, AS_OF, t.role_skills).select(
        "company_id", "composite_score", "active_roles"
    )


@query(
    "ranked_rescored",
    SCORES_SQL
    + """ SELECT c.company_id, name, funding_stage, fit AS fit_score, urgency AS urgency_score, composite AS composite_score,
      label AS urgency_label FROM scored JOIN companies c USING (company_id) ORDER BY composite DESC, c.company_id LIMIT 200""",
)
def ranked_rescored(t: Tables):
    return (
        scoring.rescore(t.companies, t.role_state, t.signals, AS_OF, t.role_skills)
        .select("company_id", "name", "funding_stage", "fit_score", "urgency_score", "composite_score", "urgency_label")
        .orderBy(F.desc("composite_score"), "company_id")
        .limit(200)
    )


@query(
    "affected_rescore",
    SCORES_SQL
    + """ SELECT company_id, composite AS composite_score FROM scored
      WHERE company_id IN (SELECT company_id FROM signals WHERE type = 'funding' AND signal_date >= TIMESTAMP '2024-01-19 00:00:00')""",
)
def affected_rescore(t: Tables):
    touched = t.signals.where("type = 'funding' AND signal_date >= TIMESTAMP_NTZ '2024-01-19 00:00:00'")
    return scoring.rescore(t.companies, t.role_state, t.signals, AS_OF, t.role_skills, affected=touched).select(
        "company_id", "composite_score"
    )


@query(
    "role_fit_scores",
    f"""WITH s AS (SELECT role_id,
        count(DISTINCT CASE WHEN lower(skill) IN ({quoted(PROFILE.primary_skills)}) THEN lower(skill) END) AS prim,
        count(DISTINCT CASE WHEN lower(skill) IN ({quoted(PROFILE.secondary_skills)}) THEN lower(skill) END) AS sec
      FROM role_skills GROUP BY role_id)
    SELECT role_id, CAST(least(100.0,
        (CASE WHEN coalesce(prim, 0) + coalesce(sec, 0) = 0 THEN 5.0 ELSE least(coalesce(prim, 0) * 8, 28) + least(coalesce(sec, 0) * 2, 7) END)
        + least(25, CASE role_type {" ".join(f"WHEN '{d}' THEN {(6 - i) * 4}" for i, d in enumerate(PROFILE.preferred_domains))} ELSE 5 END)
        + (CASE WHEN seniority IN ({quoted(PROFILE.target_seniority)}) THEN 20.0 WHEN seniority = 'junior' THEN 5.0 ELSE 10.0 END)
        + (CASE WHEN is_remote_us THEN 8.0 ELSE 0.0 END)) AS DOUBLE) AS fit_score
    FROM roles LEFT JOIN s USING (role_id)""",
)
def role_fit_scores(t: Tables):
    return scoring.role_fit(t.roles, t.role_skills).select("role_id", "fit_score")


RULES_SQL = f"""WITH r AS (SELECT company_id, count(*) AS roles, count(*) FILTER (WHERE days_open <= 3) AS fresh,
        bool_or(role_type IN ('infra', 'distributed', 'backend')) AS lead_role,
        arg_min(title, (-fit_score, days_open, role_id)) AS top_role
      FROM role_state WHERE is_active GROUP BY company_id),
    s AS (SELECT company_id, count(*) AS signals, bool_or(type = 'founder_post') AS founder, bool_or(type = 'funding') AS funding,
        bool_or(lower(headline) LIKE '%recruit%') AS recruiter,
        arg_max(headline, (score, signal_date, -signal_id)) AS top_signal
      FROM signals WHERE signal_date >= {NOW} - INTERVAL 30 DAYS GROUP BY company_id),
    base AS (SELECT c.*, coalesce(roles, 0) AS n_roles, coalesce(signals, 0) AS n_signals, coalesce(fresh, 0) AS n_fresh,
        coalesce(founder, false) AS b_founder, coalesce(funding, false) AS b_funding, coalesce(recruiter, false) AS b_recruiter,
        coalesce(lead_role, false) AS b_lead, top_role, top_signal
      FROM companies c LEFT JOIN r USING (company_id) LEFT JOIN s USING (company_id)),
    d1 AS (SELECT *, composite_score >= 72 AND n_roles >= 1 AND n_signals >= 1 AS worth FROM base),
    d2 AS (SELECT *, worth AND NOT on_watchlist AS added,
        NOT worth AND on_watchlist AND coalesce({D.days("watchlist_added_at", NOW)} >= 14, false)
          AND composite_score <= 60 AND n_roles <= 0 AND n_signals <= 0 AS removed FROM d1),
    d3 AS (SELECT *, (on_watchlist OR added) AND NOT removed AS watched FROM d2),
    d4 AS (SELECT *, CASE WHEN watched THEN CAST(greatest(0, least(100, floor(composite_score + 0.5) + least(12, n_fresh * 4)
          + CASE WHEN b_founder THEN 10 ELSE 0 END + CASE WHEN b_funding THEN 6 ELSE 0 END + CASE WHEN remote_us THEN 4 ELSE 0 END)) AS INTEGER) END AS priority,
        watched AND composite_score >= 84 AND n_roles >= 1 AND n_signals >= 1
          AND company_id NOT IN (SELECT company_id FROM outreach WHERE status IN ('identified', 'drafted', 'sent')) AS outreach_now
      FROM d3),
    decided AS (SELECT *, coalesce(watched AND priority <> watchlist_priority, false) AS repriced FROM d4)"""


def _decided(t: Tables):
    return rules.apply_rules(t.companies, t.role_state, t.signals, t.outreach, AS_OF)


@query(
    "watchlist_actions",
    RULES_SQL
    + """ SELECT company_id, CASE WHEN added THEN 'add' WHEN removed THEN 'remove' ELSE 'reprioritise' END AS action,
      watched AS now_watched, priority FROM decided WHERE added OR removed OR repriced""",
)
def watchlist_actions(t: Tables):
    return rules.watchlist_actions(_decided(t))


@query(
    "outreach_actions",
    RULES_SQL
    + f""" SELECT company_id, CASE WHEN b_founder THEN 'founder' WHEN b_recruiter THEN 'recruiter' ELSE 'engineering lead' END AS contact_role,
      top_role, top_signal, {NOW} + INTERVAL 3 DAYS AS follow_up_due FROM decided WHERE outreach_now""",
)
def outreach_actions(t: Tables):
    return rules.outreach_actions(_decided(t), AS_OF)


@query(
    "automation_summary",
    RULES_SQL
    + """ SELECT count(*) AS companies_scanned, count(*) FILTER (WHERE added) AS watchlist_added,
      count(*) FILTER (WHERE removed) AS watchlist_removed, count(*) FILTER (WHERE repriced) AS priority_updated,
      count(*) FILTER (WHERE outreach_now) AS outreach_created FROM decided""",
)
def automation_summary(t: Tables):
    return rules.run_summary(_decided(t))


def _training_sql() -> str:
    maps = ",\n".join(
        [f"count(*) FILTER (WHERE live AND role_type = '{k}') AS role_type__{k}" for k in lex.ROLE_TYPES]
        + [f"count(*) FILTER (WHERE live AND source = '{k}') AS role_source__{k}" for k in lex.SIGNAL_TYPES]
    )
    kinds = ",\n".join(f"count(*) FILTER (WHERE type = '{k}') AS signal_count__{k}" for k in lex.SIGNAL_TYPES)
    return f"""WITH grid AS (
      SELECT CAST(d AS DATE) AS as_of_date, CAST(d AS TIMESTAMP) + INTERVAL 86399999999 MICROSECONDS AS eod
      FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-29', INTERVAL 7 DAYS) AS g(d)),
    cells AS (SELECT company_id, as_of_date, eod FROM companies CROSS JOIN grid),
    rr AS (SELECT company_id, as_of_date,
      count(*) FILTER (WHERE live) AS active_roles_total,
      count(*) FILTER (WHERE live AND is_remote_us) AS active_remote_roles_total,
      count(*) FILTER (WHERE first_seen_at BETWEEN eod - INTERVAL 6 DAYS AND eod) AS new_roles_7d,
      count(*) FILTER (WHERE first_seen_at BETWEEN eod - INTERVAL 29 DAYS AND eod) AS new_roles_30d,
      count(*) FILTER (WHERE first_seen_at <= eod AND removed_at BETWEEN eod - INTERVAL 29 DAYS AND eod) AS removed_roles_30d,
      count(*) FILTER (WHERE first_seen_at > eod AND first_seen_at <= eod + INTERVAL 30 DAYS) AS label_new_roles_next_30d,
      count(*) FILTER (WHERE first_seen_at > eod AND first_seen_at <= eod + INTERVAL 60 DAYS) AS label_new_roles_next_60d,
      {maps}
      FROM (SELECT c.company_id, c.as_of_date, c.eod, r.role_type, r.source, r.first_seen_at, r.removed_at, r.is_remote_us,
        r.first_seen_at <= c.eod AND (r.removed_at IS NULL OR r.removed_at > c.eod) AS live
        FROM cells c LEFT JOIN roles r USING (company_id)) AS x GROUP BY company_id, as_of_date),
    ss AS (SELECT company_id, as_of_date, count(*) AS signals_30d_total, max(coalesce(score, 0.0)) AS max_signal_score_30d, {kinds}
      FROM cells JOIN signals USING (company_id) WHERE signal_date BETWEEN eod - INTERVAL 29 DAYS AND eod GROUP BY company_id, as_of_date),
    ff AS (SELECT company_id, as_of_date, arg_max((announced_at, amount_usd, coalesce(round_type, '~')), (announced_at, amount_usd)) AS latest,
      count(*) FILTER (WHERE CAST(announced_at AS DATE) >= as_of_date - 365) AS funding_events_12m,
      sum(CASE WHEN CAST(announced_at AS DATE) >= as_of_date - 365 THEN amount_usd ELSE 0 END) AS funding_amount_12m
      FROM cells JOIN funding_history USING (company_id) WHERE announced_at <= eod GROUP BY company_id, as_of_date)
    SELECT rr.*, c.name AS company_name, c.funding_stage, c.headcount, c.engineering_headcount, c.remote_us,
      coalesce(signals_30d_total, 0) AS signals_30d_total, coalesce(max_signal_score_30d, 0.0) AS max_signal_score_30d,
      {", ".join(f"coalesce(signal_count__{k}, 0) AS signal_count__{k}" for k in lex.SIGNAL_TYPES)},
      date_diff('day', CAST(latest[1] AS DATE), rr.as_of_date) AS days_since_last_funding,
      latest[2] AS last_funding_amount_usd, CASE WHEN latest[3] = '~' THEN NULL ELSE latest[3] END AS last_funding_round_type,
      coalesce(funding_events_12m, 0) AS funding_events_12m, coalesce(funding_amount_12m, 0.0) AS funding_amount_12m,
      CASE WHEN label_new_roles_next_60d >= 3 THEN 1 ELSE 0 END AS label_eng_hiring_spike_next_60d
    FROM rr JOIN companies c USING (company_id) LEFT JOIN ss USING (company_id, as_of_date) LEFT JOIN ff USING (company_id, as_of_date)"""


def training(t: Tables):
    return dataset.training_rows(t.companies, t.roles, t.signals, t.funding_history, GRID.start, "2024-01-29", 7)


TRAINING_SQL = _training_sql()


@query("training_rows", TRAINING_SQL)
def training_rows(t: Tables):
    return training(t)


@query(
    "train_split",
    """WITH grid AS (
      SELECT CAST(d AS DATE) AS as_of_date FROM generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-01-29', INTERVAL 7 DAYS) AS g(d)),
    numbered AS (SELECT company_id, as_of_date,
        row_number() OVER (ORDER BY as_of_date, substr(md5(CAST(company_id AS VARCHAR)), 1, 3), company_id) AS n, count(*) OVER () AS total
      FROM companies CROSS JOIN grid)
    SELECT company_id, as_of_date, n <= greatest(1, least(total - 1, CAST(floor(total * 0.8) AS BIGINT))) AS is_train FROM numbered""",
)
def train_split(t: Tables):
    cells = GRID.dense(t.companies).select("company_id", GRID.date_of(F.col("pos")).alias("as_of_date"))
    return ranking.chronological_split(cells)
