"""Point-in-time rollups and training rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.catalog.registry import query
from tideline.functions import lexicons as lex
from tideline.operators import asof
from tideline.tables import AS_OF_DATE, Tables

GRID = asof.Grid("2024-01-01", "2024-01-29", 7)
GRID_30 = asof.Grid("2024-01-01", "2024-01-30", 1)

EOD = f"TIMESTAMP '{AS_OF_DATE} 23:59:59.999999'"
START_7 = "TIMESTAMP '2024-01-14 23:59:59.999999'"
START_30 = "TIMESTAMP '2023-12-22 23:59:59.999999'"


@query(
    "role_rollup_asof",
    f"""SELECT company_id,
      count(*) FILTER (WHERE removed_at IS NULL OR removed_at > {EOD}) AS active_roles_total,
      count(*) FILTER (WHERE (removed_at IS NULL OR removed_at > {EOD}) AND is_remote_us) AS active_remote_roles_total,
      count(*) FILTER (WHERE first_seen_at >= {START_7}) AS new_roles_7d,
      count(*) FILTER (WHERE first_seen_at >= {START_30}) AS new_roles_30d,
      count(*) FILTER (WHERE removed_at BETWEEN {START_30} AND {EOD}) AS removed_roles_30d
    FROM roles WHERE first_seen_at <= {EOD} GROUP BY company_id""",
)
def role_rollup_asof(t: Tables):
    return asof.role_rollup(t.roles, AS_OF_DATE)


def _grid_sql(start: str, end: str, step: int, columns: str) -> str:
    return f"""WITH grid AS (
      SELECT CAST(d AS DATE) AS as_of_date, CAST(d AS TIMESTAMP) + INTERVAL 86399999999 MICROSECONDS AS eod
      FROM generate_series(TIMESTAMP '{start}', TIMESTAMP '{end}', INTERVAL {step} DAYS) AS g(d))
    SELECT c.company_id, g.as_of_date, {columns}
    FROM companies c CROSS JOIN grid g LEFT JOIN roles r ON r.company_id = c.company_id
    GROUP BY c.company_id, g.as_of_date"""


ROLE_COLUMNS = """
      count(*) FILTER (WHERE first_seen_at <= eod AND (removed_at IS NULL OR removed_at > eod)) AS active_roles_total,
      count(*) FILTER (WHERE first_seen_at <= eod AND (removed_at IS NULL OR removed_at > eod) AND is_remote_us) AS active_remote_roles_total,
      count(*) FILTER (WHERE first_seen_at BETWEEN eod - INTERVAL 6 DAYS AND eod) AS new_roles_7d,
      count(*) FILTER (WHERE first_seen_at BETWEEN eod - INTERVAL 29 DAYS AND eod) AS new_roles_30d,
      count(*) FILTER (WHERE first_seen_at <= eod AND removed_at BETWEEN eod - INTERVAL 29 DAYS AND eod) AS removed_roles_30d"""
LABEL_COLUMNS = """
      count(*) FILTER (WHERE first_seen_at > eod AND first_seen_at <= eod + INTERVAL 30 DAYS) AS label_new_roles_next_30d,
      count(*) FILTER (WHERE first_seen_at > eod AND first_seen_at <= eod + INTERVAL 60 DAYS) AS label_new_roles_next_60d"""


@query("role_rollup_grid", _grid_sql("2024-01-01", "2024-01-29", 7, ROLE_COLUMNS))
def role_rollup_grid(t: Tables):
    return asof.role_grid(t.companies, t.roles, GRID, asof.ROLE_MEASURES[:5])


@query("role_rollup_grid_30d", _grid_sql("2024-01-01", "2024-01-30", 1, ROLE_COLUMNS))
def role_rollup_grid_30d(t: Tables):
    return asof.role_grid(t.companies, t.roles, GRID_30, asof.ROLE_MEASURES[:5])


@query(
    "future_role_labels",
    f"""SELECT *, CASE WHEN label_new_roles_next_60d >= 3 THEN 1 ELSE 0 END AS label_eng_hiring_spike_next_60d
    FROM ({_grid_sql("2023-06-01", "2023-12-01", 30, LABEL_COLUMNS)}) AS x""".replace("WITH grid", "WITH grid"),
)
def future_role_labels(t: Tables):
    grid = asof.Grid("2023-06-01", "2023-12-01", 30)
    rows = asof.role_grid(t.companies, t.roles, grid, ("next_30d", "next_60d"))
    return rows.withColumn("label_eng_hiring_spike_next_60d", F.when(F.col("label_new_roles_next_60d") >= 3, 1).otherwise(0))


@query(
    "future_role_count",
    """SELECT company_id, count(*) AS new_roles_next_60d FROM roles
    WHERE first_seen_at > TIMESTAMP '2023-11-30 23:59:59.999999' AND first_seen_at <= TIMESTAMP '2024-01-29 23:59:59.999999'
    GROUP BY company_id""",
)
def future_role_count(t: Tables):
    return asof.future_role_count(t.roles, "2023-11-30", 60)


@query(
    "role_type_counts",
    f"""SELECT company_id, role_type, count(*) AS n FROM roles
    WHERE first_seen_at <= {EOD} AND (removed_at IS NULL OR removed_at > {EOD}) GROUP BY company_id, role_type""",
)
def role_type_counts(t: Tables):
    return asof.active_role_counts(t.roles, AS_OF_DATE, "role_type")


@query(
    "role_source_map",
    f"""SELECT company_id, string_agg(source || ':' || n, ',' ORDER BY source) AS source_counts FROM (
      SELECT company_id, source, count(*) AS n FROM roles
      WHERE first_seen_at <= {EOD} AND (removed_at IS NULL OR removed_at > {EOD}) GROUP BY company_id, source) AS x
    GROUP BY company_id""",
)
def role_source_map(t: Tables):
    counts = asof.active_role_counts(t.roles, AS_OF_DATE, "source")
    entries = F.transform(F.map_entries("source_counts"), lambda e: F.concat_ws(":", e["key"], e["value"]))
    return asof.count_map(counts, "source", "source_counts").select(
        "company_id", F.array_join(entries, ",").alias("source_counts")
    )


@query(
    "signal_metrics_30d",
    f"""SELECT company_id, count(*) AS signals_30d_total, max(coalesce(score, 0.0)) AS max_signal_score_30d,
      {", ".join(f"count(*) FILTER (WHERE type = '{k}') AS signals_{k}" for k in lex.SIGNAL_TYPES)}
    FROM signals WHERE signal_date BETWEEN {START_30} AND {EOD} GROUP BY company_id""",
)
def signal_metrics_30d(t: Tables):
    return asof.signal_metrics(t.signals, AS_OF_DATE)


FUNDING_SQL = f"""WITH known AS (
      SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY announced_at DESC, amount_usd DESC NULLS LAST) AS rn
      FROM funding_history WHERE announced_at <= {EOD})
    SELECT company_id,
      max(CASE WHEN rn = 1 THEN date_diff('day', CAST(announced_at AS DATE), DATE '{AS_OF_DATE}') END) AS days_since_last_funding,
      max(CASE WHEN rn = 1 THEN amount_usd END) AS last_funding_amount_usd,
      max(CASE WHEN rn = 1 THEN round_type END) AS last_funding_round_type,
      count(*) FILTER (WHERE CAST(announced_at AS DATE) >= DATE '{AS_OF_DATE}' - 365) AS funding_events_12m,
      sum(CASE WHEN CAST(announced_at AS DATE) >= DATE '{AS_OF_DATE}' - 365 THEN coalesce(amount_usd, 0) ELSE 0 END) AS funding_amount_12m
    FROM known GROUP BY company_id"""


@query("funding_metrics", FUNDING_SQL)
def funding_metrics(t: Tables):
    return asof.funding_metrics(t.funding_history, AS_OF_DATE)


@query(
    "open_days",
    """SELECT company_id, avg(days_open) AS avg_days_open, max(days_open) AS oldest_open_days
    FROM role_state WHERE is_active GROUP BY company_id""",
)
def open_days(t: Tables):
    return asof.open_days(t.role_state)
