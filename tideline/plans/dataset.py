"""Feature payloads and labelled training rows (ML1, ML2, ML6, J8, J9, K1, S15)."""

from __future__ import annotations

from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import lexicons as lex
from tideline.operators import asof

FEATURE_VERSION = "v1"

# Order of the source and signal columns of the feature vector. Fixed values.
VECTOR_SOURCES = ("ats_greenhouse", "ats_ashby", "ats_lever", "career_page", "yc_jobs", "wellfound")
VECTOR_SIGNALS = (
    "funding", "founder_post", "github_spike", "blog_post", "news", "career_page", "ats_greenhouse", "ats_ashby",
    "ats_lever", "yc_jobs", "wellfound",
)
VECTOR_NUMBERS = (
    "headcount", "engineering_headcount", "active_roles_total", "active_remote_roles_total", "new_roles_7d",
    "new_roles_30d", "removed_roles_30d", "days_since_last_funding", "last_funding_amount_usd", "funding_events_12m",
    "funding_amount_12m", "signals_30d_total", "max_signal_score_30d",
)
FEATURE_COLUMNS = (
    "funding_stage_ord", *VECTOR_NUMBERS, "headcount_missing", "engineering_headcount_missing",
    *[f"role_type__{k}" for k in lex.ROLE_TYPES],
    *[f"role_source__{k}" for k in VECTOR_SOURCES],
    *[f"signal_count__{k}" for k in VECTOR_SIGNALS],
)
MAP_PREFIXES = {"role_type_counts": "role_type__", "source_counts": "role_source__", "signal_counts_30d": "signal_count__"}


def features(
    companies: DataFrame, roles: DataFrame, signals: DataFrame, funding: DataFrame, grid: asof.Grid
) -> DataFrame:
    """ML1, wide form: one row per company and date with the company's own
    attributes joined on (J8: rows without a company do not occur, the grid is
    built from the companies)."""
    own = companies.select(
        "company_id",
        F.col("name").alias("company_name"),
        F.coalesce("funding_stage", F.lit("unknown")).alias("funding_stage"),
        "headcount",
        "engineering_headcount",
        F.coalesce("remote_us", F.lit(False)).alias("remote_us"),
    )
    return asof.feature_grid(companies, roles, signals, funding, grid).join(own, "company_id")


def training_rows(
    companies: DataFrame, roles: DataFrame, signals: DataFrame, funding: DataFrame, start: str | date,
    end: str | date, step_days: int = 7,
) -> DataFrame:
    """Features and labels of every company on every date of the grid."""
    rows = features(companies, roles, signals, funding, asof.Grid(start, end, step_days))
    return rows.withColumn(
        "label_eng_hiring_spike_next_60d", F.when(F.col("label_new_roles_next_60d") >= 3, 1).otherwise(0)
    )


def _counts_json(rows: DataFrame, prefix: str) -> Column:
    """JSON object of the non-zero counts, keys sorted."""
    names = sorted(c for c in rows.columns if c.startswith(prefix))
    entries = F.array_compact(
        F.array(*[F.when(F.col(c) > 0, F.struct(F.lit(c.removeprefix(prefix)), F.col(c).cast("long"))) for c in names])
    )
    return F.to_json(F.map_from_entries(entries))


EXPORT_COLUMNS = (
    "company_id", "company_name", "as_of_date", "feature_version", "funding_stage", "headcount",
    "engineering_headcount", "active_roles_total", "active_remote_roles_total", "new_roles_7d", "new_roles_30d",
    "removed_roles_30d", "days_since_last_funding", "last_funding_amount_usd", "funding_events_12m",
    "funding_amount_12m", "signals_30d_total", "max_signal_score_30d", "signal_counts_30d", "role_type_counts",
    "source_counts", "label_new_roles_next_30d", "label_new_roles_next_60d", "label_eng_hiring_spike_next_60d",
)


def export_frame(rows: DataFrame) -> DataFrame:
    """K1: training rows in the columns of the exchange file, count maps as JSON."""
    maps = {name: _counts_json(rows, prefix) for name, prefix in MAP_PREFIXES.items()}
    return rows.withColumn("feature_version", F.lit(FEATURE_VERSION)).withColumns(maps).select(*EXPORT_COLUMNS)


def write_export(rows: DataFrame, path: str) -> None:
    """K1: a folder of CSV parts with header, partition-wise; quotes doubled as
    CSV readers expect."""
    export_frame(rows).write.mode("overwrite").csv(path, header=True, escape='"')


EXPORT_SCHEMA = (
    "company_id string, company_name string, as_of_date date, feature_version string, funding_stage string,"
    "headcount double, engineering_headcount double, active_roles_total double, active_remote_roles_total double,"
    "new_roles_7d double, new_roles_30d double, removed_roles_30d double, days_since_last_funding double,"
    "last_funding_amount_usd double, funding_events_12m double, funding_amount_12m double, signals_30d_total double,"
    "max_signal_score_30d double, signal_counts_30d string, role_type_counts string, source_counts string,"
    "label_new_roles_next_30d double, label_new_roles_next_60d double, label_eng_hiring_spike_next_60d double"
)


def read_export(spark, path: str) -> DataFrame:
    """Exchange file with rows that carry a label; count maps back to wide
    columns, bad JSON counting as an empty map."""
    rows = spark.read.csv(path, schema=EXPORT_SCHEMA, header=True, escape='"')
    rows = rows.where(F.col("label_new_roles_next_30d").isNotNull())
    sets = {"role_type_counts": lex.ROLE_TYPES, "source_counts": VECTOR_SOURCES, "signal_counts_30d": VECTOR_SIGNALS}
    wide = {}
    for name, keys in sets.items():
        parsed = F.from_json(F.col(name), "map<string,double>")
        for key in keys:
            wide[MAP_PREFIXES[name] + key] = F.coalesce(F.try_element_at(parsed, F.lit(key)), F.lit(0.0))
    return rows.withColumns(wide).drop(*sets)


def vector_columns(rows: DataFrame) -> DataFrame:
    """ML2: the 43 vector columns as doubles; other columns stay. Missing numbers
    are 0, missing days since funding 365, missing headcounts flagged."""
    stage = F.lower(F.coalesce("funding_stage", F.lit("unknown")))
    ordinal = F.lit(0.0)
    for name, value in lex.STAGE_ORDINAL.items():
        ordinal = F.when(stage == name, F.lit(value)).otherwise(ordinal)
    out = {"funding_stage_ord": ordinal}
    for c in ("headcount", "engineering_headcount"):
        out[f"{c}_missing"] = F.when(F.col(c).isNull(), 1.0).otherwise(0.0)
    rows = rows.withColumns(out)
    fill = {}
    for c in FEATURE_COLUMNS:
        if c in out:
            continue
        default = 365.0 if c == "days_since_last_funding" else 0.0
        value = F.col(c).cast("double") if c in rows.columns else F.lit(None).cast("double")
        fill[c] = F.coalesce(value, F.lit(default))
    return rows.withColumns(fill)
