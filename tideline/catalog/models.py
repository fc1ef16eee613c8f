"""Training and applying the velocity model on training rows of the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.catalog.registry import query
from tideline.catalog.scoring import TRAINING_SQL, training
from tideline.functions import lexicons as lex
from tideline.operators import asof
from tideline.plans import dataset, model, scoring
from tideline.session import shared_folder
from tideline.tables import AS_OF, Tables

_trained: dict[tuple[str, str], str] = {}


def velocity_model(t: Tables) -> model.Artifact:
    """The forest with the settings that a run uses, trained once per session and folder
    of tables: both queries below apply the same one."""
    made = (t.spark.sparkContext.applicationId, t.folder)
    if made not in _trained:
        rows = dataset.training_rows(t.companies, t.roles, t.signals, t.funding_history, "2023-06-01", "2023-12-28", 30)
        path = shared_folder(t.spark, "velocity-model")
        model.train(rows, path, metrics=False)
        _trained[made] = path
    return model.load(t.spark, _trained[made])


def today_features(t: Tables):
    return dataset.features(t.companies, t.roles, t.signals, t.funding_history, asof.Grid("2024-01-20", "2024-01-20", 1))


@query("model_predictions")
def model_predictions(t: Tables):
    # No SQL check: forest training is iterative. Invariants are tested.
    return model.predict(velocity_model(t), today_features(t))


@query("blended_ranking")
def blended_ranking(t: Tables):
    predictions = model.predict(velocity_model(t), today_features(t))
    return (
        scoring.rescore(t.companies, t.role_state, t.signals, AS_OF, t.role_skills, predictions=predictions)
        .select("company_id", "name", "fit_score", "urgency_score", "model_score", "composite_score")
        .orderBy(F.desc("composite_score"), "company_id")
        .limit(200)
    )


def _vector_sql() -> str:
    """All vector columns over the SQL of the training rows."""
    stages = " ".join(f"WHEN '{k}' THEN {v}" for k, v in lex.STAGE_ORDINAL.items())
    made = {
        "funding_stage_ord": f"CASE lower(coalesce(funding_stage, 'unknown')) {stages} ELSE 0.0 END",
        "headcount_missing": "CASE WHEN headcount IS NULL THEN 1 ELSE 0 END",
        "engineering_headcount_missing": "CASE WHEN engineering_headcount IS NULL THEN 1 ELSE 0 END",
        "days_since_last_funding": "coalesce(days_since_last_funding, 365)",
    }
    columns = ", ".join(f"CAST({made.get(c, f'coalesce({c}, 0)')} AS DOUBLE) AS {c}" for c in dataset.FEATURE_COLUMNS)
    return f"SELECT company_id, as_of_date, {columns} FROM ({TRAINING_SQL}) AS rows"


@query("feature_vectors", _vector_sql())
def feature_vectors(t: Tables):
    """ML2: all 43 columns, for every company and date of the training grid."""
    return dataset.vector_columns(training(t)).select("company_id", "as_of_date", *dataset.FEATURE_COLUMNS)


def _export_sql() -> str:
    """All columns of the exchange file over the SQL of the training rows."""
    kinds = {"role_type_counts": lex.ROLE_TYPES, "source_counts": lex.SIGNAL_TYPES, "signal_counts_30d": lex.SIGNAL_TYPES}
    made = {"feature_version": f"'{dataset.FEATURE_VERSION}'", "funding_stage": "coalesce(funding_stage, 'unknown')"}
    for name, keys in kinds.items():
        prefix = dataset.MAP_PREFIXES[name]
        entries = ", ".join(f"""CASE WHEN {prefix}{k} > 0 THEN '"{k}":' || {prefix}{k} END""" for k in sorted(keys))
        made[name] = f"'{{' || concat_ws(',', {entries}) || '}}'"
    columns = ", ".join(f"{made.get(c, c)} AS {c}" for c in dataset.EXPORT_COLUMNS)
    return f"SELECT {columns} FROM ({TRAINING_SQL}) AS rows"


@query("training_export", _export_sql())
def training_export(t: Tables):
    """K1: every column of the exchange file, for every company and date of the training grid."""
    return dataset.export_frame(training(t))


@query("training_reimport", f"SELECT vectors.* REPLACE (CAST(company_id AS VARCHAR) AS company_id) FROM ({_vector_sql()}) AS vectors")
def training_reimport(t: Tables):
    """The exchange file written, read back and made into vectors again; its ids are strings."""
    path = shared_folder(t.spark, "training-export")
    dataset.write_export(training(t), path)
    return dataset.vector_columns(dataset.read_export(t.spark, path)).select("company_id", "as_of_date", *dataset.FEATURE_COLUMNS)
