"""One ingest run from staging frames to committed tables (U5, J3, M1-M5, M10, M11,
C5, A14, K4)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.clock import instant
from tideline.functions.labels import signal_payload
from tideline.functions.numbers import count_where
from tideline.functions.text import company_slug
from tideline.operators import joins, merge
from tideline.plans import scoring
from tideline.schemas import STAGED_COMPANY, TABLES, Staged, conform
from tideline.session import cut_lineage
from tideline.sources.store import TableStore


def stored_days(signals: DataFrame, staged: DataFrame) -> DataFrame:
    """Stored signals of the days in the batch, and the undated ones. The days are
    joined, so that Spark prunes the stored partitions when it runs, however many
    days a batch has."""
    days = staged.select(F.to_date("signal_date").alias("signal_day")).distinct()
    return signals.join(days, "signal_day", "left_semi").unionByName(signals.where("signal_day IS NULL"))


def _named_only(names: DataFrame) -> DataFrame:
    """Minimal staged companies for names that nothing else describes."""
    seq = F.struct(F.lit(2**62).alias("landed"), F.lit(0).alias("pos"))
    return conform(names.select("name", seq.alias("seq")), STAGED_COMPANY)


def ingest(
    store: TableStore, staged: Staged, as_of: str, run_id: str, profile: scoring.Profile = scoring.Profile(),
    predictions: DataFrame | None = None,
) -> dict:
    """Merge one batch and rescore the companies it touches.

    Only the buckets that the batch's keys fall into are read in full and rewritten;
    intermediate tables are written once to the run's own folder and read back. On an
    error before the run is ready nothing but the run's error row is left; a run that
    died after that is completed by its repeat."""
    if store.has_run(run_id):
        return {"run_id": run_id, "skipped": True}
    store.begin(run_id)
    if store.is_ready(run_id):
        store.finish(run_id)
        return {"run_id": run_id, "completed": True}
    try:
        summary, published = _ingest(store, staged, as_of, run_id, profile, predictions)
    except Exception as error:
        store.give_up(run_id)
        store.log_run(f"{run_id}-error", _run_row(store, staged.source, run_id, as_of, "error", 0, 0, str(error)[:2000]))
        raise
    store.finish(run_id, published)
    return summary


def _run_row(store: TableStore, source: str, run_id: str, as_of: str, status: str, found: int, new: int, error: str | None) -> DataFrame:
    return conform(
        store.spark.range(1).select(
            F.lit(run_id).alias("run_id"), F.lit(source).alias("source"), F.lit(status).alias("status"), instant(as_of).alias("started_at"),
            instant(as_of).alias("finished_at"), F.lit(found).alias("records_found"), F.lit(new).alias("records_new"), F.lit(error).alias("error_message"),
        ),
        TABLES["ingest_runs"],
    )


def _ingest(store, staged, as_of, run_id, profile, predictions) -> tuple[dict, DataFrame]:
    def keep(table: str, df: DataFrame, step: str = "") -> DataFrame:
        return store.stage(run_id, table, df, step)

    now = instant(as_of)
    # Payloads are parsed once; every later step reads the stored staging frames.
    staged = Staged(staged.source, *(cut_lineage(df) for df in (staged.companies, staged.signals, staged.roles)))
    named = staged.signals.select("company_name").unionByName(staged.roles.select("company_name"))
    every = staged.companies.select(F.col("name").alias("company_name")).unionByName(named).distinct()

    # Companies: the described ones, then a minimal row for every other name. A name in
    # any case has one slug, so all that the batch can mean lies in its slugs' buckets.
    slugs = every.select(company_slug(F.col("company_name")).alias("slug"))
    held = store.read("companies", store.buckets_of(slugs, "slug"))
    companies = keep("companies", merge.merge_companies(held, staged.companies, as_of), "-1")
    unknown = _named_only(joins.missing_companies(named, companies))
    companies = keep("companies", merge.merge_companies(companies, unknown, as_of), "-2")
    touched = cut_lineage(joins.resolve_company(every, companies).select("company_id").distinct())

    # Signals: only new ones; the table is appended to.
    signals = joins.resolve_company(staged.signals, companies)
    fresh = merge.new_signals(signals, stored_days(store.read("signals"), signals))
    fresh = fresh.withColumns(
        {"ingested_at": now, "signal_id": F.substring(F.sha2(F.concat_ws(":", "company_id", "dedup_key"), 256), 1, 32)}
    )
    added = keep("signals", fresh)
    bumped = merge.bump_last_signal(companies, added, as_of)

    # Funding history, and what the scores need of all signals, merged with the batch's.
    events = keep("funding_history", merge.funding_events(added.withColumn("seq", F.lit(0)), staged.source), "-new")
    funded = store.buckets_of(events, "company_id")
    if funded:
        keep("funding_history", merge.merge_funding(store.read("funding_history", funded), events.withColumn("seq", F.lit(0))))
    facts = store.read("signal_facts", store.buckets_of(touched, "company_id"))
    facts = keep("signal_facts", scoring.merged_signal_inputs(facts, scoring.signal_inputs(added)))

    # Roles, and for a crawl the ones that are gone; a run without roles leaves them.
    counts, role_state = {"new": 0, "seen": 0}, store.read("roles")
    if staged.source == "career_page" or not staged.roles.isEmpty():
        roles = joins.resolve_company(staged.roles, companies)
        crawled = joins.resolve_company(staged.companies.select(F.col("name").alias("company_name")), companies)
        urls = roles.select("url")
        if staged.source == "career_page":
            urls = urls.unionByName(role_state.where("is_active").join(crawled.select("company_id").distinct(), "company_id", "left_semi").select("url"))
        mine = store.buckets_of(urls, "url")
        merged = cut_lineage(merge.merge_roles(store.read("roles", mine), roles, as_of))
        counts = merged.agg(count_where(F.col("is_new")).alias("new"), F.coalesce(F.sum("staged_rows"), F.lit(0)).alias("seen")).first()
        if staged.source == "career_page":
            merged = merge.deactivate_missing(merged.drop("is_new", "staged_rows"), crawled, roles, "career_page", as_of)
        role_state = keep("roles", scoring.role_fit(merged, profile=profile)).unionByName(store.read("roles", but=mine))

    # Scores of every touched company.
    skills = role_state.join(touched, "company_id", "left_semi").select("role_id", F.explode("required_skills").alias("skill"))
    scores = scoring.rescore(
        bumped.drop("fit_score", "urgency_score", "composite_score"), role_state, None, as_of, skills,
        predictions, affected=touched, profile=profile, facts=facts,
    ).select("company_id", "fit_score", "urgency_score", "composite_score")
    keep("companies", merge.apply_updates(bumped, scores, "company_id"))

    n_companies, n_found = staged.companies.count(), staged.signals.count() + staged.roles.count()
    summary = {
        "run_id": run_id, "source": staged.source, "companies_upserted": n_companies, "signals_new": added.count(),
        "roles_new": counts["new"], "roles_updated": counts["seen"] - counts["new"], "companies_rescored": touched.count(),
    }
    keep("ingest_runs", _run_row(store, staged.source, run_id, as_of, "success", n_companies + n_found, summary["signals_new"] + summary["roles_new"], None))
    return summary, payloads(added, companies)


def payloads(signals: DataFrame, companies: DataFrame) -> DataFrame:
    """One payload row per signal."""
    named = joins.with_company_name(signals, companies)
    payload = signal_payload(
        *[F.col(c) for c in ("signal_id", "company_id", "company_name", "type", "headline", "detail", "score", "signal_date", "source_url")]
    )
    return named.select(payload.alias("p")).select("p.*")


def last_run(runs: DataFrame, source: str) -> DataFrame:
    """The latest run of a source."""
    return runs.where(F.col("source") == source).orderBy(F.desc("started_at"), "run_id").limit(1)
