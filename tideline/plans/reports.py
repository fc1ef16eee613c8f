"""Table outputs: stats card, digest, brief context, summaries."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.clock import instant, shift
from tideline.functions.labels import (
    execution_label, funding_label, score_variant, signal_type_label, stage_label, stored_urgency_label, urgency_label,
)
from tideline.functions.numbers import count_where
from tideline.operators import filters, joins, ranking


def one_row(parts: list[DataFrame]) -> DataFrame:
    """Side-by-side columns of one-row frames, without a cross join."""
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return union.agg(*[F.max(c).alias(c) for c in union.columns])


def stats_card(
    companies: DataFrame, role_state: DataFrame, signals: DataFrame, outreach: DataFrame, execution: DataFrame,
    runs: DataFrame | None, as_of: str,
) -> DataFrame:
    """A1, A2, Q18: one row; one aggregate per table. ``signals`` are counted for
    the last 24 hours by ``ingested_at`` when present, else by their date."""
    now = instant(as_of)
    seen = "ingested_at" if "ingested_at" in signals.columns else "signal_date"
    parts = [
        companies.agg(
            F.count(F.lit(1)).alias("companies_total"),
            count_where(F.col("on_watchlist")).alias("companies_watchlist"),
            F.avg("fit_score").alias("avg_fit_score"),
        ),
        role_state.agg(count_where(F.col("is_active")).alias("open_roles")),
        signals.agg(
            F.count(F.lit(1)).alias("signals_total"),
            count_where(F.col(seen) >= shift(now, hours=-24)).alias("signals_last_24h"),
        ),
        filters.outreach_due(outreach, as_of).agg(F.count(F.lit(1)).alias("outreach_only")),
        filters.follow_up_due(execution, as_of).agg(F.count(F.lit(1)).alias("follow_ups")),
    ]
    if runs is not None:
        parts.append(runs.agg(F.max("finished_at").alias("last_ingest")))
    card = one_row(parts)
    return card.withColumn("outreach_due", F.col("outreach_only") + F.col("follow_ups")).drop("outreach_only", "follow_ups")


def _lists(df: DataFrame, order: str, value: Column, name: str) -> DataFrame:
    """Values of already limited rows as one array per company in rank order."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(order).alias("_o"), value.alias("_v"))))
    return df.groupBy("company_id").agg(F.transform(pairs, lambda p: p["_v"]).alias(name))


def digest_companies(companies: DataFrame, signals: DataFrame, limit: int = 5, per_company: int = 2) -> DataFrame:
    """O1: the best companies with their two best signal headlines."""
    top = companies.orderBy(F.desc("composite_score"), "company_id").limit(limit)
    # Only the signals of the listed companies are ranked.
    scoped = signals.join(top.select("company_id"), "company_id", "left_semi")
    best = ranking.top_signals(scoped, per_company)
    lines = _lists(best, "rank", F.coalesce("headline", F.lit("")), "signal_headlines")
    return top.join(lines, "company_id", "left").select(
        "company_id",
        "name",
        F.col("composite_score").alias("score"),
        urgency_label(F.coalesce("urgency_score", F.lit(0.0))).alias("urgency"),
        "tagline",
        "funding_stage",
        F.array_join(F.coalesce("signal_headlines", F.array().cast("array<string>")), " · ").alias("signals"),
    )


def digest_signals(signals: DataFrame, companies: DataFrame, as_of: str, limit: int = 6) -> DataFrame:
    """O1: the best new signals of the last 24 hours."""
    fresh = filters.best_signals(filters.recent_signals(signals, as_of, hours=24), limit)
    return joins.with_company_name(fresh, companies).select("signal_id", "type", "company_name", "headline", "score", "signal_date")


def digest_totals(companies: DataFrame, role_state: DataFrame, signals: DataFrame, outreach: DataFrame, as_of: str) -> DataFrame:
    """O1: totals under the digest."""
    recent = F.col("signal_date") >= shift(instant(as_of), hours=-24)
    return one_row(
        [
            companies.agg(F.count(F.lit(1)).alias("companies")),
            role_state.agg(count_where(F.col("is_active")).alias("roles")),
            signals.agg(count_where(recent).alias("new_signals")),
            filters.outreach_due(outreach, as_of).agg(F.count(F.lit(1)).alias("outreach_due")),
        ]
    )


def brief_context(candidates: DataFrame, signals: DataFrame, role_state: DataFrame) -> DataFrame:
    """O2: what a brief is written from, per candidate company: 5 newest signals,
    5 newest active roles, two names of each stack part."""
    keys = candidates.select("company_id")
    newest = ranking.newest_signals(signals.join(keys, "company_id", "left_semi"), 5)
    line = F.concat(
        F.replace("type", F.lit("_"), F.lit(" ")),
        F.lit(": "),
        F.coalesce(F.nullif("headline", F.lit("")), F.lit("activity detected")),
    )
    roles = ranking.top_k(
        role_state.where("is_active").join(keys, "company_id", "left_semi"),
        ["company_id"], [F.desc("first_seen_at"), F.asc("role_id")], 5,
    )
    empty = F.array().cast("array<string>")
    return (
        candidates.join(_lists(newest, "rank", line, "recent_signals"), "company_id", "left")
        .join(_lists(roles, "rank", F.col("title"), "open_roles"), "company_id", "left")
        .withColumns({c: F.coalesce(c, empty) for c in ("recent_signals", "open_roles")})
        .withColumns(
            {
                "visible_stack": F.array_join(
                    F.concat(*[F.slice(f"tech_stack.{p}", 1, 2) for p in ("languages", "frameworks", "infra")]), ", "
                ),
                "urgency_label": stored_urgency_label(F.coalesce("urgency_score", F.lit(0.0))),
                "active_role_count": F.size("open_roles"),
            }
        )
    )


def company_cards(
    companies: DataFrame, role_state: DataFrame, signals: DataFrame, as_of: str, role_cap: int | None = None,
    signal_cap: int | None = None,
) -> DataFrame:
    """Companies with their counts and labels. Caps reproduce the row limits of
    a served card (Q24); unset, the counts are whole."""
    recent = filters.recent_signals(signals, as_of)
    role_n = role_state.where("is_active").groupBy("company_id").agg(F.count(F.lit(1)).alias("open_roles"))
    signal_n = recent.groupBy("company_id").agg(F.count(F.lit(1)).alias("signal_count"))

    def counted(c: str, cap: int | None) -> Column:
        value = F.coalesce(c, F.lit(0))
        return F.least(value, F.lit(cap)) if cap else value

    label = funding_label(F.col("funding_amount_usd"), F.col("funding_stage"))
    return (
        companies.join(role_n, "company_id", "left")
        .join(signal_n, "company_id", "left")
        .withColumns(
            {
                "open_roles": counted("open_roles", role_cap),
                "signal_count": counted("signal_count", signal_cap),
                "funding_label": label,
                "stage_label": stage_label(F.col("funding_stage"), label),
                "urgency_label": urgency_label(F.coalesce("urgency_score", F.lit(0.0))),
                "remote_label": F.when(F.col("remote_us"), "Remote US").otherwise("On-site"),
                "location": F.when(F.col("remote_us"), "Remote").otherwise("On-site"),
            }
        )
    )


def signal_cards(signals: DataFrame, companies: DataFrame) -> DataFrame:
    """O4"""
    return joins.with_company_name(signals, companies).withColumns(
        {
            "type_label": signal_type_label(F.col("type")),
            "score_variant": score_variant(F.coalesce("score", F.lit(0.0))),
            "headline": F.coalesce("headline", F.lit("")),
        }
    )


def execution_cards(events: DataFrame, companies: DataFrame, newest: int = 12) -> DataFrame:
    """State per company, newest first, with its newest events."""
    state = joins.with_company_name(ranking.execution_state(events), companies)
    shown = ranking.execution_history(events, newest)
    text = F.concat_ws("|", F.col("status"), F.date_format("occurred_at", "yyyy-MM-dd HH:mm"))
    return (
        state.join(_lists(shown, "rank", text, "events"), "company_id", "left")
        .withColumn("status_label", execution_label(F.col("status")))
        .orderBy(F.desc("last_event_at"), "company_id")
    )
