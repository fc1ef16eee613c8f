"""Row-level scores of signals, feed entries and repository activity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import lexicons as lex
from tideline.functions.clock import age_days, linear_decay
from tideline.functions.numbers import clamp
from tideline.functions.text import contains_any, found_in


def signal_score(
    kind: Column, at: Column, now: Column, amount: Column | None = None, batch: Column | None = None,
    sigma: Column | None = None,
) -> Column:
    """Base score of a raw signal, decayed linearly by its age."""
    age = age_days(at, now)
    amount = F.coalesce(amount if amount is not None else F.lit(None).cast("double"), F.lit(0.0))
    batch = F.coalesce(batch, F.lit(False)) if batch is not None else F.lit(False)
    sigma = F.coalesce(sigma, F.lit(2.0)) if sigma is not None else F.lit(2.0)
    out = (
        F.when(kind == "funding", F.when(amount >= 20_000_000, 70.0).otherwise(50.0) * linear_decay(age, 60))
        .when(kind == "github_spike", F.least(40.0 + sigma * 6, F.lit(75.0)) * linear_decay(age, 7))
    )
    for name, (base, horizon) in lex.SIGNAL_DECAY.items():
        value = F.when(batch, 85.0).otherwise(base) if name.startswith("ats_") else F.lit(base)
        out = out.when(kind == name, value * linear_decay(age, horizon))
    return out.otherwise(30.0)


def ashby_score(at: Column, now: Column) -> Column:
    """P22"""
    return F.greatest(70.0 - age_days(at, now) * 1.5, F.lit(20.0))


def spike_score(sigma: Column, commits: Column) -> Column:
    """P23"""
    return F.least(
        40.0 + F.least(sigma * 8, F.lit(30.0)) + F.least(commits / F.lit(5.0), F.lit(20.0)), F.lit(90.0)
    )


def is_infra_repo(name: Column) -> Column:
    """P23"""
    return contains_any(F.lower(name), lex.INFRA_REPO_WORDS)


def _weights(text: Column, table: dict[str, float]) -> Column:
    total = F.lit(0.0)
    for phrase, weight in table.items():
        total = total + F.when(text.contains(phrase), F.lit(weight)).otherwise(0.0)
    return total


def with_entry_scores(
    entries: DataFrame, title: Column, summary: Column, kind: Column, actor_role: Column
) -> DataFrame:
    """P20: ``score`` and ``hits`` of every feed entry, over its whole text. The
    lower-cased text is a column of its own, so it is built once per entry and not
    once per phrase."""
    body = F.concat_ws("\n", F.coalesce(title, F.lit("")), F.coalesce(summary, F.lit("")))
    lowered = entries.withColumns({"_head": F.lower(F.coalesce(title, F.lit(""))), "_text": F.lower(body)})
    head, text = F.col("_head"), F.col("_text")
    gate = F.when(contains_any(text, lex.HIRING_GATE_WORDS), 0.0).otherwise(-16.0)
    bonus = F.when(contains_any(head, lex.TITLE_BONUS_WORDS), 8.0).otherwise(0.0)
    hits = found_in(text, [*lex.HIRING_PHRASES, *lex.ENGINEERING_PHRASES])
    lowered = lowered.withColumns({"hits": hits, "_down": _weights(text, lex.DOWNRANK_PHRASES), "_extra": gate + bonus})
    # Positive weights are read off the hits instead of the text.
    weights = F.create_map(*[F.lit(x) for pair in {**lex.HIRING_PHRASES, **lex.ENGINEERING_PHRASES}.items() for x in pair])
    gained = F.aggregate(F.transform("hits", lambda p: F.element_at(weights, p)), F.lit(0.0), lambda a, w: a + w)
    raw = (
        F.when(kind == "founder_post", 12.0).otherwise(6.0)
        + gained
        + F.col("_down")
        + F.col("_extra")
        + F.when(F.coalesce(actor_role, F.lit("")) != "", 4.0).otherwise(0.0)
    )
    return lowered.withColumn("score", clamp(raw, 0.0, 95.0)).drop("_head", "_text", "_down", "_extra")
