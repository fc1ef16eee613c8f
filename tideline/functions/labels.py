"""Score ladders, labels and payload shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tideline.functions import lexicons as lex
from tideline.functions.text import contains_any


def lookup(key: Column, table: dict, fallback: Column) -> Column:
    """``table[key]``, or ``fallback``. A chain of equality tests stays inside
    generated code and lets the optimizer fold it."""
    out = fallback
    for name, value in table.items():
        out = F.when(key == name, F.lit(value)).otherwise(out)
    return out


def words_of(key: Column) -> Column:
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))


def score_variant(score: Column) -> Column:
    return F.when(score >= 75, "high").when(score >= 50, "medium").otherwise("low")


def urgency_label(score: Column) -> Column:
    """75 / 50 / 25 ladder of the scoring job and the API."""
    return F.when(score >= 75, "critical").when(score >= 50, "high").when(score >= 25, "medium").otherwise("low")


def stored_urgency_label(score: Column) -> Column:
    """80 / 60 / 35 ladder of the stored company record; feeds the brief context."""
    return F.when(score >= 80, "critical").when(score >= 60, "high").when(score >= 35, "medium").otherwise("low")


def signal_type_label(kind: Column) -> Column:
    return lookup(kind, lex.SIGNAL_TYPE_LABELS, words_of(kind))


def execution_label(status: Column) -> Column:
    return lookup(status, lex.EXECUTION_LABELS, words_of(status))


def funding_label(amount: Column, stage: Column) -> Column:
    """'$12M series_a', or the stage in words, or ''."""
    has_amount = amount.isNotNull() & (amount != 0)
    return (
        F.when(has_amount, F.format_string("$%.0fM %s", F.rint(amount / 1e6), stage))
        .when(stage.isNotNull() & (stage != "unknown"), words_of(stage))
        .otherwise(F.lit(""))
    )


def stage_label(stage: Column, funding: Column) -> Column:
    """The stage in words; for unknown stages inferred from the funding
    label; else 'Unverified'."""
    text = F.lower(F.coalesce(funding, F.lit("")))
    inferred = (
        F.when(contains_any(text, ("series d", "series e", "series f")), "Series D+")
        .when(text.contains("series c"), "Series C")
        .when(text.contains("series b"), "Series B")
        .when(text.contains("series a"), "Series A")
        .when(text.contains("seed"), "Seed")
        .when(contains_any(text, ("public", "ipo")), "Public")
        .otherwise("Unverified")
    )
    return F.when(stage.isNotNull() & (stage != "unknown"), words_of(stage)).otherwise(inferred)


def signal_payload(
    signal_id: Column, company_id: Column, company_name: Column, kind: Column, headline: Column, detail: Column,
    score: Column, at: Column, url: Column,
) -> Column:
    """The payload struct of one signal."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    value = F.coalesce(score, F.lit(0.0))
    return F.struct(
        signal_id.cast("string").alias("id"),
        company_id.cast("string").alias("company_id"),
        text(company_name).alias("company_name"),
        kind.alias("type"),
        signal_type_label(kind).alias("type_label"),
        text(headline).alias("headline"),
        text(detail).alias("detail"),
        value.alias("score"),
        score_variant(value).alias("score_variant"),
        F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("signal_date"),
        text(url).alias("source_url"),
    )
