"""Parsing and scoring of funding text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import lexicons as lex
from tideline.functions.clock import parse_instant
from tideline.functions.labels import lookup
from tideline.functions.numbers import truthy
from tideline.functions.text import contains_any, tidy

# Patterns of funding text. Fixed values.
AMOUNT = r"(?i)\$(\d+(?:\.\d+)?)\s*(million|billion|m\b|b\b)"
ROUND = r"(?i)\b(seed|pre-seed|series [a-f]|series[a-f]|growth|bridge)\b"
VERB = "(?:" + "|".join(lex.DEAL_VERBS) + r")\b"
SUBJECT_THEN_VERB = r"(?im)^([A-Z][A-Za-z0-9\s&'.\-,]+?)\s+" + VERB
SUBJECT_ASIDE_VERB = r"(?i)^(?:Exclusive:\s*)?([A-Z][A-Za-z0-9\s&'.\-]+?)(?:,|:)\s.*?\b" + VERB
# A fixed value: the editorial openings of headlines.
EDITORIAL = r"(?i)^(?:Exclusive|Report|Reports|Breaking|Analysis|Update|Opinion):\s+"
BACKED = r"(?i)^[A-Z][A-Za-z0-9\s&'.\-,]+-backed\s+"
QUESTION = r"(?i)^(?:How|Why)\s+"
BULLET = (
    r"^([A-Z0-9][A-Za-z0-9\s&'.\-]+?)\s+\([^)]+\):\s+\$(\d+(?:\.\d+)?)\s*([KMB])\s+on\s+"
    r"([A-Za-z]+\s+\d{1,2},\s+\d{4})"
)

MIN_DEAL = 5_000_000
MAX_DEAL = 500_000_000


def without_editorial(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, EDITORIAL, ""))


def clean_company(name: Column) -> Column:
    """A company name without punctuation at the end and without editorial,
    '-backed' or question prefixes."""
    out = F.rtrim(tidy(name), F.lit(","))
    out = without_editorial(out)
    out = F.regexp_replace(out, BACKED, "")
    return F.trim(F.regexp_replace(out, QUESTION, ""))


def amount_in(text: Column) -> Column:
    """Dollar amount of the first '$n million|billion|m|b'; null without one."""
    number = F.regexp_extract(text, AMOUNT, 1).try_cast("double")
    unit = F.lower(F.regexp_extract(text, AMOUNT, 2))
    return F.when(unit.isin("million", "m"), number * 1_000_000.0).otherwise(number * 1_000_000_000.0)


def round_in(text: Column, default: Column) -> Column:
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(text, ROUND, 1)), F.lit("")), default)


def subject_of(head: Column) -> Column:
    """Company name in a tidied headline: what stands before the deal verb, or before
    an aside that holds it; '' without one."""
    subject = without_editorial(head)
    return clean_company(
        F.coalesce(
            F.nullif(F.regexp_extract(subject, SUBJECT_THEN_VERB, 1), F.lit("")),
            F.nullif(F.regexp_extract(subject, SUBJECT_ASIDE_VERB, 1), F.lit("")),
            F.lit(""),
        )
    )


def with_deal(df: DataFrame, title: Column, description: Column) -> DataFrame:
    """The rows whose headline tells of a deal, with ``company_name``,
    ``amount_usd`` and ``round_type``: amount, size gate and company name all fit.

    Cheap tests come first: rows without a dollar sign never meet a pattern, and
    names are only looked for where the amount fits. The two gates are 0-or-1-row
    generators: a filter would be pushed below the columns it tests, and every text
    clean-up would run again for each use."""
    given = F.coalesce(description, F.lit(""))
    rows = df.where(F.coalesce(title, F.lit("")).contains("$") | given.contains("$"))
    rows = rows.withColumn("_head", tidy(title)).withColumn("_full", F.concat_ws(" ", "_head", tidy(given)))
    rows = rows.withColumn("_amount", amount_in(F.col("_full")))
    sized = F.when(F.col("_amount").between(MIN_DEAL, MAX_DEAL), F.array(F.struct(F.col("_amount").alias("amount_usd"))))
    rows = rows.select("*", F.inline(sized)).withColumn("_name", subject_of(F.col("_head")))
    named = F.when(F.length("_name").between(2, 80), F.array(F.struct(F.col("_name").alias("company_name"))))
    rows = rows.select("*", F.inline(named)).withColumn("round_type", round_in(F.col("_full"), F.lit("unknown")))
    return rows.drop("_head", "_full", "_amount", "_name")


def labelled_block(text: Column, label: str, stops: tuple[str, ...]) -> Column:
    """The text after ``label`` up to the nearest stop label, tidied."""
    start = F.instr(text, label)
    tail = F.substr(text, start + F.lit(len(label)))
    ends = [F.nullif(F.instr(tail, stop), F.lit(0)) for stop in stops]
    end = F.least(*ends) if len(ends) > 1 else ends[0]
    block = F.when(end.isNull(), tail).otherwise(F.substr(tail, F.lit(1), end - 1))
    return F.when(start > 0, tidy(block)).otherwise(F.lit(""))


def parse_structured(funding_text: Column, default_round: Column, this_year: Column) -> Column:
    """struct(amount_usd, round_type, year) of a directory's funding line."""
    text = tidy(funding_text)
    amount = amount_in(text)
    kind = round_in(text, default_round)
    year = F.coalesce(F.regexp_extract(text, r"\b(20\d{2})\b", 1).try_cast("int"), this_year)
    return F.when(
        amount.isNotNull() | (kind != "unknown"),
        F.struct(amount.alias("amount_usd"), kind.alias("round_type"), year.alias("year")),
    )


def mid_year(year: Column) -> Column:
    """July 1 of the year, not before 2000."""
    return F.make_date(F.greatest(F.lit(2000), year), F.lit(7), F.lit(1)).cast("timestamp_ntz")


def parse_bullet(line: Column) -> Column:
    """struct(company_name, amount_usd, announced_at) of one roundup bullet."""
    number = F.regexp_extract(line, BULLET, 2).try_cast("double")
    unit = F.regexp_extract(line, BULLET, 3)
    amount = number * F.when(unit == "K", 1e3).when(unit == "M", 1e6).otherwise(1e9)
    return F.when(
        amount >= MIN_DEAL,
        F.struct(
            clean_company(F.regexp_extract(line, BULLET, 1)).alias("company_name"),
            amount.alias("amount_usd"),
            parse_instant(F.regexp_extract(line, BULLET, 4)).alias("announced_at"),
        ),
    )


def event_score(amount: Column, round_type: Column, context: Column) -> Column:
    """P16"""
    base = lookup(F.lower(round_type), lex.FUNDING_ROUND_BASE, F.lit(40.0))
    size = F.when(amount >= 50_000_000, 15.0).when(amount >= 20_000_000, 10.0).when(amount >= 10_000_000, 5.0)
    sector = F.when(contains_any(F.lower(context), lex.FUNDING_SECTOR_WORDS), 10.0)
    total = base + F.coalesce(size, F.lit(0.0)) + F.coalesce(sector, F.lit(0.0))
    return F.when(amount.isNull(), 30.0).otherwise(F.least(total, F.lit(95.0)))


def round_stage(round_type: Column) -> Column:
    """Round text to stage."""
    text = F.lower(round_type)
    return (
        F.when(text.contains("seed"), "seed")
        .when(text.contains("series a"), "series_a")
        .when(text.contains("series b"), "series_b")
        .when(text.contains("series c"), "series_c")
        .when(contains_any(text, ("series d", "growth")), "series_d_plus")
        .otherwise("unknown")
    )


def label_stage(label: Column) -> Column:
    """Portfolio-board funding label to stage."""
    text = F.lower(F.coalesce(label, F.lit("")))
    return (
        F.when(text.contains("seed"), "seed")
        .when(text.contains("series a"), "series_a")
        .when(text.contains("series b"), "series_b")
        .when(text.contains("series c"), "series_c")
        .when(contains_any(text, ("series d", "series e", "series f", "growth", "late")), "series_d_plus")
        .when(contains_any(text, ("public", "ipo")), "public")
        .otherwise("unknown")
    )


def headline(amount: Column, round_type: Column) -> Column:
    """P18"""
    kind = F.replace(F.initcap(round_type), F.lit("Pre-seed"), F.lit("Pre-Seed"))
    money = F.when(amount >= 1e9, F.format_string("$%.1fB", F.rint(amount / 1e8) / 10)).otherwise(
        F.format_string("$%.0fM", F.rint(amount / 1e6))
    )
    return F.when(
        truthy(amount), F.concat(F.lit("Raised "), money, F.lit(" "), kind, F.lit(" — engineering hiring wave expected"))
    ).otherwise(F.concat(F.lit("Funding event ("), kind, F.lit(") — engineering hiring expected")))


def parse_money(text: Column) -> Column:
    """P19: '$1,250,000.50' to a double; null for na, n/a, none and non-numbers."""
    cleaned = F.regexp_replace(F.trim(text), "[$,]", "")
    return F.when(~F.lower(cleaned).isin("na", "n/a", "none"), cleaned.try_cast("double"))


def hq_city(text: Column) -> Column:
    """P19"""
    clean = tidy(text)
    return F.when(F.lower(clean).startswith("remote"), "Remote").otherwise(F.trim(F.split_part(clean, F.lit(","), F.lit(1))))
