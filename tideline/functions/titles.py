"""Classification of job titles, descriptions and locations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import lexicons as lex
from tideline.functions.text import contains_any, found_in


def first_match(text: Column, rules: Sequence[tuple[str, Sequence[str]]], default: str) -> Column:
    """Value of the first rule with a word in ``text``."""
    chain = None
    for value, words in rules:
        hit = contains_any(text, words)
        chain = F.when(hit, F.lit(value)) if chain is None else chain.when(hit, F.lit(value))
    return chain.otherwise(F.lit(default))


def role_type(title: Column) -> Column:
    return first_match(F.lower(title), lex.ROLE_TYPE_WORDS, "unknown")


def listing_role_type(title: Column, listed: Column) -> Column:
    """Title first, the listing's own type when the title says nothing."""
    own = role_type(title)
    key = F.lower(F.trim(listed))
    mapped = F.lit(None).cast("string")
    for name, value in lex.LISTING_ROLE_TYPE_MAP.items():
        mapped = F.when(key == name, F.lit(value)).otherwise(mapped)
    return F.when(own == "unknown", F.coalesce(mapped, F.lit("unknown"))).otherwise(own)


def seniority(title: Column) -> Column:
    lowered = F.lower(title)
    opens_with_sr = lowered.startswith("sr ")
    chain = None
    for level, words in lex.SENIORITY_WORDS:
        hit = contains_any(lowered, words)
        if level == "senior":
            hit = hit | opens_with_sr
        chain = F.when(hit, F.lit(level)) if chain is None else chain.when(hit, F.lit(level))
    return chain.otherwise(F.lit("mid"))


def stack_in(lowered: Column, whole_word: bool = False) -> Column:
    """P6 on text that is already lower-cased."""
    return F.struct(
        found_in(lowered, lex.LANGUAGES, whole_word).alias("languages"),
        found_in(lowered, lex.FRAMEWORKS, whole_word).alias("frameworks"),
        found_in(lowered, lex.INFRA_TOOLS, whole_word).alias("infra"),
    )


def tech_stack(text: Column, whole_word: bool = False) -> Column:
    """Struct of the three vocabularies' members found in ``text``. For long texts
    use `with_tech_stack`, which lower-cases once and not once per word."""
    return stack_in(F.lower(F.coalesce(text, F.lit(""))), whole_word)


def with_tech_stack(df: DataFrame, text: Column, name: str = "tech_stack", whole_word: bool = False) -> DataFrame:
    lowered = df.withColumn("_low", F.lower(F.coalesce(text, F.lit(""))))
    return lowered.withColumn(name, stack_in(F.col("_low"), whole_word)).drop("_low")


def is_target(title: Column) -> Column:
    return contains_any(F.lower(F.coalesce(title, F.lit(""))), lex.TARGET_TITLE_WORDS)


def is_listing_target(title: Column, listed: Column, employment: Column) -> Column:
    """P7, accelerator listing: interns out, more titles, or a listed type."""
    intern = F.lower(F.trim(F.coalesce(employment, F.lit("")))).isin("intern", "internship")
    more = contains_any(F.lower(F.coalesce(title, F.lit(""))), lex.LISTING_TITLE_WORDS)
    by_type = F.lower(F.trim(F.coalesce(listed, F.lit("")))).isin(*lex.LISTING_ROLE_TYPES)
    return ~intern & (is_target(title) | more | by_type)


def remote_flags(source: str, location: Column, declared: Column | None = None) -> tuple[Column, Column]:
    """(is_remote, is_remote_us) under the rule of ``source``."""
    place = F.lower(F.coalesce(location, F.lit("")))
    if source == "portfolio":
        remote = F.coalesce(declared, F.lit(False)) | place.contains("remote")
        return remote, remote
    remote = contains_any(place, lex.REMOTE_WORDS[source])
    if source == "greenhouse":
        return remote, remote & (place.contains("us") | (place == "") | place.contains("remote"))
    if source == "ashby":
        remote = remote | F.coalesce(declared, F.lit(False))
        return remote, (remote & contains_any(place, lex.US_WORDS)) | (remote & (place == ""))
    if source == "listing":
        return remote, place.contains("remote") & contains_any(place, lex.US_WORDS[:3])
    return remote, remote


def role_focus(text: Column) -> Column:
    """One family from free text."""
    return first_match(F.lower(text), lex.FAMILY_WORDS, "backend")


def role_families(text: Column) -> Column:
    """All families from free text, backend when there is none."""
    lowered = F.lower(text)
    hits = F.array_compact(
        F.array(*[F.when(contains_any(lowered, words), F.lit(name)) for name, words in lex.FAMILY_WORDS])
    )
    return F.when(F.size(hits) == 0, F.array(F.lit("backend"))).otherwise(hits)


def freshness_band(days_open: Column) -> Column:
    """P26"""
    return F.when(days_open <= 2, "fresh").when(days_open <= 10, "open").otherwise("competitive")
