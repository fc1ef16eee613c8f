"""The registry of tracked companies, a small table the user supplies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions import lexicons as lex
from tideline.functions.text import board_token
from tideline.operators.mentions import aliases_of
from tideline.operators.ranking import first_wins_two_keys, union_first_wins

REGISTRY = (
    "name string, website string, career_page_url string, greenhouse_token string, ashby_slug string, github_org string,"
    "aliases array<string>"
)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """Registry from JSON lines with the columns of `REGISTRY`."""
    return spark.read.schema(REGISTRY).json(path)


def tracked(registry: DataFrame, column: str) -> DataFrame:
    """Companies with a value in ``column`` (a board token, a page, an organisation)."""
    return registry.where(F.coalesce(column, F.lit("")) != "").select("name", F.col(column).alias("value"))


def discovery_seed(registry: DataFrame) -> DataFrame:
    """Companies with a website or a career page."""
    known = (F.coalesce("website", F.lit("")) != "") | (F.coalesce("career_page_url", F.lit("")) != "")
    return registry.where(known).select("name", "website", "career_page_url")


def registry_aliases(registry: DataFrame) -> DataFrame:
    return aliases_of(registry.select("name", "aliases"))


BOARD_COLUMNS = {"greenhouse": "greenhouse_token", "ashby": "ashby_slug"}


def board_targets(registry: DataFrame, companies: DataFrame, board: str, discovered: DataFrame | None = None) -> DataFrame:
    """Boards to read (name, token): tracked, then stored career pages that
    carry a token, then discovered (name, token); the first of a token wins."""
    first = tracked(registry, BOARD_COLUMNS[board]).select("name", F.lower(F.trim("value")).alias("token"))
    token = board_token(F.col("career_page_url"), lex.BOARD_TOKEN_PATTERNS[board], board == "greenhouse")
    stored = companies.select("name", F.lower(token).alias("token")).where("token IS NOT NULL")
    sources = [first, stored] + ([discovered.select("name", F.lower(F.trim("token")).alias("token"))] if discovered is not None else [])
    return union_first_wins([s.where("token <> ''") for s in sources], ["token"], "name")


def page_targets(pages: DataFrame) -> DataFrame:
    """Pages to crawl (name, url, seq), each company and each address once."""
    usable = pages.where("trim(name) <> '' AND trim(url) <> ''").withColumns(
        {"_name": F.lower(F.trim("name")), "url": F.trim("url")}
    )
    return first_wins_two_keys(usable, "_name", "url", "seq").drop("_name")
