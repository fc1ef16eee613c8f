"""Imports every query module; each registers its queries."""

from tideline.catalog import console, crawl, lists, merges, models, rest, rollups, scoring, sources  # noqa: F401
