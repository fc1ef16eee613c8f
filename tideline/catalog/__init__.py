"""All registered queries, one module per area."""

from tideline.catalog.registry import QUERIES, Query  # noqa: F401
