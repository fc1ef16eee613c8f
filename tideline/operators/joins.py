"""Joins that attach names and resolve companies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.text import company_slug


def with_company_name(df: DataFrame, companies: DataFrame) -> DataFrame:
    """The company's name, '' when the company is gone. Whether the companies
    are broadcast is left to Spark, which knows their size."""
    names = companies.select("company_id", F.col("name").alias("company_name"))
    return df.join(names, "company_id", "left").withColumn("company_name", F.coalesce("company_name", F.lit("")))


def company_key(name) -> F.Column:
    """Repeatable surrogate id of a company: first 32 hex digits over its slug."""
    return F.substring(F.sha2(company_slug(name), 256), 1, 32)


def missing_companies(staged: DataFrame, companies: DataFrame) -> DataFrame:
    """Minimal company rows for names (column ``company_name``) that no
    company carries in any case. Distinct names are taken before the join, so a
    name on a third of the rows crosses the network once per task."""
    names = staged.select("company_name").where(F.trim("company_name") != "").distinct()
    unknown = names.withColumn("_key", F.lower("company_name")).join(
        companies.select(F.lower("name").alias("_key")), "_key", "left_anti"
    )
    return unknown.groupBy(company_slug(F.col("company_name")).alias("slug")).agg(F.min("company_name").alias("name"))


def resolve_company(staged: DataFrame, companies: DataFrame) -> DataFrame:
    """Company ids for staged rows by name in any case, else by slug. Run after
    `missing_companies` has been merged, so every named row resolves. Names are
    resolved once per distinct name."""
    by_name = companies.groupBy(F.lower("name").alias("_name")).agg(F.min("company_id").alias("by_name"))
    by_slug = companies.groupBy("slug").agg(F.min("company_id").alias("by_slug"))
    ids = (
        staged.select("company_name").distinct()
        .withColumns({"_name": F.lower("company_name"), "slug": company_slug(F.col("company_name"))})
        .join(by_name, "_name", "left")
        .join(by_slug, "slug", "left")
        .select("company_name", F.coalesce("by_name", "by_slug").alias("company_id"))
        .where("company_id IS NOT NULL")
    )
    return staged.drop("company_id").join(ids, "company_name")


def with_children(companies: DataFrame, children: dict[str, DataFrame]) -> DataFrame:
    """Each child table nested as an array of structs ordered by its first
    column after ``company_id``. Children must be cut to a fixed number per
    company first (W2), so that no array grows with the data."""
    out = companies
    for name, child in children.items():
        fields = [c for c in child.columns if c != "company_id"]
        nested = child.groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias(name))
        out = out.join(nested, "company_id", "left").withColumn(
            name, F.coalesce(name, F.array().cast(nested.schema[name].dataType))
        )
    return out
