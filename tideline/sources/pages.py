"""Career pages to job lists, snapshots and signals."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import lexicons as lex, titles
from tideline.functions.clock import instant
from tideline.functions.text import absolute_url, contains_any, page_hash
from tideline.operators import merge
from tideline.operators.filters import looks_like_career_page
from tideline.operators.ranking import first_wins, top_k
from tideline.schemas import Staged
from tideline.session import cut_lineage
from tideline.sources.elements import page_elements

JSON_LD = (
    "`@type` string, `@graph` string, title string, url string, jobLocation string, description string"
)


def career_links(pages: DataFrame) -> DataFrame:
    """P10: (page_id, url) of links that look like career pages; ``pages`` holds
    page_id, url and html. A page that itself looks like one is its own link."""
    links = page_elements(pages, tags=("a",)).where("href IS NOT NULL AND trim(href) <> ''")
    found = links.join(pages.select("page_id", F.col("url").alias("base")), "page_id").withColumn(
        "url", absolute_url(F.col("base"), F.trim("href"))
    )
    hinted = contains_any(F.lower("text"), lex.CAREER_ANCHOR_WORDS) | contains_any(F.lower("url"), lex.CAREER_URL_WORDS)
    own = pages.where(looks_like_career_page(F.col("html"), F.col("url"))).select("page_id", "url", F.lit(-1).alias("seq"))
    both = own.unionByName(found.where(hinted).select("page_id", "url", "seq"))
    return both.groupBy("page_id", "url").agg(F.min("seq").alias("seq"))


def _order(part: int, *places: str) -> Column:
    """Where a job stands among those of its strategy: its part, then places on the page."""
    padded = [F.col(p).cast("bigint") for p in places] + [F.lit(0).cast("bigint")] * (3 - len(places))
    return F.struct(F.lit(part).alias("part"), *[p.alias(n) for p, n in zip(padded, ("seq", "n", "m"))]).alias("order")


def _json_ld_jobs(elements: DataFrame) -> DataFrame:
    scripts = elements.where("tag = 'script'").select("page_id", "seq", F.trim("text").alias("text"))
    as_list = F.coalesce(
        F.when(F.col("text").startswith("["), F.from_json("text", "array<string>")), F.array("text")
    )
    items = scripts.select("page_id", "seq", F.posexplode(as_list).alias("n", "item"))
    graph = F.get_json_object("item", "$['@graph']")
    inner = F.when(graph.isNotNull() & F.col("item").startswith("{"), F.from_json(graph, "array<string>"))
    rows = items.select("page_id", "seq", "n", F.posexplode(F.coalesce(inner, F.array("item"))).alias("m", "item"))
    job = F.from_json("item", JSON_LD)
    rows = rows.withColumn("job", job).where(F.col("job.`@type`") == "JobPosting")
    return rows.select(
        "page_id", F.lit(1).alias("priority"), _order(0, "seq", "n", "m"),
        F.coalesce("job.title", F.lit("")).alias("title"),
        F.col("job.url").alias("href"),
        F.coalesce(F.get_json_object("job.jobLocation", "$.address.addressLocality"), F.lit("")).alias("location"),
        F.coalesce("job.description", F.lit("")).alias("description"),
    )


def _boxed_jobs(elements: DataFrame) -> DataFrame:
    """Jobs in known board markup: one per box, title, link and place from its parts."""
    boxed = elements.where("box IS NOT NULL AND box_kind <> 'list'")
    first = lambda value, condition: F.min_by(F.when(condition, value), F.when(condition, F.col("seq")))
    kind, tag, text = F.col("box_kind"), F.col("tag"), F.col("text")
    is_title = (
        ((kind == "opening") & (tag == "a"))
        | ((kind == "posting") & (F.col("box_part") == "title") & (tag.isin("h5") | F.col("classes").contains("posting-name")))
        | ((kind == "ashby") & (F.col("classes").contains("ashby-job-posting-brief-title") | tag.isin("h3", "h4")))
    )
    jobs = boxed.groupBy("page_id", "box").agg(
        first(text, is_title & (text != "")).alias("title"),
        first(F.col("href"), (tag == "a") & F.col("href").isNotNull()).alias("href"),
        first(text, F.col("box_part") == "location").alias("location"),
    )
    return jobs.where("title IS NOT NULL").select(
        "page_id", F.lit(2).alias("priority"), _order(0, "box"), "title", "href",
        F.coalesce("location", F.lit("")).alias("location"), F.lit("").alias("description"),
    )


def _semantic_jobs(elements: DataFrame) -> DataFrame:
    listed = (
        elements.where("box_kind = 'list' AND tag = 'a'")
        .groupBy("page_id", "box")
        .agg(F.min_by(F.struct("text", "href"), "seq").alias("a"))
        .where(F.length("a.text") > 5)
        .select("page_id", F.lit(3).alias("priority"), _order(0, "box"), F.col("a.text").alias("title"), F.col("a.href").alias("href"))
    )
    length = F.length("text")
    headed = elements.where(F.col("tag").isin("h3", "h4", "h5") & titles.is_target(F.col("text")) & (length > 10) & (length < 100)).select(
        "page_id", F.lit(3).alias("priority"), _order(1, "seq"), F.col("text").alias("title"), F.col("next_href").alias("href")
    )
    return listed.unionByName(headed).withColumns({"location": F.lit(""), "description": F.lit("")})


def _linked_jobs(elements: DataFrame, link_cap: int | None) -> DataFrame:
    links = elements.where(
        (F.col("tag") == "a")
        & F.col("href").isNotNull()
        & F.length("text").between(10, 100)
        & titles.is_target(F.col("text"))
        & contains_any(F.lower("href"), lex.JOB_HREF_WORDS)
    )
    once = first_wins(links, ["page_id", "text"], ["seq"])
    if link_cap is not None:
        once = top_k(once, ["page_id"], [F.asc("seq")], link_cap)
    return once.select(
        "page_id", F.lit(4).alias("priority"), _order(0, "seq"), F.col("text").alias("title"), "href",
        F.lit("").alias("location"), F.lit("").alias("description"),
    )


def page_jobs(pages: DataFrame, link_cap: int | None = None) -> DataFrame:
    """Jobs per page (page_id, url, html) from the best strategy that finds any:
    structured data, board markup, job lists and headings, links. ``pos`` numbers the
    jobs of a page."""
    # Parsed once; the strategies read the stored elements, and none of them whole texts.
    elements = cut_lineage(page_elements(pages).where("tag <> '#lines'").drop("block", "parent_text"))
    found = reduce(DataFrame.unionByName, [_json_ld_jobs(elements), _boxed_jobs(elements), _semantic_jobs(elements), _linked_jobs(elements, link_cap)])
    # The best strategy comes first, so its jobs are numbered from 1 and known by the first row.
    ranked = Window.partitionBy("page_id").orderBy("priority", "order", "title", "href")
    base = pages.select("page_id", F.col("url").alias("base"))
    return (
        found.withColumns({"pos": F.row_number().over(ranked), "best": F.first("priority").over(ranked)})
        .where("priority = best")
        .join(base, "page_id")
        .select("page_id", "pos", "title", absolute_url(F.col("base"), F.col("href")).alias("url"), "location", "description")
    )


def snapshots(pages: DataFrame, jobs: DataFrame) -> DataFrame:
    """Job rows for `merge.snapshot_diff`; ``pages`` also carries company_name. A page
    without jobs keeps one row with a null title."""
    head = pages.select("page_id", F.col("company_name").alias("company_id"), page_hash(F.col("html")).alias("page_hash"))
    return head.join(jobs, "page_id", "left")


def career_pages(pages: DataFrame, previous: DataFrame | None, as_of: str) -> Staged:
    """Crawled pages (page_id, company_name, url, html) to staging frames: a role per
    target job, a signal per job added or removed since ``previous`` (rows of
    `snapshots`)."""
    jobs = page_jobs(pages)
    # Both the diff and the roles read the parsed jobs.
    rows = snapshots(pages, jobs)
    now = instant(as_of)
    named = rows.join(pages.select("page_id", F.col("url").alias("page_url")), "page_id")
    companies = pages.select(
        F.col("company_name").alias("name"), F.col("url").alias("career_page_url"),
        F.struct(F.col("page_id").cast("bigint").alias("landed"), F.lit(-1).alias("pos")).alias("seq"),
    )
    seq: Column = F.struct(F.col("page_id").cast("bigint").alias("landed"), F.col("pos").cast("int").alias("pos"))
    target = named.where(F.col("title").isNotNull() & titles.is_target(F.col("title")))
    remote, remote_us = titles.remote_flags("career_page", F.col("location"))
    roles = target.select(
        F.col("company_id").alias("company_name"), "title", "url", F.lit("career_page").alias("source"),
        F.col("description").alias("description_raw"), titles.role_type(F.col("title")).alias("role_type"),
        titles.seniority(F.col("title")).alias("seniority"), remote.alias("is_remote"), remote_us.alias("is_remote_us"), "location",
        seq.alias("seq"),
    )
    if previous is None:
        return Staged.of("career_page", companies, None, roles)
    diff = merge.snapshot_diff(previous, rows).where(titles.is_target(F.col("title")) & F.col("status").isin("added", "removed"))
    added = F.col("status") == "added"
    pages_of = pages.groupBy("company_name").agg(F.min("url").alias("page_url"))
    signals = diff.withColumnRenamed("company_id", "company_name").join(pages_of, "company_name").select(
        "company_name",
        F.lit("career_page").alias("type"),
        F.when(added, F.concat("title", F.lit(" — direct listing, not yet syndicated to job boards"))).otherwise(
            F.concat("title", F.lit(" removed — role filled or paused"))
        ).alias("headline"),
        F.when(added, F.concat(F.lit("New on "), "page_url", F.lit(". Location: "), F.coalesce(F.nullif("location", F.lit("")), F.lit("not specified"))))
        .otherwise(F.concat(F.lit("No longer on "), "page_url")).alias("detail"),
        F.when(added, F.coalesce(F.nullif("url", F.lit("")), F.col("page_url"))).otherwise(F.col("page_url")).alias("source_url"),
        now.alias("signal_date"),
        F.when(added, lex.SOURCE_SCORES["page_added"]).otherwise(lex.SOURCE_SCORES["page_removed"]).alias("score"),
        F.struct(F.lit(0).cast("bigint").alias("landed"), F.hash("slug").alias("pos")).alias("seq"),
    )
    return Staged.of("career_page", companies, signals, roles)
