"""Funding tables, news, API rounds and pages to staging frames."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions import funding as fund, lexicons as lex
from tideline.functions.clock import instant, parse_instant, shift
from tideline.functions.text import absolute_url, contains_any, nonblank, tidy
from tideline.operators.ranking import first_wins
from tideline.schemas import Staged
from tideline.sources.elements import page_elements
from tideline.sources.feeds import rss_items

# Offering-table columns, by purpose; header names are compared without case and
# punctuation. Fixed values.
OFFERING_COLUMNS = {
    "company_name": ("primaryIssuerEntityName", "issuerName", "entityName", "entity_name", "nameOfIssuer"),
    "filed": ("dateOfFirstSale", "dateOfFirstSaleValue", "filingDate", "submissionDate"),
    "offered": ("totalOfferingAmount", "totalOfferingAmountValue", "offeringAmount"),
    "sold": ("totalAmountSold", "totalAmountSoldValue", "amountSold"),
    "industry": ("industryGroupType", "industry_group_type"),
    "industry_text": ("industryGroupDescription", "industry_group_description"),
    "size": ("issuerSizeRevenueRange", "revenueRange"),
}


def _bare(name: str) -> str:
    return re.sub(r"[^a-z0-9]", "", name.lower())


def _pick(df: DataFrame, candidates: tuple[str, ...]) -> Column:
    """First non-blank of the candidate columns that the table has."""
    have = {_bare(c): c for c in df.columns}
    found = [nonblank(F.col(f"`{have[_bare(c)]}`")) for c in candidates if _bare(c) in have]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def choose_offering_table(tables: list[DataFrame]) -> DataFrame:
    """The first table with an issuer and an amount column, else the largest."""
    for df in tables:
        names = [_bare(c) for c in df.columns]
        if any("issuer" in n or "entity" in n for n in names) and any("amount" in n for n in names):
            return df
    return max(tables, key=lambda df: df.count())


def read_offering_tables(spark, paths: list[str]) -> list[DataFrame]:
    """CSV or TSV files with free headers, all columns as text."""
    out = []
    for path in paths:
        first = spark.read.text(path).first()
        sep = "\t" if first and "\t" in first[0] else ","
        out.append(spark.read.csv(path, sep=sep, header=True, inferSchema=False))
    return out


def offerings(table: DataFrame, as_of: str, source_url: str = "", max_age_days: int = 120, min_amount: float = 5e6, min_score: float = 35.0) -> Staged:
    """Recent private offerings of a size that matters."""
    now = instant(as_of)
    picked = table.select(*[_pick(table, names).alias(c) for c, names in OFFERING_COLUMNS.items()])
    sold, offered = fund.parse_money(F.col("sold")), fund.parse_money(F.col("offered"))
    amount = F.when(sold.isNotNull() & (sold != 0), sold).otherwise(offered)
    context = F.concat_ws(" ", "company_name", F.coalesce("industry", F.lit("")), F.coalesce("industry_text", F.lit("")), F.coalesce("size", F.lit("")))
    filed = parse_instant(F.col("filed"))
    rows = (
        picked.withColumns({"amount_usd": amount, "sold_usd": sold, "offered_usd": offered, "filed_at": filed, "context": context})
        .where(F.col("company_name").isNotNull())
        .where(F.col("filed_at").isNull() | (F.col("filed_at") >= shift(now, days=-max_age_days)))
        .where(F.col("amount_usd") >= min_amount)
        .withColumn("score", fund.event_score(F.col("amount_usd"), F.lit("private offering"), F.col("context")))
        .where(F.col("score") >= min_score)
        # Offering tables have no order; the filing date and a row hash stand in.
        .withColumn("seq", F.struct(F.xxhash64("company_name", "filed", "offered", "sold").alias("landed"), F.lit(0).alias("pos")))
    )
    at = F.coalesce("filed_at", now)
    part_sold = (F.col("sold_usd") != 0) & (F.col("offered_usd") != 0) & (F.col("sold_usd") != F.col("offered_usd"))
    signals = rows.select(
        "company_name", F.lit("funding").alias("type"), fund.headline(F.col("amount_usd"), F.lit("private offering")).alias("headline"),
        F.when(
            part_sold, F.format_string("Offering table: $%.0fM sold of $%.0fM offered.", F.rint(F.col("sold_usd") / 1e6), F.rint(F.col("offered_usd") / 1e6))
        ).otherwise(F.lit("Offering table: private offering.")).alias("detail"),
        F.lit(source_url).alias("source_url"), at.alias("signal_date"), "score", F.col("amount_usd").alias("funding_amount_usd"),
        F.lit("private offering").alias("funding_round"), "seq",
    )
    companies = first_wins(rows, [F.lower("company_name")], ["seq"]).select(
        F.col("company_name").alias("name"), F.lit("unknown").alias("funding_stage"), F.col("amount_usd").alias("funding_amount_usd"),
        at.alias("last_funding_date"), F.coalesce("industry_text", "industry").alias("description"), "seq",
    )
    return Staged.of("funding", companies, signals)


def staged_events(events: DataFrame, source: str = "funding") -> Staged:
    """Parsed funding events (company_name, amount_usd, round_type, announced_at,
    source_url, detail, score, description, hq_city, seq) to staging frames.

    W4: of events with the same company, round, whole millions and day the first
    counts, and a company is described by its first event."""
    cleaned = events.withColumn("company_name", fund.clean_company(F.col("company_name"))).where("company_name <> ''")
    millions = F.floor(F.coalesce("amount_usd", F.lit(0.0)) / 1e6)
    kind = F.coalesce(nonblank(F.lower("round_type")), F.lit("unknown"))
    once = first_wins(cleaned, [F.lower("company_name"), kind, millions, F.to_date("announced_at")], ["seq"])
    companies = first_wins(once, [F.lower("company_name")], ["seq"]).select(
        F.col("company_name").alias("name"), "description", fund.round_stage(F.col("round_type")).alias("funding_stage"),
        F.col("amount_usd").alias("funding_amount_usd"), F.col("announced_at").alias("last_funding_date"), "hq_city", "seq",
    )
    signals = once.select(
        "company_name", F.lit("funding").alias("type"), fund.headline(F.col("amount_usd"), F.col("round_type")).alias("headline"), "detail",
        "source_url", F.col("announced_at").alias("signal_date"), "score", F.col("amount_usd").alias("funding_amount_usd"),
        F.col("round_type").alias("funding_round"), "seq",
    )
    return Staged.of(source, companies, signals)


EVENT_COLUMNS = ("company_name", "amount_usd", "round_type", "announced_at", "source_url", "detail", "score", "description", "hq_city", "seq")


def _events(df: DataFrame) -> DataFrame:
    for c in ("description", "hq_city"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(""))
    return df.select(*EVENT_COLUMNS)


def headline_events(titles: DataFrame, min_score: float | None = None) -> DataFrame:
    """P14, P16 on rows (title, description, context, announced_at, source_url,
    detail, seq): the events whose headline parses, gated by score."""
    parsed = fund.with_deal(titles, F.col("title"), F.col("description"))
    scored = parsed.select(
        "company_name", "amount_usd", "round_type", "announced_at", "source_url", "detail",
        fund.event_score(F.col("amount_usd"), F.col("round_type"), F.col("context")).alias("score"), "seq",
    )
    if min_score is not None:
        scored = scored.where(F.col("score") >= min_score)
    return _events(scored)


def news_feed(landed: DataFrame, as_of: str, first_items: int | None = None, max_age_days: int = 14, min_score: float = 30.0) -> DataFrame:
    """Events of a news feed; old items and items without a funding word are out.
    Undated items count as new."""
    now = instant(as_of)
    items = rss_items(landed, first_items)
    text = F.lower(F.concat_ws(" ", "title", "summary_raw"))
    fresh = items.where(contains_any(text, lex.FUNDING_NEWS_WORDS)).where(
        # the date, worked out in the filter, once
        F.coalesce("published_at", now) >= shift(now, days=-max_age_days)
    )
    rows = fresh.select(
        "title", F.col("summary_raw").alias("description"), F.concat("title", "summary_raw").alias("context"),
        F.coalesce("published_at", now).alias("announced_at"), F.col("link").alias("source_url"), F.lit("Source: news feed.").alias("detail"), "seq",
    )
    return headline_events(rows, min_score)


def brief_feed(landed: DataFrame, as_of: str, first_items: int | None = None, min_score: float = 35.0) -> DataFrame:
    """S6, second feed: title words only, every item counts as new."""
    items = rss_items(landed, first_items).where(contains_any(F.lower("title"), lex.FUNDING_BRIEF_NEWS_WORDS))
    rows = items.select(
        "title", F.col("summary_raw").alias("description"), F.concat("title", "summary_raw").alias("context"),
        instant(as_of).alias("announced_at"), F.col("link").alias("source_url"), F.lit("Source: brief feed.").alias("detail"), "seq",
    )
    return headline_events(rows, min_score)


ROUNDS_BODY = (
    "entities array<struct<properties:struct<funded_organization_identifier:struct<value:string>,"
    "money_raised:struct<value_usd:double>,investment_type:string,announced_on:string>>>"
)


def api_rounds(landed: DataFrame, as_of: str) -> DataFrame:
    """S7"""
    rows = landed.withColumn("body", F.from_json("body", ROUNDS_BODY)).select("landed", F.posexplode("body.entities").alias("pos", "e"))
    p = "e.properties."
    rows = rows.select(
        F.col(p + "funded_organization_identifier.value").alias("company_name"),
        F.col(p + "money_raised.value_usd").alias("amount_usd"),
        F.coalesce(p + "investment_type", F.lit("")).alias("round_type"),
        F.coalesce(parse_instant(F.col(p + "announced_on")), instant(as_of)).alias("announced_at"),
        F.lit("").alias("source_url"), F.lit("Source: rounds API.").alias("detail"),
        F.struct(F.col("landed").cast("bigint").alias("landed"), F.col("pos")).alias("seq"),
    ).where(F.coalesce("company_name", F.lit("")) != "")
    return _events(rows.withColumn("score", fund.event_score(F.col("amount_usd"), F.col("round_type"), F.col("company_name"))))


def _page_seq() -> Column:
    return F.struct(F.col("page_id").cast("bigint").alias("landed"), F.col("seq").alias("pos"))


def directory_pages(pages: DataFrame, as_of: str) -> DataFrame:
    """Company directories; ``pages`` (page_id, url, html, default_round)."""
    blocks = page_elements(pages, tags=("h3",)).join(pages.select("page_id", "url", "default_round"), "page_id")
    name = fund.clean_company(F.col("text"))
    blocks = blocks.select(
        name.alias("company_name"), "block", "url", "default_round", _page_seq().alias("seq"),
        fund.labelled_block(F.col("block"), "Funding:", ("Take action:",)).alias("funding_text"),
        fund.labelled_block(F.col("block"), "What they do:", ("Quick facts:", "Funding:")).alias("description"),
        fund.labelled_block(F.col("block"), "HQ:", ("Funding:", "Take action:", "Founded:")).alias("hq_text"),
    )
    low = F.lower("company_name")
    usable = blocks.where((F.col("company_name") != "") & ~low.startswith("get newly funded") & ~low.startswith("filter") & (F.col("funding_text") != ""))
    deal = fund.parse_structured(F.col("funding_text"), F.col("default_round"), F.year(instant(as_of)))
    parsed = usable.withColumn("deal", deal).where("deal IS NOT NULL").select("*", "deal.*")
    context = F.concat_ws(" ", "company_name", "description", "funding_text", "hq_text")
    return _events(
        parsed.select(
            "company_name", "amount_usd", "round_type", fund.mid_year(F.col("year")).alias("announced_at"), F.col("url").alias("source_url"),
            F.concat(F.lit("Source: startup directory. "), F.coalesce(nonblank(F.col("description")), F.lit("Recently funded."))).alias("detail"),
            fund.event_score(F.col("amount_usd"), F.col("round_type"), context).alias("score"), "description", fund.hq_city(F.col("hq_text")).alias("hq_city"), "seq",
        )
    )


def roundup_pages(pages: DataFrame, as_of: str) -> DataFrame:
    """Deal roundups with labelled paragraphs under h2/h3 headings."""
    heads = page_elements(pages, tags=("h2", "h3")).join(pages.select("page_id", "url"), "page_id")
    title = tidy(F.col("text"))
    heads = heads.withColumn("title", title).where(contains_any(F.lower("title"), lex.FUNDING_ROUNDUP_WORDS))
    parsed = fund.with_deal(heads, F.col("title"), F.lit(""))
    block = F.coalesce("block", F.lit(""))
    named = F.nullif(F.regexp_extract(block, r"Recipient Company:\s*([^\n(]+)", 1), F.lit(""))
    details = fund.labelled_block(block, "Details:", ("Reference:", "When:", "Recipient Company:"))
    return _events(
        parsed.select(
            F.coalesce(F.nullif(fund.clean_company(named), F.lit("")), F.col("company_name")).alias("company_name"), "amount_usd", "round_type",
            F.coalesce(parse_instant(F.regexp_extract(block, r"When:\s*([A-Za-z]+\s+\d{1,2},\s+\d{4})", 1)), instant(as_of)).alias("announced_at"),
            F.col("url").alias("source_url"),
            F.concat(F.lit("Source: funding roundup. "), F.coalesce(nonblank(details), F.col("title"))).alias("detail"),
            fund.event_score(F.col("amount_usd"), F.col("round_type"), F.concat_ws(" ", "title", block)).alias("score"),
            _page_seq().alias("seq"),
        )
    )


DATE_IN_TEXT = r"([A-Z][a-z]+ \d{1,2}, \d{4}|\d{4}-\d{2}-\d{2}|\d{1,2} [A-Z][a-z]+ \d{4})"


def headline_pages(pages: DataFrame, as_of: str) -> DataFrame:
    """Funding headlines among a page's links; the first link of a title counts."""
    links = page_elements(pages, tags=("a",), parents=True).where("href IS NOT NULL").join(pages.select("page_id", "url"), "page_id")
    links = links.withColumn("title", tidy(F.col("text"))).where(
        (F.length("title") >= 20) & contains_any(F.lower("title"), lex.FUNDING_ANCHOR_WORDS)
    )
    # Only titles that parse take part in the first-wins rule.
    parsing = fund.with_deal(links, F.col("title"), F.lit("")).drop("company_name", "amount_usd", "round_type")
    once = first_wins(parsing, ["page_id", F.lower("title")], ["seq"])
    around = tidy(F.col("parent_text"))
    rows = once.select(
        "title", F.lit("").alias("description"), around.alias("context"),
        F.coalesce(parse_instant(F.regexp_extract(around, DATE_IN_TEXT, 1)), instant(as_of)).alias("announced_at"),
        absolute_url(F.col("url"), F.col("href")).alias("source_url"), F.concat(F.lit("Source: headline page. "), "title").alias("detail"),
        _page_seq().alias("seq"),
    )
    return headline_events(rows)


def bullet_pages(pages: DataFrame, as_of: str) -> DataFrame:
    """Bullet lines of the section on exceptionally large rounds; ``pages``
    (page_id, url, html, default_round)."""
    lines = page_elements(pages, tags=("#lines",)).select("page_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.withColumn("line", F.trim(F.col("line"), F.lit(" *\t")))
    low = F.lower("line")
    # The section starts after its first opening line and ends at the first closing
    # line after that: two small aggregates instead of a running state.
    start = lines.where(low.contains("exceptionally large")).groupBy("page_id").agg(F.min("pos").alias("start"))
    bounded = lines.join(start, "page_id").where(F.col("pos") > F.col("start"))
    end = bounded.where(low.contains("exceptionally small")).groupBy("page_id").agg(F.min("pos").alias("end"))
    inside = bounded.join(end, "page_id", "left").where(F.col("end").isNull() | (F.col("pos") < F.col("end")))
    inside = inside.where(~low.contains("exceptionally large"))
    parsed = inside.withColumn("deal", fund.parse_bullet(F.col("line"))).where("deal IS NOT NULL").join(
        pages.select("page_id", "url", "default_round"), "page_id"
    )
    return _events(
        parsed.select(
            F.col("deal.company_name").alias("company_name"), F.col("deal.amount_usd").alias("amount_usd"), F.col("default_round").alias("round_type"),
            F.coalesce("deal.announced_at", instant(as_of)).alias("announced_at"), F.col("url").alias("source_url"),
            F.lit("Source: roundup bullet.").alias("detail"), fund.event_score(F.col("deal.amount_usd"), F.col("default_round"), F.col("line")).alias("score"),
            F.struct(F.col("page_id").cast("bigint").alias("landed"), F.col("pos").cast("int").alias("pos")).alias("seq"),
        )
    )
