"""Feeds and forum items to entries and signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.clock import epoch_instant, instant, parse_instant, shift
from tideline.functions.scores import with_entry_scores
from tideline.functions.text import cut, nonblank, site_origin, squeeze, tidy
from tideline.operators.mentions import match_mentions
from tideline.operators.ranking import first_wins
from tideline.schemas import Staged

RECENT_DAYS = 14

# Item elements are taken as text; XML prefixes are dropped by the reader.
RSS = (
    "channel struct<item:array<struct<title:string,link:string,description:string,encoded:string,creator:string,"
    "author:string,pubDate:string,published:string,updated:string>>>"
)
ATOM = (
    "entry array<struct<title:string,link:array<struct<_href:string,_rel:string>>,summary:string,content:string,"
    "author:struct<name:string>,published:string,updated:string>>"
)
XML_OPTIONS = {"ignoreNamespace": "true", "valueTag": "_VALUE", "mode": "PERMISSIVE"}


def _first(*columns: str) -> Column:
    return F.coalesce(*[nonblank(F.col(c)) for c in columns], F.lit(""))


def rss_items(landed: DataFrame, first_items: int | None = None) -> DataFrame:
    """Items of every feed payload (landed, feed, body); all, or the first ``first_items``."""
    parsed = landed.withColumn("x", F.from_xml("body", RSS, XML_OPTIONS))
    keep = [c for c in landed.columns if c != "body"]
    return (
        parsed.select(*keep, F.posexplode("x.channel.item").alias("pos", "i"))
        .where(F.lit(True) if first_items is None else F.col("pos") < first_items)
        .select(
            *keep,
            F.struct(F.col("landed").cast("bigint").alias("landed"), F.col("pos")).alias("seq"),
            _first("i.title").alias("title"),
            _first("i.link").alias("link"),
            _first("i.description", "i.encoded").alias("summary_raw"),
            _first("i.creator", "i.author").alias("author"),
            parse_instant(_first("i.pubDate", "i.published", "i.updated")).alias("published_at"),
        )
    )


def atom_entries(landed: DataFrame, first_items: int | None = None) -> DataFrame:
    parsed = landed.withColumn("x", F.from_xml("body", ATOM, XML_OPTIONS))
    keep = [c for c in landed.columns if c != "body"]
    main = F.filter("i.link", lambda a: (F.coalesce(a["_href"], F.lit("")) != "") & F.coalesce(a["_rel"], F.lit("alternate")).isin("alternate", ""))
    return (
        parsed.select(*keep, F.posexplode("x.entry").alias("pos", "i"))
        .where(F.lit(True) if first_items is None else F.col("pos") < first_items)
        .select(
            *keep,
            F.struct(F.col("landed").cast("bigint").alias("landed"), F.col("pos")).alias("seq"),
            _first("i.title").alias("title"),
            F.coalesce(F.get(main, 0)["_href"], F.lit("")).alias("link"),
            _first("i.summary", "i.content").alias("summary_raw"),
            _first("i.author.name").alias("author"),
            parse_instant(_first("i.published", "i.updated")).alias("published_at"),
        )
    )


def feed_entries(landed: DataFrame, as_of: str, first_items: int | None = None) -> DataFrame:
    """Entries of RSS and Atom payloads of the last 14 days, with title and link;
    an undated entry counts as new."""
    now = instant(as_of)
    is_atom = F.col("body").rlike(r"(?s)^\s*(?:<\?xml[^>]*\?>\s*)?(?:<!--.*?-->\s*)*<(?:\w+:)?feed\b")
    both = rss_items(landed.where(~is_atom), first_items).unionByName(atom_entries(landed.where(is_atom), first_items))
    entries = both.withColumns({"published_at": F.coalesce("published_at", now), "summary": tidy(F.col("summary_raw"))})
    return entries.where((F.col("title") != "") & (F.col("link") != "") & (F.col("published_at") >= shift(now, days=-RECENT_DAYS))).drop("summary_raw")


FORUM_ITEM = "id bigint, type string, title string, text string, url string, `by` string, time bigint, dead boolean, deleted boolean"


def forum_items(landed: DataFrame, as_of: str, item_url: str = "https://news.ycombinator.com/item?id=", title_length: int | None = None) -> DataFrame:
    """Live stories and comments of the last 14 days as entries."""
    now = instant(as_of)
    items = landed.select("landed", F.from_json("body", FORUM_ITEM).alias("i")).select("landed", "i.*")
    live = items.where(
        F.col("type").isin("story", "comment") & ~F.coalesce("dead", F.lit(False)) & ~F.coalesce("deleted", F.lit(False))
    )
    at = F.when(F.coalesce("time", F.lit(0)) != 0, epoch_instant(F.col("time"))).otherwise(now)
    title = squeeze(F.coalesce("title", F.lit("")))
    summary = tidy(F.coalesce(F.nullif("text", F.lit("")), title))
    return live.withColumns({"published_at": at, "summary": summary, "head": title}).where(F.col("published_at") >= shift(now, days=-RECENT_DAYS)).select(
        F.struct(F.col("landed").cast("bigint").alias("landed"), F.lit(0).alias("pos")).alias("seq"),
        F.coalesce(F.nullif("head", F.lit("")), cut(F.col("summary"), title_length)).alias("title"),
        F.coalesce(nonblank(F.col("url")), F.concat(F.lit(item_url), F.col("id").cast("string"))).alias("link"),
        "summary", "published_at", F.coalesce("by", F.lit("")).alias("author"),
        # Mentions are looked up in the item's own title, which may be empty.
        F.concat_ws("\n", "head", "summary").alias("text"),
    )


def named_entries(entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """Entries of open feeds with the company they mention; others are dropped."""
    if "text" not in entries.columns:
        entries = entries.withColumn("text", F.concat_ws("\n", "title", "summary"))
    keyed = entries.withColumn("_key", F.concat_ws(":", "seq.landed", "seq.pos", F.col("link")))
    return keyed.join(match_mentions(keyed.select("_key", "text"), aliases, "_key"), "_key").drop("_key", "text")


ENTRY_COLUMNS = (
    "company_name", "website", "kind", "source_label", "actor_name", "actor_role", "min_score", "title", "link", "summary",
    "published_at", "author", "seq",
)


def social_signals(entries: DataFrame, source: str = "social") -> Staged:
    """Scored entries (columns `ENTRY_COLUMNS`) to staging frames: score gate per feed,
    then the first entry of every link (P20, W4)."""
    scored = with_entry_scores(entries, F.col("title"), F.col("summary"), F.col("kind"), F.col("actor_role"))
    kept = first_wins(scored.where(F.col("score") >= F.col("min_score")), ["link"], ["seq"])
    actor = F.coalesce(nonblank(F.col("actor_name")), nonblank(F.col("author")))
    founder = (F.col("kind") == "founder_post") & (F.coalesce("actor_role", F.lit("")) != "")
    signals = kept.select(
        "company_name", F.col("kind").alias("type"),
        F.when(founder, F.concat("title", F.lit(" — "), F.lower("actor_role"), F.lit(" hiring signal"))).otherwise(F.col("title")).alias("headline"),
        F.trim(
            F.concat(
                F.lit("Source: "), "source_label", F.lit(". Company: "), "company_name", F.lit(". "),
                F.when(actor.isNotNull(), F.concat(actor, F.lit(" · "))).otherwise(F.lit("")),
                F.lit("Matched on "), F.coalesce(F.nullif(F.array_join("hits", ", "), F.lit("")), F.lit("team growth language")),
                F.lit(". "), F.col("summary"),
            )
        ).alias("detail"),
        F.col("link").alias("source_url"), F.col("summary").alias("raw_content"), F.col("published_at").alias("signal_date"), "score",
        actor.alias("poster_handle"), "seq",
    )
    companies = first_wins(kept, [F.lower("company_name")], ["seq"]).select(F.col("company_name").alias("name"), "website", "seq")
    return Staged.of(source, companies, signals)


def owned_feed_entries(landed: DataFrame, as_of: str) -> DataFrame:
    """Entries of feeds that belong to a company; landing rows carry company_name,
    kind, source_label, actor_name, actor_role, min_score and feed_url."""
    entries = feed_entries(landed, as_of).withColumn("website", F.coalesce(site_origin(F.col("feed_url")), F.lit("")))
    return entries.select(*ENTRY_COLUMNS)
