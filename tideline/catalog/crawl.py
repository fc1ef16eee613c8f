"""Career pages, funding feeds and tables, Atom feeds: payloads made from the driver tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.catalog.registry import query
from tideline.catalog.sources import HEADLINE, any_sql
from tideline.functions import lexicons as lex
from tideline.sources import feeds, funding, pages
from tideline.tables import AS_OF, Dialect, Tables

NOW = Dialect("duckdb").now

# --- career pages: every part is a page, with one of four markups ------------------------

TITLES_SQL = """SELECT p_partkey, 'Software Engineer, ' || p_name AS first_title, 'Backend Engineer, ' || p_name AS second_title, 'Platform Engineer, ' || p_name AS third_title FROM part"""


def _script(titles) -> F.Column:
    job = lambda title, k: F.struct(
        F.lit("JobPosting").alias("@type"), title.alias("title"), F.lit(f"/jobs/{k}").alias("url"), F.struct(F.struct(F.lit("Berlin").alias("addressLocality")).alias("address")).alias("jobLocation"), F.lit("text").alias("description")
    )
    return F.concat(F.lit('<script type="application/ld+json">'), F.to_json(F.array(*[job(title, k) for title, k in titles])), F.lit("</script>"))


def _markup(titles) -> F.Column:
    """The page of ``titles`` (title, number), in the markup of the part's key."""
    join = lambda form: F.concat(*[x for title, k in titles for x in form(title, k)])
    boxes = join(lambda title, k: (F.lit(f'<div class="opening"><a href="/jobs/{k}">'), title, F.lit('</a><span class="location">Berlin</span></div>')))
    heads = join(lambda title, k: (F.lit("<h3>"), title, F.lit(f'</h3><p><a href="/jobs/{k}">apply</a></p>')))
    links = join(lambda title, k: (F.lit(f'<p><a href="/jobs/{k}">'), title, F.lit("</a></p>")))
    kind = F.col("p_partkey") % 4
    body = F.when(kind == 0, _script(titles)).when(kind == 1, boxes).when(kind == 2, heads).otherwise(links)
    return F.concat(F.lit("<html><body>"), body, F.lit("</body></html>"))


def crawled(t: Tables, before: bool = False):
    """One page per part. In the earlier crawl a third of the parts lack the second
    job, and another third have a third one."""
    first, second, third = (F.concat(F.lit(f"{kind} Engineer, "), "p_name") for kind in ("Software", "Backend", "Platform"))
    now = _markup([(first, 1), (second, 2)])
    turn = F.col("p_partkey") % 3
    then = F.when(turn == 0, _markup([(first, 1)])).when(turn == 1, _markup([(first, 1), (second, 2), (third, 3)])).otherwise(now)
    key = F.col("p_partkey").cast("string")
    return t.part.select(
        F.col("p_partkey").alias("page_id"), F.concat(F.lit("Company "), key).alias("company_name"), F.concat(F.lit("https://c"), key, F.lit(".example/careers")).alias("url"), (then if before else now).alias("html")
    )


@query(
    "career_page_jobs",
    f"""WITH p AS ({TITLES_SQL})
    SELECT p_partkey AS page_id, k AS pos, CASE k WHEN 1 THEN first_title ELSE second_title END AS title, 'https://c' || p_partkey || '.example/jobs/' || k AS url,
      CASE WHEN p_partkey % 4 < 2 THEN 'Berlin' ELSE '' END AS location, CASE WHEN p_partkey % 4 = 0 THEN 'text' ELSE '' END AS description
    FROM p, (SELECT CAST(unnest([1, 2]) AS INTEGER) AS k)""",
)
def career_page_jobs(t: Tables):
    """Each strategy finds the jobs of its pages."""
    return pages.page_jobs(crawled(t)).select("page_id", "pos", "title", "url", "location", "description")


@query(
    "career_roles",
    f"""WITH p AS ({TITLES_SQL})
    SELECT 'Company ' || p_partkey AS company_name, CASE k WHEN 1 THEN first_title ELSE second_title END AS title, 'https://c' || p_partkey || '.example/jobs/' || k AS url, 'career_page' AS source
    FROM p, (SELECT unnest([1, 2]) AS k)""",
)
def career_roles(t: Tables):
    return pages.career_pages(crawled(t), None, AS_OF).roles.select("company_name", "title", "url", "source")


@query(
    "career_signals",
    f"""WITH p AS ({TITLES_SQL})
    SELECT 'Company ' || p_partkey AS company_name, second_title || ' — direct listing, not yet syndicated to job boards' AS headline, 'https://c' || p_partkey || '.example/jobs/2' AS source_url,
      {lex.SOURCE_SCORES["page_added"]}::DOUBLE AS score FROM p WHERE p_partkey % 3 = 0
    UNION ALL SELECT 'Company ' || p_partkey, third_title || ' removed — role filled or paused', 'https://c' || p_partkey || '.example/careers', {lex.SOURCE_SCORES["page_removed"]}::DOUBLE FROM p WHERE p_partkey % 3 = 1""",
)
def career_signals(t: Tables):
    """J6 over two crawls of the same pages."""
    earlier = crawled(t, before=True)
    previous = pages.snapshots(earlier, pages.page_jobs(earlier))
    return pages.career_pages(crawled(t), previous, AS_OF).signals.select("company_name", "headline", "source_url", F.col("score").cast("double").alias("score"))


# --- funding -----------------------------------------------------------------------------

DEALS = (
    "SELECT l_orderkey, l_linenumber, {headline} AS title, p_name, p_size, l_quantity, l_returnflag, l_shipdate + INTERVAL 8217 {days} AS dated, "
    "concat('https://news.example/', CAST(l_orderkey AS {text}), '/', CAST(l_linenumber AS {text})) AS link FROM {lineitem} JOIN {part} ON l_partkey = p_partkey"
)


def deals(t: Tables):
    sql = DEALS.replace("{headline}", HEADLINE.format(text="STRING")).replace("{days}", "DAYS").replace("{text}", "STRING")
    return t.spark.sql(sql, lineitem=t.lineitem, part=t.part)


DEALS_SQL = DEALS.replace("{headline}", HEADLINE.format(text="VARCHAR")).replace("{days}", "DAYS").replace("{text}", "VARCHAR").replace("{lineitem}", "lineitem").replace("{part}", "part")
ROUND = "CASE p_size % 5 WHEN 0 THEN 'series a' WHEN 1 THEN 'seed' WHEN 2 THEN 'series b' WHEN 3 THEN 'growth' ELSE 'unknown' END"


def rss(t: Tables):
    """One feed per order, an item per line."""
    stamp = F.date_format("dated", "EEE, dd MMM yyyy HH:mm:ss '+0000'")
    item = F.concat(F.lit("<item><title>"), "title", F.lit("</title><link>"), "link", F.lit("</link><pubDate>"), stamp, F.lit("</pubDate></item>"))
    items = F.transform(F.array_sort(F.collect_list(F.struct(F.col("l_linenumber").alias("n"), item.alias("item")))), lambda r: r["item"])
    return deals(t).groupBy(F.col("l_orderkey").alias("landed")).agg(F.concat(F.lit('<rss version="2.0"><channel><title>f</title>'), F.array_join(items, ""), F.lit("</channel></rss>")).alias("body"))


def _news_sql(words, dated: str, where: str) -> str:
    return f"""WITH d AS ({DEALS_SQL}),
    e AS (SELECT *, upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS company_name, l_quantity * 1000000.0::DOUBLE AS amount_usd, {ROUND} AS round_type FROM d
      WHERE l_returnflag <> 'R' AND l_linenumber % 4 <> 2 AND CAST(l_quantity AS INTEGER) >= 5 AND {any_sql("lower(title)", words)} AND {where})
    SELECT link AS source_url, company_name, amount_usd, round_type, {dated} AS announced_at,
      least(95, CASE round_type WHEN 'series a' THEN 70 WHEN 'seed' THEN 45 WHEN 'series b' THEN 80 WHEN 'growth' THEN 55 ELSE 40 END
        + CASE WHEN amount_usd >= 50000000 THEN 15 WHEN amount_usd >= 20000000 THEN 10 WHEN amount_usd >= 10000000 THEN 5 ELSE 0 END
        + CASE WHEN {any_sql("lower(title)", lex.FUNDING_SECTOR_WORDS)} THEN 10 ELSE 0 END)::DOUBLE AS score FROM e"""


@query("news_feed_events", _news_sql(lex.FUNDING_NEWS_WORDS, "dated", f"dated >= {NOW} - INTERVAL 14 DAYS"))
def news_feed_events(t: Tables):
    """S6, first feed: all items of all feeds, 14 days back."""
    return funding.news_feed(rss(t), AS_OF).select("source_url", "company_name", "amount_usd", "round_type", "announced_at", "score")


@query("brief_feed_events", _news_sql(lex.FUNDING_BRIEF_NEWS_WORDS, NOW, "true"))
def brief_feed_events(t: Tables):
    """S6, second feed: every item counts as new."""
    return funding.brief_feed(rss(t), AS_OF).select("source_url", "company_name", "amount_usd", "round_type", "announced_at", "score")


@query(
    "api_rounds",
    f"""WITH d AS ({DEALS_SQL})
    SELECT l_orderkey AS landed, p_name AS company_name, l_quantity * 1000000.0::DOUBLE AS amount_usd, {ROUND} AS round_type, CAST(CAST(dated AS DATE) AS TIMESTAMP) AS announced_at FROM d WHERE l_linenumber % 5 <> 0""",
)
def api_rounds(t: Tables):
    """Rounds without a company are left out."""
    rows = deals(t).withColumn("kind", F.expr(ROUND))
    entity = F.struct(
        F.struct(
            F.struct(F.when(F.col("l_linenumber") % 5 != 0, F.col("p_name")).alias("value")).alias("funded_organization_identifier"),
            F.struct((F.col("l_quantity") * 1e6).alias("value_usd")).alias("money_raised"),
            F.col("kind").alias("investment_type"), F.date_format("dated", "yyyy-MM-dd").alias("announced_on"),
        ).alias("properties")
    )
    landed = rows.groupBy(F.col("l_orderkey").alias("landed")).agg(F.to_json(F.struct(F.collect_list(entity).alias("entities"))).alias("body"))
    return funding.api_rounds(landed, AS_OF).select(F.col("seq.landed").alias("landed"), "company_name", "amount_usd", "round_type", "announced_at")


@query(
    "offering_signals",
    f"""WITH d AS ({DEALS_SQL})
    SELECT p_name AS company_name, CAST(CAST(dated AS DATE) AS TIMESTAMP) AS signal_date, CASE WHEN l_linenumber % 3 = 0 THEN floor(l_quantity) * 500000 ELSE floor(l_quantity) * 1000000 END::DOUBLE AS amount_usd
    FROM d WHERE dated >= {NOW} - INTERVAL 120 DAYS AND CAST(dated AS DATE) >= {NOW} - INTERVAL 120 DAYS AND CASE WHEN l_linenumber % 3 = 0 THEN floor(l_quantity) * 500000 ELSE floor(l_quantity) * 1000000 END >= 5000000""",
)
def offering_signals(t: Tables):
    """What was sold counts where it is given, else what was offered."""
    millions = F.floor("l_quantity")
    table = deals(t).select(
        F.col("p_name").alias("Issuer Name"), F.date_format("dated", "yyyy-MM-dd").alias("Filing Date"), (millions * 1000000).cast("string").alias("Total Offering Amount"),
        F.when(F.col("l_linenumber") % 3 == 0, (millions * 500000).cast("string")).otherwise("").alias("Total Amount Sold"),
    )
    found = funding.offerings(table, AS_OF, min_score=0.0).signals
    return found.select("company_name", "signal_date", F.col("funding_amount_usd").alias("amount_usd"))


# --- Atom --------------------------------------------------------------------------------


@query(
    "atom_feed_entries",
    f"""WITH d AS ({DEALS_SQL})
    SELECT l_orderkey AS landed, title, link, p_name AS summary, 'Author ' || p_size AS author, date_trunc('second', dated) AS published_at FROM d WHERE dated >= {NOW} - INTERVAL 14 DAYS""",
)
def atom_feed_entries(t: Tables):
    """Atom feeds, one per order."""
    stamp = F.date_format("dated", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    entry = F.concat(
        F.lit("<entry><title>"), "title", F.lit('</title><link rel="alternate" href="'), "link", F.lit('"/><summary>'), "p_name", F.lit("</summary><author><name>Author "),
        F.col("p_size").cast("string"), F.lit("</name></author><published>"), stamp, F.lit("</published></entry>"),
    )
    feed = F.concat(F.lit('<feed xmlns="http://www.w3.org/2005/Atom"><title>f</title>'), F.array_join(F.collect_list(entry), ""), F.lit("</feed>"))
    landed = deals(t).groupBy(F.col("l_orderkey").alias("landed")).agg(feed.alias("body"))
    return feeds.feed_entries(landed, AS_OF).select("landed", "title", "link", "summary", "author", "published_at")
