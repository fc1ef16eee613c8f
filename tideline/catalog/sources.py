"""Normalisers and text functions over payloads that Spark builds from the tables.

Every payload belongs to one order, page or event, so payloads stay small however
the tables grow.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.catalog.registry import query
from tideline.functions import funding as fund, labels, lexicons as lex, text, titles
from tideline.functions.clock import instant
from tideline.functions.scores import ashby_score
from tideline.operators import joins
from tideline.sources import boards, feeds, funding, pages
from tideline.sources.elements import page_elements
from tideline.tables import AS_OF, Dialect, Tables

D = Dialect("duckdb")
NOW = D.now

TITLE = """CASE p_size % 10 WHEN 0 THEN 'Senior Backend Engineer' WHEN 1 THEN 'Staff ML Engineer' WHEN 2 THEN 'Site Reliability Lead'
  WHEN 3 THEN 'Junior Software Engineer' WHEN 4 THEN 'Accountant' WHEN 5 THEN 'Principal Platform Engineer' WHEN 6 THEN 'Full-Stack Software Engineer'
  WHEN 7 THEN 'Distributed Systems Engineer' WHEN 8 THEN 'Founding Engineer' ELSE 'Recruiter' END"""
PLACE = "CASE l_returnflag WHEN 'A' THEN 'Remote - US' WHEN 'R' THEN 'Berlin' ELSE '' END"
LINES = f"""SELECT l_orderkey, o_custkey AS company_id, l_linenumber, l_partkey, l_quantity, l_returnflag, l_shipdate + INTERVAL 8217 DAYS AS dated,
    p_name, p_brand, p_type, p_size, {TITLE} AS title, {PLACE} AS location,
    concat(p_name, CASE p_size % 5 WHEN 0 THEN ' uses Go and Kafka' WHEN 1 THEN ' uses Rust, gRPC' WHEN 2 THEN ' uses Python on AWS' ELSE ' team' END) AS content
  FROM {{lineitem}} JOIN {{part}} ON l_partkey = p_partkey JOIN {{orders}} ON l_orderkey = o_orderkey"""
LINES_SQL = "WITH lines AS (" + LINES.format(lineitem="lineitem", part="part", orders="orders") + ")"


def lines(t: Tables) -> DataFrame:
    return t.spark.sql(LINES, lineitem=t.lineitem, part=t.part, orders=t.orders)


def payload(rows: DataFrame, item, wrap, *more) -> DataFrame:
    """One body per order; ``item`` is the struct of a line."""
    order = F.struct(F.col("l_linenumber").alias("n"), F.col("l_partkey").alias("p"), item.alias("item"))
    items = F.transform(F.array_sort(F.collect_list(order)), lambda r: r["item"])
    grouped = rows.groupBy(F.col("l_orderkey").alias("landed"), "company_id").agg(items.alias("items"), *more)
    return grouped.select(
        "landed", F.concat(F.lit("Customer "), F.col("company_id").cast("string")).alias("company_name"),
        F.col("landed").cast("string").alias("token"), wrap(F.col("items")).alias("body"),
    )


def iso(c):
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def greenhouse(t: Tables):
    item = F.struct(
        F.col("l_partkey").alias("id"), F.col("title").alias("title"), F.col("content").alias("content"), iso(F.col("dated")).alias("updated_at"),
        F.struct(F.col("location").alias("name")).alias("location"),
    )
    return boards.greenhouse(payload(lines(t), item, lambda i: F.to_json(F.struct(i.alias("jobs")))), AS_OF)


def any_sql(expr: str, words) -> str:
    return "(" + " OR ".join(f"contains({expr}, '{w}')" for w in words) + ")"


def ladder_sql(expr: str, rules, default: str) -> str:
    return "CASE " + " ".join(f"WHEN {any_sql(expr, words)} THEN '{name}'" for name, words in rules) + f" ELSE '{default}' END"


ROLE_TYPE_SQL = ladder_sql("lower(title)", lex.ROLE_TYPE_WORDS, "unknown")
SENIORITY_SQL = ladder_sql("lower(title)", lex.SENIORITY_WORDS, "mid")
TARGET_SQL = any_sql("lower(title)", lex.TARGET_TITLE_WORDS)
LANGUAGES_SQL = "concat_ws(',', " + ", ".join(f"CASE WHEN contains(lower(content), '{w}') THEN '{w}' END" for w in lex.LANGUAGES) + ")"


@query(
    "board_a_roles",
    LINES_SQL
    + f""" SELECT 'Customer ' || company_id AS company_name, title, 'https://job-boards.greenhouse.io/' || l_orderkey || '/jobs/' || l_partkey AS url,
      {ROLE_TYPE_SQL} AS role_type, {SENIORITY_SQL} AS seniority, location = 'Remote - US' AS is_remote, location = 'Remote - US' AS is_remote_us, {LANGUAGES_SQL} AS skills
    FROM lines WHERE {TARGET_SQL}""",
)
def board_a_roles(t: Tables):
    return greenhouse(t).roles.select(
        "company_name", "title", "url", "role_type", "seniority", "is_remote", "is_remote_us", F.array_join("required_skills", ",").alias("skills")
    )


@query(
    "board_a_signals",
    LINES_SQL
    + f""", jobs AS (SELECT 'Customer ' || company_id AS company_name, title, title || ' — ' || CASE WHEN location = '' THEN 'Remote' ELSE location END AS headline,
        dated AS signal_date, 65.0 AS score, l_orderkey, l_linenumber, l_partkey FROM lines WHERE {TARGET_SQL}),
    recent AS (SELECT *, row_number() OVER (PARTITION BY company_name ORDER BY l_orderkey, l_linenumber, l_partkey, title) AS rn FROM jobs WHERE {D.days("signal_date", NOW)} <= 2),
    batch AS (SELECT company_name, count(*) || ' engineering roles posted simultaneously — ' || string_agg(CASE WHEN rn <= 3 THEN title END, ', ' ORDER BY rn) AS headline,
        {NOW} AS signal_date, 88.0 AS score FROM recent GROUP BY company_name HAVING count(*) >= 3),
    every AS (SELECT company_name, headline, signal_date, score FROM jobs UNION ALL SELECT * FROM batch),
    busy AS (SELECT company_name FROM every WHERE CAST(signal_date AS DATE) = DATE '2024-01-20' GROUP BY company_name HAVING count(*) >= 3)
    SELECT company_name, headline, signal_date, CASE WHEN company_name IN (SELECT company_name FROM busy) THEN least(score::DOUBLE * 1.3::DOUBLE, 100.0) ELSE score::DOUBLE END AS score FROM every""",
)
def board_a_signals(t: Tables):
    return greenhouse(t).signals.select("company_name", "headline", "signal_date", "score")


@query(
    "board_b_roles",
    LINES_SQL
    + f""" SELECT title, 'https://jobs.ashbyhq.com/' || l_orderkey || '/' || l_partkey AS url, {LANGUAGES_SQL} AS skills, location = 'Remote - US' OR p_size > 25 AS is_remote,
      location = 'Remote - US' OR (p_size > 25 AND location = '') AS is_remote_us, greatest(70.0 - {D.days("dated", NOW)} * 1.5, 20.0)::DOUBLE AS base_score
    FROM lines WHERE {TARGET_SQL}""",
)
def board_b_roles(t: Tables):
    item = F.struct(
        F.col("l_partkey").alias("id"), F.col("title").alias("title"), F.col("content").alias("descriptionHtml"), F.col("location").alias("location"),
        (F.col("p_size") > 25).alias("isRemote"), iso(F.col("dated")).alias("publishedAt"),
    )
    staged = boards.ashby(payload(lines(t), item, lambda i: F.to_json(F.struct(i.alias("jobs")))), AS_OF)
    return staged.roles.join(
        staged.signals.where("NOT headline LIKE '% roles posted simultaneously%'").select("seq", ashby_score(F.col("signal_date"), instant(AS_OF)).alias("base_score")), "seq"
    ).select("title", "url", F.array_join("required_skills", ",").alias("skills"), "is_remote", "is_remote_us", "base_score")


@query(
    "portfolio_roles",
    LINES_SQL
    + f""", firsts AS (SELECT *, row_number() OVER (PARTITION BY l_partkey ORDER BY l_orderkey, l_linenumber, title, location) AS rn FROM lines)
    SELECT 'https://board.example/jobs/' || l_partkey AS url, title, 'Company ' || p_brand AS company_name,
      CASE WHEN location = 'Berlin' THEN 'Berlin · Hybrid' ELSE location END AS location, location = 'Remote - US' AS is_remote,
      CASE p_size % 5 WHEN 0 THEN 'Go,Kafka' WHEN 1 THEN 'Rust,gRPC' ELSE 'Python' END AS skills FROM firsts WHERE rn = 1 AND {TARGET_SQL}""",
)
def portfolio_roles(t: Tables):
    skills = F.when(F.col("p_size") % 5 == 0, F.array(F.lit("Go"), F.lit("Kafka"))).when(F.col("p_size") % 5 == 1, F.array(F.lit("Rust"), F.lit("gRPC"))).otherwise(F.array(F.lit("Python")))
    item = F.struct(
        F.col("title").alias("title"), F.concat(F.lit("Company "), "p_brand").alias("companyName"), F.concat(F.lit("/jobs/"), F.col("l_partkey").cast("string")).alias("url"),
        F.transform(skills, lambda s: F.struct(s.alias("label"))).alias("requiredSkills"),
        F.when(F.col("location") != "", F.array("location")).otherwise(F.array().cast("array<string>")).alias("locations"), (F.col("location") == "Berlin").alias("hybrid"),
        F.struct(F.lit("Series B").alias("label")).alias("fundingLV"), iso(F.col("dated")).alias("timeStamp"),
    )
    # Lines of one part differ in their place only; the order within an order decides.
    rows = lines(t)
    order = F.struct(F.col("l_linenumber").alias("n"), F.col("title").alias("t"), F.col("location").alias("l"), item.alias("item"))
    items = F.transform(F.array_sort(F.collect_list(order)), lambda r: r["item"])
    landed = rows.groupBy(F.col("l_orderkey").alias("landed")).agg(items.alias("jobs")).select(
        "landed", F.lit("https://board.example/jobs").alias("board_url"), F.lit("Board").alias("board_name"), F.to_json(F.struct("jobs")).alias("body")
    )
    return boards.portfolio(landed, AS_OF).roles.select("url", "title", "company_name", "location", "is_remote", F.array_join("required_skills", ",").alias("skills"))


LISTED_SQL = ladder_sql("lower(title)", lex.ROLE_TYPE_WORDS, "unknown")


@query(
    "listing_companies",
    LINES_SQL
    + f""", ok AS (SELECT *, CASE WHEN location = 'Berlin' THEN 'Anywhere' ELSE location END AS place FROM lines
        WHERE p_size % 7 <> 0 AND ({TARGET_SQL} OR {any_sql("lower(title)", lex.LISTING_TITLE_WORDS)} OR p_size % 3 = 0))
    SELECT 'Customer ' || company_id AS name, bool_or(place IN ('Remote - US', 'Anywhere')) AS remote_friendly, bool_or(place = 'Remote - US') AS remote_us FROM ok GROUP BY company_id""",
)
def listing_companies(t: Tables):
    item = F.struct(
        F.col("l_partkey").alias("id"), F.col("title").alias("title"), F.concat(F.lit("c"), F.col("company_id").cast("string")).alias("companySlug"),
        F.concat(F.lit("Customer "), F.col("company_id").cast("string")).alias("companyName"), F.col("content").alias("companyOneLiner"),
        F.when(F.col("p_size") % 3 == 0, "Backend").otherwise("other").alias("roleType"), F.when(F.col("p_size") % 7 == 0, "Internship").otherwise("Full-time").alias("jobType"),
        F.when(F.col("location") == "Berlin", "Anywhere").otherwise(F.col("location")).alias("location"),
    )

    def page(items):
        body = F.to_json(F.struct(F.struct(items.alias("jobs")).alias("props")))
        quoted = F.replace(F.replace(body, F.lit("&"), F.lit("&amp;")), F.lit('"'), F.lit("&quot;"))
        return F.concat(F.lit('<html><body><div id="jobs/public/pages/JobsPage-react-component-x" data-page="'), quoted, F.lit('"></div></body></html>'))

    return boards.listing(payload(lines(t), item, page), AS_OF).companies.select("name", "remote_friendly", "remote_us")


@query(
    "feed_entries",
    LINES_SQL
    + f""" SELECT l_orderkey AS landed, title, 'https://blog.example/' || l_orderkey || '/' || l_partkey AS link, content AS summary, p_brand AS author, dated AS published_at
    FROM lines WHERE dated >= {NOW} - INTERVAL 14 DAYS""",
)
def feed_entries(t: Tables):
    link = F.concat(F.lit("https://blog.example/"), F.col("l_orderkey").cast("string"), F.lit("/"), F.col("l_partkey").cast("string"))
    stamp = F.date_format("dated", "EEE, dd MMM yyyy HH:mm:ss '+0000'")
    item = F.concat(
        F.lit("<item><title>"), "title", F.lit("</title><link>"), link, F.lit("</link><description>&lt;p&gt;"), "content", F.lit("&lt;/p&gt;</description><dc:creator>"),
        "p_brand", F.lit("</dc:creator><pubDate>"), stamp, F.lit("</pubDate></item>"),
    )
    wrap = lambda items: F.concat(
        F.lit('<rss version="2.0" xmlns:dc="http://purl.org/dc/elements/1.1/"><channel><title>f</title>'), F.array_join(items, ""), F.lit("</channel></rss>")
    )
    return feeds.feed_entries(payload(lines(t), item, wrap), AS_OF).select("landed", "title", "link", "summary", "author", "published_at")


@query(
    "forum_items",
    f"""SELECT 'https://news.ycombinator.com/item?id=' || event_id AS link, event_type || ' ' || CAST(user_id AS VARCHAR) AS title, date_trunc('second', ts) AS published_at
    FROM events WHERE event_id % 5 <> 0 AND event_type <> 'error' AND date_trunc('second', ts) >= {NOW} - INTERVAL 14 DAYS""",
)
def forum_items(t: Tables):
    whole = F.datediff("ts", F.lit("1970-01-01").cast("date")).cast("bigint") * 86400 + F.hour("ts") * 3600 + F.minute("ts") * 60 + F.floor(F.second("ts"))
    item = F.struct(
        F.col("event_id").alias("id"), F.when(F.col("event_type") == "error", "job").otherwise("story").alias("type"),
        F.concat_ws(" ", "event_type", F.col("user_id").cast("string")).alias("title"), whole.alias("time"), (F.col("event_id") % 5 == 0).alias("dead"),
    )
    landed = t.events.select(F.col("event_id").alias("landed"), F.to_json(item).alias("body"))
    return feeds.forum_items(landed, AS_OF).select("link", "title", "published_at")


HEADLINE = """concat(upper(substr(p_name, 1, 1)), substr(p_name, 2), CASE l_linenumber % 4 WHEN 0 THEN ' raises' WHEN 1 THEN ' secures' WHEN 2 THEN ' explores' ELSE ' locks down' END,
  ' $', CAST(CAST(l_quantity AS INTEGER) AS {text}), CASE l_returnflag WHEN 'A' THEN ' million' WHEN 'N' THEN 'M' ELSE ' billion' END,
  CASE p_size % 5 WHEN 0 THEN ' Series A' WHEN 1 THEN ' seed' WHEN 2 THEN ' Series B' WHEN 3 THEN ' growth' ELSE '' END,
  CASE p_size % 3 WHEN 0 THEN ' for cloud tools' ELSE '' END)"""


@query(
    "funding_headlines",
    f"""WITH h AS (SELECT l_orderkey, l_linenumber, l_partkey, {HEADLINE.format(text="VARCHAR")} AS title, p_name, l_quantity * 1000000.0::DOUBLE AS amount,
        CASE p_size % 5 WHEN 0 THEN 'series a' WHEN 1 THEN 'seed' WHEN 2 THEN 'series b' WHEN 3 THEN 'growth' ELSE 'unknown' END AS round_type
      FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_returnflag <> 'R' AND l_linenumber % 4 <> 2 AND CAST(l_quantity AS INTEGER) >= 5)
    SELECT l_orderkey, l_linenumber, upper(substr(p_name, 1, 1)) || substr(p_name, 2) AS company_name, amount AS amount_usd, round_type,
      least(95, CASE round_type WHEN 'series a' THEN 70 WHEN 'seed' THEN 45 WHEN 'series b' THEN 80 WHEN 'growth' THEN 55 ELSE 40 END
        + CASE WHEN amount >= 50000000 THEN 15 WHEN amount >= 20000000 THEN 10 WHEN amount >= 10000000 THEN 5 ELSE 0 END
        + CASE WHEN {any_sql("lower(title)", lex.FUNDING_SECTOR_WORDS)} THEN 10 ELSE 0 END)::DOUBLE AS score,
      'Raised $' || CAST(CAST(amount / 1000000 AS INTEGER) AS VARCHAR) || 'M ' || CASE round_type WHEN 'series a' THEN 'Series A' WHEN 'seed' THEN 'Seed' WHEN 'series b' THEN 'Series B'
        WHEN 'growth' THEN 'Growth' ELSE 'Unknown' END || ' — engineering hiring wave expected' AS headline FROM h""",
)
def funding_headlines(t: Tables):
    rows = t.spark.sql(
        "SELECT l_orderkey, l_linenumber, " + HEADLINE.format(text="STRING") + " AS title FROM {lineitem} JOIN {part} ON l_partkey = p_partkey", lineitem=t.lineitem, part=t.part
    )
    deals = fund.with_deal(rows, F.col("title"), F.lit(""))
    amount, kind = F.col("amount_usd"), F.col("round_type")
    return deals.select(
        "l_orderkey", "l_linenumber", "company_name", "amount_usd", "round_type",
        fund.event_score(amount, kind, F.col("title")).alias("score"), fund.headline(amount, kind).alias("headline"),
    )


@query(
    "funding_events_deduped",
    """WITH d AS (SELECT l_partkey, l_quantity, l_orderkey * 10 + l_linenumber AS seq, l_shipdate AS announced_at, lower(p_name) AS name FROM lineitem JOIN part ON l_partkey = p_partkey)
    SELECT name, CAST(floor(l_quantity) AS BIGINT) AS millions, CAST(announced_at AS DATE) AS day, min(seq) AS seq FROM d GROUP BY ALL""",
)
def funding_events_deduped(t: Tables):
    rows = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey"))
    events = rows.select(
        F.col("p_name").alias("company_name"), (F.col("l_quantity") * 1e6).alias("amount_usd"), F.lit("Seed").alias("round_type"), F.col("l_shipdate").alias("announced_at"),
        F.lit("").alias("source_url"), F.lit("").alias("detail"), F.lit(1.0).alias("score"), F.lit("").alias("description"), F.lit("").alias("hq_city"),
        F.struct((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("landed"), F.lit(0).alias("pos")).alias("seq"),
    )
    return funding.staged_events(events).signals.select(
        F.lower("company_name").alias("name"), F.floor(F.col("funding_amount_usd") / 1e6).alias("millions"), F.to_date("signal_date").alias("day"), F.col("seq.landed").alias("seq")
    )


@query(
    "title_classes",
    f"SELECT role_id, {ROLE_TYPE_SQL} AS role_type, {SENIORITY_SQL} AS seniority, {TARGET_SQL} AS is_target FROM roles",
)
def title_classes(t: Tables):
    title = F.col("title")
    return t.roles.select(
        "role_id", titles.role_type(title).alias("role_type"), titles.seniority(title).alias("seniority"), titles.is_target(title).alias("is_target")
    )


def words_sql(expr: str, words) -> str:
    return "concat_ws(',', " + ", ".join(f"CASE WHEN contains({expr}, '{w}') THEN '{w}' END" for w in words) + ")"


@query(
    "document_stacks",
    f"""WITH d AS (SELECT doc_id, lower(text) AS body FROM documents)
    SELECT doc_id, {words_sql("body", lex.LANGUAGES)} AS languages, {words_sql("body", lex.FRAMEWORKS)} AS frameworks, {words_sql("body", lex.INFRA_TOOLS)} AS infra FROM d""",
)
def document_stacks(t: Tables):
    stack = titles.with_tech_stack(t.documents.select("doc_id", "text"), F.col("text"), "s")
    return stack.select("doc_id", *[F.array_join(f"s.{p}", ",").alias(p) for p in ("languages", "frameworks", "infra")])


@query(
    "document_families",
    f"""WITH d AS (SELECT doc_id, lower(text) AS body FROM documents)
    SELECT doc_id, {ladder_sql("body", lex.FAMILY_WORDS, "backend")} AS focus,
      coalesce(nullif(concat_ws(',', {", ".join(f"CASE WHEN {any_sql('body', words)} THEN '{name}' END" for name, words in lex.FAMILY_WORDS)}), ''), 'backend') AS families FROM d""",
)
def document_families(t: Tables):
    low = t.documents.select("doc_id", F.lower("text").alias("text"))
    return low.select(
        "doc_id", titles.role_focus(F.col("text")).alias("focus"), F.array_join(titles.role_families(F.col("text")), ",").alias("families")
    )


@query(
    "text_keys",
    """SELECT doc_id, trim(replace(replace(replace(lower(head), ' ', '-'), '.', '-'), ',', ''), '-') AS slug,
      trim(regexp_replace(lower(head), '[^a-z0-9]+', '-', 'g'), '-') AS job_slug, substr(trim(regexp_replace(lower(head), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60) AS short_slug,
      substr(sha256(source || head), 1, 16) AS url_key, substr(md5(head || ':' || lang || ':' || source), 1, 8) AS fingerprint, substr(md5(text), 1, 16) AS page_hash
    FROM (SELECT *, text AS head FROM documents) AS x""",
)
def text_keys(t: Tables):
    head = F.col("text")
    return t.documents.select(
        "doc_id", text.company_slug(head).alias("slug"), text.job_slug(head).alias("job_slug"), text.job_slug(head, 60).alias("short_slug"), text.role_key(F.concat("source", head)).alias("url_key"),
        text.job_fingerprint(head, F.col("lang"), F.col("source")).alias("fingerprint"), text.page_hash(F.col("text")).alias("page_hash"),
    )


TYPE_LABELS = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lex.SIGNAL_TYPE_LABELS.items())


@query(
    "signal_payloads",
    f"""SELECT CAST(signal_id AS VARCHAR) AS id, CAST(company_id AS VARCHAR) AS company_id, name AS company_name, type, CASE type {TYPE_LABELS} END AS type_label, headline, '' AS detail, score,
      CASE WHEN score >= 75 THEN 'high' WHEN score >= 50 THEN 'medium' ELSE 'low' END AS score_variant, strftime(signal_date, '%Y-%m-%dT%H:%M:%S.%f') AS signal_date, source_url
    FROM signals JOIN companies USING (company_id)""",
)
def signal_payloads(t: Tables):
    named = joins.with_company_name(t.signals, t.companies)
    p = labels.signal_payload(
        F.col("signal_id"), F.col("company_id"), F.col("company_name"), F.col("type"), F.col("headline"), F.lit(""), F.col("score"), F.col("signal_date"), F.col("source_url")
    )
    return named.select(p.alias("p")).select("p.*")


@query(
    "page_links",
    r"""SELECT page_id, href, text FROM (
      SELECT page_id, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS text FROM pages) AS x""",
)
def page_links(t: Tables):
    return page_elements(t.pages, tags=("a",)).select("page_id", "href", "text")


@query(
    "career_links",
    rf"""WITH a AS (SELECT page_id, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin, lower(url) AS own, html,
        unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS text FROM pages)
    SELECT DISTINCT page_id, origin || href AS url FROM a WHERE {any_sql("lower(text)", lex.CAREER_ANCHOR_WORDS)} OR {any_sql("lower(origin || href)", lex.CAREER_URL_WORDS)}
    UNION SELECT page_id, url FROM pages WHERE {any_sql("lower(url)", lex.CAREER_URL_WORDS)} OR {any_sql("lower(html)", lex.CAREER_PAGE_WORDS)}""",
)
def career_links(t: Tables):
    return pages.career_links(t.pages).select("page_id", "url")


@query("page_jobs")
def page_jobs(t: Tables):
    # The driver's pages hold no job markup, so there are no rows to check in SQL;
    # each strategy has inline tests.
    return pages.page_jobs(t.pages)
