"""Registry, discovery, text helpers, stream folds and run steps as batch queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.catalog.registry import query
from tideline.catalog.sources import any_sql, ladder_sql
from tideline.functions import lexicons as lex
from tideline.functions import text, titles
from tideline.operators import filters, joins, merge, ranking
from tideline.sources import registry
from tideline.streaming import live
from tideline.tables import AS_OF, Dialect, Tables

NOW = Dialect("duckdb").now

# --- registry and discovery ----------------------------------------------------------------

TOKEN = "replace(slug, '#', '-')"
PAGES = f"""CASE company_id % 5 WHEN 0 THEN concat('https://boards.greenhouse.io/', {TOKEN}, '/jobs') WHEN 1 THEN concat('https://jobs.example/apply?for=', {TOKEN})
  WHEN 2 THEN concat('https://', slug, '.example/careers') WHEN 3 THEN '' ELSE concat('HTTPS://JOB-BOARDS.greenhouse.io/', upper({TOKEN})) END"""
SITES = "CASE company_id % 4 WHEN 0 THEN '' WHEN 1 THEN concat('https://www.', slug, '.example/') ELSE concat('https://', slug, '.example') END"
TOKENS = f"CASE company_id % 5 WHEN 0 THEN {TOKEN} WHEN 1 THEN {TOKEN} WHEN 4 THEN {TOKEN} END"


def listed(t: Tables):
    """Companies with a site and a career page, some of which carry a board token."""
    return t.companies.select("company_id", "name", "slug", F.expr(SITES).alias("website"), F.expr(PAGES).alias("career_page_url"))


@query("board_tokens", f"SELECT company_id, {TOKENS} AS token FROM companies")
def board_tokens(t: Tables):
    """P9"""
    return listed(t).select("company_id", text.board_token(F.col("career_page_url"), lex.BOARD_TOKEN_PATTERNS["greenhouse"], True).alias("token"))


@query(
    "board_targets",
    f"""WITH l AS (SELECT name, {TOKENS} AS stored, CASE WHEN company_id % 10 = 0 THEN {TOKEN} END AS tracked FROM companies)
    SELECT DISTINCT name, coalesce(tracked, stored) AS token FROM l WHERE coalesce(tracked, stored) IS NOT NULL""",
)
def board_targets(t: Tables):
    """Tracked tokens first, then those of stored pages."""
    known = listed(t).select("name", F.expr(f"CASE WHEN company_id % 10 = 0 THEN {TOKEN} END").alias("greenhouse_token"))
    return registry.board_targets(known, listed(t), "greenhouse")


@query(
    "discovery_seed",
    f"SELECT name, {SITES} AS website, {PAGES} AS career_page_url FROM companies WHERE {SITES} <> '' OR {PAGES} <> ''",
)
def discovery_seed(t: Tables):
    """S13"""
    return registry.discovery_seed(listed(t))


@query(
    "discovery_candidates",
    f"""SELECT company_id, {SITES} AS website FROM companies
    WHERE ({SITES} <> '' OR {PAGES} <> '') AND {TOKENS} IS NULL AND company_id % 7 <> 0""",
)
def discovery_candidates(t: Tables):
    """F11"""
    tracked = t.companies.where("company_id % 7 = 0").select(F.upper("name").alias("name"))
    return filters.discovery_candidates(listed(t), tracked, "greenhouse").select("company_id", "website")


@query(
    "registry_aliases",
    """SELECT DISTINCT company_name, alias FROM (SELECT name AS company_name, unnest([lower(name), replace(lower(name), '.', ''), translate(lower(name), '.-', '  '), 'the ' || slug]) AS alias FROM companies) AS x WHERE alias <> ''""",
)
def registry_aliases(t: Tables):
    """S13"""
    return registry.registry_aliases(t.companies.select("name", F.array(F.concat(F.lit("The "), "slug")).alias("aliases")))


@query(
    "canonical_page_urls",
    f"""SELECT company_id, CASE WHEN {any_sql("lower(page)", lex.CANONICAL_URL_WORDS)} AND NOT {any_sql("lower(site)", lex.CANONICAL_URL_WORDS)} THEN page ELSE site END AS url
    FROM (SELECT company_id, {PAGES} AS page, {SITES} AS site FROM companies) AS x""",
)
def canonical_page_urls(t: Tables):
    """P10"""
    return listed(t).select("company_id", filters.canonical_page_url(F.col("career_page_url"), F.col("website")).alias("url"))


# --- text helpers ----------------------------------------------------------------------------


@query(
    "spelling_variants",
    """WITH w AS (SELECT p_partkey, list_concat(string_split(p_name, ' '), [upper(split_part(p_name, ' ', 1)), ' ', 'x' || p_size]) AS words FROM part),
    k AS (SELECT p_partkey, list_filter(list_transform(words, lambda x: trim(x)), lambda x: x <> '') AS words FROM w)
    SELECT p_partkey, array_to_string(list_filter(words, lambda x, i: list_position(list_transform(words, lambda y: lower(y)), lower(x)) = i), ',') AS words FROM k""",
)
def spelling_variants(t: Tables):
    """P25"""
    words = F.concat(F.split("p_name", " "), F.array(F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))), F.lit(" "), F.concat(F.lit("x"), F.col("p_size").cast("string"))))
    return t.part.select("p_partkey", F.array_join(text.distinct_ignoring_case(words), ",").alias("words"))


@query("stage_names", "SELECT c_custkey, replace(lower(trim(c_mktsegment || ' A')), ' ', '_') AS key, lower(trim(c_mktsegment || ' A')) AS words FROM customer")
def stage_names(t: Tables):
    """P25, there and back."""
    key = text.stage_key(F.concat("c_mktsegment", F.lit(" A")))
    return t.customer.select("c_custkey", key.alias("key"), text.stage_words(key).alias("words"))


@query(
    "source_hosts",
    r"""SELECT page_id, regexp_replace(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#:]+)', 1)), '^www\.', ''), '^jobs\.', ''), '^news\.', '') AS host FROM pages""",
)
def source_hosts(t: Tables):
    """P26"""
    return t.pages.select("page_id", text.source_host(F.col("url")).alias("host"))


LISTED_TYPES = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lex.LISTING_ROLE_TYPE_MAP.items())
LISTED_NAMES = tuple(lex.LISTING_ROLE_TYPE_MAP)


@query(
    "listing_role_types",
    f"""WITH l AS (SELECT role_id, title, list_extract({list(LISTED_NAMES)}, CAST(role_id % {len(LISTED_NAMES) + 1} + 1 AS BIGINT)) AS listed FROM roles)
    SELECT role_id, CASE WHEN {ladder_sql("lower(title)", lex.ROLE_TYPE_WORDS, "unknown")} <> 'unknown' THEN {ladder_sql("lower(title)", lex.ROLE_TYPE_WORDS, "unknown")}
      ELSE coalesce(CASE listed {LISTED_TYPES} END, 'unknown') END AS role_type FROM l""",
)
def listing_role_types(t: Tables):
    """P28"""
    names = F.array(*[F.lit(n) for n in LISTED_NAMES])
    said = F.upper(F.get(names, (F.col("role_id") % (len(LISTED_NAMES) + 1)).cast("int")))
    return t.roles.select("role_id", titles.listing_role_type(F.col("title"), said).alias("role_type"))


# --- children, run steps ---------------------------------------------------------------------


@query(
    "companies_with_signals",
    """WITH s AS (SELECT company_id, signal_id, row_number() OVER (PARTITION BY company_id ORDER BY signal_date DESC, signal_id) AS rank FROM signals)
    SELECT c.company_id, coalesce(string_agg(CAST(signal_id AS VARCHAR), ',' ORDER BY rank), '') AS signals FROM companies c LEFT JOIN s ON c.company_id = s.company_id AND rank <= 3 GROUP BY c.company_id""",
)
def companies_with_signals(t: Tables):
    """The three newest signals inside each company."""
    newest = ranking.top_k(t.signals, ["company_id"], [F.desc("signal_date"), F.asc("signal_id")], 3).select("company_id", "rank", "signal_id")
    nested = joins.with_children(t.companies.select("company_id"), {"children": newest})
    return nested.select("company_id", F.array_join(F.transform("children", lambda c: c["signal_id"].cast("string")), ",").alias("signals"))


@query(
    "last_signal_bumped",
    f"""SELECT company_id, CASE WHEN company_id IN (SELECT company_id FROM signals WHERE type = 'funding') THEN {NOW} END AS last_signal_at FROM companies""",
)
def last_signal_bumped(t: Tables):
    """M11"""
    companies = t.companies.select("company_id", F.lit(None).cast("timestamp_ntz").alias("last_signal_at"))
    return merge.bump_last_signal(companies, t.signals.where("type = 'funding'"), AS_OF)


@query(
    "resolved_companies",
    "SELECT r.role_id, c.company_id FROM roles r JOIN companies c USING (company_id) WHERE r.role_id % 3 <> 2",
)
def resolved_companies(t: Tables):
    """By name in any case, by slug, or not at all."""
    named = t.roles.join(t.companies.select("company_id", "name", "slug"), "company_id")
    said = F.when(F.col("role_id") % 3 == 0, F.upper("name")).when(F.col("role_id") % 3 == 1, F.col("slug")).otherwise(F.concat(F.lit("no "), "name"))
    staged = named.select("role_id", said.alias("company_name"))
    return joins.resolve_company(staged, t.companies).select("role_id", "company_id")


# --- stream folds (T2, T3) --------------------------------------------------------------------


def batches(t: Tables):
    """Signals as published payloads in two batches."""
    rows = joins.with_company_name(t.signals, t.companies).select(
        F.col("signal_id").cast("string").alias("id"), F.col("company_id").cast("string").alias("company_id"), "company_name", F.col("type").alias("type_label"), "headline", "score",
        F.date_format("signal_date", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("signal_date"), (F.col("signal_id") % 2).alias("batch"),
    )
    return rows.where("batch = 0").drop("batch"), rows.where("batch = 1").drop("batch")


STREAM_SQL = """p AS (SELECT CAST(signal_id AS VARCHAR) AS id, CAST(company_id AS VARCHAR) AS company_id, headline, strftime(signal_date, '%Y-%m-%dT%H:%M:%S.%f') AS signal_date, signal_id % 2 AS batch_id
    FROM signals JOIN companies USING (company_id))"""


@query(
    "live_counts",
    f"""WITH {STREAM_SQL} SELECT company_id, count(*) AS signal_count, arg_max(headline, (batch_id, signal_date, id)) AS latest_signal, max((batch_id, signal_date))[2] AS latest_at FROM p GROUP BY company_id""",
)
def live_counts(t: Tables):
    """Two batches folded into counts and latest headlines."""
    first, second = batches(t)
    return live.fold_counts(live.fold_counts(None, first), second)


@query(
    "live_history",
    f"""WITH {STREAM_SQL} SELECT company_id, id, CAST(n AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY batch_id DESC, signal_date DESC, id DESC) AS n FROM p) AS x WHERE n <= 8""",
)
def live_history(t: Tables):
    """The last eight signals of every company."""
    first, second = batches(t)
    return live.fold_history(live.fold_history(None, first, 0), second, 1).select("company_id", "id", "rank")


@query("live_feed_fold", f"WITH {STREAM_SQL} SELECT id, company_id, signal_date, batch_id FROM p ORDER BY batch_id DESC, signal_date DESC, id DESC LIMIT 30")
def live_feed_fold(t: Tables):
    """The last thirty signals of all companies."""
    first, second = batches(t)
    return live.fold_feed(live.fold_feed(None, first, 0), second, 1).select("id", "company_id", "signal_date", "batch_id")
