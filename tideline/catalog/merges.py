"""Merges, diffs, dedupe, activity and text matching."""

from __future__ import annotations

from pyspark.sql import functions as F

from tideline.catalog.registry import query
from tideline.functions import lexicons as lex
from tideline.functions import scores
from tideline.functions.clock import instant
from tideline.functions.text import signal_key
from tideline.operators import activity, joins, mentions, merge, ranking
from tideline.tables import AS_OF, AS_OF_DATE, Dialect, Tables

D = Dialect("duckdb")
NOW = D.now


@query(
    "snapshot_diff",
    """WITH jobs AS (SELECT company_id, crawl, trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') AS slug,
        title || '|' || location || '|' || url AS pos, title, location, url FROM snapshot_jobs),
    side AS (SELECT company_id, crawl, slug, arg_max(title, pos) AS title, arg_max(location, pos) AS location, arg_max(url, pos) AS url FROM jobs GROUP BY ALL),
    pairs AS (SELECT DISTINCT n.company_id, n.crawl FROM jobs n JOIN jobs o ON n.company_id = o.company_id AND n.crawl = o.crawl + 1),
    old AS (SELECT p.company_id, p.crawl, slug, title, location, url FROM pairs p JOIN side s ON s.company_id = p.company_id AND s.crawl = p.crawl - 1),
    new AS (SELECT p.company_id, p.crawl, slug, title, location, url FROM pairs p JOIN side s ON s.company_id = p.company_id AND s.crawl = p.crawl)
    SELECT coalesce(n.company_id, o.company_id) AS company_id, coalesce(n.crawl, o.crawl) AS crawl, coalesce(n.slug, o.slug) AS slug,
      CASE WHEN o.slug IS NULL THEN 'added' WHEN n.slug IS NULL THEN 'removed' ELSE 'changed' END AS status,
      coalesce(n.title, o.title) AS title, coalesce(n.location, o.location) AS location, coalesce(n.url, o.url) AS url
    FROM old o FULL JOIN new n ON o.company_id = n.company_id AND o.crawl = n.crawl AND o.slug = n.slug
    WHERE o.slug IS NULL OR n.slug IS NULL OR o.title <> n.title OR o.location <> n.location OR o.url <> n.url""",
)
def snapshot_diff(t: Tables):
    """Every crawl against the one of the year before."""
    jobs = t.snapshot_jobs.select("company_id", "crawl", F.col("crawl").cast("string").alias("page_hash"), F.concat_ws("|", "title", "location", "url").alias("pos"), "title", "location", "url")
    return merge.crawl_diffs(jobs)


@query(
    "company_merge",
    """WITH old AS (SELECT * FROM companies WHERE company_id % 3 <> 0),
    inc AS (SELECT slug, name, CASE WHEN company_id % 2 = 0 THEN funding_stage ELSE 'unknown' END AS stage, CASE WHEN company_id % 4 = 0 THEN funding_amount_usd * 2 END AS amount,
        CASE WHEN company_id % 4 = 1 THEN 'https://' || slug || '.example' ELSE '' END AS website, company_id % 5 = 0 AS remote_us, stack_infra FROM companies WHERE company_id % 3 <> 1)
    SELECT coalesce(o.slug, n.slug) AS slug, coalesce(o.name, n.name) AS name,
      CASE WHEN coalesce(n.stage, 'unknown') <> 'unknown' THEN n.stage ELSE coalesce(o.funding_stage, 'unknown') END AS funding_stage,
      CASE WHEN o.slug IS NULL OR n.amount <> 0 THEN n.amount ELSE o.funding_amount_usd END AS funding_amount_usd,
      nullif(n.website, '') AS website, coalesce(o.remote_us, false) OR coalesce(n.remote_us, false) AS remote_us,
      array_to_string(list_sort(list_distinct([x FOR x IN [o.stack_infra, n.stack_infra] IF x IS NOT NULL])), ',') AS infra
    FROM old o FULL JOIN inc n ON o.slug = n.slug""",
)
def company_merge(t: Tables):
    none, empty = F.lit(None), F.array().cast("array<string>")
    old = t.companies.where("company_id % 3 <> 0").select(
        "slug", "name", none.cast("string").alias("website"), none.cast("string").alias("career_page_url"),
        none.cast("string").alias("github_org"), none.cast("string").alias("description"), "funding_stage",
        "funding_amount_usd", none.cast("timestamp_ntz").alias("last_funding_date"), none.cast("string").alias("hq_city"),
        "hq_country", F.lit(False).alias("remote_friendly"), "remote_us", "headcount",
        F.struct(empty.alias("languages"), empty.alias("frameworks"), F.array("stack_infra").alias("infra")).alias("tech_stack"),
    )
    inc = t.companies.where("company_id % 3 <> 1").select(
        "name", F.expr("CASE WHEN company_id % 4 = 1 THEN concat('https://', slug, '.example') ELSE '' END").alias("website"),
        F.lit("").alias("career_page_url"), F.lit("").alias("github_org"), F.lit("").alias("description"),
        F.expr("CASE WHEN company_id % 2 = 0 THEN funding_stage ELSE 'unknown' END").alias("funding_stage"),
        F.expr("CASE WHEN company_id % 4 = 0 THEN funding_amount_usd * 2 END").alias("funding_amount_usd"),
        none.cast("timestamp_ntz").alias("last_funding_date"), F.lit("").alias("hq_city"), F.lit("").alias("hq_country"),
        F.lit(False).alias("remote_friendly"), F.expr("company_id % 5 = 0").alias("remote_us"), "headcount",
        F.struct(empty.alias("languages"), empty.alias("frameworks"), F.array("stack_infra").alias("infra")).alias("tech_stack"),
        F.col("company_id").alias("seq"),
    )
    return merge.merge_companies(old, inc, AS_OF).select(
        "slug", "name", "funding_stage", "funding_amount_usd", "website", "remote_us", F.array_join("tech_stack.infra", ",").alias("infra")
    )


SIGNAL_KEY_SQL = "substr(sha256(coalesce(name, '') || ':' || type || ':' || source_url || ':' || CAST(CAST(signal_date AS DATE) AS VARCHAR)), 1, 16)"


@query(
    "signals_dedup",
    f"""WITH named AS (SELECT s.*, c.name, concat('https://news.example/', CAST(signal_id % 700 AS VARCHAR)) AS url FROM signals s JOIN companies c USING (company_id)),
    stored AS (SELECT DISTINCT company_id, {SIGNAL_KEY_SQL.replace('source_url', 'url')} AS dedup_key FROM named WHERE signal_date < TIMESTAMP '2024-01-15 12:00:00'),
    staged AS (SELECT *, {SIGNAL_KEY_SQL.replace('source_url', 'url')} AS dedup_key FROM named WHERE signal_date >= TIMESTAMP '2024-01-13 00:00:00')
    SELECT company_id, dedup_key, min(signal_id) AS signal_id FROM staged
    WHERE (company_id, dedup_key) NOT IN (SELECT company_id, dedup_key FROM stored) GROUP BY company_id, dedup_key""",
)
def signals_dedup(t: Tables):
    named = joins.with_company_name(t.signals, t.companies).withColumns(
        {
            "source_url": F.concat(F.lit("https://news.example/"), (F.col("signal_id") % 700).cast("string")),
            "detail": F.lit(""),
            "seq": F.col("signal_id"),
        }
    )
    stored = named.where("signal_date < TIMESTAMP_NTZ '2024-01-15 12:00:00'").select(
        "company_id",
        F.to_date("signal_date").alias("signal_day"),
        signal_key(F.col("company_name"), F.col("type"), F.col("source_url"), F.col("signal_date")).alias("dedup_key"),
    )
    staged = named.where("signal_date >= TIMESTAMP_NTZ '2024-01-13 00:00:00'")
    return merge.new_signals(staged, stored).select("company_id", "dedup_key", "signal_id")


@query(
    "role_merge",
    f"""WITH old AS (SELECT url, company_id, role_id, title, first_seen_at, removed_at, is_active, days_open FROM role_state WHERE role_id % 4 <> 0),
    inc AS (SELECT url, company_id, title FROM role_state WHERE role_id % 3 = 0 OR role_id % 4 = 0)
    SELECT coalesce(o.url, n.url) AS url, coalesce(n.title, o.title) AS title, coalesce(o.first_seen_at, {NOW}) AS first_seen_at,
      CASE WHEN n.url IS NULL THEN o.removed_at END AS removed_at, CASE WHEN n.url IS NOT NULL THEN true ELSE o.is_active END AS is_active,
      CASE WHEN n.url IS NOT NULL AND o.url IS NULL THEN 0 ELSE o.days_open END AS days_open, n.url IS NOT NULL AND o.url IS NULL AS is_new
    FROM old o FULL JOIN inc n ON o.url = n.url""",
)
def role_merge(t: Tables):
    none, empty = F.lit(None).cast("string"), F.array().cast("array<string>")
    full = t.role_state.select(
        "url", "company_id", "role_id", "title", "source", "role_type", "seniority", "is_remote", "is_remote_us",
        F.lit("boards").alias("ingest_source"), none.alias("external_id"), none.alias("location"), none.alias("description_raw"),
        F.struct(empty.alias("languages"), empty.alias("frameworks"), empty.alias("infra")).alias("tech_stack"),
        empty.alias("required_skills"), "first_seen_at", F.col("first_seen_at").alias("last_seen_at"), "removed_at", "is_active", "days_open",
    )
    old = full.where("role_id % 4 <> 0").withColumn("role_id", F.col("role_id").cast("string"))
    inc = full.where("role_id % 3 = 0 OR role_id % 4 = 0").withColumn("seq", F.col("role_id"))
    return merge.merge_roles(old, inc, AS_OF).select("url", "title", "first_seen_at", "removed_at", "is_active", "days_open", "is_new")


@query(
    "deactivated_roles",
    f"""SELECT role_id, is_active AND NOT (source = 'career_page' AND company_id % 2 = 0 AND role_id % 3 <> 0) AS is_active,
      CASE WHEN is_active AND source = 'career_page' AND company_id % 2 = 0 AND role_id % 3 <> 0 THEN {NOW} ELSE removed_at END AS removed_at FROM role_state""",
)
def deactivated_roles(t: Tables):
    roles = t.role_state.withColumn("ingest_source", F.col("source"))
    crawled = t.companies.where("company_id % 2 = 0").select("company_id")
    listed = t.role_state.where("company_id % 2 = 0 AND role_id % 3 = 0").select("company_id", "url")
    return merge.deactivate_missing(roles, crawled, listed, "career_page", AS_OF).select("role_id", "is_active", "removed_at")


@query(
    "funding_merge",
    """WITH old AS (SELECT company_id, announced_at, round_type, amount_usd, source FROM funding_history WHERE announced_at < TIMESTAMP '2024-01-18 00:00:00'),
    inc AS (SELECT company_id, announced_at, round_type, amount_usd, source FROM funding_history WHERE announced_at >= TIMESTAMP '2024-01-12 00:00:00')
    SELECT * FROM old UNION SELECT * FROM inc""",
)
def funding_merge(t: Tables):
    full = t.funding_history.withColumn("lead_investors", F.array().cast("array<string>"))
    old = full.where("announced_at < TIMESTAMP_NTZ '2024-01-18 00:00:00'")
    inc = full.where("announced_at >= TIMESTAMP_NTZ '2024-01-12 00:00:00'").withColumn("seq", F.lit(1))
    return merge.merge_funding(old, inc).select(*merge.FUNDING_KEY)


@query(
    "execution_inherited",
    """WITH filled AS (SELECT company_id, event_id, status, occurred_at,
        last_value(target_role_title IGNORE NULLS) OVER w AS target_role_title, last_value(follow_up_due IGNORE NULLS) OVER w AS follow_up_due
      FROM execution_events WINDOW w AS (PARTITION BY company_id ORDER BY occurred_at, event_id ROWS UNBOUNDED PRECEDING))
    SELECT company_id, event_id, replace(status, '_', ' ') AS label, target_role_title, follow_up_due FROM filled WHERE occurred_at >= TIMESTAMP '2024-01-04 00:00:00'""",
)
def execution_inherited(t: Tables):
    none = F.lit(None).cast("string")
    events = t.execution_events.withColumns({"label": none, "target_role_url": none})
    old = events.where("occurred_at < TIMESTAMP_NTZ '2024-01-04 00:00:00'")
    added = events.where("occurred_at >= TIMESTAMP_NTZ '2024-01-04 00:00:00'")
    return (
        merge.append_execution_events(old, added)
        .where("occurred_at >= TIMESTAMP_NTZ '2024-01-04 00:00:00'")
        .select("company_id", "event_id", "label", "target_role_title", "follow_up_due")
    )


@query(
    "union_first_wins",
    """SELECT company_id, arg_min(origin, (prio, id)) AS origin, arg_min(id, (prio, id)) AS id FROM (
      SELECT company_id, 'signal' AS origin, 0 AS prio, signal_id AS id FROM signals WHERE type = 'funding'
      UNION ALL SELECT company_id, 'execution', 1, event_id FROM execution_events UNION ALL SELECT company_id, 'role', 2, role_id FROM roles) AS x GROUP BY company_id""",
)
def union_first_wins(t: Tables):
    sources = [
        t.signals.where("type = 'funding'").select("company_id", F.lit("signal").alias("origin"), F.col("signal_id").alias("id")),
        t.execution_events.select("company_id", F.lit("execution").alias("origin"), F.col("event_id").alias("id")),
        t.roles.select("company_id", F.lit("role").alias("origin"), F.col("role_id").alias("id")),
    ]
    return ranking.union_first_wins(sources, ["company_id"], "id")


@query("two_key_dedupe")
def two_key_dedupe(t: Tables):
    # No SQL check: taking rows in order against two keys is sequential; see the
    # brute-force test.
    pages = t.lineitem.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"), F.col("l_partkey").alias("name"), F.col("l_suppkey").alias("url")
    ).groupBy("seq").agg(F.min("name").alias("name"), F.min("url").alias("url"))
    return ranking.first_wins_two_keys(pages, "name", "url", "seq")


@query(
    "batch_posting",
    """SELECT name AS company_name, count(*) AS n, count(*) || ' engineering roles posted simultaneously — ' ||
      string_agg(CASE WHEN rn <= 3 THEN title END, ', ' ORDER BY rn) AS headline, 88.0::DOUBLE AS score
    FROM (SELECT c.name, r.title, row_number() OVER (PARTITION BY c.name ORDER BY r.role_id) AS rn FROM role_state r JOIN companies c USING (company_id) WHERE r.days_open <= 60) AS x
    GROUP BY name HAVING count(*) >= 3""",
)
def batch_posting(t: Tables):
    recent = joins.with_company_name(t.role_state.where("days_open <= 60"), t.companies)
    return activity.batch_postings(recent, "role_id")


@query(
    "same_day_boost",
    f"""WITH busy AS (SELECT company_id FROM signals WHERE CAST(signal_date AS DATE) = DATE '{AS_OF_DATE}' GROUP BY company_id HAVING count(*) >= 3)
    SELECT signal_id, CASE WHEN company_id IN (SELECT company_id FROM busy) THEN least(score * 1.3::DOUBLE, 100.0) ELSE score END AS score FROM signals""",
)
def same_day_boost(t: Tables):
    return activity.boost_same_day(t.signals, AS_OF_DATE, "company_id").select("signal_id", "score")


@query(
    "busy_days",
    "SELECT company_id, CAST(signal_date AS DATE) AS day, count(*) AS n FROM signals GROUP BY ALL HAVING count(*) >= 3",
)
def busy_days(t: Tables):
    return activity.busy_days(t.signals)


@query(
    "activity_spikes",
    f"""WITH o AS (SELECT company_id, date_diff('day', DATE '{AS_OF_DATE}', CAST(committed_at AS DATE)) + 14 AS off FROM commits),
    s AS (SELECT company_id, {", ".join(f"count(*) FILTER (WHERE off BETWEEN {3*i} AND {3*i+2}) AS w{i}" for i in range(4))},
        count(*) FILTER (WHERE off BETWEEN 11 AND 13) AS recent_commits FROM o WHERE off BETWEEN 0 AND 13 GROUP BY company_id),
    m AS (SELECT *, (w0 + w1 + w2 + w3) / 4 AS baseline FROM s),
    d AS (SELECT *, sqrt(((w0 - baseline) ^ 2 + (w1 - baseline) ^ 2 + (w2 - baseline) ^ 2 + (w3 - baseline) ^ 2) / 3) AS deviation FROM m),
    z AS (SELECT *, (recent_commits - baseline) / greatest(deviation, 0.1) AS sigma FROM d)
    SELECT company_id, recent_commits, baseline, deviation, sigma, sigma >= 2 AND recent_commits >= 10 AS is_spike,
      least(40 + least(sigma * 8, 30) + least(recent_commits / 5, 20), 90) AS score FROM z""",
)
def activity_spikes(t: Tables):
    return activity.commit_activity(t.commits, AS_OF_DATE)


@query(
    "share_top_categories",
    """WITH s AS (SELECT l_suppkey AS company_id, p_brand AS language, sum(CAST(l_quantity AS BIGINT)) AS bytes FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL),
    h AS (SELECT *, bytes / sum(bytes) OVER (PARTITION BY company_id) AS share FROM s)
    SELECT company_id, lower(language) AS language, bytes, share, CAST(rank AS INTEGER) AS rank FROM (
      SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY bytes DESC, language) AS rank FROM h WHERE share > 0.05) AS x WHERE rank <= 6""",
)
def share_top_categories(t: Tables):
    sizes = t.lineitem.join(t.part, F.col("l_partkey") == F.col("p_partkey")).select(
        F.col("l_suppkey").alias("company_id"), F.col("p_brand").alias("language"), F.col("l_quantity").cast("bigint").alias("bytes")
    )
    return activity.language_shares(sizes)


FIRST_WORDS = r"^[^A-Za-z0-9]*([A-Za-z0-9]+[^A-Za-z0-9]+[A-Za-z0-9]+)"
LAST_WORD = r"([^ \n]+)\s*$"
LONG_WORD = r"([A-Za-z0-9]{8,})"


@query(
    "mention_match",
    f"""WITH a AS (SELECT DISTINCT 'item ' || item_id AS company_name, alias FROM (
        SELECT item_id, lower(regexp_extract(text, '{FIRST_WORDS}', 1)) AS alias FROM benchmark
        UNION ALL SELECT item_id, lower(regexp_extract(text, '{LAST_WORD}', 1)) FROM benchmark
        UNION ALL SELECT item_id, lower(unnest(regexp_extract_all(text, '{LONG_WORD}', 1))) FROM benchmark) AS x WHERE alias <> ''),
    hits AS (SELECT doc_id, company_name, length(alias) AS n FROM documents JOIN a ON contains(lower(text), alias)
      WHERE regexp_matches(lower(text), '(^|[^a-z0-9])' || regexp_escape(alias) || '([^a-z0-9]|$)'))
    SELECT doc_id, arg_max(company_name, (n, company_name)) AS company_name FROM hits GROUP BY doc_id""",
)
def mention_match(t: Tables):
    names = F.concat(F.lit("item "), F.col("item_id").cast("string"))
    parts = F.concat(F.array(F.regexp_extract("text", FIRST_WORDS, 1), F.regexp_extract("text", LAST_WORD, 1)), F.regexp_extract_all("text", F.lit(LONG_WORD), F.lit(1)))
    aliases = t.benchmark.select(names.alias("company_name"), F.explode(F.transform(parts, lambda p: F.lower(p))).alias("alias")).where("alias <> ''").distinct()
    return mentions.match_mentions(t.documents, aliases, "doc_id")


def _weights_sql(text: str, table: dict[str, float]) -> str:
    return " + ".join(f"CASE WHEN contains({text}, '{p.replace(chr(39), chr(39) * 2)}') THEN {w} ELSE 0 END" for p, w in table.items())


def _any_sql(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


@query(
    "lexicon_scores",
    f"""WITH d AS (SELECT doc_id, lower(split_part(text, '.', 1)) AS head, lower(split_part(text, '.', 1) || chr(10) || text) AS body,
        CASE WHEN doc_id % 2 = 0 THEN 'founder_post' ELSE 'blog_post' END AS kind, CASE WHEN doc_id % 3 = 0 THEN 'Founder' ELSE '' END AS actor FROM documents)
    SELECT doc_id, CAST(greatest(0, least(95, CASE WHEN kind = 'founder_post' THEN 12 ELSE 6 END + {_weights_sql('body', lex.HIRING_PHRASES)}
      + {_weights_sql('body', lex.ENGINEERING_PHRASES)} + {_weights_sql('body', lex.DOWNRANK_PHRASES)}
      + CASE WHEN {_any_sql('head', lex.TITLE_BONUS_WORDS)} THEN 8 ELSE 0 END + CASE WHEN actor <> '' THEN 4 ELSE 0 END
      - CASE WHEN {_any_sql('body', lex.HIRING_GATE_WORDS)} THEN 0 ELSE 16 END)) AS DOUBLE) AS score,
      concat_ws(',', {", ".join(f"CASE WHEN contains(body, '{p.replace(chr(39), chr(39) * 2)}') THEN '{p.replace(chr(39), chr(39) * 2)}' END" for p in [*lex.HIRING_PHRASES, *lex.ENGINEERING_PHRASES])}) AS hits
    FROM d""",
)
def lexicon_scores(t: Tables):
    head = F.split_part("text", F.lit("."), F.lit(1))
    kind = F.when(F.col("doc_id") % 2 == 0, "founder_post").otherwise("blog_post")
    actor = F.when(F.col("doc_id") % 3 == 0, "Founder").otherwise("")
    scored = scores.with_entry_scores(t.documents.select("doc_id", "text"), head, F.col("text"), kind, actor)
    return scored.select("doc_id", "score", F.array_join("hits", ",").alias("hits"))


@query(
    "signal_decay_scores",
    f"""WITH a AS (SELECT *, {D.days("signal_date", NOW)} AS age FROM signals)
    SELECT signal_id, CASE type WHEN 'funding' THEN (CASE WHEN coalesce(funding_amount_usd, 0) >= 20000000 THEN 70.0 ELSE 50.0 END) * greatest(0.0, 1.0 - age / 60.0)
      WHEN 'founder_post' THEN 80.0 * greatest(0.0, 1.0 - age / 14.0) WHEN 'ats_greenhouse' THEN 65.0 * greatest(0.0, 1.0 - age / 30.0)
      WHEN 'career_page' THEN 60.0 * greatest(0.0, 1.0 - age / 14.0) WHEN 'github_spike' THEN least(40.0 + (score / 10) * 6, 75.0) * greatest(0.0, 1.0 - age / 7.0)
      ELSE 30.0 END AS decayed, greatest(70.0 - age * 1.5, 20.0)::DOUBLE AS board_score FROM a""",
)
def signal_decay_scores(t: Tables):
    now, at = instant(AS_OF), F.col("signal_date")
    decayed = scores.signal_score(F.col("type"), at, now, F.col("funding_amount_usd"), sigma=F.col("score") / 10)
    return t.signals.select("signal_id", decayed.alias("decayed"), scores.ashby_score(at, now).alias("board_score"))
