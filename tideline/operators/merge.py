"""Batch merges of staged rows into state tables.

Each merge is a function from (state, staged) to the new state or to the rows to
add; `sources.store` writes results. A batch may hold a key many times: it is
first collapsed with mergeable aggregates to what applying its rows in ``seq``
order would leave, so neither a window nor a list ever holds all rows of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline import session
from tideline.functions.clock import age_days, instant
from tideline.functions.numbers import truthy
from tideline.functions.text import company_slug, cut, job_slug, signal_key
from tideline.operators.ranking import first_wins

STACK_PARTS = ("languages", "frameworks", "infra")


def _given(c: Column) -> Column:
    """A text value that may overwrite: not null, not empty."""
    return c.isNotNull() & (c != "")


def _last(c: Column, condition: Column, seq: str) -> Column:
    return F.max_by(F.when(condition, c), F.when(condition, F.col(seq)))


def _first(c: Column, seq: str) -> Column:
    return F.min_by(c, F.col(seq))


# --- companies (M1, U3) ---------------------------------------------------------

OVERWRITE_TEXT = ("website", "career_page_url", "github_org", "description")
INSERT_ONLY = ("name", "hq_city", "hq_country")


def stack_words(df: DataFrame, key: str = "slug") -> DataFrame:
    """Distinct (key, part, word) of the ``tech_stack`` column."""

    def tagged(part: str) -> Column:
        words = F.coalesce(f"tech_stack.{part}", F.array().cast("array<string>"))
        return F.transform(words, lambda w: F.struct(F.lit(part).alias("part"), w.alias("word")))

    parts = [tagged(p) for p in STACK_PARTS]
    return df.select(key, F.inline(F.concat(*parts))).where(F.col("word") != "").distinct()


def stack_of(words: DataFrame, key: str = "slug") -> DataFrame:
    """Back to one struct of sorted arrays per key (vocabulary-sized)."""
    return words.groupBy(key).agg(
        F.struct(
            *[F.sort_array(F.collect_set(F.when(F.col("part") == p, F.col("word")))).alias(p) for p in STACK_PARTS]
        ).alias("tech_stack")
    )


def collapse_companies(staged: DataFrame, seq: str = "seq") -> DataFrame:
    """One row per slug: what inserting the first row and updating with the rest
    would leave."""
    staged = staged.withColumn("slug", company_slug(F.col("name")))
    known_stage = F.coalesce("funding_stage", F.lit("unknown")) != "unknown"
    rows = staged.groupBy("slug").agg(
        *[F.nullif(_first(F.col(c), seq), F.lit("")).alias(c) for c in INSERT_ONLY],
        *[_last(F.col(c), _given(F.col(c)), seq).alias(c) for c in OVERWRITE_TEXT],
        F.coalesce(_last(F.col("funding_stage"), known_stage, seq), F.lit("unknown")).alias("funding_stage"),
        F.coalesce(_last(F.col("funding_amount_usd"), truthy(F.col("funding_amount_usd")), seq), _first(F.col("funding_amount_usd"), seq)).alias("funding_amount_usd"),
        _last(F.col("last_funding_date"), F.col("last_funding_date").isNotNull(), seq).alias("last_funding_date"),
        F.coalesce(_last(F.col("headcount"), truthy(F.col("headcount")), seq), _first(F.col("headcount"), seq)).alias("headcount"),
        F.coalesce(F.bool_or("remote_us"), F.lit(False)).alias("remote_us"),
        F.coalesce(F.bool_or("remote_friendly"), F.lit(False)).alias("remote_friendly"),
        F.count(F.lit(1)).alias("staged_rows"),
    )
    return rows.join(stack_of(stack_words(staged)), "slug", "left").withColumn(
        "hq_country", F.coalesce("hq_country", F.lit("United States"))
    )


def merge_companies(companies: DataFrame, staged: DataFrame, as_of: str, seq: str = "seq") -> DataFrame:
    """M1: the new companies table. Given values overwrite, an unknown stage or an
    empty value never does, flags are OR-ed, stacks united, and name, city and
    country are set on insert only. Columns that staging does not know are kept."""
    new = collapse_companies(staged, seq)
    old, inc = companies.alias("o"), new.alias("n")
    joined = old.join(inc, F.col("o.slug") == F.col("n.slug"), "full_outer")
    exists = F.col("o.slug").isNotNull()
    merged: dict[str, Column] = {"slug": F.coalesce("o.slug", "n.slug")}
    for c in INSERT_ONLY:
        merged[c] = F.when(exists, F.col(f"o.{c}")).otherwise(F.col(f"n.{c}"))
    for c in OVERWRITE_TEXT + ("last_funding_date",):
        merged[c] = F.coalesce(f"n.{c}", f"o.{c}")
    merged["funding_stage"] = F.when(F.coalesce("n.funding_stage", F.lit("unknown")) != "unknown", F.col("n.funding_stage")).otherwise(
        F.coalesce("o.funding_stage", F.lit("unknown"))
    )
    for c in ("funding_amount_usd", "headcount"):
        merged[c] = F.when(~exists | truthy(F.col(f"n.{c}")), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    for c in ("remote_us", "remote_friendly"):
        merged[c] = F.coalesce(f"o.{c}", F.lit(False)) | F.coalesce(f"n.{c}", F.lit(False))
    empty = F.array().cast("array<string>")
    merged["tech_stack"] = F.struct(
        *[
            F.sort_array(
                F.array_union(F.coalesce(f"o.tech_stack.{p}", empty), F.coalesce(f"n.tech_stack.{p}", empty))
            ).alias(p)
            for p in STACK_PARTS
        ]
    )
    if "company_id" in companies.columns:
        made = F.substring(F.sha2("n.slug", 256), 1, 32)
        merged["company_id"] = F.coalesce("o.company_id", made)
    if "updated_at" in companies.columns:
        merged["updated_at"] = F.when(F.col("n.slug").isNotNull(), instant(as_of)).otherwise(F.col("o.updated_at"))
    return joined.select(*[merged.get(c, F.col(f"o.{c}")).alias(c) for c in companies.columns])


# --- signals (M2, J4, M11) ---------------------------------------------------------


def new_signals(
    staged: DataFrame, stored: DataFrame, seq: str = "seq", headline_length: int | None = None, detail_length: int | None = None
) -> DataFrame:
    """Staged rows (company_id, company_name, type, ..., seq) whose key is not
    stored yet, first occurrence only. Undated signals have a null day and are found
    among the stored ones without a day.

    The key holds the date of the signal, so a duplicate can only lie in the same
    ``signal_day``; with the stored table partitioned by that column the lookup
    reads the batch's days and nothing else."""
    keyed = staged.withColumns(
        {
            "dedup_key": signal_key(F.col("company_name"), F.col("type"), F.col("source_url"), F.col("signal_date")),
            "signal_day": F.to_date("signal_date"),
        }
    )
    keys = ["company_id", "signal_day", "dedup_key"]
    held = stored.select(*[F.col(k).alias(f"_{k}") for k in keys])
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    fresh = keyed.join(held, same[0] & same[1] & same[2], "left_anti")
    return first_wins(fresh, keys, [seq]).withColumns(
        {"headline": cut(F.col("headline"), headline_length), "detail": cut(F.col("detail"), detail_length)}
    )


def bump_last_signal(companies: DataFrame, added: DataFrame, as_of: str) -> DataFrame:
    """Companies with a new signal get ``last_signal_at`` = now."""
    hit = added.select("company_id").distinct().withColumn("_hit", F.lit(True))
    return (
        companies.join(hit, "company_id", "left")
        .withColumn("last_signal_at", F.when(F.col("_hit"), instant(as_of)).otherwise(F.col("last_signal_at")))
        .drop("_hit")
    )


# --- roles (M3, M4, J5) ---------------------------------------------------------

ROLE_OVERWRITE = ("title", "source", "role_type", "seniority", "is_remote", "is_remote_us", "ingest_source")
ROLE_KEEP_IF_EMPTY = ("external_id", "location", "description_raw")


def collapse_roles(staged: DataFrame, seq: str = "seq") -> DataFrame:
    latest = F.struct(*ROLE_OVERWRITE, "tech_stack", "required_skills")
    rows = staged.where(_given(F.col("url"))).groupBy("url").agg(
        _first(F.col("company_id"), seq).alias("company_id"),
        F.max_by(latest, F.col(seq)).alias("latest"),
        *[_last(F.col(c), _given(F.col(c)), seq).alias(c) for c in ROLE_KEEP_IF_EMPTY],
        F.count(F.lit(1)).alias("staged_rows"),
    )
    return rows.select("url", "company_id", "latest.*", *ROLE_KEEP_IF_EMPTY, "staged_rows")


def merge_roles(roles: DataFrame, staged: DataFrame, as_of: str, seq: str = "seq") -> DataFrame:
    """M3: the new roles table plus ``is_new`` and ``staged_rows`` for the run
    summary. Seen roles are active again and lose ``removed_at`` (Q17)."""
    now = instant(as_of)
    joined = roles.alias("o").join(collapse_roles(staged, seq).alias("n"), F.col("o.url") == F.col("n.url"), "full_outer")
    seen, exists = F.col("n.url").isNotNull(), F.col("o.url").isNotNull()
    first_seen = F.coalesce("o.first_seen_at", now)
    out: dict[str, Column] = {
        "url": F.coalesce("o.url", "n.url"),
        "company_id": F.coalesce("o.company_id", "n.company_id"),
        "first_seen_at": first_seen,
        "last_seen_at": F.when(seen, now).otherwise(F.col("o.last_seen_at")),
        "is_active": F.when(seen, F.lit(True)).otherwise(F.col("o.is_active")),
        "removed_at": F.when(~seen, F.col("o.removed_at")),
        "days_open": F.when(seen & exists, age_days(first_seen, now)).when(seen, 0).otherwise(F.col("o.days_open")),
        "role_id": F.coalesce("o.role_id", F.substring(F.sha2("n.url", 256), 1, 32)),
    }
    for c in (*ROLE_OVERWRITE, "tech_stack", "required_skills"):
        out[c] = F.when(seen, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}"))
    for c in ROLE_KEEP_IF_EMPTY:
        out[c] = F.coalesce(f"n.{c}", f"o.{c}")
    columns = [out.get(c, F.col(f"o.{c}")).alias(c) for c in roles.columns]
    return joined.select(*columns, (seen & ~exists).alias("is_new"), F.coalesce("n.staged_rows", F.lit(0)).alias("staged_rows"))


def deactivate_missing(
    roles: DataFrame, crawled: DataFrame, listed: DataFrame, ingest_source: str, as_of: str
) -> DataFrame:
    """Active roles of the ``crawled`` companies (company_id) that came
    from ``ingest_source`` and whose url is not ``listed`` (company_id, url) become
    inactive; a crawled company without listed urls loses all of them."""
    mine = crawled.select("company_id").distinct().withColumn("_crawled", F.lit(True))
    here = listed.select("company_id", "url").distinct().withColumn("_listed", F.lit(True))
    marked = roles.join(mine, "company_id", "left").join(here, ["company_id", "url"], "left")
    gone = (
        F.col("is_active") & (F.col("ingest_source") == ingest_source) & F.col("_crawled").isNotNull() & F.col("_listed").isNull()
    )
    gone = F.coalesce(gone, F.lit(False))
    return marked.withColumns(
        {"removed_at": F.when(gone, instant(as_of)).otherwise(F.col("removed_at")), "is_active": F.when(gone, False).otherwise(F.col("is_active"))}
    ).select(*roles.columns)


# --- funding history (M5) ---------------------------------------------------------

FUNDING_KEY = ("company_id", "announced_at", "round_type", "amount_usd", "source")


def funding_events(added_signals: DataFrame, source: str) -> DataFrame:
    """Funding events of newly added signals, as rows to merge."""
    return added_signals.where(F.col("type") == "funding").select(
        "company_id",
        F.col("signal_date").alias("announced_at"),
        F.nullif(F.coalesce("funding_round", F.lit("")), F.lit("")).alias("round_type"),
        F.col("funding_amount_usd").alias("amount_usd"),
        F.lit(source).alias("source"),
        "source_url",
        F.array().cast("array<string>").alias("lead_investors"),
        "seq",
    )


def merge_funding(history: DataFrame, staged: DataFrame, seq: str = "seq") -> DataFrame:
    """M5: null-safe on the five key columns; urls and investors are refreshed by
    given values."""
    some = F.size("lead_investors") > 0
    new = staged.groupBy(*FUNDING_KEY).agg(
        _last(F.col("source_url"), _given(F.col("source_url")), seq).alias("source_url"),
        _last(F.col("lead_investors"), some, seq).alias("lead_investors"),
    )
    match = F.lit(True)
    for c in FUNDING_KEY:
        match = match & F.col(f"o.{c}").eqNullSafe(F.col(f"n.{c}"))
    marked = new.withColumn("_new", F.lit(True))
    joined = history.withColumn("_old", F.lit(True)).alias("o").join(marked.alias("n"), match, "full_outer")
    take_new = F.col("o._old").isNull()
    out = {c: F.when(take_new, F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")) for c in FUNDING_KEY}
    out["source_url"] = F.coalesce("n.source_url", "o.source_url")
    out["lead_investors"] = F.coalesce("n.lead_investors", "o.lead_investors", F.array().cast("array<string>"))
    return joined.select(*[out.get(c, F.col(f"o.{c}")).alias(c) for c in history.columns])


# --- execution events (M7) ---------------------------------------------------------


def carry_forward(rows: DataFrame, key: str, at: str, tie: str, columns: list[str]) -> DataFrame:
    """Fill blanks of ``columns`` with the last given value before, per key.

    Two levels keep windows small: the last value per key and day runs over at
    most one row per day, and only rows of one day meet in the inner window."""
    day = F.to_date(at)
    order = F.struct(at, tie)
    given = {c: F.col(c).isNotNull() & (F.col(c).cast("string") != "") for c in columns}
    rows = rows.withColumn("_day", day)
    daily = rows.groupBy(key, "_day").agg(*[F.max_by(F.when(given[c], F.col(c)), F.when(given[c], order)).alias(c) for c in columns])
    before = Window.partitionBy(key).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    carried = daily.select(key, "_day", *[F.last(c, ignorenulls=True).over(before).alias(f"_{c}") for c in columns])
    within = Window.partitionBy(key, "_day").orderBy(at, tie).rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.select("*", *[F.last(F.when(given[c], F.col(c)), ignorenulls=True).over(within).alias(f"_in_{c}") for c in columns])
    return filled.join(carried, [key, "_day"]).select(
        *[F.coalesce(f"_in_{c}", f"_{c}").alias(c) if c in columns else F.col(c) for c in rows.columns if c != "_day"]
    )


def append_execution_events(events: DataFrame, added: DataFrame) -> DataFrame:
    """M7: the events table with the added actions; an action without a target role
    or follow-up date takes over the ones in force, and without a label is named
    after its status."""
    named = added.withColumn("label", F.coalesce(F.nullif("label", F.lit("")), F.replace("status", F.lit("_"), F.lit(" "))))
    inherit = ["target_role_title", "target_role_url", "follow_up_due"]
    touched = events.join(added.select("company_id").distinct(), "company_id", "left_semi")
    known = touched.withColumn("_added", F.lit(False)).unionByName(named.withColumn("_added", F.lit(True)))
    filled = carry_forward(known, "company_id", "occurred_at", "event_id", inherit).where("_added").drop("_added")
    return events.unionByName(filled.select(*events.columns))


# --- career-page snapshots (J6, U2, M8) ---------------------------------------------


def _slugged(snapshots: DataFrame) -> DataFrame:
    return snapshots.withColumn("slug", job_slug(F.col("title"))).where(F.col("slug") != "")


def page_jobs(snapshots: DataFrame, *by: str) -> DataFrame:
    """One row per company, title slug (and ``by``) of a snapshot's jobs; of equal slugs
    the last job in page order counts (``pos``), of pages the one with the greater hash."""
    slugged = snapshots if "slug" in snapshots.columns else _slugged(snapshots)
    job = F.struct(*[F.coalesce(c, F.lit("")).alias(c) for c in ("title", "location", "url")])
    return slugged.groupBy("company_id", "slug", *by).agg(F.max_by(job, F.struct("page_hash", "pos")).alias("job"))


def crawl_diffs(crawls: DataFrame) -> DataFrame:
    """J6, U2, Q15 over a history: job rows (company_id, crawl, page_hash, pos, title,
    location, url) to added / removed / changed slugs of every crawl against the one
    numbered before. Companies without the earlier crawl and pairs of crawls with equal
    page hashes are left out. A crawl of a company must carry a row even when it lists
    no job (title null).

    Jobs are dealt by company and slug once. There they are reduced to one row per crawl,
    and a slug's crawls in order tell both what a row changed and where it is missing
    next; no crawl is joined with the other. Which pairs of crawls count is decided on one
    narrow row per company and crawl."""
    hashes = crawls.groupBy("company_id", "crawl").agg(F.sort_array(F.collect_set("page_hash")).alias("hashes"))
    by_crawl = Window.partitionBy("company_id").orderBy("crawl")  # one row per crawl
    pairs = hashes.withColumns({"_last": F.lag("crawl").over(by_crawl), "_before": F.lag("hashes").over(by_crawl)})
    moved = pairs.where((F.col("_last") == F.col("crawl") - 1) & (F.col("hashes") != F.col("_before"))).select("company_id", "crawl")
    jobs = page_jobs(_slugged(crawls).repartition("company_id", "slug"), "crawl")
    of_slug = Window.partitionBy("company_id", "slug").orderBy("crawl")  # one row per crawl
    seen = jobs.withColumns({"_last": F.lag("crawl").over(of_slug), "_old": F.lag("job").over(of_slug), "_next": F.lead("crawl").over(of_slug)})
    here = F.when(F.coalesce(F.col("_last") == F.col("crawl") - 1, F.lit(False)), F.when(F.col("job") != F.col("_old"), "changed")).otherwise("added")
    gone = F.when(~F.coalesce(F.col("_next") == F.col("crawl") + 1, F.lit(False)), "removed")
    events = F.array(F.struct(F.col("crawl").alias("crawl"), here.alias("status")), F.struct((F.col("crawl") + 1).alias("crawl"), gone.alias("status")))
    flat = seen.select("company_id", "slug", "job", F.inline(events)).where("status is not null")
    return flat.join(moved, ["company_id", "crawl"], "left_semi").select("company_id", "crawl", "slug", "status", "job.title", "job.location", "job.url")


def snapshot_diff(previous: DataFrame, current: DataFrame) -> DataFrame:
    """Job rows (company_id, page_hash, pos, title, location, url) of two
    crawls to added / removed / changed slugs. Companies without an earlier crawl
    and companies none of whose page hashes changed are left out. ``current`` must carry
    a row per crawled company even when it lists no job (title null). Rows are stored
    once: the diff reads them for the hashes and for the jobs."""
    columns = ["company_id", "page_hash", "pos", "title", "location", "url"]
    both = previous.select(*columns).withColumn("crawl", F.lit(0)).unionByName(current.select(*columns).withColumn("crawl", F.lit(1)))
    return crawl_diffs(session.stored(both, "crawls")).where("crawl = 1").drop("crawl")


def latest_snapshots(stored: DataFrame, crawled: DataFrame) -> DataFrame:
    """M8: crawled companies' snapshots replace their stored ones."""
    kept = stored.join(crawled.select("company_name").distinct(), "company_name", "left_anti")
    return kept.unionByName(crawled.select(*stored.columns))


# --- updates by key (M9) -------------------------------------------------------------


def apply_updates(table: DataFrame, updates: DataFrame, key: str) -> DataFrame:
    """M9: columns of ``updates`` replace those of the row with the same key; a null
    leaves the old value. ``updates`` holds each key once."""
    changed = [c for c in updates.columns if c != key]
    joined = table.alias("t").join(updates.alias("u"), key, "left")
    return joined.select(
        *[F.coalesce(f"u.{c}", f"t.{c}").alias(c) if c in changed else F.col(key if c == key else f"t.{c}") for c in table.columns]
    )


def watchlist_updates(decided: DataFrame, as_of: str) -> DataFrame:
    """Column updates of `rules.apply_rules`: flag, stamp of joining the list, and
    priority, which leaving the list resets to 0."""
    return decided.where("watchlist_add OR watchlist_remove OR priority_change").select(
        "company_id",
        F.col("now_watched").alias("on_watchlist"),
        F.when(F.col("watchlist_add"), instant(as_of)).alias("watchlist_added_at"),
        F.when(F.col("watchlist_remove"), 0).otherwise(F.col("priority")).alias("watchlist_priority"),
    )


def outreach_status_updates(outreach: DataFrame, updates: DataFrame, as_of: str) -> DataFrame:
    """Outreach rows with new status and notes (outreach_id, status, notes); sent and
    responded are stamped."""
    now = instant(as_of)
    stamped = updates.select(
        "outreach_id",
        "status",
        F.nullif("notes", F.lit("")).alias("notes"),
        F.when(F.col("status") == "sent", now).alias("sent_at"),
        F.when(F.col("status") == "responded", now).alias("responded_at"),
    )
    return apply_updates(outreach, stamped, "outreach_id")
