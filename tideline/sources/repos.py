"""Repository lists, commits and language sizes to staging frames."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions import lexicons as lex
from tideline.functions.clock import instant, parse_instant, shift
from tideline.functions.scores import is_infra_repo
from tideline.functions.text import cut
from tideline.operators.activity import commit_activity, language_shares
from tideline.operators.ranking import top_k
from tideline.schemas import Staged

REPO_LIST = (
    "array<struct<name:string,html_url:string,description:string,fork:boolean,archived:boolean,created_at:string,pushed_at:string>>"
)
COMMIT_LIST = "array<struct<commit:struct<author:struct<date:string>>>>"


def repositories(landed: DataFrame, first: int | None = None) -> DataFrame:
    """Repositories of organisations (landed, company_name, org, body). With ``first``
    the repositories pushed last are numbered up to it, else all are number 1."""
    rows = landed.select("landed", "company_name", "org", F.explode(F.from_json("body", REPO_LIST)).alias("r")).select(
        "landed", "company_name", "org", "r.*"
    )
    if first is None:
        return rows.withColumn("rank", F.lit(1))
    ranked = top_k(rows, ["org"], [F.desc_nulls_last("pushed_at"), F.asc("name")], first)
    return rows.join(ranked.select("org", "name", "rank"), ["org", "name"], "left")


def commits(landed: DataFrame) -> DataFrame:
    """Commits (org, repo, committed_at) of commit-list payloads (org, repo, body)."""
    rows = landed.select("org", "repo", F.explode(F.from_json("body", COMMIT_LIST)).alias("c"))
    return rows.select("org", "repo", parse_instant(F.col("c.commit.author.date")).alias("committed_at")).where("committed_at IS NOT NULL")


def languages(landed: DataFrame) -> DataFrame:
    """Bytes per language (org, repo, language, bytes) of payloads (org, repo, body)."""
    return landed.select("org", "repo", F.explode(F.from_json("body", "map<string,bigint>")).alias("language", "bytes"))


def repo_activity(repos: DataFrame, commit_rows: DataFrame, language_rows: DataFrame, as_of: str, first: int | None = None, first_languages: int | None = None, description_length: int | None = None) -> Staged:
    """One company per organisation with its inferred stack, a signal per commit
    spike and per repository opened within 7 days."""
    now = instant(as_of)
    usable = repos.where(~F.coalesce("fork", F.lit(False)) & ~F.coalesce("archived", F.lit(False)))
    among = lambda n: F.lit(True) if n is None else F.col("rank") <= n
    active = usable.where(among(first)).select("org", F.col("name").alias("repo"))
    counted = commit_rows.join(active, ["org", "repo"], "left_semi")
    orgs = repos.groupBy("org").agg(F.min("company_name").alias("company_name"), F.min("landed").cast("bigint").alias("landed"))
    spikes = commit_activity(counted, as_of, "org").where("is_spike").join(orgs, "org")
    seq = F.struct(F.col("landed").alias("landed"), F.lit(0).alias("pos"))
    spike_rows = spikes.select(
        "company_name", F.lit("github_spike").alias("type"),
        F.format_string("%d commits in 72h — %.1fσ above 14-day baseline", "recent_commits", "sigma").alias("headline"),
        F.format_string("Baseline: ~%.0f commits per 72h.", "baseline").alias("detail"),
        F.concat(F.lit("https://github.com/"), "org").alias("source_url"), now.alias("signal_date"), "score",
        F.col("recent_commits").alias("github_commit_count"), seq.alias("seq"),
    )
    created = parse_instant(F.col("created_at"))
    fresh = repos.where(~F.coalesce("fork", F.lit(False)) & (created >= shift(now, days=-7)))
    new_rows = fresh.select(
        "company_name", F.lit("github_spike").alias("type"), F.concat(F.lit("New repository opened: "), "name").alias("headline"),
        F.concat(
            F.lit("New public repository: "), F.when(is_infra_repo(F.col("name")), "infra/platform work").otherwise("new project"),
            F.lit(". Description: "), cut(F.coalesce("description", F.lit("none")), description_length),
        ).alias("detail"),
        F.col("html_url").alias("source_url"), now.alias("signal_date"), F.lit(lex.SOURCE_SCORES["new_repo"]).alias("score"),
        F.col("name").alias("github_repo_name"), F.struct(F.col("landed").cast("bigint").alias("landed"), F.lit(1).alias("pos")).alias("seq"),
    )
    read = usable.where(among(first_languages)).select("org", F.col("name").alias("repo"))
    shares = language_shares(language_rows.join(read, ["org", "repo"], "left_semi"), "org")
    stack = shares.groupBy("org").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "language"))), lambda r: r["language"]).alias("languages")
    )
    none = F.array().cast("array<string>")
    companies = orgs.join(stack, "org", "left").select(
        F.col("company_name").alias("name"), F.col("org").alias("github_org"),
        F.struct(F.coalesce("languages", none).alias("languages"), none.alias("frameworks"), none.alias("infra")).alias("tech_stack"),
        seq.alias("seq"),
    )
    return Staged.of("github", companies, spike_rows.unionByName(new_rows, allowMissingColumns=True))
