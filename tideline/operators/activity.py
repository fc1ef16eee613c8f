"""Batch postings, commit spikes and language shares."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import lexicons as lex
from tideline.functions.clock import day
from tideline.functions.scores import spike_score
from tideline.operators.ranking import top_k


def batch_postings(recent_roles: DataFrame, order: str, at_least: int = 3) -> DataFrame:
    """A10: companies with ``at_least`` recent roles (company_name, title, order), the
    count and the first three titles. Only three titles per company leave a task."""
    counts = recent_roles.groupBy("company_name").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= at_least)
    first = top_k(recent_roles, ["company_name"], [F.asc(order)], 3)
    titles = first.groupBy("company_name").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "title"))), lambda r: r["title"]).alias("titles")
    )
    return counts.join(titles, "company_name").select(
        "company_name",
        "n",
        F.concat(
            F.col("n").cast("string"), F.lit(" engineering roles posted simultaneously — "), F.array_join("titles", ", ")
        ).alias("headline"),
        F.lit(lex.SOURCE_SCORES["batch_posting"]).alias("score"),
    )


def boost_same_day(signals: DataFrame, as_of: str, key: str = "company_name", at_least: int = 3) -> DataFrame:
    """A10: all signals of a company with ``at_least`` signals on the day get 1.3
    times their score, at most 100. Counts are joined back instead of taken over a
    window, so that a large company is not gathered in one task."""
    busy = (
        signals.where(F.to_date("signal_date") == day(as_of))
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") >= at_least)
    )
    boosted = F.when(F.col("_n").isNotNull(), F.least(F.col("score") * 1.3, F.lit(100.0))).otherwise(F.col("score"))
    return signals.join(busy, key, "left").withColumn("score", boosted).drop("_n")


def busy_days(signals: DataFrame, at_least: int = 3) -> DataFrame:
    """T6 in batch: company and day with ``at_least`` signals."""
    return (
        signals.groupBy("company_id", F.to_date("signal_date").alias("day"))
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= at_least)
    )


def commit_activity(commits: DataFrame, as_of: str, key: str = "company_id") -> DataFrame:
    """Commits (key, committed_at) of the 14 days before the day, as four
    3-day baseline sums (day offsets 0-11) and the recent sum (offsets 11-13);
    mean, sample deviation, sigma and the spike decision. One aggregate; days
    without commits count 0 without being built."""
    offset = F.datediff(F.to_date("committed_at"), day(as_of)) + 14
    sums = {f"w{i}": F.sum(F.when(offset.between(3 * i, 3 * i + 2), 1).otherwise(0)) for i in range(4)}
    sums["recent_commits"] = F.sum(F.when(offset.between(11, 13), 1).otherwise(0))
    totals = commits.where(offset.between(0, 13)).groupBy(key).agg(*[c.alias(n) for n, c in sums.items()])
    windows = [F.col(f"w{i}") for i in range(4)]
    mean = sum(windows[1:], windows[0]) / 4
    variance = sum(((w - mean) * (w - mean) for w in windows[1:]), (windows[0] - mean) * (windows[0] - mean)) / 3
    stats = totals.withColumns({"baseline": mean, "deviation": F.sqrt(variance)})
    stats = stats.withColumn(
        "sigma", (F.col("recent_commits") - F.col("baseline")) / F.greatest("deviation", F.lit(0.1))
    )
    return stats.withColumns(
        {
            "is_spike": (F.col("sigma") >= 2.0) & (F.col("recent_commits") >= 10),
            "score": spike_score(F.col("sigma"), F.col("recent_commits")),
        }
    ).drop("w0", "w1", "w2", "w3")


def language_shares(sizes: DataFrame, key: str = "company_id", over: float = 0.05, k: int = 6) -> DataFrame:
    """(key, language, bytes) to the ``k`` largest languages with more than the
    given share, long form. Sizes are summed per language before any window, which
    then sees one row per language."""
    sums = sizes.groupBy(key, "language").agg(F.sum("bytes").alias("bytes"))
    total = F.sum("bytes").over(Window.partitionBy(key))
    big = sums.withColumn("share", F.try_divide(F.col("bytes"), total)).where(F.col("share") > over)
    return top_k(big, [key], [F.desc("bytes"), F.asc("language")], k).withColumn("language", F.lower("language"))
