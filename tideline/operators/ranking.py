"""Rankings, top-k per company and first-wins dedupe.

Top-k per company uses ``row_number() <= k``: Spark limits each group inside
every map task before the shuffle, so a company with a third of all rows still
sends only k rows per task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.session import cut_lineage


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first ``k`` rows of every group with their rank."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(window)).where(F.col(rank) <= k)


def signal_order() -> list[Column]:
    """L2 with a final id tiebreak."""
    return [F.desc("score"), F.desc("signal_date"), F.asc("signal_id")]


def role_order() -> list[Column]:
    """L3 with a final id tiebreak."""
    return [F.desc("fit_score"), F.asc("days_open"), F.asc("role_id")]


def top_signals(signals: DataFrame, k: int) -> DataFrame:
    """W2"""
    return top_k(signals, ["company_id"], signal_order(), k)


def top_roles(role_state: DataFrame, k: int) -> DataFrame:
    """W2"""
    return top_k(role_state.where("is_active"), ["company_id"], role_order(), k)


def newest_signals(signals: DataFrame, k: int) -> DataFrame:
    return top_k(signals, ["company_id"], [F.desc("signal_date"), F.asc("signal_id")], k)


def best_role(value: Column) -> Column:
    """Aggregate: ``value`` of the first role in `role_order`."""
    return F.min_by(value, F.struct(-F.col("fit_score"), F.col("days_open"), F.col("role_id")))


def best_signal(value: Column) -> Column:
    """Aggregate: ``value`` of the first signal in `signal_order`."""
    return F.max_by(value, F.struct(F.col("score"), F.col("signal_date"), -F.col("signal_id")))


def latest_signal(signals: DataFrame) -> DataFrame:
    """Newest signal per company, the lower id on a tie."""
    return top_k(signals, ["company_id"], [F.desc("signal_date"), F.asc("signal_id")], 1).drop("rank")


def first_wins(df: DataFrame, keys: list[Column | str], order: list[Column | str]) -> DataFrame:
    """The first row of every key."""
    window = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(window)).where("_n = 1").drop("_n")


def union_first_wins(sources: list[DataFrame], keys: list[Column | str], seq: str) -> DataFrame:
    """Union in order of priority; the first source with a key keeps it."""
    ranked = [df.withColumn("_source", F.lit(i)) for i, df in enumerate(sources)]
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), ranked)
    return first_wins(union, keys, ["_source", seq]).drop("_source")


def first_wins_two_keys(rows: DataFrame, key_a: str, key_b: str, seq: str) -> DataFrame:
    """W4 on two keys (H4): rows are taken in ``seq`` order and a row is dropped
    when either key was taken before; exactly that result, in parallel rounds.

    In a round every undecided row that comes first under both of its keys is
    kept, then all rows that share a key with a kept row are dropped. The first
    undecided row is always kept, so each round makes progress; rounds needed are
    the length of the longest chain of rows blocking each other. The work table
    holds keys and ``seq`` only and is cut down to distinct key pairs first.
    """
    open_rows = rows.groupBy(key_a, key_b).agg(F.min(seq).alias(seq))
    kept: list[DataFrame] = []
    while True:
        open_rows = cut_lineage(open_rows)
        if open_rows.isEmpty():
            break
        first_a = open_rows.groupBy(key_a).agg(F.min(seq).alias("_a"))
        first_b = open_rows.groupBy(key_b).agg(F.min(seq).alias("_b"))
        winners = cut_lineage(
            open_rows.join(first_a, key_a)
            .join(first_b, key_b)
            .where((F.col(seq) == F.col("_a")) & (F.col(seq) == F.col("_b")))
            .select(key_a, key_b, seq)
        )
        kept.append(winners)
        open_rows = open_rows.join(winners.select(key_a), key_a, "left_anti").join(
            winners.select(key_b), key_b, "left_anti"
        )
    if not kept:
        return rows.limit(0)
    winners = reduce(DataFrame.unionByName, kept)
    return rows.join(winners.select(seq), seq, "left_semi")


def chronological_split(rows: DataFrame, share: float = 0.8, at_least: int = 8) -> DataFrame:
    """Rows in date order, the first ``share`` of them marked ``is_train``.

    No global sort: row counts per date give the date that holds the cut, counts
    per hash bucket of that date's companies give the bucket that holds it, and
    only that bucket's rows are numbered. Within a date the order is the bucket,
    then the company."""
    bucket = F.substring(F.md5(F.col("company_id").cast("string")), 1, 3)
    rows = rows.withColumn("_bucket", bucket)
    per_date = [(r[0], r[1]) for r in rows.groupBy("as_of_date").count().orderBy("as_of_date").collect()]
    total = sum(n for _, n in per_date)
    if total < at_least:
        raise ValueError(f"need at least {at_least} rows to split")
    cut = max(1, min(total - 1, int(total * share)))
    before, cut_date = 0, per_date[-1][0]
    for d, n in per_date:
        if before + n > cut:
            cut_date = d
            break
        before += n
    # At most 4096 buckets by construction of the three hex digits.
    on_date = rows.where(F.col("as_of_date") == F.lit(cut_date))
    per_bucket = [(r[0], r[1]) for r in on_date.groupBy("_bucket").count().orderBy("_bucket").collect()]
    cut_bucket = per_bucket[-1][0]
    for b, n in per_bucket:
        if before + n > cut:
            cut_bucket = b
            break
        before += n
    edge = on_date.where(F.col("_bucket") == cut_bucket)
    chosen = (
        edge.select("company_id", F.row_number().over(Window.orderBy("company_id")).alias("_n"))
        .where(F.col("_n") <= cut - before)
        .select("company_id", F.lit(True).alias("_edge"), F.lit(cut_date).alias("as_of_date"))
    )
    date_col = F.col("as_of_date")
    earlier = (date_col < F.lit(cut_date)) | ((date_col == F.lit(cut_date)) & (F.col("_bucket") < cut_bucket))
    return (
        rows.join(chosen, ["company_id", "as_of_date"], "left")
        .withColumn("is_train", earlier | F.coalesce("_edge", F.lit(False)))
        .drop("_edge", "_bucket")
    )


def execution_state(events: DataFrame) -> DataFrame:
    """Current record per company: the latest status, and the latest non-empty
    value of every field that an event may leave blank."""
    when = F.struct("occurred_at", "event_id")

    def latest(name: str) -> Column:
        value = F.col(name)
        given = value.isNotNull() & (value.cast("string") != "")
        return F.max_by(F.when(given, value), F.when(given, when)).alias(name)

    return events.groupBy("company_id").agg(
        F.max_by("status", when).alias("status"),
        latest("notes"),
        latest("target_role_title"),
        *([latest("target_role_url")] if "target_role_url" in events.columns else []),
        latest("follow_up_due"),
        F.max("occurred_at").alias("last_event_at"),
        F.min("occurred_at").alias("created_at"),
        F.count(F.lit(1)).alias("event_count"),
    )


def execution_history(events: DataFrame, k: int = 12) -> DataFrame:
    """The newest ``k`` events of every company, newest first."""
    return top_k(events, ["company_id"], [F.desc("occurred_at"), F.desc("event_id")], k)


def prioritised(opportunities: DataFrame) -> DataFrame:
    """Actionable rows, or all rows when none is; best first."""
    actionable = (F.col("open_roles") > 0) | (F.col("signal_count") > 1) | (F.col("score") >= 50)
    flagged = opportunities.withColumn("_actionable", actionable)
    none_is = ~flagged.agg(F.coalesce(F.bool_or("_actionable"), F.lit(False))).scalar()
    return (
        flagged.where(F.col("_actionable") | none_is)
        .drop("_actionable")
        .orderBy(F.desc("open_roles"), F.desc("score"), F.desc("signal_count"), F.asc("company_id"))
    )
