"""Point-in-time rollups of roles, signals and funding.

All windows of the data model have day-sized edges: a closed window of n days
before an end of day holds n - 1 whole days plus the last microsecond of the day
before (Q1). So every row counts for one interval of dates, and a rollup over a
grid of dates is a sum of +1/-1 steps on the grid. Steps are summed per company
and grid position before any window runs: a window partition holds at most one
row per grid date, however many rows a company has.
"""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tideline.functions import lexicons as lex
from tideline.functions.clock import closes_day, day, end_of_day
from tideline.functions.numbers import count_where

ROLE_MEASURES = ("active", "active_remote", "new_7d", "new_30d", "removed_30d", "next_30d", "next_60d")


def date_grid(start: str | date, end: str | date, step_days: int) -> list[date]:
    start, end = date.fromisoformat(str(start)[:10]), date.fromisoformat(str(end)[:10])
    if end < start:
        raise ValueError("the grid ends before it starts")
    if step_days <= 0:
        raise ValueError("step_days must be positive")
    return [start + timedelta(days=d) for d in range(0, (end - start).days + 1, step_days)]


# --- one date ---------------------------------------------------------------


def roles_known(roles: DataFrame, as_of: str | date) -> DataFrame:
    """F8: roles first seen by the end of the day."""
    return roles.where(F.col("first_seen_at") <= end_of_day(as_of))


def funding_known(funding: DataFrame, as_of: str | date) -> DataFrame:
    """F8: funding events announced by the end of the day."""
    return funding.where(F.col("announced_at") <= end_of_day(as_of))


def _role_conditions(as_of: str | date) -> dict[str, Column]:
    end = end_of_day(as_of)
    start_7d = end - F.expr("INTERVAL 6 DAYS")
    start_30d = end - F.expr("INTERVAL 29 DAYS")
    seen, gone = F.col("first_seen_at"), F.col("removed_at")
    active = gone.isNull() | (gone > end)
    return {
        "active": active,
        "active_remote": active & F.col("is_remote_us"),
        "new_7d": seen >= start_7d,
        "new_30d": seen >= start_30d,
        "removed_30d": gone.between(start_30d, end),
    }


def role_rollup(roles: DataFrame, as_of: str | date) -> DataFrame:
    """A4: one row per company with roles known on the date."""
    when = _role_conditions(as_of)
    return roles_known(roles, as_of).groupBy("company_id").agg(
        count_where(when["active"]).alias("active_roles_total"),
        count_where(when["active_remote"]).alias("active_remote_roles_total"),
        count_where(when["new_7d"]).alias("new_roles_7d"),
        count_where(when["new_30d"]).alias("new_roles_30d"),
        count_where(when["removed_30d"]).alias("removed_roles_30d"),
    )


def active_role_counts(roles: DataFrame, as_of: str | date, key: str) -> DataFrame:
    """A7, long form: active roles per company and ``key`` (role_type or source)."""
    active = _role_conditions(as_of)["active"]
    return (
        roles_known(roles, as_of)
        .where(active & F.col(key).isNotNull())
        .groupBy("company_id", key)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def count_map(counts: DataFrame, key: str, name: str) -> DataFrame:
    """A7, map form: one sorted map per company. A map has at most one entry per
    value of a closed set."""
    entries = F.array_sort(F.collect_list(F.struct(F.col(key), F.col("n"))))
    return counts.groupBy("company_id").agg(F.map_from_entries(entries).alias(name))


def signals_within_30d(signals: DataFrame, as_of: str | date) -> DataFrame:
    end = end_of_day(as_of)
    return signals.where(F.col("signal_date").between(end - F.expr("INTERVAL 29 DAYS"), end))


def signal_metrics(signals: DataFrame, as_of: str | date) -> DataFrame:
    """Total, best score and a count per signal type over 30 days."""
    return (
        signals_within_30d(signals, as_of)
        .groupBy("company_id")
        .agg(
            F.count(F.lit(1)).alias("signals_30d_total"),
            F.max(F.coalesce(F.col("score"), F.lit(0.0))).alias("max_signal_score_30d"),
            *[count_where(F.col("type") == kind).alias(f"signals_{kind}") for kind in lex.SIGNAL_TYPES],
        )
    )


def funding_metrics(funding: DataFrame, as_of: str | date) -> DataFrame:
    """Latest round and the trailing 365 days (bound by date). Ties of the
    announcement instant go to the larger amount."""
    today = day(as_of)
    recent = F.to_date("announced_at") >= F.date_sub(today, 365)
    latest = F.max(
        F.struct(F.col("announced_at"), F.coalesce("amount_usd", F.lit(-1.0)), F.col("amount_usd"), F.col("round_type"))
    )
    return (
        funding_known(funding, as_of)
        .groupBy("company_id")
        .agg(
            latest.alias("latest"),
            count_where(recent).alias("funding_events_12m"),
            F.sum(F.when(recent, F.coalesce("amount_usd", F.lit(0.0))).otherwise(0.0)).alias("funding_amount_12m"),
        )
        .select(
            "company_id",
            F.datediff(today, "latest.announced_at").alias("days_since_last_funding"),
            F.col("latest.amount_usd").alias("last_funding_amount_usd"),
            F.col("latest.round_type").alias("last_funding_round_type"),
            "funding_events_12m",
            "funding_amount_12m",
        )
    )


def future_role_count(roles: DataFrame, as_of: str | date, horizon_days: int) -> DataFrame:
    """A6 for one date: roles first seen in the ``horizon_days`` after the day."""
    seen = F.to_date("first_seen_at")
    first, last = F.date_add(day(as_of), 1), F.date_add(day(as_of), horizon_days)
    return (
        roles.where(seen.between(first, last))
        .groupBy("company_id")
        .agg(F.count(F.lit(1)).alias(f"new_roles_next_{horizon_days}d"))
    )


def open_days(role_state: DataFrame) -> DataFrame:
    """A3: mean and maximum age of the active roles of a company."""
    return (
        role_state.where("is_active")
        .groupBy("company_id")
        .agg(F.avg("days_open").alias("avg_days_open"), F.max("days_open").alias("oldest_open_days"))
    )


# --- a grid of dates --------------------------------------------------------


ROLE_GRID_NAMES = {
    "active": "active_roles_total",
    "active_remote": "active_remote_roles_total",
    "new_7d": "new_roles_7d",
    "new_30d": "new_roles_30d",
    "removed_30d": "removed_roles_30d",
    "next_30d": "label_new_roles_next_30d",
    "next_60d": "label_new_roles_next_60d",
}
KINDS = {"role_type__": lex.ROLE_TYPES, "role_source__": lex.SIGNAL_TYPES, "signal_count__": lex.SIGNAL_TYPES}
# Steps name their measure by its number: rows stay small, and the pivot compares numbers.
MEASURES = (*ROLE_GRID_NAMES, "signals_30d_total", *[f"{prefix}{k}" for prefix, kinds in KINDS.items() for k in kinds])
CODES = {name: code for code, name in enumerate(MEASURES)}
TASK_ROWS = 200_000


def kind_code(prefix: str, kind: Column) -> Column:
    """Number of the measure of one kind; null for a kind that has none."""
    kinds = KINDS[prefix]
    place = F.array_position(F.array(*[F.lit(k) for k in kinds]), kind)
    return F.when(place > 0, (place + F.lit(CODES[f"{prefix}{kinds[0]}"] - 1)).cast("int"))


class Grid:
    """Positions 0..n-1 of the dates start, start + step, ... on the day axis."""

    def __init__(self, start: str | date, end: str | date, step_days: int = 7):
        self.dates = date_grid(start, end, step_days)
        self.start, self.step, self.size = self.dates[0], step_days, len(self.dates)

    def at_or_after(self, d: Column) -> Column:
        """First position whose date is not before ``d``, at least 0; may be past the end."""
        offset = F.datediff(d, F.lit(self.start))
        return F.greatest(F.ceil(offset / F.lit(float(self.step))).cast("int"), F.lit(0))

    def date_of(self, position: Column) -> Column:
        return F.date_add(F.lit(self.start), position * F.lit(self.step))

    def span(self, first: Column, last: Column, name: str | Column, ends: Column | None = None, condition: Column | None = None) -> tuple[Column, Column, Column]:
        """Where the two steps of a row lie that counts on the dates first..last, or from first
        on where ``ends`` is false, and their measure. Without a date of the grid in between, or
        where ``condition`` does not hold, the places are null."""
        low, high = self.at_or_after(first), self.at_or_after(F.greatest(F.date_add(last, 1), first))
        some = low < high
        up, down = (some, some) if ends is None else (~ends | some, ends & some)
        if condition is not None:
            up, down = condition & up, condition & down
        return F.when(up, low), F.when(down, high), F.lit(CODES[name]) if isinstance(name, str) else name

    def steps(self, rows: DataFrame, spans: list[tuple[Column, Column, Column]]) -> DataFrame:
        """(company_id, pos, measure, step) of the ``spans`` of every row. Places are columns of
        their own first, so that each is worked out once and in compiled code. Steps without a
        place, or past the end of the grid, are never seen by the running sums."""
        columns = {f"_{part}{i}": c for i, span in enumerate(spans) for part, c in zip("udm", span)}
        step = lambda place, i, n: F.struct(F.col(f"_{place}{i}").alias("pos"), F.col(f"_m{i}").alias("measure"), F.lit(n).alias("step"))
        both = [s for i in range(len(spans)) for s in (step("u", i, 1), step("d", i, -1))]
        placed = rows.select("company_id", *[c.alias(name) for name, c in columns.items()])
        return placed.select("company_id", F.inline(F.array(*both))).where(F.col("pos") < self.size)

    def positions(self, first: Column, last: Column) -> Column:
        """Array of the positions whose dates lie in first..last."""
        low = self.at_or_after(first)
        high = F.least(self.at_or_after(F.date_add(last, 1)) - 1, F.lit(self.size - 1))
        return F.when(low <= high, F.sequence(low, high)).otherwise(F.array().cast("array<int>"))

    def dense(self, companies: DataFrame) -> DataFrame:
        """One row per company and position."""
        spread = F.explode(F.sequence(F.lit(0), F.lit(self.size - 1)))
        return companies.select("company_id", spread.alias("pos"))


def role_steps(roles: DataFrame, grid: Grid, measures: tuple[str, ...] = ROLE_MEASURES, by_kind: bool = False) -> DataFrame:
    """Steps of every role on the grid: (company_id, pos, measure, step). ``by_kind``
    adds the active count per role type and per source as measures."""
    seen_day = F.to_date("first_seen_at")
    gone_day = F.to_date("removed_at")
    seen_tail = closes_day(F.col("first_seen_at"))
    gone_tail = closes_day(F.col("removed_at"))
    ends = gone_day.isNotNull()
    # A role removed before it was first seen is never active.
    last_active = F.date_sub(F.greatest(seen_day, gone_day), 1)
    steps: list[tuple[Column, Column, Column]] = []

    def add_active(name: str | Column, condition: Column | None = None) -> None:
        steps.append(grid.span(seen_day, last_active, name, ends, condition))

    spans = {
        "new_7d": (seen_day, F.date_add(seen_day, 5 + seen_tail), None),
        "new_30d": (seen_day, F.date_add(seen_day, 28 + seen_tail), None),
        "removed_30d": (F.greatest(seen_day, gone_day), F.date_add(gone_day, 28 + gone_tail), ends),
        "next_30d": (F.date_sub(seen_day, 30), F.date_sub(seen_day, 1), None),
        "next_60d": (F.date_sub(seen_day, 60), F.date_sub(seen_day, 1), None),
    }
    for name in measures:
        if name == "active":
            add_active(name)
        elif name == "active_remote":
            add_active(name, F.col("is_remote_us"))
        else:
            first, last, condition = spans[name]
            steps.append(grid.span(first, last, name, condition=condition))
    if by_kind:
        for prefix, kind in (("role_type__", "role_type"), ("role_source__", "source")):
            code = kind_code(prefix, F.col(kind))
            add_active(code, code.isNotNull())
    return grid.steps(roles, steps)


def signal_steps(signals: DataFrame, grid: Grid) -> DataFrame:
    """Steps of every signal: the 30-day total and the count of its type."""
    first = F.to_date("signal_date")
    last = F.date_add(first, 28 + closes_day(F.col("signal_date")))
    code = kind_code("signal_count__", F.col("type"))
    return grid.steps(signals, [grid.span(first, last, "signals_30d_total"), grid.span(first, last, code, condition=code.isNotNull())])


def _summed(steps: DataFrame) -> DataFrame:
    """Steps summed per company, position and measure: narrow rows with map-side
    combine, so this shuffle carries at most grid x measures rows per company and task."""
    return steps.groupBy("company_id", "pos", "measure").agg(F.sum("step").alias("n"))


def _tasks(companies: DataFrame, grid: Grid) -> int:
    """Partitions for a grid of ``companies``: as many as give `TASK_ROWS` wide rows each.
    Merged by their bytes, narrow parts would come out as too many wide rows in one task."""
    return max(companies.sparkSession.sparkContext.defaultParallelism, -(-companies.count() * grid.size // TASK_ROWS))


def _run_up(parts: DataFrame, columns: dict[str, str], tasks: int, more: list[Column] = ()) -> DataFrame:
    """Long parts to one wide row per company and grid date. Rows are partitioned by
    company once, for the pivot and for the running sums over the grid."""
    sums = [F.sum(F.when(F.col("measure") == CODES[m], F.col("n"))).alias(m) for m in columns]
    return (
        parts.repartition(tasks, "company_id")
        .groupBy("company_id", "pos")
        .agg(*sums, F.max("on_grid").alias("on_grid"), *more)
        .where("on_grid")
    )


def _so_far():
    return Window.partitionBy("company_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)


def role_grid(
    companies: DataFrame, roles: DataFrame, grid: Grid, measures: tuple[str, ...] = ROLE_MEASURES
) -> DataFrame:
    """The role rollup of every company on every date of the grid."""
    names = {m: ROLE_GRID_NAMES[m] for m in measures}
    dense = grid.dense(companies).withColumn("on_grid", F.lit(True))
    parts = _summed(role_steps(roles, grid, measures)).unionByName(dense, allowMissingColumns=True)
    return _run_up(parts, names, _tasks(companies, grid)).select(
        "company_id",
        grid.date_of(F.col("pos")).alias("as_of_date"),
        *[F.coalesce(F.sum(k).over(_so_far()), F.lit(0)).alias(name) for k, name in names.items()],
    )


def feature_grid(
    companies: DataFrame, roles: DataFrame, signals: DataFrame, funding: DataFrame, grid: Grid
) -> DataFrame:
    """ML1 over a grid: role, signal and funding features and the labels of every
    company on every date.

    Counts are running sums of steps. A maximum or a sum of amounts cannot be
    taken back by a step; those are first reduced per company and day and then
    given to the positions that the window of the day covers."""
    steps = role_steps(roles, grid, by_kind=True).unionByName(signal_steps(signals, grid))

    best_days = signals.groupBy(
        "company_id", F.to_date("signal_date").alias("d"), closes_day(F.col("signal_date")).alias("tail")
    ).agg(F.max(F.coalesce("score", F.lit(0.0))).alias("best"))
    best = best_days.select("company_id", F.explode(grid.positions(F.col("d"), F.date_add("d", 28 + F.col("tail")))).alias("pos"), "best")

    latest = F.struct(
        F.col("announced_at"), F.coalesce("amount_usd", F.lit(-1.0)).alias("k"), F.col("amount_usd"), F.col("round_type")
    )
    funding_days = funding.groupBy("company_id", F.to_date("announced_at").alias("d")).agg(
        F.count(F.lit(1)).alias("funding_n"),
        F.sum(F.coalesce("amount_usd", F.lit(0.0))).alias("funding_amount"),
        F.max(latest).alias("latest"),
    )
    trailing = funding_days.select(
        "company_id", F.explode(grid.positions(F.col("d"), F.date_add("d", 365))).alias("pos"), "funding_n", "funding_amount"
    )
    rounds = funding_days.select("company_id", grid.at_or_after(F.col("d")).alias("pos"), "latest").where(F.col("pos") < grid.size)

    parts = _summed(steps)
    for other in (grid.dense(companies).withColumn("on_grid", F.lit(True)), best, trailing, rounds):
        parts = parts.unionByName(other, allowMissingColumns=True)
    counts = {
        **ROLE_GRID_NAMES,
        **{name: name for name in MEASURES if name not in ROLE_GRID_NAMES},
    }
    more = [
        F.max("best").alias("best"),
        F.sum("funding_n").alias("funding_n"),
        F.sum("funding_amount").alias("funding_amount"),
        F.max("latest").alias("latest"),
    ]
    rolled = _run_up(parts, counts, _tasks(companies, grid), more).select(
        "company_id",
        grid.date_of(F.col("pos")).alias("as_of_date"),
        *[F.coalesce(F.sum(k).over(_so_far()), F.lit(0)).alias(name) for k, name in counts.items()],
        F.coalesce("best", F.lit(0.0)).alias("max_signal_score_30d"),
        F.coalesce("funding_n", F.lit(0)).alias("funding_events_12m"),
        F.coalesce("funding_amount", F.lit(0.0)).alias("funding_amount_12m"),
        F.max("latest").over(_so_far()).alias("latest"),
    )
    return rolled.select(
        "*",
        F.datediff("as_of_date", "latest.announced_at").alias("days_since_last_funding"),
        F.col("latest.amount_usd").alias("last_funding_amount_usd"),
        F.col("latest.round_type").alias("last_funding_round_type"),
    ).drop("latest")
