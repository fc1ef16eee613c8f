"""Live signals with Structured Streaming.

Stateful work that a hot company could overload is done per micro-batch in
``foreachBatch``: the batch is first reduced per company with partial aggregates,
then merged with the state of the previous batch. State folders carry the batch
id, so a replayed batch starts from the same state and gives the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tideline.operators.ranking import first_wins, top_k
from tideline.plans import ingest as ingest_plan
from tideline.plans.scoring import Profile
from tideline.schemas import STAGED_COMPANY, STAGED_ROLE, STAGED_SIGNAL, Staged
from tideline.sources.store import TableStore

PAYLOAD = (
    "id string, company_id string, company_name string, type string, type_label string, headline string, detail string,"
    "score double, score_variant string, signal_date string, source_url string"
)
LATE = "1 day"
FEED_SIZE = 30
HISTORY_SIZE = 8


def read_feed(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Published payloads as a stream with an event time."""
    raw = spark.readStream.schema(PAYLOAD).option("maxFilesPerTrigger", max_files).json(path)
    return with_event_time(raw.drop("run"))


def with_event_time(payloads: DataFrame) -> DataFrame:
    at = F.try_to_timestamp("signal_date")
    return payloads.withColumn("event_time", at)


def unique_signals(feed: DataFrame) -> DataFrame:
    """T1 for append-only sinks: each signal once, ids remembered for a day of event
    time. Rows later than that are dropped by the watermark; the live tables and
    the state tables use lossless checks instead (`LiveState`, `start_ingest`)."""
    return feed.withWatermark("event_time", LATE).dropDuplicatesWithinWatermark(["id"])


def busy_windows(feed: DataFrame, at_least: int = 3) -> DataFrame:
    """Companies with ``at_least`` signals on a day, as day windows close."""
    return (
        feed.withWatermark("event_time", LATE)
        .groupBy(F.window("event_time", "1 day"), "company_id")
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") >= at_least)
        .select("company_id", F.to_date("window.start").alias("day"), "n")
    )


# --- live fold and feed (T2, T3) ---------------------------------------------------


def fold_counts(state: DataFrame | None, batch: DataFrame) -> DataFrame:
    """Signal count and latest headline per company; the newer batch's wins."""
    news = batch.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("signal_count"),
        F.max_by(F.struct("headline", "signal_date"), F.struct("signal_date", "id")).alias("last"),
    ).select("company_id", "signal_count", F.col("last.headline").alias("latest_signal"), F.col("last.signal_date").alias("latest_at"))
    if state is None:
        return news
    o, n = state.alias("o"), news.alias("n")
    return o.join(n, "company_id", "full_outer").select(
        "company_id",
        (F.coalesce("o.signal_count", F.lit(0)) + F.coalesce("n.signal_count", F.lit(0))).alias("signal_count"),
        *[F.when(F.col("n.signal_count").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in ("latest_signal", "latest_at")],
    )


def fold_history(state: DataFrame | None, batch: DataFrame, batch_id: int, k: int = HISTORY_SIZE) -> DataFrame:
    """The last ``k`` signals of every company in order of arrival."""
    order = [F.desc("batch_id"), F.desc("signal_date"), F.desc("id")]
    news = batch.select("company_id", "id", "type_label", "headline", "signal_date", F.lit(batch_id).cast("bigint").alias("batch_id"))
    both = news if state is None else state.drop("rank").unionByName(news)
    return top_k(both, ["company_id"], order, k)


def fold_feed(state: DataFrame | None, batch: DataFrame, batch_id: int, k: int = FEED_SIZE) -> DataFrame:
    """The last ``k`` signals of all companies in order of arrival."""
    news = batch.select("company_id", "company_name", "id", "type_label", "headline", "score", "signal_date", F.lit(batch_id).cast("bigint").alias("batch_id"))
    both = news if state is None else state.unionByName(news)
    return both.orderBy(F.desc("batch_id"), F.desc("signal_date"), F.desc("id")).limit(k)


LIVE_TABLES = ("counts", "history", "feed")


class LiveState:
    """Live tables per batch id under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def read(self, table: str, batch_id: int) -> DataFrame | None:
        folder = f"{self.root}/batch={batch_id}/{table}"
        if not self._fs.exists(self._path(f"{folder}/_SUCCESS")):
            return None
        return self.spark.read.parquet(folder)

    def unseen(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """The signals of the batch that no earlier batch had, once each, however late.
        Seen ids are kept by day of the signal, so only the batch's days are read."""
        keyed = batch.withColumn("day", F.to_date(F.substring("signal_date", 1, 10)))
        once = first_wins(keyed, ["id"], ["signal_date"])
        folder = f"{self.root}/seen"
        if not self._fs.exists(self._path(folder)):
            return once
        seen = self.spark.read.schema("id string, day date, batch bigint").parquet(folder)
        days = keyed.select("day").distinct()
        earlier = seen.where(F.col("batch") < batch_id).join(days, "day", "left_semi")
        undated = seen.where((F.col("batch") < batch_id) & F.col("day").isNull())
        held = earlier.unionByName(undated).select(F.col("day").alias("_day"), F.col("id").alias("_id"))
        return once.join(held, (F.col("id") == F.col("_id")) & F.col("day").eqNullSafe(F.col("_day")), "left_anti")

    def advance(self, batch: DataFrame, batch_id: int) -> None:
        """Fold one micro-batch: state of batch n is state of n - 1 plus the batch's
        unseen signals, which are written first and read back."""
        new = self.unseen(batch, batch_id).withColumn("batch", F.lit(batch_id).cast("bigint"))
        arrived = f"{self.root}/arrived/batch={batch_id}"
        new.drop("batch").write.mode("overwrite").parquet(arrived)
        batch = self.spark.read.schema(PAYLOAD + ", day date").parquet(arrived)
        batch.select("id", "day", F.lit(batch_id).cast("bigint").alias("batch")).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic"
        ).partitionBy("day", "batch").parquet(f"{self.root}/seen")
        before = {t: self.read(t, batch_id - 1) for t in LIVE_TABLES}
        after = {
            "counts": fold_counts(before["counts"], batch),
            "history": fold_history(before["history"], batch, batch_id),
            "feed": fold_feed(before["feed"], batch, batch_id),
        }
        for table, df in after.items():
            df.write.mode("overwrite").parquet(f"{self.root}/batch={batch_id}/{table}")

    def latest(self, table: str) -> DataFrame | None:
        folder = self._path(self.root)
        if not self._fs.exists(folder):
            return None
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        ids = sorted((int(n.removeprefix("batch=")) for n in names if n.startswith("batch=")), reverse=True)
        for i in ids:
            found = self.read(table, i)
            if found is not None:
                return found
        return None


def _for_each(df: DataFrame, checkpoint: str, step: Callable[[DataFrame, int], None], once: bool) -> DataStreamWriter:
    writer = df.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True) if once else writer


def start_live_fold(feed: DataFrame, state_root: str, checkpoint: str, once: bool = False):
    """Start folding the unique signals of ``feed`` into live tables."""
    state = LiveState(feed.sparkSession, state_root)
    return _for_each(feed.drop("event_time"), checkpoint, state.advance, once).start()


# --- streaming ingest (T4, T5) -----------------------------------------------------


def read_staged_signals(spark: SparkSession, path: str) -> DataFrame:
    """Staged signal rows that normalisers land as JSON lines."""
    return spark.readStream.schema(STAGED_SIGNAL).json(path)


def start_ingest(
    staged: DataFrame, store_root: str, checkpoint: str, as_of: Callable[[int], str], name: str = "stream",
    source: str = "stream", profile: Profile = Profile(), once: bool = False,
):
    """T4, T5: each micro-batch is one ingest run: insert-if-new into signals and
    funding history, and a rescore of the companies it touches. The run id holds the
    query's id, which its checkpoint keeps, and the batch id, so a replayed batch commits
    nothing twice and a new checkpoint's batches are runs of their own."""

    def step(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        parts = Staged(source, spark.createDataFrame([], STAGED_COMPANY), batch, spark.createDataFrame([], STAGED_ROLE))
        query_id = spark.sparkContext.getLocalProperty("sql.streaming.queryId")
        ingest_plan.ingest(TableStore(spark, store_root), parts, as_of(batch_id), f"{name}-{query_id}-{batch_id}", profile)

    return _for_each(staged, checkpoint, step, once).start()
