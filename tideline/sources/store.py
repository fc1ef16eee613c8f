"""State tables as Parquet folders in hash buckets.

``companies``, ``roles`` and ``funding_history`` are partitioned by a hash bucket of their
key; a run reads the buckets that its batch falls into and rewrites these only. Signals
are partitioned by day and run, run rows and the published feed by run.

A run first writes its results to a folder of its own and marks that folder as ready; from
there they are copied over their partitions, and the run's row comes last. A run that
dies before the mark has changed nothing and is computed again; after it, a repeat copies
the same results over the same partitions. So a repeated run leaves each row once,
whenever it died. One run at a time changes a store: another one is refused until the
first has ended or has been repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline import schemas

BUCKETS = 64
# Keyed tables and the column that their buckets come from.
KEYED = {"companies": "slug", "roles": "url", "funding_history": "company_id", "signal_facts": "company_id"}


class TableStore:
    """``buckets`` is fixed by the first run of a store; a large one wants some thousands."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        held = self._text("_buckets")
        self.buckets = int(held) if held else buckets

    # --- small files ---

    def _exists(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.root}/{name}"))

    def _delete(self, name: str) -> None:
        self._fs.delete(self._path(f"{self.root}/{name}"), True)

    def _text(self, name: str) -> str | None:
        if not self._exists(name):
            return None
        stream = self._fs.open(self._path(f"{self.root}/{name}"))
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _create(self, name: str, text: str) -> bool:
        """Whether the file was made here: it isn't, if it is there already."""
        if self._exists(name):
            return False
        out = self._fs.create(self._path(f"{self.root}/{name}"), False)
        out.write(bytearray(text.encode()))
        out.close()
        return True

    # --- runs ---

    def has_run(self, run_id: str) -> bool:
        return self._exists(f"ingest_runs/run={run_id}/_SUCCESS")

    def is_ready(self, run_id: str) -> bool:
        return self._exists(f"_staged/{run_id}/_READY")

    def begin(self, run_id: str) -> None:
        """Takes the store for a run; a run that died holds it until it is repeated."""
        self._create("_buckets", str(self.buckets))
        if not self._create("_running", run_id) and (other := self._text("_running")) != run_id:
            raise RuntimeError(f"run {other} has not ended; repeat it first")
        if not self.is_ready(run_id):
            self._delete(f"_staged/{run_id}")

    def give_up(self, run_id: str) -> None:
        """Ends a run that has changed nothing."""
        self._delete(f"_staged/{run_id}")
        self._delete("_running")

    def stage(self, run_id: str, table: str, df: DataFrame, step: str = "") -> DataFrame:
        """``df`` with the table's columns, written to the run's folder and read back.
        Only what has no ``step`` is copied to the tables later."""
        ddl = schemas.TABLES[table]
        folder = f"{self.root}/_staged/{run_id}/{table}{step}"
        schemas.conform(df, ddl).write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(folder)
        return self.spark.read.schema(ddl).parquet(folder)

    def finish(self, run_id: str, payloads: DataFrame | None = None) -> None:
        """Marks the run's folder as ready if it isn't, and copies it to the tables.
        ``payloads`` are part of what is made ready."""
        if payloads is not None:
            payloads.write.mode("overwrite").option("partitionOverwriteMode", "static").parquet(f"{self.root}/_staged/{run_id}/feed")
        self._create(f"_staged/{run_id}/_READY", run_id)
        for table, column in KEYED.items():
            if (df := self._made(run_id, table)) is not None:
                self._replace(df.withColumn("bucket", self.bucket(F.col(column))), table, "bucket")
        if (df := self._made(run_id, "signals")) is not None:
            self._replace(df.withColumn("run", F.lit(run_id)), "signals", "signal_day", "run")
        if self._exists(f"_staged/{run_id}/feed"):
            self._whole(self.spark.read.parquet(f"{self.root}/_staged/{run_id}/feed").write, "json", f"feed/run={run_id}")
        self.log_run(run_id, self._made(run_id, "ingest_runs"))
        self._delete(f"_staged/{run_id}")
        self._delete("_running")

    def log_run(self, run_id: str, row: DataFrame) -> None:
        self._whole(row.write, "parquet", f"ingest_runs/run={run_id}")

    def _made(self, run_id: str, table: str) -> DataFrame | None:
        if not self._exists(f"_staged/{run_id}/{table}/_SUCCESS"):
            return None
        return self.spark.read.schema(schemas.TABLES[table]).parquet(f"{self.root}/_staged/{run_id}/{table}")

    def _replace(self, df: DataFrame, table: str, *by: str) -> None:
        """Overwrites the partitions that ``df`` has rows for, and no others."""
        writer = df.hint("rebalance", *by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy(*by).parquet(f"{self.root}/{table}")

    def _whole(self, writer, kind: str, name: str) -> None:
        writer.mode("overwrite").option("partitionOverwriteMode", "static").format(kind).save(f"{self.root}/{name}")

    # --- tables ---

    def bucket(self, key: Column) -> Column:
        return F.pmod(F.xxhash64(key), F.lit(self.buckets)).cast("int")

    def buckets_of(self, keys: DataFrame, column: str) -> list[int]:
        """The buckets that keys fall into: ``buckets`` numbers at most."""
        return [r[0] for r in keys.select(self.bucket(F.col(column)).alias("b")).distinct().collect()]

    def read(self, table: str, buckets: list[int] | None = None, but: list[int] | None = None) -> DataFrame:
        """Current content of ``table``, or of some buckets, or of all ``but`` some.
        Types come from the declared schema, never from folder names."""
        if not self._exists(table) or buckets == []:
            return schemas.empty(self.spark, table)
        ddl, more = schemas.TABLES[table], {"bucket": "int"} if table in KEYED else {"run": "string"}
        df = self.spark.read.schema(", ".join([ddl, *(f"{c} {t}" for c, t in more.items())])).parquet(f"{self.root}/{table}")
        if buckets is not None:
            df = df.where(F.col("bucket").isin(buckets))
        if but:
            df = df.where(~F.col("bucket").isin(but))
        return df.drop(*more)

    # --- daily facts (M6) ---

    def write_daily(self, table: str, df: DataFrame) -> None:
        """Rows replace those of the same ``as_of_date``; other dates stay. Only the
        partitions of the dates in ``df`` are touched."""
        df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("as_of_date").parquet(
            f"{self.root}/daily/{table}"
        )

    def read_daily(self, table: str, start: str | None = None, end: str | None = None) -> DataFrame:
        """Daily rows of a date range; the range prunes partitions (Q21)."""
        df = self.spark.read.parquet(f"{self.root}/daily/{table}")
        if start is not None:
            df = df.where(F.col("as_of_date") >= F.lit(start).cast("date"))
        if end is not None:
            df = df.where(F.col("as_of_date") <= F.lit(end).cast("date"))
        return df

    # --- feed (K4) ---

    @property
    def feed_path(self) -> str:
        """JSON lines of new signals in one folder a run. A repeated run overwrites its
        folder, so a batch reader sees each key once; a stream that has read the folder
        before sees new files and drops their keys."""
        return f"{self.root}/feed"
