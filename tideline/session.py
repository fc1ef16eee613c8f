"""Spark session for the jobs in this package."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "true",
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def build_session(app: str = "tideline", master: str | None = None, **extra: str) -> SparkSession:
    """On a cluster the master and all sizing come from spark-submit; only the
    semantic settings above are fixed here."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **extra}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def _checkpoint_folder(spark: SparkSession) -> str:
    """The folder of reliable checkpoints: the cluster's ``spark.checkpoint.dir``, or one
    the caller has set on the context; on a single machine a temporary one that goes
    when Python ends. A cluster without one is an error: nothing else is shared."""
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tideline-")
        atexit.register(shutil.rmtree, folder, True)
    context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def shared_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that all executors can reach, removed when Python ends."""
    folder = f"{_checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    atexit.register(_remove, spark, folder)
    return folder


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # the session ended before; the folder is left to the cluster's cleaning
        pass


def cut_lineage(df):
    """Checkpoint ``df`` to the shared folder, so that a lost executor costs a read."""
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint()


def stored(df, name: str):
    """``df`` written once as Parquet to the shared folder and read back, so that its
    branches read the columns they need instead of working it out again each."""
    folder = shared_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
