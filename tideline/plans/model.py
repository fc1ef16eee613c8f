"""Hiring-velocity model (ML3-ML5, K3): training, artifact, batch prediction."""

from __future__ import annotations

import json
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml import PipelineModel
from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.pipeline import Pipeline
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideline.functions.numbers import clamp, half_up
from tideline.operators.ranking import chronological_split
from tideline.plans.dataset import FEATURE_COLUMNS, vector_columns
from tideline.plans.forest import Forest
from tideline.session import stored

LABEL = "label_new_roles_next_30d"


@dataclass(frozen=True)
class ForestSettings:
    trees: int = 200
    min_leaf: int = 2
    seed: int = 42
    max_depth: int = 12
    max_bins: int = 64


@dataclass(frozen=True)
class Artifact:
    """A trained forest, its leaf values per tree, and the scale of its scores."""

    pipeline: PipelineModel
    leaves: DataFrame
    meta: dict


def score_scale(rows: DataFrame) -> float:
    """ML5, Q22: nearest-rank 90 % quantile of the label over all rows, at least 3."""
    quantile = F.expr(f"percentile_disc(0.9) WITHIN GROUP (ORDER BY CAST({LABEL} AS DOUBLE))")
    value = rows.agg(quantile).first()[0]
    return max(3.0, float(value))


def _leaf_table(spark: SparkSession, path: str) -> DataFrame:
    """(tree, leaf, value): leaves numbered depth first, left before right, as the
    model's leaf column numbers them. Node ids are in pre-order, so the n-th leaf by
    id is leaf n."""
    nodes = spark.read.parquet(f"{path}/stages/*/data")
    flat = nodes.select(F.col("treeID").alias("tree"), "nodeData.id", "nodeData.leftChild", F.col("nodeData.prediction").alias("value"))
    by_tree = Window.partitionBy("tree").orderBy("id")
    return flat.where("leftChild < 0").select("tree", (F.row_number().over(by_tree) - 1).alias("leaf"), "value")


PART_ROWS = 200_000
# The statistics of the nodes that one pass grows; it decides how many passes there are,
# not what comes out.
PASS_MB = 512


def _varying(rows: DataFrame) -> list[str]:
    """The features with more than one value: no node can split on another."""
    ranges = rows.agg(*[(F.min(c) < F.max(c)).alias(c) for c in FEATURE_COLUMNS]).first()
    return [c for c in FEATURE_COLUMNS if ranges[c]] or list(FEATURE_COLUMNS[:1])


def _spread(rows: DataFrame, n: int) -> DataFrame:
    """``rows`` in even parts, at least one per core, whatever number of parts their
    shuffle was merged to: every pass of the forest runs over these parts."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(n / PART_ROWS))
    return rows.repartition(parts, "company_id", "as_of_date").sortWithinPartitions("company_id", "as_of_date")


def train(rows: DataFrame, path: str, settings: ForestSettings = ForestSettings(), metrics: bool = True) -> dict:
    """ML3: fit on the first 80 % of the rows by date, evaluate both parts, save the
    forest and its metadata under ``path`` (K3)."""
    spark = rows.sparkSession
    # The split counts dates and buckets before it marks rows: the features are worked out once for all.
    labelled = stored(rows.where(F.col(LABEL).isNotNull()).withColumn("label", F.col(LABEL).cast("double")), "training-rows")
    split = vector_columns(chronological_split(labelled)).select("company_id", "as_of_date", *FEATURE_COLUMNS, "label", "is_train", LABEL)
    counts = {r["is_train"]: r["count"] for r in split.groupBy("is_train").count().collect()}
    known = split.where("is_train")
    forest = RandomForestRegressor(
        numTrees=settings.trees, minInstancesPerNode=settings.min_leaf, seed=settings.seed, featureSubsetStrategy="all",
        maxDepth=settings.max_depth, maxBins=settings.max_bins, leafCol="leaves", predictionCol="raw_prediction",
        maxMemoryInMB=PASS_MB,
    )
    assembler = VectorAssembler(inputCols=_varying(known), outputCol="features")
    model = Pipeline(stages=[assembler, Forest(forest, settings, assembler.getInputCols())]).fit(_spread(known, counts.get(True, 0)))
    meta = {
        "target_column": LABEL, "feature_columns": list(FEATURE_COLUMNS), "score_scale": score_scale(split),
        "train_rows": counts.get(True, 0), "valid_rows": counts.get(False, 0), "trees": settings.trees,
    }
    if metrics:
        meta["metrics"] = _metrics(model, split)
    model.write().overwrite().save(f"{path}/forest")
    spark.createDataFrame([(json.dumps(meta),)], "meta string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")
    return meta


def _metrics(model: PipelineModel, split: DataFrame) -> dict:
    scored = model.transform(split)
    out = {}
    for part, rows in (("train", scored.where("is_train")), ("valid", scored.where("NOT is_train"))):
        for name in ("mae", "rmse", "r2"):
            value = RegressionEvaluator(predictionCol="raw_prediction", labelCol="label", metricName=name).evaluate(rows)
            out[f"{part}_{name}"] = round(value, 4)
    return out


def load(spark: SparkSession, path: str) -> Artifact:
    meta = json.loads(spark.read.text(f"{path}/meta").first()[0])
    return Artifact(PipelineModel.load(f"{path}/forest"), _leaf_table(spark, f"{path}/forest"), meta)


def _with_spread(rows: DataFrame, leaves: DataFrame) -> DataFrame:
    """``rows`` with the mean and the variance of their leaf values instead of ``leaf_ids``.
    The values of a forest are at most trees x 2^depth numbers."""
    known = leaves.orderBy("tree", "leaf").toPandas()
    starts = np.searchsorted(known["tree"].to_numpy(), np.arange(known["tree"].max() + 1))
    values = known["value"].to_numpy()

    def reduce(batches):
        for batch in batches:
            ids = batch.column("leaf_ids").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, len(starts))
            found = values[ids.astype(np.int64) + starts]
            columns = [batch.column(c) for c in names] + [pa.array(found.mean(axis=1)), pa.array(found.var(axis=1))]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "leaf_mean", "leaf_variance"])

    kept = rows.drop("leaf_ids")
    names = kept.columns
    return rows.mapInArrow(reduce, T.StructType([*kept.schema.fields, T.StructField("leaf_mean", T.DoubleType()), T.StructField("leaf_variance", T.DoubleType())]))


def predict(artifact: Artifact, features: DataFrame, key: tuple[str, ...] = ("company_id", "as_of_date")) -> DataFrame:
    """ML4: prediction, model score, and a confidence from the spread of the trees.

    Leaf numbers of all trees come with the prediction. A row's leaf values are reduced
    to their mean and spread where they are looked up, whatever the size of the forest."""
    scored = artifact.pipeline.transform(vector_columns(features)).withColumn("leaf_ids", vector_to_array("leaves"))
    rows = scored.select(*key, F.greatest("raw_prediction", F.lit(0.0)).alias("prediction"), "leaf_ids")
    rows = stored(_with_spread(rows, artifact.leaves), "predictions")
    # Rows that share a key share the deviation of all their leaf values.
    variance = F.avg("leaf_variance") + F.var_pop("leaf_mean")
    spread = rows.groupBy(*key).agg(F.sqrt(variance).alias("deviation"))
    rows = rows.join(spread, list(key))
    scale = F.greatest(F.abs("prediction"), F.lit(2.0))
    confidence = clamp((1.0 - F.least(F.col("deviation") / scale, F.lit(1.0))) * 100.0, 0.0, 100.0)
    score = clamp(F.col("prediction") / F.lit(artifact.meta["score_scale"]) * 100.0, 0.0, 100.0)
    return rows.select(
        *key,
        half_up(F.col("prediction"), 3).alias("predicted_new_roles_30d"),
        half_up(score, 1).alias("model_score"),
        half_up(confidence, 1).alias("model_confidence"),
        half_up(F.col("deviation"), 3).alias("prediction_stddev"),
    )
