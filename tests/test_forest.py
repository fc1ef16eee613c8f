"""The forest that is grown tree by tree, against MLlib's own, and what is read from it."""

import statistics

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import functions as F

from conftest import values
from tideline.plans import forest, model

NAMES = ["wide", "even", "signed", "flag", "rare"]


def rows(spark, n=4000, label="CAST(pmod(hash(id, 3), 4) + flag + wide / 40 AS INT) * 1.0"):
    base = spark.range(0, n, 1, 4).selectExpr(
        "id", "pmod(hash(id), 150) * 1.5 AS wide", "pmod(hash(id, 1), 9) * 1.0 AS even", "hash(id, 2) % 7 * 0.5 AS signed",
        "id % 2 * 1.0 AS flag", "IF(id % 100 = 3, 4.0, 0.0) AS rare",
    )
    base = base.selectExpr("id", *[f"double({c}) AS {c}" for c in NAMES], f"double({label}) AS label")
    return VectorAssembler(inputCols=NAMES, outputCol="features").transform(base.repartition(3, "id").sortWithinPartitions("id"))


def both(spark, data, settings, path):
    regressor = RandomForestRegressor(
        numTrees=settings.trees, minInstancesPerNode=settings.min_leaf, seed=settings.seed, featureSubsetStrategy="all",
        maxDepth=settings.max_depth, maxBins=settings.max_bins, leafCol="leaves", predictionCol="raw_prediction",
    )
    own = forest.Forest(regressor, settings, NAMES)
    own.fit(data).write().save(f"{path}/own")
    regressor.fit(data).write().save(f"{path}/mllib")
    nodes = [spark.read.parquet(f"{path}/{k}/data").selectExpr("treeID", "nodeData.*").orderBy("treeID", "id").collect() for k in ("own", "mllib")]
    return own, nodes


@pytest.mark.parametrize("settings", [
    model.ForestSettings(trees=7, max_depth=9, max_bins=32), model.ForestSettings(trees=3, min_leaf=25, seed=9, max_bins=256),
    model.ForestSettings(trees=2, max_depth=1), model.ForestSettings(trees=4, min_leaf=1, max_depth=12, seed=5),
])
def test_forest_is_mllibs_node_by_node(spark, tmp_path, settings):
    data = rows(spark)
    own, (ours, theirs) = both(spark, data, settings, tmp_path)
    assert own._plan(data)[0] is not None and len(theirs) >= settings.trees * 3
    assert ours == theirs


def test_few_rows(spark, tmp_path):
    # Fewer rows than bins.
    data = rows(spark, 40)
    own, (ours, theirs) = both(spark, data, model.ForestSettings(trees=5, max_depth=6), tmp_path)
    assert own._plan(data)[0] is not None and ours == theirs


def test_sums_that_do_not_fit_beside_counts():
    plan = forest._Plan(["a", "b", "c"], [[0.5, 1.5], [1.0], [0.0]], np.array([0.0, 3.0, 7.0]), [0, 500], model.ForestSettings(), 17)
    some = np.random.default_rng(1)
    lines, node = some.integers(0, 12, (1, 500)).astype(np.uint8), some.integers(0, 3, 500).astype(np.uint16)
    given = (lines, some.integers(0, 3, 500), some.integers(1, 4, 500).astype(np.uint8), node, np.array([1, -1, 0]), 2)
    grower = forest._Grower(plan)
    assert plan.bundles == [[0, 1, 2]] and (grower.histograms(*given, 1024.0) == grower.histograms(*given, 0.0)).all()


def test_labels_that_are_not_whole_go_to_mllib(spark, tmp_path):
    data = rows(spark, 300, "even / 3")
    own, (ours, theirs) = both(spark, data, model.ForestSettings(trees=2, max_depth=4), tmp_path)
    assert own._plan(data)[0] is None and ours == theirs


def test_rows_beyond_a_task_go_to_mllib(spark, monkeypatch):
    monkeypatch.setattr(forest, "TASK_MB", 0)
    assert forest.Forest(None, model.ForestSettings(trees=2), NAMES)._plan(rows(spark, 300))[0] is None


def test_batches_are_set_back(spark):
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    with pytest.raises(ValueError), forest._small_batches(spark):
        assert spark.conf.get(name) == "4m"
        raise ValueError
    assert spark.conf.get(name) == before


def test_spread_is_over_all_leaf_values_of_a_key(spark):
    leaves = spark.createDataFrame([(1, 1, 9.0), (0, 0, 1.0), (0, 1, 4.0), (1, 0, 2.5)], "tree int, leaf int, value double")
    given = spark.createDataFrame([(1, 0.5, [0.0, 1.0]), (2, 0.25, [1.0, 0.0]), (None, 0.125, [1.0, 1.0])], "k int, prediction double, leaf_ids array<double>")
    out = model._with_spread(given, leaves)
    assert values(out) == values(spark.createDataFrame([(1, 0.5, 5.0, 16.0), (2, 0.25, 3.25, 0.5625), (None, 0.125, 6.5, 6.25)], out.schema))
    assert statistics.pvariance([1.0, 9.0]) == 16.0


def test_repeated_and_null_keys_of_predictions(spark, tables, tmp_path):
    from tideline.plans import dataset

    made = dataset.training_rows(tables.companies, tables.roles, tables.signals, tables.funding_history, "2023-06-01", "2023-12-28", 60)
    model.train(made, str(tmp_path / "m"), model.ForestSettings(trees=4, max_depth=5), metrics=False)
    artifact = model.load(spark, str(tmp_path / "m"))
    # Three companies under one key, and one without a key.
    keyed = made.where("company_id <= 6").withColumn("company_id", F.expr("CASE WHEN company_id <= 2 THEN 1 WHEN company_id <= 5 THEN company_id END"))
    out = model.predict(artifact, keyed)
    assert out.where("company_id IS NULL").count() == 0 and out.where("company_id = 1").count() == 3 * out.where("company_id = 3").count()
    from pyspark.ml.functions import vector_to_array

    scored = artifact.pipeline.transform(dataset.vector_columns(keyed)).select("company_id", "as_of_date", F.posexplode(vector_to_array("leaves")).alias("tree", "leaf"))
    want = scored.join(artifact.leaves, ["tree", "leaf"]).groupBy("company_id", "as_of_date").agg(F.stddev_pop("value").alias("w"))
    assert out.join(want, ["company_id", "as_of_date"]).where("abs(prediction_stddev - w) > 0.00051").count() == 0


def test_steps_are_compiled(spark, tables):
    from tideline.operators import asof

    plan = asof.role_steps(tables.roles, asof.Grid("2023-06-01", "2023-12-28", 30), by_kind=True)._jdf.queryExecution().optimizedPlan().toString()
    assert "lambda" not in plan
