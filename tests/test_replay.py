"""Bundles replay clean as written, and each kind of spoilt bundle is seen."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from retroscope.functions.stored import place
from retroscope.operators import replay

BLOCK = 4


@pytest.fixture(scope="module")
def series(spark):
    x = np.random.default_rng(1).normal(size=(30, 2)) / 50
    return spark.createDataFrame([(i, float(a), float(b), 30) for i, (a, b) in enumerate(x)], "position bigint, a double, b double, n bigint")


def bundle(spark, series):
    path = place(spark, "bundle")
    replay.export(series, path, BLOCK, 12, "t")
    return path


def checked(spark, path):
    return {r.rule: (r.evaluated, r.violations) for r in replay.replay(spark, path, BLOCK).collect()}


def spoil(spark, path, name, change):
    rows = spark.read.parquet(f"{path}/{name}")
    kept = change(rows).collect()
    spark.createDataFrame(kept, rows.schema).write.mode("overwrite").parquet(f"{path}/{name}")


def test_clean(spark, series):
    assert checked(spark, bundle(spark, series)) == {"digests": (4, 0), "blocks": (12, 0), "draws": (26, 0), "contrasts": (12, 0), "identity": (1, 0)}


def test_changed_draw_is_seen(spark, series):
    path = bundle(spark, series)
    spoil(spark, path, "draws", lambda d: d.withColumn("sharpe", F.when(F.col("draw") == 3, F.col("sharpe") + 1e-6).otherwise(F.col("sharpe"))))
    found = checked(spark, path)
    assert found["digests"] == (4, 1) and found["draws"] == (26, 1) and found["blocks"][1] == 0


def test_lost_draw_and_number_that_is_none(spark, series):
    path = bundle(spark, series)
    spoil(spark, path, "draws", lambda d: d.where("coalesce(draw, -1) <> 5").withColumn("sharpe", F.when(F.col("draw") == 3, float("nan")).otherwise(F.col("sharpe"))))
    assert checked(spark, path)["draws"] == (26, 2 + 2)  # both values lack; one is not finite and does not equal its replay


def test_blocks_outside_the_series(spark, series):
    path = bundle(spark, series)
    spoil(spark, path, "blocks", lambda d: d.withColumn("start", F.when((F.col("draw") == 1) & (F.col("place") == 0), 29).otherwise(F.col("start"))).where("not (draw = 2 and place = 1)"))
    assert checked(spark, path)["blocks"] == (12, 2)


def test_series_of_another_run(spark, series):
    path = bundle(spark, series)
    spoil(spark, path, "series", lambda d: d.withColumn("a", F.col("a") + F.when(F.col("position") == 7, 0.01).otherwise(0.0)))
    found = checked(spark, path)
    assert found["identity"] == (1, 1) and found["draws"][1] > 0 and found["contrasts"][1] == 0  # contrasts follow from the stored draws


def test_differences_with_nulls(spark):
    schema = "k int, v double"
    left = spark.createDataFrame([(None, 1.0), (1, None), (2, 2.0), (3, float("inf"))], schema)
    right = spark.createDataFrame([(None, 1.0), (1, 1.0), (2, 2.5), (3, float("inf")), (4, 0.0)], schema)
    r = replay.differences(left, right, ["k"], ["v"], 0.1).first()
    assert (r.compared, r.lacking, r.not_finite, r.beyond, r.largest) == (5, 2, 1, 1, 0.5)
    assert replay.differences(left.limit(0), right.limit(0), ["k"], ["v"], 0.1).count() == 0
