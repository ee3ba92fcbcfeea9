"""Joins of tables with one row per key, positions, and what plans must not hold."""

from pyspark.sql import functions as F

from gatelens import fixtures as fx
from gatelens.functions.blocks import position
from gatelens.functions.joins import gather
from gatelens.plans.features import features_from_texts


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_gathered_rows_are_the_inner_join(spark):
    a = spark.createDataFrame([(1, 1, 2.5), (2, 3, None), (3, 7, 0.0)], "file long, n int, x double")
    b = spark.createDataFrame([(2, 1.5), (1, None)], "file long, y double")
    met = gather([a, b], "file")
    assert met.columns == ["file", "n", "x", "y"]
    assert sorted(map(tuple, met.collect())) == [(1, 1.0, 2.5, None), (2, 3.0, None, 1.5)]
    assert "Join" not in _plan(met)


def test_the_frame_broadcasts_no_table_of_circuits(spark):
    text = "qreg q[3];\nh q[0];\ncx q[0],q[1];\n"
    frame = features_from_texts(spark.createDataFrame([("a", text), ("b", text)], "file string, text string"))
    assert "Broadcast" not in _plan(frame) and frame.count() == 2


def test_positions_with_and_without_blocks(spark):
    rows = spark.range(1000).select((F.col("id") % 3).alias("k"), F.col("id"))
    blocked = position(rows, ["k"], F.floor(F.col("id") / 64), ["id"], "at")
    plain = position(rows, ["k"], F.floor(F.col("id") / 64), ["id"], "at", fx.longest(rows, "k"))
    assert sorted(map(tuple, blocked.select("k", "id", "at").collect())) == sorted(map(tuple, plain.collect()))
    assert "Join" not in _plan(plain)
