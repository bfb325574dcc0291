"""Pairs of a key's rows: all of them, and dealt over many tasks."""

from collections import Counter

from pyspark.sql import functions as F

from revtrail.plans import views


def test_one_key_is_dealt_over_many_tasks(spark):
    left = spark.range(900).select(F.lit("a").alias("k"), F.col("id").alias("x"))
    right = spark.range(700).select(F.lit("a").alias("k"), F.col("id").alias("y"))
    rows = views.crossed(left, right, "k", block=100).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n"), F.countDistinct("x", "y").alias("d")).collect()
    assert sum(r["n"] for r in rows) == sum(r["d"] for r in rows) == 900 * 700
    assert len(rows) > 8 and max(r["n"] for r in rows) < 900 * 700 / 4


def test_repeats_nulls_and_lone_keys(spark):
    left = [("a", 1), ("a", 1), ("b", 2), (None, 3), ("c", 4)] + [("d", i) for i in range(7)]
    right = [("a", 8), ("a", 8), ("a", 9), (None, 8), ("e", 1)] + [("d", i % 2) for i in range(5)]
    want = Counter((k, x, y) for k, x in left for j, y in right if k is not None and j == k)
    got = views.crossed(spark.createDataFrame(left, "k string, x int"), spark.createDataFrame(right, "k string, y int"), "k", block=2)
    assert got.columns == ["k", "x", "y"]
    assert Counter(map(tuple, got.collect())) == want
