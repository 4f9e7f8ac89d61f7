"""Plans that must hold when one key has a third of the rows, and with no broadcast."""

from contextlib import contextmanager

import pytest
from conftest import rows
from pyspark.sql import functions as F

from vitalake.operators import logs, lookups, merge
from vitalake.operators.occurrences import occurrence_id
from vitalake.session import bytes_under, size_shuffles


@contextmanager
def settings(spark, **values):
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


TIGHT = {
    "spark__sql__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "20k",
    "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "1.5",
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": "20k",
    "spark__sql__shuffle__partitions": "8",
}


def final_plan(df):
    df.write.format("noop").mode("overwrite").save()
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def hot(spark):
    """A third of the rows under one key, a fifth without a key, the rest spread out."""
    key = (
        F.when(F.col("id") % 3 == 0, "hot")
        .when(F.col("id") % 5 == 0, None)
        .otherwise(F.concat(F.lit("k"), F.col("id") % 997))
    )
    return spark.range(0, 60_000, 1, 8).select("id", key.alias("key"), F.md5(F.col("id").cast("string")).alias("pad"))


@pytest.fixture
def dim(spark):
    names = spark.range(0, 900, 1, 4).select(F.concat(F.lit("k"), "id").alias("name"), "id")
    return names.unionByName(spark.createDataFrame([("hot", -1)], "name string, id long"))


def test_hot_lookup_is_split(spark, hot, dim):
    want = rows(lookups.lookup(hot, dim, "key", "out"), "id", "out")
    with settings(spark, **TIGHT):
        found = lookups.lookup(hot, dim, "key", "out")
        assert "SortMergeJoin(skew=true)" in final_plan(found)
        assert rows(found, "id", "out") == want


def test_hot_orphans_are_split(spark, hot, dim):
    known = dim.filter("name != 'hot'")
    want = rows(lookups.orphans(hot, known, "key", "name"), "id")
    with settings(spark, **TIGHT):
        lost = lookups.orphans(hot, known, "key", "name")
        assert "SortMergeJoin(skew=true)" in final_plan(lost)
        assert rows(lost, "id") == want


def test_hot_keys_are_reduced_before_the_shuffle(spark, hot):
    latest = merge.latest_by_key(hot, ["key"], "id")
    got = latest.filter("key = 'hot'").first()
    assert got.id == 59_997 and latest.count() == hot.select("key").distinct().count()
    plan = latest._jdf.queryExecution().executedPlan().toString()
    assert plan.index("partial_max") > plan.index("Exchange hashpartitioning")


def test_copies_are_counted_once_and_dealt_out(spark):
    df = spark.range(0, 40_000, 1, 8).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 50).alias("x"))
    numbered = occurrence_id(df, "t", block=1000)
    plan = final_plan(numbered)
    assert "ReusedExchange" in plan
    assert numbered.count() == 40_000 and numbered.select("id").distinct().count() == 40_000


def test_rows_of_a_few_thousand_copies_are_dealt_out_too(spark):
    # 40 distinct rows of 500 copies: their counts fit one small partition, the rows they stand for must not.
    numbered = occurrence_id(spark.range(20_000).selectExpr("id % 40 AS key"), "t")
    sizes = [n for _, n in rows(numbered.groupBy(F.spark_partition_id()).count())]
    assert sum(sizes) == 20_000 and max(sizes) < 14_000
    assert numbered.select("id").distinct().count() == 20_000


def test_series_spread_buckets_and_not_rows(spark):
    lines = spark.range(0, 1000, 1, 4).select(
        F.timestamp_seconds(F.col("id") * 7).alias("ts"), F.lit("a").alias("s"), F.lit("x").alias("line")
    )
    plan = logs.rate(lines, ["s"])._jdf.queryExecution().executedPlan().toString()
    assert "Expand" not in plan and plan.count("Exchange") == 2


def test_no_python_in_the_plans(spark, hot, dim):
    for df in (lookups.lookup(hot, dim, "key", "o"), merge.latest_by_key(hot, ["key"], "id"), occurrence_id(hot, "t")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Cartesian" not in plan and "BroadcastNestedLoop" not in plan


def test_shuffles_are_sized_by_the_input(spark, tmp_path):
    spark.range(1000).write.parquet(str(tmp_path / "a" / "b"))
    size = bytes_under(spark, str(tmp_path / "a"))
    assert size > 4000
    with settings(spark, spark__sql__shuffle__partitions="4"):
        assert size_shuffles(spark, 10 * 2**40) == 40_960
        assert size_shuffles(spark, 100) == 40_960
