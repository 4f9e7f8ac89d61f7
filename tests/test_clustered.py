"""Compaction of the log table while it is read and written."""

from datetime import timedelta

import pytest
from conftest import rows
from pyspark.sql import functions as F
from test_rollups import START, lines_of

from vitalake.sources import versions
from vitalake.streaming import clustered

DAYS = timedelta(days=4)
END = START + DAYS


@pytest.fixture
def table(spark, tmp_path):
    path = f"{tmp_path}/lines"
    for seed in range(3):
        lines_of(spark, seed, START, START + timedelta(days=3), 300).repartition(4).write.mode("append").partitionBy("day").parquet(path)
    return path, str(tmp_path)


def read(spark, table, *services, span=DAYS, as_of=END):
    return clustered.read_lines(spark, *table, as_of, span, services).select("ts", "compose_service", "container", "line", "day")


def plain(spark, table, *services, span=DAYS, as_of=END):
    df = spark.read.parquet(table[0]).filter((F.col("ts") > F.lit(as_of - span)) & (F.col("ts") <= F.lit(as_of)))
    return (df.filter(F.col("compose_service").isin(*services)) if services else df).select("ts", "compose_service", "container", "line", "day")


def test_same_rows_before_during_and_after(spark, table):
    path, root = table
    want = rows(plain(spark, table))
    before = read(spark, table)
    assert rows(before) == want
    assert clustered.compact(spark, path, root, (START + timedelta(days=2)).date(), "1", 4000) == ["2026-03-01", "2026-03-02"]
    assert rows(before) == rows(read(spark, table)) == want  # a reader that began before goes on
    # A day that gets more lines is read from the stream's files until it is compacted again.
    late = lines_of(spark, 9, START, START + timedelta(days=1), 40)
    late.write.mode("append").partitionBy("day").parquet(path)
    want = rows(plain(spark, table))
    assert rows(read(spark, table)) == want
    assert clustered.compact(spark, path, root, END.date(), "2", 4000) == ["2026-03-01", "2026-03-03"]
    assert rows(read(spark, table)) == want and clustered.compact(spark, path, root, END.date(), "3") == []
    manifest = clustered._latest(spark, root)
    assert {(r.day.day, r.file.split("/")[2]) for r in manifest.collect()} == {(1, "2"), (2, "1"), (3, "2")}
    assert manifest.agg(F.sum("n")).first()[0] == len(want)


def test_a_search_opens_a_share_of_the_files(spark, table):
    path, root = table
    clustered.compact(spark, path, root, END.date(), "1", 1500)
    every = set(read(spark, table).inputFiles())
    raw = {f for f in every if f.startswith(f"file://{path}")}
    some = {f for f in read(spark, table, "b").inputFiles()} - raw
    assert len(some) < 0.7 * len(every - raw) and len(every - raw) >= 9
    for services, span, as_of in ((("b",), DAYS, END), (("a", "c"), timedelta(hours=5), START + timedelta(hours=30)), ((), timedelta(hours=1), START + timedelta(days=1))):
        assert rows(read(spark, table, *services, span=span, as_of=as_of)) == rows(plain(spark, table, *services, span=span, as_of=as_of))
    assert read(spark, table, "none").count() == 0


def test_a_failed_compaction_leaves_the_table(spark, table, monkeypatch):
    path, root = table
    want = rows(plain(spark, table))
    monkeypatch.setattr(clustered, "publish", lambda *a: (_ for _ in ()).throw(RuntimeError("lost")))
    with pytest.raises(RuntimeError):
        clustered.compact(spark, path, root, END.date(), "1")
    monkeypatch.undo()
    with pytest.raises(versions.VersionNotFound):
        versions.resolve(spark, root, "logs", "clustered")
    assert rows(read(spark, table)) == want
    assert len(clustered.compact(spark, path, root, END.date(), "1")) == 3 and rows(read(spark, table)) == want
