"""The rollup of log lines, and series filled across gaps."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from conftest import rows
from pyspark.sql import functions as F

from vitalake.functions import values
from vitalake.operators import logs, rollups
from vitalake.plans import dashboards
from vitalake.sources import versions

START = datetime(2026, 3, 1, tzinfo=timezone.utc)
MIN = timedelta(minutes=1)
LINES = "ts timestamp, compose_service string, container string, line string"


def lines_of(spark, seed, first, last, n=400):
    pick = random.Random(seed)
    span = int((last - first).total_seconds() * 1e6)
    data = [
        (first + timedelta(microseconds=pick.choice([pick.randrange(span), 60_000_000 * pick.randrange(span // 60_000_000)])),
         pick.choice(["a", "b", "c"]), "x", pick.choice(["ok", "an ERROR", "warn: x", "fatal", None, "panic and warning"]))
        for _ in range(n)
    ]
    return spark.createDataFrame(data, LINES).withColumn("day", F.to_date("ts"))


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    """A log table of three days with its rollup."""
    root = tmp_path_factory.mktemp("rollup")
    path = f"{root}/lines"
    lines_of(spark, 1, START, START + timedelta(days=3)).write.partitionBy("day").parquet(path)
    assert rollups.refresh(spark, path, str(root), "1") == ["2026-03-01", "2026-03-02", "2026-03-03"]
    return path, str(root)


@pytest.mark.parametrize(("severity", "pattern"), [(None, None), ("is_error", values.ERROR_WORDS), ("is_warning", values.WARN_WORDS)])
def test_series_equal_those_of_lines(spark, table, severity, pattern):
    path, root = table
    lines, counts = spark.read.parquet(path), rollups.read_rollup(spark, root)
    for span, step in ((5 * MIN, MIN), (timedelta(hours=1), 5 * MIN), (timedelta(hours=6), MIN)):
        want = logs.count_series(lines, ["compose_service"], span, step, pattern)
        got = rollups.count_series(counts, ["compose_service"], span, step, severity, kind="timestamp")
        assert rows(got) == rows(want)
    # In total and with chosen labels.
    want = logs.count_series(lines, [], 5 * MIN, MIN, pattern, {"compose_service": ("a|b", None)})
    assert rows(rollups.count_series(counts, [], 5 * MIN, MIN, severity, {"compose_service": ("a|b", None)}, "timestamp")) == rows(want)


@pytest.mark.parametrize("cut", [timedelta(), timedelta(seconds=13, microseconds=7), timedelta(microseconds=1)])
@pytest.mark.parametrize("span", [timedelta(hours=30), MIN, timedelta(seconds=20), timedelta(seconds=95)])
def test_summary_equals_that_of_lines(spark, table, cut, span):
    path, root = table
    lines, as_of = spark.read.parquet(path), START + timedelta(hours=40) + cut
    got = rollups.summary(rollups.read_rollup(spark, root, as_of, span), lines, as_of, span, {"compose_service": (".+", "c")}, dashboards.LOG_STEPS)
    assert got.collect() == dashboards.log_summary(lines, as_of, span, ".+", "c").collect()


def test_long_series_equal_spread_ones(spark, table):
    lines = spark.read.parquet(table[0])
    for by, span, step in ((["compose_service"], timedelta(hours=6), MIN), ([], timedelta(hours=1), timedelta(seconds=15)), (["container", "compose_service"], MIN, MIN)):
        for pattern, labels in ((None, None), (values.ERROR_WORDS, {"compose_service": ("a|b", None)})):
            got = logs.count_long_series(lines, by, span, step, pattern, labels)
            assert rows(got) == rows(logs.count_series(lines, by, span, step, pattern, labels))
    assert logs.count_long_series(lines.limit(0), [], MIN, MIN).count() == 0


def test_panel_reads_no_line(spark, table):
    counts = rollups.read_rollup(spark, table[1], START + timedelta(days=1), timedelta(hours=3))
    plan = rollups.rate(counts, ["compose_service"], 5 * MIN)._jdf.queryExecution().toString()
    assert "line" not in plan.replace(table[1], "") and f"{table[0]}" not in plan
    assert {str(f).split("day=")[1][:10] for f in counts.inputFiles()} == {"2026-03-01", "2026-03-02"}


def test_refresh_counts_changed_days_only(spark, tmp_path):
    path, root = f"{tmp_path}/lines", str(tmp_path)
    lines_of(spark, 2, START, START + timedelta(days=3)).write.partitionBy("day").parquet(path)
    rollups.refresh(spark, path, root, "1")
    assert rollups.refresh(spark, path, root, "2") == []
    more = lines_of(spark, 3, START + timedelta(days=1), START + timedelta(days=2), 50)
    more.write.mode("append").partitionBy("day").parquet(path)
    lines_of(spark, 4, START + timedelta(days=5), START + timedelta(days=6), 50).write.mode("append").partitionBy("day").parquet(path)
    assert rollups.refresh(spark, path, root, "3") == ["2026-03-02", "2026-03-06"]
    folders = {r.day.day: r.folder for r in spark.read.parquet(f"{root}/{versions.resolve(spark, root, 'logs', 'rollup').folder}/manifest").collect()}
    assert {d: f.split("/")[2] for d, f in folders.items()} == {1: "1", 2: "3", 3: "1", 6: "3"}
    lines = spark.read.parquet(path)
    want = logs.count_series(lines, ["compose_service"], 5 * MIN, MIN)
    assert rows(rollups.count_series(rollups.read_rollup(spark, root), ["compose_service"], 5 * MIN, kind="timestamp")) == rows(want)
    with pytest.raises(versions.VersionExists):
        rollups.refresh(spark, path, root, "3")
    # A day that left the table leaves the rollup.
    spark.read.parquet(path).filter("day <> '2026-03-01'").write.partitionBy("day").parquet(f"{tmp_path}/fewer")
    rollups.refresh(spark, f"{tmp_path}/fewer", root, "4")
    assert rollups.read_rollup(spark, root).agg(F.sum("n")).first()[0] == lines.filter("day <> '2026-03-01'").count()


def filled(samples, as_of, span, step, staleness):
    """samples: (ts, job, value)."""
    out = []
    grid = [START + k * step for k in range(int((as_of - START) / step) + 1)]
    low = as_of - span - staleness
    known = [s for s in samples if s[2] is not None and low < s[0] <= as_of]
    for job in sorted({s[1] for s in known}):
        for end in (g for g in grid if as_of - span < g <= as_of):
            seen = [(t, v) for t, j, v in known if j == job and t <= end]
            newest = max(seen)[0] if seen else None
            fresh = newest is not None and end - newest < staleness
            last = max(seen)[1] if fresh else None
            own = [v for t, j, v in known if j == job and end - step < t <= end]
            age = (end - newest).total_seconds() if fresh else None
            out.append((job, end.replace(tzinfo=None), last, sum(own) / len(own) if own else None, age))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("seed", "slice_steps"), [(1, 1024), (2, 7), (3, 1)])
def test_filled_series(spark, monkeypatch, seed, slice_steps):
    monkeypatch.setattr(logs, "SLICE_STEPS", slice_steps)
    pick = random.Random(seed)
    samples, at = [], START
    while at < START + timedelta(hours=3):
        at += timedelta(seconds=pick.choice([5, 30, 60, 400, 1500]))
        samples.append((at, pick.choice(["hot", "hot", "hot", "cold"]), pick.choice([0.0, 1.0, None])))
    samples = list({(t, j): (t, j, v) for t, j, v in samples}.values())
    df = spark.createDataFrame(samples, "ts timestamp, job string, value double").repartition(5)
    for as_of, span in ((START + timedelta(hours=2, seconds=7), timedelta(hours=1)), (START + timedelta(hours=3), timedelta(minutes=20))):
        got = logs.availability_filled(df, as_of, span, step=MIN, staleness=10 * MIN)
        have = [(r.job, r.window_end.astimezone(timezone.utc).replace(tzinfo=None), r.last, r.up_ratio, r.age_s) for r in got.collect()]
        assert sorted(have, key=repr) == filled(samples, as_of, span, MIN, 10 * MIN)
    assert logs.availability_filled(df, START - timedelta(days=9), MIN, step=MIN).count() == 0


def test_one_job_is_many_groups(spark):
    """A job with all samples is filled over 26 slices."""
    df = spark.range(20_000).select((F.lit(START) + F.make_dt_interval(secs=F.col("id") * 20)).alias("ts"), F.lit("one").alias("job"), F.lit(1.0).alias("value"))
    as_of = START + timedelta(seconds=400_000)
    got = logs.availability_filled(df, as_of, timedelta(seconds=390_000), step=timedelta(seconds=15))
    assert got.filter("last = 1.0").count() == got.count() == 26_000
