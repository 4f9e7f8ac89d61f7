import json
from datetime import datetime, timedelta, timezone

import pytest
from conftest import rows
from pyspark.sql import functions as F

from vitalake.functions.values import ERROR_WORDS
from vitalake.operators import logs
from vitalake.plans import dashboards, queries
from vitalake.session import shared_dir
from vitalake.streaming import log_streams

T0 = datetime(2026, 6, 17, 12, 0, tzinfo=timezone.utc)
MIN = timedelta(minutes=1)
KEEP = ["api", "gateway"]


def record(at, line, service="api", name="/stack-api-1"):
    value = json.dumps({"log": line, "stream": "stdout", "time": at.strftime("%Y-%m-%dT%H:%M:%S.%f") + "789Z"})
    return (value, "stack", service, name, f"id-{service}", T0)


RECORDS = [
    record(T0 - 5 * MIN, "ERROR on the lower edge"),
    record(T0 - 4 * MIN, "error one"),
    record(T0 - 4 * MIN + timedelta(seconds=30), "warn: panic"),
    record(T0 - 2 * MIN, "all fine"),
    record(T0, "Exception on the edge"),
    record(T0 - MIN, "error", "gateway", "/stack-gateway-1"),
    record(T0 - MIN, "error", "gateway-2"),
    record(T0 - timedelta(hours=169), "error, old"),
    record(T0 - timedelta(hours=168), "error, at the limit"),
]


@pytest.fixture
def records(spark):
    return spark.createDataFrame(RECORDS, log_streams.RECORD_SCHEMA)


@pytest.fixture
def lines(records):
    return logs.parse_logs(records, KEEP)


def test_parse(spark, lines):
    assert lines.count() == 8
    one = lines.filter("line = 'all fine'").first()
    assert (one.compose_service, one.container, one.container_id, one.stream) == ("api", "stack-api-1", "id-api", "stdout")
    # Nanoseconds are cut to microseconds.
    assert lines.filter(F.col("ts") == F.lit(T0)).count() == 1
    raw = spark.createDataFrame([("not json", "p", "api", "/c", "i", T0)], log_streams.RECORD_SCHEMA)
    kept = logs.parse_logs(raw, KEEP).first()
    assert kept.line == "not json" and kept.stream is None


def test_reject_old(lines):
    kept = logs.reject_old(lines, as_of=T0)
    assert kept.filter("line = 'error, old'").count() == 0
    assert kept.filter("line = 'error, at the limit'").count() == 1


def test_count_over_time(lines):
    span = 5 * MIN
    assert rows(logs.count_over_time(lines, T0, span, ERROR_WORDS)) == [(4,)]
    assert rows(logs.count_over_time(lines, T0, span, "nothing like it")) == [(0,)]
    by = logs.count_over_time(lines, T0, span, ERROR_WORDS, by=["compose_service"])
    assert rows(by) == [("api", 3), ("gateway", 1)]
    only = logs.count_over_time(lines, T0, span, labels={"compose_service": (".+", "api")})
    assert rows(only) == [(1,)]


def brute_series(samples, span, step, first, last):
    out, at = {}, first
    while at <= last:
        for service, ts in samples:
            if at - span < ts <= at:
                out[(service, at)] = out.get((service, at), 0) + 1
        at += step
    return out


@pytest.mark.parametrize(("span", "step"), [(5 * MIN, MIN), (5 * MIN, 5 * MIN), (3 * MIN, 2 * MIN)])
def test_series_against_brute_force(spark, span, step):
    samples = [
        ("a" if i % 3 else "b", T0 + timedelta(seconds=s))
        for i, s in enumerate([0, 0, 1, 59, 60, 61, 119, 120, 300, 301, 359, 360, 361, 900])
    ]
    df = spark.createDataFrame([(s, t) for s, t in samples], "compose_service string, ts timestamp")
    got = {
        (r.compose_service, r.window_end.replace(tzinfo=timezone.utc)): r.n
        for r in logs.count_series(df, ["compose_service"], span, step)
        .withColumn("window_end", F.col("window_end").cast("timestamp_ntz")).collect()
    }
    # Steps are whole multiples of the step since the epoch.
    first = datetime.fromtimestamp(T0.timestamp() // step.total_seconds() * step.total_seconds(), timezone.utc)
    assert got == brute_series(samples, span, step, first, T0 + timedelta(hours=1))


def test_rate_and_stats(spark):
    df = spark.createDataFrame([("a", T0 + timedelta(seconds=s)) for s in (1, 2, 70)], "s string, ts timestamp")
    series = logs.rate(df, ["s"], 5 * MIN, MIN)
    assert series.count() == 6
    stats = logs.series_stats(series, ["s"], "rate").first()
    assert stats.max_rate == pytest.approx(0.01) and stats.last_rate == pytest.approx(1 / 300)
    assert stats.sum_rate == pytest.approx(15 / 300) and stats.mean_rate == pytest.approx(15 / 300 / 6)


def test_search_and_labels(lines):
    newest = logs.search(lines, pattern=ERROR_WORDS, limit=2, tie=["line"]).collect()
    assert [r.line for r in newest] == ["Exception on the edge", "error"]
    assert [r[0] for r in logs.label_values(lines, "compose_service", exclude="gateway").collect()] == ["api"]
    chained = logs.label_values(lines, "container", labels={"compose_service": ("gateway", None)})
    assert rows(chained) == [("stack-gateway-1",)]


SAMPLES = [
    ("a", 0, 1.0), ("a", 15, 0.0), ("b", 0, 0.0), ("b", 30, 1.0), ("b", 45, None), ("c", 0, None), ("d", 0, 2.0),
    ("a", 60, 1.0), ("a", 61, 1.0),
]


def test_status_and_availability(spark):
    df = spark.createDataFrame([(T0 + timedelta(seconds=s), j, v) for j, s, v in SAMPLES],
                               "ts timestamp, job string, value double")
    assert rows(logs.service_status(df), "job", "status") == [("a", "UP"), ("b", "UP"), ("d", "2.0")]
    got = logs.availability(df, "a|b", MIN).withColumn("m", F.minute("window_end"))
    assert rows(got, "job", "m", "last", "up_ratio") == [
        ("a", 0, 1.0, 1.0), ("a", 1, 1.0, 0.5), ("a", 2, 1.0, 1.0), ("b", 0, 0.0, 0.0), ("b", 1, 1.0, 1.0),
    ]


def write_records(folder, batches):
    folder.mkdir()
    for i, batch in enumerate(batches):
        text = "\n".join(
            json.dumps(dict(zip(("value", "meta_project", "meta_service", "meta_name", "meta_id"), r[:5]))
                       | {"arrived": r[5].strftime("%Y-%m-%dT%H:%M:%SZ")})
            for r in batch
        )
        (folder / f"{i}.json").write_text(text)
    return str(folder)


def test_stream_equals_batch(spark, lines, tmp_path):
    source = write_records(tmp_path / "in", [RECORDS[:3], RECORDS[3:6], RECORDS[6:]])
    stream = logs.parse_logs(log_streams.open_json(spark, source, log_streams.RECORD_SCHEMA, 1), KEEP)
    series = logs.count_series(logs.watermark(stream), ["compose_service"], pattern=ERROR_WORDS)
    query = log_streams.start_measure(
        series, str(tmp_path / "out"), "errors", ["compose_service", "window_end"], str(tmp_path / "cp"), once=True
    )
    query.awaitTermination(300)
    got = log_streams.read_measure(spark, str(tmp_path / "out"), ["compose_service", "window_end"])
    want = logs.count_series(lines, ["compose_service"], pattern=ERROR_WORDS)
    in_range = F.col("window_end") >= F.lit(T0 - timedelta(hours=167))
    assert rows(got.filter(in_range), "compose_service", "window_end", "n") == rows(want.filter(in_range), "compose_service", "window_end", "n")


def test_compacted_measures_read_the_same(spark, tmp_path):
    folder, out, keys = tmp_path / "in", str(tmp_path / "out"), ["job"]

    def feed(number, *values):
        folder.mkdir(exist_ok=True)
        text = "".join(json.dumps({"ts": f"2024-01-01T00:00:{number:02}Z", "job": j, "value": v}) + "\n" for j, v in values)
        (folder / f"{number}.json").write_text(text)
        stream = log_streams.open_json(spark, str(folder), log_streams.SAMPLE_SCHEMA)
        status = logs.service_status(stream)
        log_streams.start_measure(status, out, f"status{number}", keys, str(tmp_path / "cp"), once=True).awaitTermination(300)
        return rows(log_streams.read_measure(spark, out, keys), "job", "status")

    assert feed(1, ("a", 1.0), ("b", 0.0)) == [("a", "UP"), ("b", "DOWN")]
    feed(2, ("a", 0.0))
    assert log_streams.compact_measure(spark, out, keys) >= 1
    assert rows(log_streams.read_measure(spark, out, keys), "job", "status") == [("a", "DOWN"), ("b", "DOWN")]
    assert feed(3, ("b", 1.0)) == [("a", "DOWN"), ("b", "UP")]
    log_streams.compact_measure(spark, out, keys)
    assert feed(4, ("c", 1.0)) == [("a", "DOWN"), ("b", "UP"), ("c", "UP")]
    plan = log_streams.read_measure(spark, out, keys)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch" in plan and "PartitionFilters: [isnotnull(upto" in plan


def test_store_and_read_by_day(spark, tmp_path):
    source = write_records(tmp_path / "in", [RECORDS])
    stream = log_streams.ingest(
        log_streams.open_json(spark, source, log_streams.RECORD_SCHEMA), KEEP, timedelta(days=36500)
    )
    table = str(tmp_path / "logs")
    log_streams.store_logs(stream, table, checkpoint=str(tmp_path / "cp"), once=True).awaitTermination(300)
    day = log_streams.read_logs(spark, table, T0.date(), T0.date())
    assert day.count() == 6
    plan = day._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(day" in plan
    log_streams.store_logs(
        log_streams.ingest(log_streams.open_json(spark, source, log_streams.RECORD_SCHEMA), KEEP, timedelta(days=36500)),
        table, checkpoint=str(tmp_path / "cp"), once=True,
    ).awaitTermination(300)
    assert spark.read.parquet(table).count() == 8


def test_ingest_goes_by_arrival_and_not_by_the_time_of_the_run(spark):
    """Lines of last year that arrived at once stay; a line that took ten days does not."""
    record = '{"log": "%s", "stream": "stdout", "time": "2024-01-01T00:00:00Z"}'
    at = datetime(2024, 1, 1, tzinfo=timezone.utc)
    raw = spark.createDataFrame(
        [(record % "soon", "p", "api", "/a", "1", at), (record % "late", "p", "api", "/a", "1", at + timedelta(days=10))],
        log_streams.RECORD_SCHEMA,
    )
    assert [r.line for r in log_streams.ingest(raw, ["api"]).collect()] == ["soon"]


def test_panels_read_their_days_only(spark, tmp_path, lines):
    path = str(tmp_path / "table")
    lines.withColumn("day", F.to_date("ts")).write.partitionBy("day").parquet(path)
    stored = spark.read.parquet(path)
    for name in ("services", "containers", "errors", "rate"):
        plan = dashboards.container_logs(stored, T0)[name]._jdf.queryExecution().executedPlan().toString()
        assert "PartitionFilters: [isnotnull(day" in plan, name


def test_long_series_have_short_plans(spark):
    lines = spark.createDataFrame([(T0 - timedelta(seconds=7), "a", "x")], "ts timestamp, s string, line string")
    day = logs.count_series(lines, ["s"], timedelta(hours=24), timedelta(seconds=15))
    short = logs.count_series(lines, ["s"], 5 * MIN, MIN)
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString())
    assert size(day) < 1.2 * size(short) and day.count() == 5760


def test_stream_labels(spark, tmp_path):
    source = write_records(tmp_path / "in", [RECORDS])
    stream = logs.parse_logs(log_streams.open_json(spark, source, log_streams.RECORD_SCHEMA), KEEP)
    values = logs.label_values(stream, "compose_service")
    out = str(tmp_path / "out")
    with pytest.raises(ValueError, match="keys not in the measure"):
        log_streams.start_measure(values, out, "labels", ["container"], str(tmp_path / "cp"))
    q = log_streams.start_measure(values, out, "labels", ["compose_service"], str(tmp_path / "cp"), once=True)
    q.awaitTermination(300)
    assert rows(spark.read.parquet(out), "compose_service") == [("api",), ("gateway",)]


def test_shared_folder_comes_from_the_session():
    class Session:
        def __init__(self, conf):
            self.conf = conf

    assert shared_dir(Session({"spark.checkpoint.dir": "hdfs:/shared/"}), "streams/x") == "hdfs:/shared/streams/x"
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Session({"spark.master": "yarn"}), "x")
    assert shared_dir(Session({"spark.master": "local[2]"}), "x").endswith("/x")


def test_sample_streams_equal_batch(spark, tmp_path):
    df = spark.createDataFrame([(T0 + timedelta(seconds=s), j, v) for j, s, v in SAMPLES],
                               log_streams.SAMPLE_SCHEMA)
    source = str(tmp_path / "in")
    df.repartition(3).write.json(source)

    def streamed(name, build, keys):
        out = str(tmp_path / name)
        stream = log_streams.open_json(spark, source, log_streams.SAMPLE_SCHEMA, 1)
        query = log_streams.start_measure(build(stream), out, name, keys, str(tmp_path / f"{name}-cp"), once=True)
        query.awaitTermination(300)
        return log_streams.read_measure(spark, out, keys)

    status = streamed("status", logs.service_status, ["job"])
    assert rows(status, "job", "last", "status") == rows(logs.service_status(df), "job", "last", "status")
    cols = ["job", "window_end", "last", "up_ratio"]
    up = streamed("up", lambda s: logs.availability(logs.watermark(s), "a|b", MIN), cols[:2])
    assert rows(up, *cols) == rows(logs.availability(df, "a|b", MIN), *cols)


def test_panels(lines, spark):
    df = spark.createDataFrame([(T0 + timedelta(seconds=s), j, v) for j, s, v in SAMPLES],
                               "ts timestamp, job string, value double")
    summary = dashboards.log_summary(lines, T0, 5 * MIN).first()
    assert (summary.total, summary.errors, summary.warnings, summary.fatals) == (5, 4, 1, 1)
    assert (summary.errors_band, summary.warnings_band, summary.fatals_band, summary.total_band) == (
        "orange", "yellow", "red", "blue",
    )
    empty = dashboards.log_summary(lines, T0, 5 * MIN, service="nobody").first()
    assert (empty.total, empty.errors, empty.errors_band) == (0, 0, "green")
    panels = dashboards.container_logs(lines, T0, timedelta(hours=1), service="api")
    assert rows(panels["services"]) == [("api",), ("gateway",)]
    assert rows(panels["containers"]) == [("stack-api-1",)]
    assert panels["errors"].count() == 4 and panels["lines"].count() == 5
    assert [r.max_rate for r in panels["rate_legend"].collect()] == [pytest.approx(4 / 300)]
    over = dashboards.overview(lines, df, T0)
    # What came after the shown time is not shown, nor what lies before it.
    assert rows(over["status"], "job", "band") == [("a", "green"), ("b", "red"), ("d", "green")]
    assert rows(over["availability_legend"], "job", "last_last") == [("a", 1.0), ("b", 0.0), ("d", 2.0)]
    later = dashboards.overview(lines, df, T0 + MIN)
    assert rows(later["status"], "job", "band") == [("a", "green"), ("b", "green"), ("d", "green")]
    assert dashboards.overview(lines, df, T0 + timedelta(days=2))["status"].count() == 0
    assert over["errors_by_service"].filter("band = 'green'").count() == 0
    assert over["errors_legend"].count() == 2


def test_refused_lines_are_kept_apart(spark, tmp_path):
    """Stored and refused lines are all that was read, also when the last batch is run again."""
    source, kept, refused, checkpoint = (tmp_path / x for x in ("in", "kept", "refused", "cp"))
    source.mkdir()
    now = T0
    records = [
        (json.dumps({"log": "fine", "stream": "stdout", "time": now.isoformat()}), "p", "api", "/c", "1", now.isoformat()),
        (json.dumps({"log": "late", "stream": "stdout", "time": (now - timedelta(hours=169)).isoformat()}), "p", "api", "/c", "2", now.isoformat()),
        ("no json", "p", "db", "/d", "3", now.isoformat()),
        ("no service", "p", None, "/d", "4", now.isoformat()),
        ("plain", "p", "api", "/c", "5", now.isoformat()),
    ]
    names = ("value", "meta_project", "meta_service", "meta_name", "meta_id", "arrived")

    def run(*lines):
        for i, r in enumerate(lines):
            (source / f"{r[4]}.json").write_text(json.dumps(dict(zip(names, r, strict=True))))
        stream = log_streams.open_json(spark, str(source), log_streams.RECORD_SCHEMA)
        log_streams.store_with_refused(stream, ["api"], str(kept), str(refused), "apart", checkpoint=str(checkpoint), once=True).awaitTermination(300)

    def stored():
        away = spark.read.parquet(str(refused)).select("container_id", "refused").collect()
        return sorted(r.container_id for r in spark.read.parquet(str(kept)).collect()), sorted(map(tuple, away))

    run(*records[:3])
    run(*records[3:])
    want = (["1", "5"], [("2", "age"), ("3", "service"), ("4", "service")])
    assert stored() == want
    # The last batch was written, but its commit was lost with the driver.
    last = max((checkpoint / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    last.unlink()
    (checkpoint / "commits" / f".{last.name}.crc").unlink(missing_ok=True)
    run()
    assert stored() == want


def test_parse_logs_query(spark, tmp_path):
    """The query returns log lines of the kept services, not the raw records."""
    rows_in = [(1, T0, 9, "click", "{}"), (2, T0 + MIN, 2, "error", '{"a": 1}'), (3, T0, 8, "click", "{}")]
    events = spark.createDataFrame(rows_in, "event_id long, ts timestamp, user_id long, event_type string, props string")
    events.withColumn("ts", F.col("ts").cast("timestamp_ntz")).write.parquet(f"{tmp_path}/events.parquet")
    got = queries.run("parse_logs", spark, str(tmp_path))
    assert rows(got, "event_id", "ts", "line", "stream", "container") == [
        (1, T0.replace(tzinfo=None), "click {}", "stdout", "c9"),
        (2, (T0 + MIN).replace(tzinfo=None), 'error {"a": 1}', "stdout", "c2"),
    ]
