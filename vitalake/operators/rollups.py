"""A rollup of log lines: counts per day, service, severity and step, kept beside the log table.

A refresh lists the files of the log table by day and counts again only the days whose files changed since the
version before; the others keep their folders. Panels add up these counts; lines themselves are read only for the
parts of a step at the edges of a range that does not start or end on a step.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalake.functions import values
from vitalake.operators.logs import Labels, in_range, select_streams, spread_counts, step_end
from vitalake.sources.publications import Table, Version, VersionNotFound, claim
from vitalake.sources.versions import dataset_name, now_label, publish, resolve

SECTION, DATASET = "logs", "rollup"
SERVICE = "compose_service"
STEP = timedelta(minutes=1)
SEVERITIES = ("is_error", "is_warning", "is_fatal")
_MANIFEST = "day date, files long, mark long, folder string"
_COUNTS = f"{SERVICE} string, is_error boolean, is_warning boolean, is_fatal boolean, _end long, n long, day date"


def files_by_day(spark: SparkSession, path: str) -> DataFrame:
    """(day, files, mark, bytes) of a log table in folders of days: `mark` changes with any file's name, size or time."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.parquet").load(path)
    day = F.to_date(F.regexp_extract("path", "/day=([0-9-]+)/[^/]+$", 1))
    mark = F.xxhash64("path", "length", "modificationTime")
    by_day = listed.groupBy(day.alias("day")).agg(F.count("*").alias("files"), F.bit_xor(mark).alias("mark"), F.sum("length").alias("bytes"))
    return by_day.filter("day IS NOT NULL")


def count_lines(lines: DataFrame, step: timedelta = STEP, line: str = "line") -> DataFrame:
    """Lines per service, severity and step; a step is named by its end, in microseconds."""
    flags = values.severity_flags(line)
    kinds = [F.coalesce(flags[s], F.lit(False)).alias(s) for s in SEVERITIES]
    return lines.groupBy("day", SERVICE, *kinds, step_end("ts", step).alias("_end")).agg(F.count("*").alias("n"))


def _manifest(spark: SparkSession, root: str, version: Version | None) -> DataFrame:
    if version is None:
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).parquet(f"{root}/{version.folder}/manifest")


def _latest(spark: SparkSession, root: str) -> Version | None:
    try:
        return resolve(spark, root, SECTION, DATASET)
    except VersionNotFound:
        return None


def refresh(spark: SparkSession, path: str, root: str, label: str | None = None, step: timedelta = STEP) -> list[str]:
    """Bring the rollup of the log table at `path` up to date, as a new version; returns the days counted again.

    Days that left the table leave the rollup. Readers see the version before until all days are written; files that
    arrive meanwhile change the mark of their day, so the next refresh counts it. All versions of a root have one step.
    """
    root, label = root.rstrip("/"), label or now_label()
    old = _latest(spark, root)
    now = files_by_day(spark, path)
    known = _manifest(spark, root, old).withColumnsRenamed({"files": "old_files", "mark": "old_mark"})
    joined = now.join(known, "day", "left").withColumn("same", F.expr("files <=> old_files AND mark <=> old_mark"))
    days = joined.select("day", "files", "mark", "folder", F.coalesce("same", F.lit(False)).alias("same")).collect()  # one row a day
    changed = [d for d in days if not d.same]
    folder = claim(spark, root, dataset_name(SECTION, DATASET), label)
    if changed:
        lines = spark.read.parquet(path).filter(F.col("day").isin([d.day for d in changed]))
        count_lines(lines, step).repartition("day").sortWithinPartitions("_end", SERVICE).write.partitionBy("day").parquet(f"{root}/{folder}/counts")
    rows = [(d.day, d.files, d.mark, d.folder if d.same else f"{folder}/counts/day={d.day}") for d in days]
    spark.createDataFrame(rows, _MANIFEST).coalesce(1).write.parquet(f"{root}/{folder}/manifest")
    publish(spark, root, [Version(dataset_name(SECTION, DATASET), label, folder, (Table("manifest"),))])
    return sorted(str(d.day) for d in changed)


def read_rollup(spark: SparkSession, root: str, as_of: datetime | None = None, span: timedelta | None = None) -> DataFrame:
    """The counts of the latest version; with a range, only folders of its days are listed and read."""
    root = root.rstrip("/")
    manifest = _manifest(spark, root, resolve(spark, root, SECTION, DATASET))
    if as_of is not None:
        # Counts lie under the day of their lines, also those of a step that ends with the day.
        manifest = manifest.filter(F.col("day").between(F.lit((as_of - span).date()), F.lit(as_of.date())))
    folders = [f"{root}/{r.folder}" for r in manifest.select("folder").collect()]
    schema = _COUNTS.removesuffix(", day date")
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def _micros(moment: datetime) -> int:
    return (moment - datetime(1970, 1, 1, tzinfo=moment.tzinfo)) // timedelta(microseconds=1)


def _kept(rollup: DataFrame, labels: Labels | None, severity: str | None) -> DataFrame:
    rows = select_streams(rollup, labels)
    return rows if severity is None else rows.filter(F.col(severity))


def count_series(
    rollup: DataFrame,
    by: Sequence[str],
    span: timedelta,
    step: timedelta = STEP,
    severity: str | None = None,
    labels: Labels | None = None,
    kind: str = "timestamp_ntz",
) -> DataFrame:
    """`logs.count_series` from counts: (by.., window_end, n). The step is a multiple of the rollup's."""
    every = step // timedelta(microseconds=1)
    coarse = F.col("_end") + F.pmod(-F.col("_end"), F.lit(every))
    buckets = _kept(rollup, labels, severity).groupBy(*by, coarse.alias("_end")).agg(F.sum("n").alias("n"))
    return spread_counts(buckets, by, span, step, kind)


def rate(rollup: DataFrame, by: Sequence[str], span: timedelta, step: timedelta = STEP, **options) -> DataFrame:
    """Lines per second per label in the trailing range at every step."""
    series = count_series(rollup, by, span, step, **options)
    return series.select(*by, "window_end", (F.col("n") / span.total_seconds()).alias("rate"))


def shown(series: DataFrame, as_of: datetime, span: timedelta) -> DataFrame:
    """The points of the range before `as_of`."""
    return series.filter(in_range(series, "window_end", as_of, span))


def summary(
    rollup: DataFrame, lines: DataFrame, as_of: datetime, span: timedelta, labels: Labels | None = None, steps: dict | None = None,
    step: timedelta = STEP,
) -> DataFrame:
    """Errors, warnings, fatals and all lines of the range (as_of - span, as_of], and their bands, in one row.

    Whole steps come from the counts. Of the two steps that the range cuts, the lines are read; times are literals, so
    other days and blocks of the log table are skipped.
    """
    every = step // timedelta(microseconds=1)
    low, high = _micros(as_of - span), _micros(as_of)
    first, last = low + -low % every, high - high % every
    whole = rollup.filter((F.col("_end") > first) & (F.col("_end") <= last))
    if first > last:  # the range lies within one step
        edges = [(as_of, span)]
    else:
        until = timedelta(microseconds=1)
        edges = [(as_of - span + (first - low) * until, (first - low) * until), (as_of, (high - last) * until)]
    parts = [_kept(whole, labels, None).select(*SEVERITIES, "n")]
    for end, length in edges:
        if length:
            parts.append(select_streams(count_lines(_in_days(lines, end, length), step), labels).select(*SEVERITIES, "n"))
    total = parts[0]
    for part in parts[1:]:
        total = total.unionByName(part)

    def n(kind: Column) -> Column:
        return F.coalesce(F.sum(F.when(kind, F.col("n"))), F.lit(0))

    counts = total.agg(
        n(F.col("is_error")).alias("errors"), n(F.col("is_warning")).alias("warnings"), n(F.col("is_fatal")).alias("fatals"),
        n(F.lit(True)).alias("total"),
    )
    return counts.withColumns({f"{name}_band": values.band(name, s) for name, s in (steps or {}).items()})


def _in_days(lines: DataFrame, as_of: datetime, span: timedelta) -> DataFrame:
    return lines.filter(in_range(lines, "ts", as_of, span))
