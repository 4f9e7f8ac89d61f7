"""A log table whose closed days lie in few files, ordered by service and time.

The stream leaves small files in folders of days, in order of arrival. Compaction writes the lines of closed days again, by
range of (service, ts), and publishes a manifest: which files hold a day, with the services and times that each covers.
Readers take the files of the manifest that may hold what they look for, and the stream's own files for days that are open,
not compacted yet, or have got lines since: the mark of a day tells. So every reader sees each line once,
before, during and after a compaction, and the stream's files may go once no reader uses them.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalake.operators.logs import in_range
from vitalake.operators.rollups import SERVICE, files_by_day
from vitalake.sources.publications import Table, Version, VersionNotFound, claim
from vitalake.sources.versions import dataset_name, now_label, publish, resolve

SECTION, DATASET = "logs", "clustered"
#: Bytes of a compacted file, about.
FILE_BYTES = 256 << 20
_MANIFEST = "day date, files long, mark long, file string, low string, high string, first timestamp, last timestamp, n long"


def _latest(spark: SparkSession, root: str) -> DataFrame:
    try:
        version = resolve(spark, root, SECTION, DATASET)
    except VersionNotFound:
        return spark.createDataFrame([], _MANIFEST)
    return spark.read.schema(_MANIFEST).parquet(f"{root}/{version.folder}/manifest")


def _same(now: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of the manifest whose days have the files they were made from."""
    return known.join(now.drop("bytes"), ["day", "files", "mark"], "left_semi")


def compact(spark: SparkSession, path: str, root: str, until: date, label: str | None = None, file_bytes: int = FILE_BYTES) -> list[str]:
    """Compact the days before `until` that are not compacted as they are now; returns these days.

    Days that left the table leave the manifest; days compacted earlier keep their files.
    """
    root, label = root.rstrip("/"), label or now_label()
    now = files_by_day(spark, path).filter(F.col("day") < F.lit(until))
    kept = _same(now, _latest(spark, root))
    todo = now.join(kept.select("day").distinct(), "day", "left_anti").collect()  # one row a day
    if not todo:
        return []
    folder = claim(spark, root, dataset_name(SECTION, DATASET), label)
    days = [r.day for r in todo]
    size = sum(r.bytes for r in todo)
    lines = spark.read.parquet(path).filter(F.col("day").isin(days))
    # A day is cut by ranges of service and time, so one service with most lines fills files of its own.
    ordered = lines.repartitionByRange(max(1, -(-size // file_bytes)), "day", SERVICE, "ts").sortWithinPartitions("day", SERVICE, "ts")
    ordered.write.partitionBy("day").option("compression", "zstd").parquet(f"{root}/{folder}/lines")
    written = spark.read.parquet(f"{root}/{folder}/lines")
    name = F.concat(F.lit(f"{folder}/lines/"), F.regexp_extract("_metadata.file_path", "(day=[^/]+/[^/]+)$", 1))
    files = written.groupBy("day", name.alias("file")).agg(
        F.min(SERVICE).alias("low"), F.max(SERVICE).alias("high"), F.min(F.col("ts").cast("timestamp")).alias("first"),
        F.max(F.col("ts").cast("timestamp")).alias("last"), F.count("*").alias("n"),
    )
    marks = spark.createDataFrame([(r.day, r.files, r.mark) for r in todo], "day date, files long, mark long")
    columns = [c.split()[0] for c in _MANIFEST.split(", ")]
    fresh = files.join(F.broadcast(marks), "day").select(columns)
    fresh.unionByName(kept.select(columns)).coalesce(1).write.parquet(f"{root}/{folder}/manifest")
    publish(spark, root, [Version(dataset_name(SECTION, DATASET), label, folder, (Table("manifest"),))])
    return sorted(str(d) for d in days)


def read_lines(
    spark: SparkSession, path: str, root: str, as_of: datetime, span: timedelta, services: Sequence[str] = ()
) -> DataFrame:
    """Lines of the range (as_of - span, as_of], of all services or some.

    Of compacted days only files that cover one of the services and a part of the range are opened. A line without a
    service is found where no service is asked for.
    """
    root = root.rstrip("/")
    table = spark.read.parquet(path)
    inside = F.col("day").between(F.lit((as_of - span).date()), F.lit(as_of.date()))
    now = files_by_day(spark, path).filter(inside)
    known = _same(now, _latest(spark, root).filter(inside))
    done = [r.day for r in known.select("day").distinct().collect()]
    wanted = known.filter((F.col("last") > F.lit(as_of - span)) & (F.col("first") <= F.lit(as_of)))
    if services:
        wanted = wanted.filter(F.exists(F.array(*[F.lit(s) for s in services]), lambda s: (F.col("low") <= s) & (F.col("high") >= s)))
    parts = [table.filter(inside & ~F.col("day").isin(done)) if done else table]
    by_version: dict[str, list[str]] = {}
    for r in wanted.select("file").collect():
        by_version.setdefault(r.file.rsplit("/day=", 1)[0], []).append(f"{root}/{r.file}")
    parts += [spark.read.schema(table.schema).option("basePath", f"{root}/{base}").parquet(*files) for base, files in sorted(by_version.items())]
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    rows = rows.filter(in_range(rows, "ts", as_of, span))
    return rows.filter(F.col(SERVICE).isin(*services)) if services else rows
