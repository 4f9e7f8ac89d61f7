"""Structured Streaming jobs over container logs and service samples.

The measures are those of `vitalake.operators.logs`; this module opens the streams, bounds their
state and starts the sinks.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vitalake.operators.logs import MAX_AGE, judge_records, parse_logs, reject_old
from vitalake.session import shared_dir
from vitalake.sources.readers import is_missing_path

# Raw container records as a shipper drops them: the record and the container's meta labels.
RECORD_SCHEMA = (
    "value string, meta_project string, meta_service string, meta_name string, meta_id string, "
    "arrived timestamp"
)
SAMPLE_SCHEMA = "ts timestamp, job string, value double"


def open_json(spark: SparkSession, path: str, schema: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of JSON lines that appear under `path`."""
    reader = spark.readStream.schema(schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(path)


def open_table(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Stream of the parquet files that appear under `path`."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def ingest(records: DataFrame, keep: Sequence[str], max_age: timedelta = MAX_AGE) -> DataFrame:
    """Records to log lines, without those that were too old when they arrived, whenever the job runs."""
    lines = parse_logs(records, keep, also=["arrived"])
    return reject_old(lines, as_of=F.col("arrived"), max_age=max_age).drop("arrived")


def _checkpoint(spark: SparkSession, name: str, checkpoint: str | None) -> str:
    """The given folder, else one in the shared folder of the cluster, which a restart finds again."""
    if not checkpoint and not spark.conf.get("spark.checkpoint.dir", None):
        raise ValueError("a stream needs a checkpoint folder, or spark.checkpoint.dir")
    return checkpoint or shared_dir(spark, f"streams/{name}")


def store_logs(
    lines: DataFrame, path: str, name: str = "logs", checkpoint: str | None = None, once: bool = False
) -> StreamingQuery:
    """Append log lines to a table partitioned by day, the unit that readers prune by.

    The file sink records each batch, so a restart after a lost driver neither drops nor repeats a line.
    """
    writer = (
        lines.withColumn("day", F.to_date("ts"))
        .writeStream.format("parquet")
        .partitionBy("day")
        .queryName(name)
        .option("checkpointLocation", _checkpoint(lines.sparkSession, name, checkpoint))
        .outputMode("append")
    )
    return (writer.trigger(availableNow=True) if once else writer).start(path)


def store_with_refused(
    records: DataFrame,
    keep: Sequence[str],
    path: str,
    refused: str,
    name: str = "logs",
    max_age: timedelta = MAX_AGE,
    checkpoint: str | None = None,
    once: bool = False,
) -> StreamingQuery:
    """Store the log lines of a stream of records under `path`, and those not stored, with the reason, under `refused`.

    Both have a folder per batch, with folders of days in it, and are written from one reading of the batch. A batch that
    is run again after a failure overwrites both of its folders, so each record is in one of the two tables, once.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        judged = batch.withColumn("day", F.to_date("ts")).persist()
        for rows, folder in ((judged.filter("refused IS NULL").drop("refused"), path), (judged.filter("refused IS NOT NULL"), refused)):
            rows.write.mode("overwrite").partitionBy("day").parquet(f"{folder}/batch={batch_id}")
        judged.unpersist()

    writer = (
        judge_records(records, keep, max_age)
        .writeStream.queryName(name)
        .option("checkpointLocation", _checkpoint(records.sparkSession, name, checkpoint))
        .foreachBatch(save)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def read_logs(spark: SparkSession, path: str, first: date, last: date) -> DataFrame:
    """Stored log lines of the days first..last; other days are not listed or read."""
    return spark.read.parquet(path).filter(F.col("day").between(F.lit(first), F.lit(last)))


def start_measure(
    measure: DataFrame,
    path: str,
    name: str,
    keys: Sequence[str],
    checkpoint: str | None = None,
    once: bool = False,
) -> StreamingQuery:
    """Keep a streaming measure as a table of changes, one folder per batch.

    Update mode emits the groups a batch changed. Each batch overwrites its own folder, so one that
    is run again after a failure leaves a single copy; `read_measure` takes the last state per key.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    missing = set(keys) - set(measure.columns)
    if missing:
        raise ValueError(f"keys not in the measure: {sorted(missing)}")
    writer = (
        measure.writeStream.queryName(name)
        .option("checkpointLocation", _checkpoint(measure.sparkSession, name, checkpoint))
        .outputMode("update")
        .foreachBatch(save)
    )
    return (writer.trigger(availableNow=True) if once else writer).start()


def compact_measure(spark: SparkSession, path: str, keys: Sequence[str]) -> int:
    """Write the present state as a base that stands for all batches so far; returns the last of them.

    Later reads take the newest base and the batches after it, so what they read follows the keys and not the
    age of the stream. Folders of batches up to the base may then be removed, as may older bases.
    """
    upto = spark.read.parquet(path).agg(F.max("batch")).first()[0]
    state = _state(_changes(spark, path).filter(F.col("batch") <= upto), keys)
    state.write.mode("overwrite").parquet(f"{_base(path)}/upto={upto}")
    return upto


def read_measure(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """Present state of a stored measure: the row of the latest batch per key."""
    return _state(_changes(spark, path), keys).drop("batch")


def _base(path: str) -> str:
    return f"{path.rstrip('/')}.base"


def _changes(spark: SparkSession, path: str) -> DataFrame:
    """The newest base, if there is one, and the batches after it."""
    batches = spark.read.parquet(path)
    try:
        bases = spark.read.parquet(_base(path))
    except AnalysisException as error:
        if is_missing_path(error):
            return batches
        raise
    newest = bases.agg(F.max("upto")).first()[0]
    base = bases.filter(F.col("upto") == newest).drop("upto")
    return base.unionByName(batches.filter(F.col("batch") > newest))


def _state(changes: DataFrame, keys: Sequence[str]) -> DataFrame:
    rest = [c for c in changes.columns if c not in (*keys, "batch")]
    newest = changes.groupBy(*keys).agg(F.max(F.struct("batch", *rest)).alias("_row"))
    return newest.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest], F.col("_row.batch").alias("batch"))
