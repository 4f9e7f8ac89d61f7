"""Landing of source files as versioned lake datasets.

Text sources land with every field as text, plus the place of the row in its file and the line of
any row whose field count is off. Both later loads, which read the same fields by different rules,
start from that table and never parse the files again.
"""

from __future__ import annotations

import logging
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from vitalake import schemas
from vitalake.sources.readers import is_missing_path, read_csv, read_json
from vitalake.sources.versions import AT_ONCE, Version, publish, stage_tables, write_version

log = logging.getLogger(__name__)


@dataclass(frozen=True)
class Source:
    """A file (or folder of files) to land, and how to read it.

    `multiline` lets cells of a CSV hold line breaks in quotes; its files are then read whole, each by one task.
    """

    dataset: str
    path: str
    kind: str = "csv"
    schema: T.StructType | None = None
    section: str = "raw/external"
    multiline: bool = False


# Dataset name, file name and format of the external datasets.
EXTERNAL = (
    ("daily_food", "daily_food_nutrition_dataset.csv", "csv", schemas.text_schema(schemas.DAILY_FOOD)),
    ("diet_recommendation", "diet_recommendations_dataset.csv", "csv", schemas.text_schema(schemas.DIET)),
    ("exercise", "exercises.json", "json", schemas.EXERCISE),
    ("workout_session", "gym_members_exercise_tracking.csv", "csv", schemas.text_schema(schemas.WORKOUT)),
)
EXPORTS = ("workout_session", "food_item", "exercise", "diet_recommendation")


def external_sources(folder: str, exercise: str = "json") -> list[Source]:
    """The external sources in a folder; `exercise` is "jsonl" for a file with one object a line."""
    kinds = {"exercise": exercise}
    return [Source(name, f"{folder}/{file}", kinds.get(name, kind), schema) for name, file, kind, schema in EXTERNAL]


def read_source(spark: SparkSession, source: Source) -> DataFrame:
    if source.kind in ("json", "jsonl"):
        return read_json(
            spark, source.path, source.schema, lines=source.kind == "jsonl", corrupt=True, seq=True
        )
    schema = source.schema
    if schema is None:
        header = spark.read.option("header", True).option("multiLine", source.multiline).csv(source.path).columns
        schema = T.StructType([T.StructField(name, T.StringType()) for name in header])
    return read_csv(spark, source.path, schema, corrupt=True, seq=True, multiline=source.multiline)


def land(spark: SparkSession, source: Source, root: str, label: str | None = None) -> str:
    """Land one source as a new version; returns its label."""
    return write_version(read_source(spark, source), root, source.section, source.dataset, label)


def land_all(
    spark: SparkSession,
    sources: list[Source],
    root: str,
    label: str | None = None,
    missing: str = "skip",
) -> dict[str, str]:
    """Land several sources; a missing one is skipped with a warning, or fails the run.

    They are read side by side, so that the last tasks of one do not idle the cluster, and published in their order.
    """
    if missing not in ("skip", "fail"):
        raise ValueError(f"missing must be 'skip' or 'fail', not {missing!r}")

    def stage(source: Source) -> Version:
        return stage_tables({"data": read_source(spark, source)}, root, source.section, source.dataset, label)

    labels = {}
    with ThreadPoolExecutor(max_workers=AT_ONCE) as pool:
        for source, staged in [(source, pool.submit(stage, source)) for source in sources]:
            try:
                version = staged.result()
            except AnalysisException as error:
                if not is_missing_path(error):
                    raise
                if missing == "fail":
                    raise FileNotFoundError(source.path) from None
                log.warning("skip %s: nothing at %s", source.dataset, source.path)
                continue
            publish(spark, root, [version])
            labels[source.dataset] = version.label
    return labels


def land_export(
    spark: SparkSession, path: str, dataset: str, root: str, label: str | None = None
) -> str:
    """Land an API export that was already fetched, under raw/api."""
    if dataset not in EXPORTS:
        raise ValueError(f"unknown export {dataset!r}; known: {', '.join(EXPORTS)}")
    schema = schemas.text_schema(schemas.WORKOUT_API) if dataset == "workout_session" else None
    return land(spark, Source(dataset, path, "csv", schema, "raw/api"), root, label)
