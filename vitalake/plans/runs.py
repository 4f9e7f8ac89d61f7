"""Whole loads against a lake folder: land, load the warehouse, load the serving store.

Every load of a dataset is published as one version: all its tables appear together or not at all.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalake import schemas
from vitalake.plans import serving, warehouse
from vitalake.session import bytes_under, size_shuffles
from vitalake.sources import publications
from vitalake.sources.backup import backup
from vitalake.sources.landing import external_sources, land_all, land_export
from vitalake.sources.buckets import ROWS, Merged, drop, merge_buckets
from vitalake.sources.publications import Table, Version
from vitalake.sources.tolerance import tolerate
from vitalake.sources.versions import (
    VersionNotFound,
    dataset_name,
    now_label,
    publish,
    read_version,
    refuse_published,
    resolve,
    stage_tables,
    tables_of,
    write_tables,
)

EXTERNAL, API, RAW, WAREHOUSE, SERVING = "raw/external", "raw/api", "warehouse/raw", "warehouse", "serving"
WAREHOUSE_DATASETS = tuple(warehouse.DATASETS)
SERVING_DATASETS = tuple(serving.DATASETS)


def _now() -> datetime:
    return datetime.now(timezone.utc)


def dump_external(spark: SparkSession, folder: str, root: str, label: str | None = None, missing: str = "skip",
                  exercise: str = "json"):
    """Land every external source found in `folder`; `exercise` is "jsonl" for a file with one object a line."""
    return land_all(spark, external_sources(folder, exercise), root, label, missing)


def dump_exports(spark: SparkSession, paths: dict[str, str], root: str, label: str | None = None):
    """Land fetched API exports, {dataset: path}."""
    return {name: land_export(spark, path, name, root, label) for name, path in paths.items()}


def _raw(spark: SparkSession, root: str, dataset: str, frame: DataFrame, label: str | None) -> DataFrame:
    """Write the raw table once, check it, and only then publish it: the check reads one column of the written table."""
    good: list[DataFrame] = []
    write_tables({"data": frame}, root, RAW, dataset, label, check=lambda t: good.extend(tolerate(t["data"])))
    return good[0]


class IdCollision(ValueError):
    """Two names have one id."""


#: What the id of a table stands for, where a table holds both; `patient_id` is the patient a row is of.
NAMED_BY = ("name", "id_data_set", "patient_id")


def _check_ids(tables: dict[str, DataFrame]) -> None:
    """Refuse a load in which an id stands for two names; reads two columns of each written table."""
    for table, df in tables.items():
        for column in (c for c in NAMED_BY if c in df.columns and "id" in df.columns):
            of = df.groupBy("id").agg(F.min(column).alias("a"), F.max(column).alias("b")).filter("a <> b")
            if (first := of.first()) is not None:
                raise IdCollision(f"{table}: {first.a!r} and {first.b!r} have the id {first.id}")


def _check_one_per_id(name: str, merged: Merged, load_ts: datetime) -> None:
    """Refuse a load in which an id stands for two rows, which in the serving store are two keys.

    Written rows are compared with each other, and ids that are new with those of the untouched buckets, of which one
    column is read, and none where no row is new.
    """
    of = merged.written.groupBy("id").agg(F.count("*").alias("n")).filter("n > 1")
    if (first := of.first()) is not None:
        raise IdCollision(f"{name}: {first.n} rows have the id {first.id}")
    new = merged.written.filter(F.col("created_at") == F.lit(load_ts)).select("id")
    if not new.isEmpty() and (first := merged.untouched.select("id").join(new, "id", "left_semi").first()) is not None:
        raise IdCollision(f"{name}: a new row has the id {first.id} of another")


def _landed_or_empty(spark: SparkSession, root: str, section: str, dataset: str, columns) -> DataFrame:
    try:
        return read_version(spark, root, section, dataset)
    except VersionNotFound:
        return spark.createDataFrame([], schemas.text_schema(columns))


def stage_warehouse_dataset(
    spark: SparkSession, root: str, dataset: str, load_ts: datetime | None = None, label: str | None = None
) -> Version:
    """Reload one warehouse dataset from the latest landed files; the version is written but not published."""
    load_ts = load_ts or _now()
    if dataset not in WAREHOUSE_DATASETS:
        raise ValueError(f"unknown dataset {dataset!r}; known: {', '.join(WAREHOUSE_DATASETS)}")
    if dataset == "exercise_db":
        frames = {dataset: warehouse.raw_exercise(read_version(spark, root, EXTERNAL, "exercise"))}
    elif dataset == "workout_session":
        external = read_version(spark, root, EXTERNAL, dataset)
        # No export yet is no error: the API part of the table is then empty.
        api = _landed_or_empty(spark, root, API, dataset, schemas.WORKOUT_API)
        frames = {
            "workout_csv": warehouse.raw_csv(external, schemas.WORKOUT),
            "workout_api": warehouse.raw_csv(api, schemas.WORKOUT_API),
        }
    else:
        columns = schemas.DAILY_FOOD if dataset == "daily_food" else schemas.DIET
        frames = {dataset: warehouse.raw_csv(read_version(spark, root, EXTERNAL, dataset), columns)}
    raws = [_raw(spark, root, name, frame, label) for name, frame in frames.items()]
    tables = warehouse.build(dataset, raws, load_ts)
    return stage_tables(tables, root, WAREHOUSE, dataset, label, sort_keys=schemas.SORT_KEY, check=_check_ids)


def load_warehouse_dataset(
    spark: SparkSession, root: str, dataset: str, load_ts: datetime | None = None, label: str | None = None
) -> str:
    """Reload one warehouse dataset from the latest landed files and publish it; returns its label."""
    version = stage_warehouse_dataset(spark, root, dataset, load_ts, label)
    publish(spark, root, [version])
    return version.label


def stage_serving_dataset(
    spark: SparkSession,
    root: str,
    dataset: str,
    load_ts: datetime | None = None,
    label: str | None = None,
    enums: serving.Enums | None = None,
    rows: int = ROWS,
) -> tuple[Version, dict[str, int]]:
    """Merge the latest landed files into the serving tables: a version, not published, and rows skipped as malformed.

    The tables are kept as buckets of their key, of about `rows` rows each. Only buckets that the landed rows touch are
    read and written. An id that stands for two rows is refused.
    """
    load_ts, label, root = load_ts or _now(), label or now_label(), root.rstrip("/")
    if dataset not in SERVING_DATASETS:
        raise ValueError(f"unknown dataset {dataset!r}; known: {', '.join(SERVING_DATASETS)}")
    refuse_published(spark, root, SERVING, dataset, label)
    try:
        old = resolve(spark, root, SERVING, dataset)
    except VersionNotFound:
        old = None
    source = {"food_item": "daily_food", "exercise": "exercise", "diet": "diet_recommendation"}[dataset]
    landed = read_version(spark, root, EXTERNAL, source)
    folder = publications.claim(spark, root, dataset_name(SERVING, dataset), label)
    kept = f"{root}/{folder}/reduced"

    def keep(df: DataFrame) -> DataFrame:
        df.write.parquet(kept)
        return spark.read.schema(df.schema).parquet(kept)

    found = serving.changes(dataset, landed, tables_of(spark, root, old) if old else {}, load_ts, enums, keep=keep)
    skipped = serving.skipped_foods(landed).count() if dataset == "food_item" else 0

    def write(name: str) -> Table:
        schema, change = T.StructType.fromDDL(serving.TABLE_SCHEMA[name]), found[name]
        merged = merge_buckets(change.rows, root, old, folder, name, (change.key,), schema, change.apply, rows)
        _check_one_per_id(name, merged, load_ts)
        return merged.table

    # All side by side, so that the last ones do not idle the cluster.
    with ThreadPoolExecutor(max_workers=len(found)) as pool:
        tables = tuple(pool.map(write, found))
    drop(spark, kept)
    others = [t for t in (old.tables if old else ()) if t.name not in found]
    if others:
        raise ValueError(f"{dataset}: the published version has further tables: {', '.join(t.name for t in others)}")
    return Version(dataset_name(SERVING, dataset), label, folder, tables), {"skipped": skipped}


def load_serving_dataset(
    spark: SparkSession,
    root: str,
    dataset: str,
    load_ts: datetime | None = None,
    label: str | None = None,
    enums: serving.Enums | None = None,
    rows: int = ROWS,
) -> dict[str, int]:
    """Merge the latest landed files into the serving tables and publish them; returns rows skipped as malformed."""
    version, report = stage_serving_dataset(spark, root, dataset, load_ts, label, enums, rows)
    publish(spark, root, [version])
    return report


@contextmanager
def _sized_for(spark: SparkSession, root: str, names: Iterable[tuple[str, str]]) -> Iterator[None]:
    """Shuffles that fit the largest of the landed datasets, while the loads run side by side."""
    key = "spark.sql.shuffle.partitions"
    before, sizes = spark.conf.get(key), [0]
    for section, name in names:
        try:
            folder = resolve(spark, root, section, name).folder
        except VersionNotFound:
            continue
        sizes.append(bytes_under(spark, f"{root.rstrip('/')}/{folder}"))
    size_shuffles(spark, max(sizes))
    try:
        yield
    finally:
        spark.conf.set(key, before)


_LANDED = [(EXTERNAL, d) for d in ("daily_food", "diet_recommendation", "exercise", "workout_session")]


def _in_parallel(names: Iterable[str], job: Callable[[str], object]) -> dict[str, object]:
    """Independent loads side by side, so that the tail of one does not idle the cluster."""
    names = list(names)
    if not names:
        return {}
    with ThreadPoolExecutor(max_workers=len(names)) as pool:
        return dict(zip(names, pool.map(job, names)))


def load_warehouse(spark: SparkSession, root: str, load_ts: datetime | None = None, label: str | None = None,
                   datasets: Iterable[str] = WAREHOUSE_DATASETS, together: bool = False) -> dict[str, object]:
    """Reload the warehouse datasets, all with one load time.

    `together` publishes them in one entry, so that readers see all of them change at once, or none if one fails.
    """
    load_ts = load_ts or _now()
    with _sized_for(spark, root, [*_LANDED, (API, "workout_session")]):
        if not together:
            return _in_parallel(datasets, lambda d: load_warehouse_dataset(spark, root, d, load_ts, label))
        staged = _in_parallel(datasets, lambda d: stage_warehouse_dataset(spark, root, d, load_ts, label))
    if staged:
        publish(spark, root, list(staged.values()))
    return {name: version.label for name, version in staged.items()}


def load_serving(spark: SparkSession, root: str, load_ts: datetime | None = None, label: str | None = None,
                 datasets: Iterable[str] = SERVING_DATASETS, enums: serving.Enums | None = None, together: bool = False):
    """Merge the serving datasets, all with one load time; `together` publishes them in one entry."""
    load_ts = load_ts or _now()
    with _sized_for(spark, root, _LANDED):
        if not together:
            return _in_parallel(datasets, lambda d: load_serving_dataset(spark, root, d, load_ts, label, enums))
        staged = _in_parallel(datasets, lambda d: stage_serving_dataset(spark, root, d, load_ts, label, enums))
    if staged:
        publish(spark, root, [version for version, _ in staged.values()])
    return {name: report for name, (_, report) in staged.items()}


def backup_services(services: dict[str, dict[str, DataFrame]], root: str, label: str | None = None):
    """Snapshot the tables of several services, {service: {table: frame}}."""
    return _in_parallel(services, lambda name: backup(services[name], root, name, label))


def run_all(spark: SparkSession, folder: str, exports: dict[str, str], root: str,
            load_ts: datetime | None = None, label: str | None = None) -> dict[str, object]:
    """Land everything, then load the warehouse and the serving store."""
    load_ts = load_ts or _now()
    return {
        "external": dump_external(spark, folder, root, label),
        "exports": dump_exports(spark, exports, root, label),
        "warehouse": load_warehouse(spark, root, load_ts, label),
        "serving": load_serving(spark, root, load_ts, label),
    }
