"""Versioned tables: one folder per label, published through the log of the lake.

A version is a set of tables under <root>/<section>/<dataset>/<label>/<table>. It becomes visible with an entry of
the publication log that is put after every table is written, so readers see all tables of a load or none. One
entry can publish the versions of several datasets. Earlier versions stay as they are.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from vitalake.sources import publications
from vitalake.sources.buckets import read_table
from vitalake.sources.publications import Table, Version, VersionExists, VersionNotFound

__all__ = ["Version", "VersionExists", "VersionNotFound"]

#: Tables of a version that are written side by side.
AT_ONCE = 4


def now_label(now: datetime | None = None) -> str:
    """UTC label of a moment, for example 2026-06-17T03-00-00Z."""
    return (now or datetime.now(timezone.utc)).astimezone(timezone.utc).strftime("%Y-%m-%dT%H-%M-%SZ")


def dataset_name(section: str, dataset: str) -> str:
    """Name of a dataset in the log, and its folder under the root."""
    return f"{section.strip('/')}/{dataset.strip('/')}"


def resolve(spark: SparkSession, root: str, section: str, dataset: str, version: str = "latest", number: int | None = None) -> Version:
    """The latest or an exact version; with `number`, as of that publication."""
    return publications.resolve(spark, root.rstrip("/"), dataset_name(section, dataset), version, number)


def refuse_published(spark: SparkSession, root: str, section: str, dataset: str, label: str) -> None:
    """Raise VersionExists for a published label, before any work is done; publishing checks again."""
    try:
        resolve(spark, root, section, dataset, label)
    except VersionNotFound:
        return
    raise VersionExists(f"{dataset_name(section, dataset)}@{label}")


def stage_tables(
    tables: dict[str, DataFrame],
    root: str,
    section: str,
    dataset: str,
    label: str | None = None,
    *,
    sort_keys: dict[str, Sequence[str]] | None = None,
    check: Callable[[dict[str, DataFrame]], object] | None = None,
    compression: str = "zstd",
) -> Version:
    """Write a set of tables as one version that is not published yet; a published label is refused.

    Tables with a sort key are sorted inside each file, so that parquet min/max skip blocks on
    reads by that key; this needs no shuffle. Tables are written side by side. `check` gets the written tables and
    raises to refuse the version. Each attempt at a label has a folder of its own, so two writers
    never write the same files, and what a failed load left is not read.
    """
    label, root = label or now_label(), root.rstrip("/")
    spark = next(iter(tables.values())).sparkSession
    refuse_published(spark, root, section, dataset, label)
    folder = publications.claim(spark, root, dataset_name(section, dataset), label)

    def write(name: str) -> Table:
        df = tables[name]
        keys = [k for k in (sort_keys or {}).get(name, ()) if k in df.columns]
        out = df.sortWithinPartitions(*keys) if keys else df
        out.write.option("compression", compression).parquet(f"{root}/{folder}/{name}")
        return Table(name, df.schema.json())

    with ThreadPoolExecutor(max_workers=AT_ONCE) as pool:
        written = tuple(pool.map(write, tables))
    version = Version(dataset_name(section, dataset), label, folder, written)
    if check:
        check(tables_of(spark, root, version))
    return version


def write_tables(tables: dict[str, DataFrame], root: str, section: str, dataset: str, label: str | None = None, **options) -> str:
    """Write a set of tables as one version and publish it (see `stage_tables`); returns the label."""
    version = stage_tables(tables, root, section, dataset, label, **options)
    publications.publish(next(iter(tables.values())).sparkSession, root.rstrip("/"), [version])
    return version.label


def publish(spark: SparkSession, root: str, versions: Sequence[Version]) -> int:
    """Publish staged versions together; returns the number of the entry."""
    return publications.publish(spark, root.rstrip("/"), versions)


def tables_of(spark: SparkSession, root: str, version: Version) -> dict[str, DataFrame]:
    """The tables of a version."""
    return {t.name: read_table(spark, root.rstrip("/"), version, t) for t in version.tables}


def read_tables(
    spark: SparkSession, root: str, section: str, dataset: str, version: str = "latest", number: int | None = None
) -> dict[str, DataFrame]:
    """The tables of the latest or an exact version; with `number`, as of that publication.

    Reads of several datasets by one number fit together: they show what was published up to it.
    """
    return tables_of(spark, root, resolve(spark, root, section, dataset, version, number))


def write_version(df: DataFrame, root: str, section: str, dataset: str, label: str | None = None) -> str:
    """Write one table as a new version of a dataset and make it the latest."""
    return write_tables({"data": df}, root, section, dataset, label)


def read_version(
    spark: SparkSession, root: str, section: str, dataset: str, version: str = "latest"
) -> DataFrame:
    """One table of a dataset: the latest or an exact version."""
    return read_tables(spark, root, section, dataset, version)["data"]


def full_refresh(df: DataFrame, path: str, label: str | None = None) -> str:
    """Replace the content at `path`: a new version is written, then readers move to it."""
    root, section, dataset = path.rstrip("/").rsplit("/", 2)
    return write_version(df, root, section, dataset, label)
