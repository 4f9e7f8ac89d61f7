"""Snapshots of a service's tables in the lake, and their restore."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vitalake.sources.versions import read_tables, write_tables

SECTION = "backups"


def backup(tables: dict[str, DataFrame], root: str, service: str, label: str | None = None) -> str:
    """Write every table of a service as one gzip snapshot, dated and latest."""
    return write_tables(tables, root, SECTION, service, label, compression="gzip")


def restore(
    spark: SparkSession, root: str, service: str, version: str = "latest", target: str | None = None
) -> dict[str, DataFrame]:
    """The tables of a snapshot; with `target`, every table there is replaced by the snapshot's.

    The replacement is published as one new version of `target`, so a restore that dies half way
    leaves the tables as they were. `target` is a folder such as <root>/serving/<service>.
    """
    tables = read_tables(spark, root, SECTION, service, version)
    if target is None:
        return tables
    base, section, dataset = target.rstrip("/").rsplit("/", 2)
    label = write_tables(tables, base, section, dataset)
    return read_tables(spark, base, section, dataset, label)
