"""Tables kept as hash buckets, of which a merge reads and writes only those its batch touches.

A version of such a table is a manifest: for each bucket, the folder that holds its rows and their number. A merge finds
the buckets of its batch, joins the batch with their rows, writes these buckets anew, and lists the folders of all
others as the version before did. What a load costs thus grows with its batch and not with its target.

Rows go to buckets by the hash of the `on` columns, by which a merge joins, so that a key has one bucket.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalake.sources.publications import Table, Version

BUCKET = "_bucket"
#: Rows of a bucket on the average; a table that has grown beyond it gets twice the buckets.
ROWS = 250_000
#: Each bucket is a folder to write and to list, so of buckets smaller than ROWS a table has no more than these; they grow to ROWS first.
SMALL_BUCKETS = 256
_MANIFEST = f"{BUCKET} int, folder string, n long"

Merge = Callable[[DataFrame, DataFrame], DataFrame]


@dataclass(frozen=True)
class Merged:
    """A merged table: what a version says of it, the rows that were written, and those of the buckets that stay."""

    table: Table
    written: DataFrame
    untouched: DataFrame


def bucket_of(df: DataFrame, on: tuple[str, ...], buckets: int) -> Column:
    """The bucket of a row. Rows that have only NULL in the `on` columns match no other and are spread by all they hold."""
    keys = [F.col(f"`{c}`") for c in on]
    rest = [F.col(f"`{f.name}`") for f in df.schema if not isinstance(f.dataType, T.MapType)]
    return F.pmod(F.when(F.coalesce(*[k.cast("string") for k in keys]).isNull(), F.xxhash64(*rest)).otherwise(F.xxhash64(*keys)), F.lit(buckets)).cast("int")


def _manifest(spark: SparkSession, root: str, version: Version, name: str) -> DataFrame:
    return spark.read.schema(_MANIFEST).parquet(f"{root}/{version.folder}/{name}/manifest")


def bucket_folders(spark: SparkSession, root: str, version: Version, name: str) -> dict[int, str]:
    """The folder of each bucket that has rows, under the root."""
    return {r[BUCKET]: r.folder for r in _manifest(spark, root, version, name).select(BUCKET, "folder").collect()}


def _rows_of(spark: SparkSession, root: str, schema: T.StructType, folders: list[str]) -> DataFrame:
    if not folders:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*[f"{root}/{f}" for f in folders])


def read_table(spark: SparkSession, root: str, version: Version, table: Table) -> DataFrame:
    """A table of a version, kept as buckets or plain."""
    schema = T.StructType.fromJson(json.loads(table.schema))
    if table.buckets is None:
        return spark.read.schema(schema).parquet(f"{root}/{version.folder}/{table.name}")
    return _rows_of(spark, root, schema, list(bucket_folders(spark, root, version, table.name).values()))


def _write(df: DataFrame, root: str, folder: str, table: Table, reused: DataFrame | None) -> DataFrame:
    """Write rows as buckets, and the manifest of these and of the reused ones; returns the written rows."""
    spark, path = df.sparkSession, f"{root}/{folder}/{table.name}"
    rows = df.withColumn(BUCKET, bucket_of(df, table.on, table.buckets)).repartition(BUCKET)
    rows.write.partitionBy(BUCKET).option("compression", "zstd").parquet(f"{path}/data")
    written = spark.read.schema(T.StructType([*df.schema, T.StructField(BUCKET, T.IntegerType())])).parquet(f"{path}/data")
    new = written.groupBy(BUCKET).agg(F.count("*").alias("n"))
    new = new.select(BUCKET, F.concat(F.lit(f"{folder}/{table.name}/data/{BUCKET}="), F.col(BUCKET).cast("string")).alias("folder"), "n")
    (new if reused is None else new.unionByName(reused)).coalesce(1).write.parquet(f"{path}/manifest")
    return written.drop(BUCKET)


def drop(spark: SparkSession, path: str) -> None:
    """Delete a folder if it is there."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def merge_buckets(
    batch: DataFrame, root: str, old: Version | None, folder: str, name: str, on: tuple[str, ...], schema: T.StructType, apply: Merge, rows: int = ROWS
) -> Merged:
    """Write a table of a new version: what `apply` makes of the rows there and the batch, bucket by bucket.

    `apply` gets the rows of the touched buckets and the batch, and returns rows of `schema`; it must not need other
    rows, and the rows it returns must belong to buckets of the batch or come from those it got. `folder` is
    that of the new version. A plain table of the old version, one kept by other columns, and one that has more than
    `rows` rows a bucket, is written whole, as new buckets. Beyond SMALL_BUCKETS buckets only such of more than ROWS rows split.
    """
    spark = batch.sparkSession
    staged = f"{root}/{folder}/{name}/batch"
    batch.write.parquet(staged)
    batch = spark.read.schema(batch.schema).parquet(staged)
    before = old.table(name) if old else None
    known = _manifest(spark, root, old, name) if before and before.buckets and before.on == tuple(on) else None
    there = 0
    if known is not None:
        there = known.agg(F.sum("n")).first()[0] or 0
    elif before:
        there = read_table(spark, root, old, before).count()
    buckets = before.buckets if known is not None else 1
    n = max(there, batch.count() if not before else 0)
    while n > rows * buckets and (buckets < SMALL_BUCKETS or n > ROWS * buckets):
        buckets *= 2
    table = Table(name, schema.json(), tuple(on), buckets)
    if known is not None and before.buckets == buckets:
        touched = {r[0] for r in batch.select(bucket_of(batch, on, buckets)).distinct().collect()}
        folders = bucket_folders(spark, root, old, name)
        current = _rows_of(spark, root, schema, [f for b, f in folders.items() if b in touched])
        untouched = _rows_of(spark, root, schema, [f for b, f in folders.items() if b not in touched])
        reused = known.filter(~F.col(BUCKET).isin(touched))
    else:
        current = read_table(spark, root, old, before) if before else spark.createDataFrame([], schema)
        untouched, reused = spark.createDataFrame([], schema), None
    written = _write(apply(current, batch).select(*[F.col(f"`{c}`") for c in schema.names]), root, folder, table, reused)
    drop(spark, staged)
    return Merged(table, written, untouched)


def upsert_buckets(
    batch: DataFrame, root: str, old: Version | None, folder: str, name: str, keys: tuple[str, ...], schema: T.StructType, rows: int = ROWS, **options
) -> Merged:
    """`upsert` of a batch into a table kept as buckets of its key; see `operators.merge.upsert` for the options."""
    from vitalake.operators.merge import upsert

    return merge_buckets(batch, root, old, folder, name, keys, schema, lambda current, new: upsert(current, new, keys, **options), rows)
