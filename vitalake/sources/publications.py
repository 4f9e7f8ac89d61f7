"""The publication log of a lake: numbered entries, each of which publishes one or several datasets at once.

An entry is a file <root>/publications/<number>.json that holds one line. Writers make it by an exclusive put of the
next number: the file appears whole under a name that must not exist, so of two writers one gets the number
and the other looks at what came in between and tries the next. What an entry names is published, all of it or
nothing; a label that any entry names is refused. Readers take the highest number that names a dataset, so neither
clocks nor the order of writes decide which version is the latest.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Sequence
from dataclasses import asdict, dataclass
from datetime import datetime, timezone

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalake.sources.readers import is_missing_path

LOG = "publications"
_TABLE = "struct<name:string,schema:string,on:array<string>,buckets:int>"
_VERSION = f"struct<dataset:string,label:string,folder:string,tables:array<{_TABLE}>>"
_ENTRY = f"number long, published_at timestamp, versions array<{_VERSION}>"


class VersionExists(ValueError):
    """The label was published before."""


class VersionNotFound(LookupError):
    """Nothing was published under this name, or not this version."""


@dataclass(frozen=True)
class Table:
    """A table of a version. `schema` is Spark's JSON of it; `on` and `buckets` are set for tables kept as buckets."""

    name: str
    schema: str | None = None
    on: tuple[str, ...] | None = None
    buckets: int | None = None


@dataclass(frozen=True)
class Version:
    """A written version of a dataset; `dataset` and `folder` are paths under the root of the lake."""

    dataset: str
    label: str
    folder: str
    tables: tuple[Table, ...]

    def table(self, name: str) -> Table | None:
        return next((t for t in self.tables if t.name == name), None)


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """Make a file with this content unless there is one; False if there is. Nobody sees it half written.

    Local files are linked to their name and others renamed to it, both of which fail where the name exists.
    A store whose rename replaces files cannot hold a log.
    """
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    target = jvm.org.apache.hadoop.fs.Path(path)
    files = target.getFileSystem(conf)
    files.mkdirs(target.getParent())
    if files.getScheme() == "file":
        return _linked(files.makeQualified(target).toUri().getPath(), text)
    return _renamed(spark, target, text)


def _linked(path: str, text: str) -> bool:
    draft = os.path.join(os.path.dirname(path), f".{uuid.uuid4().hex}")
    with open(draft, "x", encoding="utf-8") as out:
        out.write(text)
        out.flush()
        os.fsync(out.fileno())
    try:
        os.link(draft, path)
    except FileExistsError:
        return False
    finally:
        os.unlink(draft)
    return True


def _renamed(spark: SparkSession, target, text: str) -> bool:
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    files = target.getFileSystem(conf)
    draft = jvm.org.apache.hadoop.fs.Path(target.getParent(), f".{uuid.uuid4().hex}")
    out = files.create(draft, False)
    try:
        out.write(bytearray(text, "utf-8"))
    finally:
        out.close()
    rename = getattr(jvm.org.apache.hadoop.fs, "Options$Rename")
    refuse = spark.sparkContext._gateway.new_array(rename, 1)
    refuse[0] = rename.NONE
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), conf).rename(draft, target, refuse)
    except Py4JJavaError as error:
        files.delete(draft, False)
        if "FileAlreadyExistsException" in error.java_exception.getClass().getName():
            return False
        raise
    return True


def entries(spark: SparkSession, root: str) -> DataFrame:
    """Every published version: one row per entry and dataset, with the entry's number."""
    try:
        found = spark.read.schema(_ENTRY).json(f"{root}/{LOG}")
    except AnalysisException as error:
        if not is_missing_path(error):
            raise
        found = spark.createDataFrame([], _ENTRY)
    return found.select("number", "published_at", F.explode("versions").alias("version")).select("number", "published_at", "version.*")


def publish(spark: SparkSession, root: str, versions: Sequence[Version]) -> int:
    """Publish written versions together; returns the number of the entry.

    Raises VersionExists, and publishes none of them, where an entry has one of their labels.
    """
    wanted = {(v.dataset, v.label) for v in versions}
    if len(wanted) < len(versions):
        raise VersionExists("one label is named twice")
    while True:
        known = entries(spark, root)
        taken = F.struct("dataset", "label").isin([F.struct(F.lit(d), F.lit(n)) for d, n in wanted])
        last, there = known.agg(F.max("number"), F.min(F.when(taken, F.concat_ws("@", "dataset", "label")))).first()
        if there is not None:
            raise VersionExists(there)
        number = (last or 0) + 1
        now = datetime.now(timezone.utc).isoformat(timespec="microseconds")
        entry = {"number": number, "published_at": now, "versions": [asdict(v) for v in versions]}
        if put_if_absent(spark, f"{root}/{LOG}/{number:020d}.json", json.dumps(entry) + "\n"):
            return number


def _version(row) -> Version:
    tables = tuple(Table(t.name, t.schema, tuple(t.on) if t.on is not None else None, t.buckets) for t in row.tables)
    return Version(row.dataset, row.label, row.folder, tables)


def resolve(spark: SparkSession, root: str, dataset: str, version: str = "latest", number: int | None = None) -> Version:
    """The latest or an exact version of a dataset; with `number`, as of that entry of the log."""
    found = entries(spark, root).filter(F.col("dataset") == dataset)
    if version != "latest":
        found = found.filter(F.col("label") == version)
    if number is not None:
        found = found.filter(F.col("number") <= number)
    newest = found.agg(F.max_by(F.struct("dataset", "label", "folder", "tables"), "number").alias("v")).first().v
    if newest is None:
        raise VersionNotFound(f"{root}/{dataset}@{version}")
    return _version(newest)


def publication(spark: SparkSession, root: str, number: int) -> dict[str, Version]:
    """The versions that one entry published, by dataset."""
    rows = entries(spark, root).filter(F.col("number") == number).collect()
    if not rows:
        raise VersionNotFound(f"{root}, publication {number}")
    return {r.dataset: _version(r) for r in rows}


def claim(spark: SparkSession, root: str, dataset: str, label: str) -> str:
    """A folder under the root for one attempt to write a version; no two attempts get the same.

    The first has <dataset>/<label>; later ones, after a failed load or beside another writer, a folder in it.
    """
    attempt = 0
    while not put_if_absent(spark, f"{root}/{dataset}/{label}/_attempts/{attempt}", ""):
        attempt += 1
    return f"{dataset}/{label}/again-{attempt}" if attempt else f"{dataset}/{label}"
