"""Readers with declared columns. Columns are taken by name, never by position."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalake.sources.json_arrays import read_objects

CORRUPT = "_corrupt"
SEQ = "_seq"


def file_position():
    """Place of a row in its source: file, split offset, row in split. Orders as the file does."""
    return F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    ).alias(SEQ)


def _csv_reader(spark: SparkSession, multiline: bool):
    return spark.read.option("header", True).option("escape", '"').option("multiLine", multiline)


def read_csv(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    *,
    corrupt: bool = False,
    seq: bool = False,
    multiline: bool = False,
) -> DataFrame:
    """CSV with a header and declared column types.

    Undeclared columns are dropped and declared columns the file lacks are NULL. With `corrupt`,
    rows that do not parse keep their text in `_corrupt`. All files under `path` must share one
    header, which Spark checks. `multiline` allows line breaks in quotes but stops Spark from
    splitting a file, so it is off unless a source needs it.
    """
    header = _csv_reader(spark, multiline).csv(path).columns
    declared = {f.name: f for f in schema.fields}
    fields = [declared.get(name, T.StructField(name, T.StringType())) for name in header]
    out = [
        F.col(f"`{f.name}`") if f.name in header else F.lit(None).cast(f.dataType).alias(f.name)
        for f in schema.fields
    ]
    reader = _csv_reader(spark, multiline).option("enforceSchema", False)
    if corrupt:
        # Without column pruning a row is bad or good whatever columns the caller asks for.
        reader = reader.option("columnPruning", False)
        fields = [*fields, T.StructField(CORRUPT, T.StringType())]
        out = [*out, F.col(CORRUPT)]
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    if seq:
        out = [*out, file_position()]
    return reader.schema(T.StructType(fields)).csv(path).select(*out)


def read_json(
    spark: SparkSession,
    path: str,
    schema: T.StructType,
    *,
    lines: bool = False,
    corrupt: bool = False,
    seq: bool = False,
) -> DataFrame:
    """JSON objects with declared fields: one array per file, or one object per line.

    Both forms are read by byte range; an array costs one shuffle of its text (see `json_arrays`).
    """
    fields = list(schema.fields)
    if corrupt:
        fields.append(T.StructField(CORRUPT, T.StringType()))
    columns = [F.col(f"`{f.name}`") for f in fields]
    if not lines:
        found = read_objects(spark, path, schema, CORRUPT if corrupt else None)
        return found.select(*columns, *([F.struct("file", "block", "row").alias(SEQ)] if seq else []))
    reader = spark.read
    if corrupt:
        reader = reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT)
    return reader.schema(T.StructType(fields)).json(path).select(*columns, *([file_position()] if seq else []))


def is_missing_path(error: AnalysisException) -> bool:
    return error.getCondition() == "PATH_NOT_FOUND"


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType, **options) -> DataFrame:
    """`read_csv`, or an empty frame with the same columns when nothing is at `path`."""
    try:
        return read_csv(spark, path, schema, **options)
    except AnalysisException as error:
        if not is_missing_path(error):
            raise
    fields = list(schema.fields)
    if options.get("corrupt"):
        fields.append(T.StructField(CORRUPT, T.StringType()))
    if options.get("seq"):
        fields.append(T.StructField(SEQ, SEQ_TYPE))
    return spark.createDataFrame([], T.StructType(fields))


SEQ_TYPE = T.StructType(
    [
        T.StructField("file", T.StringType()),
        T.StructField("block", T.LongType()),
        T.StructField("row", T.LongType()),
    ]
)
