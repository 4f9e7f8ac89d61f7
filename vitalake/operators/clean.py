"""Projections, casts with row skip, tags, stamps, marker counts and deletes."""

from __future__ import annotations

from collections.abc import Iterable, Mapping
from datetime import datetime
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalake import schemas
from vitalake.functions.ids import ColumnLike, as_col

MALFORMED = "_malformed"


def rename_map(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    """Keep the mapped columns under their canonical names; drop all others."""
    have = set(df.columns)
    return df.select(*[F.col(f"`{old}`").alias(new) for old, new in mapping.items() if old in have])


def check_enum(df: DataFrame, col: str, allowed: Iterable[str]) -> tuple[DataFrame, DataFrame]:
    """Split by allowed values; a NULL passes, as a NULL enum does."""
    ok = F.col(col).isNull() | F.col(col).isin(*allowed)
    return df.filter(ok), df.filter(~ok)


def require_enum(col: str, allowed: Iterable[str] | None) -> Column:
    """The column itself; a value outside `allowed` fails the job. None allows everything."""
    c = F.col(col)
    if allowed is None:
        return c
    message = F.concat(F.lit(f"{col}: value not allowed: "), c)
    return F.when(c.isNull() | c.isin(*allowed), c).otherwise(F.raise_error(message)).alias(col)


# Spellings of infinity a float column may hold; 'd', 'f' and 'x' occur in no other number.
_INFINITY = "('inf', '+inf', '-inf', 'infinity', '+infinity', '-infinity')"


def _number_sql(col: str, kind: str) -> tuple[str, str]:
    """SQL of the number in a text column, and of the test that there is one.

    Integers take no fraction ('70.0' is rejected). The cast is the JVM's, which also takes a type
    suffix ('1.5f') or a hexadecimal float; those are not numbers in a CSV and are rejected.
    """
    spark_type = schemas.SPARK_TYPE.get(kind, kind)
    parsed = f"try_cast(`{col}` AS {spark_type})"
    if kind in schemas.MAX_VALUE:
        return parsed, f"coalesce(try_cast(`{col}` AS bigint) BETWEEN 0 AND {schemas.MAX_VALUE[kind]}, false)"
    if spark_type in ("float", "double"):
        no_suffix = f"(NOT `{col}` RLIKE '[dDfFxX]' OR lower(trim(`{col}`)) IN {_INFINITY})"
        return parsed, f"({parsed} IS NOT NULL AND {no_suffix})"
    return parsed, f"({parsed} IS NOT NULL)"


def parse_number(col: str, kind: str) -> Column:
    """Number in a text column, NULL where it is not one."""
    value, ok = _number_sql(col, kind)
    return F.expr(f"IF({ok}, {value}, NULL)")


def malformed(spec: Mapping[str, str]) -> Column:
    """True where a column holds something that is not a number of its kind."""
    tests = [f"(`{c}` IS NOT NULL AND NOT {_number_sql(c, kind)[1]})" for c, kind in spec.items()]
    return F.expr(" OR ".join(tests) if tests else "false")


def cast_flagged(df: DataFrame, spec: Mapping[str, str], fill: Any = 0) -> DataFrame:
    """Cast text columns, missing ones to `fill`; `_malformed` marks rows with a value that is no number."""

    def cell(c: str) -> str:
        value, ok = _number_sql(c, spec[c])
        spark_type = schemas.SPARK_TYPE.get(spec[c], spec[c])
        return f"CASE WHEN `{c}` IS NULL THEN CAST({fill} AS {spark_type}) WHEN {ok} THEN {value} END AS `{c}`"

    cells = [F.expr(cell(c)) if c in spec else F.col(f"`{c}`") for c in df.columns]
    return df.select(*cells, malformed(spec).alias(MALFORMED))


def strict_cast(df: DataFrame, spec: Mapping[str, str], fill: Any = 0) -> tuple[DataFrame, DataFrame]:
    """Split into rows whose columns all cast, and the skipped rows as they came.

    A row is skipped when a value is there but is not a number; a missing value becomes `fill`.
    """
    flagged = cast_flagged(df, spec, fill)
    return flagged.filter(~F.col(MALFORMED)).drop(MALFORMED), df.filter(malformed(spec))


def stamp(df: DataFrame, load_ts: datetime | None = None) -> DataFrame:
    """One load time on every row, as created_at and updated_at."""
    now = F.current_timestamp() if load_ts is None else F.lit(load_ts)
    return df.withColumns({"created_at": now, "updated_at": now})


def tag(df: DataFrame, **values: Any) -> DataFrame:
    """Constant columns; a Column (for example a typed NULL) is taken as it is."""
    return df.withColumns({k: v if isinstance(v, Column) else F.lit(v) for k, v in values.items()})


def delete_where(df: DataFrame, predicate: Column) -> DataFrame:
    """The rows a DELETE leaves: those where the predicate is false or NULL."""
    return df.filter(~F.coalesce(predicate, F.lit(False)))


def delete_in(frames: Mapping[str, tuple[DataFrame, Column | None]]) -> dict[str, DataFrame]:
    """`delete_where` over several tables; a predicate of None deletes every row of a table."""
    return {
        name: delete_where(df, F.lit(True) if predicate is None else predicate)
        for name, (df, predicate) in frames.items()
    }


def marker_counts(frames: Mapping[str, tuple[DataFrame, Column | None]]) -> DataFrame:
    """Several scalar counts in one row: per name the rows of a frame where the test holds.

    A test of None counts all rows. Each count is a scalar subquery, so frames are never joined.
    """
    spark = next(iter(frames.values()))[0].sparkSession
    counts = [
        (df if test is None else df.filter(test)).agg(F.count("*")).scalar().alias(name)
        for name, (df, test) in frames.items()
    ]
    return spark.range(1).select(*counts)


def starts_with(col: ColumnLike, prefix: str) -> Column:
    """Marker test on a literal prefix: '_' and '%' in it stand for themselves."""
    return as_col(col).startswith(prefix)
