"""Dimension tables: distinct names with an id and the load time."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalake.functions.ids import ColumnLike, as_col, stable_id
from vitalake.functions.values import BLANK, present
from vitalake.operators.clean import stamp

DIM_SCHEMA = "id bigint, name string, created_at timestamp, updated_at timestamp"


def _with_id(names: DataFrame, load_ts: datetime | None) -> DataFrame:
    # The id is computed after the distinct, once per name and not once per row.
    return stamp(names.distinct().select(stable_id("name").alias("id"), "name"), load_ts)


def names_of(df: DataFrame, col: ColumnLike, tokens: Sequence[str] = BLANK) -> DataFrame:
    """The present values of a column as `name`, duplicates included."""
    return df.select(as_col(col).alias("name")).filter(present("name", tokens))


def build_dim(
    df: DataFrame, col: ColumnLike, tokens: Sequence[str] = BLANK, load_ts: datetime | None = None
) -> DataFrame:
    """Dimension of the distinct present names in a column."""
    return _with_id(names_of(df, col, tokens), load_ts)


def build_dim_union(
    sources: Sequence[tuple[DataFrame, ColumnLike]],
    tokens: Sequence[str] = BLANK,
    load_ts: datetime | None = None,
) -> DataFrame:
    """Dimension of the distinct names over several sources."""
    parts = [names_of(df, col, tokens) for df, col in sources]
    return _with_id(reduce(DataFrame.unionByName, parts), load_ts)


def array_names(df: DataFrame, cols: Sequence[str], tokens: Sequence[str] = BLANK) -> DataFrame:
    """Every present element of one or more array columns as `name`."""
    empty = F.array().cast("array<string>")
    merged = reduce(F.array_union, [F.coalesce(F.col(c), empty) for c in cols])
    return df.select(F.explode(merged).alias("name")).filter(present("name", tokens))


def build_dim_arrays(
    df: DataFrame, cols: Sequence[str], tokens: Sequence[str] = BLANK, load_ts: datetime | None = None
) -> DataFrame:
    """Dimension of the distinct elements of several array columns."""
    return _with_id(array_names(df, cols, tokens), load_ts)


def upsert_dim(existing: DataFrame, names: DataFrame, load_ts: datetime | None = None) -> DataFrame:
    """Add new names, keep the id and creation time of known ones, refresh their updated_at.

    `names` may hold duplicates; known names that are not in it stay untouched.
    """
    fresh = names.select("name").distinct().withColumn("_seen", F.lit(True))
    old = existing.select("id", "name", "created_at", "updated_at")
    now = F.current_timestamp() if load_ts is None else F.lit(load_ts)
    return old.join(fresh, "name", "full_outer").select(
        F.coalesce("id", stable_id("name")).alias("id"),
        "name",
        F.coalesce("created_at", now).alias("created_at"),
        F.when(F.col("_seen"), now).otherwise(F.col("updated_at")).alias("updated_at"),
    )


def id_collisions(df: DataFrame, id_col: str = "id", name_col: str = "name") -> DataFrame:
    """Ids that stand for more than one name, with the number of names."""
    return (
        df.select(F.col(id_col).alias("id"), F.col(name_col).alias("name"))
        .distinct()
        .groupBy("id")
        .agg(F.count("name").alias("n_names"))
        .filter(F.col("n_names") > 1)
    )


