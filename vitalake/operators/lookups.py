"""Lookups by name and scalar lookups.

The joins carry no broadcast hint. Spark broadcasts a dimension when its measured size is under the
session's threshold; past it the join is shuffled and AQE splits a fact partition that one hot key
has blown up. Both give the same rows, so a dimension that outgrows memory changes speed only.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalake.functions.ids import stable_id


def _pairs(dim: DataFrame, name: str, value: str) -> DataFrame:
    return dim.select(F.col(name).alias("_name"), F.col(value).alias("_value"))


def lookup(
    df: DataFrame, dim: DataFrame, key: str, out: str, name: str = "name", value: str = "id"
) -> DataFrame:
    """Add `out`, the dimension's value for the key; NULL on a miss. Names are unique in `dim`."""
    joined = df.join(_pairs(dim, name, value), F.col(key) == F.col("_name"), "left")
    return joined.select(*[F.col(c) for c in df.columns if c != out], F.col("_value").alias(out))


def lookup_strict(
    df: DataFrame, dim: DataFrame, key: str, out: str, name: str = "name", value: str = "id"
) -> DataFrame:
    """`lookup`, but a key without a row in `dim` fails the job that evaluates the column."""
    found = lookup(df, dim, key, out, name, value)
    missing = F.raise_error(
        F.concat(F.lit(f"{key}: no dimension row for "), F.coalesce(F.col(key).cast("string"), F.lit("NULL")))
    )
    checked = F.when(F.col(out).isNotNull(), F.col(out)).otherwise(missing.cast("bigint"))
    return found.withColumn(out, checked)


def lookup_or_new(
    df: DataFrame, dim: DataFrame, key: str, out: str, name: str = "name", value: str = "id"
) -> DataFrame:
    """`lookup` against the names known before a load; a name it adds has the id it will be given.

    So a fact does not wait for its dimension to be merged, nor compute the merge a second time.
    """
    found = lookup(df, dim, key, out, name, value)
    return found.withColumn(out, F.coalesce(F.col(out), stable_id(key)))


def lookup_misses(
    df: DataFrame, dim: DataFrame, key: str, name: str = "name", value: str = "id"
) -> DataFrame:
    """Keys without a dimension row and how many rows hold them; counted before the join."""
    counts = df.groupBy(F.col(key).alias("key")).agg(F.count("*").alias("n"))
    return counts.join(_pairs(dim, name, value), F.col("key") == F.col("_name"), "left_anti")


def lookup_arrays(
    df: DataFrame,
    dim: DataFrame,
    cols: Mapping[str, str],
    row_key: Sequence[str],
    name: str = "name",
    value: str = "id",
    new_ids: bool = False,
) -> DataFrame:
    """Look up every element of array columns, {column: output}; order kept, empty elements dropped.

    A miss is NULL, or with `new_ids` the id the name will be given. `row_key` is unique in `df`.
    Only the key and the elements of all columns go through the one element join, and a group
    gathered back is one row's arrays.
    """
    def tagged(n: int, col: str) -> Column:
        filled = F.coalesce(F.col(col), F.array().cast("array<string>"))
        return F.transform(
            filled,
            lambda e, at: F.struct(F.lit(n).alias("_col"), at.alias("_pos"), e.alias("_element")),
        )

    elements = (
        df.select(*row_key, F.inline(F.concat(*[tagged(n, c) for n, c in enumerate(cols)])))
        .filter(F.col("_element") != "")
        .join(_pairs(dim, name, value), F.col("_element") == F.col("_name"), "left")
    )
    found = F.coalesce(F.col("_value"), stable_id("_element")) if new_ids else F.col("_value")
    entry = F.struct("_pos", found.alias("_value"))
    ids = elements.groupBy(*row_key).agg(
        *[
            F.transform(
                F.sort_array(F.collect_list(F.when(F.col("_col") == n, entry))), lambda e: e["_value"]
            ).alias(out)
            for n, out in enumerate(cols.values())
        ]
    )
    empty = F.array().cast("array<bigint>")
    joined = df.drop(*cols.values()).join(ids, list(row_key), "left")
    return joined.withColumns({out: F.coalesce(F.col(out), empty) for out in cols.values()})


def lookup_array(
    df: DataFrame, dim: DataFrame, col: str, out: str, row_key: Sequence[str], **options
) -> DataFrame:
    """`lookup_arrays` of one column."""
    return lookup_arrays(df, dim, {col: out}, row_key, **options)


def scalar(parent: DataFrame, predicate: Column, value: str = "id") -> Column:
    """Scalar subquery: the value of the one parent row that meets the predicate, NULL if none.

    More than one such row is an error, as in SQL.
    """
    return parent.filter(predicate).select(value).scalar()


def insert_from(
    target: DataFrame, parent: DataFrame, predicate: Column, values: Mapping[str, Column]
) -> DataFrame:
    """INSERT .. SELECT: one new row per parent row that meets the predicate.

    Columns of the target that `values` does not name are NULL.
    """
    cols = [
        values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in target.schema.fields
    ]
    return target.unionByName(parent.filter(predicate).select(*cols))


def orphans(fact: DataFrame, dim: DataFrame, key: str, dim_key: str = "id") -> DataFrame:
    """Fact rows whose foreign key has no dimension row."""
    # No distinct on the dimension: AQE splits a hot key only where both sides are plain shuffles.
    known = dim.select(F.col(dim_key).alias("_known"))
    return fact.join(known, F.col(key) == F.col("_known"), "left_anti")


def orphan_keys(fact: DataFrame, dim: DataFrame, key: str, dim_key: str = "id") -> DataFrame:
    """Foreign keys without a dimension row and how many fact rows hold them.

    An array column is exploded first. Keys are counted before the join, so hot ones cost nothing.
    """
    is_array = dict(fact.dtypes)[key].startswith("array")
    keys = fact.select((F.explode(key) if is_array else F.col(key)).alias("key"))
    counts = keys.groupBy("key").agg(F.count("*").alias("n_rows"))
    return orphans(counts, dim, "key", dim_key)
