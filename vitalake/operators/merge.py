"""Newest row per key, upsert, insert-if-absent, tagged union, entity split.

Every reduction to one row per key is an aggregate, not a window: it combines on the map side, so a
key that holds a third of all rows sends one row per map task through the shuffle.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _one_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str], pick) -> DataFrame:
    rest = [c for c in df.columns if c not in keys and c not in order]
    ordering = [c for c in order if c not in keys]
    if not ordering and not rest:
        return df.select(*keys).distinct()
    row = F.struct(*[F.col(c) for c in [*ordering, *rest]])
    picked = df.groupBy(*keys).agg(pick(row).alias("_row"))
    return picked.select(*[F.col(c) if c in keys else F.col(f"_row.{c}").alias(c) for c in df.columns])


def latest_by_key(
    df: DataFrame, keys: Sequence[str], version: str | None = None, seq: str | None = None
) -> DataFrame:
    """The row with the highest (version, seq) per key.

    The remaining columns settle what is left of a tie, so the result does not depend on how the
    rows are spread. NULL keys form one group, as in a sort key.
    """
    return _one_per_key(df, keys, [c for c in (version, seq) if c], F.max)


def first_by_key(df: DataFrame, keys: Sequence[str], seq: str | None = None) -> DataFrame:
    """The row with the lowest seq per key."""
    return _one_per_key(df, keys, [seq] if seq else [], F.min)


def _has_null_key(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    seq: str | None = None,
    load_ts: datetime | None = None,
    keep: Sequence[str] = ("created_at",),
    reduced: bool = False,
) -> DataFrame:
    """Merge source rows into target: known keys are replaced, new keys are added.

    Of several source rows with one key the last by `seq` counts. A replaced row keeps its `keep`
    columns. `updated_at` is the load time on every source row, `created_at` on every added one.
    Keys are unique in target. Rows with a NULL key conflict with nothing and are all added.
    `reduced` says that source already holds one row per key and no NULL key.

    Both sides are shuffled once on the keys; after the reduction the join is one to one.
    """
    now = F.current_timestamp() if load_ts is None else F.lit(load_ts)
    stamps = {c: now for c in ("created_at", "updated_at") if c in target.columns}
    source = source.withColumns({c: v for c, v in stamps.items()})
    columns = target.columns
    if reduced:
        known, batch, unmatched = target, source, []
    else:
        null_key = _has_null_key(keys)
        known = target.filter(~null_key)
        batch = latest_by_key(source.filter(~null_key), keys, seq=seq)
        unmatched = [target.filter(null_key), source.filter(null_key).select(*columns)]
    fresh = batch.select(F.struct(*columns).alias("_new"), *keys)
    known = known.select(F.struct(*columns).alias("_old"), *keys)
    both = known.join(fresh, list(keys), "full_outer")

    def merged(c: str) -> Column:
        new, old = F.col(f"_new.{c}"), F.col(f"_old.{c}")
        if c in keep and c not in keys:
            return F.when(F.col("_old").isNotNull(), old).otherwise(new).alias(c)
        return F.when(F.col("_new").isNotNull(), new).otherwise(old).alias(c)

    return reduce(DataFrame.unionByName, [both.select(*[merged(c) for c in columns]), *unmatched])


def insert_if_absent(
    target: DataFrame, source: DataFrame, keys: Sequence[str], seq: str | None = None
) -> DataFrame:
    """Target plus the source rows whose key it lacks; of equal new keys the first by `seq`."""
    return target.unionByName(absent_rows(target, source, keys, seq).select(*target.columns))


def absent_rows(
    target: DataFrame, source: DataFrame, keys: Sequence[str], seq: str | None = None
) -> DataFrame:
    """The source rows `insert_if_absent` adds. NULL keys are never equal, so they are all added."""
    null_key = _has_null_key(keys)
    known = target.select(*keys).distinct()
    fresh = first_by_key(source.filter(~null_key), keys, seq).join(known, list(keys), "left_anti")
    return fresh.unionByName(source.filter(null_key))


def union_tagged(sources: Mapping[str, DataFrame], tag: str = "source") -> DataFrame:
    """Same-shaped sources appended, each row tagged with the name of its source."""
    return reduce(DataFrame.unionByName, [df.withColumn(tag, F.lit(name)) for name, df in sources.items()])


def split_entities(df: DataFrame, specs: Mapping[str, Sequence[Column | str]]) -> dict[str, DataFrame]:
    """One wide frame as several entity tables; each reads only its own columns of a written `df`."""
    return {name: df.select(*cols) for name, cols in specs.items()}


def union_all(frames: Sequence[DataFrame]) -> DataFrame:
    """All rows of same-shaped frames."""
    return reduce(DataFrame.unionByName, frames)


def union_distinct(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION DISTINCT of same-shaped frames."""
    return union_all(frames).distinct()
