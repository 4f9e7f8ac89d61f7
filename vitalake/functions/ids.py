"""Surrogate ids computed from names, so that a foreign key needs no join."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ColumnLike = Column | str


def as_col(col: ColumnLike) -> Column:
    return F.col(col) if isinstance(col, str) else col


def id_text(*cols: ColumnLike) -> Column:
    """The text that stands for one or more values in an id.

    One column: its text, NULL for NULL. Of several, each stands with its length before it, and NULL as
    a dash, so no two lists of values have one text, whatever signs they hold.
    """
    parts = [as_col(c).cast("string") for c in cols]
    if len(parts) == 1:
        return parts[0]
    marked = [F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]
    return F.concat(*[F.coalesce(p, F.lit("-")) for p in marked])


def stable_id(*cols: ColumnLike) -> Column:
    """60-bit id of one or more values: the first 15 hex digits of the md5 of their text, as a long.

    The same value in every engine that has md5. A single NULL gives NULL.
    """
    return F.conv(F.substring(F.md5(id_text(*cols)), 1, 15), 16, 10).cast("long")


def stable_ids(array: ColumnLike) -> Column:
    """`stable_id` of every element of an array column, in order."""
    return F.transform(as_col(array), lambda name: stable_id(name))
