"""Array and JSON-text expressions of the warehouse tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vitalake.functions.ids import ColumnLike, as_col
from vitalake.functions.values import BLANK_OR_NONE, present, when_present


def single(value: ColumnLike) -> Column:
    """One-element array of the value."""
    return F.array(as_col(value))


def single_or_empty(value: ColumnLike, test: ColumnLike, tokens=BLANK_OR_NONE) -> Column:
    """One-element array of `value` where `test` is present, else the empty array."""
    one = single(value)
    return F.when(present(test, tokens), one).otherwise(F.filter(one, lambda _: F.lit(False)))


def non_empty(array: ColumnLike) -> Column:
    """True where the array has at least one element."""
    return F.size(as_col(array)) > 0


def json_array(array: ColumnLike) -> Column:
    """JSON text of an array of strings; a NULL array is the text []."""
    return F.coalesce(F.to_json(as_col(array)), F.lit("[]"))


def condition_entries(name: ColumnLike, entry_id: Column, severity: ColumnLike) -> Column:
    """JSON text [{"id": .., "severity": ..}], severity null when missing; [] when the name is missing."""
    level = F.when(present(severity, BLANK_OR_NONE), as_col(severity))
    entry = F.to_json(
        F.array(F.struct(entry_id.alias("id"), level.alias("severity"))),
        {"ignoreNullFields": "false"},
    )
    return when_present(name, entry, "[]", BLANK_OR_NONE)
