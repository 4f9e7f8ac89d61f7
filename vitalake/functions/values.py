"""Column expressions for missing values, label matching, severity and bands."""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalake.functions.ids import ColumnLike, as_col

# The two spellings of "missing" in the sources, the log patterns of the
# dashboards, and the label format of lake versions.
BLANK = ("",)
BLANK_OR_NONE = ("", "None")
ERROR_WORDS = ("error", "exception", "fatal", "panic")
WARN_WORDS = ("warn", "warning")
FATAL_WORDS = ("fatal", "panic")
LABEL_FORMAT = "yyyy-MM-dd'T'HH-mm-ss'Z'"


def present(col: ColumnLike, tokens: Sequence[str] = BLANK) -> Column:
    """True where the value is neither NULL nor one of the missing tokens; never NULL."""
    c = as_col(col)
    return c.isNotNull() & ~c.isin(*tokens)


def when_present(col: ColumnLike, expr: Column, default: Any, tokens: Sequence[str] = BLANK) -> Column:
    """`expr` where `col` is present, else `default` (a scalar, a Column, or an empty array)."""
    other = default if isinstance(default, Column) else F.lit(default)
    return F.when(present(col, tokens), expr).otherwise(other)


def null_tokens(df: DataFrame, cols: Iterable[str], tokens: Sequence[str] = BLANK_OR_NONE) -> DataFrame:
    """Missing tokens become NULL in the given string columns."""
    return df.withColumns({c: F.when(~F.col(c).isin(*tokens), F.col(c)) for c in cols})


def fill_missing(df: DataFrame, defaults: dict[str, Any]) -> DataFrame:
    """NULL becomes the given default, the warehouse's way of storing 'missing'."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) for c, v in defaults.items()})


def utc_label(ts: ColumnLike) -> Column:
    """Version label of a timestamp, for example 2026-06-17T03-00-00Z (session zone UTC)."""
    return F.date_format(as_col(ts), LABEL_FORMAT)


_PLAIN = re.compile(r"[\w-]+(\|[\w-]+)*", re.ASCII)


def _whole_match(col: Column, pattern: str) -> Column:
    # Lists of names and 'anything' need no regular expression, and reach the scan as filters.
    if pattern == ".+":
        return col != ""
    if _PLAIN.fullmatch(pattern):
        return col.isin(*pattern.split("|"))
    return col.rlike(rf"(?s)\A(?:{pattern})\z")


def matches(col: ColumnLike, include: str | None = None, exclude: str | None = None) -> Column:
    """Label matcher: the whole value must match `include` and must not match `exclude`.

    A label that is missing counts as the empty text.
    """
    c = as_col(col)
    tests = []
    if include is not None:
        missing = bool(re.fullmatch(include, ""))
        tests.append(F.coalesce(_whole_match(c, include), F.lit(True)) if missing else _whole_match(c, include))
    if exclude is not None:
        missing = bool(re.fullmatch(exclude, ""))
        tests.append(F.coalesce(~_whole_match(c, exclude), F.lit(not missing)))
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def contains_any(line: ColumnLike, words: Sequence[str]) -> Column:
    """True where the line holds one of the lower-case words in any case.

    Plain substring search: several times faster than the regular expression it stands for.
    """
    needed = [w for w in words if not any(o != w and o in w for o in words)]
    lowered = F.lower(as_col(line))
    return reduce(lambda a, b: a | b, [lowered.contains(w) for w in needed])


def line_holds(line: ColumnLike, pattern: str | Sequence[str]) -> Column:
    """Line filter: a regular expression, or words in any case."""
    return as_col(line).rlike(pattern) if isinstance(pattern, str) else contains_any(line, pattern)


def severity_flags(line: ColumnLike) -> dict[str, Column]:
    """Error, warning and fatal flags of a log line; a line may carry several."""
    return {
        "is_error": contains_any(line, ERROR_WORDS),
        "is_warning": contains_any(line, WARN_WORDS),
        "is_fatal": contains_any(line, FATAL_WORDS),
    }


def band(value: ColumnLike, steps: Sequence[tuple[float | None, str]]) -> Column:
    """Name of the highest step whose lower bound is <= value; the first step has no bound."""
    c = as_col(value)
    (_, base), *rest = steps
    out = F.lit(base)
    for bound, name in rest:
        out = F.when(c >= F.lit(bound), F.lit(name)).otherwise(out)
    return out


# Lower bounds and colours of the dashboard panels.
LOG_ERROR_STEPS = ((None, "green"), (1, "orange"), (10, "red"))
LOG_WARNING_STEPS = ((None, "green"), (1, "yellow"), (10, "orange"))
LOG_TOTAL_STEPS = ((None, "green"), (1, "blue"))
LOG_FATAL_STEPS = ((None, "green"), (1, "red"))
ERROR_RATE_STEPS = ((None, "green"), (1, "orange"), (5, "red"))
OVERVIEW_ERROR_STEPS = ((None, "green"), (1, "orange"), (10, "red"))
OVERVIEW_WARNING_STEPS = ((None, "green"), (1, "orange"), (5, "yellow"))
OVERVIEW_FATAL_STEPS = ((None, "green"), (1, "orange"), (5, "red"))
STATUS_STEPS = ((None, "red"), (1, "green"))
