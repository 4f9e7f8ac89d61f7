"""Bad-row tolerance of a load."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalake.sources.readers import CORRUPT


class TooManyBadRows(ValueError):
    """More bad rows than a load may skip."""


def tolerate(
    df: DataFrame,
    corrupt_col: str = CORRUPT,
    max_n: int = 100,
    max_ratio: float = 0.1,
) -> tuple[DataFrame, DataFrame]:
    """Split into good rows and quarantined rows; fail only past both limits.

    The counts take one pass, so hand in a frame read back from a written table: it then reads the
    one `corrupt_col` and does not parse the text files again.
    """
    bad_test = F.col(corrupt_col).isNotNull()
    n, bad_n = df.agg(F.count("*"), F.count_if(bad_test)).first()
    if bad_n > max_n and bad_n > max_ratio * n:
        raise TooManyBadRows(f"{bad_n} of {n} rows are bad (allowed: {max_n} rows or {max_ratio:.0%})")
    return df.filter(~bad_test).drop(corrupt_col), df.filter(bad_test)
