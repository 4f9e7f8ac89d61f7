"""Row ids that depend on content alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalake.functions.ids import id_text, stable_id

_BLOCK = 10_000
#: Copies that a row is written out with where it was counted; rows with more are dealt out first.
_FEW = 8


def occurrence_id(df: DataFrame, tag: str, out: str = "id", block: int = _BLOCK) -> DataFrame:
    """Add an id of (tag, all columns, number of the row among its identical copies).

    Copies of a row are alike, so they are counted and written out again with numbers 1..n; the set
    of ids is the same for any order or partitioning of the input. Counting combines on the map
    side. Counts are few and small however many rows they stand for, and Spark merges partitions by their bytes; rows
    with more than a few copies are therefore dealt out over a fixed number of partitions, in numbered blocks of
    at most `block` copies, so no task writes all of the rows or holds all copies of one.
    """
    cols = df.columns
    # The text of a row is made once per distinct row; a copy then adds its number and is hashed.
    content = id_text(F.lit(tag), *cols).alias("_content")
    counts = df.groupBy(*cols).agg(F.count("*").alias("_n")).select(*cols, "_n", content)
    few = min(_FEW, block)
    usual = counts.filter(F.col("_n") <= few).select(
        *cols, "_content", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n"))).alias("_i")
    )
    last_block = F.floor((F.col("_n") - 1) / block).cast("bigint")
    first = F.col("_block") * block + 1
    # With a number of partitions given, Spark doesn't merge them.
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = (
        counts.filter(F.col("_n") > few)
        .select("*", F.explode(F.sequence(F.lit(0).cast("bigint"), last_block)).alias("_block"))
        .repartition(parts, "_block", *cols)
        .select(
            *cols,
            "_content",
            F.explode(F.sequence(first, F.least(F.col("_n"), first + block - 1))).alias("_i"),
        )
    )
    numbered = usual.unionByName(dealt)
    return numbered.select(stable_id("_content", F.col("_i")).alias(out), *cols)
