"""JSON arrays read by byte range: one large array file is read by as many tasks as it has splits.

A file is read in pieces that end with a closing brace, wherever it stands; splits hand out whole pieces. Whether
a piece starts inside a string, and at which depth, depends on all text before it. Each piece is therefore judged for
both cases: its quotes, and how it changes the depth if it starts outside or inside a string. Sums over a split
give the same for the split, a running sum over the splits of a file gives each split its start, and with it
each piece is known. An object ends with the piece that returns to the depth of the array.

The text is shuffled once, by split; what the sums need goes beside it without the text, one row per piece. Only objects that cross the edge of a
split are put together in a second, small step.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SPLIT = ["file", "block"]


def _count(text: Column, *signs: str) -> Column:
    """How often a text has any of some ASCII signs."""
    left = text
    for sign in signs:
        left = F.replace(left, F.lit(sign), F.lit(""))
    return F.octet_length(text) - F.octet_length(left)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, row, text, quotes, outside, inside, head): texts up to a closing brace, in order of row within a split.

    `quotes` is the parity of the quotes that are not escaped; `outside` and `inside` are the change of depth by all
    but the closing brace, for a piece that starts outside or inside a string. A backslash stands in
    strings only, and never before a brace, so no escape crosses an edge. `head` is the first character that is no space.
    """
    read = spark.read.option("lineSep", "}").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"), F.col("value").alias("text"),
    )
    bare = F.when(F.contains("text", F.lit("\\")), F.regexp_replace("text", r"(?s)\\.", "")).otherwise(F.col("text"))
    # What is left without the strings, for a text that starts outside or inside one.
    unquoted = (F.regexp_replace(bare, r'"[^"]*("|\z)', ""), F.regexp_replace(bare, r'(^|")[^"]*("|\z)', ""))

    def change(parity: int) -> Column:
        return (_count(unquoted[parity], "[", "{") - _count(unquoted[parity], "]")).cast("long")

    head = F.substring(F.regexp_replace("text", r"^[\s﻿]+", ""), 1, 1)
    return read.withColumns(
        {"quotes": (_count(bare, '"') % 2).cast("long"), "outside": change(0), "inside": change(1), "head": head}
    )


def placed(found: DataFrame) -> DataFrame:
    """Pieces with `depth`, the depth after the piece and its brace, and `open`, whether it ends inside a string."""
    earlier = Window.partitionBy(*SPLIT).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    parity = F.coalesce(F.sum("quotes").over(earlier), F.lit(0)) % 2
    found = found.withColumn("parity", parity)

    def change(start: int) -> Column:
        """Change of depth by a piece, brace included, in a split that starts outside (0) or inside (1) a string."""
        begins = (F.col("parity") + start) % 2
        ends = (begins + F.col("quotes")) % 2
        return F.when(begins == 0, F.col("outside")).otherwise(F.col("inside")) - F.when(ends == 0, 1).otherwise(0)

    found = found.withColumns({"if_outside": change(0), "if_inside": change(1)})
    up_to = Window.partitionBy(*SPLIT).orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    found = found.withColumns({f"sum_{x}": F.sum(f"if_{x}").over(up_to) for x in ("outside", "inside")})

    splits = found.groupBy(*SPLIT).agg(
        F.sum("quotes").alias("quotes"), F.sum("if_outside").alias("if_outside"), F.sum("if_inside").alias("if_inside"),
        F.min_by("head", "row").alias("head"),
    )
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("start", F.coalesce(F.sum("quotes").over(before), F.lit(0)) % 2)
    grown = F.when(F.col("start") == 0, F.col("if_outside")).otherwise(F.col("if_inside"))
    splits = splits.withColumn("grown", grown).select(
        *SPLIT, "start", F.coalesce(F.sum("grown").over(before), F.lit(0)).alias("level"),
        F.when(F.first("head").over(Window.partitionBy("file").orderBy("block")) == "[", 1).otherwise(0).alias("base"),
    )
    known = found.join(splits, SPLIT)
    inside = F.col("level") + F.when(F.col("start") == 0, F.col("sum_outside")).otherwise(F.col("sum_inside"))
    return known.select(
        *SPLIT, "row", "text", "base", inside.alias("depth"), ((F.col("start") + F.col("parity") + F.col("quotes")) % 2 == 1).alias("open")
    )


def objects(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, row, text): the objects of the arrays under a path, each with the place of its first piece.

    A file is an array of objects, several one after the other, or one object. Text that belongs to no whole object, as in a file that was cut off,
    comes as a row of its own, so that it is seen as malformed.
    """
    known = placed(pieces(spark, path)).withColumn("ends", ~F.col("open") & (F.col("depth") == F.col("base")))
    earlier = Window.partitionBy(*SPLIT).orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    numbered = known.withColumn("object", F.coalesce(F.sum(F.col("ends").cast("long")).over(earlier), F.lit(0)))
    parts = numbered.groupBy(*SPLIT, "object").agg(
        F.min("row").alias("row"), F.max("ends").alias("whole"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("row", "text"))), lambda p: p["text"]), "}").alias("text"),
    )
    # Each split has one first part, and one last part that has no end; where these meet, an object crosses the edge.
    edge = (F.col("object") == 0) | ~F.col("whole")
    inner = parts.filter(~edge).select(*SPLIT, "row", F.concat("text", F.lit("}")).alias("text"))
    crossing = parts.filter(edge)
    in_file = Window.partitionBy("file").orderBy("block", "row").rowsBetween(Window.unboundedPreceding, -1)
    crossing = crossing.withColumn("number", F.coalesce(F.sum(F.col("whole").cast("long")).over(in_file), F.lit(0)))
    place = F.struct("block", "row")
    joined = crossing.groupBy("file", "number").agg(
        F.min(place).alias("place"), F.max("whole").alias("whole"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("place"), "text"))), lambda p: p["text"]), "}").alias("text"),
    )
    text = F.when(F.col("whole"), F.concat("text", F.lit("}"))).otherwise(F.col("text"))
    outer = joined.select("file", "place.block", "place.row", text.alias("text"))
    bare = F.regexp_replace("text", r"^[\s,\[\]﻿]+", "")
    return inner.unionByName(outer).withColumn("text", bare).filter(~F.col("text").rlike(r"^[\s\]]*$"))


def read_objects(spark: SparkSession, path: str, schema: T.StructType, corrupt: str | None = None) -> DataFrame:
    """The declared fields of every object, its text in `corrupt` where it does not parse, and file, block and row."""
    fields = list(schema.fields) + ([T.StructField(corrupt, T.StringType())] if corrupt else [])
    options = {"mode": "PERMISSIVE"} | ({"columnNameOfCorruptRecord": corrupt} if corrupt else {})
    parsed = objects(spark, path).withColumn("parsed", F.from_json("text", T.StructType(fields), options))
    return parsed.select(*[F.col(f"parsed.`{f.name}`") for f in fields], "file", "block", "row")
