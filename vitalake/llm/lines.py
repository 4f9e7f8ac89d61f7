"""Line dedup: levelled sorted runs of line hashes; each batch merge-anti-joins the runs and adds its own.

A run is a table of distinct line keys, bucketed and sorted by key: a batch is shuffled by key once and then
meets every run bucket by bucket, without moving a run. A key that no run holds is new, and its batch is the
first to have it; the batch's own run says of each key in how many documents it is and, for new ones, which of
them is the largest. FANOUT runs of one level become one run of the next, so there are few of them however
many batches came. Batches go from the largest ids to the smallest, so the first holder of a key is the one
that keeps its lines. Keys are 128 bits of hash. DataFrame functions only.
"""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalake.llm.blocks import FIRST_ID, scratch

#: Code points of a key that counts, documents that make it a repeat, batches, and runs of a level that are merged.
LEAST, DOCUMENTS, BATCHES, FANOUT = 20, 3, 8, 4
KEY = ["k1", "k2"]
RUN = "k1 long, k2 long, docs long, top long"
SPACE = " \t\n\x0b\x0c\r"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def lowered(line: Column) -> Column:
    """The line with A-Z lower-cased and every other character as it is; all-ASCII lines take the short way."""
    plain = F.octet_length(line) == F.char_length(line)
    return F.when(plain, F.lower(line)).otherwise(F.translate(line, CAPITALS, CAPITALS.lower()))


def line_keys(text: Column, least: int = LEAST) -> Column:
    """(pos, k1, k2) of each line of a text whose key has at least `least` code points."""
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    keys = F.transform(F.transform(lines, lambda x: F.btrim(x, F.lit(SPACE))), lowered)
    hashed = F.transform(
        keys,
        lambda k, i: F.struct(
            i.alias("pos"), F.xxhash64(k).alias("k1"), F.xxhash64(F.lit(1), k).alias("k2"), (F.char_length(k) >= least).alias("counts")
        ),
    )
    return F.transform(F.filter(hashed, lambda x: x["counts"]), lambda x: F.struct(x["pos"], x["k1"], x["k2"]))


class LineRuns:
    """Runs of (k1, k2, docs, top) in a shared folder; `top` is set in the one run of the batch that had the key first.

    `docs` counts the documents of a key in a batch, so no document may come in two batches.
    """

    def __init__(self, spark: SparkSession, folder: str, fanout: int = FANOUT):
        self.spark, self.folder, self.fanout = spark, folder, fanout
        #: One bucket for each shuffle partition: a batch that is shuffled by key lies as the buckets do.
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []

    def _write(self, rows: DataFrame, level: int) -> None:
        name = f"line_run_{uuid.uuid4().hex}"
        out = rows.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", f"{self.folder}/{name}")
        out.format("parquet").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def runs(self) -> list[DataFrame]:
        """All runs, those of the highest level first."""
        return [self.spark.table(name) for name in self._names()]

    def add(self, lines: DataFrame) -> None:
        """Take in a batch of (k1, k2, doc); repeated rows count once."""
        own = lines.select(*KEY, "doc").distinct().groupBy(*KEY).agg(F.count("*").alias("docs"), F.max("doc").alias("top"))
        if self.levels:
            new = reduce(lambda left, run: left.join(run.select(*KEY), KEY, "left_anti"), self.runs(), own)
            marked = own.drop("top").join(new.select(*KEY, "top"), KEY, "left")
            own = marked.select(*KEY, "docs", "top")
        self._write(own, 0)
        self._compact()

    def _compact(self) -> None:
        """Merge a level that is full into one run of the next, and so on upwards."""
        level = 0
        while level < len(self.levels):
            names = self.levels[level]
            if len(names) >= self.fanout:
                self._write(self.merged(names), level + 1)
                self.levels[level] = []
                self.drop(names)
            level += 1

    def _names(self) -> list[str]:
        return [name for level in reversed(self.levels) for name in level]

    def merged(self, names: list[str] | None = None) -> DataFrame:
        """One row per key of several runs, or of all.

        Their files are read as one plain table: a union of bucketed tables is taken to lie by bucket, which it does not.
        """
        files = self.spark.read.schema(RUN).parquet(*[f"{self.folder}/{n}" for n in names or self._names()])
        return files.groupBy(*KEY).agg(F.sum("docs").alias("docs"), F.max("top").alias("top"))

    def drop(self, names: list[str] | None = None) -> None:
        """Forget runs; their files go with the shared folder."""
        for name in names or self._names():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _batch(doc: str, cuts: list[int]) -> Column:
    """How many of the cuts lie below an id."""
    return reduce(lambda a, b: a + b, [(F.col(doc) > c).cast("int") for c in cuts], F.lit(0))


def remove_repeats(docs: DataFrame, least: int = LEAST, documents: int = DOCUMENTS, batches: int = BATCHES) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_text): texts without the lines that `documents` documents or more share.

    Texts are split at \\n. A line's key is the line without white space at its ends and with A-Z lower-cased; keys
    of fewer than `least` code points are left alone. A repeated key keeps its lines in the document with the
    largest id that holds it, and there all of them. Lines that stay are as they were.

    A null or empty text is one empty line. A document is a doc_id: rows of one id count as one document, and as
    all of them are the largest holder, all keep the line. Rows without an id are one document too, with an id
    below all others. Repeated rows each get their result; an empty table gives no rows; further columns
    are ignored, whatever their names. A text of any length is one row of its task.
    """
    spark, folder = docs.sparkSession, scratch(docs.sparkSession)
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        "doc_id", body.alias("text"), F.coalesce("doc_id", F.lit(FIRST_ID)).alias("doc"),
        F.xxhash64(body).alias("s1"), F.xxhash64(F.lit(1), body).alias("s2"),
    )
    shares = [i / batches for i in range(1, batches)]
    edges = rows.agg(F.percentile_approx("doc", shares, 1000).alias("cuts")).first().cuts if shares else []
    cuts = sorted(set(edges or []))
    keyed = rows.select("doc", "s1", "s2", F.explode(line_keys(F.col("text"), least)).alias("line"))
    # Sorted in its files by batch, so that a batch skips the pages of others; folders of batches would be many small files.
    numbered = keyed.select("doc", "s1", "s2", "line.*", _batch("doc", cuts).alias("batch"))
    numbered.sortWithinPartitions("batch").write.parquet(f"{folder}/lines")
    lines = spark.read.schema("doc long, s1 long, s2 long, pos int, k1 long, k2 long, batch int").parquet(f"{folder}/lines")

    runs = LineRuns(spark, folder)
    for number in range(len(cuts), -1, -1):
        runs.add(lines.filter(F.col("batch") == number))
    runs.merged().filter(F.col("docs") >= documents).select(*KEY, "top").write.parquet(f"{folder}/repeats")
    runs.drop()

    repeats = spark.read.parquet(f"{folder}/repeats")
    gone = lines.join(repeats, KEY).filter("doc <> top").groupBy("doc", "s1", "s2").agg(F.collect_set("pos").alias("gone"))
    gone.write.parquet(f"{folder}/gone")
    found = rows.join(spark.read.parquet(f"{folder}/gone"), ["doc", "s1", "s2"], "left")
    split = F.split("text", "\n")
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), F.col("gone"))
    kept = F.array_join(F.transform(stay, lambda i: F.element_at(F.col("split"), i + 1)), "\n")
    return found.withColumn("split", split).select(
        "doc_id",
        F.size("split").cast("long").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("gone").isNull(), F.col("text")).otherwise(kept).alias("kept_text"),
    )


def digest(found: DataFrame) -> DataFrame:
    """The kept texts as hashes."""
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


SQL = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), repeats AS (
  SELECT key, max(doc_id) AS top FROM keyed WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3
), judged AS (
  SELECT k.*, r.key IS NOT NULL AND k.doc_id <> r.top AS gone FROM keyed k LEFT JOIN repeats r ON k.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""
