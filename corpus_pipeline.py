"""Documents made ready for training: quality rules, near-dedup, decontamination, secret scan, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last
return the columns of documents. A stage's result is written and read again before the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalake.llm import decontaminate, neardup, packing, quality, secrets
from vitalake.llm.blocks import FIRST_ID, scratch
from vitalake.llm.queries import table, tokenizer_path


#: The columns of docs but its text, as one beside the results: no operator can mistake them for its own.
ROW = "carried"


def _narrow(docs: DataFrame) -> DataFrame:
    """doc_id, text and the other columns in ROW."""
    rest = [docs[f"`{c}`"] for c in docs.columns if c != "text"]
    return docs.select(F.col("doc_id"), F.col("text"), F.struct(*rest).alias(ROW))


def _widened(found: DataFrame, docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of docs again, with the text of a result column, and its length where docs has one and the text is new."""
    new = {"text": F.col(text)}
    if text != "text":
        new["n_chars"] = F.coalesce(F.length(text), F.lit(0)).cast(dict(docs.dtypes).get("n_chars", "long"))
    return found.select(*[(new[c] if c in new else F.col(ROW)[c]).alias(c) for c in docs.columns])


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the fixed rules and the trees; the others go.

    Null and empty texts have no words and go. Repeated rows are judged alike. Columns of any name stay as they are.
    """
    trees = quality.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return _widened(quality.rate(_narrow(docs), trees).filter("kept"), docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near-duplicates; of rows with one id and text, one.

    Shingles have five words, and groups a similarity of 0.8 or more along their links. Documents are told apart by
    id and 128 bits of their text, so one id with two texts is two documents, and so are two texts without an
    id; a null text is an empty one, and a null id comes before all others. Of rows that repeat id and text, the one
    whose other columns are least as JSON stays. Copies combine before the shuffle; what is left is
    written once, each document with a number of its own, and read again.
    """
    folder = scratch(spark)
    narrow = _narrow(docs)
    body = F.coalesce("text", F.lit(""))
    rows = narrow.select("doc_id", "text", ROW, F.xxhash64(body).alias("h1"), F.xxhash64(F.lit(1), body).alias("h2"))
    order = F.struct(F.to_json(ROW), F.col("text").isNotNull())
    first = rows.groupBy("doc_id", "h1", "h2").agg(F.min_by(F.struct("text", ROW), order).alias("first"))
    numbered = first.select(F.monotonically_increasing_id().alias("document"), "doc_id", "first.*")
    numbered.write.parquet(f"{folder}/documents")
    each = spark.read.schema(numbered.schema).parquet(f"{folder}/documents")
    found = neardup.groups(each.select(F.col("document").alias("doc_id"), "text"))
    ids = each.select("document", F.coalesce("doc_id", F.lit(FIRST_ID)).alias("id"))
    grouped = ids.join(found.select(F.col("doc_id").alias("document"), "component_id"), "document").groupBy("component_id")
    keep = grouped.agg(F.min(F.struct("id", "document")).alias("least")).select(F.col("least.document").alias("document"))
    return _widened(each.join(keep, "document", "left_semi"), docs)


def without_benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words of benchmark passages; a document that is hit and left without words goes.

    A null or empty text is not hit. Repeated rows are cleaned alike. Other columns stay as they are.
    """
    found = decontaminate.contamination(_narrow(docs), table(spark, sf_dir, "benchmark"))
    return _widened(found.filter("NOT (contaminated AND n_hit = n_words)"), docs, "clean_text")


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with each secret masked. Null and empty texts stay so, as do repeated rows and other columns."""
    return _widened(secrets.find_secrets(_narrow(docs)), docs, "clean_text")


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences, each row packed for itself; a null or empty text has the end token only."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality", good_quality),
    ("near_dedup", one_of_each_group),
    ("decontamination", without_benchmarks),
    ("secrets", without_secrets),
    ("packing", packed),
]

#: Near-dedup is a search for connected components and packing an online choice, neither of which SQL states.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; what passes from one to the next lies in the shared folder.

    No documents, or none that a stage keeps, give no rows.
    """
    folder = scratch(spark)
    docs = table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}_{name}")
        docs = spark.read.parquet(f"{folder}/{number}_{name}")
    return docs
