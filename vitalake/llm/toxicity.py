"""Toxicity: a bidirectional gated recurrent network over all overlapping windows of a document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalake.llm.arrays import Fields, add_columns, pick
from vitalake.llm.recurrent import Network, Vocabulary, train

#: Labelled documents that a fit uses at most, characters of one of them, and bytes of all.
SAMPLE, LONGEST, TOTAL = 4_000, 1 << 18, 96 << 20
#: Stretches that stand for a longer text, evenly spread over it.
STRETCHES = 16


def held_out(doc_id: str = "doc_id", part: int = 0) -> Column:
    """Whether a row's crc32 of its id as text leaves `part` modulo 5; a null id counts as empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == part


def _stretches(text: Column, longest: int) -> Column:
    """A text of up to `longest` characters as it is; of a longer one, evenly spread stretches of that many in all."""
    size, n = longest // STRETCHES, F.char_length(text)
    starts = F.transform(F.sequence(F.lit(0), F.lit(STRETCHES - 1)), lambda i: F.floor(i * (n - size) / (STRETCHES - 1)).cast("int") + 1)
    return F.when(n > longest, F.array_join(F.transform(starts, lambda at: F.substring(text, at, F.lit(size))), " ")).otherwise(text)


def fit(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, longest: int = LONGEST, total: int = TOTAL, text: str = "text") -> Network:
    """A network for P(toxic = 1), from at most `limit` labelled documents that are not held out.

    They are those with the lowest hash of their id. Of a text of more than `longest` characters, evenly spread
    stretches are learned from, so long labelled texts count as others do; of all rows, those with the lowest hash of id and
    text, up to `limit` rows and `total` bytes. Rows without an id or label are not used, rows that repeat id and text
    count once, and an id labelled both ways counts as toxic. Only texts enter.
    These bounds together bound what is broadcast and collected. No labelled document, or one class only,
    gives one score for all.
    """
    rated = pick(labels, "doc_id", "toxic").dropna().filter(~held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    sample = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = docs.select("doc_id", _stretches(F.col(text), longest).alias("text")).filter("text IS NOT NULL")
    rows = rows.join(F.broadcast(sample), "doc_id").distinct().withColumn("_hash", F.xxhash64("doc_id", "text"))
    first = rows.orderBy("_hash", "doc_id", "text").limit(limit)
    # At most `limit` rows: one task adds up their bytes.
    upto = F.sum(F.octet_length("text")).over(Window.orderBy("_hash", "doc_id", "text"))
    table = first.withColumn("_upto", upto).filter(F.col("_upto") <= total).select("doc_id", "text", "toxic").toArrow()
    table = table.sort_by([("doc_id", "ascending"), ("text", "ascending")])
    column = table.column("text").cast(pa.large_string()).combine_chunks() if len(table) else pa.array([], pa.large_string())
    return train(column, np.array(table.column("toxic").to_pylist(), np.float32) if len(table) else np.zeros(1, np.float32))


def score(docs: DataFrame, network: Network, text: str = "text") -> DataFrame:
    """docs with `score` (P that the label is 1) and `predicted` (1 if score is at least 0.5, else 0).

    A document's score is the highest of its windows; every word lies in a window. A null text or one
    without words gets the score of the bias alone. Repeated rows are scored each for itself; an empty
    table gives an empty one. Columns of docs with the names of the new ones are replaced.
    """

    def make():
        held = network

        def judge(batch):
            vocabulary = Vocabulary(batch.column(text))
            start, length, row = vocabulary.windows()
            best = np.full(batch.num_rows, -np.inf)
            np.maximum.at(best, row, held.score(vocabulary, start, length))
            best[np.isinf(best)] = held.w["out_bias"][0]
            value = 1 / (1 + np.exp(-np.clip(best, -500, 500)))
            return [value.astype(float), (value >= 0.5).astype(np.int32)]

        return judge

    return add_columns(docs, make, Fields("score double, predicted int").spark, text)
