"""Documents in blocks, and keys of a block dealt to buckets as packed arrays.

A block is a set of documents given by a hash of their id and text, of about BLOCK bytes; one task
works on a block at a time. What a block must learn from all others (is this window found elsewhere?)
it asks of buckets: each distinct key of the block goes, once, to the bucket its hash names, in one
row per block and bucket. A bucket answers with bits or values in the order of the keys, so an answer
carries no keys. As a block sends a key once, a key that a third of all rows hold costs a bucket one
entry per block, not one per row.

Documents are told apart by id and text: rows that repeat both count as one document, and each gets
its result. A null id sorts before all others.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitalake.llm.arrays import Fields, U

#: Bytes of text in a block, in a partition of blocks, and keys in a bucket.
BLOCK = 2 << 20
PARTITION = 32 << 20
BUCKET = 1_500_000
#: Bytes of packed arrays that a task hands over at once.
PIECE = 4 << 20
FIRST_ID = -(1 << 63)


def text_bytes(docs: DataFrame, text: str = "text") -> int:
    """Bytes of all texts."""
    return docs.agg(F.sum(F.octet_length(F.col(text)))).first()[0] or 0


def dealt(docs: DataFrame, total: int, text: str = "text") -> DataFrame:
    """(block, doc, sig, doc_id, text) with the rows of a block together. One shuffle of the texts."""
    spark = docs.sparkSession
    blocks = max(1, -(-total // BLOCK))
    parts = max(min(int(spark.conf.get("spark.sql.shuffle.partitions")), blocks), -(-total // PARTITION))
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.select(
        F.coalesce(F.col("doc_id"), F.lit(FIRST_ID)).alias("doc"), F.xxhash64(body).alias("sig"), "doc_id",
        body.alias("text"),
    )
    return keyed.withColumn("block", F.pmod(F.xxhash64("doc", "sig"), F.lit(blocks)).cast("int")).repartition(parts, "block")


class Block:
    """The documents of a block in order of id and text, each once, and the rows that stand for them."""

    def __init__(self, table: pa.Table):
        doc, sig = (table.column(c).to_numpy() for c in ("doc", "sig"))
        order = np.lexsort((sig, doc))
        new = np.ones(len(order), bool)
        new[1:] = (doc[order][1:] != doc[order][:-1]) | (sig[order][1:] != sig[order][:-1])
        self.doc, self.sig = doc[order][new], sig[order][new]
        self.text = table.column("text").take(pa.array(order[new])).combine_chunks()
        self.copies = np.diff(np.append(np.flatnonzero(new), len(order)))
        self.doc_id = table.column("doc_id").take(pa.array(order[new])).combine_chunks()

    def __len__(self) -> int:
        return len(self.doc)

    def rows(self, *columns) -> list[pa.Array]:
        """doc_id and one value per document, as one row for each row of the input."""
        at = pa.array(np.repeat(np.arange(len(self)), self.copies))
        return [c.take(at) for c in (self.doc_id, *[x if isinstance(x, pa.Array) else pa.array(x) for x in columns])]


class Keys:
    """Distinct keys of a block, where each is first found, how often, and the bucket each goes to."""

    def __init__(self, values: np.ndarray, buckets: int):
        self.keys, self.first, self.inverse, self.counts = np.unique(
            values, return_index=True, return_inverse=True, return_counts=True
        )
        bucket = ((self.keys >> U(32)) % U(buckets)).astype(np.int32)
        self.order = np.argsort(bucket, kind="stable")
        self.names, self.starts = np.unique(bucket[self.order], return_index=True)
        self.ends = np.append(self.starts, len(self.order))[1:]

    def parts(self) -> Iterator[tuple[int, np.ndarray]]:
        """Each bucket, and which keys go there."""
        for name, low, high in zip(self.names.tolist(), self.starts, self.ends, strict=True):
            yield name, self.order[low:high]

    def answers(self, names: list[int], bits: list[bytes]) -> np.ndarray:
        """The bits that buckets sent back, by key."""
        sent = dict(zip(names, bits, strict=True))
        out = np.zeros(len(self.keys), bool)
        for name, at in self.parts():
            out[at] = np.unpackbits(np.frombuffer(sent[name], np.uint8), count=len(at)).astype(bool)
        return out


def in_pieces(fields: Fields, rows: Iterable[tuple]) -> pa.Table:
    """Rows with packed arrays as a table in pieces of about PIECE bytes: they are made as they are taken, and Spark gets them one by one."""
    pieces, own, n = [], [], 0
    for row in rows:
        own.append(row)
        n += sum(len(x) for x in row if isinstance(x, bytes))
        if n >= PIECE:
            pieces.append(fields.table(own))
            own, n = [], 0
    return pa.concat_tables([*pieces, fields.table(own)])


def joined(column: pa.ChunkedArray, kind) -> tuple[np.ndarray, np.ndarray]:
    """Packed arrays of all rows of a column one after the other, and the length of each."""
    parts = [np.frombuffer(x, kind) for x in column.to_pylist()]
    return np.concatenate(parts) if parts else np.zeros(0, kind), np.array([len(p) for p in parts], np.int64)


def unpacked(column: pa.ChunkedArray, lengths: np.ndarray) -> np.ndarray:
    """Flags of all rows of a column of packed bits."""
    parts = zip(column.to_pylist(), lengths, strict=True)
    return np.concatenate([np.unpackbits(np.frombuffer(x, np.uint8), count=n) for x, n in parts]).astype(bool)


def bits(flags: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """Flags cut into the given lengths, packed."""
    return [np.packbits(part).tobytes() for part in np.split(flags, np.cumsum(lengths)[:-1])]


def found_twice(keys: np.ndarray, several: np.ndarray) -> np.ndarray:
    """Which entries have a key that another entry has too, or that was found several times in one block."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    group = np.cumsum(new) - 1
    size = np.bincount(group)
    many = np.bincount(group, several[order]) > 0
    out = np.zeros(len(keys), bool)
    out[order] = ((size > 1) | many)[group]
    return out


def scratch(spark: SparkSession) -> str:
    """A new folder in the shared folder of the cluster, for tables between jobs."""
    from vitalake.session import shared_dir

    return shared_dir(spark, f"llm-{uuid.uuid4().hex}")


@contextmanager
def shuffles_end_with_jobs(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a job go when it ends, not when the driver next collects garbage; the setting is restored."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)
