"""Substring dedup: words covered by a window that also starts earlier, found by difference-cover anchors.

Of each document only the windows of SIZE - PERIOD + 1 words at places in a difference cover modulo
PERIOD are hashed: any two places have a common shift below PERIOD that takes both into the cover, so
two equal windows of SIZE words always share an anchor at the same shift. Anchors found once rule out
every window that holds them; the windows around the others are hashed whole, and the first place of
each, by (doc_id, start), is kept.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vitalake.llm.arrays import U, Fields, Words, covered, mixed, seeded
from vitalake.llm.blocks import BUCKET, Block, Keys, bits, dealt, found_twice, joined, text_bytes, unpacked

SIZE = 20
#: A perfect difference set: every remainder modulo 13 is a difference of two of its members.
PERIOD, COVER = 13, (0, 1, 3, 9)
SECOND = seeded(1, 99)[0]

ASKED = Fields("bucket int, block int, keys binary, several binary")
PLACED = Fields("bucket int, block int, keys binary, checks binary, docs binary, owners binary, places binary")
TOLD = Fields("block int, step int, bucket int, bits binary")
KEPT = Fields("doc_id long, n_words long, n_removed long, kept_sha256 string, kept_text string")


class Scan:
    """Words of a block, and its anchors."""

    def __init__(self, table: pa.Table, size: int, buckets: int):
        self.block, self.size = Block(table), size
        self.words = Words(self.block.text)
        place = np.arange(len(self.words)) - self.words.first[self.words.row]
        in_cover = np.isin(place % PERIOD, COVER) & (self.words.count[self.words.row] >= size)
        starts, hashes = self.words.windows(size - PERIOD + 1)
        at = in_cover[starts]
        self.anchors = starts[at]
        self.keys = Keys(hashes[at], buckets)

    def windows(self, names: list[int], answers: list[bytes], buckets: int) -> None:
        """Whole windows that hold an anchor found twice, each word sequence once."""
        keys = self.keys
        twice = keys.answers(names, answers) | (keys.counts > 1)
        marked = self.anchors[twice[keys.inverse]]
        near = covered(len(self.words), np.maximum(marked - PERIOD + 1, 0), marked + 1)
        starts, hashes = self.words.windows(self.size)
        at = near[starts]
        self.starts = starts[at]
        self.found = Keys(hashes[at], buckets)
        self.first = self.starts[self.found.first]


def replies(table: pa.Table) -> dict[int, tuple[list[int], list[bytes]]]:
    """Answers to a block by step."""
    out: dict[int, tuple[list[int], list[bytes]]] = {1: ([], []), 2: ([], [])}
    for step, bucket, answer in zip(*[table.column(c).to_pylist() for c in ("step", "bucket", "bits")], strict=True):
        out[step][0].append(bucket)
        out[step][1].append(answer)
    return out


def remove_repeats(docs: DataFrame, size: int = SIZE, text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_words, n_removed, kept_sha256, kept_text (kept words, joined by a space).

    A window is `size` consecutive words of one document; each word covered by a window whose words
    also start earlier (smaller doc_id, or same document and earlier start) is removed. Windows are
    judged on the input.

    A null text has no words. Rows that repeat id and text count as one document, and each gets its
    result; of rows with one id and several texts the one with the lower hash comes first. A null id
    comes before all others. Further columns of docs are ignored; an empty table gives no rows.
    """
    total = text_bytes(docs, text)
    # A word and its space take five bytes or more in all but odd texts; of these a third are anchors.
    buckets = max(1, total * len(COVER) // (5 * PERIOD) // BUCKET)
    by_block = dealt(docs, total, text)
    check = Rolls(size)

    def ask(table: pa.Table) -> pa.Table:
        keys = Scan(table, size, buckets).keys
        block = table.column("block")[0].as_py()
        low, several = keys.keys.astype(np.uint32), keys.counts > 1
        rows = [(b, block, low[at].tobytes(), np.packbits(several[at]).tobytes()) for b, at in keys.parts()]
        return ASKED.table(rows)

    def judge(table: pa.Table) -> pa.Table:
        keys, lengths = joined(table.column("keys"), np.uint32)
        flags = bits(found_twice(keys, unpacked(table.column("several"), lengths)), lengths)
        blocks, bucket = table.column("block").to_pylist(), table.column("bucket")[0].as_py()
        return TOLD.table([(block, 1, bucket, flag) for block, flag in zip(blocks, flags, strict=True)])

    def place(table: pa.Table, answers: pa.Table) -> pa.Table:
        scan = Scan(table, size, buckets)
        scan.windows(*replies(answers)[1], buckets)
        block, found, words = table.column("block")[0].as_py(), scan.found, scan.words
        owner = words.row[scan.first]
        at_word = scan.first - words.first[owner]
        second = check(words, scan.first)
        rows = []
        for bucket, at in found.parts():
            own, local = np.unique(owner[at], return_inverse=True)
            pairs = np.stack([scan.block.doc[own], scan.block.sig[own]], axis=1)
            rows.append(
                (bucket, block, found.keys[at].tobytes(), second[at].tobytes(), pairs.tobytes(),
                 local.astype(np.uint32).tobytes(), at_word[at].astype(np.uint32).tobytes())
            )
        return PLACED.table(rows)

    def order(table: pa.Table) -> pa.Table:
        keys, lengths = joined(table.column("keys"), np.uint64)
        checks, _ = joined(table.column("checks"), np.uint32)
        pairs, sizes = joined(table.column("docs"), np.int64)
        pairs, sizes = pairs.reshape(-1, 2), sizes // 2
        owners, _ = joined(table.column("owners"), np.uint32)
        places, _ = joined(table.column("places"), np.uint32)
        owners = owners + np.repeat(np.concatenate(([0], np.cumsum(sizes)[:-1])), lengths)
        by_doc = np.lexsort((pairs[:, 1], pairs[:, 0]))
        rank = np.zeros(len(pairs), U)
        rank[by_doc] = np.arange(len(pairs))
        when = (rank[owners] << U(32)) | places.astype(U)
        at = np.lexsort((when, checks, keys))
        later = np.zeros(len(keys), bool)
        later[at[1:]] = (keys[at][1:] == keys[at][:-1]) & (checks[at][1:] == checks[at][:-1])
        blocks, bucket = table.column("block").to_pylist(), table.column("bucket")[0].as_py()
        return TOLD.table([(block, 2, bucket, flag) for block, flag in zip(blocks, bits(later, lengths), strict=True)])

    def finish(table: pa.Table, answers: pa.Table) -> pa.Table:
        sent = replies(answers)
        scan = Scan(table, size, buckets)
        scan.windows(*sent[1], buckets)
        found, words = scan.found, scan.words
        gone = found.answers(*sent[2])[found.inverse]
        later = np.ones(len(scan.starts), bool)
        later[found.first] = False
        starts = scan.starts[gone | later]
        removed = covered(len(words), starts, starts + size)
        texts, digests, dropped = [], [], np.zeros(len(scan.block), np.int64)
        for i, value in enumerate(scan.block.text.to_pylist()):
            own = removed[words.first[i] : words.first[i + 1]]
            parts = value.encode().split()
            dropped[i] = own.sum()
            if dropped[i]:
                parts = [parts[j] for j in np.flatnonzero(~own)]
            kept_text = b" ".join(parts)
            texts.append(kept_text.decode())
            digests.append(hashlib.sha256(kept_text).hexdigest())
        columns = scan.block.rows(words.count.astype(np.int64), dropped, pa.array(digests), pa.array(texts))
        return pa.table(columns, schema=KEPT.arrow)

    def with_answers(told_: DataFrame, function, fields: Fields) -> DataFrame:
        return by_block.groupBy("block").cogroup(told_.groupBy("block")).applyInArrow(function, fields.spark)

    first = by_block.groupBy("block").applyInArrow(ask, ASKED.spark).groupBy("bucket").applyInArrow(judge, TOLD.spark)
    second = with_answers(first, place, PLACED).groupBy("bucket").applyInArrow(order, TOLD.spark)
    return with_answers(first.unionByName(second), finish, KEPT)


class Rolls:
    """A second hash of whole windows, of other word values than the first: 32 bits more to tell them apart."""

    def __init__(self, size: int):
        self.size = size

    def __call__(self, words: Words, starts: np.ndarray) -> np.ndarray:
        value, total = mixed(words.hash ^ SECOND), np.zeros(len(starts), U)
        for k in range(self.size):
            total = mixed(total) + value[starts + k]
        return (mixed(total) >> U(32)).astype(np.uint32)
