"""Benchmark decontamination: n-grams of the test items in a broadcast hash set, documents scanned against it.

Both sides are lower-cased (A-Z) and cut into runs of letters, digits and characters beyond ASCII.
A window is `size` consecutive words of an item; an item of fewer words, but some, is one window of
its own length. A document word inside any occurrence of a window is hit. Hash hits are verified
on the words themselves.

The index is broadcast only while its items hold at most `limit` bytes; above that the items are
dealt by hash into as many parts as needed, and the documents are passed by each part in turn
within one job. Nothing is left out either way.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalake.llm.arrays import ALNUM, Fields, Words, add_columns, covered, pick, row_sums

#: Bytes of benchmark items in one broadcast part; an index takes about 100 times as much in a task.
INDEX_BYTES = 1 << 20
#: Bytes that an item counts besides its text.
ITEM_BYTES = 64
FOUND = Fields("_hit binary, _items strings").spark
RESULT = Fields("n_words long, n_hit long, n_items long, items strings, contaminated boolean, clean_text string").spark


class Index:
    """Windows of the items by length: sorted hashes, and the words and items of each hash."""

    def __init__(self, items: list[tuple[str, str]], size: int):
        self.sizes: dict[int, tuple[np.ndarray, list[dict[bytes, list[str]]]]] = {}
        found: dict[int, dict[int, dict[bytes, set[str]]]] = defaultdict(lambda: defaultdict(lambda: defaultdict(set)))
        words = Words(pa.array([text for _, text in items], pa.large_string()), True, ALNUM)
        for n in range(1, size + 1):
            starts, hashes = words.windows(n)
            rows = words.row[starts]
            for start, row, value in zip(starts, rows, hashes.tolist(), strict=True):
                if n == size or words.count[row] == n:
                    text = b" ".join(words.word(i) for i in range(start, start + n))
                    found[n][value][text].add(items[row][0])
        for n, by_hash in found.items():
            keys = np.array(sorted(by_hash), np.uint64)
            self.sizes[n] = keys, [{t: sorted(i) for t, i in by_hash[int(k)].items()} for k in keys]

    def hits(self, words: Words) -> tuple[np.ndarray, list[set[str]]]:
        """Which words are hit, and the items found in each row."""
        hit, items = np.zeros(len(words), bool), [set() for _ in range(words.rows)]
        for n, (keys, known) in self.sizes.items():
            starts, hashes = words.windows(n)
            place = np.minimum(np.searchsorted(keys, hashes), len(keys) - 1)
            sure = []
            for i in np.flatnonzero(keys[place] == hashes):
                start = starts[i]
                text = b" ".join(words.word(j) for j in range(start, start + n))
                if names := known[place[i]].get(text):
                    items[words.row[start]].update(names)
                    sure.append(start)
            if sure:
                sure = np.array(sure)
                hit |= covered(len(words), sure, sure + n)
        return hit, items


def parts_of(benchmark: DataFrame, limit: int) -> int:
    """Broadcast parts that the items need, from their measured size."""
    total = benchmark.agg(F.sum(F.octet_length("text") + ITEM_BYTES)).first()[0] or 0
    return -(-total // limit) or 1


def contamination(
    docs: DataFrame, benchmark: DataFrame, size: int = 10, text: str = "text", limit: int = INDEX_BYTES
) -> DataFrame:
    """docs with `n_words`, `n_hit`, `n_items`, `items` (ids as text, sorted), `contaminated`, `clean_text`.

    `clean_text` is the text without the hit words; each cut takes the bytes from the first to the
    last word of a run of hit words, so other white space and marks stay.

    A null text has no words; a null item text or one without words has no window; an item with a
    null id is still looked for, but not listed. Repeated rows are judged each for itself. Empty
    tables give no rows, or no hits. Columns of docs with the names above are replaced.
    """
    items = pick(benchmark, "item_id", "text").filter(F.col("text").isNotNull())
    n_parts = parts_of(items, limit)
    out = docs.withColumns({"_hit": F.lit(None).cast("binary"), "_items": F.array().cast("array<string>")})
    for part in range(n_parts):
        rows = items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n_parts)) == part) if n_parts > 1 else items
        listed = [(None if i is None else str(i), t) for i, t in rows.collect()]
        held = docs.sparkSession.sparkContext.broadcast(listed)
        last = part == n_parts - 1
        out = add_columns(out, _pass(held, size, text, last), RESULT if last else FOUND, text)
    return out.drop("_hit", "_items")


def _pass(held, size: int, text: str, last: bool):
    """A pass of the documents by one part of the items; the last one gives the results."""

    def make():
        index = Index(held.value, size)

        def scan(batch):
            words = Words(batch.column(text), True, ALNUM)
            hit, found = index.hits(words)
            names = batch.column("_items").to_pylist()
            for i, earlier in enumerate(batch.column("_hit").to_pylist()):
                found[i].update(names[i])
                if earlier:
                    own = np.unpackbits(np.frombuffer(earlier, np.uint8), count=words.count[i]).astype(bool)
                    hit[words.first[i] : words.first[i + 1]] |= own
            n_hit = row_sums(hit, words.first)
            hits = {i: hit[words.first[i] : words.first[i + 1]] for i in np.flatnonzero(n_hit).tolist()}
            if not last:
                sent = [np.packbits(hits[i]).tobytes() if i in hits else None for i in range(words.rows)]
                return [pa.array(sent, pa.binary()), pa.array([[*x] for x in found], pa.list_(pa.string()))]
            texts = batch.column(text).to_pylist()
            for i, own in hits.items():
                texts[i] = without(words, i, own, texts[i].encode())
            listed = [sorted(x for x in own if x is not None) for own in found]
            return [
                words.count.astype(np.int64), n_hit, np.array([len(x) for x in listed], np.int64),
                pa.array(listed, pa.list_(pa.string())), n_hit > 0, pa.array(texts, pa.string()),
            ]

        return scan

    return make


def without(words: Words, row: int, hit: np.ndarray, data: bytes) -> str:
    """A row's text without its runs of hit words."""
    edge = np.diff(np.concatenate(([0], hit.astype(np.int8), [0])))
    first, base = words.first[row], words.offsets[row]
    kept, at = [], 0
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True):
        kept.append(data[at : words.start[first + a] - base])
        at = words.end[first + b - 1] - base
    return b"".join([*kept, data[at:]]).decode()


def digest(found: DataFrame) -> DataFrame:
    """One row per document: the counts, and a hash of the sorted item ids."""
    listed = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", listed.alias("items_sha256"), "contaminated")
