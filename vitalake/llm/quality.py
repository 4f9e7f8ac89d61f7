"""Quality rules: statistics of each document, two fixed rules, and boosted trees over the statistics.

The trees are fitted on a bounded sample of labelled documents (`SAMPLE` rows, those with the lowest
hash of their id); the statistics and the verdict cover every document and its whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalake.llm import boosting
from vitalake.llm.arrays import BYTES, Fields, Rolling, Words, add_columns, class_table, covered, mixed, pick, row_sums

#: Labelled documents that a fit uses at most.
SAMPLE = 20_000
SYMBOLS = class_table(b"#*$%&|<>")
CAPITALS, SMALL = class_table(range(0x41, 0x5B)), class_table(range(0x61, 0x7B))
DIGITS = class_table(b"0123456789")
MARKS = class_table(b"!?.,;:()[]{}\"'/\\@^_`~=+-")
LATER = class_table(range(0x80, 0xC0))  # bytes of a character after its first

#: Statistics the trees see, and the way each may move the score of quality: -1 never up, 0 either way.
FEATURES = {
    "log_words": 0,
    "word_length": 0,
    "symbol_share": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "capital_share": 0,
    "digit_share": 0,
    "mark_share": 0,
    "bang_share": -1,
    "symbol_word_share": -1,
    "words_a_line": 0,
    "distinct_share": 0,
}
SIGNS = np.array(list(FEATURES.values()))
COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def repeated_in_row(values: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two masks: values found twice or more in their row; values equal to an earlier one of their row."""
    keys = mixed(values ^ mixed(rows.astype(np.uint64) + np.uint64(1)))
    order = np.argsort(keys, kind="stable")
    same = keys[order][1:] == keys[order][:-1]
    later, twice = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
    later[order[1:]] = same
    twice[order[1:]] = same
    twice[order[:-1]] |= same
    return twice, later


def statistics(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """The five counts of each text, and the matrix of features."""
    words = Words(column)
    buf, offsets = words.buf, words.offsets
    share = lambda part, whole: part / np.maximum(whole, 1)
    count = lambda mask: row_sums(mask, offsets)
    starts_char = ~LATER[buf]
    chars = count(starts_char) - 1
    before = np.concatenate(([0], np.cumsum(starts_char)))
    lengths = before[words.end] - before[words.start]
    word_chars = row_sums(lengths, words.first)
    symbols = SYMBOLS[buf]
    n_symbols = count(symbols)

    # Lines: cut at \n and at the end of a row, without the space that ends each row in buf.
    cuts = buf == 10
    cuts[offsets[1:] - 1] = True
    ends = np.flatnonzero(cuts)
    starts = np.concatenate(([0], ends[:-1] + 1))
    worded = np.searchsorted(words.start, ends) > np.searchsorted(words.start, starts)
    starts, ends = starts[worded], ends[worded]
    line_row = np.searchsorted(offsets, starts, "right") - 1
    _, copy = repeated_in_row(Rolling(BYTES[buf]).runs(starts, ends), line_row)
    lines, n_dup_lines = (np.bincount(line_row, w, words.rows).astype(np.int64) for w in (None, copy))

    at, hashes = words.windows(3)
    twice, _ = repeated_in_row(hashes, words.row[at])
    n_repeat = row_sums(covered(len(words), at[twice], at[twice] + 3), words.first)
    _, again = repeated_in_row(words.hash, words.row)
    distinct = words.count - row_sums(again, words.first)
    symbol_sums = np.concatenate(([0], np.cumsum(symbols)))
    odd_words = row_sums(symbol_sums[words.end] > symbol_sums[words.start], words.first)
    capitals, n = count(CAPITALS[buf]), words.count
    features = np.stack(
        [
            np.log1p(n), share(word_chars, n), share(n_symbols, chars), share(n_dup_lines, lines), share(n_repeat, n),
            share(capitals, capitals + count(SMALL[buf])), share(count(DIGITS[buf]), chars),
            share(count(MARKS[buf]), chars), share(count(buf == 0x21), chars), share(odd_words, n),
            share(n, lines), share(distinct, n),
        ],
        axis=1,
    )
    return [x.astype(np.int64) for x in (n, word_chars, n_symbols, n_dup_lines, n_repeat)], features


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE, text: str = "text") -> boosting.Trees:
    """Trees for P(quality = 1), fitted on at most `limit` labelled documents.

    Rows without an id or label are not used; an id labelled both ways counts as bad. The ids of the
    sample are what is broadcast, and their statistics what is collected: both are bounded by `limit`. Rows of one id
    that are alike count once, and of more than `limit` different ones those with the lowest hash are used.
    No labelled document, or one class only, gives trees that score every document alike.
    """
    rated = pick(labels, "doc_id", "quality").dropna().groupBy("doc_id").agg(F.min("quality").alias("quality"))
    sample = rated.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)
    rows = pick(docs, "doc_id", text).join(F.broadcast(sample), "doc_id")
    measured = add_columns(rows, lambda: _measure(text), Fields("_features doubles").spark, text)
    different = measured.select("doc_id", "quality", "_features").distinct()
    table = different.orderBy(F.xxhash64("doc_id", "_features"), "doc_id").limit(limit).toArrow().sort_by("doc_id")
    x = np.array(table.column("_features").to_pylist(), float).reshape(len(table), len(FEATURES))
    y = np.array(table.column("quality").to_pylist(), float) > 0
    # Ties of the sort (repeated rows) are equal in all but their features; put those in order too.
    order = np.lexsort([*x.T[::-1], np.array(table.column("doc_id").to_pylist(), np.int64)]) if len(x) else []
    return boosting.fit(x[order], y[order].astype(float), SIGNS) if len(x) else boosting.fit(x, y.astype(float), SIGNS)


def _measure(text: str):
    return lambda batch: [pa.array(list(statistics(batch.column(text))[1]), pa.list_(pa.float64()))]


def rate(docs: DataFrame, trees: boosting.Trees, least: float = 0.5, text: str = "text") -> DataFrame:
    """docs with the five counts, `base_failed`, `quality` (P of a good document) and `kept`.

    base_failed: under 50 words, or over half of the words in three-word windows that repeat. kept: not
    base_failed, and quality at least `least`. A null or empty text has no words, so it fails. Repeated
    rows are judged each for itself; an empty table gives an empty one. Columns of docs with the names
    of the new ones are replaced.
    """
    fields = Fields(f"{COUNTS}, base_failed boolean, quality double, kept boolean").spark

    def judge(batch):
        counts, features = statistics(batch.column(text))
        n, repeat = counts[0], counts[4]
        failed = (n < 50) | (100 * repeat > 50 * n)
        quality = trees.probability(features)
        return [*counts, failed, quality, ~failed & (quality >= least)]

    return add_columns(docs, lambda: judge, fields, text)
