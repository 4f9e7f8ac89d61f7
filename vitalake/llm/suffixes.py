"""Suffix dedup: bytes covered by a string of SIZE bytes that also starts elsewhere, by prefix doubling.

Suffixes are ranked where every common string must have a common place: at the minimizers of a text
(the place of the least hash among SPREAD neighbours), about two in SPREAD bytes. The text from one
minimizer to the next is a phrase. Two equal strings of SIZE bytes share their first minimizer and all
phrases from it that end within LIMIT bytes. Round 0 ranks phrases; each later round sorts the pairs of
the ranks of a place and of the place a growing number of phrases on, and ranks the pairs anew. A place
whose pair is found once is dropped; a place whose phrases reach LIMIT is done. Places that are left
share LIMIT bytes or so with another. Of these, those are kept that share the longest run of bytes from
the place on that lies in every string it may be the first minimizer of.

The strings around a place are then compared in steps of neighbours: the bytes common to a step must be
found twice, or none of its strings is; where all bytes of a step are found twice, all its strings are.
Only the strings of steps between these, at the ends of a passage, are compared one by one.

Rounds are written to the shared folder, so a lost executor costs a part of one round.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalake.llm.arrays import BYTES, Fields, Rolling, U, covered, mixed, ranges, raw, row_sums, slices
from vitalake.llm.blocks import BLOCK, BUCKET, FIRST_ID, Block, Keys, bits, dealt, found_twice, joined, scratch, text_bytes, unpacked

SIZE = 400
#: Bytes of a slice of documents whose places are kept in one row.
LENGTH = 1 << 20
#: Numbers a slice has for the rows that are settled in its rounds.
ROUNDS = 64

# Rows of a slice of documents: its documents, and places as packed arrays. `index` numbers the places of a
# slice, `reach` counts the phrases within LIMIT, `low` and `wide` are the starts of the strings whose first
# minimizer the place is, `ahead` is how far it lies behind `low`, and `common` is the hash of the bytes from the
# place that all of them share. `open` counts the places that take part in a further round.
STATE = Fields(
    "slice long, docs binary, index binary, rank binary, reach binary, row binary, low binary, wide binary,"
    " ahead binary, common binary, open long"
)
KINDS = {"index": "i4", "rank": "u8", "reach": "u2", "row": "i4", "low": "i4", "wide": "u2", "ahead": "u2", "common": "u8"}
#: Arrays kept as differences of neighbours, which compress well.
STEADY = ("index", "row", "low")
PAIRS = Fields("bucket int, slice long, a binary, b binary, several binary")
RANKS = Fields("slice long, bucket int, ranks binary")
KEYS = Fields("bucket int, slice long, keys binary, several binary")
BITS = Fields("slice long, bucket int, bits binary")
MARKS = Fields("doc long, sig long, low binary, wide binary, ahead binary")
CODES = Fields("slice long, bucket int, codes binary")
KEPT = Fields("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")

ALL, DETAIL, BOTH = 2, 1, 3


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of `width` values, by its start."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(U).max, U)
    padded[:n] = values
    parts = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(parts, axis=1).ravel()
    behind = np.minimum.accumulate(parts[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


class Shape:
    """The lengths that follow from SIZE: of hashed strings, of their neighbourhood, of what must be common."""

    def __init__(self, size: int):
        self.size = size
        self.gram = max(1, min(16, size // 8))
        self.spread = max(1, (size - self.gram) // 3)
        self.limit = size - 2 * self.spread - self.gram + 2
        self.common = size - self.spread + 1
        self.step = max(1, min(16, self.spread // 8))


def places(buf: np.ndarray, offsets: np.ndarray, shape: Shape) -> dict[str, np.ndarray]:
    """The minimizers of the texts of a slice, as the arrays of STATE."""
    ends = offsets[1:]
    span = shape.spread + shape.gram - 1
    empty = {name: np.zeros(0, kind) for name, kind in KINDS.items()}
    if len(buf) < span:
        return empty
    rolling = Rolling(BYTES[buf])
    grams = rolling.windows(shape.gram)
    values = (grams & U(0xFFFFFFFF00000000)) | np.arange(len(grams), dtype=U)
    least = (sliding_least(values, shape.spread) & U(0xFFFFFFFF)).astype(np.int64)
    row_of = np.repeat(np.arange(len(ends)), np.diff(offsets))
    starts = np.flatnonzero(np.arange(len(least)) + span <= ends[row_of[: len(least)]])
    if not len(starts):
        return empty
    at, rows = least[starts], row_of[starts]
    new = np.flatnonzero(np.concatenate(([True], (at[1:] != at[:-1]) | (rows[1:] != rows[:-1]))))
    at, rows, low = at[new], rows[new], starts[new]
    high = np.append(starts[new[1:] - 1], starts[-1])
    last = np.searchsorted(rows, rows, "right") - 1
    following = np.arange(len(at)) + 1
    inner = following <= last
    rank = np.zeros(len(at), U)
    own = np.flatnonzero(inner)
    rank[own] = rolling.runs(at[own], at[own + 1])
    reach = np.minimum(np.searchsorted(at, at + shape.limit, "right") - 1, last) - np.arange(len(at))
    high = np.minimum(high, ends[rows] - shape.size)
    wide = np.maximum(high - low + 1, 0)
    common = np.zeros(len(at), U)
    some = np.flatnonzero(wide)
    common[some] = rolling.runs(at[some], at[some] + shape.common)
    out = {
        "index": np.arange(len(at)), "rank": rank, "reach": reach, "row": rows, "low": low - offsets[rows],
        "wide": wide, "ahead": at - low, "common": common,
    }
    return {name: np.minimum(x, np.iinfo(KINDS[name]).max).astype(KINDS[name])[own] for name, x in out.items()}


def state_row(number: int, docs: bytes, state: dict[str, np.ndarray], open_: int) -> tuple:
    """A row of STATE."""
    sent = {name: np.diff(x, prepend=x.dtype.type(0)) if name in STEADY else x for name, x in state.items()}
    return (number, docs, *[sent[name].tobytes() for name in KINDS], open_)


def state_of(table: pa.Table | pa.RecordBatch, row: int = 0) -> dict[str, np.ndarray]:
    state = {name: np.frombuffer(table.column(name)[row].as_py(), kind) for name, kind in KINDS.items()}
    return {name: np.cumsum(x, dtype=x.dtype) if name in STEADY else x for name, x in state.items()}


class Round:
    """Pairs of ranks of one slice: round 0 ranks phrases, round r covers 2**r of them, or as many as are in reach."""

    def __init__(self, state: dict[str, np.ndarray], covers: int, buckets: int):
        reach = state["reach"].astype(np.int64)
        self.state = state
        # What a place covers now, and after this round; places that gain nothing are done.
        step = np.minimum(reach, covers) - np.minimum(reach, covers // 2)
        self.goes = np.flatnonzero(step > 0) if covers > 1 else np.arange(len(reach))
        self.alive = np.ones(len(reach), bool)
        partner = np.zeros(len(self.goes), U)
        if covers > 1:
            wanted = state["index"][self.goes] + step[self.goes]
            at = np.searchsorted(state["index"], wanted)
            there = at < len(reach)
            there[there] = state["index"][at[there]] == wanted[there]
            partner[there] = state["rank"][at[there]]
            self.alive[self.goes[~there]] = False
            self.goes, partner = self.goes[there], partner[there]
        own = state["rank"][self.goes]
        self.keys = Keys(mixed(own ^ mixed(partner + U(covers))), buckets)
        self.a, self.b = own[self.keys.first], partner[self.keys.first]


def remove_repeats(docs: DataFrame, size: int = SIZE, text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept (the bytes that are left).

    Each byte covered by a string of `size` bytes that also starts anywhere else, in the same or another
    document, is removed; overlaps count, and strings are judged on the input. n_spans counts the
    longest removed runs. `size` is at least 8.

    A null text is an empty one. Rows that repeat id and text are copies of each other, so what is long
    enough in them is removed from each. A null doc_id stays null. Further columns of docs are ignored; an
    empty table gives no rows.
    """
    spark, shape = docs.sparkSession, Shape(size)
    total = text_bytes(docs, text)
    buckets = max(1, 2 * total // shape.spread // (BUCKET // 3))
    blocks = max(1, -(-total // BLOCK))
    folder = scratch(spark)
    body = F.coalesce(F.col(text), F.lit("")).alias("text")
    known = docs.select(F.coalesce(F.col("doc_id"), F.lit(FIRST_ID)).alias("doc"), F.xxhash64(body).alias("sig"), body)

    def cut(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in slices(batch, "text", LENGTH):
                state = places(*raw(part.column("text")), shape)
                pairs = np.stack([part.column("doc").to_numpy(), part.column("sig").to_numpy()], axis=1)
                yield from STATE.table([state_row(number * ROUNDS, pairs.tobytes(), state, 1)]).to_batches()
                number += 1

    def kept_as(state: DataFrame, step: str) -> DataFrame:
        state.write.option("compression", "zstd").parquet(f"{folder}/{step}")
        return spark.read.parquet(f"{folder}/{step}")

    def pair_up(covers: int):
        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    this = Round(state_of(batch, i), covers, buckets)
                    several = this.keys.counts > 1
                    number = batch.column("slice")[i].as_py()
                    rows = [
                        (bucket, number, this.a[at].tobytes(), this.b[at].tobytes(), np.packbits(several[at]).tobytes())
                        for bucket, at in this.keys.parts()
                    ]
                    yield from PAIRS.table(rows).to_batches()

        return run

    def rerank(table: pa.Table) -> pa.Table:
        a, lengths = joined(table.column("a"), np.uint64)
        b, _ = joined(table.column("b"), np.uint64)
        several = unpacked(table.column("several"), lengths)
        order = np.lexsort((b, a))
        new = np.ones(len(a), bool)
        new[1:] = (a[order][1:] != a[order][:-1]) | (b[order][1:] != b[order][:-1])
        group = np.cumsum(new)
        many = (np.bincount(group) > 1) | (np.bincount(group, several[order]) > 0)
        bucket = table.column("bucket")[0].as_py()
        ranks = np.zeros(len(a), U)
        ranks[order] = np.where(many[group], (U(bucket) << U(32)) | group.astype(U), U(0))
        parts = np.split(ranks, np.cumsum(lengths)[:-1])
        return RANKS.table([(s, bucket, r.tobytes()) for s, r in zip(table.column("slice").to_pylist(), parts, strict=True)])

    def take(covers: int):
        def run(states: pa.Table, answers: pa.Table) -> pa.Table:
            this = Round(state_of(states), covers, buckets)
            sent = dict(zip(answers.column("bucket").to_pylist(), answers.column("ranks").to_pylist(), strict=True))
            ranks = np.zeros(len(this.keys.keys), U)
            for bucket, at in this.keys.parts():
                ranks[at] = np.frombuffer(sent[bucket], U)
            new = this.state["rank"].copy()
            new[this.goes] = ranks[this.keys.inverse]
            this.alive[this.goes] = new[this.goes] > 0
            left = {name: x[this.alive] for name, x in (this.state | {"rank": new}).items()}
            # Places that go on, and those they may still be paired with; the others are settled.
            goes = left["reach"] > covers
            end = np.searchsorted(left["index"], left["index"][goes] + left["reach"][goes], "right")
            stays = covered(len(goes), np.flatnonzero(goes), end)
            settled = ~stays & (left["wide"] > 0)
            number, docs_ = states.column("slice")[0].as_py(), states.column("docs")[0].as_py()
            rows = []
            for mask, own, open_ in ((settled, number + covers.bit_length(), 0), (stays, number, int(goes.sum()))):
                if mask.any():
                    rows.append(state_row(own, docs_, {name: x[mask] for name, x in left.items()}, open_))
            return STATE.table(rows)

        return run

    going, settled = kept_as(known.mapInArrow(cut, STATE.spark), "cut"), []
    covers = 1
    while True:
        ranks = going.drop("docs").mapInArrow(pair_up(covers), PAIRS.spark).groupBy("bucket").applyInArrow(rerank, RANKS.spark)
        done = going.groupBy("slice").cogroup(ranks.groupBy("slice")).applyInArrow(take(covers), STATE.spark)
        state = kept_as(done, f"round{covers}")
        settled.append(state.filter("open = 0"))
        going = state.filter("open > 0")
        if going.isEmpty():
            break
        covers *= 2
    state = reduce(DataFrame.unionByName, settled)

    def ask_common(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                keys = Keys(state_of(batch, i)["common"], buckets)
                yield from KEYS.table(key_rows(keys, keys.counts > 1, batch.column("slice")[i].as_py())).to_batches()

    def judge(table: pa.Table) -> pa.Table:
        keys, lengths = joined(table.column("keys"), np.uint64)
        flags = bits(found_twice(keys, unpacked(table.column("several"), lengths)), lengths)
        bucket = table.column("bucket")[0].as_py()
        return BITS.table([(s, bucket, f) for s, f in zip(table.column("slice").to_pylist(), flags, strict=True)])

    def mark(states: pa.Table, answers: pa.Table) -> pa.Table:
        now = state_of(states)
        keys = Keys(now["common"], buckets)
        twice = keys.answers(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist())[keys.inverse]
        now = {name: x[twice] for name, x in now.items()}
        pairs = np.frombuffer(states.column("docs")[0].as_py(), np.int64).reshape(-1, 2)
        rows, starts = np.unique(now["row"], return_index=True)
        ends = np.append(starts, len(now["row"]))[1:]
        return MARKS.table(
            [
                (*pairs[row].tolist(), *[now[c][a:b].tobytes() for c in ("low", "wide", "ahead")])
                for row, a, b in zip(rows, starts, ends, strict=True)
            ]
        )

    twice = state.drop("docs").mapInArrow(ask_common, KEYS.spark).groupBy("bucket").applyInArrow(judge, BITS.spark)
    marks = kept_as(state.groupBy("slice").cogroup(twice.groupBy("slice")).applyInArrow(mark, MARKS.spark), "marks")
    block = F.pmod(F.xxhash64("doc", "sig"), F.lit(blocks)).cast("int").alias("block")
    marks = marks.select(block, "*")
    by_block = dealt(docs, total, text)

    def ask_steps(table: pa.Table, told: pa.Table) -> pa.Table:
        return PAIRS.table(Strings(table, told, shape, buckets).step_rows(table.column("block")[0].as_py()))

    def judge_steps(table: pa.Table) -> pa.Table:
        inner, lengths = joined(table.column("a"), np.uint64)
        outer, _ = joined(table.column("b"), np.uint64)
        several = unpacked(table.column("several"), lengths)
        order = np.lexsort((outer, inner))
        a, b = inner[order], outer[order]
        new_inner = np.concatenate(([True], a[1:] != a[:-1]))
        new_outer = new_inner | np.concatenate(([True], b[1:] != b[:-1]))
        class_, group = np.cumsum(new_inner) - 1, np.cumsum(new_outer) - 1
        more = lambda g: ((np.bincount(g) > 1) | (np.bincount(g, several[order]) > 0))[g]
        alike = (np.bincount(class_, new_outer) == 1)[class_]
        same = more(group) & (b > 0)  # 0: the step runs over an end of its document
        codes = np.zeros(len(a), np.uint8)
        codes[order] = np.where(more(class_), np.where(same, np.where(alike, ALL, BOTH), DETAIL), 0)
        bucket, parts = table.column("bucket")[0].as_py(), np.split(codes, np.cumsum(lengths)[:-1])
        return CODES.table([(s, bucket, c.tobytes()) for s, c in zip(table.column("slice").to_pylist(), parts, strict=True)])

    def ask_strings(table: pa.Table, told: pa.Table) -> pa.Table:
        strings = Strings(table, told, shape, buckets)
        keys = strings.one_by_one(told)
        several = keys.counts > 1
        several[keys.inverse[strings.sure]] = True
        return KEYS.table(key_rows(keys, several, table.column("block")[0].as_py()))

    def finish(table: pa.Table, told: pa.Table) -> pa.Table:
        strings = Strings(table, told, shape, buckets)
        keys = strings.one_by_one(told)
        answers = part_of(told, "bits")
        repeated = keys.answers(answers.column("bucket").to_pylist(), answers.column("bits").to_pylist())[keys.inverse]
        starts = np.concatenate([strings.starts[repeated], strings.low])
        ends = np.concatenate([strings.starts[repeated], strings.high]) + size
        buf, offsets = strings.buf, strings.offsets
        removed = covered(len(buf), starts, ends)
        opens = removed.copy()
        opens[1:] &= ~removed[:-1]
        firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
        opens[firsts] = removed[firsts]
        kept = [buf[a:b][~removed[a:b]].tobytes() for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        columns = strings.block.rows(
            np.diff(offsets), row_sums(removed, offsets), row_sums(opens, offsets),
            pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(kept, pa.binary()),
        )
        return pa.table(columns, schema=KEPT.arrow)

    def with_told(told: DataFrame, function, fields: Fields) -> DataFrame:
        return by_block.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(function, fields.spark)

    def sent_back(answers: DataFrame) -> DataFrame:
        return answers.withColumn("block", F.col("slice").cast("int")).drop("slice")

    codes = with_told(marks, ask_steps, PAIRS).groupBy("bucket").applyInArrow(judge_steps, CODES.spark)
    known = marks.unionByName(sent_back(codes), allowMissingColumns=True)
    known = known.withColumn("bits", F.lit(None).cast("binary"))
    found = with_told(known, ask_strings, KEYS).groupBy("bucket").applyInArrow(judge, BITS.spark)
    return with_told(known.unionByName(sent_back(found), allowMissingColumns=True), finish, KEPT)


def key_rows(keys: Keys, several: np.ndarray, number: int) -> list[tuple]:
    """Rows of KEYS: each bucket's keys, and which were found several times."""
    return [(b, number, keys.keys[at].tobytes(), np.packbits(several[at]).tobytes()) for b, at in keys.parts()]


def part_of(told: pa.Table, column: str) -> pa.Table:
    """The rows of what a block was told that hold a column."""
    return told.filter(told.column(column).is_valid()) if column in told.column_names else told.slice(0, 0)


class Strings:
    """The strings of a block around its places, in steps of neighbours by their distance before the place.

    Step g holds the strings that start 16 g to 16 g + 15 bytes before a place (for 16, shape.step). What they
    have in common and what they cover together depends on the place and g alone, so it is the same in a copy.
    """

    def __init__(self, table: pa.Table, told: pa.Table, shape: Shape, buckets: int):
        self.block, self.shape, self.buckets = Block(table), shape, buckets
        self.buf, self.offsets = raw(self.block.text)
        marks = part_of(told, "low")
        rows = {pair: i for i, pair in enumerate(zip(self.block.doc.tolist(), self.block.sig.tolist(), strict=True))}
        row = [rows[pair] for pair in zip(marks.column("doc").to_pylist(), marks.column("sig").to_pylist(), strict=True)]
        low, lengths = joined(marks.column("low"), np.dtype("i4"))
        wide, ahead = (joined(marks.column(c), np.dtype("u2"))[0].astype(np.int64) for c in ("wide", "ahead"))
        row = np.repeat(np.array(row, np.int64), lengths)
        step, size = shape.step, shape.size
        start = self.offsets[:-1][row] + low
        n = ahead // step - (ahead - wide + 1) // step + 1
        at = np.repeat(np.arange(len(n)), n)
        g = ranges((ahead - wide + 1) // step, n)
        first = (start + ahead)[at] - step * g  # the last start of the step
        self.from_ = np.maximum(start[at], first - step + 1)
        self.to = np.minimum((start + wide - 1)[at], first)
        self.rolling = Rolling(BYTES[self.buf])
        mark = mixed(g.astype(U) + U(1))
        self.inner = mixed(self.rolling.runs(first, first - step + 1 + size) ^ mark)
        inside = (first - step + 1 >= self.offsets[:-1][row[at]]) & (first + size <= self.offsets[1:][row[at]])
        self.outer = np.zeros(len(g), U)
        self.outer[inside] = mixed(self.rolling.runs((first - step + 1)[inside], (first + size)[inside]) ^ mark[inside]) | U(1)
        # The bucket comes from the high half of a key, so all that have an inner part in common meet in one.
        high = self.inner & U(0xFFFFFFFF00000000)
        self.steps = Keys(high | (mixed(self.outer ^ mixed(self.inner)) >> U(32)), buckets)

    def step_rows(self, number: int) -> list[tuple]:
        keys = self.steps
        inner, outer, several = self.inner[keys.first], self.outer[keys.first], keys.counts > 1
        return [(b, number, inner[at].tobytes(), outer[at].tobytes(), np.packbits(several[at]).tobytes()) for b, at in keys.parts()]

    def one_by_one(self, told: pa.Table) -> Keys:
        """Take the codes of the steps: ranges of starts that repeat for certain, and the strings to compare."""
        answers = part_of(told, "codes")
        sent = dict(zip(answers.column("bucket").to_pylist(), answers.column("codes").to_pylist(), strict=True))
        codes = np.zeros(len(self.steps.keys), np.uint8)
        for bucket, at in self.steps.parts():
            codes[at] = np.frombuffer(sent[bucket], np.uint8)
        codes = codes[self.steps.inverse]
        self.low, self.high = self.from_[codes >= ALL], self.to[codes >= ALL]
        some = np.flatnonzero((codes == DETAIL) | (codes == BOTH))
        n = self.to[some] - self.from_[some] + 1
        self.starts = ranges(self.from_[some], n)
        self.sure = np.repeat(codes[some] == BOTH, n)
        return Keys(self.rolling.runs(self.starts, self.starts + self.shape.size), self.buckets)
