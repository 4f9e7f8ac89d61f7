"""Words, lines and their hashes as numpy arrays, straight from the bytes of an Arrow text column.

Everything here works on one slice of rows of about SLICE bytes, so memory does not grow with a
partition; one longer text is a slice of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

SLICE = 1 << 18
U = np.uint64


def mixed(x: np.ndarray) -> np.ndarray:
    """64 well-mixed bits of each value (the finaliser of splitmix64)."""
    x = x.astype(U, copy=True)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def seeded(n: int, seed: int) -> np.ndarray:
    """n random-looking 64-bit values, the same everywhere."""
    with np.errstate(over="ignore"):
        return mixed((np.arange(1, n + 1, dtype=U) + U(seed) * U(1 << 32)) * U(0x9E3779B97F4A7C15))


BASE = 0xD6E8FEB86659FD93  # odd, so it has an inverse modulo 2**64
INVERSE = pow(BASE, -1, 1 << 64)
BYTES = seeded(256, 7)


@lru_cache(maxsize=2)
def _power_table(size: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(size, BASE, U), np.full(size, INVERSE, U)
    up[0] = down[0] = 1
    return np.cumprod(up), np.cumprod(down)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = _power_table(max(1 << 19, 1 << max(0, n - 1).bit_length()))
    return up[:n], down[:n]


class Rolling:
    """Hash of any run of a sequence of 64-bit values, by prefix sums."""

    def __init__(self, values: np.ndarray):
        up, self.down = powers(len(values) + 1)
        self.sums = np.zeros(len(values) + 1, U)
        np.cumsum(values * up[:-1], out=self.sums[1:])

    def runs(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mixed((self.sums[end] - self.sums[start]) * self.down[start])

    def windows(self, size: int) -> np.ndarray:
        """Hash of every run of `size` values, by its start."""
        n = len(self.sums) - size
        if n <= 0:
            return np.zeros(0, U)
        return mixed((self.sums[size:] - self.sums[:n]) * self.down[:n])


def class_table(codes: Sequence[int]) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(codes)] = True
    return table


SPACES = (0x20, *range(0x09, 0x0E))
WORD = ~class_table(SPACES)
#: Digits, small letters and every byte of a character beyond ASCII; capitals once they are lowered.
ALNUM = class_table([*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)])
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


KINDS = {
    "int": (T.IntegerType(), pa.int32()),
    "long": (T.LongType(), pa.int64()),
    "double": (T.DoubleType(), pa.float64()),
    "boolean": (T.BooleanType(), pa.bool_()),
    "string": (T.StringType(), pa.string()),
    "binary": (T.BinaryType(), pa.binary()),
    "strings": (T.ArrayType(T.StringType()), pa.list_(pa.string())),
    "doubles": (T.ArrayType(T.DoubleType()), pa.list_(pa.float64())),
}


class Fields:
    """Columns named once, for Spark and for Arrow: "doc_id long, text string"."""

    def __init__(self, listed: str):
        pairs = [x.split() for x in listed.split(",")]
        self.spark = T.StructType([T.StructField(n, KINDS[k][0]) for n, k in pairs])
        self.arrow = pa.schema([(n, KINDS[k][1]) for n, k in pairs])

    def table(self, rows: Sequence[tuple]) -> pa.Table:
        columns = zip(*rows, strict=True) if rows else [[] for _ in self.arrow]
        return pa.table([pa.array(c, f.type) for c, f in zip(columns, self.arrow, strict=True)], schema=self.arrow)


def texts_of(column: pa.Array) -> pa.Array:
    """The column as large strings, nulls as empty texts."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def raw(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text column, and the offsets of its rows (one more than rows)."""
    column = texts_of(column)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


class Words:
    """Words of a slice of rows: byte ranges, hashes, and each row's first word.

    `buf` holds the texts, each followed by a space, so no word runs over a row's end.
    """

    def __init__(self, column: pa.Array, lower: bool = False, kind: np.ndarray = WORD, hashes: bool = True):
        spaced = pc.binary_join_element_wise(texts_of(column), pa.scalar(" ", pa.large_string()), pa.scalar("", pa.large_string()))
        self.buf, self.offsets = raw(spaced)
        if lower:
            self.buf = LOWER[self.buf]
        inside = np.zeros(len(self.buf) + 1, np.int8)
        inside[1:] = kind[self.buf]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        self.start, self.end = edges[::2], edges[1::2]
        self.rows = len(self.offsets) - 1
        #: first[i] is the number of the first word of row i; first[rows] is the number of words.
        self.first = np.searchsorted(self.start, self.offsets)
        self.count = np.diff(self.first)
        self.row = np.repeat(np.arange(self.rows), self.count)
        if hashes:
            self.hash = Rolling(BYTES[self.buf]).runs(self.start, self.end)

    def __len__(self) -> int:
        return len(self.start)

    def word(self, i: int) -> bytes:
        return self.buf[self.start[i] : self.end[i]].tobytes()

    def windows(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the runs of `size` words that stay in their row."""
        if len(self) < size:
            return np.zeros(0, np.int64), np.zeros(0, U)
        hashes = Rolling(self.hash).windows(size)
        whole = np.flatnonzero(self.row[: len(self) - size + 1] == self.row[size - 1 :])
        return whole, hashes[whole]


def covered(n: int, starts: np.ndarray, ends: np.ndarray | int) -> np.ndarray:
    """Which of n places lie in one of the ranges [start, end)."""
    depth = np.zeros(n + 1, np.int64)
    np.add.at(depth, starts, 1)
    np.add.at(depth, ends, -1)
    return np.cumsum(depth[:-1]) > 0


def ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The places start, start + 1, .. of ranges of n places, one range after the other."""
    return np.repeat(start - (np.cumsum(n) - n), n) + np.arange(n.sum())


def row_sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of values within each row's range of offsets."""
    sums = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=sums[1:])
    return sums[offsets[1:]] - sums[offsets[:-1]]


def slices(batch: pa.RecordBatch | pa.Table, text: str, size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of a batch with about `size` bytes of text in each slice."""
    _, offsets = raw(batch.column(text))
    low = 0
    while low < batch.num_rows:
        high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + size, "right")) - 1)
        yield batch.slice(low, high - low)
        low = high


def add_columns(
    df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], list]], fields: T.StructType, text: str = "text"
) -> DataFrame:
    """df with further columns that a function of slices of its rows gives.

    `make` runs once in each task and returns that function. A column of df with the name of a new
    one is replaced.
    """
    kept = [c for c in df.columns if c not in fields.names]
    names = [*kept, *fields.names]
    schema = T.StructType([*[df.schema[c] for c in kept], *fields.fields])

    def run(batches):
        function = make()
        for batch in batches:
            for part in slices(batch, text):
                new = [x if isinstance(x, pa.Array) else pa.array(x) for x in function(part)]
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], *new], names)

    return df.mapInArrow(run, schema)


def pick(df: DataFrame, *columns: str) -> DataFrame:
    """Some columns, whatever signs their names hold."""
    return df.select(*[df[f"`{c}`"] for c in columns])
