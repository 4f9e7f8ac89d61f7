"""Sum-of-squares packing of tokenised documents into windows of a fixed number of tokens.

A document's tokens beyond whole windows are one piece; it goes online to the fill level that leaves
the least sum of squared counts of partly filled windows. The counts are an array by level. Each
partition of documents packs its own windows as its rows arrive, so nothing is shuffled; what is open
at its end is cut into full windows and, for the rest, windows of a power of two.
"""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from vitalake.llm.arrays import Fields, Rolling, U, mixed, pick, ranges, seeded, slices

SIZE = 4096
END = 2
#: Words whose ids a Python worker remembers, twice over: those of this turn and of the one before.
REMEMBERED = 600_000
#: New words that are kept apart, at least, before they are sorted in among the others.
RECENT = 4096

# Texts of these characters only are lowered and cut here; all others go through the tokenizer whole.
PLAIN = "\\t\\n\\x0b\\x0c\\r\\x20-\\x7e\\xa0-\\u012f\\u0131-\\u017e"
_in_plain = [*range(0x09, 0x0E), *range(0x20, 0x7F), *range(0xA0, 0x130), *range(0x131, 0x17F)]

SPACE, LETTER, NUMBER, OTHER, NONE = range(5)


def _kind(code: int) -> int:
    if chr(code).isspace():
        return SPACE
    return {"L": LETTER, "N": NUMBER}.get(unicodedata.category(chr(code))[0], OTHER)


#: The kind of each character by its 16-bit code; NONE where a text with it is not plain.
KINDS = np.full(1 << 16, NONE, np.uint8)
KINDS[_in_plain] = [_kind(c) for c in _in_plain]
#: Two sets of values of characters, for two hashes of a word.
FIRST, SECOND = seeded(0x180, 21), seeded(0x180, 22)
APOSTROPHE = ord("'")
#: Endings that are words of their own after an apostrophe that starts a run: of one letter and of two.
ONE, TWO = np.array([ord(c) for c in "stmd"]), np.array([ord(a) << 16 | ord(b) for a, b in ("re", "ve", "ll")])


def _codes(text: str) -> np.ndarray:
    """Characters as 16-bit codes; those beyond take two, neither of which is plain."""
    return np.frombuffer(text.encode("utf-16-le", "surrogatepass"), "<u2")


def cut_words(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words of a lowered plain text: runs of letters or of signs, single digits, short endings."""
    kind = KINDS[codes]
    starts = kind != SPACE
    starts[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER)
    sign = np.flatnonzero((codes == APOSTROPHE) & starts)
    after = np.concatenate([codes, np.full(3, 32, codes.dtype)]).astype(np.int64)
    two = np.isin(after[sign + 1] << 16 | after[sign + 2], TWO)
    one = np.isin(after[sign + 1], ONE)
    # The letters join the apostrophe; what follows them in their run starts a word.
    for at, size in ((sign[one], 1), (sign[two], 2)):
        starts[at + 1] = False
        rest = at + 1 + size
        rest = rest[rest < len(codes)]
        starts[rest] |= kind[rest] == LETTER
    edges = np.flatnonzero(starts | (kind == SPACE))
    first = np.flatnonzero(starts[edges])
    return edges[first], np.append(edges, len(codes))[first + 1]


class WordIds:
    """Ids of words by their hash, in flat arrays: some 30 bytes a word."""

    def __init__(self):
        self.hash, self.check = np.zeros(0, U), np.zeros(0, U)
        self.at, self.n = np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.ids = np.zeros(0, "<u4")

    def __len__(self) -> int:
        return len(self.hash)

    def find(self, hashes: np.ndarray, checks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where each word lies, and whether it is there: both hashes must be the same."""
        place = np.searchsorted(self.hash, hashes)
        there = place < len(self)
        there[there] = (self.hash[place[there]] == hashes[there]) & (self.check[place[there]] == checks[there])
        return place, there

    def add(self, hashes: np.ndarray, checks: np.ndarray, n: np.ndarray, ids: np.ndarray) -> None:
        """Take in words that are not there, with the number of ids of each and all ids in order."""
        both = np.concatenate([self.hash, hashes])
        order = np.argsort(both, kind="stable")
        at = len(self.ids) + np.cumsum(n) - n
        self.hash = both[order]
        self.check = np.concatenate([self.check, checks])[order]
        self.at, self.n = np.concatenate([self.at, at])[order], np.concatenate([self.n, n.astype(np.int32)])[order]
        self.ids = np.concatenate([self.ids, ids])

    def of(self, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of words at the given places, and all these ids."""
        return self.n[place], self.ids[ranges(self.at[place], self.n[place])]


class Tokenizer:
    """Ids of texts by a word-level BPE whose words end in `</w>`, with the ids of words remembered."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer as Library

        self.library = Library.from_file(path)
        self.plain = re.compile(f"[{PLAIN}]*")
        size = self.library.get_vocab_size()
        self.ends = np.array([(self.library.id_to_token(i) or "").endswith("</w>") for i in range(size)])
        #: Words of this turn, those of them met lately, and words of the turn before.
        self.known, self.recent, self.before = WordIds(), WordIds(), WordIds()

    def learn(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each word and all ids, encoded in one text: a token that ends a word ends in `</w>`."""
        ids = np.array(self.library.encode(" ".join(words), add_special_tokens=False).ids, "<u4")
        ends = np.flatnonzero(self.ends[ids]) + 1
        if len(ends) != len(words) or (len(ends) and ends[-1] != len(ids)):
            each = [self.library.encode(word, add_special_tokens=False).ids for word in words]
            return np.array([len(x) for x in each], np.int64), np.array([i for x in each for i in x], "<u4")
        return np.diff(ends, prepend=0), ids

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text, None as the empty one."""
        texts = [text or "" for text in texts]
        body, plain = " ".join(texts), [True] * len(texts)
        if "<|" in body or (KINDS[_codes(body)] == NONE).any():
            plain = [bool(self.plain.fullmatch(text)) and "<|" not in text for text in texts]
            body = " ".join([text for text, is_plain in zip(texts, plain, strict=True) if is_plain])
        cut = iter(self._cut(body.lower(), [len(text) for text, is_plain in zip(texts, plain, strict=True) if is_plain]))
        whole = lambda text: np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")
        return [next(cut) if is_plain else whole(text) for text, is_plain in zip(texts, plain, strict=True)]

    def _cut(self, body: str, lengths: list[int]) -> list[np.ndarray]:
        """Ids of lowered plain texts that stand one after the other with a space between."""
        if not lengths:
            return []
        codes = _codes(body)
        start, end = cut_words(codes)
        hashes = Rolling(FIRST[codes]).runs(start, end)
        checks = Rolling(SECOND[codes]).runs(start, end)
        both = np.unique(hashes ^ mixed(checks), return_index=True, return_inverse=True)
        first, inverse = both[1], both[2]
        n, ids = self._ids_of(body, hashes[first], checks[first], start[first], end[first])
        at = np.cumsum(n) - n
        tokens, each = ids[ranges(at[inverse], n[inverse])], n[inverse]
        ends_at = np.cumsum(np.array(lengths, np.int64) + 1)[:-1]
        upto = np.concatenate([[0], np.cumsum(each)])
        return np.split(tokens, upto[np.searchsorted(start, ends_at)])

    def _ids_of(
        self, body: str, hashes: np.ndarray, checks: np.ndarray, start: np.ndarray, end: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of distinct words, and all ids in order; those not remembered are learned."""
        counts = np.zeros(len(hashes), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        left = np.arange(len(hashes))
        for number, store in enumerate((self.known, self.recent, self.before)):
            if not len(left) or not len(store):
                continue
            place, there = store.find(hashes[left], checks[left])
            found = left[there]
            n, ids = store.of(place[there])
            parts.append((found, n, ids))
            left = left[~there]
            if number == 2 and len(found):
                self.recent.add(hashes[found], checks[found], n, ids)
        if len(left):
            n, ids = self.learn([body[a:b] for a, b in zip(start[left].tolist(), end[left].tolist(), strict=True)])
            self.recent.add(hashes[left], checks[left], n, ids)
            parts.append((left, n, ids))
        if len(self.recent) > RECENT + len(self.known) // 8:
            self.known.add(self.recent.hash, self.recent.check, *self.recent.of(np.arange(len(self.recent))))
            self.recent = WordIds()
        if len(self.known) > REMEMBERED:
            # Words in use move on with the new ones; the others are forgotten one turn later.
            self.before, self.known = self.known, WordIds()
        for words, n, _ in parts:
            counts[words] = n
        at = np.cumsum(counts) - counts
        out = np.zeros(int(counts.sum()), "<u4")
        for words, n, ids in parts:
            out[ranges(at[words], n)] = ids
        return counts, out


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """One for each Python worker."""
    return Tokenizer(path)


class Packer:
    """Open windows by fill level, and the pieces of windows that were closed."""

    def __init__(self, size: int, first: int):
        self.size = size
        self.counts = np.zeros(size + 1, np.int64)
        self.open: list[list[list]] = [[] for _ in range(size + 1)]
        self.next = first
        self.done: list[tuple] = []

    def close(self, pieces: list) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.done.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, self.next, at))
            at += len(ids)
        self.next += 1

    def add(self, doc, ids: np.ndarray) -> None:
        total = len(ids)
        whole = total - total % self.size
        for start in range(0, whole, self.size):
            self.close([(doc, start, ids[start : start + self.size], total)])
        if whole == total:
            return
        # Copied, so that an open window keeps a piece alive and not the ids of the whole document.
        piece = (doc, whole, ids[whole:].copy(), total)
        n = total - whole
        # Placing n tokens at level h takes a window from h and adds one at h + n: the sum of squares
        # changes by 2 * counts[h + n] + 1 - (2 * counts[h] - 1); a new window takes none, a full one adds none.
        levels = np.flatnonzero(self.counts[: self.size - n + 1])
        best, level = 2 * self.counts[n] + 1, 0
        if len(levels):
            change = np.where(levels + n == self.size, 0, 2 * self.counts[levels + n] + 1) + 1 - 2 * self.counts[levels]
            k = len(levels) - 1 - int(np.argmin(change[::-1]))  # of equal changes, the fullest
            if change[k] <= best:
                best, level = change[k], int(levels[k])
        window = self.open[level].pop() if level else []
        if level:
            self.counts[level] -= 1
        window.append(piece)
        if level + n == self.size:
            self.close(window)
        else:
            self.open[level + n].append(window)
            self.counts[level + n] += 1

    def finish(self) -> None:
        """Cut what is open into full windows, and the rest into windows of a power of two."""
        pieces = [piece for windows in self.open for window in windows for piece in window]
        left = sum(len(p[2]) for p in pieces)
        pieces.reverse()
        while left:
            room = self.size if left >= self.size else 1 << (left.bit_length() - 1)
            left -= room
            window = []
            while room:
                doc, start, ids, total = pieces.pop()
                window.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    pieces.append((doc, start + room, ids[room:], total))
                room -= len(window[-1][2])
            self.close(window)

    def take(self) -> list[tuple]:
        done, self.done = self.done, []
        return done


PIECES = Fields("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def pack(docs: DataFrame, path: str, size: int = SIZE, end: int = END, text: str = "text") -> DataFrame:
    """One row per piece of a document's ids: where it starts in the document and in its sequence.

    A document's ids are those of its text by the tokenizer file `path`, then `end`. `size` is a power
    of two; a sequence holds `size` ids, or a smaller power of two, so none needs padding. Sequence ids
    are the partition's number in the high bits and a running number below; each is used once.

    A null text is an empty one: its only id is `end`. Rows with a repeated or null doc_id are packed
    each for itself. An empty table gives no rows. Further columns of docs are ignored.
    """

    def run(batches):
        packer = Packer(size, TaskContext.get().partitionId() << 32)
        encoder = tokenizer(path)

        def rows():
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*packer.take(), strict=True)], schema=PIECES.arrow)

        for batch in batches:
            for part in slices(batch, text):
                ids = part.column("doc_id").to_pylist()
                for doc, tokens in zip(ids, encoder.encode(part.column(text).to_pylist()), strict=True):
                    packer.add(doc, np.append(tokens, np.uint32(end)).astype("<u4"))
                if packer.done:
                    yield rows()
        packer.finish()
        if packer.done:
            yield rows()

    return pick(docs, "doc_id", text).mapInArrow(run, PIECES.spark)
