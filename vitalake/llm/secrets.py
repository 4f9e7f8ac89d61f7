"""Secret scan: regular expressions behind a trigram index.

From each rule's expression a Boolean query over trigrams is derived: what any match must contain.
A slice of documents is indexed once (postings for the trigrams that some query uses); a rule then
runs only on the documents its query leaves. A rule whose expression names no mandatory trigram is
scanned over every document. Texts are indexed with A-Z lowered, so the index also serves rules
that ignore case; the expression itself decides on every candidate.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalake.llm.arrays import LOWER, add_columns, raw

_parser = re._parser
#: Alternatives of a piece of an expression that are still listed one by one.
LISTED = 64


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its expression, and the least length of a match or of one of its groups."""

    kind: str
    pattern: str
    least: int = 0
    group: int = 0

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Ranges of code points of the matches: leftmost, not overlapping, then those long enough."""
        found = re.compile(self.pattern, re.ASCII).finditer(text)
        return [m.span() for m in found if len(m[self.group]) >= self.least]


BASE = (
    Rule(
        "assign",
        r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        least=8,
        group=1,
    ),
    Rule("access", r"AKIA[A-Z0-9]+", least=16),
    Rule("hex", r"[0-9a-f]+", least=32),
)
#: Formats that issuers publish; they add spans to the three kinds above.
MORE = (
    Rule("pem", r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[A-Za-z0-9_-]{35}"),
    Rule("stripe", r"sk_live_[A-Za-z0-9]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

SPANS = T.ArrayType(T.StructType().add("kind", T.StringType()).add("start", T.IntegerType()).add("end", T.IntegerType()))
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

# A query is True (any document), or ("and" | "or", set of trigrams and queries), in tuples.


def _all(*queries):
    rest = {q for q in queries if q is not True}
    return True if not rest else next(iter(rest)) if len(rest) == 1 else ("and", frozenset(rest))


def _any(*queries):
    if any(q is True for q in queries):
        return True
    return next(iter(set(queries))) if len(set(queries)) == 1 else ("or", frozenset(queries))


def _grams(texts: set[str]):
    """What a document with one of these texts must hold."""
    return _any(*[_all(*[t[i : i + 3] for i in range(len(t) - 2)]) for t in texts]) if texts else True


def query_of(pattern: str):
    """The Boolean trigram query of an expression: True if it names no mandatory trigram."""
    exact, query = _read(_parser.parse(pattern, re.ASCII))
    return _all(query, _grams(exact) if exact else True)


def _read(nodes) -> tuple[set[str] | None, object]:
    """Of a sequence of parsed nodes: all texts it can match, if few, else None; and what it needs besides."""
    runs: set[str] = {""}
    needs = []

    def close(after: set[str] = frozenset({""})) -> None:
        nonlocal runs
        needs.append(_grams(runs))
        runs = set(after)

    whole = True
    for op, value in nodes:
        name = str(op)
        exact, need = None, True
        if name == "LITERAL":
            exact = {chr(value).lower()} if value < 128 else None
        elif name == "IN" and all(str(k) == "LITERAL" and v < 128 for k, v in value) and len(value) <= 8:
            exact = {chr(v).lower() for _, v in value}
        elif name == "SUBPATTERN":
            exact, need = _read(value[3])
        elif name == "BRANCH":
            sides = [_read(side) for side in value[1]]
            if all(e is not None for e, _ in sides) and sum(len(e) for e, _ in sides) <= LISTED:
                exact = set().union(*[e for e, _ in sides])
            else:
                need = _any(*[_all(n, _grams(e) if e is not None else True) for e, n in sides])
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT"):
            least, most, inner = value
            inner_exact, inner_need = _read(inner)
            if (least, most) == (0, 1) and inner_exact is not None:
                exact = {"", *inner_exact}
            elif least >= 1:
                need = _all(inner_need, _grams(inner_exact) if inner_exact is not None else True)
        needs.append(need)
        if exact is not None and len(runs) * len(exact) <= LISTED:
            runs = {a + b for a, b in product(runs, exact)}
        else:
            whole = False
            close(exact or {""})
    if whole:
        return runs, _all(*needs)
    close()
    return None, _all(*needs)


def grams_in(query) -> set[str]:
    if query is True:
        return set()
    if isinstance(query, str):
        return {query}
    return set().union(*[grams_in(q) for q in query[1]])


def documents_for(query, postings: dict[str, np.ndarray], rows: int) -> np.ndarray:
    """Rows that a query leaves: postings intersected and united."""
    if query is True:
        return np.arange(rows)
    if isinstance(query, str):
        return postings[query]
    found = [documents_for(q, postings, rows) for q in query[1]]
    if query[0] == "and":
        return reduce(lambda a, b: np.intersect1d(a, b, True), sorted(found, key=len))
    return np.unique(np.concatenate(found))


class TrigramIndex:
    """Postings of the wanted trigrams over a slice of documents."""

    def __init__(self, wanted: set[str]):
        self.wanted = sorted(wanted)
        self.number = np.full(1 << 24, -1, np.int16)
        for i, gram in enumerate(self.wanted):
            a, b, c = gram.encode()
            self.number[(a << 16) | (b << 8) | c] = i

    def postings(self, buf: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
        low = LOWER[buf].astype(np.int32)
        codes = self.number[(low[:-2] << 16) | (low[1:-1] << 8) | low[2:]] if len(low) > 2 else np.zeros(0, np.int16)
        at = np.flatnonzero(codes >= 0)
        first = np.searchsorted(offsets, at, "right") - 1
        inside = at + 3 <= offsets[first + 1]
        at, first = at[inside], first[inside]
        which = codes[at]
        return {gram: np.unique(first[which == i]) for i, gram in enumerate(self.wanted)}


def run_class(pattern: str) -> np.ndarray | None:
    """For an expression that is one or more of a class of ASCII characters, that class, by byte."""
    nodes = list(_parser.parse(pattern, re.ASCII))
    if len(nodes) != 1 or str(nodes[0][0]) != "MAX_REPEAT" or nodes[0][1][0] != 1 or nodes[0][1][1] < 1 << 16:
        return None
    inner = list(nodes[0][1][2])
    if len(inner) != 1 or str(inner[0][0]) != "IN":
        return None
    table = np.zeros(256, bool)
    for kind, value in inner[0][1]:
        low, high = value if str(kind) == "RANGE" else (value, value) if str(kind) == "LITERAL" else (0, 256)
        if high > 127:
            return None
        table[low : high + 1] = True
    return table


def rows_with_run(buf: np.ndarray, offsets: np.ndarray, kind: np.ndarray, least: int) -> np.ndarray:
    """Rows that hold `least` or more bytes of a class in a row: a full scan, without an index.

    Every such run covers a place that is a multiple of `least`, and half of it lies on one side of
    that place; runs are measured only where that holds.
    """
    inside = kind[buf]
    places = np.flatnonzero(inside[::least]) * least
    sides = []
    for step in (1, -1):
        left = places
        for k in range(1, (least - 1) // 2 + 1):
            at = left + step * k
            left = left[(at >= 0) & (at < len(buf)) & inside[np.clip(at, 0, len(buf) - 1)]]
        sides.append(left)
    found = set()
    for p in np.union1d(*sides).tolist():
        row = int(np.searchsorted(offsets, p, "right")) - 1
        low, high = max(int(offsets[row]), p - least + 1), min(int(offsets[row + 1]), p + least)
        gaps = np.flatnonzero(np.concatenate(([True], ~inside[low:high], [True])))
        if np.diff(gaps).max() - 1 >= least:
            found.add(row)
    return np.array(sorted(found), np.int64)


def find_secrets(
    docs: DataFrame, base: tuple[Rule, ...] = BASE, more: tuple[Rule, ...] = MORE, text: str = "text"
) -> DataFrame:
    """docs with a count `n_<kind>` for each base rule, `base_spans`, `spans` and `clean_text`.

    The spans are arrays of kind, start and end (code points, end exclusive), ordered by start and
    then by kind as listed, base kinds first. In `clean_text` each stretch covered by spans is
    replaced by `[SECRET]`.

    A null text is an empty one in the spans and stays null in clean_text. Repeated rows are scanned
    each for itself; empty tables give empty ones. Columns of docs with the names of the new ones are
    replaced.
    """
    rules = (*base, *more)
    rank = {rule.kind: i for i, rule in enumerate(rules)}
    fields = T.StructType([T.StructField(f"n_{rule.kind}", T.LongType()) for rule in base])
    fields = fields.add("base_spans", SPANS).add("spans", SPANS).add("clean_text", T.StringType())

    def make() -> Callable:
        queries = [query_of(rule.pattern) for rule in rules]
        classes = [run_class(rule.pattern) if rule.group == 0 else None for rule in rules]
        index = TrigramIndex(set().union(*map(grams_in, queries)))

        def scan(batch):
            column = batch.column(text)
            buf, offsets = raw(column)
            postings = index.postings(buf, offsets)
            rows = len(column)
            found: dict[int, list[tuple[int, int, str, int]]] = {}
            for rule, query, kind in zip(rules, queries, classes, strict=True):
                if kind is not None and rule.least > 1:
                    left = rows_with_run(buf, offsets, kind, rule.least)
                else:
                    left = documents_for(query, postings, rows)
                for i in left.tolist():
                    for start, end in rule.spans(column[i].as_py() or ""):
                        found.setdefault(i, []).append((start, rank[rule.kind], rule.kind, end))
            texts = column.to_pylist()
            spans = [[] for _ in range(rows)]
            first = [[] for _ in range(rows)]
            counts = np.zeros((len(base), rows), np.int64)
            for i, own in found.items():
                own.sort()
                spans[i] = [{"kind": k, "start": s, "end": e} for s, _, k, e in own]
                first[i] = [{"kind": k, "start": s, "end": e} for s, r, k, e in own if r < len(base)]
                for _, r, _, _ in own:
                    if r < len(base):
                        counts[r, i] += 1
                texts[i] = masked(texts[i], [(s, e) for s, _, _, e in own])
            return [*counts, pa.array(first, _SPANS), pa.array(spans, _SPANS), pa.array(texts, pa.string())]

        return scan

    return add_columns(docs, make, fields, text)


def masked(text: str, spans: list[tuple[int, int]], mark: str = "[SECRET]") -> str:
    """The text with each stretch covered by spans (ordered by start) replaced by the mark."""
    out, at, open_to = [], 0, -1
    for start, end in spans:
        if start >= open_to:
            out += [text[at:start], mark]
        open_to = at = max(open_to, end)
    return "".join([*out, text[at:]])


def listed(spans: str):
    """Spans as text: kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """One row per document: the base counts, a hash of the base spans, and all spans as text."""
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2(listed("base_spans").cast("binary"), 256).alias("base_sha256"),
        listed("spans").alias("spans"),
    )
