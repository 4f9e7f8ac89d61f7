"""Near-dedup against all pairs, and its parts."""

import collections
import random

import numpy as np
import pyarrow as pa
import pytest

from llm.conftest import ODD, by_id
from vitalake.llm import neardup
from vitalake.llm.components import components


def shingle_set(text, size):
    words = [w.lower() for w in (text or "").encode().split()]
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def by_all_pairs(rows, size=4):
    sets = {i: shingle_set(t, size) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            common = len(sets[a] & sets[b])
            if common and 100 * common >= 80 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def families(seed, n=12):
    """Texts with copies edited more and more, so that groups hang together by chains."""
    pick, rows, number = random.Random(seed), [], 0
    for _ in range(n):
        words = [f"w{pick.randrange(4000)}" for _ in range(pick.randint(3, 150))]
        for _ in range(pick.randint(1, 8)):
            rows.append((number, pick.choice([" ", "\n "]).join(words)))
            number += 1
            words = list(words)
            for _ in range(pick.randint(0, 4)):
                words[pick.randrange(len(words))] = f"x{pick.randrange(9)}"
            if pick.random() < 0.3:
                words = [w.upper() for w in words]
    pick.shuffle(rows)
    return rows


def test_given_documents(small):
    df, texts = small
    assert by_id(neardup.groups(df, 4), "n_shingles", "component_id", "kept") == by_all_pairs(texts.items())


@pytest.mark.parametrize(("seed", "size"), [(1, 4), (2, 4), (3, 5)])
def test_families(make, seed, size, monkeypatch):
    monkeypatch.setattr(neardup, "PIECE", 5)
    rows = families(seed)
    found = neardup.groups(make(rows), 4) if size == 4 else neardup.groups(make(rows))
    assert by_id(found, "n_shingles", "component_id", "kept") == by_all_pairs(rows, size)


def test_odd_rows(make):
    rows = [*ODD, (9, "same text here"), (10, "SAME  text\nHERE"), (11, "two")]
    got = collections.defaultdict(list)
    for r in neardup.groups(make(rows), 4).collect():
        got[r.doc_id].append((r.n_shingles, r.component_id, r.kept))
    assert got[4] == [(1, 4, True)] * 2 and got[9] == got[10] == [(1, 4, False)]
    assert got[1] == [(0, 1, True)] and got[3] == [(0, 3, True)]
    assert got[11] == [(1, 5, False)] and len(got[None]) == 2
    assert neardup.groups(make([]), 4).count() == 0
    assert neardup.groups(make([(1, None)])).count() == 1


def test_estimate_is_near():
    pick = np.random.default_rng(1)
    for share in (0.2, 0.5, 0.8, 0.95):
        common = int(2000 * share / (1 + share))
        a = pick.integers(0, 1 << 63, 1000).astype(np.uint64)
        b = np.concatenate([a[:common], pick.integers(0, 1 << 63, 1000 - common).astype(np.uint64)])
        r = [neardup.registers(x, np.array([0])) for x in (a, b)]
        assert abs(neardup.similarity(*r, np.array([1000.0]), np.array([1000.0]))[0] - share) < 0.15


def test_registers_of_a_union_are_the_maxima():
    pick = np.random.default_rng(2)
    a, b = (pick.integers(0, 1 << 63, n).astype(np.uint64) for n in (50, 70))
    whole = neardup.registers(np.concatenate([a, b]), np.array([0]))
    assert (whole == np.maximum(neardup.registers(a, np.array([0])), neardup.registers(b, np.array([0])))).all()


def test_components_of_chains_and_hubs(spark, tmp_path):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(200, 200), (301, 300)]
    got = {r.node: r.component for r in components(spark.createDataFrame(links, "u long, v long"), str(tmp_path)).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 160))
    assert got[301] == got[300] == 300 and len(got) == 41 + 60 + 2


def test_shingles_of_short_and_empty_texts():
    hashes, rows, n = neardup.shingles(pa.array(["a b", None, "a B c d", "a b"]), 4)
    assert n == 4 and sorted(rows.tolist()) == [0, 2, 3] and hashes[rows == 0] == hashes[rows == 3]
