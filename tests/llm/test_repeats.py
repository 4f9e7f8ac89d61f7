"""Substring and suffix dedup against brute force."""

import collections
import hashlib
import random

import numpy as np
import pytest

from llm.conftest import ODD, by_id
from vitalake.llm import substrings, suffixes


def kept_words(texts, size):
    """texts: (doc_id, text) in order; words covered by a window that also starts earlier go."""
    seen, out = set(), []
    for _, text in texts:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        for i in range(len(words) - size + 1):
            window = tuple(words[i : i + size])
            if window in seen:
                gone[i : i + size] = [True] * size
            seen.add(window)
        kept = b" ".join(w for w, g in zip(words, gone, strict=True) if not g)
        out.append((len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def kept_bytes(texts, size):
    data = [(text or "").encode() for _, text in texts]
    count = collections.Counter(d[i : i + size] for d in data for i in range(len(d) - size + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - size + 1):
            if count[d[i : i + size]] > 1:
                gone[i : i + size] = True
        spans = int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum())
        kept = np.frombuffer(d, np.uint8)[~gone[:-1]].tobytes()
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def copied(seed, letters="ab cd", n=30):
    """Texts that share passages at odd places, some within one text."""
    pick = random.Random(seed)
    words = ["".join(pick.choices("abc", k=pick.randint(1, 3))) for _ in range(300)]
    texts = []
    for i in range(n):
        parts = []
        for _ in range(pick.randint(0, 4)):
            a = pick.randrange(250)
            parts += words[a : a + pick.randint(1, 45)] + ["".join(pick.choices("xyz", k=4)) for _ in range(pick.randint(0, 6))]
        texts.append((i, pick.choice([" ", "  ", "\n"]).join(parts)))
    return texts


def test_words_on_given_documents(small):
    df, texts = small
    rows = sorted(texts.items())
    got = by_id(substrings.remove_repeats(df), "n_words", "n_removed", "kept_sha256")
    assert [got[i] for i, _ in rows] == kept_words(rows, 20)
    assert sum(v[1] for v in got.values()) > 0


@pytest.mark.parametrize("seed", [1, 2])
def test_words_of_shared_passages(make, seed):
    rows = copied(seed)
    got = by_id(substrings.remove_repeats(make(rows)), "n_words", "n_removed", "kept_sha256")
    assert [got[i] for i, _ in rows] == kept_words(rows, 20)


def test_bytes_on_given_documents(small):
    df, texts = small
    rows = sorted(texts.items())
    got = by_id(suffixes.remove_repeats(df), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert [got[i] for i, _ in rows] == kept_bytes(rows, 400)


@pytest.mark.parametrize(("seed", "size"), [(1, 60), (2, 9)])
def test_bytes_of_shared_passages(make, seed, size):
    rows = [*copied(seed), (100, "a" * 500), (101, "b" * (size - 1)), (102, "ab" * size)]
    got = by_id(suffixes.remove_repeats(make(rows), size), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert [got[i] for i, _ in rows] == kept_bytes(rows, size)


def test_odd_rows(make):
    long = " ".join(f"w{i}" for i in range(30_000))
    rows = [*ODD, (20, long), (21, "head " + long)]
    words = substrings.remove_repeats(make(rows)).collect()
    assert len(words) == len(rows)
    found = collections.defaultdict(list)
    for r in words:
        found[r.doc_id].append((r.n_words, r.n_removed))
    assert found[20] == [(30_000, 0)] and found[21] == [(30_001, 30_000)]
    # Rows that repeat id and text are one document: nothing of them starts earlier.
    assert found[4] == [(3, 0)] * 2 and found[1] == found[2] == found[3] == [(0, 0)]
    data = suffixes.remove_repeats(make([*rows, (4, "same " * 100), (4, "same " * 100)])).collect()
    assert len(data) == len(rows) + 2
    found = collections.defaultdict(list)
    for r in data:
        found[r.doc_id].append((r.n_bytes, r.n_removed, r.n_spans))
    assert found[20] == [(len(long), len(long), 1)] and found[21] == [(len(long) + 5, len(long), 1)]
    # There, they are copies of each other.
    assert sorted(found[4]) == [(14, 0, 0)] * 2 + [(500, 500, 1)] * 2 and found[7] == [(5000, 5000, 1)]


def test_empty_tables(make):
    assert substrings.remove_repeats(make([])).count() == 0
    assert suffixes.remove_repeats(make([])).count() == 0
    assert suffixes.remove_repeats(make([(1, None), (2, "")])).count() == 2


def test_blocks_and_buckets_do_not_show(make, monkeypatch):
    rows = copied(3, n=60)
    for module in (substrings, suffixes):
        monkeypatch.setattr(f"{module.__name__}.BUCKET", 40)
    monkeypatch.setattr("vitalake.llm.blocks.BLOCK", 500)
    monkeypatch.setattr("vitalake.llm.suffixes.BLOCK", 500)
    got = by_id(substrings.remove_repeats(make(rows)), "n_words", "n_removed", "kept_sha256")
    assert [got[i] for i, _ in rows] == kept_words(rows, 20)
    got = by_id(suffixes.remove_repeats(make(rows), 50), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert [got[i] for i, _ in rows] == kept_bytes(rows, 50)


def test_nothing_or_too_little_repeats(make):
    pick = random.Random(9)
    shared = "".join(pick.choices("abcdefgh ", k=390))  # long enough to be a candidate, too short to go
    rows = [(i, "".join(pick.choices("abcdefgh ", k=900)) + (shared if i < 6 else "") + "".join(pick.choices("ijkl", k=50))) for i in range(9)]
    got = by_id(suffixes.remove_repeats(make(rows)), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert [got[i] for i, _ in rows] == kept_bytes(rows, 400) and not any(v[1] for v in got.values())
    assert not any(r.n_removed for r in suffixes.remove_repeats(make(rows[6:])).collect())
