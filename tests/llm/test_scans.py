"""Decontamination, quality rules, secret scan and packing against brute force."""

import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from llm.conftest import ODD, SMALL, by_id
from vitalake.llm import boosting, decontaminate, packing, quality, secrets
from vitalake.llm.queries import table, tokenizer_path

WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORDS.findall(re.sub(rb"[A-Z]+", lambda m: m[0].lower(), (text or "").encode()))


def contaminated(rows, items, size=10):
    index = collections.defaultdict(set)
    for item, text in items:
        words = plain_words(text)
        for i in range(max(1, len(words) - size + 1) if words else 0):
            index[tuple(words[i : i + size])].add(str(item))
    out = {}
    for i, text in rows:
        words, names = plain_words(text), set()
        hit = [False] * len(words)
        for n in {len(k) for k in index}:
            for at in range(len(words) - n + 1):
                if own := index.get(tuple(words[at : at + n])):
                    names |= own
                    hit[at : at + n] = [True] * n
        listed = hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
        out[i] = (len(words), sum(hit), len(names), listed, any(hit))
    return out


COLUMNS = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.mark.parametrize("limit", [1 << 20, 2000])
def test_given_benchmark(spark, small, limit):
    df, texts = small
    bench = table(spark, SMALL, "benchmark")
    items = [(r.item_id, r.text) for r in bench.collect()]
    found = decontaminate.contamination(df, bench, limit=limit)
    got = by_id(decontaminate.digest(found), *COLUMNS)
    assert got == contaminated(texts.items(), items)
    assert decontaminate.parts_of(bench, 2000) > 1 and any(v[4] for v in got.values())


def test_short_items_and_clean_text(spark, make):
    bench = spark.createDataFrame([(1, "Two words"), (2, "..."), (3, None), (4, "two WORDS"), (None, "gone")], "item_id long, text string")
    rows = [(1, "See: two, words! end"), (2, "two\nWords"), (3, None), (4, "twowords Gone"), (5, "two words two words x")]
    found = decontaminate.contamination(make(rows), bench)
    got = by_id(found, "n_hit", "items", "clean_text", "contaminated")
    assert got[1] == (2, ["1", "4"], "See: ! end", True) and got[2] == (2, ["1", "4"], "", True)
    assert got[3] == (0, [], None, False) and got[4] == (1, [], "twowords ", True) and got[5][0] == 4
    empty = bench.limit(0)
    assert not any(r.contaminated for r in decontaminate.contamination(make(ODD), empty).collect())
    assert decontaminate.contamination(make([]), bench).count() == 0
    assert decontaminate.contamination(make(ODD), bench).count() == len(ODD)


def counted(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    count = collections.Counter(zip(words, words[1:], words[2:], strict=False))
    twice = [False] * len(words)
    for i in range(len(words) - 2):
        if count[tuple(words[i : i + 3])] > 1:
            twice[i : i + 3] = [True] * 3
    seen, copies = set(), 0
    for line in (text or "").split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            copies += line in seen
            seen.add(line)
    n, r = len(words), sum(twice)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), copies, r, n < 50 or 100 * r > 50 * n


BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def test_quality_counts(spark, small, make):
    df, texts = small
    trees = quality.train(df, table(spark, SMALL, "labels"))
    rated = quality.rate(df, trees)
    assert by_id(rated, *BASE) == {i: counted(t) for i, t in texts.items()}
    rows = [(i, t) for i, (_, t) in enumerate([*ODD, (0, "a\n\na\n a\na " + "b c d " * 40), (0, "x\ny\nx\n\n")])]
    assert by_id(quality.rate(make(rows), trees), *BASE) == {i: counted(t) for i, t in rows}
    assert not [r for r in rated.collect() if r.kept and r.base_failed]
    assert quality.rate(make([]), trees).count() == 0
    none = quality.train(df, table(spark, SMALL, "labels").limit(0))
    assert len({r.quality for r in quality.rate(df, none).collect()}) == 1


def test_quality_of_held_out_documents(spark):
    folder = SMALL.replace("0.001", "0.1")
    docs, labels = table(spark, folder, "documents"), table(spark, folder, "labels")
    kept_back = quality.F.crc32(labels.doc_id.cast("string").cast("binary")) % 4 == 0
    trees = quality.train(docs, labels.filter(~kept_back))
    judged = quality.rate(docs.join(labels.filter(kept_back), "doc_id"), trees).filter("NOT base_failed").collect()
    right = sum(r.kept == (r.quality >= 0.5) for r in judged)
    assert right == len(judged)
    told = {r.doc_id: r.quality for r in labels.collect()}
    good = [r.kept for r in judged if told[r.doc_id]]
    bad = [r.kept for r in judged if not told[r.doc_id]]
    assert sum(good) / len(good) > 0.97 and sum(bad) / len(bad) < 0.2


def test_monotonic_trees():
    pick = np.random.default_rng(3)
    x = pick.random((3000, 3))
    y = (pick.random(3000) < 0.5 + 0.4 * np.sin(6 * x[:, 0]) * x[:, 1]).astype(float)
    for sign in (-1, 1):
        model = boosting.fit(x, y, np.array([sign, 0, 0]), trees=30)
        grid = np.tile(pick.random((50, 1, 3)), (1, 40, 1))
        grid[:, :, 0] = np.linspace(0, 1, 40)
        steps = np.diff(model.scores(grid.reshape(-1, 3)).reshape(50, 40), axis=1)
        assert (sign * steps >= -1e-9).all() and np.abs(steps).max() > 0


ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [(m.start(), 1, "access", m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, "hex", m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{k}:{a}:{b}" for a, _, k, b in sorted(found)]


SECRETS = [
    (1, "é Password = 'hunter2hunter2' AKIA" + "A1" * 8), (2, "token: short token:\"" + "0f" * 16 + "\""), (3, "x" + "a" * 32 + "g" + "b" * 31),
    (4, None), (5, ""), (6, "API_KEY=abcdefgh apikey:12345678 api-key=12345678"), (7, "a" * 100), (8, "paſſword=12345678 AKIA12"),
    (9, "ghp_" + "z1" * 18 + " -----BEGIN RSA PRIVATE KEY----- xoxb-1234567890ab"), (10, "é" * 40 + "0" * 64 + "secret=" + "0" * 40),
]


def test_secrets(small, make):
    df, texts = small
    for frame, rows in ((df, texts.items()), (make(SECRETS), SECRETS)):
        got = by_id(secrets.digest(secrets.find_secrets(frame)), "n_assign", "n_access", "n_hex", "base_sha256")
        for i, text in rows:
            spans = base_spans(text)
            count = collections.Counter(s.split(":")[0] for s in spans)
            listed = hashlib.sha256(",".join(spans).encode()).hexdigest()
            assert got[i] == (count["assign"], count["access"], count["hex"], listed), i


def test_more_secrets_and_masks(make):
    got = by_id(secrets.find_secrets(make(SECRETS)), "spans", "clean_text")
    assert [s.kind for s in got[9][0]] == ["github", "pem", "slack"] and got[9][1] == "[SECRET] [SECRET] [SECRET]"
    assert got[4] == ([], None) and got[10][1] == "é" * 40 + "[SECRET][SECRET]"
    assert secrets.find_secrets(make([])).count() == 0 and secrets.find_secrets(make(ODD)).count() == len(ODD)


def test_index_leaves_out_no_match():
    pick = random.Random(4)
    bits = ["password", "=", "'", "AKIA", "0123456789abcdef" * 2, "A" * 20, " ", "Secret", ":", "api", "_", "key", "tok", "en", "ghp_", "z" * 40]
    rules = (*secrets.BASE, *secrets.MORE)
    index = secrets.TrigramIndex(set().union(*[secrets.grams_in(secrets.query_of(r.pattern)) for r in rules]))
    texts = ["".join(pick.choices(bits, k=pick.randint(0, 8))) for _ in range(400)]
    buf, offsets = secrets.raw(secrets.pa.array(texts))
    postings = index.postings(buf, offsets)
    for rule in rules:
        left = set(secrets.documents_for(secrets.query_of(rule.pattern), postings, len(texts)).tolist())
        assert {i for i, t in enumerate(texts) if re.search(rule.pattern, t, re.A)} <= left
        if (kind := secrets.run_class(rule.pattern)) is not None:
            runs = set(secrets.rows_with_run(buf, offsets, kind, rule.least).tolist())
            assert {i for i, t in enumerate(texts) if rule.spans(t)} == runs
    assert secrets.query_of("[0-9a-f]+") is True and secrets.query_of("ab|abcd") is True


def ids_of(rows):
    from tokenizers import Tokenizer

    encoded = Tokenizer.from_file(tokenizer_path()).encode_batch([t or "" for _, t in rows], add_special_tokens=False)
    return [np.array([*e.ids, 2], "<u4") for e in encoded]


def check_pieces(pieces, documents, size=4096):
    """documents: id lists by doc_id, of which each occurs once."""
    at, fill = collections.Counter(), collections.Counter()
    for p in sorted(pieces, key=lambda p: (p.doc_id, p.start)):
        ids = documents[p.doc_id]
        assert p.start == at[p.doc_id] and p.doc_tokens == len(ids) and p.length > 0
        assert p.ids_crc32 == zlib.crc32(ids[p.start : p.start + p.length].tobytes())
        at[p.doc_id] += p.length
    assert all(at[i] == len(ids) for i, ids in documents.items())
    for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)):
        assert p.offset == fill[p.sequence_id]
        fill[p.sequence_id] += p.length
    assert all(n <= size and n & (n - 1) == 0 for n in fill.values())
    return fill


def test_packing_given_documents(small):
    df, texts = small
    rows = list(texts.items())
    pieces = packing.pack(df, tokenizer_path()).collect()
    fill = check_pieces(pieces, dict(zip([i for i, _ in rows], ids_of(rows), strict=True)))
    assert max(fill.values()) == 4096


def test_packing_odd_texts(make):
    odd = [t for _, t in ODD] + [
        "<|endoftext|> a", "It's   the\tend's 12 ²½ ªº", "Ἀθήνα ΣΊΣΥΦΟΣ", "İstanbul ǅ", "é café", "\x1c a\x00b", "µ ß Ÿ ŉ",
        "word " * 9000, "'S 'LL don'T", "日本語 text", "﻿ x",
    ]
    rows = list(enumerate(odd))
    pieces = packing.pack(make(rows), tokenizer_path()).collect()
    check_pieces(pieces, dict(zip([i for i, _ in rows], ids_of(rows), strict=True)))
    assert packing.pack(make([]), tokenizer_path()).count() == 0
    repeated = packing.pack(make([(1, "a"), (1, "a"), (None, None)]), tokenizer_path()).collect()
    assert len(repeated) == 3 and {p.doc_id for p in repeated} == {1, None}


def test_words_are_forgotten_and_learned_again(monkeypatch):
    monkeypatch.setattr(packing, "REMEMBERED", 3)
    monkeypatch.setattr(packing, "RECENT", 0)
    encoder = packing.Tokenizer(tokenizer_path())
    rows = [(0, "one two three four five"), (1, "six one"), (2, ""), (3, "one two"), (4, "seven, eight 9 10!"), (5, "two six three"), (6, "one")]
    wanted = [x.tolist()[:-1] for x in ids_of(rows)]
    assert [x.tolist() for x in encoder.encode([t for _, t in rows])] == wanted
    for _ in range(2):
        assert [encoder.encode([t])[0].tolist() for _, t in rows] == wanted
    assert len(encoder.before) and len(encoder.known) + len(encoder.recent) < 15


def test_words_are_cut_as_the_library_does(monkeypatch):
    """Apostrophes, digits, signs and white space of all kinds in any order, in slices of several texts."""
    pick, encoder = random.Random(11), packing.Tokenizer(tokenizer_path())
    bits = ["'", "'s", "'ll", "'re", "'v", "ve", "d", "M", "tt", "é", "Ÿ", "ſ", "1", "²", "½", "ª", "-", '"', "…", "'\"", " ", "\n", "\x0b", "\xa0", "\x85", "日", "😀", "<|x|>", "\x00"]
    for _ in range(60):
        rows = [(i, "".join(pick.choices(bits[: pick.choice([23, 25, len(bits)])], k=pick.randint(0, 25)))) for i in range(8)]
        got = [x.tolist() for x in encoder.encode([t for _, t in rows])]
        assert got == [x.tolist()[:-1] for x in ids_of(rows)], rows


def test_words_of_one_hash_are_told_apart():
    """A word that another's first hash hides is learned like a new one."""
    store = packing.WordIds()
    one = lambda *x: np.array(x, np.uint64)
    store.add(one(5, 9), one(1, 2), np.array([2, 1]), np.array([7, 8, 4], "<u4"))
    place, there = store.find(one(5, 5, 9, 10), one(1, 3, 2, 2))
    assert there.tolist() == [True, False, True, False]
    n, ids = store.of(place[there])
    assert n.tolist() == [2, 1] and ids.tolist() == [7, 8, 4]


def test_sum_of_squares_choice():
    """Every piece goes where the sum of squared level counts is least."""
    pick, packer = random.Random(5), packing.Packer(16, 0)
    for n in [pick.randint(1, 40) for _ in range(300)]:
        before, rest = packer.counts.copy(), n % 16
        packer.add(0, np.zeros(n, "<u4"))
        if rest:
            options = []
            for level in [0, *np.flatnonzero(before[: 17 - rest])]:
                after = before.copy()
                after[level] -= level > 0
                after[level + rest] += level + rest < 16
                options.append((after**2).sum())
            assert (packer.counts**2).sum() == min(options)
        assert [len(w) for w in packer.open] == packer.counts.tolist()
