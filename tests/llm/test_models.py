"""Language model, toxicity network and their queries on held-out documents."""

import collections
import math
import time
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from llm.conftest import ODD, by_id
from vitalake.llm import blocks, language, quality, recurrent, toxicity
from vitalake.llm.queries import QUERIES, table

SF = "/root/testdata/sf0.01"


def base_of(rows):
    tokens = [(i, [w.lower() for w in (t or "").encode().split()] + [None]) for i, t in rows]
    out = [zlib.crc32(b"" if i is None else str(i).encode()) % 5 == 1 for i, _ in rows]
    count = collections.Counter(w for (_, t), held in zip(tokens, out, strict=True) if not held for w in t)
    n, v = sum(count.values()), len(count)
    return [
        (held, len(t), sum(count[w] > 0 for w in t), n, sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t))
        for (_, t), held in zip(tokens, out, strict=True)
    ]


def test_language_model(spark):
    docs = table(spark, SF, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = by_id(QUERIES["op6_maxent_lm"](spark, SF), "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    for (i, _), want in zip(rows, base_of(rows), strict=True):
        assert got[i][:4] == want[:4] and got[i][4] == pytest.approx(want[4], rel=1e-9)
    held = [v for v in got.values() if v[0]]
    assert sum(v[5] for v in held) > sum(v[4] for v in held)


def test_language_model_odd_rows(make, monkeypatch):
    monkeypatch.setattr(language, "BUCKET", 5)
    rows = [*ODD, (9, "a A b"), (10, "a " * 3000)]
    got = language.score(make(rows)).collect()
    want = base_of(rows)
    key = lambda x: repr(x)
    assert sorted([(r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got], key=key) == sorted(
        [(*w[:4], round(w[4], 6)) for w in want], key=key
    )
    assert all(math.isfinite(r.score) and r.score < 0 for r in got)
    assert language.score(make([])).count() == 0


def test_slot_probabilities_sum_to_one():
    model = language.Model()
    tokens = language.Tokens(pa.array(["the cat sat on the mat", "the dog"]))
    for _ in range(5):
        model.learn(tokens.contexts(), tokens.slot)
    contexts = tokens.contexts()[:, 3:4]
    every = np.arange(language.SLOTS)
    total = 10 ** model.log_probability(np.repeat(contexts, len(every), axis=1), every)
    assert total.sum() == pytest.approx(1, rel=1e-4)
    assert total[tokens.slot[3]] > 1 / language.SLOTS


def test_network_gradients():
    column = pa.array(["one two three four five", "six two", "seven one three"])
    vocabulary = recurrent.Vocabulary(column)
    network = recurrent.Network(vocabulary.hash[:4], np.ones(4, np.float32))
    network.w = {k: v.astype(np.float64) for k, v in network.w.items()}
    start, length, _ = vocabulary.windows()
    at, mask = recurrent.places(vocabulary, start, length)
    labels = np.array([1.0, 0.0, 1.0])

    def loss():
        z = network.forward(network.inputs(vocabulary)[0], at, mask)
        return np.log1p(np.exp(-np.where(labels > 0, z, -z))).sum()

    x = network.inputs(vocabulary)[0]
    keep = {}
    slope = recurrent._sigmoid(network.forward(x, at, mask, keep)) - labels
    gradients, d_x = network.backward(x, at, mask, keep, slope)
    pick = np.random.default_rng(1)
    for name, own in gradients.items():
        for place in [tuple(pick.integers(0, s) for s in own.shape) for _ in range(3)]:
            old = network.w[name][place]
            network.w[name][place] = old + 1e-3
            up = loss()
            network.w[name][place] = old - 1e-3
            down = loss()
            network.w[name][place] = old
            assert own[place] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=2e-4), name
    assert d_x.shape == x.shape


def test_windows_cover_every_word():
    for n in (0, 1, 63, 64, 65, 112, 113, 1000):
        vocabulary = recurrent.Vocabulary(pa.array([" ".join(["w"] * n), "x"]))
        start, length, row = vocabulary.windows()
        inside = np.zeros(n + 1, bool)
        for a, b, r in zip(start, length, row, strict=True):
            inside[a : a + b] = True
            assert 0 < b <= recurrent.WINDOW and (r == 0) == (a < n)
        assert inside.all()


def test_toxicity_of_held_out_documents(spark):
    folder = SF.replace("0.01", "0.1")
    got = by_id(QUERIES["op10_toxicity"](spark, folder), "held_out", "score", "predicted")
    told = {r.doc_id: r.toxic for r in table(spark, folder, "labels").collect()}
    right = [v[2] == told[i] for i, v in got.items() if v[0] and i in told]
    assert sum(right) / len(right) > 0.95 and all(0 <= v[1] <= 1 for v in got.values())


def test_toxicity_odd_rows(spark, make):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40, 80)] + [(None, 1), (41, None), (99, 1)], "doc_id long, toxic int")
    train = [(i, f"you {'awful' if i % 2 else 'good'} thing number {i} " * 5) for i in range(40, 80)]
    network = toxicity.fit(make([*train, *ODD]), labels)
    got = toxicity.score(make([*ODD, (90, "awful thing " * 9000)]), network).collect()
    assert len(got) == len(ODD) + 1 and all(0 <= r.score <= 1 for r in got)
    assert [r.predicted for r in got if r.doc_id == 90] == [1]
    assert toxicity.score(make([]), network).count() == 0
    none = toxicity.fit(make(ODD), labels.limit(0))
    assert len({r.score for r in toxicity.score(make(ODD), none).collect()}) == 1


def test_every_context_has_a_row_of_its_own():
    tokens = language.Tokens(pa.array([" ".join(f"w{i} v{i * 7 % 40009}" for i in range(40009))]))
    contexts = tokens.contexts()
    names = language.Model._rows(contexts, 0, tokens.slot // language.MEMBERS)
    assert len(np.unique(names[1])) == len(np.unique(contexts[1])) > 1 << 15


def test_rounds_start_from_the_shared_weights(make, monkeypatch):
    monkeypatch.setattr(blocks, "BLOCK", 20_000)
    monkeypatch.setattr(language, "SHARE", 30_000)
    pick = np.random.default_rng(3)
    follows = pick.permutation(300)
    rows = []
    for i in range(60):
        words, w = [], int(pick.integers(300))
        for _ in range(300):
            words.append(f"t{w}e")
            w = int(follows[w])
        rows.append((i, " ".join(words)))
    docs = make(rows)
    one, three = (sum(r.score for r in language.score(docs, **kw).collect() if r.held_out) for kw in ({"rounds": 1}, {}))
    assert three > one


def test_a_round_replaces_the_one_before(spark, make, monkeypatch, tmp_path):
    """Of three rounds the last table of weights is left, and all rows are scored from it."""
    monkeypatch.setattr(blocks, "BLOCK", 20_000)
    monkeypatch.setattr(language, "scratch", lambda spark: f"{tmp_path}/scratch")
    scored = language.score(make([(i, f"word{i % 7} and word{i % 11} " * 300) for i in range(40)]))
    assert sorted(p.name for p in (tmp_path / "scratch").iterdir()) == ["counts", "weights2"]
    assert scored.count() == 40


def test_a_round_holds_a_row_of_weights_once(spark, make, monkeypatch, tmp_path):
    """However many blocks ask for it; and every block gets the rows of its names, in their order."""
    monkeypatch.setattr(blocks, "BLOCK", 20_000)
    monkeypatch.setattr(language, "SHARE", 30_000)
    docs = make([(i, " ".join(f"w{(i * k + k) % 50}" for k in range(400))) for i in range(60)])
    by_block = blocks.dealt(docs, blocks.text_bytes(docs)).cache()
    held, buckets = language.train(by_block, blocks.text_bytes(docs), f"{tmp_path}/t", 2, 1)
    asked, own = {}, collections.defaultdict(list)
    for row in by_block.collect():
        own[row.block].append(row.text)
    for number, texts in own.items():
        tokens = language.Tokens(pa.array(texts))
        asked[number] = language._keys(tokens.contexts(), tokens.slot, buckets)
    names = np.unique(np.concatenate([keys.keys for keys in asked.values()]))
    table = spark.read.parquet(f"{tmp_path}/t/weights1").select("weights").collect()
    assert len(asked) > 3 and buckets > 2
    assert sum(len(r.weights) for r in table) == len(names) * 2 * language.CLASSES < sum(len(k.keys) for k in asked.values()) * 2 * language.CLASSES
    answers = {(r.block, r.bucket): np.frombuffer(r.weights, np.float16).reshape(-1, language.CLASSES) for r in held.collect()}
    seen = {}
    for number, keys in asked.items():
        for bucket, at in keys.parts():
            assert len(answers[number, bucket]) == len(at)
            for name, weights in zip(keys.keys[at].tolist(), answers[number, bucket], strict=True):
                assert (seen.setdefault(name, weights) == weights).all()
    assert len(seen) == len(names) and any(w.any() for w in seen.values())


def test_blocks_without_training_texts(make, monkeypatch):
    """They ask for weights in the last round only, and get those that others learned."""
    monkeypatch.setattr(blocks, "BLOCK", 3000)
    text = "the cat sat on the mat and the dog sat on the cat " * 12
    held = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 == 1]
    learned = [i for i in range(200) if i not in held]
    got = language.score(make([(i, text) for i in [*held[:8], *learned[:2]]])).collect()
    assert sorted(r.doc_id for r in got if r.held_out) == sorted(held[:8])
    assert all(r.score > r.base_score for r in got)
    none = language.score(make([(i, text) for i in held[:8]])).collect()
    assert len(none) == 8 and all(r.train_tokens == 0 and r.n_known == 0 and math.isfinite(r.score) for r in none)


def test_shuffle_files_end_with_their_job(spark, tmp_path):
    files, key = spark._jsc.sc().env().blockManager().diskBlockManager(), "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

    def shuffled():
        every = files.getAllFiles()
        return {name for i in range(every.size()) if (name := every.apply(i).getName()).startswith("shuffle_")}

    before, setting = shuffled(), spark.conf.get(key, None)
    with blocks.shuffles_end_with_jobs(spark):
        spark.range(100_000).repartition(3, "id").write.parquet(f"{tmp_path}/out")
    until = time.time() + 5  # files go in the background
    while shuffled() - before and time.time() < until:
        time.sleep(0.1)
    assert not shuffled() - before
    assert spark.conf.get(key, None) == setting and spark.read.parquet(f"{tmp_path}/out").count() == 100_000


def test_weights_are_handed_over_in_pieces(monkeypatch):
    """Rows are made one after the other, and no piece holds much more than PIECE bytes."""
    monkeypatch.setattr(blocks, "PIECE", 1000)
    rows = [(i, 7, bytes([i]) * (i % 5 * 100)) for i in range(50)]
    made = blocks.in_pieces(language.HELD, iter(rows))
    assert [tuple(r.values()) for r in made.to_pylist()] == rows
    assert max(b.column("weights").nbytes for b in made.to_batches()) < 2000 and len(made.to_batches()) > 5
    assert blocks.in_pieces(language.HELD, iter([])).num_rows == 0


def test_long_labelled_texts_are_learned_from(spark, make):
    """One class has long texts only: stretches of them are learned from, whole texts are scored."""
    good, bad = "a calm and friendly line of words ", "you awful nasty horrid fool "
    rows = [(i, (bad if i % 2 else good) * (400 if i % 2 else 3)) for i in range(1, 160)]
    labels = spark.createDataFrame([(i, 1, i % 2) for i, _ in rows], "doc_id long, quality int, toxic int")
    network = toxicity.fit(make(rows), labels, longest=2000)
    got = {r.doc_id: r.predicted for r in toxicity.score(make([(1, bad * 9), (2, good * 9), (3, good * 50 + bad * 40)]), network).collect()}
    assert got == {1: 1, 2: 0, 3: 1}


def test_stretches_are_spread_over_a_text(spark):
    text = "".join(chr(0x100 + i % 0x100) for i in range(10_000))
    df = spark.createDataFrame([(text,), (text[:160],), (None,)], "text string")
    cut = [r[0] for r in df.select(toxicity._stretches(F.col("text"), 160)).collect()]
    parts = cut[0].split(" ")
    assert cut[1:] == [text[:160], None] and [len(x) for x in parts] == [10] * 16
    assert text.startswith(parts[0]) and text.endswith(parts[-1]) and all(x in text for x in parts)


def test_an_id_of_a_third_of_all_rows_is_bounded(spark, make):
    """The rows of a sampled id are no more than the limit, whatever their number."""
    rows = [(1, f"text {i} " + "a b c " * 30) for i in range(300)] + [(i, "good words " * 40) for i in range(2, 40)]
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 40)], "doc_id long, quality int, toxic int")
    assert toxicity.fit(make(rows), labels, limit=20, total=2000) is not None
    assert quality.train(make(rows), labels, limit=20) is not None
