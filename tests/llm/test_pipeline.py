"""The pipeline stage by stage against brute force."""

import collections

import corpus_pipeline
from pyspark.sql import functions as F
from llm.conftest import ODD, SMALL
from llm.test_neardup import by_all_pairs
from llm.test_scans import base_spans, check_pieces, contaminated, counted, ids_of
from vitalake.llm.queries import table


def test_stages(spark, make, small):
    docs, texts = small
    labels = {r.doc_id: r.quality for r in table(spark, SMALL, "labels").collect()}
    items = [(r.item_id, r.text) for r in table(spark, SMALL, "benchmark").collect()]
    columns = docs.columns
    state = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SMALL)
        if name != "packing":
            assert docs.columns == columns
            before, state = state, {r.doc_id: r.text for r in docs.collect()}
        if name == "quality":
            assert all(not counted(t)[5] for t in state.values())
            good = [i for i in texts if not counted(texts[i])[5] and labels.get(i) == 1]
            assert len([i for i in good if i in state]) >= 0.95 * len(good)
        elif name == "near_dedup":
            assert set(state) == {i for i, v in by_all_pairs(before.items(), 5).items() if v[2]}
        elif name == "decontamination":
            hits = contaminated(before.items(), items)
            assert all(state[i] == before[i] for i in state if not hits[i][4])
            assert set(before) - set(state) == {i for i, v in hits.items() if v[4] and v[1] == v[0]}
        elif name == "secrets":
            assert not any(base_spans(t) for t in state.values()) and set(state) == set(before)
            assert all(state[i] == before[i] for i in state if not base_spans(before[i]))
    rows = list(state.items())
    check_pieces(docs.collect(), dict(zip([i for i, _ in rows], ids_of(rows), strict=True)))


def test_run_gives_all_pieces(spark):
    got = collections.Counter(r.doc_id for r in corpus_pipeline.run(spark, SMALL).select("doc_id").collect())
    assert got and corpus_pipeline.ORACLE_SQL is None


def test_stages_take_odd_rows(spark, make):
    for rows in (ODD, []):
        docs = make(rows)
        for name, stage in corpus_pipeline.STAGES:
            if name != "quality":
                stage(spark, docs, SMALL).collect()
        assert corpus_pipeline.good_quality(spark, docs, SMALL).count() == 0
    same = make([(4, "a b"), (4, "a b"), (5, "a  b"), (None, None), (None, "x y")])
    kept = sorted((r.doc_id or 0, r.text or "") for r in corpus_pipeline.one_of_each_group(spark, same, SMALL).collect())
    assert kept == [(0, ""), (0, "x y"), (4, "a b")]


NAMES = (
    "quality", "kept", "n_words", "spans", "base_spans", "clean_text", "contaminated", "_hit", "n_hit", "items", "base_failed", "document", "carried",
    "component_id", "first", "id", "h1", "least", "n_symbols", "a.b", "with space",
)


def test_stages_keep_columns_of_any_name(spark, make):
    """Further columns come out as they went in, also a map, whatever operators call theirs."""
    text = "A plain and quite long English text about the work of many hands. " * 8
    rows = [(1, text + "one"), (2, "something else " * 30), (3, text + "one"), (4, "token = 'abcdefgh12345678' and " + text), (5, "")]
    docs = make(rows).withColumns({c: F.concat(F.lit(f"{c}:"), "doc_id") for c in NAMES})
    docs = docs.withColumn("facts", F.create_map(F.lit("id"), F.col("doc_id")))
    given = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        got = out.collect()
        assert got or name == "quality"
        for r in got:
            same = given[1 if r.doc_id in (1, 3) and name == "near_dedup" else r.doc_id]
            assert [r[c] for c in (*NAMES, "kept", "facts", "lang")] == [same[c] for c in (*NAMES, "kept", "facts", "lang")], name
    assert {r.doc_id for r in corpus_pipeline.packed(spark, docs, SMALL).collect()} == set(given)


def test_a_third_of_all_rows_alike(spark, make):
    rows = [(i, f"text number {i} of its own words {i * 7}") for i in range(60)] + [(None, "the same text")] * 20 + [(7, None)] * 10
    kept = corpus_pipeline.one_of_each_group(spark, make(rows), SMALL).collect()
    assert len(kept) == 62 and sum(r.doc_id is None for r in kept) == 1


def test_documents_are_told_apart_by_id_and_text(spark, make):
    long = [f"w{i}" for i in range(100)]
    near = " ".join([*long[:-1], "x"])
    rows = [(None, near), (5, " ".join(long)), (None, "quite another text"), (None, "and a third"), (None, "and a third"),
            (7, "one id"), (7, "two texts"), (8, "TWO  texts"), (9, None), (9, ""), (None, None)]
    kept = collections.Counter((r.doc_id, r.text or "") for r in corpus_pipeline.one_of_each_group(spark, make(rows), SMALL).collect())
    want = [(None, near), (None, "quite another text"), (None, "and a third"), (7, "one id"), (7, "two texts"), (9, ""), (None, "")]
    assert kept == collections.Counter(want)
