from datetime import timedelta

import pytest
from conftest import LOAD_TS, rows
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vitalake.functions.ids import stable_id
from vitalake.operators import clean, dims, lookups, merge
from vitalake.operators.occurrences import occurrence_id


def test_strict_cast_skips_and_counts(spark):
    df = spark.createDataFrame(
        [("a", "70", "1.5"), ("b", "70.0", "1"), ("c", None, None), ("d", " 8 ", "nan"), ("e", "1", "1.5f"),
         ("f", "x", "2"), ("g", "1", "inf"), ("h", "2", "0x1p3")],
        "n string, i string, f string",
    )
    good, skipped = clean.strict_cast(df, {"i": "bigint", "f": "double"})
    assert [r.n for r in good.orderBy("n").collect()] == ["a", "c", "d", "g"]
    assert tuple(good.filter("n = 'c'").first()) == ("c", 0, 0.0)
    assert sorted(r.n for r in skipped.collect()) == ["b", "e", "f", "h"]
    assert skipped.filter("n = 'b'").first().i == "70.0"


def test_unsigned_range(spark):
    df = spark.createDataFrame([("255",), ("256",), ("-1",)], "a string")
    assert rows(clean.strict_cast(df, {"a": "UInt8"})[0]) == [(255,)]


def test_rename_enum_delete_tag_stamp(spark):
    df = spark.createDataFrame([(1, "A", "z"), (2, None, "z"), (3, "X", "z")], "`x (y)` int, e string, junk string")
    named = clean.rename_map(df, {"x (y)": "x", "e": "e", "absent": "q"})
    assert named.columns == ["x", "e"]
    ok, bad = clean.check_enum(named, "e", ["A", "B"])
    assert rows(ok, "x") == [(1,), (2,)] and rows(bad, "x") == [(3,)]
    with pytest.raises(Exception, match="value not allowed: X"):
        named.select(clean.require_enum("e", ["A"])).collect()
    assert rows(clean.delete_where(named, F.col("e") == "X"), "x") == [(1,), (2,)]
    tagged = clean.stamp(clean.tag(named, source="api", at=F.lit(None).cast("timestamp")), LOAD_TS).first()
    assert tagged.source == "api" and tagged.at is None and tagged.created_at == tagged.updated_at


def test_dims(spark):
    df = spark.createDataFrame([("a",), ("",), ("None",), ("b",), ("a",), (None,)], "c string")
    assert rows(dims.build_dim(df, "c", load_ts=LOAD_TS), "name") == [("None",), ("a",), ("b",)]
    two = dims.build_dim_union([(df, "c"), (spark.createDataFrame([("z",), ("a",)], "d string"), "d")], ("", "None"))
    assert rows(two, "name") == [("a",), ("b",), ("z",)]
    arr = spark.createDataFrame([(["x", ""], ["y"]), (None, ["x"])], "p array<string>, s array<string>")
    assert rows(dims.build_dim_arrays(arr, ["p", "s"]), "name") == [("x",), ("y",)]


def test_upsert_dim_keeps_ids(spark):
    old_ts = LOAD_TS - timedelta(days=1)
    existing = spark.createDataFrame([(7, "a", old_ts, old_ts), (8, "gone", old_ts, old_ts)], dims.DIM_SCHEMA)
    names = spark.createDataFrame([("a",), ("b",), ("a",)], "name string")
    got = {r.name: r for r in dims.upsert_dim(existing, names, LOAD_TS).collect()}
    assert got["a"].id == 7 and got["a"].created_at < got["a"].updated_at
    assert got["gone"].updated_at == got["gone"].created_at
    assert got["b"].id == spark.range(1).select(stable_id(F.lit("b"))).first()[0]


def test_id_collisions(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c"), (2, "c")], "id long, name string")
    assert rows(dims.id_collisions(df)) == [(1, 2)]


def test_occurrence_ids_do_not_depend_on_partitions(spark):
    df = spark.createDataFrame([(1, "x")] * 25 + [(2, None)] * 3 + [(2, "")], "a int, b string")
    expected = None
    for parts in (3, 7):
        got = occurrence_id(df.repartition(parts), "csv", block=4)
        assert rows(got, "a", "b") == rows(df)
        ids = rows(got, "id")
        assert len(set(ids)) == 29
        assert expected in (None, ids)
        expected = ids
    assert not set(expected) & set(rows(occurrence_id(df, "api"), "id"))


def test_latest_by_key(spark):
    df = spark.createDataFrame(
        [(1, 10, 1, "a"), (1, 10, 2, "b"), (1, 9, 9, "c"), (2, 1, 1, "d"), (None, 1, 1, "e"), (None, 1, 2, None)],
        "k int, v int, s int, x string",
    )
    assert rows(merge.latest_by_key(df, ["k"], "v", "s")) == [(1, 10, 2, "b"), (2, 1, 1, "d"), (None, 1, 2, None)]
    assert rows(merge.first_by_key(df, ["k"], "s"), "k", "x") == [(1, "a"), (2, "d"), (None, "e")]


def test_latest_by_key_combines_before_the_shuffle(spark):
    df = spark.range(1000).select((F.col("id") % 2).alias("k"), F.col("id").alias("v"))
    plan = merge.latest_by_key(df, ["k"], "v")._jdf.queryExecution().executedPlan().toString()
    assert "partial_max" in plan and "Window" not in plan


TARGET = "name string, id long, v int, created_at timestamp, updated_at timestamp"


def test_upsert(spark):
    old = LOAD_TS - timedelta(days=1)
    target = spark.createDataFrame([("a", 1, 1, old, old), ("b", 2, 2, old, old), (None, 3, 3, old, old)], TARGET)
    source = spark.createDataFrame(
        [("a", 91, 10, 1), ("a", 92, None, 2), ("c", 93, 30, 1), (None, 94, 40, 1), (None, 95, 50, 2)],
        "name string, id long, v int, seq int",
    )
    got = merge.upsert(target, source, ["name"], "seq", LOAD_TS, keep=("id", "created_at"))
    assert got.columns == target.columns
    assert rows(got, "name", "id", "v") == sorted(
        [("a", 1, None), ("b", 2, 2), ("c", 93, 30), (None, 3, 3), (None, 94, 40), (None, 95, 50)], key=repr
    )
    by_name = {r.name: r for r in got.collect() if r.name}
    assert by_name["a"].created_at < by_name["a"].updated_at == by_name["c"].updated_at
    assert by_name["b"].updated_at == by_name["b"].created_at == by_name["a"].created_at


keys = st.lists(st.tuples(st.sampled_from([None, "a", "b", "c"]), st.integers(0, 5)), max_size=12)


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(batch=keys)
def test_upsert_twice_is_upsert_once(spark, batch):
    schema = "name string, v int, seq int"
    target = spark.createDataFrame([("a", 100)], "name string, v int")
    source = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(batch) if k], schema)
    once = merge.upsert(target, source, ["name"], "seq")
    shuffled = source.repartition(3)
    assert rows(merge.upsert(once, shuffled, ["name"], "seq")) == rows(once)
    expected = {"a": 100} | {k: v for k, v in batch if k}
    assert rows(once) == sorted(expected.items(), key=repr)


def test_insert_if_absent(spark):
    target = spark.createDataFrame([(1, "old"), (1, "old2")], "k int, x string")
    source = spark.createDataFrame([(1, "n", 1), (2, "b", 2), (2, "a", 1), (None, "z", 1), (None, "y", 1)],
                                   "k int, x string, seq int")
    got = merge.insert_if_absent(target, source, ["k"], "seq")
    assert rows(got) == sorted([(1, "old"), (1, "old2"), (2, "a"), (None, "z"), (None, "y")], key=repr)


def test_lookups(spark):
    dim = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    df = spark.createDataFrame([("r1", "a", ["b", "", "a", "b"]), ("r2", None, []), ("r3", "q", None)],
                               "r string, c string, arr array<string>")
    assert rows(lookups.lookup(df, dim, "c", "cid"), "r", "cid") == [("r1", 1), ("r2", None), ("r3", None)]
    with pytest.raises(Exception, match="no dimension row for q"):
        lookups.lookup_strict(df.filter("r = 'r3'"), dim, "c", "cid").collect()
    assert rows(lookups.lookup_strict(df.filter("r = 'r1'"), dim, "c", "cid"), "cid") == [(1,)]
    assert rows(lookups.lookup_misses(df, dim, "c")) == [("q", 1), (None, 1)]
    got = {r.r: r.ids for r in lookups.lookup_array(df, dim, "arr", "ids", ["r"]).collect()}
    assert got == {"r1": [2, 1, 2], "r2": [], "r3": []}
    new = lookups.lookup_or_new(df, dim, "c", "cid").filter("r = 'r3'").first().cid
    assert new == spark.range(1).select(stable_id(F.lit("q"))).first()[0]


def test_lookup_is_the_same_without_broadcast(spark):
    dim = spark.range(50).select("id", F.concat(F.lit("n"), "id").alias("name"))
    hot = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "n7").otherwise(F.concat(F.lit("n"), F.col("id") % 60)).alias("c"))
    small = rows(lookups.lookup(hot, dim, "c", "d"), "id", "d")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert rows(lookups.lookup(hot, dim, "c", "d"), "id", "d") == small
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_scalar_and_orphans(spark):
    parent = spark.createDataFrame([(5, "yoga"), (6, "run"), (6, "twice"), (7, "twice")], "id long, name string")
    df = spark.range(1).select(
        lookups.scalar(parent, F.col("name") == "yoga").alias("y"),
        lookups.scalar(parent, F.col("name") == "none").alias("n"),
    )
    assert tuple(df.first()) == (5, None)
    with pytest.raises(Exception):
        spark.range(1).select(lookups.scalar(parent, F.col("name") == "twice")).collect()
    fact = spark.createDataFrame([(5, [5, 9]), (9, [6]), (9, [])], "fk long, fks array<long>")
    assert rows(lookups.orphans(fact, parent, "fk"), "fk") == [(9,), (9,)]
    assert rows(lookups.orphan_keys(fact, parent, "fk")) == [(9, 2)]
    assert rows(lookups.orphan_keys(fact, parent, "fks")) == [(9, 1)]


def test_unions_and_split(spark):
    a, b = spark.createDataFrame([(1,), (1,)], "x int"), spark.createDataFrame([(1,), (2,)], "x int")
    assert rows(merge.union_tagged({"a": a, "b": b})) == [(1, "a"), (1, "a"), (1, "b"), (2, "b")]
    assert rows(merge.union_distinct([a, b])) == [(1,), (2,)]
    parts = merge.split_entities(b, {"p": ["x"], "q": [(F.col("x") * 2).alias("y")]})
    assert rows(parts["q"]) == [(2,), (4,)]
