"""The publication log, and tables kept as buckets."""

import json
import os
import random
import threading
from datetime import timedelta
from pathlib import Path

import pytest
from conftest import LOAD_TS, rows
from fixtures import write_folder
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vitalake.operators.merge import upsert
from vitalake.plans import runs
from vitalake.sources import buckets, publications, versions
from vitalake.sources.publications import Table, Version, VersionExists, VersionNotFound

SCHEMA = (
    T.StructType().add("key", "long").add("value", "string").add("created_at", "timestamp").add("updated_at", "timestamp")
)


def version(dataset, label):
    return Version(dataset, label, f"{dataset}/{label}", (Table("data"),))


def test_put_is_exclusive(spark, tmp_path):
    path = str(tmp_path / "log" / "1.json")
    assert publications.put_if_absent(spark, path, "one") and not publications.put_if_absent(spark, path, "two")
    assert Path(path).read_text() == "one" and os.listdir(tmp_path / "log") == ["1.json"]


def test_put_by_rename_is_exclusive(spark, tmp_path):
    target = spark._jvm.org.apache.hadoop.fs.Path(f"file://{tmp_path}/1.json")
    assert publications._renamed(spark, target, "one") and not publications._renamed(spark, target, "two")
    assert (tmp_path / "1.json").read_text() == "one"
    assert [f for f in os.listdir(tmp_path) if not f.endswith(".crc")] == ["1.json"]


def test_log(spark, tmp_path):
    root = str(tmp_path)
    with pytest.raises(VersionNotFound):
        publications.resolve(spark, root, "s/a")
    assert publications.publish(spark, root, [version("s/a", "1"), version("s/b", "1")]) == 1
    assert publications.publish(spark, root, [version("s/a", "0")]) == 2
    # The number decides, not the label.
    assert publications.resolve(spark, root, "s/a").label == "0" and publications.resolve(spark, root, "s/b").label == "1"
    assert publications.resolve(spark, root, "s/a", number=1).label == "1"
    assert set(publications.publication(spark, root, 1)) == {"s/a", "s/b"}
    with pytest.raises(VersionExists):
        publications.publish(spark, root, [version("s/b", "2"), version("s/a", "1")])
    with pytest.raises(VersionNotFound):
        publications.resolve(spark, root, "s/b", "2")  # of a refused entry nothing is published
    with pytest.raises(VersionExists):
        publications.publish(spark, root, [version("s/c", "1"), version("s/c", "1")])
    with pytest.raises(VersionNotFound):
        publications.publication(spark, root, 9)


def test_writers_side_by_side(spark, tmp_path):
    """Two threads publish the same label: one is refused. Others lose nothing."""
    root, done, refused = str(tmp_path), [], []

    def writer(dataset, label, n):
        try:
            versions.write_tables({"data": spark.range(n)}, root, "s", dataset, label)
            done.append((dataset, label, n))
        except VersionExists:
            refused.append((dataset, label, n))

    jobs = [("a", "same", 3), ("a", "same", 5), *[("a", f"own-{i}", i) for i in range(4)], ("b", "same", 7)]
    threads = [threading.Thread(target=writer, args=j) for j in jobs]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(done) == 6 and len(refused) == 1 and refused[0][:2] == ("a", "same")
    for dataset, label, n in done:
        # What is published is what this writer wrote, whoever else wrote to the label.
        assert versions.read_version(spark, root, "s", dataset, label).count() == n
    numbers = [r.number for r in publications.entries(spark, root).select("number").collect()]
    assert sorted(numbers) == list(range(1, 7))


def test_a_failed_attempt_is_not_read(spark, tmp_path):
    root = str(tmp_path)

    def refuse(_):
        raise RuntimeError("no")

    with pytest.raises(RuntimeError):
        versions.write_tables({"data": spark.range(9)}, root, "s", "a", "1", check=refuse)
    with pytest.raises(VersionNotFound):
        versions.read_version(spark, root, "s", "a")
    versions.write_tables({"data": spark.range(2)}, root, "s", "a", "1")
    assert versions.read_version(spark, root, "s", "a").count() == 2


def stored(path):
    return {str(p.relative_to(path)): p.stat().st_mtime_ns for p in path.rglob("*.parquet")}


def frame(spark, pairs):
    return spark.createDataFrame(pairs, "key long, value string")


def load(spark, root, label, pairs, keep=20, day=0):
    """One load of (key, value) rows into the table kv, published."""
    try:
        old = versions.resolve(spark, root, "s", "kv")
    except VersionNotFound:
        old = None
    folder = publications.claim(spark, root, "s/kv", label)
    merged = buckets.upsert_buckets(
        frame(spark, pairs), root, old, folder, "kv", ("key",), SCHEMA, keep, load_ts=LOAD_TS + timedelta(days=day)
    )
    versions.publish(spark, root, [Version("s/kv", label, folder, (merged.table,))])
    return old, versions.resolve(spark, root, "s", "kv"), merged.written.count()


def content(spark, root):
    return rows(versions.read_tables(spark, root, "s", "kv")["kv"])


def test_touched_buckets_only(spark, tmp_path):
    root = str(tmp_path)
    load(spark, root, "1", [(i, "old") for i in range(400)])
    before = stored(tmp_path / "s")
    old, new, written = load(spark, root, "2", [(7, "new"), (7, "newer"), (1000, "added")], day=1)
    assert old.table("kv").buckets == new.table("kv").buckets >= 16
    was, now = (buckets.bucket_folders(spark, root, v, "kv") for v in (old, new))
    moved = {b for b in now if now[b] != was.get(b)}
    assert 1 <= len(moved) <= 2 and set(now) == set(was) | moved
    # Files of the version before are as they were; the load wrote the rows of its buckets and no others.
    assert stored(tmp_path / "s").items() >= before.items()
    placed = frame(spark, [(i, "x") for i in [*range(400), 1000]]).select("key")
    placed = placed.select(buckets.bucket_of(placed, ("key",), new.table("kv").buckets)).collect()
    assert written == sum(b in moved for (b,) in placed)
    got = {r[0]: r[1:] for r in content(spark, root)}
    assert len(got) == 401 and got[7][0] == "newer" and got[1000][0] == "added" and got[8][0] == "old"
    assert got[7][1] < got[7][2] and got[1000][1] == got[1000][2] and got[8][1] == got[8][2]
    # The old version still reads as it did.
    assert versions.read_tables(spark, root, "s", "kv", "1")["kv"].filter("value <> 'old'").count() == 0


def bucket(spark, key, v):
    df = frame(spark, [(key, "x")]).select("key")
    return df.select(buckets.bucket_of(df, ("key",), v.table("kv").buckets)).first()[0]


def test_untouched_buckets_are_not_read(spark, tmp_path):
    root = str(tmp_path)
    load(spark, root, "1", [(i, "old") for i in range(400)])
    first = versions.resolve(spark, root, "s", "kv")
    folders = buckets.bucket_folders(spark, root, first, "kv")
    hit = bucket(spark, 7, first)
    for b, folder in folders.items():
        if b != hit:  # a read of any other bucket would fail
            for f in (tmp_path / folder).glob("part-*"):
                f.write_bytes(b"not parquet")
            for f in (tmp_path / folder).glob(".*.crc"):
                f.unlink()
    load(spark, root, "2", [(7, "new")])
    again = buckets.bucket_folders(spark, root, versions.resolve(spark, root, "s", "kv"), "kv")
    assert {b for b in again if again[b] != folders[b]} == {hit}


@pytest.mark.parametrize("seed", [1])
def test_many_loads_equal_one_table(spark, tmp_path, seed):
    """Loads of any size, with growing buckets, NULL keys and repeated keys, give what `upsert` of whole tables gives."""
    pick, root = random.Random(seed), str(tmp_path)
    target = spark.createDataFrame([], SCHEMA)
    sizes = []
    for n, size in enumerate([0, 60, 300, 20]):
        keys = [pick.choice([None, pick.randrange(400), pick.randrange(400), pick.randrange(400)]) for _ in range(size)]
        pairs = [(k, f"{n}.{i}") for i, k in enumerate(keys)]
        unique = {k: v for k, v in pairs if k is not None}
        pairs = [*unique.items(), *[(None, v) for k, v in pairs if k is None]]
        _, now, _ = load(spark, root, str(n), pairs, keep=10, day=n)
        whole = upsert(target, frame(spark, pairs), ["key"], load_ts=LOAD_TS + timedelta(days=n))
        target = spark.createDataFrame(whole.collect(), SCHEMA)
        assert content(spark, root) == rows(target)
        sizes.append(now.table("kv").buckets)
    assert sizes[0] == 1 and sizes[-1] >= 16


def test_a_plain_table_becomes_buckets(spark, tmp_path):
    root = str(tmp_path)
    plain = spark.createDataFrame([(i, "plain", LOAD_TS, LOAD_TS) for i in range(50)], SCHEMA)
    versions.write_tables({"kv": plain}, root, "s", "kv", "1")
    _, new, written = load(spark, root, "2", [(3, "new")], day=1)
    assert written == 50 and new.table("kv").buckets > 1
    assert [r[1] for r in content(spark, root) if r[0] in (3, 4)] == ["new", "plain"]


def test_serving_loads_touch_few_buckets(spark, tmp_path):
    folder, root = write_folder(tmp_path / "in"), str(tmp_path / "lake")
    runs.dump_external(spark, str(folder), root)
    for label, day in (("1", 0), ("2", 1)):
        runs.load_serving_dataset(spark, root, "food_item", LOAD_TS + timedelta(days=day), label, rows=1)
    one, two = (versions.resolve(spark, root, runs.SERVING, "food_item", n) for n in "12")
    a, b = (versions.tables_of(spark, root, v)["food_item"] for v in (one, two))
    assert two.table("food_item").buckets >= 4
    same = [c for c in a.columns if c != "updated_at"]
    assert rows(a, *same) == rows(b, *same)
    # Every food comes again, so every bucket is touched; a file with one food touches one.
    path = folder / "daily_food_nutrition_dataset.csv"
    path.write_text("\n".join(path.read_text().splitlines()[:1] + ["Egg,Dairy,78,6.3,0.6,5.3,0,0.6,62,186,Lunch,0"]) + "\n")
    runs.dump_external(spark, str(folder), root)
    runs.load_serving_dataset(spark, root, "food_item", LOAD_TS + timedelta(days=2), "3", rows=1)
    three = versions.resolve(spark, root, runs.SERVING, "food_item")
    was, now = (buckets.bucket_folders(spark, root, v, "food_item") for v in (two, three))
    assert len([x for x in now if now[x] != was.get(x)]) == 1
    egg = versions.tables_of(spark, root, three)["food_item"].filter("name = 'Egg'").first()
    assert egg.meal_type == "Lunch" and egg.created_at < egg.updated_at


@pytest.mark.parametrize("keep", [1000, 1])
def test_an_id_of_two_foods_stops_a_serving_load(spark, tmp_path, monkeypatch, keep):
    """Also where the other row lies in a bucket that the load does not touch."""
    folder, root = write_folder(tmp_path / "in"), str(tmp_path / "lake")
    runs.dump_external(spark, str(folder), root)
    runs.load_serving_dataset(spark, root, "food_item", LOAD_TS, "1", rows=keep)
    before = rows(versions.read_tables(spark, root, runs.SERVING, "food_item")["food_item"])
    path = folder / "daily_food_nutrition_dataset.csv"
    path.write_text(path.read_text().splitlines()[0] + "\nTofu,Dairy,78,6.3,0.6,5.3,0,0.6,62,186,Lunch,0\n")
    runs.dump_external(spark, str(folder), root)
    taken = next(r[0] for r in before if r[1] == "Egg")
    real = runs.serving.stable_id
    # A new name gets the id that another name has from an earlier load.
    monkeypatch.setattr("vitalake.plans.serving.stable_id", lambda c, *more: F.when(F.col(c) == "Tofu", F.lit(taken)).otherwise(real(c, *more)))
    with pytest.raises(runs.IdCollision, match="food_item"):
        runs.load_serving_dataset(spark, root, "food_item", LOAD_TS + timedelta(days=1), "2", rows=keep)
    assert rows(versions.read_tables(spark, root, runs.SERVING, "food_item")["food_item"]) == before


def test_datasets_are_published_together(spark, tmp_path):
    folder, root = write_folder(tmp_path / "in"), str(tmp_path / "lake")
    runs.dump_external(spark, str(folder), root)
    out = runs.load_warehouse(spark, root, LOAD_TS, "1", ["daily_food", "exercise_db"], together=True)
    assert out == {"daily_food": "1", "exercise_db": "1"}
    newest = json.loads(sorted((tmp_path / "lake" / "publications").glob("*.json"))[-1].read_text())
    assert {v["dataset"] for v in newest["versions"]} == {"warehouse/daily_food", "warehouse/exercise_db"}
    # One of two fails: neither is published.
    with pytest.raises(ValueError, match="unknown dataset"):
        runs.load_warehouse(spark, root, LOAD_TS, "2", ["exercise_db", "none"], together=True)
    assert versions.resolve(spark, root, runs.WAREHOUSE, "exercise_db").label == "1"
    number = publications.entries(spark, root).agg({"number": "max"}).first()[0]
    got = runs.load_serving(spark, root, LOAD_TS, "1", ["exercise", "diet"], together=True)
    assert got == {"exercise": {"skipped": 0}, "diet": {"skipped": 0}}
    assert set(publications.publication(spark, root, number + 1)) == {"serving/exercise", "serving/diet"}


def test_small_buckets_are_bounded(spark, tmp_path, monkeypatch):
    """A large table gets larger buckets before it gets more of them, and reads as before."""
    root = str(tmp_path)
    monkeypatch.setattr(buckets, "SMALL_BUCKETS", 4, raising=False)
    _, one, _ = load(spark, root, "1", [(i, "old") for i in range(400)], keep=2)
    assert one.table("kv").buckets == 4
    monkeypatch.setattr(buckets, "ROWS", 50)
    _, two, written = load(spark, root, "2", [(7, "new"), (1000, "added")], keep=2, day=1)
    assert two.table("kv").buckets == 8 and written == 401
    got = {r[0]: r[1] for r in content(spark, root)}
    assert len(got) == 401 and got[7] == "new" and got[1000] == "added" and got[8] == "old"
