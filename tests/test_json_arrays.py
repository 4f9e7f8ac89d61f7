"""JSON arrays read by byte range equal the same file read by one task."""

import json
import random

import pytest
from pyspark.sql import types as T

from vitalake.plans import queries
from vitalake.sources import readers

SCHEMA = T.StructType().add("id", "long").add("text", "string").add("more", T.MapType(T.StringType(), T.StringType())).add("list", T.ArrayType(T.StringType()))
SIGNS = ["{", "}", "[", "]", '"', "\\", ",", ":", "\n", "\t", " ", "é", "日本", "\\\\", '\\"', "},{", "x", "]}", "{[", " "]


def made(seed, n):
    pick = random.Random(seed)
    text = lambda most: "".join(pick.choices(SIGNS, k=pick.randint(0, most)))
    return [
        {"id": i, "text": text(40), "more": {text(3) + str(k): text(9) for k in range(pick.randint(0, 3))}, "list": [text(6) for _ in range(pick.randint(0, 3))]}
        for i in range(n)
    ]


@pytest.fixture
def ranges(spark):
    """Read files in ranges of so many bytes."""
    keys = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {k: spark.conf.get(k) for k in keys}
    yield lambda size: [spark.conf.set(k, str(size)) for k in keys]
    for k, v in before.items():
        spark.conf.set(k, v)


def read(spark, path):
    got = readers.read_json(spark, str(path), SCHEMA, seq=True).orderBy(readers.SEQ).collect()
    return [r.asDict(recursive=True) for r in got]


@pytest.mark.parametrize(("seed", "indent", "ascii"), [(1, None, True), (2, 2, False), (3, None, False)])
def test_equal_to_one_task(spark, tmp_path, ranges, seed, indent, ascii):
    objects, path = made(seed, 300), tmp_path / "a.json"
    path.write_text(json.dumps(objects, indent=indent, ensure_ascii=ascii), encoding="utf-8")
    whole = [r.asDict(recursive=True) for r in spark.read.option("multiLine", True).schema(SCHEMA).json(str(path)).collect()]
    assert whole == objects
    for parts in (64, 7, 1):
        ranges(-(-path.stat().st_size // parts))
        got = read(spark, path)
        blocks = {r.pop(readers.SEQ)["block"] for r in got}
        assert got == objects and (len(blocks) > parts // 2)


def test_objects_longer_than_a_range(spark, tmp_path, ranges):
    objects = [{"id": i, "text": "}{" * 50 if i % 2 else "a", "more": {"k" * 30: "}" * 40, "m": "{" * 90}, "list": ["}]"] * 20} for i in range(20)]
    path = tmp_path / "a.json"
    path.write_text(json.dumps(objects))
    for size in (3, 17, 64):
        ranges(size)
        got = read(spark, path)
        assert [{k: v for k, v in r.items() if k != readers.SEQ} for r in got] == objects


def test_several_files_and_forms(spark, tmp_path, ranges):
    folder = tmp_path / "in"
    folder.mkdir()
    objects = made(5, 40)
    (folder / "a.json").write_text("﻿ \n" + json.dumps(objects[:20]) + "\n\n", encoding="utf-8")
    (folder / "b.json").write_text("[]")
    (folder / "c.json").write_text("")
    (folder / "d.json").write_text(json.dumps(objects[20]))
    (folder / "e.json").write_text("[\n" + ",\n".join(json.dumps(o) for o in objects[21:30]) + "\n]\n")
    (folder / "f.json").write_text("\n".join(json.dumps([o]) for o in objects[30:]) + "\n[]")
    ranges(200)
    got = read(spark, folder)
    assert [r["id"] for r in got] == list(range(40)) and [r["text"] for r in got] == [o["text"] for o in objects]


def test_malformed_objects_are_kept(spark, tmp_path):
    path = tmp_path / "a.json"
    path.write_text('[{"id": 1}, {"id": "x"}, {"id": 3, "text": "cut o')
    got = readers.read_json(spark, str(path), SCHEMA, corrupt=True, seq=True).orderBy(readers.SEQ).collect()
    assert [(r.id, r[readers.CORRUPT]) for r in got][0] == (1, None)
    assert [r[readers.CORRUPT] for r in got][1:] == ['{"id": "x"}', '{"id": 3, "text": "cut o']


def test_the_ranges_of_the_query_grow_with_its_input(spark, tmp_path, monkeypatch):
    """The query reads its arrays in a bounded number of ranges, and the rows are the same in any number."""
    orders = [(i, i % 500, "1-URGENT" if i % 3 else "5-LOW", i / 4) for i in range(5000)]
    names = "o_orderkey long, o_custkey long, o_orderpriority string, o_totalprice double"
    spark.createDataFrame(orders, names).write.parquet(f"{tmp_path}/orders.parquet")
    seen, real = [], readers.read_json

    def watched(spark, path, schema, **options):
        found = real(spark, path, schema, **options)
        seen.append(spark.read.text(path).rdd.getNumPartitions())
        return found

    monkeypatch.setattr(readers, "read_json", watched)
    monkeypatch.setattr(queries, "_LEAST_RANGE", 512)
    got = []
    for ranges in (1000, 10):
        monkeypatch.setattr(queries, "_RANGES", ranges)
        got.append(sorted(tuple(r) for r in queries.run("json_array_split", spark, str(tmp_path)).collect()))
    assert got[0] == got[1] and len(got[0]) == 5000
    assert seen[1] < 30 < seen[0]
    assert queries.range_bytes(0) == 512 and queries.range_bytes(10**10) == 128 * 1024**2
