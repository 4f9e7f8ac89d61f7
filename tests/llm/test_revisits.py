"""WARC revisits: the query against its SQL, and single cases."""

import random

from oracle import compare, connect
from pyspark.sql import functions as F

from vitalake.llm import revisits
from vitalake.llm.queries import QUERIES, SQL

SCHEMA = "record_id string, type string, url string, ts long, status int, headers string, payload string"


def test_query(spark):
    folder = "/root/testdata/sf0.01"
    assert compare(spark, connect(folder), QUERIES["op3_warc_revisits"], SQL["op3_warc_revisits"], folder) == ""


def resolved(spark, rows):
    got = revisits.resolve(spark.createDataFrame(rows, SCHEMA).withColumn("page", F.lit("x")).withColumn("slice", F.lit(1)))
    return {r.record_id: r for r in got.collect()}


def test_cases(spark):
    full = "ETag: W/\"a\"\r\nContent-Length: 5\r\nX-Old: 1\r\nbroken line\r\nX-Two: p\r\nx-two: q"
    rows = [
        ("r1", "response", "http://www.A.com:80/x/", 1, 200, full, "first"),
        ("e", "response", "https://a.com/x", 2, 500, None, "error"),
        ("v1", "revisit", "https://a.com/x?utm_a=1#f", 3, 304, 'etag: "a"\nContent-Length: 0\nX-New: 2', None),
        ("v2", "revisit", "https://a.com/x", 3, 304, 'ETag: "b"', None),
        ("v3", "revisit", "https://a.com/x", 3, 304, None, None),
        ("v0", "revisit", "https://a.com/x", 0, 304, 'ETag: "a"', None),
        ("v4", "revisit", None, 3, 304, None, None),
        ("v5", "revisit", "not a url", 3, 304, None, None),
        ("v6", "revisit", "https://a.com/x", None, 304, None, None),
        ("p", "response", "http://b.org/?b=2&a=1", 5, 200, None, ""),
        ("v7", "revisit", "http://b.org?a=1&b=2", 5, 304, None, None),
        ("w", "revisit", "http://b.org?a=1&b=2", 5, 304, "Last-Modified: x", None),
        (None, "response", "http://c.org/", 1, 200, None, "c"),
        ("v8", "revisit", "http://c.org/", 2, 304, None, None),
    ]
    got = resolved(spark, rows)
    assert got["v1"].payload == "first" and got["v1"].refers_to == "r1"
    assert got["v1"].headers == {"etag": '"a"', "content-length": "5", "x-old": "1", "x-two": "p, q", "x-new": "2"}
    assert (got["v2"].outcome, got["v2"].refers_to, got["v2"].payload) == ("changed", "r1", None)
    assert got["v3"].outcome == "unverified" and got["w"].outcome == "changed"
    assert {k for k, r in got.items() if r.outcome == "missing"} == {"v0", "v4", "v5", "v6", "v8"}
    assert got["v7"].outcome == "resolved" and got["v7"].payload == ""  # p sorts before v7
    assert got["e"].outcome == "response" and got["e"].payload == "error"


def test_slices_do_not_show(spark, monkeypatch):
    pick = random.Random(1)
    rows = []
    for i in range(400):
        url, kind = f"http://h{pick.choice([0, 0, 0, 1, 2])}.org/", pick.choice(["response", "revisit", "revisit"])
        rows.append((f"{i:03}", kind, url, pick.randrange(60), 200 if pick.random() < 0.8 else 404, "ETag: a", f"p{i}" if kind == "response" else None))
    monkeypatch.setattr(revisits, "SLICE_ROWS", 20)
    got = resolved(spark, rows)
    assert len(got) == len(rows)
    for name, kind, url, ts, _, _, _ in rows:
        if kind == "revisit":
            earlier = [(r[3], r[0], r[6]) for r in rows if r[1] == "response" and r[4] == 200 and r[2] == url and (r[3], r[0]) < (ts, name)]
            assert got[name].payload == (max(earlier)[2] if earlier else None)


def test_empty(spark):
    assert revisits.resolve(spark.createDataFrame([], SCHEMA)).count() == 0
