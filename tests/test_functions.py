import hashlib
import json

from conftest import rows
from pyspark.sql import functions as F

from vitalake.functions import arrays, values
from vitalake.functions.ids import stable_id, stable_ids


def md5_id(text):
    return int(hashlib.md5(text.encode()).hexdigest()[:15], 16)


def test_stable_id_is_md5_and_null_safe(spark):
    df = spark.createDataFrame([("a", "b"), ("a", None), ("a", ""), (None, None)], "x string, y string")
    got = df.select(stable_id("x").alias("i"), stable_id("x", "y").alias("j")).collect()
    assert [r.i for r in got[:3]] == [md5_id("a")] * 3 and got[3].i is None
    assert got[0].j == md5_id("1:a1:b")
    assert len({r.j for r in got}) == 4
    # No sign in a value makes two lists of values alike.
    odd = [("a\x1fb", "c"), ("a", "b\x1fc"), (None, "x"), ("\x01", "x"), ("-", "x"), ("1:a", ""), ("1", ":a"), ("", "1:a")]
    ids = spark.createDataFrame(odd, "x string, y string").select(stable_id("x", "y").alias("j")).collect()
    assert len({r.j for r in ids}) == len(odd)


def test_missing_value_rules(spark):
    df = spark.createDataFrame([("x",), ("",), ("None",), (None,)], "c string")
    assert [r.p for r in df.select(values.present("c").alias("p")).collect()] == [True, False, True, False]
    two = df.select(values.present("c", values.BLANK_OR_NONE).alias("p")).collect()
    assert [r.p for r in two] == [True, False, False, False]
    assert [r.c for r in values.null_tokens(df, ["c"]).collect()] == ["x", None, None, None]
    got = df.select(values.when_present("c", F.upper("c"), "-").alias("v")).collect()
    assert [r.v for r in got] == ["X", "-", "NONE", "-"]
    assert [r.c for r in values.fill_missing(df, {"c": ""}).collect()] == ["x", "", "None", ""]


def test_matcher_is_anchored(spark):
    df = spark.createDataFrame([("loki",), ("loki-2",), ("",), (None,), ("api\n",)], "s string")

    def kept(include=None, exclude=None):
        return rows(df.filter(values.matches("s", include, exclude)))

    assert kept(".+", "loki|grafana") == [("api\n",), ("loki-2",)]
    assert kept("lok.*") == [("loki",), ("loki-2",)]
    assert kept("loki|x") == [("loki",)]
    assert kept("(lo)?") == [("",), (None,)]
    assert kept(None, "lok.*") == [("",), ("api\n",), (None,)]
    assert kept(None, "(loki)?") == [("api\n",), ("loki-2",)]
    assert len(kept()) == 5


def test_words_equal_their_regular_expression(spark):
    lines = ["ERRor", "wArn", "Warning!", "xpanicx", "fat al", "", "EXCEPTION", "pan\u0130c", "err\nor"]
    df = spark.createDataFrame([(x,) for x in lines] + [(None,)], "line string")
    for words in (values.ERROR_WORDS, values.WARN_WORDS, values.FATAL_WORDS):
        pattern = "(?i)(" + "|".join(words) + ")"
        got = df.select(values.line_holds("line", words).alias("w"), values.line_holds("line", pattern).alias("r"))
        assert all(r.w == r.r for r in got.collect())


def test_severity_overlaps(spark):
    df = spark.createDataFrame([("ERROR",), ("warn: panic",), ("ok",), ("Fatal",)], "line string")
    got = df.select(*[c.alias(n) for n, c in values.severity_flags("line").items()]).collect()
    assert [tuple(r) for r in got] == [
        (True, False, False),
        (True, True, True),
        (False, False, False),
        (True, False, True),
    ]


def test_bands_and_labels(spark):
    df = spark.createDataFrame([(None,), (0.0,), (1.0,), (9.9,), (10.0,)], "v double")
    got = [r.b for r in df.select(values.band("v", values.OVERVIEW_ERROR_STEPS).alias("b")).collect()]
    assert got == ["green", "green", "orange", "orange", "red"]
    label = spark.sql("select timestamp'2026-06-17 03:00:00' as t").select(values.utc_label("t")).first()[0]
    assert label == "2026-06-17T03-00-00Z"


def test_arrays_and_json(spark):
    df = spark.createDataFrame(
        [("flu", 'a "b"', ["x", 'q"']), ("None", "", []), ("", None, None)],
        "d string, s string, a array<string>",
    )
    got = df.select(
        arrays.condition_entries("d", F.lit(7).cast("bigint"), "s").alias("j"),
        arrays.json_array("a").alias("t"),
        arrays.single_or_empty("d", "d").alias("o"),
        stable_ids("a").alias("ids"),
    ).collect()
    assert json.loads(got[0].j) == [{"id": 7, "severity": 'a "b"'}]
    assert got[1].j == "[]" and got[2].j == "[]"
    assert json.loads(got[0].t) == ["x", 'q"'] and got[1].t == "[]" and got[2].t == "[]"
    assert [r.o for r in got] == [["flu"], [], []]
    assert got[0].ids == [md5_id("x"), md5_id('q"')]


def test_null_severity_is_written(spark):
    df = spark.createDataFrame([("flu", "None")], "d string, s string")
    got = df.select(arrays.condition_entries("d", F.lit(1).cast("bigint"), "s").alias("j")).first().j
    assert got == '[{"id":1,"severity":null}]'
