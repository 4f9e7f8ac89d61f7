import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from vitalake.llm.queries import table  # noqa: E402

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that operators use inside; documents may have columns of these names too.
CLASHING = ("doc", "sig", "block", "bucket", "row", "keys", "slice", "component", "kept", "n_words", "spans", "score", "_hit")


@pytest.fixture(scope="module")
def make(spark):
    """Documents from (doc_id, text) pairs, with further columns of clashing names."""

    def build(pairs, clashing=True, parts=3):
        df = spark.createDataFrame([(i, t, None, "s", None) for i, t in pairs], SCHEMA)
        if clashing:
            df = df.withColumns({c: F.lit("x") for c in CLASHING})
        return df.repartition(parts) if pairs else df

    return build


@pytest.fixture(scope="module")
def small(spark):
    """The smallest given documents as a frame, and as a dict of texts."""
    df = table(spark, SMALL, "documents")
    return df, {r.doc_id: r.text or "" for r in df.select("doc_id", "text").collect()}


def by_id(df, *columns):
    return {r[0]: tuple(r)[1:] for r in df.select("doc_id", *columns).collect()}


#: Null id, null and empty text, white space only, repeated rows, one id with two texts.
ODD = [
    (None, "alone " * 3), (1, None), (2, ""), (3, " \n\t "), (4, "same text here"), (4, "same text here"), (5, "one"), (5, "two"),
    (None, None), (6, "é ü ñ — ✓ \x85   x"), (7, "x" * 5000), (8, "a b c d e f g h i j k l m n o p q r s t u v w x y z"),
]
