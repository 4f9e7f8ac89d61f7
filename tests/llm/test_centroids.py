"""Centroid clustering against plain distances."""

import hashlib
import math

import numpy as np
import pytest

from llm.conftest import SMALL
from vitalake.llm import centroids
from vitalake.llm.queries import table

FIELDS = "vec_id long, embedding array<float>, cluster string, distance string, v string"


def usable(x):
    return x is not None and len(x) == 64 and all(c is not None and math.isfinite(c) for c in x)


def plain(rows, k=40, rounds=5):
    """rows: (vec_id, components); (vec_id, cluster, distance, cluster_inertia, inertia, hash) of each usable one."""
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in x]) for i, x in rows if usable(x)]
    name = lambda r: (hashlib.sha256(f"2:{'' if r[0] is None else r[0]}".encode()).hexdigest(), r[1])
    at = [v for _, v in sorted(kept, key=name)[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(at))

    for _ in range(rounds):
        groups = {}
        for _, v in kept:
            groups.setdefault(nearest(v)[1], []).append(v)
        at = [[sum(x) // len(groups[i]) for x in zip(*groups[i], strict=True)] if i in groups else c for i, c in enumerate(at)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    sums = {}
    for _, c, d in found:
        sums[c] = sums.get(c, 0) + d
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in at]
    return sorted(((i, c, d, sums[c], sum(sums.values()), shas[c]) for i, c, d in found), key=repr)


def clustered(df, **options):
    return sorted((tuple(r) for r in centroids.digest(centroids.cluster(df, **options)).collect()), key=repr)


def test_given_vectors(spark):
    df = table(spark, SMALL, "embeddings").limit(150)
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    assert clustered(df) == plain(rows)


@pytest.mark.parametrize(("seed", "k", "high"), [(1, 40, 3), (2, 7, 2), (3, 1, 1000), (4, 40, 1 << 26)])
def test_nearest_with_ties(seed, k, high):
    pick = np.random.default_rng(seed)
    at = pick.integers(-high, high, (k, 64))
    at[k // 2] = at[0]  # the smaller number wins
    vectors = np.concatenate([pick.integers(-high, high, (300, 64)), at])
    number, distance = centroids.SortedLists(at).nearest(vectors)
    exact = ((vectors[:, None] - at[None]) ** 2).sum(axis=2)
    assert (number == exact.argmin(axis=1)).all() and (distance == exact.min(axis=1)).all()


def test_walk_stops_early():
    """Few centroids are met when one is near and the others are far in every dimension."""
    at = np.arange(40)[:, None] * 1000 + np.zeros((1, 64), np.int64)
    met = []
    real = centroids.np.put_along_axis
    lists = centroids.SortedLists(at)
    try:
        centroids.np.put_along_axis = lambda a, i, v, axis: (met.append(len(np.unique(i))), real(a, i, v, axis))[1]
        number, _ = lists.nearest(np.full((1, 64), 20_001))
    finally:
        centroids.np.put_along_axis = real
    assert number.tolist() == [20] and sum(met) == 1


def test_odd_vectors(spark):
    base = [float(i % 5) / 4 for i in range(64)]
    rows = [
        (1, base), (1, base), (1, [-x for x in base]), (None, base), (2, None), (3, []), (4, base[:-1]), (5, [*base[:-1], None]), (6, [*base[:-1], float("nan")]),
        (7, [*base[:-1], float("inf")]), (8, [*base, 1.0]), (9, [-0.001] * 64), (10, [0.0] * 64), (11, [-0.0] * 64), (12, [500.0] * 64),
    ]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], FIELDS)
    assert clustered(df) == plain(rows)
    assert clustered(df, centroids=3, rounds=2) == plain(rows, 3, 2)
    for none in (df.limit(0), df.filter("vec_id IN (2, 3)")):
        assert clustered(none) == []


def test_a_third_of_all_rows_alike(spark):
    pick = np.random.default_rng(8)
    rows = [(i, pick.random(64).round(2).tolist()) for i in range(100)]
    rows += [(1000 + i, rows[0][1]) for i in range(50)]
    df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], FIELDS).repartition(7)
    assert clustered(df) == plain(rows)


def test_huge_components_are_refused(spark):
    df = spark.createDataFrame([(1, [1e30] * 64, "x", "y", "z")], FIELDS)
    with pytest.raises(Exception, match="no exact distance"):
        centroids.cluster(df)
