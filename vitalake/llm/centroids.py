"""Centroid clustering; the nearest centroid is found by the threshold algorithm.

The centroids are kept as one list per dimension, sorted by that component. A vector enters each list at its own
value and walks outward, one centroid of each list at a time; the exact distance of a centroid is taken when it is
first met. No centroid that was not met yet can be nearer than the sum of the squared distances to the frontiers,
so the walk ends when that sum strictly exceeds the best distance: an equal one might belong to a smaller number.

All is in integers and exact. Vectors are quantised once, into a table; a round reads it, sums in each task, and
sends one row per task, cluster and dimension through the shuffle. Only centroids pass through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalake.llm.blocks import scratch

CENTROIDS, ROUNDS, SIZE, SCALE, SEED = 40, 5, 64, 256, "2:"
#: Bound of a component's size: the squared distance of 64 differences below FAR fits 64 bits.
LIMIT, FAR = 1 << 27, 1 << 28
#: Vectors that walk together.
TOGETHER = 512


class SortedLists:
    """Centroids, and for each dimension their numbers in order of the component."""

    def __init__(self, centroids: np.ndarray):
        self.centroids = centroids
        self.numbers = np.argsort(centroids, axis=0, kind="stable")
        edge = np.full((1, centroids.shape[1]), 2 * FAR)
        #: Row i + 1 holds the i-th components; the rows around them stand for the ends of the lists.
        self.values = np.concatenate([-edge, np.take_along_axis(centroids, self.numbers, 0), edge])

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number and squared distance of each vector's nearest centroid; of equal ones the smallest number."""
        n, k = len(vectors), len(self.centroids)
        dims = np.arange(vectors.shape[1])
        right = np.empty(vectors.shape, np.int64)
        for d in dims:
            right[:, d] = np.searchsorted(self.values[1:-1, d], vectors[:, d])
        left = right - 1
        best, number = np.full(n, np.iinfo(np.int64).max), np.full(n, k)
        met = np.zeros((n, k), bool)
        at = np.arange(n)
        below, above = self._frontier(vectors, left, right, dims)
        while len(at):
            back = below <= above
            taken = self.numbers[np.where(back, left, right), dims]
            left, right = left - back, right + ~back
            new = np.zeros((len(at), k), bool)
            np.put_along_axis(new, taken, True, axis=1)
            new &= ~met[at]
            met[at] |= new
            row, c = np.nonzero(new)
            distance = np.full((len(at), k), np.iinfo(np.int64).max)
            distance[row, c] = ((vectors[row] - self.centroids[c]) ** 2).sum(axis=1)
            least = distance.argmin(axis=1)
            found = np.take_along_axis(distance, least[:, None], 1)[:, 0]
            better = (found < best[at]) | ((found == best[at]) & (least < number[at]))
            best[at[better]], number[at[better]] = found[better], least[better]
            below, above = self._frontier(vectors, left, right, dims)
            on = (np.minimum(below, above) ** 2).sum(axis=1) <= best[at]
            at, vectors, left, right, below, above = (x[on] for x in (at, vectors, left, right, below, above))
        return number, best

    def _frontier(self, vectors: np.ndarray, left: np.ndarray, right: np.ndarray, dims: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How far the next centroids below and above are, in each dimension; FAR where there is none."""
        return np.minimum(vectors - self.values[left + 1, dims], FAR), np.minimum(self.values[right + 1, dims] - vectors, FAR)


def _walks(batches: Iterator[pa.RecordBatch], lists: SortedLists) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of rows with their vectors, nearest centroids and distances."""
    size = lists.centroids.shape[1]
    for batch in batches:
        for low in range(0, batch.num_rows, TOGETHER):
            rows = batch.slice(low, TOGETHER)
            vectors = rows.column("v").flatten().to_numpy().astype(np.int64).reshape(-1, size)
            yield rows, vectors, *lists.nearest(vectors)


def quantised(vectors: DataFrame, column: str = "embedding", size: int = SIZE, scale: int = SCALE) -> DataFrame:
    """(vec_id, v): integers floor(scale * x) of the vectors that have `size` components, none null or non-finite.

    A component beyond 2**27 after scaling raises an error: distances would not fit a long.
    """
    x = F.col(column)
    usable = (F.size(x) == size) & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    scaled = F.transform(x, lambda c: F.floor(F.lit(float(scale)) * c.cast("double")))
    fits = F.forall(x, lambda c: F.abs(c.cast("double")) < float(LIMIT // scale))
    value = F.when(fits, scaled).otherwise(F.raise_error(F.lit(f"a component beyond {LIMIT // scale} has no exact distance")))
    return vectors.filter(F.coalesce(usable, F.lit(False))).select("vec_id", value.cast("array<int>").alias("v"))


def _moved(rows: DataFrame, centroids: np.ndarray) -> np.ndarray:
    """The floors of the means of each centroid's vectors; a centroid without vectors stays."""
    k, size = centroids.shape

    def sums(batches):
        total, count, lists = np.zeros((k, size), np.int64), np.zeros(k, np.int64), SortedLists(centroids)
        for _, vectors, number, _ in _walks(batches, lists):
            count += np.bincount(number, minlength=k)
            order = np.argsort(number, kind="stable")
            names, starts = np.unique(number[order], return_index=True)
            total[names] += np.add.reduceat(vectors[order], starts, axis=0)
        held = np.flatnonzero(count)
        columns = [np.repeat(held, size), np.tile(np.arange(size), len(held)), total[held].ravel(), np.repeat(count[held], size)]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["c", "d", "total", "n"])

    summed = rows.select("v").mapInArrow(sums, "c long, d long, total long, n long").groupBy("c", "d").agg(F.sum("total").alias("total"), F.sum("n").alias("n"))
    moved = centroids.copy()
    for r in summed.collect():  # one row per centroid and dimension
        moved[r.c, r.d] = r.total // r.n
    return moved


def cluster(vectors: DataFrame, centroids: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE, scale: int = SCALE, seed: str = SEED) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid): each usable vector with its nearest centroid.

    Centroids start as the vectors whose hash of seed and vec_id is least; equal hashes (repeated ids) go by
    components. After `rounds` rounds the vectors are assigned once more. centroid has the integers of the
    cluster's centroid, and inertias are sums of squared distances.

    Vectors of another size, null vectors and those with a null or non-finite component are left out, as the
    quantised space has no place for them; very large components raise an error (see `quantised`). A null id is
    hashed as an empty one. Repeated rows are vectors of their own. With fewer usable vectors than
    centroids, each starts as one; without any, the result has no rows. Further columns are ignored.
    """
    spark, folder = vectors.sparkSession, scratch(vectors.sparkSession)
    quantised(vectors, size=size, scale=scale).write.parquet(f"{folder}/vectors")
    rows = spark.read.schema("vec_id long, v array<int>").parquet(f"{folder}/vectors")
    order = F.sha2(F.concat(F.lit(seed), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))).cast("binary"), 256)
    first = rows.orderBy(order, "v").limit(centroids).collect()
    at = np.array([r.v for r in first], np.int64).reshape(-1, size)
    for _ in range(rounds if len(at) else 0):
        at = _moved(rows, at)

    def assigned(batches):
        for part, _, number, distance in _walks(batches, SortedLists(at)):
            columns = [part.column("vec_id"), pa.array(number, pa.int32()), pa.array(distance, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["vec_id", "cluster", "distance"])

    fields = "vec_id long, cluster int, distance long"
    rows.mapInArrow(assigned, fields).write.parquet(f"{folder}/assigned")
    found = spark.read.schema(fields).parquet(f"{folder}/assigned")
    sums = {r.cluster: r.s for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # one row per centroid
    each = [(c, s, sum(sums.values()), at[c].tolist()) for c, s in sums.items()]
    facts = spark.createDataFrame(each, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid")


def digest(found: DataFrame) -> DataFrame:
    """Centroids as hashes of their components."""
    listed = F.array_join(F.transform("centroid", lambda c: c.cast("string")), ",")
    return found.withColumn("centroid", F.sha2(listed.cast("binary"), 256)).withColumnRenamed("centroid", "centroid_sha256")


def _sql(centroids: int = CENTROIDS, rounds: int = ROUNDS, size: int = SIZE) -> str:
    """The same rounds in SQL, as one chain of tables."""
    distance = f"list_sum(list_transform(range(1, {size + 1}), lambda i: (k.v[i] - c.v[i]) * (k.v[i] - c.v[i])))"
    steps = []
    for i in range(rounds + 1):
        steps.append(f"""
a{i} AS MATERIALIZED (
  SELECT k.vec_id, k.v, c.c, {distance} AS d FROM kept k, c{i} c
  QUALIFY row_number() OVER (PARTITION BY k.vec_id ORDER BY d, c.c) = 1
)""")
        if i < rounds:
            steps.append(f"""
s{i} AS MATERIALIZED (SELECT c, i, CAST(sum(v[i]) AS BIGINT) AS s, count(*) AS n FROM a{i}, range(1, {size + 1}) t(i) GROUP BY c, i),
m{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(m.v, c.v) AS v FROM c{i} c LEFT JOIN m{i} m ON c.c = m.c)""")
    return f"""
WITH kept AS MATERIALIZED (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE len(embedding) = {size} AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = {size}
), c0 AS MATERIALIZED (
  SELECT CAST(row_number() OVER (ORDER BY sha256('{SEED}' || vec_id)) - 1 AS INTEGER) AS c, v FROM kept ORDER BY c LIMIT {centroids}
), {','.join(steps)}
SELECT a.vec_id, a.c AS cluster, CAST(a.d AS BIGINT) AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia,
       CAST(sum(a.d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} c ON a.c = c.c
"""


SQL = _sql()
