"""Near-duplicate documents: SetSketch registers, banded; pairs estimated by likelihood, then verified on full sets.

A document's set is its distinct shingles. A register is the least of the set's hashes by one hash
function, taken as an exponential value and kept as the whole number of its logarithm to BASE, cut to
16 bits: registers of a union are the maxima of registers, and two sets agree in one about as often as
they overlap. Documents that agree in all registers of a band are candidates.

Equal sets are one node from the start. In a band's bucket members are paired with one centre, so a
bucket of g costs g pairs; the centres of a family differ from band to band, which joins it by chains.
Only buckets that then still hold several components are searched through, and of them only pairs across
components, each in the first band it shares.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitalake.llm.arrays import Fields, Rolling, U, Words, mixed, seeded, slices
from vitalake.llm.blocks import FIRST_ID, scratch
from vitalake.llm.components import components

REGISTERS, ROWS = 128, 4
BASE, RATE = 1.001, 20.0
TOP = (1 << 16) - 1
SCALES = seeded(REGISTERS, 11) | U(1)
#: Pairs whose likeliest similarity is this far below the threshold are not verified: over five times
#: the spread of an estimate from 128 registers.
SLACK = 0.2
#: Different orders by which bands choose their centres.
SALTS = 8
#: Members of a bucket that are searched through in one piece.
PIECE = 4096

SKETCH = Fields("doc long, n_shingles long, set_a long, set_b long, registers binary")
BANDS = Fields("bucket long, band int, doc long, n_shingles long")
SETS = Fields("doc long, shingles binary")


def shingles(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Distinct shingle hashes in order of row and value, the row of each, and the number of rows."""
    words = Words(column, lower=True)
    starts, hashes = words.windows(size)
    rows = words.row[starts]
    short = np.flatnonzero((words.count > 0) & (words.count < size))
    if len(short):
        whole = Rolling(words.hash).runs(words.first[short], words.first[short + 1])
        hashes, rows = np.concatenate([hashes, whole]), np.concatenate([rows, short])
    order = np.lexsort((hashes, rows))
    hashes, rows = hashes[order], rows[order]
    new = np.ones(len(rows), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (rows[1:] != rows[:-1])
    return hashes[new], rows[new], words.rows


def registers(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Registers of the sets that begin at `starts`: one row of 16-bit values per set."""
    least = np.stack([np.minimum.reduceat(hashes * scale, starts) for scale in SCALES], axis=1)
    exponential = -np.log1p(-(least.astype(float) + 0.5) / 2.0**64) / RATE
    return np.clip(np.floor(1 - np.log(np.maximum(exponential, 1e-300)) / np.log(BASE)), 0, TOP).astype("<u2")


def similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, steps: int = 100) -> np.ndarray:
    """Likeliest similarity of pairs of sets of known sizes, from which registers of a are above, below or equal to b's."""
    above, below = (a > b).sum(axis=1)[:, None], (a < b).sum(axis=1)[:, None]
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    j = np.linspace(0, 1, steps + 1)[None, :] * np.minimum(u / v, v / u)

    def chance(x):  # that one register is above the other
        return -np.log1p(-np.clip(x, 0, 1) * (BASE - 1) / BASE) / np.log(BASE)

    up, down = np.maximum(chance(u - v * j), 1e-12), np.maximum(chance(v - u * j), 1e-12)
    equal = np.maximum(1 - up - down, 1e-12)
    likelihood = above * np.log(up) + below * np.log(down) + (a.shape[1] - above - below) * np.log(equal)
    return np.take_along_axis(j, np.argmax(likelihood, axis=1)[:, None], axis=1)[:, 0]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u2").reshape(-1, REGISTERS)


def groups(docs: DataFrame, size: int = 5, percent: int = 80, text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept.

    Words are lower-cased (A-Z); a set is the distinct shingles of `size` words, of fewer words the whole
    sequence. Documents with 100 * intersection >= `percent` * union are linked; component_id is the
    least doc_id that can be reached, and kept says that it is the document's own.

    A null text or one without words has an empty set and no link. Rows with one doc_id count as linked to
    each other, and each gets its result. A null doc_id sorts before all others, and its row has a null
    component_id if no other reaches it; kept is then true. An empty table gives no rows.
    """
    spark, folder = docs.sparkSession, scratch(docs.sparkSession)

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.parquet(f"{folder}/{name}")

    body = docs.select(F.coalesce(F.col("doc_id"), F.lit(FIRST_ID)).alias("doc"), F.col(text).alias("text"))
    sketches = stored(body.mapInArrow(lambda batches: _sketch(batches, size), SKETCH.spark), "sketches")
    sets = sketches.filter("n_shingles > 0").groupBy("set_a", "set_b", "n_shingles")
    nodes = stored(sets.agg(F.min("doc").alias("doc"), F.first("registers").alias("registers")), "nodes")
    members = nodes.select("doc", "n_shingles", "registers").mapInArrow(_bands, BANDS.spark)
    order = F.xxhash64("doc", F.col("band") % SALTS)
    centres = (
        members.groupBy("bucket", "band").agg(F.count("*").alias("g"), F.min(F.struct(order.alias("h"), "doc", "n_shingles")).alias("c"))
        .filter("g > 1").select("bucket", "band", F.col("c.doc").alias("centre"), F.col("c.n_shingles").alias("n_centre"))
    )
    shared = stored(members.drop("band").join(centres, "bucket"), "shared")
    near = F.expr(f"100 * least(n_shingles, n_centre) >= {percent} * greatest(n_shingles, n_centre)")
    stars = shared.filter("doc <> centre").filter(near).select(F.greatest("doc", "centre").alias("u"), F.least("doc", "centre").alias("v"))
    sizes = nodes.select("doc", "n_shingles", "registers")
    likely = stored(_likely(stars.distinct(), sizes, percent / 100 - SLACK), "likely")
    links = stored(_verified(likely, body, size, percent), "verified")
    parts = components(links, f"{folder}/components")

    # Buckets that still hold several components are searched for links across.
    labelled = shared.join(parts.withColumnRenamed("node", "doc"), "doc", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "doc"))
    several = labelled.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high")
    rest = labelled.join(several.select("bucket"), "bucket").select("bucket", "band", "doc", "n_shingles", "component")
    apart = stored(_apart(rest, sizes, percent), "apart")
    if not apart.isEmpty():
        more = stored(_across(apart, _sets(apart.select("doc").distinct(), body, size), percent), "across")
        parts = components(links.unionByName(more), f"{folder}/more_components")

    of_set = nodes.select("set_a", "set_b", "n_shingles", F.col("doc").alias("node")).join(parts, "node", "left")
    of_set = of_set.select("set_a", "set_b", "n_shingles", F.coalesce("component", "node").alias("component"))
    found = sketches.drop("registers").join(of_set, ["set_a", "set_b", "n_shingles"], "left")
    own = F.when(F.col("doc") != FIRST_ID, F.col("doc"))
    component = F.when(F.col("component") != FIRST_ID, F.col("component"))
    return found.select(
        own.alias("doc_id"), "n_shingles",
        F.when(F.col("component").isNull(), own).otherwise(component).alias("component_id"),
        (F.coalesce("component", "doc") == F.col("doc")).alias("kept"),
    )


def _sketch(batches, size: int):
    for batch in batches:
        for part in slices(batch, "text"):
            hashes, rows, n = shingles(part.column("text"), size)
            own, starts = np.unique(rows, return_index=True)
            counts, a, b = np.zeros(n, np.int64), np.zeros(n, U), np.zeros(n, U)
            sketch: list[bytes | None] = [None] * n
            if len(own):
                counts[own] = np.diff(np.append(starts, len(rows)))
                a[own] = np.add.reduceat(mixed(hashes), starts)
                b[own] = np.add.reduceat(mixed(hashes ^ SCALES[0]), starts)
                for i, row in zip(own, registers(hashes, starts), strict=True):
                    sketch[i] = row.tobytes()
            columns = [part.column("doc"), pa.array(counts), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(sketch, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, schema=SKETCH.arrow)


def _bands(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        values = _matrix(batch.column("registers")).astype(U)
        for band in range(REGISTERS // ROWS):
            own = values[:, band * ROWS : (band + 1) * ROWS]
            key = mixed(mixed(own[:, 0] << U(48) | own[:, 1] << U(32) | own[:, 2] << U(16) | own[:, 3]) + U(band))
            which = np.full(len(key), band, np.int32)
            columns = [pa.array(key.view(np.int64)), pa.array(which), batch.column("doc"), batch.column("n_shingles")]
            yield pa.RecordBatch.from_arrays(columns, schema=BANDS.arrow)


def _likely(pairs: DataFrame, sizes: DataFrame, least: float) -> DataFrame:
    """Pairs (u, v) whose likeliest similarity is at least `least`."""
    sides = pairs
    for side in "uv":
        sides = sides.join(sizes.select(F.col("doc").alias(side), F.col("n_shingles").alias(f"n_{side}"), F.col("registers").alias(f"r_{side}")), side)

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                n_u, n_v = (batch.column(f"n_{s}").to_numpy().astype(float) for s in "uv")
                value = similarity(_matrix(batch.column("r_u")), _matrix(batch.column("r_v")), n_u, n_v)
                yield batch.select(["u", "v"]).filter(pa.array(value >= least))

    return sides.mapInArrow(run, Fields("u long, v long").spark).distinct()


def _sets(wanted: DataFrame, body: DataFrame, size: int) -> DataFrame:
    """Full sets (doc, shingles) of the documents in wanted (doc), made anew from the texts."""

    def make(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                hashes, rows, n = shingles(part.column("text"), size)
                ends = np.searchsorted(rows, np.arange(n + 1))
                sets = [hashes[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(sets, pa.binary())], schema=SETS.arrow)

    # Merged at any size: the texts are shuffled once here, and not sent around beside a small list of ids.
    return body.join(wanted.hint("merge"), "doc").select("doc", "text").mapInArrow(make, SETS.spark)


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets are similar enough."""
    if not len(a) or not len(b):
        return False
    common = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return common > 0 and 100 * common >= percent * (len(a) + len(b) - common)


def _verified(pairs: DataFrame, body: DataFrame, size: int, percent: int) -> DataFrame:
    """Pairs (u, v) whose full sets are similar enough."""
    wanted = pairs.select(F.col("u").alias("doc")).unionByName(pairs.select(F.col("v").alias("doc"))).distinct()
    sets = _sets(wanted, body, size)
    both = pairs.join(sets.withColumnsRenamed({"doc": "u", "shingles": "s_u"}), "u")
    both = both.join(sets.withColumnsRenamed({"doc": "v", "shingles": "s_v"}), "v")

    def judge(batches):
        for batch in batches:
            sides = zip(batch.column("s_u"), batch.column("s_v"), strict=True)
            keep = [_linked(np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U), percent) for x, y in sides]
            yield batch.select(["u", "v"]).filter(pa.array(keep, pa.bool_()))

    return both.mapInArrow(judge, Fields("u long, v long").spark).distinct()


class Group:
    """Members of a bucket that meet in one task, and the likely pairs across its components."""

    def __init__(self, table: pa.Table, percent: int):
        self.percent = percent
        self.i, self.j, band = (table.column(c)[0].as_py() for c in ("i", "j", "band"))
        self.piece, self.doc, self.component = (table.column(c).to_numpy().copy() for c in ("piece", "doc", "component"))
        self.n = table.column("n_shingles").to_numpy().astype(float)
        self.values = _matrix(table.column("registers"))
        self.bands = self.values.reshape(len(self.values), -1, ROWS)[:, :band]
        names, sizes = np.unique(self.component, return_counts=True)
        self.outside = self.component != names[np.argmax(sizes)]

    def partners(self, k: int) -> np.ndarray:
        """Members of other components that are likely enough to be linked with member k, the likeliest first."""
        other = self.component != self.component[k]
        if self.i != self.j:
            other &= self.piece != self.piece[k]
        at = np.flatnonzero(other)
        at = at[100 * np.minimum(self.n[at], self.n[k]) >= self.percent * np.maximum(self.n[at], self.n[k])]
        least = self.percent / 100 - SLACK
        # The likeliest similarity lies near the share of equal registers; only those near enough are worked out.
        at = at[(self.values[at] == self.values[k]).mean(axis=1) >= least - 0.15]
        # A pair that shares an earlier band is looked at there.
        at = at[~(self.bands[at] == self.bands[k]).all(axis=2).any(axis=1)]
        own = np.repeat(self.values[k : k + 1], len(at), axis=0)
        value = similarity(own, self.values[at], np.full(len(at), self.n[k]), self.n[at])
        order = np.argsort(-value, kind="stable")
        return at[order][value[order] >= least]


APART = Fields(
    "bucket long, band int, i long, j long, piece long, doc long, n_shingles long, component long, registers binary"
)


def _apart(rest: DataFrame, sizes: DataFrame, percent: int) -> DataFrame:
    """Members of buckets (as APART) that have a likely partner in another component of their bucket.

    A bucket's members are dealt into pieces of about PIECE; each pair of pieces is one group, so no group
    grows with the bucket. Only members outside a group's largest component are compared with the rest.
    """
    pieces = rest.groupBy("bucket").agg(F.ceil(F.count("*") / PIECE).alias("n"))
    placed = rest.join(pieces, "bucket").join(sizes.select("doc", "registers"), "doc")
    placed = placed.withColumn("piece", F.pmod(F.xxhash64("doc"), F.col("n")))
    both = placed.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)))
    ends = {"i": F.least("piece", "other"), "j": F.greatest("piece", "other")}
    grouped = both.select(*[ends[c].alias(c) if c in ends else c for c in APART.arrow.names])

    def search(table: pa.Table) -> pa.Table:
        group = Group(table, percent)
        wanted = np.zeros(len(table), bool)
        for k in np.flatnonzero(group.outside):
            at = group.partners(k)
            wanted[at] = True
            wanted[k] |= len(at) > 0
        return table.filter(pa.array(wanted)).cast(APART.arrow)

    return grouped.groupBy("bucket", "i", "j").applyInArrow(search, APART.spark)


def _across(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components within the groups of `apart`: as many as join them, so at most one per member."""

    def search(table: pa.Table) -> pa.Table:
        group = Group(table, percent)
        full = [np.frombuffer(x.as_buffer(), U) for x in table.column("shingles").combine_chunks()]
        found = []
        for k in np.flatnonzero(group.outside):
            for other in group.partners(k):
                # A link found just now has joined the two: the rest of that component needs no look.
                if group.component[other] != group.component[k] and _linked(full[k], full[other], percent):
                    found.append((int(group.doc[k]), int(group.doc[other])))
                    group.component[group.component == group.component[k]] = group.component[other]
        return Fields("u long, v long").table(found)

    return apart.join(sets, "doc").groupBy("bucket", "i", "j").applyInArrow(search, Fields("u long, v long").spark).distinct()
