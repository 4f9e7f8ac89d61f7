"""Conversation prefix trie by vertical bitmaps.

Conversations are cut into shards of SHARD in order of id, and into bands of BAND turns. A shard keeps, for each
(position, turn), the bitset of its conversations that have the turn there; a depth-first walk intersects the
bitset of a node with those postings, which yields its children, their popcounts and the ids that end there. A band
starts from the prefixes its conversations had at the end of the band before, so a conversation of any length, or a
third of all rows, is many small pieces.

A prefix is named by 128 bits: the XOR of a hash of (position, role, text) over its turns. Shards name their
nodes alike, so a node is the sum of its rows, of which each shard sends one. As shards follow the order of
ids, the end lists of a node's shards one after the other are in order, and their hash is taken as a stream.

Sums over subtrees come by doubling: with the sum over descendants nearer than 2**r, and each node's
ancestor 2**r above, one join and one aggregate give both for r + 1. No round looks at a whole subtree.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vitalake.llm.arrays import ranges
from vitalake.llm.blocks import scratch

SHARD, BAND = 2048, 64
#: Rules of the rebuilt conversations: ids that share a base, and turns taken from it (fewer than this).
FAMILY, HEADS = 5, 9
NODE = "p1 long, p2 long, q1 long, q2 long, depth long, bytes long, n long, least long, first long, ends string"
EMPTY = hashlib.sha256(b"").hexdigest()


def _stored(df: DataFrame, path: str) -> DataFrame:
    """df as a written table, so that what follows starts from files all executors can read."""
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ranked(conversations: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, part, place, t1, t2, bytes) in order, and of each conversation's part how many turns lie before.

    Turns are sorted over all partitions, so a conversation may lie in many; `part` says in which. The second
    table has (conv, part, first, before, total): the first place, the turns in earlier parts, and all its turns.
    """
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    slim = conversations.filter("conv_id IS NOT NULL").select(
        F.col("conv_id").cast("long").alias("conv"), "turn", F.xxhash64(role, text).alias("t1"),
        F.xxhash64(F.lit(1), text, role).alias("t2"), F.octet_length(text).cast("long").alias("bytes"),
    )
    order = ["conv", F.asc_nulls_first("turn"), "t1", "t2"]
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    in_order = slim.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("place", F.monotonically_increasing_id())
    turns = _stored(in_order.withColumn("part", F.shiftright("place", 33)).drop("turn"), f"{folder}/turns")
    pieces = turns.groupBy("conv", "part").agg(F.min("place").alias("first"), F.count("*").alias("n"))
    all_of = Window.partitionBy("conv")
    earlier = all_of.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    places = pieces.select(
        "conv", "part", "first", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"), F.sum("n").over(all_of).alias("total")
    )
    return turns, places


def rebuilt(conversations: DataFrame, folder: str) -> tuple[DataFrame, DataFrame]:
    """Turns (conv, depth, t1, t2, bytes, length) of the rebuilt conversations, and their ids and lengths.

    Conversation c has the first h turns of conversation c - c % 5 and its own after its first h; h = crc32(c) % 9.
    """
    turns, places = ranked(conversations, folder)
    places = _stored(places, f"{folder}/places")
    totals = places.groupBy("conv").agg(F.max("total").alias("total"))
    base, h = F.col("conv") - F.col("conv") % FAMILY, F.crc32(F.col("conv").cast("string").cast("binary")) % HEADS
    bases = totals.select(F.col("conv").alias("base"), F.col("total").alias("base_total"))
    facts = totals.withColumns({"base": base, "h": h}).join(bases, "base", "left")
    taken = F.least("h", F.coalesce("base_total", F.lit(0)))
    facts = facts.withColumn("taken", taken).withColumn("length", F.col("taken") + F.greatest(F.col("total") - F.col("h"), F.lit(0)))
    facts = _stored(facts.select("conv", "base", "h", "taken", "length"), f"{folder}/facts")

    placed = turns.join(places.join(facts, "conv"), ["conv", "part"])
    placed = placed.withColumn("pos", F.col("before") + F.col("place") - F.col("first"))
    turn = ["t1", "t2", "bytes"]
    own = placed.filter("pos >= h").select("conv", (F.col("taken") + F.col("pos") - F.col("h") + 1).alias("depth"), *turn, "length")
    starts = placed.filter((F.col("pos") < HEADS - 1) & (F.col("conv") == F.col("base"))).select("base", "pos", *turn)
    heads = facts.select("conv", "base", "taken", "length").join(starts, "base").filter("pos < taken")
    heads = heads.select("conv", (F.col("pos") + 1).alias("depth"), *turn, "length")
    return own.unionByName(heads), facts.select("conv", "length")


def banded(turns: DataFrame, lengths: DataFrame, folder: str, band: int = BAND) -> DataFrame:
    """(conv, band, length, turns, z1, z2): the turns of a band in order, and the prefix that comes before it."""
    depth = F.col("depth")
    hashed = turns.select(
        "conv", "depth", "length", "bytes", F.floor((depth - 1) / band).alias("band"),
        F.xxhash64("depth", "t1", "t2").alias("x1"), F.xxhash64("t2", "depth", "t1").alias("x2"),
    )
    cut = hashed.groupBy("conv", "band").agg(
        F.max("length").alias("length"),
        F.sort_array(F.collect_list(F.struct("depth", "x1", "x2", "bytes"))).alias("turns"),
        F.bit_xor("x1").alias("y1"), F.bit_xor("x2").alias("y2"),
    )
    cut = _stored(cut, f"{folder}/bands")
    earlier = Window.partitionBy("conv").orderBy("band").rowsBetween(Window.unboundedPreceding, -1)
    long = cut.filter(F.col("length") > band).select("conv", "band", *[F.bit_xor(f"y{i}").over(earlier).alias(f"z{i}") for i in (1, 2)])
    none = lengths.filter("length = 0").select(
        "conv", F.lit(0).cast("long").alias("band"), "length", F.array().cast(cut.schema["turns"].dataType).alias("turns"),
        F.lit(0).cast("long").alias("z1"), F.lit(0).cast("long").alias("z2"),
    )
    started = cut.join(long, ["conv", "band"], "left").drop("y1", "y2")
    return started.fillna(0, ["z1", "z2"]).unionByName(none)


class Shard:
    """Conversations of one band as postings, and the walk over them."""

    def __init__(self, rows: pa.Table, band_size: int):
        column = {c: rows.column(c).combine_chunks() for c in rows.column_names}
        self.conv, length, self.z1, self.z2 = (column[c].to_numpy() for c in ("conv", "length", "z1", "z2"))
        self.band, self.size = column["band"][0].as_py(), band_size
        offsets = column["turns"].offsets.to_numpy()
        turns = column["turns"].flatten()
        self.offsets = (offsets - offsets[0]).astype(np.int64)
        self.x1, self.x2, self.bytes = (turns.field(c).to_numpy() for c in ("x1", "x2", "bytes"))
        count = np.diff(self.offsets)
        ended = length == self.band * band_size + count
        #: By position: bitset of the conversations that end there, of those that go on, and of each turn.
        self.ended, self.longer = defaultdict(int), defaultdict(int)
        self.postings: list[dict] = [defaultdict(int) for _ in range(int(count.max(initial=0)))]
        keys = list(zip(self.x1.tolist(), self.x2.tolist(), strict=True))
        self.keys = keys
        for i, (low, n, at_end) in enumerate(zip(self.offsets.tolist(), count.tolist(), ended.tolist(), strict=False)):
            bit = 1 << i
            for d in range(n):
                self.postings[d][keys[low + d]] |= bit
                self.longer[d] |= bit
            if at_end:
                self.ended[n] |= bit
        self.at_end = ended

    def roots(self) -> list[int]:
        """Bitsets of the conversations that come in with one prefix."""
        groups: dict = defaultdict(int)
        for i, z in enumerate(zip(self.z1.tolist(), self.z2.tolist(), strict=True)):
            groups[z] |= 1 << i
        return list(groups.values())

    def listed(self, bits: int) -> tuple[int, str]:
        """The least id of a bitset, and all in order."""
        flags = np.unpackbits(np.frombuffer(bits.to_bytes((bits.bit_length() + 7) // 8, "little"), np.uint8), bitorder="little")
        ids = np.sort(self.conv[np.flatnonzero(flags)]).tolist()
        return ids[0], ",".join(map(str, ids))

    def nodes(self) -> pa.RecordBatch:
        """All nodes below the roots, and the root of all in the first band."""
        row, depth, n, ends, alone = [], [], [], [], []
        if self.band == 0:
            bits = (1 << len(self.conv)) - 1
            row, depth, n, ends = [0], [0], [len(self.conv)], [bits & self.ended[0]]
        stack = [(bits, 0) for bits in self.roots()]
        while stack:
            bits, d = stack.pop()
            rest = bits & self.longer[d]
            while rest:
                i = (rest & -rest).bit_length() - 1
                child = rest & self.postings[d][self.keys[self.offsets[i] + d]]
                rest ^= child
                if child & (child - 1):
                    row.append(i), depth.append(d + 1), n.append(child.bit_count()), ends.append(child & self.ended[d + 1])
                    stack.append((child, d + 1))
                else:
                    alone.append((i, d))
        return self._rows(row, depth, n, ends, alone)

    def _rows(self, row: list[int], depth: list[int], n: list[int], ends: list[int], alone: list[tuple[int, int]]) -> pa.RecordBatch:
        """Rows of the nodes of several conversations, and of the rest of each one that goes on alone."""
        single, since = np.array(alone, np.int64).reshape(-1, 2).T
        left = self.offsets[single + 1] - self.offsets[single] - since
        row = np.concatenate([np.array(row, np.int64), np.repeat(single, left)])
        depth = np.concatenate([np.array(depth, np.int64), ranges(since + 1, left)])
        many = len(n)
        count = np.ones(len(row), np.int64)
        count[:many] = n
        listed = [self.listed(bits) if bits else (None, None) for bits in ends]
        lasts = (depth[many:] == np.repeat(since + left, left)) & self.at_end[row[many:]]
        listed += [(c, str(c)) if last else (None, None) for c, last in zip(self.conv[row[many:]].tolist(), lasts.tolist(), strict=True)]

        at = self.offsets[row] + depth - 1
        names = []
        for x, z in ((self.x1, self.z1), (self.x2, self.z2)):
            up_to = np.concatenate([[0], np.bitwise_xor.accumulate(x)]) if len(x) else np.zeros(1, np.int64)
            prefix = lambda deep: z[row] ^ up_to[self.offsets[row] + deep] ^ up_to[self.offsets[row]]  # noqa: B023, E731
            names += [prefix(depth), prefix(np.maximum(depth - 1, 0))]
        top = pa.array(depth == 0)
        size = np.where(depth > 0, self.bytes[at] if len(self.bytes) else 0, 0)
        null = pa.scalar(None, pa.int64())
        columns = [
            pa.array(names[0], pa.int64()), pa.array(names[2], pa.int64()),
            *[pa.compute.if_else(top, null, pa.array(x, pa.int64())) for x in (names[1], names[3])],
            pa.array(depth + self.band * self.size, pa.int64()), pa.array(size, pa.int64()), pa.array(count, pa.int64()),
            pa.array(self.conv[row], pa.int64()), pa.array([x for x, _ in listed], pa.int64()), pa.array([x for _, x in listed], pa.string()),
        ]
        return pa.RecordBatch.from_arrays(columns, [f.split()[0] for f in NODE.split(", ")])


def shard_nodes(bands: DataFrame, shard: int = SHARD, band: int = BAND) -> DataFrame:
    """NODE rows of all shards: nodes with the popcount, least id and end list that each shard has for them."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            waiting = table if waiting is None else pa.concat_tables([waiting, table])
            while (ready := _first_shard(waiting, shard, whole=False)) is not None:
                yield Shard(waiting.slice(0, ready), band).nodes()
                waiting = waiting.slice(ready)
        while waiting is not None and waiting.num_rows:
            ready = _first_shard(waiting, shard, whole=True)
            yield Shard(waiting.slice(0, ready), band).nodes()
            waiting = waiting.slice(ready)

    parts = int(bands.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return bands.repartitionByRange(parts, "band", "conv").sortWithinPartitions("band", "conv").mapInArrow(walk, NODE)


def _first_shard(waiting: pa.Table, shard: int, whole: bool) -> int | None:
    """Rows of the next shard, which is of one band; None while more rows may belong to it."""
    bands = waiting.column("band").to_numpy()
    same = int(np.searchsorted(bands, bands[0], "right")) if len(bands) else 0
    if same >= shard:
        return shard
    return same if same and (whole or same < len(bands)) else None


def end_hashes(found: DataFrame) -> DataFrame:
    """(p1, p2, ends_sha256): the lists of a node's shards hashed one after the other, whatever their number."""

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, state = None, None
        for batch in batches:
            out = []
            for p1, p2, ends in zip(*(batch.column(c).to_pylist() for c in ("p1", "p2", "ends")), strict=True):
                if node == (p1, p2):
                    state.update(b"," + ends.encode())
                    continue
                if node is not None:
                    out.append((*node, state.hexdigest()))
                node, state = (p1, p2), hashlib.sha256(ends.encode())
            yield _hash_rows(out)
        if node is not None:
            yield _hash_rows([(*node, state.hexdigest())])

    lists = found.filter("ends IS NOT NULL").select("p1", "p2", "first", "ends")
    return lists.repartition("p1", "p2").sortWithinPartitions("p1", "p2", "first").mapInArrow(hashed, "p1 long, p2 long, ends_sha256 string")


def _hash_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [[], [], []]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())], ["p1", "p2", "ends_sha256"])


P, Q = ["p1", "p2"], ["q1", "q2"]


def _renamed(df: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    names = dict(zip(old, new, strict=True))
    return df.select(*[F.col(c).alias(names.get(c, c)) for c in df.columns])


def subtree_sums(nodes: DataFrame, values: list[str], folder: str) -> DataFrame:
    """(p1, p2, *values): each value summed over the node and all below it."""
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    sums = _stored(nodes.select(*P, *values), f"{folder}/sums_0")
    above = _stored(nodes.filter("depth > 0").select(*P, *Q), f"{folder}/above_0")
    r = 0
    while deepest >> r:
        given = above.join(sums, P).groupBy(*Q).agg(*[F.sum(v).alias(f"more_{v}") for v in values])
        more = sums.join(_renamed(given, Q, P), P, "left")
        sums = _stored(more.select(*P, *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values]), f"{folder}/sums_{r + 1}")
        r += 1
        if deepest >> r:
            further = _renamed(above, [*P, *Q], [*Q, "r1", "r2"])
            above = _stored(_renamed(above.join(further, Q).select(*P, "r1", "r2"), ["r1", "r2"], Q), f"{folder}/above_{r}")
    return sums


def trie(conversations: DataFrame, shard: int = SHARD, band: int = BAND) -> DataFrame:
    """One row per node of the prefix trie of the rebuilt conversations (see `rebuilt`).

    conv_id (the smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256:
    members are the conversations that start with the node's turns; n_leaves and saved_tokens are summed over the
    subtree, its top included; saved_tokens counts (n_convs - 1) times the bytes of a node's last text; ends_sha256
    hashes the ids of the members that end at the node, in order.

    Turns go by `turn`, null first; turns of one number go by the hash of role and text, and repeated rows are turns of
    their own. A null role or text is an empty one. Rows without a conversation id belong to no conversation and are left
    out. A conversation may be left without turns; it is a member of the root. An empty table has no
    conversation, so not even a root. Further columns are ignored.
    """
    folder = scratch(conversations.sparkSession)
    turns, lengths = rebuilt(conversations, folder)
    found = _stored(shard_nodes(banded(turns, lengths, folder, band), shard, band), f"{folder}/found")
    nodes = found.groupBy(*P).agg(
        F.max("q1").alias("q1"), F.max("q2").alias("q2"), F.max("depth").alias("depth"), F.max("bytes").alias("bytes"),
        F.sum("n").alias("n_convs"), F.min("least").alias("conv_id"),
    )
    nodes = _stored(nodes, f"{folder}/merged")
    children = _renamed(nodes.filter("depth > 0").groupBy(*Q).agg(F.count("*").alias("n_children")), Q, P)
    nodes = nodes.join(children, P, "left").fillna(0, ["n_children"])
    nodes = nodes.withColumns({
        "n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("bytes"),
    })
    nodes = _stored(nodes, f"{folder}/nodes")
    values = ["n_leaves", "saved_tokens"]
    summed = nodes.drop(*values).join(subtree_sums(nodes, values, folder), P).join(end_hashes(found), P, "left")
    parents = _renamed(nodes.select(*P, F.col("conv_id").alias("parent_conv_id")), P, Q)
    return summed.join(parents, Q, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", *values, F.coalesce("ends_sha256", F.lit(EMPTY)).alias("ends_sha256")
    )


SQL = r"""
WITH crc AS (
  SELECT conv_id, count(*) AS total, conv_id - conv_id % 5 AS base,
         xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(conv_id::VARCHAR, ''),
               lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
             lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END), 4294967295) % 9 AS h
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), facts AS (
  SELECT c.*, least(c.h, coalesce(b.total, 0)) AS taken FROM crc c LEFT JOIN crc b ON b.conv_id = c.base
), turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS pos,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), rebuilt AS (
  SELECT f.conv_id, t.pos + 1 AS depth, role, text FROM facts f JOIN turns t ON t.conv_id = f.base AND t.pos < f.taken
  UNION ALL
  SELECT f.conv_id, f.taken + t.pos - f.h + 1, role, text FROM facts f JOIN turns t ON t.conv_id = f.conv_id AND t.pos >= f.h
), members AS MATERIALIZED (
  SELECT conv_id, depth, strlen(text) AS bytes,
         string_agg(sha256(strlen(role) || ':' || role || text), '') OVER (PARTITION BY conv_id ORDER BY depth) AS node
  FROM rebuilt
  UNION ALL
  SELECT conv_id, 0, 0, '' FROM facts
), nodes AS MATERIALIZED (
  SELECT node, depth, min(conv_id) AS conv_id, count(*) AS n_convs, max(bytes) AS bytes, left(node, greatest(depth - 1, 0) * 64) AS parent
  FROM members GROUP BY node, depth
), valued AS MATERIALIZED (
  SELECT n.*, coalesce(k.n_children, 0) AS n_children
  FROM nodes n LEFT JOIN (SELECT parent, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY parent) k ON k.parent = n.node
), subtrees AS (
  SELECT a.node, b.node AS below FROM members a JOIN members b ON a.conv_id = b.conv_id AND b.depth >= a.depth GROUP BY ALL
), sums AS (
  SELECT s.node, count(*) FILTER (WHERE v.n_children = 0) AS n_leaves, sum((v.n_convs - 1) * v.bytes)::BIGINT AS saved_tokens
  FROM subtrees s JOIN valued v ON v.node = s.below GROUP BY s.node
), ends AS (
  SELECT node, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS ends_sha256
  FROM members m WHERE depth = (SELECT max(depth) FROM members x WHERE x.conv_id = m.conv_id) GROUP BY node
)
SELECT v.conv_id, v.depth, p.conv_id AS parent_conv_id, v.n_convs, v.n_children, s.n_leaves, s.saved_tokens,
       coalesce(e.ends_sha256, sha256('')) AS ends_sha256
FROM valued v JOIN sums s ON s.node = v.node LEFT JOIN ends e ON e.node = v.node
LEFT JOIN nodes p ON p.node = v.parent AND v.depth > 0
"""
