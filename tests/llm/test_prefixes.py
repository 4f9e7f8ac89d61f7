"""The prefix trie against a trie of dicts."""

import collections
import hashlib
import random
import zlib

import pytest

from llm.conftest import SMALL
from vitalake.llm import prefixes
from vitalake.llm.queries import table

FIELDS = "conv_id long, turn long, role string, text string, depth string, n string, ends string"


def plain(rows):
    """rows: (conv_id, turn, role, text), with turns of one number in order."""
    own = collections.defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        own[c].append((role or "", text or ""))
    members = collections.defaultdict(list)
    ends = collections.defaultdict(list)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % 9
        path = tuple(own.get(c - c % 5, [])[:h] + own[c][h:])
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
        ends[path].append(c)
    children = collections.Counter(p[:-1] for p in members if p)
    leaves, saved = collections.Counter(), collections.Counter()
    for p, who in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += not children[p]
            saved[p[:d]] += (len(who) - 1) * len(p[-1][1].encode()) if p else 0
    return sorted(
        (who[0], len(p), members[p[:-1]][0] if p else None, len(who), children[p], leaves[p], saved[p],
         hashlib.sha256(",".join(map(str, ends[p])).encode()).hexdigest())
        for p, who in members.items()
    )


def nodes(df, **options):
    return sorted(tuple(r) for r in prefixes.trie(df, **options).collect())


@pytest.fixture
def talk(spark):
    def build(rows, parts=3):
        df = spark.createDataFrame([(*r, "x", "y", "z") for r in rows], FIELDS)
        return df.repartition(parts) if rows else df

    return build


def branching(seed, n=80, most=14):
    pick = random.Random(seed)
    rows = []
    for c in pick.sample(range(300), n):
        rows += [(c, t, pick.choice(["user", "bot"]), pick.choice(["", "a", "é", "long text"])) for t in range(pick.randint(1, most))]
    return rows


def test_given_conversations(spark):
    df = table(spark, SMALL, "conversations")
    assert nodes(df) == plain([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize(("seed", "shard", "band"), [(1, 2048, 64), (2, 3, 4), (3, 1, 1), (4, 7, 3)])
def test_shards_and_bands_do_not_show(talk, seed, shard, band):
    rows = branching(seed)
    assert nodes(talk(rows, 5), shard=shard, band=band) == plain(rows)


def test_one_conversation_with_a_third_of_all_rows(talk):
    rows = [(0, t, "user", f"turn {t}") for t in range(300)] + [(5 * i, t, "user", "hello" if t == 0 else f"{i} {t}") for i in range(1, 200) for t in range(3)]
    assert nodes(talk(rows, 8)) == plain(rows)


def test_one_start_for_all(talk):
    rows = [(c, t, "system", "the same") for c in range(120) for t in range(1 + (c % 7 == 0))]
    got = nodes(talk(rows, 4), shard=16)
    assert got == plain(rows) and max(r[3] for r in got) == 120


def test_odd_rows(talk):
    rows = [
        (None, 0, "user", "no conversation"), (10, None, "user", "first"), (10, 0, None, "second"), (10, 1, "user", None), (10, 2, "a", "bc"), (10, 3, "ab", "c"),
        (11, 5, "user", "only"), (12, -3, "user", "below"), (12, 7, "user", "x" * 30_000), (13, 0, "user", ""), (14, 0, "", None), (999, 1, "user", "far"),
    ]
    assert nodes(talk(rows)) == plain(rows)
    assert nodes(talk([])) == [] and nodes(talk([(None, 1, "a", "b")])) == []


def test_turns_of_one_number_and_repeated_rows(talk):
    same = [(0, 1, "user", "a"), (0, 1, "user", "b"), (0, 1, "user", "a")]
    got = nodes(talk(same))
    assert [r[1] for r in got] == [0, 1, 2, 3] and got == nodes(talk(same[::-1]))
