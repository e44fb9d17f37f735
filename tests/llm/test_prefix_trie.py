"""Operator 13 against a trie of dictionaries."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ebbtide.llm import prefix_trie

SCHEMA = "conv_id long, turn int, role string, text string, node string, part long, keys string"


def by_hand(rows):
    own = {}
    for c, turn, role, text, *_ in rows:
        if c is not None:
            role, text = role or "", text or ""
            digest = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()[:16]
            own.setdefault(c, []).append((turn is not None, turn or 0, digest, role, text))
    own = {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}
    members, ends = {}, {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % 9
        seq = tuple(own.get(c - c % 5, [])[:h] + ts[h:])
        for d in range(len(seq) + 1):
            members.setdefault(seq[:d], []).append(c)
        ends.setdefault(seq, []).append(c)
    out = []
    for node, ms in members.items():
        below = [(n, m) for n, m in members.items() if n[:len(node)] == node]
        parents = {n[:-1] for n in members if n}
        out.append((min(ms), len(node), min(members[node[:-1]]) if node else None, len(ms), sum(n[:-1] == node for n in members if n),
                    sum(n not in parents for n, _ in below), sum((len(m) - 1) * len(n[-1][1].encode()) for n, m in below if n),
                    hashlib.sha256(",".join(map(str, sorted(ends.get(node, [])))).encode()).hexdigest()))
    return sorted(out, key=lambda r: (r[1], r[0]))


def found(df, shard_turns=None):
    if shard_turns is None:
        got = prefix_trie.nodes(df)
    else:
        got = prefix_trie.trie(prefix_trie.rebuilt(prefix_trie.sequences(df)), shard_turns)
    return sorted((tuple(r) for r in got.collect()), key=lambda r: (r[1], r[0]))


def table(seed, n=90):
    """Nulls everywhere, equal and missing turns, copies, shared openings, a long conversation, absent heads."""
    r = random.Random(seed)
    rows = []
    for c in range(n):
        if r.random() < 0.1:
            continue  # absent, so that others lack their head
        hot = c % 3 == 0
        for t in range(4 if hot else r.randrange(1, 9)):
            rows.append((c, t, "user", "hello") if hot else (c, r.choice([t, t, None]), r.choice(["user", "bot", None]), r.choice(["hello", "é", "", None, "bye"])))
    rows += [(n + 1, t, "user", "hello" if t < 200 else f"x{t % 3}") for t in range(240)]
    rows += [(n + 2, t, "user", "hello") for t in range(150)] + [(None, 1, "user", "hello"), (5000000001, 0, "user", "hello")] + rows[:7]
    r.shuffle(rows)
    return [(*x, "n", 7, "k") for x in rows]


@pytest.mark.parametrize("shard_turns", [1, 5, 40, None])
def test_shards_of_any_size(spark, shard_turns):
    rows = table(1)
    assert found(spark.createDataFrame(rows, SCHEMA).repartition(3), shard_turns) == by_hand(rows)


def test_copies_over_many_shards(spark):
    """A third of all conversations are one and the same; their list of ids runs over all shards."""
    rows = [(c, t, "user", "a" if c % 3 == 0 or t < 9 else f"b{c}", "n", 7, "k") for c in range(0, 900, 5) for t in range(2)]
    assert found(spark.createDataFrame(rows, SCHEMA), 4) == by_hand(rows)


def test_empty_and_given_tables(spark, sf_small):
    assert prefix_trie.nodes(spark.createDataFrame([], SCHEMA)).count() == 0
    df = spark.read.parquet(f"{sf_small}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert found(df) == by_hand([tuple(r) for r in df.collect()])


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 700), st.randoms())
def test_block_minima(n, r):
    v = np.array([r.randrange(50) for _ in range(n)] + [-1], np.int32)
    b = prefix_trie.BlockMin(v)
    starts = [r.randrange(n) for _ in range(80)]
    at = np.array(starts)
    below = np.array([r.randrange(51) for _ in at], np.int32)
    want = [next(j for j in range(i + 1, n + 1) if v[j] < x) for i, x in zip(starts, below)]
    assert b.next_smaller(at, below).tolist() == want
    stop = np.array([r.randrange(i + 1, n + 2) for i in starts])
    assert b.minimum(at, stop).tolist() == [v[i:j].min() for i, j in zip(at, stop)]
