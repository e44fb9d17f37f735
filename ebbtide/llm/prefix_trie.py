"""Trie of shared conversation prefixes in balanced parentheses (operator 13).

A node stands for a sequence of turns (role and text) that at least one conversation starts with; the root is the
empty sequence. Conversations are sorted by their turns and cut into shards (``ranges.sorted_parts``). A shard writes
its trie as balanced parentheses in depth-first order: ``findclose`` delimits every node's subtree, by a tree of the
least excess of each block; the rank of pairs ``()`` counts the leaves below it; cumulative arrays give members and
savings; block minima give the smallest member.

A node can lie in several shards only if it is on a shard's spine, the way to its first or its last conversation. So
spine nodes are merged by the hash of their turns: first their members, then, with these known, what each shard adds
to their children, leaves and savings. Everything else is settled within its shard.

Defined results: a null role or text is empty; turns of equal number (a null is the lowest) follow by their digest, so
repeated rows are repeated turns; rows without ``conv_id`` belong to no conversation; an empty table gives no rows;
other columns are not read. A conversation is one row of 24 bytes a turn, as a document is one row of its text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.ranges import sorted_parts
from ebbtide.llm.store import stored

SHARD_TURNS = 1 << 17
BLOCK = 64
CHUNK_IDS = 1 << 14  # ids in one row of a list that is hashed across shards
_ROOT = b"\0" * 16
_NONE = np.iinfo(np.int64).max
_EMPTY = hashlib.sha256(b"").hexdigest()


def sequences(turns: DataFrame, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv_id, turns): each conversation's turns in order, as digest of role and text and bytes of text."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in (role_col, text_col))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256)), 1, 16)
    row = F.struct(F.col(order_col).alias("turn"), digest.alias("digest"), F.octet_length(text).cast("long").alias("bytes"))
    listed = turns.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("t"))
    return listed.select("conv_id", F.transform("t", lambda x: F.struct(x["digest"].alias("digest"), x["bytes"].alias("bytes"))).alias("turns"))


class BlockMin:
    """Minima over blocks of an array: range minima and searches for the next smaller value, all queries at once."""

    def __init__(self, values: np.ndarray):
        self.n, blocks = len(values), max(1, -(-len(values) // BLOCK))
        self._v = np.full((blocks, BLOCK), np.iinfo(values.dtype).max, values.dtype)
        self._v.ravel()[:self.n] = values
        self._leaves = 1 << max(0, (blocks - 1).bit_length())
        self._tree = np.full(2 * self._leaves, np.iinfo(values.dtype).max, values.dtype)  # node k has children 2k and 2k + 1
        self._tree[self._leaves:self._leaves + blocks] = self._v.min(axis=1)
        at = self._leaves
        while at > 1:
            self._tree[at // 2:at] = self._tree[at:2 * at].reshape(-1, 2).min(axis=1)
            at //= 2

    def _in_block(self, block: np.ndarray, low: np.ndarray, below: np.ndarray) -> np.ndarray:
        """First column from ``low`` on whose value is smaller than ``below``, BLOCK where there is none."""
        out = np.empty(len(block), np.int64)
        columns = np.arange(BLOCK)
        for a in range(0, len(block), 1 << 14):
            s = slice(a, a + (1 << 14))
            hit = (self._v[block[s]] < below[s, None]) & (columns >= low[s, None])
            out[s] = np.where(hit.any(axis=1), hit.argmax(axis=1), BLOCK)
        return out

    def next_smaller(self, at: np.ndarray, below: np.ndarray) -> np.ndarray:
        """First position after ``at`` whose value is smaller than ``below`` (there must be one)."""
        block = at // BLOCK
        column = self._in_block(block, at % BLOCK + 1, below)
        far = np.flatnonzero(column == BLOCK)
        node, target = self._leaves + block[far], below[far]
        climbing = np.arange(len(far))
        while len(climbing):  # up to the first right sibling that holds a smaller value
            k = node[climbing]
            found = (k % 2 == 0) & (self._tree[np.minimum(k + 1, len(self._tree) - 1)] < target[climbing])
            node[climbing] = np.where(found, k + 1, k // 2)
            climbing = climbing[~found]
        # ... and down to its first such block (searches stand on different levels)
        while len(node) and (node < self._leaves).any():
            low = np.flatnonzero(node < self._leaves)
            k = 2 * node[low]
            node[low] = k + (self._tree[k] >= target[low])
        block[far] = node - self._leaves
        column[far] = self._in_block(block[far], np.zeros(len(far), np.int64), target)
        return block * BLOCK + column

    def minimum(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Least value of each range [start, stop), none of them empty."""
        last = stop - 1
        a, b = start // BLOCK, last // BLOCK
        suffix = np.minimum.accumulate(self._v[:, ::-1], axis=1)[:, ::-1]
        prefix = np.minimum.accumulate(self._v, axis=1)
        out = np.minimum(suffix[a, start % BLOCK], prefix[b, last % BLOCK])
        inside = np.flatnonzero(a == b)
        columns = np.arange(BLOCK)
        for k in range(0, len(inside), 1 << 14):
            i = inside[k:k + (1 << 14)]
            within = (columns >= (start[i] % BLOCK)[:, None]) & (columns <= (last[i] % BLOCK)[:, None])
            out[i] = np.where(within, self._v[a[i]], np.iinfo(out.dtype).max).min(axis=1)
        low, high = self._leaves + a + 1, self._leaves + b  # whole blocks between, [low, high)
        going = np.flatnonzero(low < high)
        while len(going):
            x, y = low[going], high[going]
            left, right = x % 2 == 1, y % 2 == 1
            best = out[going]
            best = np.where(left, np.minimum(best, self._tree[x]), best)
            best = np.where(right, np.minimum(best, self._tree[y - 1]), best)
            out[going] = best
            low[going], high[going] = (x + left) // 2, (y - right) // 2
            going = going[low[going] < high[going]]
        return out


class Shard:
    """The trie of a run of sorted conversations; nodes are numbered in depth-first order, the root is 0."""

    def __init__(self, ids: np.ndarray, keys: list[list[bytes]], sizes: list[list[int]]):
        parens, depth, parent, size, end_of, stack, last = [1], [0], [-1], [0], [], [0], []
        digests = [b""]
        for key, bytes_ in zip(keys, sizes):
            shared = 0
            for x, y in zip(last, key):
                if x != y:
                    break
                shared += 1
            parens += [0] * (len(stack) - 1 - shared)
            del stack[shared + 1:]
            for d in range(shared, len(key)):
                parens.append(1)
                parent.append(stack[-1])
                stack.append(len(depth))
                depth.append(d + 1)
                size.append(bytes_[d])
                digests.append(key[d])
            end_of.append(stack[-1])
            last = key
        parens += [0] * len(stack)
        self.ids, self.end_of = ids, np.array(end_of, np.int64)
        self.depth, self.parent, self.size = np.array(depth, np.int64), np.array(parent, np.int64), np.array(size, np.int64)
        self.n = len(depth)
        # spine: the ways to the first and to the last conversation
        self.spine = np.array(sorted({*range(len(keys[0]) + 1), *stack}), np.int64)
        self.names: dict[int, bytes] = {0: _ROOT}
        for k in self.spine[1:].tolist():
            self.names[k] = hashlib.sha256(self.names[parent[k]] + digests[k]).digest()[:16]
        p = np.array(parens, np.int8)
        excess = np.cumsum(2 * p.astype(np.int32) - 1, dtype=np.int32)
        opens = np.flatnonzero(p)
        closes = BlockMin(excess).next_smaller(opens, excess[opens])
        self.stop = np.cumsum(p, dtype=np.int64)[closes]  # first node after the subtree
        self.pair = p[opens + 1] == 0
        self.ends = np.bincount(self.end_of, minlength=self.n)
        self.first_end = np.searchsorted(self.end_of, np.arange(self.n))  # conversations that end in a node are neighbours
        self.n_convs = self.below(self.ends)
        least = np.full(self.n, _NONE, np.int64)
        np.minimum.at(least, self.end_of, ids)
        self.least = BlockMin(least).minimum(np.arange(self.n), self.stop)
        self.has_child = ~self.pair

    def below(self, weight: np.ndarray) -> np.ndarray:
        """Sum of ``weight`` over each node's subtree, from one cumulative array."""
        total = np.concatenate([[0], np.cumsum(weight)])
        return total[self.stop] - total[:-1]

    def ended(self, node: int) -> np.ndarray:
        """Ids of the conversations that end in a node (ascending, as sorted)."""
        return self.ids[self.first_end[node]:self.first_end[node] + self.ends[node]]


def _joined(ids: np.ndarray) -> bytes:
    return ",".join(map(str, ids.tolist())).encode()


def _shard(table: pa.Table) -> Shard:
    table = table.take(pa.array(np.argsort(table.column("place").to_numpy(), kind="stable")))
    return Shard(table.column("conv_id").to_numpy(), table.column("keys").to_pylist(), table.column("sizes").to_pylist())


SPINE = "node binary, part long, depth long, n_convs long, least long, inner boolean, n_ends long, chunk long, ids binary"
ROWS = "node binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def spines(table: pa.Table) -> pa.Table:
    """What a shard knows of its spine nodes alone (``chunk`` null), and the lists of ids that end in the first and in the last of them."""
    s, part = _shard(table), table.column("part")[0].as_py()
    own = s.spine
    listed = sorted({int(s.end_of[0]), int(s.end_of[-1])})
    chunks = [(s.names[k], i, _joined(ids[i * CHUNK_IDS:(i + 1) * CHUNK_IDS])) for k in listed for ids in [s.ended(k)] for i in range(-(-len(ids) // CHUNK_IDS))]
    n, m = len(own), len(chunks)
    none = [None] * m
    return pa.table({
        "node": pa.array([s.names[k] for k in own.tolist()] + [c[0] for c in chunks], pa.binary()), "part": pa.array([part] * (n + m), pa.int64()),
        "depth": pa.array(s.depth[own].tolist() + none, pa.int64()), "n_convs": pa.array(s.n_convs[own].tolist() + none, pa.int64()),
        "least": pa.array(s.least[own].tolist() + none, pa.int64()), "inner": pa.array(s.has_child[own].tolist() + none, pa.bool_()),
        "n_ends": pa.array(s.ends[own].tolist() + none, pa.int64()), "chunk": pa.array([None] * n + [c[1] for c in chunks], pa.int64()),
        "ids": pa.array([None] * n + [c[2] for c in chunks], pa.binary())})


def settled(table: pa.Table, merged: pa.Table) -> pa.Table:
    """Rows of a shard's nodes; those of spine nodes (``node`` not null) hold what this shard adds to them."""
    s, part = _shard(table), table.column("part")[0].as_py()
    known = {r["node"]: r for r in merged.to_pylist()}
    n_convs, least, opened, leaf = s.n_convs.copy(), s.least.copy(), np.ones(s.n, bool), s.pair.copy()
    for k, name in s.names.items():
        r = known[name]
        n_convs[k], least[k], opened[k], leaf[k] = r["n_convs"], r["conv_id"], r["first_part"] == part, not r["inner"]
    leaf &= opened
    children = np.bincount(s.parent[1:][opened[1:]], minlength=s.n)
    leaves, saved = s.below(leaf), s.below(np.where(opened, (n_convs - 1) * s.size, 0))
    hashes = [_EMPTY] * s.n
    for k in np.flatnonzero(s.ends).tolist():
        hashes[k] = hashlib.sha256(_joined(s.ended(k))).hexdigest()
    names: list[bytes | None] = [None] * s.n
    for k, name in s.names.items():
        names[k] = name
    parents = pa.array(np.where(s.parent >= 0, least[s.parent], 0), pa.int64(), mask=s.parent < 0)
    return pa.table({"node": pa.array(names, pa.binary()), "conv_id": least, "depth": s.depth, "parent_conv_id": parents, "n_convs": n_convs,
                     "n_children": children, "n_leaves": leaves, "saved_tokens": saved, "ends_sha256": pa.array(hashes, pa.string())})


def _hash_streams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """sha256 of each node's list, whose pieces follow each other in order; one piece is held at a time."""
    node, h = None, None
    for batch in batches:
        for name, ids in zip(batch.column("node").to_pylist(), batch.column("ids").to_pylist()):
            if name != node:
                if node is not None:
                    yield pa.RecordBatch.from_pydict({"node": [node], "streamed": [h.hexdigest()]})
                node, h = name, hashlib.sha256(ids)
            else:
                h.update(b"," + ids)
    if node is not None:
        yield pa.RecordBatch.from_pydict({"node": [node], "streamed": [h.hexdigest()]})


def trie(conversations: DataFrame, shard_turns: int = SHARD_TURNS) -> DataFrame:
    """One row per node of the trie over (conv_id, turns) rows, as ``sequences`` gives them (``conv_id`` unique).

    Returns conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens and ends_sha256
    (of the members that end here). A node is named by (conv_id, depth).
    """
    rows = conversations.select("conv_id", F.col("turns.digest").alias("keys"), F.col("turns.bytes").alias("sizes"), F.greatest(F.size("turns"), F.lit(1)).cast("long").alias("weight"))
    shards = sorted_parts(stored(rows, "trie-sequences"), [F.asc("keys"), F.asc("conv_id")], "trie-shards", shard_turns, "weight").drop("weight")
    found = stored(shards.groupBy("part").applyInArrow(spines, SPINE), "trie-spines")
    own = found.where("chunk is null")
    merged = own.groupBy("node").agg(F.min("part").alias("first_part"), F.sum("n_convs").alias("n_convs"), F.min("least").alias("conv_id"), F.max("inner").alias("inner"),
                                     F.sum((F.col("n_ends") > 0).cast("long")).alias("end_parts"))
    merged = stored(merged, "trie-merged")
    # lists that run over several shards: pieces in shard order are the list in order
    long = found.where("chunk is not null").join(merged.where("end_parts > 1").select("node"), "node", "left_semi").select("node", "part", "chunk", "ids")
    streamed = long.repartition("node").sortWithinPartitions("node", "part", "chunk").select("node", "ids").mapInArrow(_hash_streams, "node binary, streamed string")
    context = own.select("part", "node").join(merged.drop("end_parts"), "node")
    out = stored(shards.groupBy("part").cogroup(context.groupBy("part")).applyInArrow(settled, ROWS), "trie-rows")
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    empty = F.lit(_EMPTY)
    spine = out.where("node is not null").groupBy("node").agg(
        *[F.min(c).alias(c) for c in columns[:4]], *[F.sum(c).alias(c) for c in columns[4:7]],
        F.coalesce(F.max(F.when(F.col("ends_sha256") != empty, F.col("ends_sha256"))), empty).alias("ends_sha256"))
    spine = spine.join(streamed, "node", "left").withColumn("ends_sha256", F.coalesce("streamed", "ends_sha256"))
    return out.where("node is null").select(columns).unionByName(spine.select(columns))


def rebuilt(own: DataFrame) -> DataFrame:
    """Conversations of the query: the first h turns of conversation c - c % 5, then c's own turns after its first h,
    with h = crc32(c as text) % 9 (% as in SQL: the remainder has the sign of c)."""
    c = F.col("conv_id")
    heads = own.where(c % 5 == 0).select(c.alias("base"), F.slice("turns", 1, 8).alias("head"))
    h = (F.crc32(c.cast("string").cast("binary")) % 9).cast("int")
    both = own.withColumn("base", c - c % 5).withColumn("h", h).join(heads, "base", "left")
    start = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.array().cast(own.schema["turns"].dataType))
    return both.select("conv_id", F.concat(start, F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0)))).alias("turns"))


def nodes(conversations: DataFrame) -> DataFrame:
    """Query form."""
    return trie(rebuilt(stored(sequences(conversations), "trie-own")))
