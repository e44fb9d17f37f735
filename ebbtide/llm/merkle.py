"""Merkle manifest of a dataset with proofs for every row (operator 11).

A row's leaf is the sha256 of its fields. The leaves of a group (a language) in id order form a tree in which every
two neighbours (the last may stand alone) become their hash; the groups' roots, in group order, form a tree of their
own, whose top is the dataset's root. A change of any field, a missing or a moved row changes the root.

The leaves are sorted into parts (``ranges.sorted_parts``). A part hashes the subtrees that lie within it and reports
the highest of them; the few nodes that span parts are combined in rounds of aligned blocks of 2**16. For the proofs,
each part works out the minimal union of node coordinates that its own leaves lack (an octopus multiproof), all of
these are fetched by one join, and within the part the shared interiors are derived once and every row's proof is
read off them.

Defined results: a null field is ``-``; a null ``doc_id`` sorts first, and so does a null group, which is a group
like any other; rows with equal id are ordered by their leaf, so repeated rows are neighbours with equal leaves and
proofs of their own; an empty table gives no rows; columns that are not named as fields are not read.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.llm.ranges import sorted_parts
from ebbtide.llm.store import stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
PART_LEAVES = 1 << 15
BLOCK_BITS = 16  # levels that one round of combining climbs
TOP = -1  # number of the tree over the groups' roots


def _h(*parts: str) -> str:
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_hash(columns: list[Column]) -> Column:
    """sha256 of the values, each written as byte count, colon and value (``-`` if null)."""
    def written(c: Column) -> Column:
        s = c.cast("string")
        return F.coalesce(F.concat(F.octet_length(s).cast("string"), F.lit(":"), s), F.lit("-"))
    return F.sha2(F.concat(*[written(c) for c in columns]), 256)


def sizes(n: int) -> list[int]:
    """Nodes on each level of a tree over ``n`` leaves, up to the one root."""
    out = [n]
    while out[-1] > 1:
        out.append(-(-out[-1] // 2))
    return out


def missing(index: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Octopus multiproof: (level, index) of the nodes that the leaves at ``index`` (sorted, distinct) of a tree over
    ``n`` leaves lack on their ways to the root; every other node on those ways follows from them."""
    out = []
    for level, width in enumerate(sizes(n)[:-1]):
        beside = index ^ 1
        lacking = np.setdiff1d(beside[beside < width], index, assume_unique=True)
        out += [(level, i) for i in lacking.tolist()]
        index = np.unique(index >> 1)
    return out


def _climb(nodes: dict[int, str], width: int) -> dict[int, str]:
    """The parents that follow from the known nodes of a level with ``width`` nodes."""
    out = {}
    for i in nodes:
        if i % 2 == 0 and i + 1 in nodes:
            out[i // 2] = _h(nodes[i], nodes[i + 1])
        elif i % 2 == 0 and i + 1 == width:
            out[i // 2] = _h(nodes[i])
    return out


def _highest(first: int, leaves: list[str], n: int):
    """(level, index, hash) of the subtrees within a run of leaves that are in no larger one within it."""
    known = dict(enumerate(leaves, first))
    for level, width in enumerate(sizes(n)):
        above = _climb(known, width) if width > 1 else {}
        yield from ((level, i, h) for i, h in known.items() if i // 2 not in above)
        known = above


NODE = "tree long, leaves long, level int, index long, hash string"
NODE_TYPES = {"tree": pa.int64(), "leaves": pa.int64(), "level": pa.int32(), "index": pa.int64(), "hash": pa.string()}


def _table(rows: list[tuple], types: dict[str, pa.DataType]) -> pa.Table:
    columns = zip(*rows) if rows else [()] * len(types)
    return pa.table([pa.array(c, t) for c, t in zip(columns, types.values())], list(types))


def _combined(nodes: DataFrame, tallest: int) -> DataFrame:
    """``nodes`` (in no larger known subtree each) and all nodes above them, in rounds: one round takes each tree's
    blocks of 2**BLOCK_BITS more leaves to their tops, so a group holds the tops of the blocks below and what parts
    reported within the block, never a tree."""
    def to_level(top: int):
        def block(table: pa.Table) -> pa.Table:
            n, tree = table.column("leaves")[0].as_py(), table.column("tree")[0].as_py()
            widths = sizes(n)
            levels: list[dict[int, str]] = [{} for _ in widths]
            for level, i, h in zip(*(table.column(c).to_pylist() for c in ("level", "index", "hash"))):
                levels[level][i] = h
            rows = []
            for level in range(min(top, len(widths) - 1)):
                for i, h in _climb(levels[level], widths[level]).items():
                    levels[level + 1][i] = h
                    rows.append((tree, n, level + 1, i, h))
            return _table(rows, NODE_TYPES)
        return block

    all_nodes, below = nodes, nodes
    for top in range(BLOCK_BITS, tallest + BLOCK_BITS, BLOCK_BITS):
        low = below.where(F.col("level") < top).withColumn("block", F.expr(f"shiftright(index, {top} - level)"))
        new = stored(low.groupBy("tree", "block").applyInArrow(to_level(top), NODE), "merkle-nodes")
        all_nodes = all_nodes.unionByName(new)
        below = below.where(F.col("level") >= top).unionByName(new.where(F.col("level") == top))
    return all_nodes


@dataclass(frozen=True)
class Manifest:
    leaves: DataFrame  # the rows' columns kept, ``group``, leaf, part, place
    runs: DataFrame  # part, group, tree, first, n, leaves: where a part's rows lie in their trees
    nodes: DataFrame  # tree, leaves, level, index, hash of all nodes that span parts or are highest within one
    groups: DataFrame  # tree, group, leaves, subroot
    n_groups: int

    def root(self) -> str | None:
        if not self.n_groups:
            return None
        return self.nodes.where((F.col("tree") == TOP) & (F.col("level") == len(sizes(self.n_groups)) - 1)).first()["hash"]


def manifest(df: DataFrame, id_col: str = "doc_id", group_col: str = "lang", fields: tuple[str, ...] = FIELDS,
             keep: dict[str, Column] | None = None, part_leaves: int = PART_LEAVES) -> Manifest:
    """Leaves, spanning nodes and group roots of ``df``; ``keep`` names further columns to carry along with each leaf."""
    kept = [c.alias(k) for k, c in (keep or {}).items()]
    hashed = df.select(F.col(id_col).alias("id"), F.col(group_col).alias("group"), leaf_hash([F.col(f) for f in fields]).alias("leaf"), *kept)
    hashed = stored(hashed.withColumn("row", F.monotonically_increasing_id()), "merkle-hashed")  # texts are read and hashed once
    order = [F.asc_nulls_first("group"), F.asc_nulls_first("id"), F.asc("leaf"), F.asc("row")]
    leaves = sorted_parts(hashed, order, "merkle-leaves", part_leaves)

    counts = leaves.groupBy("part", "group").agg(F.min("place").alias("at"), F.count(F.lit(1)).alias("n"))
    of_group = Window.partitionBy("group")  # a row for each part that the group reaches into
    runs = counts.withColumn("first", F.coalesce(F.sum("n").over(of_group.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    runs = runs.withColumn("leaves", F.sum("n").over(of_group))
    begun = F.sum((F.col("first") == 0).cast("long"))
    per_part = runs.groupBy("part").agg(begun.alias("begun"))
    before = per_part.withColumn("before", F.coalesce(F.sum("begun").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # a group's number: groups that begin in earlier parts, and those that begin before it in its first part
    runs = runs.join(before.select("part", "before"), "part").withColumn("rank", begun.over(Window.partitionBy("part").orderBy("at")) - 1)
    runs = runs.withColumn("tree", F.min(F.when(F.col("first") == 0, F.col("before") + F.col("rank"))).over(of_group))
    runs = stored(runs.select("part", "group", "tree", "at", "first", "n", "leaves"), "merkle-runs")
    n_groups, longest = runs.agg(F.coalesce(F.max("tree") + 1, F.lit(0)), F.coalesce(F.max("leaves"), F.lit(1))).first()

    def highest(leaf: pa.Table, run: pa.Table) -> pa.Table:
        hashes = _in_place(leaf, "leaf")
        return _table([(tree, n, *node) for tree, at, first, size, n in _runs(run) for node in _highest(first, hashes[at:at + size], n)], NODE_TYPES)

    reported = leaves.select("part", "place", "leaf").groupBy("part").cogroup(runs.drop("group").groupBy("part")).applyInArrow(highest, NODE)
    nodes = _combined(stored(reported, "merkle-highest"), len(sizes(longest)) - 1)
    height = F.when(F.col("leaves") == 1, 0).otherwise(F.length(F.bin(F.col("leaves") - 1)))  # levels above the leaves
    tops = nodes.where(F.col("level") == height).select("tree", "hash")
    groups = stored(runs.where("first = 0").select("tree", "group", "leaves").join(tops, "tree").withColumnRenamed("hash", "subroot"), "merkle-groups")
    over = groups.select(F.lit(TOP).cast("long").alias("tree"), F.lit(n_groups).cast("long").alias("leaves"), F.lit(0).alias("level"),
                         F.col("tree").alias("index"), F.col("subroot").alias("hash"))
    nodes = stored(nodes.unionByName(_combined(over, len(sizes(n_groups)) - 1 if n_groups else 0)), "merkle-all-nodes")
    return Manifest(leaves, runs, nodes, groups, int(n_groups))


def _in_place(table: pa.Table, column: str) -> list:
    order = np.argsort(table.column("place").to_numpy(), kind="stable")
    return table.column(column).take(pa.array(order)).to_pylist()


def _runs(run: pa.Table) -> list[tuple[int, int, int, int, int]]:
    return sorted(zip(*(run.column(c).to_pylist() for c in ("tree", "at", "first", "n", "leaves"))))


PROOF = "proof array<struct<side: string, hash: string>>"


def proofs(m: Manifest) -> DataFrame:
    """Every leaf row with ``subroot``, ``root`` and its ``proof``: for each level up to the root the side on which the
    sibling stands (``L`` or ``R``; ``-`` with a null hash where the node stands alone) and the sibling's hash."""
    n_groups = m.n_groups

    def lacking(table: pa.Table) -> pa.Table:
        part, runs = table.column("part")[0].as_py(), _runs(table)
        need = [(part, tree, *c) for tree, _, first, size, n in runs for c in missing(np.arange(first, first + size), n)]
        need += [(part, TOP, *c) for c in missing(np.array([r[0] for r in runs]), n_groups)]
        return _table(need, {"part": pa.int64(), "tree": pa.int64(), "level": pa.int32(), "index": pa.int64()})

    need = m.runs.drop("group").groupBy("part").applyInArrow(lacking, "part long, tree long, level int, index long")
    fetched = need.join(m.nodes.select("tree", "level", "index", "hash"), ["tree", "level", "index"])
    none = F.lit(None)
    context = m.runs.select("part", "tree", "at", "first", "n", "leaves", none.cast("int").alias("level"), none.cast("long").alias("index"), none.cast("string").alias("hash"))
    context = stored(context.unionByName(fetched.select("part", "tree", none.cast("long").alias("at"), none.cast("long").alias("first"), none.cast("long").alias("n"),
                                                        none.cast("long").alias("leaves"), "level", "index", "hash")), "merkle-context")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in m.leaves.schema), "subroot string", "root string", PROOF])

    def expand(leaf: pa.Table, around: pa.Table) -> pa.Table:
        given: dict[tuple[int, int], dict[int, str]] = {}
        is_run = np.asarray(around.column("level").is_null())
        runs = _runs(around.filter(pa.array(is_run)))
        for tree, level, i, h in zip(*(around.filter(pa.array(~is_run)).column(c).to_pylist() for c in ("tree", "level", "index", "hash"))):
            given.setdefault((tree, level), {})[i] = h

        def derived(tree: int, known: dict[int, str], n: int) -> list[dict[int, str]]:
            """The nodes of each level that the known leaves and what was fetched give, siblings included."""
            levels = []
            for level, width in enumerate(sizes(n)):
                known = known | given.get((tree, level), {})
                levels.append(known)
                known = _climb(known, width) if width > 1 else {}
            return levels

        def beside(levels: list[dict[int, str]], i: int, n: int) -> list[tuple[str, str | None]]:
            out = []
            for nodes, width in zip(levels, sizes(n)[:-1]):
                out.append(("R" if i % 2 == 0 else "L", nodes[i ^ 1]) if i ^ 1 < width else ("-", None))
                i >>= 1
            return out

        order = np.argsort(leaf.column("place").to_numpy(), kind="stable")
        leaf = leaf.take(pa.array(order))
        hashes, subroot, sides, siblings, count = leaf.column("leaf").to_pylist(), [], [], [], []
        trees = [(tree, at, first, size, n, derived(tree, dict(enumerate(hashes[at:at + size], first)), n)) for tree, at, first, size, n in runs]
        top = derived(TOP, {t[0]: t[5][-1][0] for t in trees}, n_groups)
        for tree, at, first, size, n, levels in trees:
            above = beside(top, tree, n_groups)
            for i in range(first, first + size):
                own = beside(levels, i, n) + above
                sides += [s for s, _ in own]
                siblings += [h for _, h in own]
                count.append(len(own))
            subroot += [levels[-1][0]] * size
        proof = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()),
                                         pa.StructArray.from_arrays([pa.array(sides, pa.string()), pa.array(siblings, pa.string())], ["side", "hash"]))
        for name, col in (("subroot", pa.array(subroot, pa.string())), ("root", pa.array([top[-1][0]] * len(hashes), pa.string())), ("proof", proof)):
            leaf = leaf.append_column(name, col)
        return leaf

    return m.leaves.groupBy("part").cogroup(context.groupBy("part")).applyInArrow(expand, schema)


def folded(leaf: Column, proof: Column) -> Column:
    """The root that a leaf and a proof give."""
    def step(at: Column, node: Column) -> Column:
        return F.sha2(F.when(node["side"] == "L", F.concat(node["hash"], at)).when(node["side"] == "R", F.concat(at, node["hash"])).otherwise(at), 256)
    return F.aggregate(proof, leaf, step)


def verified(df: DataFrame, trusted_root: str, fields: tuple[str, ...] = FIELDS, proof_col: str = "proof") -> Column:
    """Whether a row with its proof belongs to the dataset of ``trusted_root``."""
    return F.coalesce(folded(leaf_hash([df[f] for f in fields]), df[proof_col]) == trusted_root, F.lit(False))


def digest(docs: DataFrame) -> DataFrame:
    """Query form: proofs of all rows, folded again from the rows as a tampered copy has them."""
    tampers = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    changed = F.when(tampers, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    seen = leaf_hash([changed if f == "n_chars" else F.col(f) for f in FIELDS])
    p = proofs(manifest(docs, keep={"seen": seen}))
    fold = p.withColumn("folded_root", folded(F.col("seen"), F.col("proof")))
    return fold.select(F.col("id").cast("long").alias("doc_id"), "leaf", "subroot", "root",
                       F.sha2(F.concat_ws("", F.col("proof.hash")), 256).alias("proof_sha256"), "folded_root",
                       (F.col("folded_root") == F.col("root")).alias("verified"))
