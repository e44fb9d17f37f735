"""Operator 11 against a tree built by hand."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from ebbtide.llm import merkle
from tests.llm.conftest import SCHEMA, rows


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(r, more=0):
    n = None if r["n_chars"] is None else r["n_chars"] + more
    values = (r["doc_id"], r["source"], r["lang"], n, r["text"])
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i:i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def path(tree, i):
    out = []
    for level in tree[:-1]:
        out.append((i & 1, level[i ^ 1] if i ^ 1 < len(level) else None))
        i >>= 1
    return out


def by_hand(table):
    groups = {}
    for r in table:
        groups.setdefault(r["lang"], []).append(r)
    names = sorted(groups, key=lambda k: (k is not None, (k or "").encode()))
    for rs in groups.values():
        rs.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf(r)))
    trees = [levels([leaf(r) for r in groups[k]]) for k in names]
    top = levels([t[-1][0] for t in trees]) if trees else [[]]
    for g, k in enumerate(names):
        for i, r in enumerate(groups[k]):
            way = path(trees[g], i) + path(top, g)
            at = leaf(r, int(r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0))
            for left, other in way:
                at = h(at) if other is None else h(other, at) if left else h(at, other)
            yield (r["doc_id"], leaf(r), trees[g][-1][0], top[-1][0], h(*(o for _, o in way if o)), at, at == top[-1][0])


def key(r):
    return tuple((v is not None, str(v)) for v in r)


def check(df):
    want = sorted(by_hand([r.asDict() for r in df.collect()]), key=key)
    got = sorted((tuple(r) for r in merkle.digest(df).collect()), key=key)
    assert got == want


def test_rows_of_every_kind(docs, empty):
    check(docs)
    assert merkle.digest(empty).count() == 0 and merkle.manifest(empty).root() is None


def test_whole_table(spark, sf_small):
    check(spark.read.parquet(f"{sf_small}/documents.parquet"))


@pytest.mark.parametrize("part,bits", [(1, 2), (3, 1), (7, 3), (50, 16)])
def test_any_cut_into_parts_and_blocks(spark, monkeypatch, part, bits):
    """Groups over many parts, parts over many groups, several rounds of combining, repeated rows."""
    monkeypatch.setattr(merkle, "BLOCK_BITS", bits)
    monkeypatch.setattr(merkle, "PART_LEAVES", part)
    r = random.Random(part)
    table = [(i if r.random() < 0.9 else None, f"t{i % 5}", r.choice(["a", "a", "a", None, "é", "z", f"l{i}"]), "s", i, "x", None, "y") for i in range(120)]
    df = spark.createDataFrame(table + table[:9], SCHEMA)
    m = merkle.manifest(df, part_leaves=part, keep={"text": F.col("text")})
    p = merkle.proofs(m).collect()
    want = sorted((w[:5] for w in by_hand([x.asDict() for x in df.collect()])), key=key)
    got = sorted(((x.id, x.leaf, x.subroot, x.root, h(*(n.hash for n in x.proof if n.hash))) for x in p), key=key)
    assert got == want and {x.root for x in p} == {m.root()}


def test_octopus_asks_for_no_node_that_follows():
    r = random.Random(3)
    for n in (1, 2, 3, 5, 8, 13, 31, 64):
        for _ in range(20):
            own = np.array(sorted(r.sample(range(n), r.randrange(1, n + 1))))
            need = merkle.missing(own, n)
            known = {(0, int(i)) for i in own} | set(need)
            assert len(known) == len(own) + len(need)
            for level, width in enumerate(merkle.sizes(n)[:-1]):
                for i in range(0, width, 2):
                    have = [(level, i) in known, i + 1 >= width or (level, i + 1) in known]
                    if all(have):
                        assert (level + 1, i // 2) not in known  # derived, hence never fetched
                        known.add((level + 1, i // 2))
            assert (len(merkle.sizes(n)) - 1, 0) in known


def test_verified_rejects_a_changed_row(spark, docs):
    few = docs.where("doc_id in (1, 4, 9, 12)").dropDuplicates(["doc_id"])
    m = merkle.manifest(few, keep={c: F.col(c) for c in ("text", "source", "n_chars")})
    p = merkle.proofs(m).withColumnsRenamed({"id": "doc_id", "group": "lang"})
    assert {r[0] for r in p.select(merkle.verified(p, m.root())).collect()} == {True}
    bad = p.withColumn("text", F.concat("text", F.lit(".")))
    assert {r[0] for r in bad.select(merkle.verified(bad, m.root())).collect()} == {False}
