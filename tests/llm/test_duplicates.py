"""Operators 4 and 5, components and the pipeline against brute force."""

import collections
import hashlib
import itertools
import random
import re

import numpy as np

from ebbtide.llm import minhash, suffixes
from ebbtide.llm.components import components
from ebbtide.llm.shingles import resembles
from tests.llm.conftest import prose, rows

LENGTH_AFTER = suffixes.LENGTH - suffixes.GRAM


def word_sets(pairs):
    out = []
    for d, t in pairs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        out.append((d, frozenset(tuple(w[i:i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    return out


def near(a, b, percent=85):
    return bool(a and b) and 100 * len(a & b) >= percent * len(a | b)


def smallest_reachable(sets, percent=85):
    comp = list(range(len(sets)))
    for i, j in itertools.combinations(range(len(sets)), 2):
        if comp[i] != comp[j] and near(sets[i][1], sets[j][1], percent):
            lo, hi = sorted((comp[i], comp[j]))
            comp = [lo if c == hi else c for c in comp]
    return [min(sets[j][0] for j in range(len(sets)) if comp[j] == comp[i]) for i in range(len(sets))]


def check(spark, pairs):
    got = minhash.near_duplicates(spark.createDataFrame(pairs, "doc_id long, text string").repartition(3)).collect()
    sets = word_sets(pairs)
    want = [(d, len(s), c, c == d) for (d, s), c in zip(sets, smallest_reachable(sets))]
    assert sorted(map(tuple, got)) == sorted(want)


def test_sketches_fill_and_estimate():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 1 << 60, n).astype(np.uint64)) for n in (1, 3, 50, 5000)]
    s = minhash.sketches(sets)
    assert (s != np.iinfo(np.uint64).max).all() and (minhash.sketches(sets[:1]) == s[0]).all()
    base = r.integers(0, 1 << 60, 1000).astype(np.uint64)
    a, b = base[:900], base[100:]  # similarity 0.8
    x, y = minhash.sketches([np.unique(a), np.unique(b)])
    assert abs((x == y).mean() - 0.8) < 0.12 and minhash.missed(0.85) < 1e-6


def test_near_duplicates_with_chains_and_crowds(spark):
    r, out = random.Random(6), []
    for g in range(6):  # near copies of one text, some of which resemble others but not the first
        base = prose(300 + g, 120).split()
        for k in range(12):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = f"new{r.randrange(10**6)}"
            out.append((len(out) * 7 % 101, " ".join(w)))
    check(spark, out + [(200, "a b c"), (201, "A  B\nc"), (202, ""), (203, " ")])


def test_blocks_of_one_bucket(spark, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK_MEMBERS", 3)
    test_near_duplicates_with_chains_and_crowds(spark)


def test_links_between_blocks():
    r = random.Random(2)
    for t in range(60):
        base = [r.randrange(10**6) for _ in range(40)]
        held = [(i, i, np.unique(np.array([x if r.random() > .06 else r.randrange(10**6) for x in base], np.uint64))) for i in range(10)]
        sides = [0] * 10 if t % 2 else [i % 2 for i in range(10)]

        def comp(edges):
            p = list(range(10))
            for _ in p:
                for a, b in edges:
                    p[a] = p[b] = min(p[a], p[b])
            return p

        want = [(a, b) for a in range(10) for b in range(a) if resembles(held[a][2], held[b][2], 85) and (t % 2 or sides[a] != sides[b])]
        assert comp(want) == comp(list(minhash.links_between(held, sides, 85)))


def test_odd_rows_and_representatives(spark, docs, empty):
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(rows())
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[2].component_id == by[1].component_id == 1 and not by[2].kept and by[15].component_id == 14
    assert all(by[d].n_shingles == 0 and by[d].kept for d in (5, 6, 7)) and all(r.kept and r.component_id is None for r in got if r.doc_id is None)
    left = minhash.representatives(docs)
    assert left.columns == docs.columns and left.where("doc_id = 4").count() == 2 and left.where("doc_id = 2").count() == 0
    assert minhash.near_duplicates(empty).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (95, 90), (95, 99), (7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{i: 90 for i in (90, 95, 99, 100)}}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def removed(pairs):
    data = [(d, (t or "").encode()) for d, t in pairs]
    first = {}
    for d, x in sorted(data, key=lambda p: (p[0] is None, p[0] or 0)):
        for i in range(len(x) - 49):
            first.setdefault(x[i:i + 50], 1 << 62 if d is None else d)
    out = collections.Counter()
    for d, x in data:
        gone = bytearray(len(x))
        for i in range(len(x) - 49):
            if first[x[i:i + 50]] < (1 << 62 if d is None else d):
                gone[i:i + 50] = b"\1" * 50
        runs = sum(1 for i, g in enumerate(gone) if g and not (i and gone[i - 1]))
        out[d, len(x), sum(gone), runs, hashlib.sha256(bytes(c for c, g in zip(x, gone) if not g)).hexdigest()] += 1
    return out


def test_anchors_are_the_least_grams():
    r = random.Random(3)
    for t in range(120):
        texts = [bytes(r.choice(b"ab ") for _ in range(r.randint(0, 160))) for _ in range(5)]
        data, bounds = np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in texts])])
        h, width = suffixes.gram_hashes(data), suffixes.LENGTH - suffixes.GRAM + 1
        want = [(s, s + int(np.argmin(h[s:s + width]))) for a, b in zip(bounds, bounds[1:]) for s in range(a, b - 49)]
        _, place, first, last = suffixes.anchors(data, bounds, step=(7, 64, 1 << 20)[t % 3])
        assert want == [(s, p) for p, a, z in zip(place, first, last) for s in range(a, z + 1)]


def test_repeats_against_brute_force(spark, docs, empty):
    r, shared = random.Random(9), [prose(500 + i, 25) for i in range(4)]
    pairs = [(i * 13 % 97, " ".join([prose(i, r.randint(0, 20)), r.choice(shared)[r.randint(0, 30):], "é" * r.randint(0, 70), prose(i + 1, 9)])) for i in range(60)]
    pairs += [(r_[0], r_[1]) for r_ in rows()] + [(98, "ab" * 300), (99, "ab" * 200), (99, "ab" * 200)]
    got = suffixes.digest(spark.createDataFrame(pairs, "doc_id long, text string").repartition(5))
    assert collections.Counter(map(tuple, got.collect())) == removed(pairs)
    assert suffixes.digest(empty).count() == 0


def test_repeats_across_ranges_of_one_gram(spark):
    """One passage of 24 to 49 bytes in every document, so that its suffixes fill all ranges; windows repeat across them."""
    r = random.Random(11)
    gram, tails = "the same notice stands in all of these ", [prose(700 + i, 12) for i in range(9)]
    pairs = [(i * 37 % 401, " ".join([prose(i, 6), r.choice(tails)[:r.randint(0, 40)], gram + r.choice(tails)[:r.randint(5, 60)], prose(i + 5, 4)])) for i in range(400)]
    got = suffixes.digest(spark.createDataFrame(pairs, "doc_id long, text string").repartition(7))
    assert collections.Counter(map(tuple, got.collect())) == removed(pairs)


def test_chunks_and_ranges_compare_like_one(monkeypatch):
    """Windows removed within chunks and across their boundaries are those of one comparison, wherever the cuts lie."""
    monkeypatch.setattr(suffixes, "CHUNK_WINDOWS", 40)
    r = random.Random(4)
    for t in range(60):
        held = []
        for i in range(r.randint(1, 50)):  # (suffix, doc, task, row, start) as the operator deals them
            place = r.randint(0, 26)
            lead = r.choice([b"a" * 24, b"ab" * 12, bytes(r.choice(b"ab") for _ in range(24))])
            n = r.randint(1, place + 1)
            after = lead + bytes(r.choice(b"ab" if r.random() < .1 else b"a") for _ in range(LENGTH_AFTER - place + n - 1))
            held.append((after + b"a" * place + bytes((place,)), r.randrange(9), 0, i, 0))
        held.sort(key=lambda x: x[:2])
        cuts = sorted(r.choices(range(len(held) + 1), k=t % 4))
        stretches, edges, windows = [], [], collections.defaultdict(list)
        for a, b in zip([0, *cuts], [*cuts, len(held)]):
            part, last = suffixes._Range(), (None, None)
            for x in held[a:b]:
                if x[0] == last[0] and x[1] > last[1]:
                    stretches.append((x[3], 0, len(x[0]) - 1))
                    continue
                last = x[:2] if x[0] != last[0] else last
                part.take(*x)
            part.end()
            stretches += [f[1:4] for f in part.found if f[4] is None]
            edges += [f[1:] for f in part.found if f[4] is not None]
        least = {}
        for _, _, _, w, d in edges:
            least[w] = min(d, least.get(w, d))
        stretches += [(row, a, b) for row, a, b, w, d in edges if d > least[w]]
        for suffix, d, _, row, _ in held:
            place = suffix[-1]
            text = suffix[-1 - place:-1] + suffix[:-1 - place]
            for i in range(len(text) - 49):
                windows[text[i:i + 50], place - i].append((d, row, i))
        want = {(row, i) for found in windows.values() for d, row, i in found if d > min(found)[0]}
        assert want == {(row, i) for row, a, b in stretches for i in range(a, b - 49)}


def test_pipeline_stages(spark, sf_small):
    import corpus_pipeline
    from ebbtide.llm import decontaminate, pii
    docs = spark.read.parquet(f"{sf_small}/documents.parquet")
    items = [r.text for r in spark.read.parquet(f"{sf_small}/benchmark.parquet").collect()]
    before = {r.doc_id: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_small)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after = {r.doc_id: r for r in docs.collect()}
        if name == "near_duplicates":
            comp = dict(zip(before, smallest_reachable(word_sets([(d, r.text) for d, r in before.items()]), minhash.LOOSE_PERCENT)))
            assert set(after) == {d for d, c in comp.items() if c == d}
        elif name == "decontamination":
            assert set(after) == {d for d, r in before.items() if not decontaminate.Matcher(items).matches(r.text)}
        elif name == "personal_data":
            finder = pii.Finder()
            assert {d: r.text for d, r in after.items()} == {d: pii.redact_text(r.text, finder.spans(r.text)) for d, r in before.items()}
            assert all(r.n_chars == len(r.text) for r in after.values())
        else:
            assert set(after) == set(before)  # all of these documents have a clear language
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_small).collect()
    assert {r.doc_id for r in pieces} == set(before)


def test_pipeline_drops_near_copies_from_similarity_80(spark):
    import corpus_pipeline
    words = [f"word{i}" for i in range(104)]  # 100 shingles; each changed word far from the others is in five
    docs = [(1, " ".join(words)), (2, " ".join("other" if i in (20, 60) else w for i, w in enumerate(words))),
            (3, " ".join(f"o{i}" if i in (20, 50, 80) else w for i, w in enumerate(words)))]
    sets = [s for _, s in word_sets(docs)]
    likeness = [len(sets[0] & s) / len(sets[0] | s) for s in sets[1:]]
    assert 0.80 <= likeness[0] < 0.85 and likeness[1] < 0.80
    df = spark.createDataFrame([(d, t, "en", "s", len(t)) for d, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, "").collect()} == {1, 3}
    assert minhash.representatives(df).count() == 3  # the query of operator 4 keeps its 0.85
    assert minhash.missed(0.8, minhash.LOOSE_BANDS, minhash.LOOSE_ROWS) <= minhash.missed(0.85)


def test_pipeline_on_odd_rows(spark, docs, empty, tmp_path):
    """Nulls, empty, tied, repeated and very long texts and columns that operators use inside, through all stages; then no rows."""
    import corpus_pipeline
    clashing = docs.selectExpr("*", "doc_id AS _dropped", "text AS p", "n_chars AS component", "doc_id AS rep", "lang AS language")
    spark.createDataFrame([(1, "a passage that no document of this table holds anywhere at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    known = {d: t for d, t, *_ in rows()}
    df, kept = clashing, []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        df = stage(spark, df, str(tmp_path))
        assert df.columns == clashing.columns
        kept.append({r.doc_id for r in df.collect()})
        assert kept[-1] <= (kept[-2] if len(kept) > 1 else set(known))
    assert not {5, 6, 7} & kept[0] and {1, 4, 9, None} <= kept[0]  # no text or no letter goes, whatever else is odd stays
    assert 2 not in kept[1] and {1, 4, 9, None} <= kept[1]  # 2 is a copy of 1; rows without an id are never dropped as copies
    assert {1, 4, 9, None} <= kept[3]
    assert {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, df, str(tmp_path)).collect()} == kept[3]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0
