"""Near-duplicate documents by fast similarity sketching, banding and exact verification (operator 4).

A document is its set of distinct five-word shingles. Its sketch has ``COORDINATES`` places: in round after
round every shingle is thrown into one place and leaves its hash there if it is the smallest of the round; a
place filled in an earlier round is final. Places still empty after as many rounds as there are places are
filled one by one from all shingles, so every place fills, at about one hash per shingle for all but short
texts. Sketches are cut into bands; documents that agree on a band meet in a bucket.

Equal sets are one class from the start (a hash of the whole set), so copies never meet as pairs. In a bucket
the smallest member is compared with all others, on their full sets, and components are drawn from the links
found. Buckets that still hold members of different components are compared within tasks: their members are
dealt into blocks of bounded size, two blocks meet in a task, and every pair of different components is
counted exactly there; only links leave the task. So no link within a bucket is lost, no bucket is capped and
no list of pairs is made; a pair at the threshold shares no bucket with probability 3e-7, see ``missed``.

Defined results: a null or blank text has no shingles, is linked with nothing and kept; a row with a null
``doc_id`` is not linked, its component is null and it is kept; rows that share a ``doc_id`` are judged each
by its own text; equal rows are all kept or all dropped; an empty table gives no rows; other columns are not
read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm import shingles, tokens
from ebbtide.llm.components import components
from ebbtide.llm.store import stored

SHINGLE_WORDS = 5
PERCENT = 85
BANDS, BAND_ROWS = 32, 6
COORDINATES = BANDS * BAND_ROWS
LOOSE_PERCENT, LOOSE_BANDS, LOOSE_ROWS = 80, 39, 5  # the pipeline's threshold, missed no more often there than 85 by the bands above
MEMBERS_PER_TASK = 256  # members of one head that are compared in one stretch of rows
BROADCAST_PAIRS = 500_000  # 16 bytes each; more pairs are joined by a shuffle
SLICE_BYTES = 4 << 20  # text whose shingles one numpy step works on
BLOCK_MEMBERS, BLOCK_SHINGLES = 1024, 4 << 20  # of a bucket with different components; two blocks meet in a task
_U = np.uint64


def missed(similarity: float, bands: int = BANDS, rows: int = BAND_ROWS) -> float:
    """Probability that a pair of that similarity shares no bucket."""
    return (1 - similarity ** rows) ** bands


def sketches(sets: list[np.ndarray], coordinates: int = COORDINATES) -> np.ndarray:
    """A row of ``coordinates`` 64-bit values per set; the sets must not be empty."""
    empty = np.iinfo(_U).max
    out = np.full((len(sets), coordinates), empty, _U)
    flat = np.concatenate(sets) if sets else np.zeros(0, _U)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    places = out.reshape(-1)
    with np.errstate(over="ignore"):
        for step in range(2 * coordinates):
            if not len(flat):
                break
            h = shingles.mix(flat + _U(step + 1) * _U(0x9E3779B97F4A7C15))
            place = (h >> _U(32)) % _U(coordinates) if step < coordinates else np.full(len(flat), step - coordinates, _U)
            np.minimum.at(places, owner * coordinates + place.astype(np.int64), (_U(step) << _U(32)) | (h & _U(0xFFFFFFFF)))
            open_sets = np.unique(owner)
            open_sets = open_sets[(out[open_sets] == empty).any(axis=1)]
            if step >= coordinates or len(open_sets) < len(sets):
                goes_on = np.zeros(len(sets), bool)
                goes_on[open_sets] = True
                keep = goes_on[owner]
                flat, owner = flat[keep], owner[keep]
    return out


def band_keys(sketch: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """One 64-bit key per band and sketch; keys of different bands differ."""
    rows = sketch.reshape(len(sketch), bands, -1)
    key = np.tile(np.arange(1, bands + 1, dtype=_U), (len(sketch), 1))
    for i in range(rows.shape[2]):
        key = shingles.mix(key * _U(0xD6E8FEB86659FD93) + rows[:, :, i])
    return key.view(np.int64)


def signatures(docs: DataFrame, id_col: str, text_col: str, bands: int = BANDS, band_rows: int = BAND_ROWS) -> DataFrame:
    """doc_id, n (set size), f1 and f2 (128-bit hash of the set, null without shingles), bands."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash
        for batch in batches:
            for part in tokens.slices(batch, "text", SLICE_BYTES):
                sets = list(shingles.shingle_sets(part.column("text"), SHINGLE_WORDS))
                some = [i for i, s in enumerate(sets) if len(s)]
                keys = iter(band_keys(sketches([sets[i] for i in some], bands * band_rows), bands).tolist())
                prints = [np.frombuffer(xxhash.xxh3_128_digest(s.tobytes()), "<i8").tolist() if len(s) else (None, None) for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(map(len, sets), pa.int64()), pa.array([p[0] for p in prints], pa.int64()),
                     pa.array([p[1] for p in prints], pa.int64()), pa.array([next(keys) if len(s) else [] for s in sets], pa.list_(pa.int64()))],
                    ["doc_id", "n", "f1", "f2", "bands"])
        tokens.release_memory()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n long, f1 long, f2 long, bands array<long>")


def linked(pairs: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) whose full sets resemble each other.

    A head ``a`` with many members is spread over stretches of rows: its text goes once to each stretch, then
    the members' texts stream past it. Only texts of documents in pairs are moved.
    """
    n = pairs.count()
    rows = docs.select(F.col(id_col).cast("long").alias("b"), F.col(text_col).alias("text"))
    size = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / MEMBERS_PER_TASK).alias("parts"))
    dealt = pairs.join(size, "a").withColumn("part", F.pmod(F.xxhash64("b"), F.col("parts"))).select("a", "part", "b")
    wanted = dealt.withColumn("member", F.lit(1)).unionByName(dealt.select("a", "part", F.col("a").alias("b"), F.lit(0).alias("member")).distinct())
    wanted = stored(wanted, "verify")
    wanted = F.broadcast(wanted) if n <= BROADCAST_PAIRS else wanted
    texts = rows.join(wanted, "b").select("a", "part", "member", "b", "text")
    texts = texts.repartition("a", "part").sortWithinPartitions("a", "part", "member", "b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, heads = None, []
        for batch in batches:
            for piece in tokens.slices(batch, "text", SLICE_BYTES):
                found = []
                sets = shingles.shingle_sets(piece.column("text"), SHINGLE_WORDS)
                for a, part, member, b, s in zip(*(piece.column(c).to_pylist() for c in ("a", "part", "member", "b")), sets):
                    if (a, part) != at:
                        at, heads = (a, part), []
                    if not member:
                        heads.append(s)  # more than one only where rows share a doc_id
                    elif any(shingles.resembles(h, s, percent) for h in heads):
                        found.append((a, b))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

    return texts.mapInArrow(run, "a long, b long")


def links_between(rows: list[tuple[int, int, np.ndarray]], sides: list[int], percent: int) -> Iterator[tuple[int, int]]:
    """Links that connect different components among (doc_id, label, set) rows of one or two sides (0, 1).

    Rows of two sides are compared across, rows of one side with each other. Common shingles are counted for
    one row against all others at once, through lists of the rows that hold each shingle.
    """
    both = len(set(sides)) == 2
    parent: dict[int, int] = {label: label for _, label, _ in rows}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    size = np.array([len(s) for _, _, s in rows])
    _, local = np.unique(np.concatenate([s for _, _, s in rows]), return_inverse=True)
    owner = np.repeat(np.arange(len(rows)), size)
    order = np.argsort(local, kind="stable")
    holders, starts = owner[order], np.concatenate([[0], np.cumsum(np.bincount(local))])
    bounds = np.concatenate([[0], np.cumsum(size)])
    for i in range(len(rows)):
        if both and sides[i]:
            continue
        if len({root(label) for _, label, _ in rows}) == 1:
            return
        mine = local[bounds[i]:bounds[i + 1]]
        held = np.concatenate([holders[starts[x]:starts[x + 1]] for x in mine.tolist()]) if len(mine) else mine
        common = np.bincount(held, minlength=len(rows))
        alike = np.flatnonzero(100 * common >= percent * (size + size[i] - common))
        for j in alike.tolist():
            if (sides[j] if both else j > i) and root(rows[i][1]) != root(rows[j][1]):
                parent[root(rows[i][1])] = root(rows[j][1])
                yield rows[i][0], rows[j][0]


def linked_in_buckets(mixed: DataFrame, docs: DataFrame, id_col: str, text_col: str, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) between different components within buckets; ``mixed`` has key, rep, n and label."""
    size = mixed.groupBy("key").agg(F.ceil(F.greatest(F.count(F.lit(1)) / BLOCK_MEMBERS, F.sum("n") / BLOCK_SHINGLES)).alias("blocks"))
    dealt = mixed.join(size, "key").withColumn("own", F.pmod(F.xxhash64("rep", "key"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = stored(dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "label",
                                (F.col("own") > F.col("other")).cast("int").alias("side")), "blocks")
    rows = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    texts = rows.join(F.broadcast(dealt) if dealt.count() <= BROADCAST_PAIRS else dealt, "rep")
    texts = texts.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held, sides = None, [], []

        def links() -> Iterator[pa.RecordBatch]:
            if held and (at[1] == at[2] or len(set(sides)) == 2):
                found = list(links_between(held, sides, percent))
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found)], ["a", "b"])

        for batch in batches:
            for piece in tokens.slices(batch, "text", SLICE_BYTES):
                columns = (piece.column(c).to_pylist() for c in ("key", "i", "j", "rep", "label", "side"))
                for key, i, j, rep, label, side, s in zip(*columns, shingles.shingle_sets(piece.column("text"), SHINGLE_WORDS)):
                    if (key, i, j) != at:
                        yield from links()
                        at, held, sides = (key, i, j), [], []
                    held.append((rep, label, s))
                    sides.append(side)
        yield from links()

    return texts.mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, bands: int = BANDS,
                    band_rows: int = BAND_ROWS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept. ``bands`` of ``band_rows`` should suit ``percent``, see ``missed``."""
    signed = stored(signatures(docs, id_col, text_col, bands, band_rows), "signatures")
    usable = signed.where("n > 0 and doc_id is not null")
    classes = stored(usable.groupBy("f1", "f2").agg(F.min("doc_id").alias("rep"), F.any_value("n").alias("n"), F.any_value("bands").alias("bands")), "classes")
    member = classes.select("rep", "n", F.explode("bands").alias("key")).distinct()
    heads = member.groupBy("key").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("rep", "n")).alias("h")).where("c > 1")
    heads = heads.select("key", F.col("h.rep").alias("a"), F.col("h.n").alias("an"))
    buckets = stored(member.join(heads, "key"), "buckets")
    near = (F.col("rep") != F.col("a")) & (100 * F.least("n", "an") >= percent * F.greatest("n", "an"))
    pairs = stored(buckets.where(near).select("a", F.col("rep").alias("b")).distinct(), "pairs")
    links = stored(linked(pairs, docs, id_col, text_col, percent), "links")
    labelled = buckets.join(components(links).withColumnRenamed("node", "rep"), "rep", "left")
    labelled = stored(labelled.select("key", "rep", "n", "a", F.coalesce("component", "rep").alias("label")), "labelled")
    # heads are done: what may be left in a bucket are pairs of its other members, if their components differ
    others = labelled.where("rep <> a")
    mixed = others.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    found = stored(linked_in_buckets(others.join(mixed, "key").select("key", "rep", "n", "label"), docs, id_col, text_col, percent), "more-links")
    named = components(links.unionByName(found)).withColumnRenamed("node", "rep")
    named = classes.select("f1", "f2", "rep").join(named, "rep", "left").select("f1", "f2", F.coalesce("component", "rep").alias("component"))
    known = usable.join(named, ["f1", "f2"]).select("doc_id", "n", "component")
    alone = signed.where("n = 0 or doc_id is null").select("doc_id", "n", F.col("doc_id").alias("component"))
    rows = known.unionByName(alone)
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, bands: int = BANDS,
                    band_rows: int = BAND_ROWS) -> DataFrame:
    """The documents (all columns) with one of each group left; rows that repeat a kept document stay."""
    dropped = near_duplicates(docs, id_col, text_col, percent, bands, band_rows).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(dropped, docs[id_col].cast("long") == dropped["doc_id"], "left_anti")
