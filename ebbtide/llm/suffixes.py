"""Removal of repeated passages on suffixes of all documents (operator 5).

Every ``LENGTH``-byte string (window) of a document that also begins in a document with a smaller id is
removed. Sorting all suffixes of all documents would move each byte fifty times over, so suffixes begin only
at anchors: places chosen by the content itself (the least hash of a ``GRAM``-byte string within each window),
so that equal windows hold the same anchor at the same place. The steps:

1. Each scan task writes its texts to a file of its own, finds the anchors and sends their hashes, once each,
   to ranges of hashes. A range finds the hashes that more than one document has and answers the tasks that
   sent them. All other suffixes are unique and stay at home.
2. The suffixes that remain (the bytes of the windows that share an anchor) are range-partitioned by their leading
   bytes. The splitters come from the suffixes of every ``SAMPLE_DOCS``-th document; equal suffixes that are too many
   for one range are split by document. Each range is sorted. Equal suffixes are settled in passing: all but the document with the smallest id lose those windows.
   Of different ones the windows are compared by a multikey sort, eight bytes at a time, which leaves a window as soon
   as it is unique; this is done for ``CHUNK_WINDOWS`` windows at once, so memory does not grow with a common gram.
3. A window can also lie beyond a boundary of its chunk or range only if its bytes from the anchor on are those the
   first or last suffix there begins with. Such windows, one copy of each document that is the smallest there, are
   compared across boundaries by one aggregation over all ranges.
4. The removed stretches go back to the task files, where the remaining bytes are put together.

Defined results: a null text is an empty one; a null ``doc_id`` counts as larger than any other and comes
back null; rows with the same ``doc_id`` do not remove each other's bytes; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

import bisect
import hashlib
import io
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm import tokens
from ebbtide.llm.shingles import mix
from ebbtide.llm.store import open_folder, stored, write_file
from ebbtide.session import scratch_path

LENGTH = 50
GRAM = 24
SLICE_BYTES = 4 << 20  # text that a task holds at once, but for a longer single text
STEP_BYTES = 1 << 17  # bytes whose anchors are sought at once; their arrays stay in the processor's cache
CHUNK_WINDOWS = 1 << 19  # windows that one multikey sort works on
RANGE_BYTES = 64 << 20  # bytes of text whose suffixes one range is meant for
SAMPLE_DOCS = 16  # one document in so many gives suffixes for the splitters
SAMPLE_RANGE = 64  # sampled suffixes for each range
SORT_STRETCHES = 1 << 18  # stretches put in order before they are written
_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15 | 1)
_NULL_RANK = np.iinfo(np.int64).max
_STRETCH = ["task", "row", "start", "stop"]
_FOUND = pa.schema([(c, pa.int64()) for c in _STRETCH] + [("window", pa.binary()), ("doc", pa.int64())])


def gram_hashes(data: np.ndarray, size: int = GRAM) -> np.ndarray:
    """A 64-bit hash of the ``size`` bytes at every place where as many are left."""
    n = len(data) - size + 1
    if n <= 0:
        return np.zeros(0, _U)
    total, step, done, part = np.zeros(n, _U), 1, 0, data.astype(_U) + _U(1)
    factor = _BASE
    left = size
    with np.errstate(over="ignore"):
        while left:  # doubling: hashes of 1, 2, 4, ... bytes, put together to ``size``
            if left & 1:
                total = total * factor + part[done:done + n]
                done += step
            left >>= 1
            if left:
                part = part[:-step] * factor + part[step:]
                factor = factor * factor
                step *= 2
        return mix(total + _U(size))


def _sliding(values: np.ndarray, width: int, least: bool) -> np.ndarray:
    """Minimum (or maximum) of every ``width`` neighbours."""
    pick = np.minimum if least else np.maximum
    step = 1
    while step * 2 <= width:
        values = pick(values[:-step], values[step:])
        step *= 2
    return pick(values[:len(values) - (width - step)], values[width - step:]) if width > step else values


def anchors(data: np.ndarray, bounds: np.ndarray, length: int = LENGTH, gram: int = GRAM, step: int = STEP_BYTES) -> tuple[np.ndarray, ...]:
    """``anchors_of`` over stretches of ``step`` windows, so that memory stays the same for texts of any length.
    A run of windows that a stretch ends in is given in two parts."""
    parts = []
    for a in range(0, max(len(data), 1), step):
        piece = data[a:a + step + length - 1]
        lo, hi = np.searchsorted(bounds, [a, a + len(piece)])
        cut = np.concatenate([[a], bounds[lo:hi], [a + len(piece)]])
        h, *places = anchors_of(piece, cut - a, length, gram)
        parts.append((h, *(p + a for p in places)))
    return tuple(np.concatenate(c) for c in zip(*parts))


def anchors_of(data: np.ndarray, bounds: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """For texts one after the other: (gram hash, anchor place, first window, last window) of every run of
    windows that share their anchor. A window's anchor is the least gram in it, the first one of equals."""
    width = length - gram + 1
    h = gram_hashes(data, gram)
    if len(h) < width:
        return np.zeros(0, _U), *(np.zeros(0, np.int64),) * 3
    least = _sliding(h, width, True)
    sizes = np.diff(bounds)
    window = np.zeros(len(data) + 1, np.int8)  # 1 where a window of one text begins
    long = sizes >= length
    np.add.at(window, bounds[:-1][long], 1)
    np.add.at(window, bounds[1:][long] - length + 1, -1)
    valid = np.flatnonzero(np.cumsum(window[:len(least)]))
    if not len(valid):
        return np.zeros(0, _U), *(np.zeros(0, np.int64),) * 3
    best = least[valid]
    # the place of the least gram: the first at or after the window's start that equals it
    place = np.full(len(valid), -1, np.int64)
    todo = np.arange(len(valid))
    hit = np.flatnonzero(h[valid] == best)
    place[hit] = valid[hit]
    # walking back, a window whose own first gram is not the least has the anchor of the next window, or a later one
    following = np.append(valid[1:] == valid[:-1] + 1, False)
    same = np.append(best[1:] == best[:-1], False) & following & (place < 0)
    nxt = np.where(same, np.arange(len(valid)) + 1, np.arange(len(valid)))
    for _ in range(max(1, math.ceil(math.log2(width)))):
        nxt = nxt[nxt]
    place = place[nxt]
    rest = todo[place < 0]  # the last windows of a run: their anchor lies beyond every window's start
    if len(rest):
        offset = np.argmax(h[valid[rest][:, None] + np.arange(width)] == best[rest][:, None], axis=1)
        place[rest] = valid[rest] + offset
    new = np.concatenate([[True], (place[1:] != place[:-1]) | ~following[:-1]])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(valid)) - 1
    return best[first], place[first], valid[first], valid[last]


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts as UTF-8 bytes in one array, and the bounds of each."""
    parts = [b"" if x is None else x for x in texts.cast(pa.large_binary()).to_pylist()]
    return np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts], dtype=np.int64)])


def _distinct(ordered: np.ndarray) -> np.ndarray:
    """The distinct values of a sorted array."""
    return ordered[np.append(True, ordered[1:] != ordered[:-1])[:len(ordered)]]


def _packed(hashes: np.ndarray) -> bytes:
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpacked(blob: bytes) -> np.ndarray:
    out = np.zeros((len(blob) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel().astype(_U)


def _write_groups(docs: DataFrame, folder: str, range_bits: int) -> DataFrame:
    """Step 1, in the scan's tasks: one file of texts per task; (range, task, hashes) rows. A hash is cut to 48
    bits (chance equals cost a comparison, no more), and marked (49th place) if two documents of the task have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seen, twice, size = TaskContext.get().partitionId(), [np.zeros(0, _U)], [np.zeros(0, _U)], 0

        def put(out) -> None:
            nonlocal size
            writer = None
            for batch in batches:
                for part in tokens.slices(batch, "text", SLICE_BYTES):
                    if writer is None:
                        writer = pq.ParquetWriter(out, part.schema, compression="zstd")
                    writer.write_batch(part)
                    data, bounds = _bytes_of(part.column("text"))
                    size += len(data)
                    h, place, _, _ = anchors(data, bounds)
                    ids = part.column("doc_id").fill_null(_NULL_RANK).to_numpy()[np.searchsorted(bounds, place, "right") - 1]
                    h = h >> _U(16)
                    order = np.argsort(h, kind="stable")
                    h, ids = h[order], ids[order]
                    new = np.append(True, h[1:] != h[:-1])[:len(h)]
                    first = np.flatnonzero(new)
                    if len(first):
                        twice.append(h[first][np.minimum.reduceat(ids, first) != np.maximum.reduceat(ids, first)])
                        seen.append(h[first])
            if writer is not None:
                writer.close()

        write_file(folder, f"docs-{task:08d}.parquet", put)
        flat = np.sort(np.concatenate(seen))
        again = flat[1:][flat[1:] == flat[:-1]]  # in two slices of the task
        every, both = _distinct(flat), _distinct(np.sort(np.concatenate([again, *twice])))
        marks = np.isin(every, both, assume_unique=True)
        cuts = np.searchsorted(every >> _U(48 - range_bits), np.arange(1 << range_bits, dtype=_U))
        for r, (a, b) in enumerate(zip(cuts, [*cuts[1:], len(every)])):
            if r == 0 or a < b:  # the first row tells of the task even where it has no anchors
                yield pa.RecordBatch.from_pydict({"range": pa.array([r], pa.int64()), "task": pa.array([task], pa.int64()),
                                                  "hashes": pa.array([_packed(every[a:b])], pa.binary()), "marks": pa.array([np.packbits(marks[a:b]).tobytes()], pa.binary()),
                                                  "bytes": pa.array([0 if r else size], pa.int64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text"))
    return rows.mapInArrow(_released(run), "range long, task long, hashes binary, marks binary, bytes long")


def _shared_hashes(sent: DataFrame, ranges: int) -> DataFrame:
    """Step 1, per range: the hashes of each task that other documents have too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def answers() -> Iterator[pa.RecordBatch]:
            each = [_unpacked(h) for _, h, _, _ in held]
            flat = np.sort(np.concatenate(each))
            marked = [e[np.unpackbits(np.frombuffer(m, np.uint8), count=len(e)).astype(bool)] for e, (_, _, m, _) in zip(each, held)]
            shared = _distinct(np.sort(np.concatenate([flat[1:][flat[1:] == flat[:-1]], *marked])))
            for (task, _, _, size), e in zip(held, each):
                mine = e[np.isin(e, shared, assume_unique=True)]
                if len(mine) or not at:  # range 0 answers every task, so that each one's file is read in the end
                    yield pa.RecordBatch.from_pydict({"task": pa.array([task], pa.int64()), "hashes": pa.array([_packed(mine)], pa.binary()), "bytes": pa.array([size], pa.int64())})

        for batch in batches:
            for r, task, hashes, marks, size in zip(*(batch.column(c).to_pylist() for c in ("range", "task", "hashes", "marks", "bytes"))):
                if r != at:
                    if held:
                        yield from answers()
                    at, held = r, []
                held.append((task, hashes, marks, size))
        if held:
            yield from answers()

    dealt = sent.repartition(ranges, "range").sortWithinPartitions("range", "task")
    return dealt.mapInArrow(_released(run), "task long, hashes binary, bytes long")


def _documents(folder: str, task: int) -> Iterator[pa.RecordBatch]:
    system, path = open_folder(folder)
    with system.open_input_file(f"{path}/docs-{task:08d}.parquet") as file:
        if file.size():
            for batch in pq.ParquetFile(file).iter_batches(batch_size=1 << 12):
                yield from tokens.slices(batch, "text", SLICE_BYTES)


def _released(run):
    """``run`` for one task, whose worker gives freed memory back at the end."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            tokens.release_memory()

    return task


def _by_task(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[tuple[int, list[list]]]:
    """(task, its parts) of batches sorted by task; a part has the values of ``columns`` in one batch."""
    at, parts = None, []
    for batch in batches:
        tasks = batch.column("task").to_numpy()
        cuts = np.flatnonzero(np.append(True, tasks[1:] != tasks[:-1])[:len(tasks)])
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(tasks)]):
            if tasks[a] != at:
                if parts:
                    yield at, parts
                at, parts = int(tasks[a]), []
            parts.append([batch.column(c).slice(a, b - a) for c in columns])
    if parts:
        yield at, parts


def _words(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each place (zeros beyond the end) as numbers that sort like them."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(padded, 8)[at]).view(">u8").ravel().astype(_U)


def _shared_suffixes(answers: DataFrame, folder: str, tasks: int, splitters: list[tuple[bytes, int]] | None = None, step: int = 1) -> DataFrame:
    """Step 2, per task file: the suffixes at shared anchors as (suffix, doc, task, row, start, range) rows. A suffix has
    the bytes from the anchor to the end of its last window, then those before the anchor, and their number. Without
    splitters, every ``step``-th suffix of the sampled documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first_words = None
        if splitters is not None:
            joined = b"".join(s[:8] for s, _ in splitters)
            first_words = _words(np.frombuffer(joined, np.uint8), np.arange(len(splitters)) * 8)
        for task, answered in _by_task(batches, ["hashes"]):  # one task's answers are as many as its anchors at most
            shared, row0 = np.sort(np.concatenate([_unpacked(h) for column, in answered for h in column.to_pylist()])), 0
            if not len(shared):
                continue
            for part in _documents(folder, task):
                rows = np.arange(row0, row0 + part.num_rows)
                row0 += part.num_rows
                if splitters is None:
                    with np.errstate(over="ignore"):
                        mine = mix(rows.astype(_U) + _U(task) * _BASE) % _U(SAMPLE_DOCS) == 0
                    part, rows = part.filter(pa.array(mine)), rows[mine]
                    if not len(rows):
                        continue
                data, bounds = _bytes_of(part.column("text"))
                h, place, first, last = anchors(data, bounds)
                at = np.searchsorted(shared, h >> _U(16))
                at[at == len(shared)] = 0
                keep = np.flatnonzero(shared[at] == (h >> _U(16)))
                if splitters is None:
                    keep = keep[::step]
                place, first, last = place[keep], first[keep], last[keep]
                row = np.searchsorted(bounds, first, "right") - 1
                ids = part.column("doc_id").fill_null(_NULL_RANK).to_numpy()[row]
                raw, size = data.tobytes(), last + LENGTH - first
                for a in range(0, len(keep), 1 << 16):
                    b = slice(a, a + (1 << 16))
                    found = [raw[p:f + n] + raw[f:p] + bytes((p - f,)) for p, f, n in zip(place[b].tolist(), first[b].tolist(), size[b].tolist())]
                    ranges = np.zeros(len(found), np.int64)
                    if splitters:
                        word = _words(data, place[b])
                        ranges, above = (np.searchsorted(first_words, word, side) for side in ("left", "right"))
                        for i in np.flatnonzero(ranges < above).tolist():  # splitters that begin like the suffix
                            ranges[i] = bisect.bisect_right(splitters, (found[i], int(ids[a + i])), int(ranges[i]), int(above[i]))
                    yield pa.RecordBatch.from_pydict({
                        "suffix": pa.array(found, pa.binary()), "doc": pa.array(ids[b], pa.int64()), "task": pa.array(np.full(len(found), task)),
                        "row": pa.array(rows[row[b]]), "start": pa.array(first[b] - bounds[row[b]]), "range": pa.array(ranges, pa.int64())})

    dealt = answers.select("task", "hashes").repartition(tasks, "task").sortWithinPartitions("task")
    return dealt.mapInArrow(_released(run), "suffix binary, doc long, task long, row long, start long, range long")


def _splitters(answers: DataFrame, folder: str, tasks: int, ranges: int, size: int) -> list[tuple[bytes, int]]:
    """The (suffix, document) at which each range but the first begins, one for about each range: every
    ``SAMPLE_RANGE``-th of the sorted sample. The sample itself stays in Spark."""
    sampled_text = -(-size // SAMPLE_DOCS)
    step = max(1, sampled_text // ((LENGTH - GRAM + 2) // 2 * SAMPLE_RANGE * ranges))
    sample = stored(_shared_suffixes(answers, folder, tasks, step=step).select("suffix", "doc"), "suffix-sample")
    every = max(1, sample.count() // ranges)

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = every // 2
        for batch in batches:
            yield batch.take(pa.array(np.arange(at, batch.num_rows, every)))
            at = at + max(0, -(-(batch.num_rows - at) // every)) * every - batch.num_rows

    picked = sample.orderBy("suffix", "doc").mapInArrow(pick, "suffix binary, doc long")
    return sorted({(bytes(r[0]), r[1]) for r in picked.collect()})


def multikey_groups(data: np.ndarray, at: np.ndarray, first_key: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Equal strings of ``length`` bytes at the places ``at`` (with equal first keys) get equal numbers; a string
    with no equal gets -1. Multikey: eight bytes at a time, and only where the strings so far are equal."""
    number = np.full(len(at), -1, np.int64)
    rows = np.arange(len(at))
    group = np.unique(first_key, return_inverse=True)[1]
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(padded, 8)
    steps = [*range(0, length - 7, 8), *([length - 8] if length % 8 else [])]
    for step in steps:
        count = np.bincount(group)
        keep = count[group] > 1
        rows, group = rows[keep], group[keep]
        if not len(rows):
            return number
        key = np.ascontiguousarray(words[at[rows] + step]).view(">u8").ravel()
        order = np.lexsort((key, group))
        g, k = group[order], key[order]
        new = np.append(True, (g[1:] != g[:-1]) | (k[1:] != k[:-1]))
        group = np.empty(len(rows), np.int64)
        group[order] = np.cumsum(new) - 1
    keep = np.bincount(group)[group] > 1
    number[rows[keep]] = group[keep]
    return number


def _common(a: bytes, b: bytes) -> int:
    """How many leading bytes are the same."""
    return next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))


class _Range:
    """Sorted suffixes of one range, taken in chunk by chunk. ``found`` gathers removed stretches (task, row, start,
    stop, None, None), and the windows to compare across boundaries with their document: (..., window, doc)."""

    def __init__(self):
        self.found: list[tuple] = []
        self._rows: list[tuple] = []  # different suffixes, and equal ones of the document that keeps them
        self._windows = 0
        self._gram = self._suffix = None
        self._several = False
        self._mark = 0
        self._open = True  # whether suffixes before this chunk may have its first gram

    def take(self, suffix: bytes, doc: int, task: int, row: int, start: int) -> None:
        windows, gram = len(suffix) - LENGTH, suffix[:GRAM]
        if gram != self._gram:
            if not self._several and (self._mark or not self._open):  # a gram with one suffix only needs no comparison
                self._windows -= sum(len(r[0]) - LENGTH for r in self._rows[self._mark:])
                del self._rows[self._mark:]
            if self._windows > CHUNK_WINDOWS:
                self.compare(False)
            self._gram, self._suffix, self._several, self._mark = gram, None, False, len(self._rows)
        elif self._windows > CHUNK_WINDOWS:
            self.compare(True)
            self._mark = 0
        self._several |= self._suffix is not None and suffix != self._suffix
        self._suffix = suffix
        self._rows.append((suffix, doc, task, row, start))
        self._windows += windows

    def compare(self, more: bool) -> None:
        """Compares the windows of the suffixes held and lets them go; ``more``: later ones may have the last gram."""
        rows, self._rows, self._windows, self._mark = self._rows, [], 0, 0
        before, self._open = self._open, more
        if not rows:
            return
        # leading bytes that a suffix shares with an open end of the chunk: windows with as many from their anchor on may lie beyond it
        lead = np.zeros(len(rows), np.int64)
        for end, order in [(rows[0], range(len(rows)))] * before + [(rows[-1], range(len(rows) - 1, -1, -1))] * more:
            for i in order:
                same = _common(rows[i][0], end[0])
                if same < GRAM:
                    break
                lead[i] = max(lead[i], same)
        data = np.frombuffer(b"".join(r[0][-1 - r[0][-1]:-1] + r[0][:-1 - r[0][-1]] for r in rows), np.uint8)
        size = np.array([len(r[0]) - 1 for r in rows])
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        n = size - LENGTH + 1
        owner = np.repeat(np.arange(len(rows)), n)
        inside = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        place = np.array([r[0][-1] for r in rows])[owner] - inside  # of the anchor in the window
        gram = np.cumsum([i and r[0][:GRAM] != rows[i - 1][0][:GRAM] for i, r in enumerate(rows)])[owner]
        number = multikey_groups(data, begin[owner] + inside, gram * LENGTH + place)
        doc = np.array([r[1] for r in rows], np.int64)[owner]
        held = np.flatnonzero(number >= 0)
        gone = np.zeros(len(number), bool)
        if len(held):
            least = np.full(number.max() + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, number[held], doc[held])
            gone[held] = doc[held] > least[number[held]]
        at = np.flatnonzero(gone)
        if len(at):
            new = np.append(True, (at[1:] != at[:-1] + 1) | (owner[at[1:]] != owner[at[:-1]]))
            last = np.append(at[np.flatnonzero(new)[1:] - 1], at[-1:])
            for o, a, b in zip(owner[at[new]].tolist(), inside[at[new]].tolist(), inside[last].tolist()):
                _, _, task, row, start = rows[o]
                self.found.append((task, row, start + a, start + b + LENGTH, None, None))
        beyond = np.flatnonzero(~gone & (LENGTH - place <= lead[owner]))
        raw = data.tobytes()
        for o, a, p in zip(owner[beyond].tolist(), inside[beyond].tolist(), place[beyond].tolist()):
            _, d, task, row, start = rows[o]
            w = int(begin[o]) + a
            self.found.append((task, row, start + a, start + a + LENGTH, raw[w:w + LENGTH] + bytes((p,)), d))

    def end(self) -> None:
        self.compare(True)


def _settled():
    """Splits sorted batches into the stretches of suffixes that an earlier document has whole, and all other rows."""
    suffix, least = None, None  # of the last row so far, and the smallest id that has it

    def split(batch: pa.RecordBatch) -> tuple[pa.RecordBatch, pa.RecordBatch]:
        nonlocal suffix, least
        if not batch.num_rows:
            return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 4, _STRETCH), batch
        column, doc = batch.column("suffix"), batch.column("doc").to_numpy()
        same = np.append(column[0].as_py() == suffix, pc.equal(column[1:], column[:-1]).to_numpy(zero_copy_only=False))
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(doc))))  # of each row's equals in this batch
        smallest = doc[first]
        if same[0]:  # the equals of the last batch's end go on up to the first other suffix
            smallest[:np.argmin(same) if not same.all() else len(same)] = least
        gone = same & (doc > smallest)
        suffix, least = column[-1].as_py(), smallest[-1]
        out, size = batch.filter(pa.array(gone)), np.asarray(pc.binary_length(column), dtype=np.int64)[gone]
        stretches = [out.column("task"), out.column("row"), out.column("start"), pa.array(out.column("start").to_numpy() + size - 1)]
        return pa.RecordBatch.from_arrays(stretches, _STRETCH), batch.filter(pa.array(~gone))

    return split


def _found(suffixes: DataFrame, ranges: int) -> DataFrame:
    """Steps 2 and 3, per range: (task, row, start, stop) of every stretch that an earlier document in the range has,
    and the windows that may lie beyond its boundaries, with their document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, settle, gone, n = _Range(), _settled(), [], 0

        def table() -> pa.RecordBatch:
            nonlocal n
            cut = [*gone, pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part.found), _FOUND.types)] if part.found
                                                     else [pa.array([], t) for t in _FOUND.types], schema=_FOUND)]
            gone.clear()
            part.found.clear()
            n = 0
            # in order of their place, so that the written columns are small
            done = pa.Table.from_batches(cut).sort_by([(c, "ascending") for c in _STRETCH[:3]]).combine_chunks()
            return done.to_batches()[0]

        for batch in batches:
            settled, rest = settle(batch)
            if settled.num_rows:
                none = [pa.nulls(settled.num_rows, t) for t in _FOUND.types[4:]]
                gone.append(pa.RecordBatch.from_arrays([*settled.columns, *none], schema=_FOUND))
                n += settled.num_rows
            for r in zip(*(rest.column(c).to_pylist() for c in ("suffix", "doc", "task", "row", "start"))):
                part.take(*r)
            if n + len(part.found) >= SORT_STRETCHES:
                yield table()
        part.end()
        if n + len(part.found):
            yield table()

    dealt = suffixes.repartitionById(ranges, F.col("range").cast("int")).drop("range").sortWithinPartitions("suffix", "doc")
    return dealt.mapInArrow(_released(run), "task long, row long, start long, stop long, window binary, doc long")


def _removed(found: DataFrame) -> DataFrame:
    """Step 3: the stretches of all ranges, with the windows that a document in another chunk or range has earlier."""
    edges = found.where("window is not null")
    least = edges.groupBy("window").agg(F.min("doc").alias("least"), F.max("doc").alias("_most")).where("least < _most").drop("_most")
    across = edges.join(least, "window").where("doc > least")
    return found.where("window is null").select(_STRETCH).unionByName(across.select(_STRETCH))


def _kept(removed: DataFrame, answers: DataFrame, folder: str, tasks: int) -> DataFrame:
    """Step 4, per task file: every document with its removed stretches and what remains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for task, parts in _by_task(batches, _STRETCH[1:]):  # a task's stretches are bounded by its own file
            rows, start, stop = (np.concatenate([p[k].drop_null().to_numpy() for p in parts]) for k in range(3))
            row = 0
            for part in _documents(folder, task):
                out, cuts = [], np.searchsorted(rows, np.arange(row, row + part.num_rows + 1))
                row += part.num_rows
                texts = (x.as_py() or b"" for x in part.column("text").cast(pa.large_binary()))
                for doc, raw, i, j in zip(part.column("doc_id").to_pylist(), texts, cuts.tolist(), cuts[1:].tolist()):
                    spans = []
                    if i < j:
                        ends = np.maximum.accumulate(stop[i:j])
                        new = np.flatnonzero(np.append(True, start[i + 1:j] > ends[:-1]))
                        spans = list(zip(start[i:j][new].tolist(), ends[np.append(new[1:] - 1, j - i - 1)].tolist()))
                    rest, end = io.BytesIO(), 0
                    for a, b in spans:
                        rest.write(raw[end:a])
                        end = b
                    rest.write(raw[end:])
                    kept = rest.getvalue()
                    out.append((doc, len(raw), len(raw) - len(kept), [{"start": a, "stop": b} for a, b in spans], hashlib.sha256(kept).hexdigest()))
                if out:
                    span = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), span, pa.string()))],
                                                     ["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256"])

    none = [F.lit(None).cast("long").alias(c) for c in _STRETCH[1:]]  # a row for each task, so that each one's file is read
    every = answers.select("task").distinct().select("task", *none)
    dealt = every.unionByName(removed).repartition(tasks, "task").sortWithinPartitions("task", "row", "start")
    return dealt.mapInArrow(_released(run), "doc_id long, n_bytes long, n_removed long, spans array<struct<start: bigint, stop: bigint>>, kept_sha256 string")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, spans (maximal removed byte runs), kept_sha256."""
    spark = docs.sparkSession
    folder = scratch_path(spark, "suffixes")
    bits = max(4, math.ceil(math.log2(int(spark.conf.get("spark.sql.shuffle.partitions")))))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    answers = stored(_shared_hashes(_write_groups(rows, folder, bits), 1 << bits), "shared-grams")
    size = answers.agg(F.count_distinct("task"), F.sum("bytes")).first()
    tasks, ranges = max(1, size[0]), max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size[1] or 0) // RANGE_BYTES))
    splitters = _splitters(answers, folder, tasks, ranges, size[1] or 0)
    found = stored(_found(_shared_suffixes(answers, folder, tasks, splitters), len(splitters) + 1), "stretches")
    return _kept(_removed(found), answers, folder, tasks)


def digest(docs: DataFrame) -> DataFrame:
    """Query form."""
    return without_repeats(docs).select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")
