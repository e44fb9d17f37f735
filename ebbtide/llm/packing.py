"""Packing documents into windows of equal capacity (operator 7).

A document's ids are cut into whole windows; what is left over is cut into pieces of at most ``max_piece``
ids. The pieces of a group (consecutive documents of a scan partition) are shared out by multiway
Karmarkar-Karp differencing: every piece starts as a partition of k windows with one of them filled, and the
two partial partitions with the largest imbalance are merged, the fullest windows of one onto the emptiest of
the other, until one is left. If a window then holds more than the capacity, k rises by one and the group is
shared out anew. Nothing is shuffled: groups are local to a partition, and bounded.

Defined results: a null text is an empty one (only the end id); a null ``doc_id`` is kept; repeated rows are
packed each on their own; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm import tokens

CAPACITY = 2048
MAX_PIECE = 512
GROUP_PIECES = 1024
SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def differencing(sizes: np.ndarray, k: int) -> np.ndarray:
    """Window (0..k-1) of each size, by Karmarkar-Karp differencing into ``k`` near-equal windows."""
    heap, nodes = [], []
    for i, s in enumerate(sizes):
        loads = np.zeros(k, dtype=np.int64)
        loads[0] = s
        nodes.append(None)
        heap.append((-int(s) if k > 1 else 0, i, loads))
    heapq.heapify(heap)
    while len(heap) > 1:
        (_, a, high), (_, b, low) = heapq.heappop(heap), heapq.heappop(heap)
        both = high + low[::-1]  # loads are kept in falling order
        order = np.argsort(-both, kind="stable")
        loads = both[order]
        nodes.append((a, b, order))
        heapq.heappush(heap, (int(loads[-1] - loads[0]), len(nodes) - 1, loads))
    window = np.zeros(len(sizes), dtype=np.int64)
    todo = [(heap[0][1], np.arange(k))] if heap else []
    while todo:  # undo the merges: which window each position of a partial partition became
        at, slot = todo.pop()
        if nodes[at] is None:
            window[at] = slot[0]
            continue
        a, b, order = nodes[at]
        first, second = np.empty(k, dtype=np.int64), np.empty(k, dtype=np.int64)
        first[order] = slot
        second[k - 1 - order] = slot
        todo += [(a, first), (b, second)]
    return window


def share_out(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Windows for pieces of at most ``capacity``: the fewest that differencing fills without an overflow."""
    k = max(1, -(-int(sizes.sum()) // capacity))
    while True:
        window = differencing(sizes, k)
        if np.bincount(window, sizes, k).max() <= capacity:
            return window
        k += 1


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY,
         max_piece: int = MAX_PIECE, group: int = GROUP_PIECES, vocab: str = tokens.VOCAB_FILE,
         end_id: int = tokens.END_ID) -> DataFrame:
    """One row per piece, with its ids as little-endian 32-bit integers.

    ``sequence_id`` is the scan partition in the upper bits and a running number in the lower 32.
    """
    if not 0 < max_piece <= capacity:
        raise ValueError("max_piece must lie between 1 and the capacity")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.WordEncoder(tokens.vocab_path(vocab))
        sequence = TaskContext.get().partitionId() << 32
        waiting: list[tuple] = []  # (doc_id, start, ids, doc_tokens) of pieces without a window

        def table(pieces: list[tuple]) -> pa.RecordBatch:
            doc, start, ids, total, seq, offset = zip(*pieces)
            return pa.RecordBatch.from_arrays(
                [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array(map(len, ids), pa.int64()),
                 pa.array([x.tobytes() for x in ids], pa.binary()), pa.array(total, pa.int64()),
                 pa.array(seq, pa.int64()), pa.array(offset, pa.int64())],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        def shared(pieces: list[tuple]) -> list[tuple]:
            nonlocal sequence
            size = np.array([len(p[2]) for p in pieces])
            window = share_out(size, capacity)
            _, window = np.unique(window, return_inverse=True)  # no number for a window left empty
            filled, out = {}, []
            for p, n, w in zip(pieces, size.tolist(), window.tolist()):
                out.append((*p, sequence + w, filled.get(w, 0)))
                filled[w] = filled.get(w, 0) + n
            sequence += len(filled)
            return out

        for batch in batches:
            for part in tokens.slices(batch, "text"):
                ids, bounds = tokens.with_end(*encoder.encode(part.column("text")), end_id)
                done: list[tuple] = []
                for doc, a, b in zip(part.column("doc_id").to_pylist(), bounds.tolist(), bounds[1:].tolist()):
                    n, cut = b - a, (b - a) // capacity * capacity
                    for s in range(0, cut, capacity):
                        done.append((doc, s, ids[a + s:a + s + capacity], n, sequence, 0))
                        sequence += 1
                    for s in range(cut, n, max_piece):
                        waiting.append((doc, s, ids[a + s:min(a + s + max_piece, b)].copy(), n))
                    while len(waiting) >= group:
                        done += shared(waiting[:group])
                        del waiting[:group]
                if done:
                    yield table(done)
        if waiting:
            yield table(shared(waiting))

    return rows.mapInArrow(run, SCHEMA)


def packed_digest(docs: DataFrame, **options) -> DataFrame:
    """Query form: the pieces with a checksum of their ids in place of the ids."""
    return pack(docs, **options).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens",
                                        "sequence_id", "offset")
