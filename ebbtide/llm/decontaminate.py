"""Benchmark decontamination by pigeonhole edit matching (operator 9).

Texts and items are compared in lower case with every white-space character as a space; both steps keep the
length, so places are code points of the original. An item of n code points may appear with up to
k = floor(error_rate * n) edits. It is cut into k + 1 pieces: a passage within the budget holds one of them
unchanged. An Aho-Corasick automaton finds all pieces in one walk over each whole document; around a hit,
Myers' bit-parallel algorithm computes the edit distance, and passages within the budget are reported.

Every task holds items, so they are taken in blocks of about ``block_bytes`` of text: a larger benchmark costs
further passes over the documents, not more memory. The blocks are written to the shared folder, where each task
reads the one it searches for; the driver knows their number only.

Defined results: null or blank texts and items match nothing; null ids are kept; repeated documents give
repeated rows, a repeated (item, text) row counts once; empty tables give no rows; other columns are not read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.store import open_folder, stored
from ebbtide.session import scratch_path

ERROR_RATE = 0.05
BLOCK_BYTES = 16 << 20
_SPACES = {c: " " for c in (9, 10, 11, 12, 13, 0x85, 0xA0, 0x2028, 0x2029)}


def normal(text: str) -> str:
    """Lower case, white space as spaces; as long as the text."""
    low = text.lower()
    if len(low) != len(text):  # a few letters grow in lower case: leave those as they are
        low = "".join(x if len(x := c.lower()) == 1 else c for c in text)
    return low.translate(_SPACES)


def budget(length: int, error_rate: float = ERROR_RATE) -> int:
    return int(length * error_rate)


def pieces(item: str, k: int) -> list[tuple[int, str]]:
    """(offset, text) of k + 1 pieces of nearly equal length."""
    cuts = [i * len(item) // (k + 1) for i in range(k + 2)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Myers:
    """Edit distance of a pattern to the best substring ending at each place of a text, 64-bit words or not."""

    def __init__(self, pattern: str):
        self._m = len(pattern)
        self._masks: dict[str, int] = defaultdict(int)
        for i, c in enumerate(pattern):
            self._masks[c] |= 1 << i
        self._masks = dict(self._masks)

    def distances(self, text: str) -> Iterator[int]:
        m, masks = self._m, self._masks
        ones, top = (1 << m) - 1, 1 << (m - 1)
        plus, minus, score = ones, 0, m
        for c in text:
            same = masks.get(c, 0)
            vertical = same | minus
            horizontal = (((same & plus) + plus) ^ plus) | same
            up = minus | (ones & ~(horizontal | plus))
            down = plus & horizontal
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up, down = (up << 1) & ones, (down << 1) & ones
            plus = down | (ones & ~(vertical | up))
            minus = up & vertical
            yield score


class Matcher:
    """All passages of the items in a text: (item index, start, end, distance), best first per region."""

    def __init__(self, items: list[str], error_rate: float = ERROR_RATE):
        import ahocorasick
        self._items, self._myers = [normal(t) for t in items], {}
        self._budget = [budget(len(t), error_rate) for t in self._items]
        where: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for i, t in enumerate(self._items):
            if t.strip():
                for at, piece in pieces(t, self._budget[i]):
                    where[piece].append((i, at))
        self._automaton = ahocorasick.Automaton()
        for piece, owners in where.items():
            self._automaton.add_word(piece, (len(piece), owners))
        self._automaton.make_automaton()
        self._empty = not where

    def _verify(self, i: int, text: str, lo: int, hi: int) -> Iterator[tuple[int, int, int, int]]:
        """Passages of item i in text[lo:hi]: at each group of near ends, the nearest one."""
        item, k = self._items[i], self._budget[i]
        forward, backward = self._myers.get(i) or self._myers.setdefault(i, (Myers(item), Myers(item[::-1])))
        best: tuple[int, int] | None = None  # (distance, end) of the passage being looked at
        last = lo

        def passage(distance: int, end: int) -> tuple[int, int, int, int]:
            begin = max(lo, end - len(item) - k)
            back = enumerate(backward.distances(text[begin:end][::-1]), 1)
            return i, end - min(back, key=lambda x: (x[1], x[0]))[0], end, distance

        for end, d in enumerate(forward.distances(text[lo:hi]), lo + 1):
            if best is not None and end - last > max(1, len(item) // 2):
                yield passage(*best)
                best = None
            if d <= k and (best is None or d < best[0]):
                best, last = (d, end), end
        if best is not None:
            yield passage(*best)

    def matches(self, text: str) -> list[tuple[int, int, int, int]]:
        if self._empty or not text:
            return []
        text = normal(text)
        windows: dict[int, list[list[int]]] = {}
        for last, (length, owners) in self._automaton.iter(text):
            for i, at in owners:
                k, begin = self._budget[i], last - length + 1 - at
                lo, hi = max(0, begin - k), min(len(text), begin + len(self._items[i]) + k)
                if (held := windows.get(i)) and lo <= held[-1][1]:
                    held[-1][1] = max(hi, held[-1][1])
                    held[-1][0] = min(lo, held[-1][0])
                else:
                    windows.setdefault(i, []).append([lo, hi])
        return [x for i, held in sorted(windows.items()) for lo, hi in held for x in self._verify(i, text, lo, hi)]


def item_blocks(benchmark: DataFrame, item_col: str = "item_id", item_text_col: str = "text",
                block_bytes: int = BLOCK_BYTES) -> tuple[str, int]:
    """Writes the distinct items in blocks of about ``block_bytes`` of text, dealt out by a hash of the text;
    returns the folder and the number of blocks."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text_col).alias("text"))
    items = stored(items.where("text is not null").distinct(), "items")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-size // block_bytes))
    folder = scratch_path(spark, "item-blocks")
    dealt = items.withColumn("block", F.pmod(F.xxhash64("text"), F.lit(n))).repartition("block")
    dealt.write.partitionBy("block").parquet(folder)
    return folder, n


def read_block(folder: str, block: int) -> list[tuple[int | None, str]]:
    """The (item_id, text) rows of one block, in order of id, then text; run inside tasks."""
    from pyarrow import fs
    import pyarrow.parquet as pq
    system, path = open_folder(folder)
    found = system.get_file_info(fs.FileSelector(f"{path}/block={block}", allow_not_found=True))
    rows: list[tuple[int | None, str]] = []
    for f in found:
        if f.is_file and f.base_name.endswith(".parquet") and f.base_name[0] not in "._":
            with system.open_input_file(f.path) as source:
                part = pq.read_table(source, columns=["item_id", "text"])
            rows += zip(part.column("item_id").to_pylist(), part.column("text").to_pylist())
    return sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 item_col: str = "item_id", item_text_col: str = "text", error_rate: float = ERROR_RATE,
                 block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per passage: doc_id, item_id, start, end (code points, end exclusive), distance."""
    if not 0 <= error_rate < 1:
        raise ValueError("error_rate must be at least 0 and below 1")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    folder, n = item_blocks(benchmark, item_col, item_text_col, block_bytes)

    def searched(block: int) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = read_block(folder, block)
            ids, matcher = [i for i, _ in items], Matcher([t for _, t in items], error_rate)
            for batch in batches:
                out = [(d, ids[i], a, b, e) for d, t in zip(batch.column("doc_id").to_pylist(), batch.column("text"))
                       for i, a, b, e in matcher.matches(t.as_py() or "")]
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)],
                                                     ["doc_id", "item_id", "start", "end", "distance"])

        return rows.mapInArrow(run, "doc_id long, item_id long, start long, end long, distance long")

    return reduce(DataFrame.unionByName, [searched(b) for b in range(n)])


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id",
          item_text_col: str = "text", error_rate: float = ERROR_RATE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The documents (all columns, repeated rows too) that hold no benchmark passage. A null text is kept."""
    from pyspark.sql.functions import arrow_udf

    folder, n = item_blocks(benchmark, item_col, item_text_col, block_bytes)

    def holds(block: int):
        @arrow_udf("boolean")
        def run(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
            matcher = Matcher([t for _, t in read_block(folder, block)], error_rate)
            for part in parts:
                yield pa.array([bool(matcher.matches(t.as_py() or "")) for t in part], pa.bool_())

        return run

    for block in range(n):
        docs = docs.where(~holds(block)(F.col(text_col)))
    return docs
