"""Token-id files with fixed-width bit packing (operator 8).

A file holds the ids of a run of documents, every id in the fewest bits that hold the vocabulary. Layout,
little-endian throughout:

* header: magic, version, bit width, ids per block, vocabulary size;
* blocks: ``block`` ids each, bits packed from the lowest bit up (the last block is filled with zeros);
* document table: id, whether the id is known, first token in this file;
* block table: byte offset of every block;
* footer: number of ids, of documents, offsets of both tables, magic.

A reader takes the footer and the tables, then reads only the blocks that a range of tokens touches and
unpacks them with numpy.

Defined results: a null text is an empty one (only the end id); a null ``doc_id`` sorts first and comes back
null; repeated rows each get their own place; an empty table makes no file and no rows; other columns are
not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbtide.llm import tokens
from ebbtide.llm.store import open_folder, stored, write_file
from ebbtide.session import scratch_path

MAGIC = b"EBBTOK01"
HEADER = struct.Struct("<8sIIII")
FOOTER = struct.Struct("<QQQQ8s")
DOCUMENT = np.dtype([("id", "<i8"), ("known", "u1"), ("first", "<i8")])
BLOCK_IDS = 1 << 16
READ_IDS = 1 << 20  # ids that the reader holds at once (a longer document is read whole)


def bit_width(vocab_size: int) -> int:
    return max(1, (vocab_size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """The ids in ``width`` bits each, lowest bit first, filled up to a whole byte."""
    if width in (8, 16, 32):  # whole bytes: the packed bits are the little-endian integers themselves
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = (ids.astype("<u4")[:, None] >> np.arange(width, dtype=np.uint32)) & 1
    return np.packbits(bits.astype(np.uint8).ravel(), bitorder="little").tobytes()


def unpack(data: bytes, width: int, count: int) -> np.ndarray:
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", count).astype("<u4")
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=count * width, bitorder="little")
    return bits.reshape(count, width).astype("<u4") @ (np.uint32(1) << np.arange(width, dtype=np.uint32))


def write_ids(out, runs: Iterator[tuple[np.ndarray, np.ndarray, list]], vocab_size: int, block: int = BLOCK_IDS) -> tuple[int, int]:
    """Writes (ids, bounds, document ids) runs to the stream; returns the numbers of documents and of ids."""
    if block % 8:
        raise ValueError("a block must be a multiple of 8 ids")
    width = bit_width(vocab_size)
    out.write(HEADER.pack(MAGIC, 1, width, block, vocab_size))
    at, total, offsets, table, rest = HEADER.size, 0, [], [], np.empty(0, "<u4")

    def put(ids: np.ndarray) -> None:
        nonlocal at
        data = pack(ids, width)
        for i in range(0, len(ids), block):
            offsets.append(at + i * width // 8)
        out.write(data)
        at += len(data)

    for ids, bounds, doc_ids in runs:
        if len(ids) and int(ids.max()) >= vocab_size:
            raise ValueError("an id is outside the vocabulary")
        rows = np.zeros(len(doc_ids), DOCUMENT)
        rows["id"] = [0 if d is None else d for d in doc_ids]
        rows["known"] = [d is not None for d in doc_ids]
        rows["first"] = bounds[:-1] + total
        table.append(rows)
        total += len(ids)
        rest = np.concatenate([rest, ids])
        whole = len(rest) // block * block
        if whole:
            put(rest[:whole])
            rest = rest[whole:]
    if len(rest):
        put(np.concatenate([rest, np.zeros(-len(rest) % block, "<u4")]))
    docs = np.concatenate(table) if table else np.zeros(0, DOCUMENT)
    out.write(docs.tobytes())
    out.write(np.array(offsets, "<u8").tobytes())
    out.write(FOOTER.pack(total, len(docs), at, at + docs.nbytes, MAGIC))
    return len(docs), total


class TokenFile:
    """Random access to one file: ``documents`` and ``ids(start, stop)``."""

    def __init__(self, file, size: int):
        self._file = file
        magic, version, self.width, self.block, self.vocab_size = HEADER.unpack(file.read_at(HEADER.size, 0))
        self.n_ids, n_docs, docs_at, blocks_at, end = FOOTER.unpack(file.read_at(FOOTER.size, size - FOOTER.size))
        if (magic, version, end) != (MAGIC, 1, MAGIC):
            raise ValueError("not a token file")
        self.documents = np.frombuffer(file.read_at(n_docs * DOCUMENT.itemsize, docs_at), DOCUMENT)
        self._offsets = np.frombuffer(file.read_at(size - FOOTER.size - blocks_at, blocks_at), "<u8")

    def ids(self, start: int, stop: int) -> np.ndarray:
        if not 0 <= start <= stop <= self.n_ids:
            raise IndexError("outside the file")
        if start == stop:
            return np.empty(0, "<u4")
        first, last = start // self.block, (stop - 1) // self.block
        size = (last - first + 1) * self.block
        data = self._file.read_at(size * self.width // 8, int(self._offsets[first]))
        return unpack(data, self.width, size)[start - first * self.block: stop - first * self.block]


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text",
                      vocab: str = tokens.VOCAB_FILE, end_id: int = tokens.END_ID, block: int = BLOCK_IDS) -> DataFrame:
    """Encodes every text, appends the end id and writes one file per range of ``id_col``.

    Returns one row per file, in ascending order of documents: shard, path, n_docs, n_ids, first_id (ids in
    all files before it). Repeated ids are told apart by a hash of the text, so they split over partitions.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    tie = F.xxhash64("text")
    rows = rows.repartitionByRange(F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.WordEncoder(tokens.vocab_path(vocab))

        def runs():
            for batch in batches:
                for part in tokens.slices(batch, "text"):
                    ids, bounds = tokens.with_end(*encoder.encode(part.column("text")), end_id)
                    yield ids, bounds, part.column("doc_id").to_pylist()

        shard, counts = TaskContext.get().partitionId(), []
        path = write_file(folder, f"ids-{shard:08d}.bin", lambda out: counts.extend(write_ids(out, runs(), encoder.vocab_size, block)))
        yield pa.RecordBatch.from_pydict({"shard": [shard], "path": [path], "n_docs": [counts[0]], "n_ids": [counts[1]]})

    files = stored(rows.mapInArrow(encode, "shard long, path string, n_docs long, n_ids long"), "token-files").where("n_docs > 0")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return files.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_token_files(files: DataFrame, folder: str, with_ids: bool = True) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32 and (on demand) the ids as binary."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, _ = open_folder(folder)
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("first_id").to_pylist()):
                size = system.get_file_info(path).size
                with system.open_input_file(path) as file:
                    tf = TokenFile(file, size)
                    bounds = np.concatenate([tf.documents["first"], [tf.n_ids]])
                    i = 0
                    while i < len(tf.documents):
                        j = max(i + 1, int(np.searchsorted(bounds, bounds[i] + READ_IDS, "right")) - 1)
                        data = memoryview(tf.ids(int(bounds[i]), int(bounds[j])).tobytes())
                        local = (bounds[i:j + 1] - bounds[i]) * 4
                        each = [data[a:b] for a, b in zip(local, local[1:])]
                        docs = tf.documents[i:j]
                        out = {
                            "doc_id": pa.array(docs["id"], pa.int64(), mask=docs["known"] == 0),
                            "start": pa.array(bounds[i:j] + before, pa.int64()),
                            "n_tokens": pa.array(np.diff(bounds[i:j + 1]), pa.int64()),
                            "ids_crc32": pa.array([zlib.crc32(x) for x in each], pa.int64()),
                        }
                        if with_ids:
                            out["ids"] = pa.array([bytes(x) for x in each], pa.binary())
                        yield pa.RecordBatch.from_pydict(out)
                        i = j

    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + (", ids binary" if with_ids else "")
    n = files.count()  # one row per file; each file is a task
    return files.select("path", "first_id", "shard").repartition(max(1, n), "shard").mapInArrow(read, schema)


def token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Query form: writes the files below the shared folder and reads every document back from them."""
    folder = scratch_path(docs.sparkSession, "token-ids")
    return read_token_files(write_token_files(docs, folder, id_col, text_col), folder, with_ids=False)
