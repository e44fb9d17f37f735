"""WARC archives with a two-level capture index (operator 1).

Writing: one gzip member per record. Records whose payload equals an earlier one (same SHA-256, at least
``MIN_REVISIT`` bytes) become ``revisit`` records, which carry the HTTP header with the payload's length and
digest but no body.

Index: one row per capture, keyed by the reversed-host form of its URL (``com,example)/path``) and its id,
range-partitioned and sorted. A partition's rows are written as compressed blocks (``.idx``) and a sparse
directory of the first key and place of every block (``.dir``); the list of partitions with their first keys
is the level above. A lookup finds the partition and then the block by binary search, reads that block by its
byte range, and gets the byte range of the WARC record.

Defined results: a null html is an empty payload; a null url has the empty key; rows with a null ``page_id``
are always responses and come back null; of repeated rows with the smallest id all are responses; an empty
table writes nothing and gives no rows; other columns are not read.
"""

from __future__ import annotations

import bisect
import gzip
import hashlib
import json
import struct
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.store import open_folder, stored, write_file
from ebbtide.session import scratch_path

MIN_REVISIT = 100
BLOCK_CAPTURES = 512
READ_BYTES = 4 << 20  # neighbouring records are read together up to this many bytes
TASK_BYTES = 64 << 20  # archive bytes a read-back task is given, less where the cluster has idle cores
TASK_KEYS = 500_000  # keys an index or look-up task is given, likewise
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_PLACE = struct.Struct("<QI")


def url_key(url: str | None) -> str:
    """Reversed-host key: ``http://www.example.com:80/a?b`` is ``com,example,www)/a?b``."""
    if not url:
        return ""
    try:
        parts = urlsplit(url.strip())
        host, port = parts.hostname or "", parts.port
    except ValueError:
        return url
    if not host:
        return url
    default = {"http": 80, "https": 443}.get(parts.scheme.lower())
    place = ",".join(reversed(host.split("."))) + (f":{port}" if port and port != default else "")
    return f"{place}){parts.path or '/'}" + (f"?{parts.query}" if parts.query else "")


def record_id(page_id: int | None) -> str:
    """A URN that holds the page id (as unsigned 64 bits); a null id has the version nibble of no page."""
    return f"<urn:uuid:{uuid.UUID(int=(1 << 127) if page_id is None else page_id % (1 << 64))}>"


def page_id_of(urn: str) -> int | None:
    n = uuid.UUID(urn.strip("<>").removeprefix("urn:uuid:")).int
    return None if n >> 127 else n - (1 << 64) * (n >> 63)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record, uncompressed."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    body = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}", f"WARC-Target-URI: {(url or '').replace(chr(13), '%0D').replace(chr(10), '%0A')}", f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(body)}",
    ]
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join([*head, "", ""]).encode() + body + b"\r\n\r\n"


def parse(data: bytes) -> dict:
    """Fields of an uncompressed record; ``payload`` is None for a revisit."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    body = rest[:int(fields["Content-Length"])]
    http, _, payload = body.partition(b"\r\n\r\n")
    length = next(int(h.split(b":")[1]) for h in http.split(b"\r\n") if h.lower().startswith(b"content-length:"))
    revisit = fields["WARC-Type"] == "revisit"
    return {
        "page_id": page_id_of(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "record_type": fields["WARC-Type"],
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha256:"), "payload_bytes": length,
        "refers_to": page_id_of(fields["WARC-Refers-To"]) if revisit else None, "payload": None if revisit else payload,
    }


def with_revisits(pages: DataFrame, id_col: str, url_col: str, html_col: str, min_bytes: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, html, digest, refers_to. Only ids and digests meet to find equal payloads; groups are
    reduced before the shuffle, and a digest that many pages share is split by the skewed-join rule."""
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"),
                        F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    rows = rows.withColumn("digest", F.sha2("html", 256))
    ids = rows.where((F.octet_length("html") >= min_bytes) & F.col("page_id").isNotNull()).select("page_id", "digest")
    first = ids.groupBy("digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("_last"))
    first = first.where("_last > refers_to").drop("_last")
    revisits = ids.distinct().join(first, "digest").where("page_id > refers_to")
    return rows.join(revisits, ["page_id", "digest"], "left")


def write_archives(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
                   date: str = "1970-01-01T00:00:00Z", min_bytes: int = MIN_REVISIT) -> DataFrame:
    """Writes one ``.warc.gz`` per partition; returns the captures: url_key, page_id, file, offset, length."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, captures = f"pages-{TaskContext.get().partitionId():08d}.warc.gz", []

        def put(out) -> None:
            at = 0
            for batch in batches:
                for page, url, html, digest, refers in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "digest", "refers_to"))):
                    data = gzip.compress(record(page, url, html.encode("utf-8", "surrogatepass"), digest, refers, date), 6, mtime=0)
                    out.write(data)
                    captures.append((url_key(url), page, name, at, len(data)))
                    at += len(data)

        write_file(folder, name, put)
        if captures:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*captures), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()))],
                                             ["url_key", "page_id", "file", "offset", "length"])

    rows = with_revisits(pages, id_col, url_col, html_col, min_bytes)
    return stored(rows.mapInArrow(write, "url_key string, page_id long, file string, offset long, length long"), "captures")


def _sort_key(url_key: str, page_id: int | None) -> tuple[bytes, bool, int]:
    return url_key.encode("utf-8", "surrogatepass"), page_id is not None, page_id or 0


def _tasks(df: DataFrame, amount: int, most: int) -> int:
    """Tasks for ``amount`` of work: at most ``most`` each, and every core busy while a task keeps 1/64 of that.
    Keys and places are a few bytes each, so their own size says nothing about the work they stand for."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return max(1, -(-amount // most), min(cores, -(-amount * 64 // most)))


def _ranged(keys: DataFrame) -> DataFrame:
    """A stored table of keys in ranges of (url_key, page_id), sorted; Spark orders strings by their bytes, nulls first."""
    n = _tasks(keys, keys.count(), TASK_KEYS)
    return keys.repartitionByRange(n, "url_key", "page_id").sortWithinPartitions("url_key", "page_id")


def write_index(captures: DataFrame, folder: str, block: int = BLOCK_CAPTURES) -> DataFrame:
    """Writes the blocks and their sparse directories; returns the top level: part, first_key, first_id, last_key, last_id."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, directory, ends = TaskContext.get().partitionId(), [], []

        def put(out) -> None:
            at, waiting = 0, []

            def flush() -> None:
                nonlocal at
                data = zlib.compress("\n".join(json.dumps(r) for r in waiting).encode(), 6)
                directory.append((waiting[0][0], waiting[0][1], at, len(data)))
                out.write(data)
                at += len(data)
                waiting.clear()

            for batch in batches:
                for row in zip(*(batch.column(c).to_pylist() for c in ("url_key", "page_id", "file", "offset", "length"))):
                    if not ends:
                        ends.append(row[:2])
                    ends[1:] = [row[:2]]
                    waiting.append(row)
                    if len(waiting) == block:
                        flush()
            if waiting:
                flush()

        write_file(folder, f"part-{part:08d}.idx", put)
        write_file(folder, f"part-{part:08d}.dir", lambda out: out.write("\n".join(json.dumps(d) for d in directory).encode()))
        if ends:
            yield pa.RecordBatch.from_pydict({"part": [part], "first_key": [ends[0][0]], "first_id": pa.array([ends[0][1]], pa.int64()),
                                              "last_key": [ends[1][0]], "last_id": pa.array([ends[1][1]], pa.int64())})

    return stored(_ranged(captures).mapInArrow(write, "part long, first_key string, first_id long, last_key string, last_id long"), "index-parts")


class Index:
    """Lookups in the index folder. ``parts`` is the top level; directories and blocks are read on demand and
    the last ones kept, so a run of sorted lookups reads each block once."""

    def __init__(self, folder: str, parts: list[tuple]):
        self._system, self._path = open_folder(folder)
        self._parts = sorted((_sort_key(k, i), _sort_key(lk, li), n) for n, k, i, lk, li in parts)
        self._starts = [p[0] for p in self._parts]
        self._dir: tuple = (None, [], [])
        self._block: tuple = (None, [], [])

    def _directory(self, part: int) -> tuple[list, list]:
        if self._dir[0] != part:
            with self._system.open_input_file(f"{self._path}/part-{part:08d}.dir") as f:
                rows = [json.loads(x) for x in f.read().decode().split("\n") if x]
            self._dir = (part, rows, [_sort_key(k, i) for k, i, _, _ in rows])
        return self._dir[1], self._dir[2]

    def _read(self, part: int, at: int, size: int) -> tuple[list, list]:
        if self._block[0] != (part, at):
            with self._system.open_input_file(f"{self._path}/part-{part:08d}.idx") as f:
                data = f.read_at(size, at)
            rows = [json.loads(x) for x in zlib.decompress(data).decode().split("\n")]
            self._block = ((part, at), rows, [_sort_key(k, i) for k, i, *_ in rows])
        return self._block[1], self._block[2]

    def find(self, key: str, page_id: int | None) -> Iterator[tuple[str, int, int]]:
        """(file, offset, length) of every capture of that key and id."""
        want = _sort_key(key, page_id)
        p = max(0, bisect.bisect_left(self._starts, want) - 1)  # equal keys may begin at the end of the part before
        while p < len(self._parts) and self._parts[p][0] <= want:
            if self._parts[p][1] >= want:
                rows, starts = self._directory(self._parts[p][2])
                b = max(0, bisect.bisect_left(starts, want) - 1)
                while b < len(rows) and starts[b] <= want:
                    captures, keys = self._read(self._parts[p][2], rows[b][2], rows[b][3])
                    for c in captures[bisect.bisect_left(keys, want):bisect.bisect_right(keys, want)]:
                        yield c[2], c[3], c[4]
                    b += 1
            p += 1


def look_up(parts: DataFrame, folder: str, wanted: DataFrame) -> DataFrame:
    """Places (file, offset, length) of the wanted captures (url, page_id). The wanted keys are ranged and sorted
    like the index, so each task reads one stretch of it. The top level has one row per index partition."""
    top = [tuple(r) for r in parts.collect()]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(folder, top)
        for batch in batches:
            found = [x for k, i in zip(batch.column("url_key").to_pylist(), batch.column("page_id").to_pylist()) for x in index.find(k, i)]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*found)], ["file", "offset", "length"])

    return _ranged(stored(keyed(wanted).distinct(), "wanted")).mapInArrow(find, "file string, offset long, length long")


def keyed(rows: DataFrame) -> DataFrame:
    """url_key and page_id of (url, page_id) rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([url_key(u) for u in batch.column("url").to_pylist()], pa.string()), batch.column("page_id")],
                                             ["url_key", "page_id"])

    return rows.mapInArrow(run, "url_key string, page_id long")


def read_records(places: DataFrame, folder: str, with_payload: bool = True) -> DataFrame:
    """Reads records by byte range; neighbours in a file are read together. The payload digest is checked. The places
    are stored and dealt in ranges of (file, offset), as many as their bytes need."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = open_folder(folder)
        names = ["page_id", "url", "record_type", "payload_digest", "payload_bytes", "refers_to", *["payload"] * with_payload]
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            rows, at = list(zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length")))), 0
            while at < len(rows):
                name, begin, size = rows[at]
                stop, end = at + 1, begin + size
                while stop < len(rows) and rows[stop][0] == name and rows[stop][1] == end and end - begin < READ_BYTES:
                    end += rows[stop][2]
                    stop += 1
                with system.open_input_file(f"{path}/{name}") as f:
                    data = f.read_at(end - begin, begin)
                out = []
                for _, o, n in rows[at:stop]:
                    r = parse(gzip.decompress(data[o - begin:o - begin + n]))
                    if r["payload"] is not None and (len(r["payload"]) != r["payload_bytes"] or hashlib.sha256(r["payload"]).hexdigest() != r["payload_digest"]):
                        raise ValueError(f"damaged record in {name} at {o}")
                    out.append(tuple(r[c] for c in names))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
                at = stop

    schema = "page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long"
    places = stored(places, "places")
    n = _tasks(places, places.agg(F.sum("length")).first()[0] or 0, TASK_BYTES)
    ordered = places.repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    return ordered.mapInArrow(read, schema + (", payload binary" if with_payload else ""))


def round_trip(pages: DataFrame) -> DataFrame:
    """Query form: writes archives and index, then reads every page's record back through the index."""
    folder = scratch_path(pages.sparkSession, "warc")
    captures = write_archives(pages, folder)
    parts = write_index(captures, folder)
    wanted = pages.select("url", F.col("page_id").cast("long").alias("page_id"))
    places = look_up(parts, folder, wanted)
    return read_records(places, folder, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
