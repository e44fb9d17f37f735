"""Token ids of whole texts with a public tokenizer, through a word cache.

The tokenizer's normaliser and pre-tokenizer never join characters across ASCII white space, so the ids of a
text are the ids of its white-space separated words, one after the other. Each distinct word of a slice of
texts is encoded once by the library and the ids are laid out again with numpy. ``tests/llm/test_tokens.py``
holds this against the library's encoding of whole texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCAB_FILE = "word_bpe_49k.json"
END_ID = 1
SLICE_BYTES = 16 << 20  # text that one numpy step works on
CACHE_WORDS = 1 << 18  # words in each half of the cache; only a cache, never a limit on what is encoded

# letters in Latin-1 whose lower case needs no context, then ASCII punctuation without the apostrophe: the
# pre-tokenizer cuts between the two runs, so both can be encoded (and kept) on their own
_LETTERS_THEN_MARKS = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


def vocab_path(name: str = VOCAB_FILE) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


class WordEncoder:
    """Encodes arrays of texts to (ids, offsets); one instance per task.

    Known words sit in two dicts: when the newer one is full it becomes the older one, and a word found in the
    older one moves up, so frequent words stay and memory is bounded.
    """

    def __init__(self, path: str | None = None, cache_words: int = CACHE_WORDS):
        import os
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, pre_tokenizers
        self._tok = Tokenizer.from_file(path or vocab_path())
        self._new: dict[str, bytes] = {}
        self._old: dict[str, bytes] = {}
        self._limit = cache_words
        bytes_of = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        # how the byte-level step spells the letters of _LETTERS_THEN_MARKS
        self._spelt = {c: bytes_of.pre_tokenize_str(chr(c))[0][0] for c in range(0xDF, 0x100) if c != 0xF7}

    @property
    def vocab_size(self) -> int:
        return self._tok.get_vocab_size()

    def _letters(self, word: str) -> bytes:
        """Ids of a lower-case run of letters: one pre-token, so the library's model is called directly."""
        spelt = word if word.isascii() else word.translate(self._spelt)
        return np.array([t.id for t in self._tok.model.tokenize(spelt)], dtype="<u4").tobytes()

    def _any(self, word: str) -> bytes:
        return np.array(self._tok.encode(word, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _known(self, word: str, encode) -> bytes:
        found = self._new.get(word)
        if found is None:
            found = self._old.get(word)
            if found is None:
                found = encode(word)
            if len(self._new) >= self._limit:
                self._old, self._new = self._new, {}
            self._new[word] = found
        return found

    def _ids_of(self, words: list[str]) -> list[bytes]:
        out, split, known = [], _LETTERS_THEN_MARKS.fullmatch, self._known
        for w in words:
            if m := split(w):
                stem, marks = m[1].lower(), m[2]
                out.append(known(stem, self._letters) + known(marks, self._any) if marks else known(stem, self._letters))
            else:
                out.append(known(w, self._any))
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text's ids begin (length n + 1)."""
        words = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
        flat = words.flatten().dictionary_encode()
        bounds = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(words), dtype=np.int64))])
        blobs = self._ids_of(flat.dictionary.to_pylist())
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 4
        pool = np.frombuffer(b"".join(blobs), dtype="<u4")
        starts = np.concatenate([[0], np.cumsum(sizes)])
        word = flat.indices.to_numpy(zero_copy_only=False)
        length = sizes[word]
        ends = np.concatenate([[0], np.cumsum(length)])
        ids = pool[np.arange(ends[-1]) + np.repeat(starts[word] - ends[:-1], length)]
        return ids, ends[bounds]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch cut into runs of rows with at most ``limit`` bytes of text (a longer text stands alone)."""
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    start, total = 0, 0
    for i, n in enumerate(size):
        if i > start and total + n > limit:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n
    if start < batch.num_rows:
        yield batch.slice(start)


def release_memory() -> None:
    """Gives freed memory back to the system at the end of a task: Spark keeps Python workers for later tasks, and what
    their allocators hold in reserve would stand beside the memory of other stages."""
    import ctypes
    import gc
    gc.collect()
    pa.default_memory_pool().release_unused()
    if hasattr(libc := ctypes.CDLL(None), "malloc_trim"):  # glibc
        libc.malloc_trim(0)


def with_end(ids: np.ndarray, bounds: np.ndarray, end_id: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """The end id put after each text's ids."""
    n = len(bounds) - 1
    out = np.full(len(ids) + n, end_id, dtype="<u4")
    keep = np.ones(len(out), dtype=bool)
    new = bounds + np.arange(n + 1)
    keep[new[1:] - 1] = False
    out[keep] = ids
    return out, new
