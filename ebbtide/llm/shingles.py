"""Sets of word shingles as sorted arrays of 64-bit hashes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

_U = np.uint64
_FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], _U)

_OFFSETS = _FACTORS * np.arange(1, 6, dtype=_U)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (multiply and xor-shift)."""
    x = (x ^ (x >> _U(31))) * _U(0x7FB5D329728EA185)
    x = (x ^ (x >> _U(27))) * _U(0x81DADEF4BC2DD44D)
    return x ^ (x >> _U(33))


def shingle_sets(texts: pa.Array, size: int = 5) -> Iterator[np.ndarray]:
    """The distinct ``size``-word shingles of each text (A-Z in lower case, words cut at ASCII white space).

    A text with fewer words has its whole sequence as its one shingle; one without words, or null, has none.
    """
    import xxhash
    words = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_string()), ""))
    flat = words.flatten().dictionary_encode()
    bounds = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(words), dtype=np.int64))])
    names = flat.dictionary.to_pylist()
    code = np.fromiter((xxhash.xxh64_intdigest(w.encode().lower()) for w in names), _U, len(names))  # of bytes: A-Z only
    empty = np.fromiter((not w for w in names), bool, len(names))
    at = flat.indices.to_numpy(zero_copy_only=False)
    if empty.any():  # splitting leaves empty words at the ends
        keep = ~empty[at]
        bounds = np.concatenate([[0], np.cumsum(keep)])[bounds]
        at = at[keep]
    h = code[at]
    n = len(h) - size + 1
    windows = np.zeros(max(n, 0), _U)
    for i in range(size if n > 0 else 0):
        windows += mix(h[i:i + n] + _OFFSETS[i % 5]) * _FACTORS[(i + 1) % 5]
    windows = mix(windows)
    for a, b in zip(bounds.tolist(), bounds[1:].tolist()):
        if b - a >= size:
            yield np.unique(windows[a:b - size + 1])
        elif b > a:
            short = np.full(1, b - a, _U)  # with its length, so that it equals no part of a longer text
            for i in range(b - a):
                short = mix(short) + mix(h[a + i:a + i + 1] + _OFFSETS[i % 5])
            yield mix(short)
        else:
            yield np.zeros(0, _U)


def resembles(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """Whether 100 * |a and b| >= percent * |a or b|."""
    if not len(a) or not len(b) or 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    at = np.searchsorted(large, small)
    at[at == len(large)] = 0
    both = int((large[at] == small).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)
