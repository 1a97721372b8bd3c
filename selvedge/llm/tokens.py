"""Words of whole columns at once, with Arrow kernels and numpy.

Words are runs of letters and digits, lower-cased. All functions take an Arrow
string array and return flat arrays plus, per row, the span of its words, so the
caller stays vectorised over a whole batch.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII letters and digits, and all bytes of longer characters.
_ASCII_WORD = np.array([c >= 128 or chr(c).isalnum() for c in range(256)])
NOT_WORD = r"[^\p{L}\p{N}]+"


def flat(column) -> pa.Array:
    """One contiguous large_string array with null as the empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def _word_bytes(buf: np.ndarray) -> np.ndarray:
    """Which bytes of UTF-8 text belong to letters or digits."""
    inside = _ASCII_WORD[buf]
    lead = np.flatnonzero(buf >= 0xC0)
    if len(lead):
        size = 2 + (buf[lead] >= 0xE0) + (buf[lead] >= 0xF0)
        code = buf[lead].astype(np.int64) & np.array([0x1F, 0x0F, 0x07])[size - 2]
        for k in (1, 2, 3):
            more = size > k
            code[more] = code[more] << 6 | buf[lead[more] + k] & 0x3F
        points, which = np.unique(code, return_inverse=True)
        other = np.array([unicodedata.category(chr(c))[0] not in "LN" for c in points.tolist()])[which]
        for k in (0, 1, 2, 3):
            inside[lead[other & (size > k)] + k] = False
    return inside


def words(texts: pa.Array, lower: bool = True) -> tuple[pa.Array, np.ndarray]:
    """(all words one after the other, offsets of length n + 1 into them)."""
    texts = pc.utf8_lower(texts) if lower else texts
    if texts.offset or not len(texts):
        texts = pa.concat_arrays([texts, pa.array([""], pa.large_string())]).slice(0, len(texts))  # its own buffers, from the first byte on
    if not len(texts):
        return pa.array([], pa.large_string()), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    rows = np.frombuffer(offsets, np.int64)[: len(texts) + 1]
    buf = np.frombuffer(data, np.uint8)[: rows[-1]] if data is not None else np.zeros(0, np.uint8)
    inside = _word_bytes(buf)
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = rows[:-1][rows[:-1] < len(buf)]
    begins[first] = inside[first]  # a word ends with its row
    start = np.flatnonzero(begins)
    kept = np.cumsum(inside)
    off = np.append(kept[start] - 1, kept[-1] if len(kept) else 0).astype(np.int64)
    values = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(off), pa.py_buffer(buf[inside]))
    return values, np.searchsorted(start, rows)


def coded(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """(a code for each value, the distinct values in code order)."""
    if len(values) == 0:
        return np.zeros(0, np.int64), values
    d = pc.dictionary_encode(values)
    return np.asarray(d.indices).astype(np.int64), d.dictionary


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """The row number of each flat value."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def hash64(values: pa.Array) -> np.ndarray:
    """A stable 64-bit hash of each string, as int64."""
    import xxhash

    return np.fromiter((xxhash.xxh3_64_intdigest(v) for v in values.to_pylist()), dtype=np.uint64, count=len(values)).view(np.int64)


def rolling_hash(hashes: np.ndarray, rows: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, row) of every run of n consecutive values within one row."""
    m = len(hashes) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.zeros(m, np.uint64)
    v = hashes.view(np.uint64)
    with np.errstate(over="ignore"):
        for k in range(n):
            h = (h ^ v[k : m + k]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    same = rows[:m] == rows[n - 1 :]
    return h[same].view(np.int64), rows[:m][same]


def distinct_sorted(values: np.ndarray) -> np.ndarray:
    """The distinct values in order, by a sort; np.unique hashes them first, which takes far longer here."""
    values = np.sort(values)
    return values[np.append(True, values[1:] != values[:-1])] if len(values) else values
