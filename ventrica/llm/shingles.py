"""Word shingles of whole texts, hashed to 64 bits with numpy over Arrow buffers.

Words are runs without ASCII white space of the text with A-Z lower-cased. A word's hash
is a polynomial over its UTF-8 bytes, taken from one running sum over the buffer; a
shingle's hash combines the hashes of its words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

WORDS = 5
CHUNK_BYTES = 1 << 18
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_rng = np.random.default_rng(20240501)
_BYTE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _rng.integers(1, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
for _c in range(65, 91):
    _BYTE[_c] = _BYTE[_c + 32]
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
_tables: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if "up" not in _tables or len(_tables["up"]) < n:
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            t = np.full(n, np.uint64(base), np.uint64)
            t[0] = 1
            _tables[name] = np.cumprod(t, dtype=np.uint64)
    return _tables["up"], _tables["down"]


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_chunks(column: pa.ChunkedArray | pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows with about CHUNK_BYTES together; null is empty."""
    column = column.cast(pa.large_string()).fill_null("")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        column = pa.concat_arrays(column.chunks) if isinstance(column, pa.ChunkedArray) else column
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        end = int(np.searchsorted(offsets, offsets[row] + CHUNK_BYTES, "right"))
        end = min(max(end - 1, row + 1), len(column))
        yield row, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def word_hashes(data: np.ndarray, offsets: np.ndarray, beginnings: tuple[int, ...] = ()) -> tuple:
    """Hash of every word, and for each text the index of its first word (one more entry at the end).

    With ``beginnings``, thirdly for each of these sizes which words are longer, and hashes of
    so many bytes of them.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
        return (*none, [(none[1][:0], none[0])] * len(beginnings)) if beginnings else none
    up, down = _powers(n + 1)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[(offsets > 0) & (offsets < n)]
    first[cut] = inside[cut]
    starts = np.flatnonzero(first)
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cut - 1] = inside[cut - 1]
    ends = np.flatnonzero(last) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[:n], out=total[1:])
    hashes = mix64((total[ends] - total[starts]) * down[starts])
    if not beginnings:
        return hashes, np.searchsorted(starts, offsets)
    longer = [np.flatnonzero(ends - starts > size) for size in beginnings]
    parts = [(where, mix64((total[starts[where] + size] - total[starts[where]]) * down[starts[where]])) for where, size in zip(longer, beginnings, strict=True)]
    return hashes, np.searchsorted(starts, offsets), parts


def ordered_shingles(column, words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text the hashes of its shingles in order, equal to those of shingle_sets."""
    for _, data, offsets in text_chunks(column):
        hashes, at = word_hashes(data, offsets)
        n = len(hashes) - words + 1
        sums = np.zeros(max(n, 0), np.uint64)
        for j in range(words if n > 0 else 0):
            sums += hashes[j : j + n] * _PLACE[j]
        sums = mix64(sums)
        for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
            if b - a >= words:
                yield sums[a : b - words + 1]
            elif b > a:
                yield mix64(np.array([(hashes[a:b] * _PLACE[: b - a]).sum(dtype=np.uint64) + np.uint64(b - a)], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def shingle_sets(column, words: int = WORDS) -> Iterator[np.ndarray]:
    """For each text its sorted distinct shingle hashes; fewer words make one shingle, none an empty set."""
    for found in ordered_shingles(column, words):
        found = np.sort(found)
        keep = np.ones(len(found), bool)
        np.not_equal(found[1:], found[:-1], out=keep[1:])
        yield found[keep]


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted distinct arrays."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))
