"""Words and their hashes for whole Arrow columns, in numpy.

A word is a run of bytes outside space and \\t \\n \\v \\f \\r. Texts are handled
in pieces of a few MB, cut between rows only, so a text is never split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SPACE = np.zeros(256, dtype=bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
PIECE_BYTES = 1 << 21
_MUL = np.uint64(0x9E3779B97F4A7C15)
_ALL = np.uint64((1 << 64) - 1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values, one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


class Hasher:
    """64-bit hash of words under a seed. Up to eight bytes the hash is one to one among
    words of one length; longer words go through it in blocks of eight, each mixed in full,
    and very long ones through xxhash."""

    BLOCKS = 8

    def __init__(self, seed: int, lower: bool = False):
        self.seed, self.lower = seed, lower
        self.keys = np.random.default_rng(seed).integers(0, 1 << 63, self.BLOCKS + 1, dtype=np.uint64)

    def words(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        own = np.zeros(len(buf) + 8, dtype=np.uint8)
        own[: len(buf)] = _LOWER[buf] if self.lower else buf
        # Eight bytes from every place on.
        wide = np.ndarray(len(buf) + 1, dtype="<u8", buffer=own, strides=(1,))
        size = ends - starts
        h = mix(size.astype(np.uint64) * _MUL + self.keys[-1])
        open_ = np.arange(len(starts))
        for i in range(self.BLOCKS):
            left = size[open_] - 8 * i
            open_ = open_[left > 0]
            if not len(open_):
                return h
            left = np.minimum(left[left > 0], 8).astype(np.uint64)
            block = wide[starts[open_] + 8 * i] & (_ALL >> (np.uint64(64) - np.uint64(8) * left))
            h[open_] = mix(mix(block + self.keys[i]) ^ h[open_])
        for w in open_[size[open_] > 8 * self.BLOCKS]:
            h[w] = xxhash.xxh3_64_intdigest(own[starts[w] : ends[w]].tobytes(), self.seed)
        return h


def pieces(column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets) of the non-empty pieces of a string column."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + n + 1]
    data = column.buffers()[2]
    whole = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    row = 0
    while row < n:
        end = int(np.searchsorted(offsets, offsets[row] + PIECE_BYTES, side="right")) - 1
        end = min(max(end, row + 1), n)
        yield row, end, whole[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def column(buf: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A string column of its own over the bytes of one piece."""
    data = pa.py_buffer(buf.tobytes())
    return pa.LargeStringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets.astype(np.int64).tobytes()), data)


def spans(buf: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words of each row. ``space`` tells of each byte whether it parts words."""
    solid = ~space[buf]
    edge = np.zeros(len(buf) + 1, dtype=bool)
    edge[offsets] = True
    first = solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:] | edge[1:-1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.diff(np.searchsorted(starts, offsets))


def join_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of ``k`` consecutive word hashes, at every place that has them."""
    m = len(h) - k + 1
    if m <= 0:
        return np.zeros(0, dtype=np.uint64)
    acc = h[:m].copy()
    for i in range(1, k):
        acc ^= acc >> np.uint64(29)
        acc *= _MUL
        acc += h[i : i + m]
    return mix(acc + np.uint64(k))


def window_places(counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Global word index, row and place in the row of every window of ``k`` words."""
    number = np.maximum(counts - k + 1, 0)
    row = np.repeat(np.arange(len(counts)), number)
    place = np.arange(number.sum()) - np.repeat(np.cumsum(number) - number, number)
    first = np.concatenate([[0], np.cumsum(counts)[:-1]]) if len(counts) else np.zeros(0, dtype=np.int64)
    return first[row] + place, row, place
