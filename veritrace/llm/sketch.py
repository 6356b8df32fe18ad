"""Count-min sketch over 64-bit hashes, built per partition and merged.

A sketch has ``ROWS`` rows of ``2**bits`` counters. Tasks emit the counters they
touched as gaps, in slices, so what is shuffled follows the input and not the
width. Slices are summed in tasks of their own. What the executors get is one
bit per counter and threshold ("the count is at least t"): ``ROWS * len(at) *
2**bits / 8`` bytes, a bound that does not depend on the input. A full sketch
reports more as repeated, never less.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from veritrace.llm.words import mix

ROWS = 2
SLICE_BITS = 22
FLUSH = 1 << 21
SCHEMA = "slice int, salt int, gaps binary, counts binary"
_SEEDS = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344))


def _cells(h: np.ndarray, row: int, bits: int) -> np.ndarray:
    return mix(h ^ _SEEDS[row]) >> np.uint64(64 - bits)


def _encode(slice_no: int, salt: int, places: np.ndarray, counts: np.ndarray) -> dict:
    pack = zstandard.ZstdCompressor(level=1).compress
    gaps = np.diff(places, prepend=0).astype(np.uint32)
    wide = np.frombuffer(gaps.tobytes(), dtype=np.uint8).reshape(-1, 4).T.copy()
    return {"slice": slice_no, "salt": salt, "gaps": pack(wide.tobytes()), "counts": pack(counts.astype(np.uint32).tobytes())}


def _decode(gaps: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    unpack = zstandard.ZstdDecompressor().decompress
    wide = np.frombuffer(unpack(gaps), dtype=np.uint8).reshape(4, -1).T.copy()
    return np.cumsum(wide.view(np.uint32).ravel().astype(np.int64)), np.frombuffer(unpack(counts), dtype=np.uint32)


def _batch(rows: list[dict]) -> pa.RecordBatch:
    fields = [("slice", pa.int32()), ("salt", pa.int32()), ("gaps", pa.binary()), ("counts", pa.binary())]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))


def counted(hashes: Iterator[np.ndarray], bits: int, salts: int) -> Iterator[pa.RecordBatch]:
    """The touched counters of one task, flushed every few million hashes."""
    from pyspark import TaskContext

    salt = TaskContext.get().partitionId() % salts
    width = min(SLICE_BITS, bits)
    held: list[np.ndarray] = []

    def flush() -> pa.RecordBatch:
        h = np.concatenate(held)
        out = []
        for row in range(ROWS):
            cells, counts = np.unique(_cells(h, row, bits), return_counts=True)
            cells = cells.astype(np.int64)
            cuts = np.searchsorted(cells, np.arange((1 << (bits - width)) + 1) << width)
            for i in np.flatnonzero(np.diff(cuts)):
                a, b = cuts[i], cuts[i + 1]
                out.append(_encode((row << (bits - width)) + int(i), salt, cells[a:b] - (int(i) << width), counts[a:b]))
        held.clear()
        return _batch(out)

    for h in hashes:
        held.append(h)
        if sum(map(len, held)) >= FLUSH:
            yield flush()
    if held and sum(map(len, held)):
        yield flush()


def _merger(bits: int, finish: Callable[[int, int, np.ndarray], pa.RecordBatch]):
    width = min(SLICE_BITS, bits)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, sums = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if (row["slice"], row["salt"]) != at:
                    if at is not None:
                        yield finish(*at, sums)
                    at, sums = (row["slice"], row["salt"]), np.zeros(1 << width, dtype=np.int64)
                places, counts = _decode(row["gaps"], row["counts"])
                sums[places] += counts
        if at is not None:
            yield finish(*at, sums)

    return merge


class Sketch:
    """Looks hashes up in the broadcast bits."""

    def __init__(self, planes: list[list[np.ndarray]], bits: int):
        self.planes, self.bits = planes, bits

    def level(self, h: np.ndarray) -> np.ndarray:
        """How many thresholds the estimated count of each hash reaches."""
        out = np.zeros(len(h), dtype=np.uint8)
        cells = [_cells(h, row, self.bits) for row in range(ROWS)]
        for planes in self.planes:
            reached = np.ones(len(h), dtype=bool)
            for cell, plane in zip(cells, planes):
                reached &= (plane[cell >> np.uint64(3)] >> (np.uint64(7) - (cell & np.uint64(7))).astype(np.uint8)) & 1 == 1
            out += reached
        return out


def build(docs: DataFrame, hashes, bits: int, at: tuple[int, ...]) -> Sketch:
    """``hashes`` turns record batches of ``docs`` into arrays of 64-bit hashes."""
    width = min(SLICE_BITS, bits)
    salts = 1 + docs.rdd.getNumPartitions() // 256
    parts = docs.mapInArrow(lambda batches: counted(hashes(batches), bits, salts), SCHEMA)
    n = ROWS << (bits - width)

    def passed_on(slice_no: int, salt: int, sums: np.ndarray) -> pa.RecordBatch:
        places = np.flatnonzero(sums)
        return _batch([_encode(slice_no, 0, places, np.minimum(sums[places], (1 << 32) - 1))])

    def planes(slice_no: int, salt: int, sums: np.ndarray) -> pa.RecordBatch:
        bitsets = [np.packbits(sums >= t).tobytes() for t in at]
        return pa.RecordBatch.from_pydict({"slice": pa.array([slice_no], pa.int32()), "planes": pa.array([bitsets], pa.list_(pa.binary()))})

    if salts > 1:
        parts = parts.repartition(n * salts, "slice", "salt").sortWithinPartitions("slice", "salt")
        parts = parts.mapInArrow(_merger(bits, passed_on), SCHEMA)
    merged = parts.repartition(n, "slice").sortWithinPartitions("slice", "salt")
    merged = merged.mapInArrow(_merger(bits, planes), "slice int, planes array<binary>")
    out = [[np.zeros(max(1, (1 << bits) // 8), dtype=np.uint8) for _ in range(ROWS)] for _ in at]
    size = max(1, (1 << width) // 8)
    # One slice after the other, so that the driver holds the bits once.
    for row in merged.toLocalIterator():
        r, i = divmod(row["slice"], 1 << (bits - width))
        for plane, data in zip(out, row["planes"]):
            plane[r][i * size : (i + 1) * size] = np.frombuffer(data, dtype=np.uint8)
    return Sketch(out, bits)
