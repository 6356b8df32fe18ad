"""The nearest of all candidates for every anchor, with the candidates streamed past blocks of anchors.

Anchors are dealt to blocks and candidates to parts; a task holds the anchors of one block and the best
that each has found, and reads the candidates of one part in chunks, in the order of their ids. Products are taken in short numbers,
and only what may be among the best by them is compared exactly, so a pair costs little more than its product.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from veritrace.session import materialize

#: Stand-ins for the distance to a zero and to a missing vector; a cosine distance is at most 2.
NAN, MISSING = 3.0, 4.0
#: Rows at most of a block of anchors and of a part of the candidates.
BLOCK_ROWS, PART_ROWS = 32_768, 1 << 18
#: There are as many blocks and tasks as these at least, unless they would have fewer rows than the last two.
BLOCKS, TASKS, LEAST_BLOCK, LEAST_PART = 8, 48, 1024, 4096
#: Candidates read, anchors compared with them, and candidates that give a first bound, at a time.
CHUNK_ROWS, SLICE_ROWS, HEAD_ROWS = 8192, 128, 8192
SENT = ["tile", "side", "va", "vb", "candidate_id", "embedding"]


def _units(batches: list[pa.RecordBatch], dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Unit rows, and masks of the zero and the missing vectors."""
    column = pa.chunked_array([b["embedding"] for b in batches]).combine_chunks()
    missing = column.is_null().to_numpy(zero_copy_only=False)
    out = np.zeros((len(column), dim))
    if not missing.all():
        out[~missing] = column.drop_null().flatten().to_numpy().astype(np.float64).reshape(-1, dim)
    size = np.linalg.norm(out, axis=1)
    out[size > 0] /= size[size > 0, None]
    return out, (size == 0) & ~missing, missing


def _dim(batches: list[pa.RecordBatch]) -> int:
    for batch in batches:
        told = batch["embedding"].drop_null()
        if len(told):
            return len(told[0])
    return 0


class _Block:
    """The anchors of a block and the best that each has found."""

    def __init__(self, batches: list[pa.RecordBatch], k: int):
        self.k, self.batches, self.dim = k, batches, 0
        self.keys = [np.concatenate([b[c].to_numpy() for b in batches]) for c in ("va", "vb")]
        n = len(self.keys[0])
        self.distance = np.full((n, k), np.inf)
        self.ids: np.ndarray | None = None
        # A candidate of less similarity, in short numbers, is no result.
        self.least = np.full(n, -np.inf, dtype=np.float32)
        self.held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self._unit(_dim(batches))

    def _unit(self, dim: int) -> None:
        """Made anew if the anchors have no numbers and the candidates tell how many there are."""
        self.dim = dim
        self.unit, zero, missing = _units(self.batches, dim)
        self.short = self.unit.astype(np.float32)
        # What stands in for the similarity to any candidate with a vector.
        self.only = np.where(missing, 1 - MISSING, np.where(zero, 1 - NAN, 0.0))
        # Short sums err by less than this, on either side of a bound.
        self.margin = 2 * (dim + 8) * 2.0**-23

    def meet(self, batches: list[pa.RecordBatch]) -> None:
        ids = pa.chunked_array([b["candidate_id"] for b in batches]).to_numpy()
        if self.ids is None:
            self.ids = np.zeros(self.distance.shape, dtype=ids.dtype)
        if not self.dim and (dim := _dim(batches)):
            self._unit(dim)
        vectors, zero, missing = _units(batches, self.dim)
        short, odd = vectors.astype(np.float32).T, zero | missing
        of_odd = np.where(missing, 1 - MISSING, 1 - NAN).astype(np.float32)
        width = len(ids)
        for at in range(0, len(self.least), SLICE_ROWS):
            part = slice(at, at + SLICE_ROWS)
            like, least, only = self.short[part] @ short, self.least[part].copy(), self.only[part]
            if odd.any():
                like[:, odd] = of_odd[odd]
            for row in np.flatnonzero(only):
                like[row] = np.minimum(only[row], np.where(missing, 1 - MISSING, 1.0))
            new = np.flatnonzero(np.isneginf(least))
            if new.size:
                head = like[new, :HEAD_ROWS]
                if head.shape[1] > self.k:
                    cut = head.shape[1] - self.k
                    least[new] = np.partition(head, cut, axis=1)[:, cut] - self.margin
            spot = np.flatnonzero(like >= least[:, None])
            if not len(spot):
                continue
            row, col = np.divmod(spot, width)
            # Summed row by row, so that equal vectors tie exactly.
            distance = 1.0 - (self.unit[row + at] * vectors[col]).sum(axis=1)
            apart = odd[col] | (only[row] != 0)
            distance[apart] = np.where(like[row[apart], col[apart]] < -2.5, MISSING, NAN)
            # Ids grow, so of equal distances the first ones stay.
            better = distance < self.distance[row + at, -1]
            self.held.append((row[better] + at, distance[better], ids[col[better]]))
            if new.size or sum(len(h[0]) for h in self.held) > self.distance.size // 2:
                self._settle()

    def _settle(self) -> None:
        """Puts what was held among the best."""
        if not self.held:
            return
        rows, distance, ids = (np.concatenate(x) for x in zip(*self.held))
        self.held = []
        if not len(rows):
            return
        touched, row = np.unique(rows, return_inverse=True)
        had_row, had = np.nonzero(np.isfinite(self.distance[touched]))
        # Earlier ones first: the sort keeps the order of equal distances.
        row = np.concatenate([had_row, row])
        distance = np.concatenate([self.distance[touched[had_row], had], distance])
        ids = np.concatenate([self.ids[touched[had_row], had], ids])
        order = np.lexsort((distance, row))
        row = row[order]
        place = np.arange(len(row)) - np.searchsorted(row, row, side="left")
        best = place < self.k
        row, place, order = touched[row[best]], place[best], order[best]
        self.distance[row, place], self.ids[row, place] = distance[order], ids[order]
        last = self.distance[touched, -1]
        self.least[touched] = np.where(np.isfinite(last), 1.0 - last - self.margin, -np.inf)

    def found(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        self._settle()
        for at in range(0, len(self.least), CHUNK_ROWS):
            row, place = np.nonzero(np.isfinite(self.distance[at : at + CHUNK_ROWS]))
            if len(row):
                row += at
                columns = [*(key[row] for key in self.keys), self.ids[row, place], self.distance[row, place]]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _searched(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by tile, the anchors before the candidates, and those by id."""
    at, held, block, schema = (None, 0), [], None, None

    def flush() -> None:
        nonlocal block, held
        if held and at[1] == 0:
            block = _Block(held, k)
        elif held and block is not None:
            block.meet(held)
        held = []

    for batch in batches:
        schema = schema or pa.schema([("va", pa.int64()), ("vb", pa.int64()), batch.schema.field("candidate_id"), ("distance", pa.float64())])
        part = batch["tile"].to_numpy().astype(np.int64) * 2 + batch["side"].to_numpy()
        cuts = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
        for a, b in zip(cuts[:-1], cuts[1:]):
            now = divmod(int(part[a]), 2)
            if now != at:
                flush()
                if now[0] != at[0]:
                    if block is not None:
                        yield from block.found(schema)
                    block = None
                at = now
            held.append(batch.slice(a, b - a))
            if at[1] and sum(h.num_rows for h in held) >= CHUNK_ROWS:
                flush()
    flush()
    if block is not None:
        yield from block.found(schema)


def best_of_all(asked: DataFrame, offered: DataFrame, k: int) -> DataFrame:
    """va, vb, candidate_id and distance (with stand-ins) of the best ``k`` per anchor and part of the candidates.

    ``asked``: va, vb, embedding, a row per vector. ``offered``: candidate_id, embedding."""
    asked, offered = materialize(asked, "asked"), materialize(offered, "offered")
    a, c = asked.count(), offered.count()
    blocks = max(1, min(BLOCKS, -(-a // LEAST_BLOCK)), -(-a // BLOCK_ROWS))
    parts = max(1, min(-(-TASKS // blocks), -(-c // LEAST_PART)), -(-c // PART_ROWS))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("part", each(parts)).select(
        (F.pmod("va", F.lit(blocks)) * parts + F.col("part")).cast("int").alias("tile"), F.lit(0).alias("side"), "va", "vb",
        F.lit(None).cast(offered.schema["candidate_id"].dataType).alias("candidate_id"), "embedding",
    )
    right = offered.withColumn("block", each(blocks)).select(
        (F.col("block") * parts + F.pmod(F.xxhash64("candidate_id"), F.lit(parts))).cast("int").alias("tile"), F.lit(1).alias("side"),
        F.lit(None).cast("long").alias("va"), F.lit(None).cast("long").alias("vb"), "candidate_id", "embedding",
    )
    # A task per tile, as all have about the same work.
    met = left.select(SENT).union(right.select(SENT)).repartitionById(blocks * parts, "tile").sortWithinPartitions("tile", "side", "candidate_id")
    kind = offered.schema["candidate_id"].dataType.simpleString()
    return met.mapInArrow(lambda it: _searched(it, k), f"va long, vb long, candidate_id {kind}, distance double")
