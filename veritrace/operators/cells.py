"""Approximate nearest neighbours through an inverted file of trained cells."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, functions as F

from veritrace.operators.inverted import CellsOf, nearest_in_cells, served_or_exact, unit
from veritrace.operators.nearest import nearest

#: Rows the cells are fitted on, in hash order; every row is indexed.
SAMPLE = 16_384
#: Cells at most; with SAMPLE the bound of what the driver holds and tasks receive.
CELLS = 1_024
#: Share of the exact neighbours to be found in the sample.
RECALL = 0.93
_ROUNDS, _ASKED = 10, 512


@dataclass(frozen=True)
class Cells:
    """Unit centres, one per row, and how many of the nearest cells to search."""

    centres: np.ndarray
    probes: int


def train_cells(rows: DataFrame, k: int, recall: float = RECALL, sample: int = SAMPLE, most: int = CELLS, seed: int = 7) -> Cells | None:
    """Cells for the vectors in ``rows.embedding``, about the root of their
    number, by spherical k-means on a sample. The number of probes is the least
    by which sampled anchors find ``recall`` of their ``k`` exact neighbours
    in the sample: few where the vectors cluster, most cells where they do
    not. None if there is no vector but zero and missing ones."""
    real = rows.select("embedding").filter(F.exists("embedding", lambda x: x != 0))
    n = real.count()
    taken = real.orderBy(F.xxhash64("embedding"), "embedding").limit(sample).toPandas()["embedding"]
    if n == 0:
        return None
    data = unit(np.stack(taken.to_numpy()).astype(np.float64))
    rng = np.random.default_rng(seed)
    centres = data[np.sort(rng.permutation(len(data))[: min(int(np.ceil(np.sqrt(n))), most, len(data))])]
    for _ in range(_ROUNDS):
        own = (data @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, data)
        centres = np.where(np.bincount(own, minlength=len(centres))[:, None] > 0, unit(sums), centres)
    own = (data @ centres.T).argmax(axis=1)
    asked = data[rng.permutation(len(data))[:_ASKED]]
    best = np.argsort(-(asked @ data.T), axis=1, kind="stable")[:, :k]
    # At which probe each neighbour's cell has its turn.
    turn = np.argsort(np.argsort(-(asked @ centres.T), axis=1, kind="stable"), axis=1)
    turns = np.sort(np.take_along_axis(turn, own[best], axis=1).ravel())
    return Cells(centres, int(turns[int(np.ceil(recall * len(turns))) - 1]) + 1)


def _nearest_cells(centres: np.ndarray, probes: int) -> CellsOf:
    """The numbers of the ``probes`` nearest cells of each vector, in any order."""

    def cells(vectors: np.ndarray) -> np.ndarray:
        like = vectors @ centres.T
        if probes == 1:
            return like.argmax(axis=1)[:, None]
        return np.argpartition(-like, probes - 1, axis=1)[:, :probes]

    return cells


def nearest_by_cells(anchors: DataFrame, candidates: DataFrame, k: int, cells: Cells | None = None) -> DataFrame:
    """Approximate ``nearest``: anchor_id, candidate_id, distance, rank.

    Every candidate is in the cell of its nearest centre, and an anchor is
    compared, by exact distance, with the candidates of the cells nearest to
    it. Anchors that find fewer than ``k`` so, such as those with a zero or
    missing vector, are answered exactly. Ties go to the smaller id. A cell of
    any size is compared in blocks. ``cells`` may be kept and used for later
    candidates; without, they are trained on these.
    """
    cells = cells or train_cells(candidates, k)
    if cells is None:
        return nearest(anchors, candidates, k)

    found = nearest_in_cells(anchors, candidates, k, _nearest_cells(cells.centres, cells.probes), _nearest_cells(cells.centres, 1))
    return served_or_exact(found, anchors, candidates, k)
