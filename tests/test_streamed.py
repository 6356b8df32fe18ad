"""The streamed search and the meeting over lists, against brute force."""

from unittest import mock

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from veritrace.operators import lists, nearest, streamed


def batch(tile, side, rows, kind=pa.string()):
    """Rows (id, vector) of one side; the id of an anchor is its key."""
    n, keys = len(rows), pa.array([i if side == 0 else None for i, _ in rows], pa.int64())
    ids = pa.array([None if side == 0 else i for i, _ in rows], kind)
    vectors = pa.array([v for _, v in rows], pa.list_(pa.float32()))
    return pa.RecordBatch.from_arrays([pa.array([tile] * n, pa.int32()), pa.array([side] * n, pa.int32()), keys, keys, ids, vectors], names=streamed.SENT)


@pytest.mark.parametrize("kind", [pa.string(), pa.int64()])
def test_candidates_are_streamed_past_blocks(kind):
    """Ties go to the smaller id, zero and missing vectors come last, and what is held is bounded, over chunks of a few rows and two tiles."""
    rng = np.random.default_rng(4)
    base = [None, [0.0] * 3, *rng.integers(-2, 3, (25, 3)).astype(float).tolist()]
    anchors = [(i, v) for i, v in enumerate(base)]
    ids = (lambda i: f"c{i:03d}") if kind == pa.string() else (lambda i: i)
    candidates = [(ids(i), base[rng.integers(len(base))] if i >= 20 else None) for i in range(150)]

    def order(v, w):
        if v is None or w is None:
            return 4.0
        v, w = np.array(v), np.array(w)
        return 3.0 if not v.any() or not w.any() else round(1 - v @ w / np.linalg.norm(v) / np.linalg.norm(w), 9)

    sent = [batch(t, s, rows[at : at + 40], kind) for t in (3, 5) for s, rows in ((0, anchors), (1, candidates)) for at in range(0, len(rows), 40)]
    with mock.patch.multiple(streamed, CHUNK_ROWS=16, SLICE_ROWS=7, HEAD_ROWS=10):
        got = [r for b in streamed._searched(iter(sent), 6) for r in zip(*(b[c].to_pylist() for c in ("va", "candidate_id", "distance")))]
    want = [(a, c) for _ in "ab" for a, v in anchors for _, c in sorted((order(v, w), c) for c, w in candidates)[:6]]
    assert [(a, c) for a, c, _ in got] == want
    assert all(abs(d - order(base[a], dict(candidates)[c])) < 1e-8 for a, c, d in got)


def test_tiles_send_the_best_only(spark):
    """However many candidates there are, a task per tile gives k a vector, and tiles are dealt one to a task."""
    rows = spark.range(9000).select("id", F.transform(F.sequence(F.lit(1), F.lit(4)), lambda j: F.sin(j * (F.col("id") + 1)).cast("float")).alias("embedding"))
    asked = nearest.vector_key(rows.limit(2500)).select(F.col("vkey.a").alias("va"), F.col("vkey.b").alias("vb"), "embedding")
    best = streamed.best_of_all(asked, rows.select(F.col("id").alias("candidate_id"), "embedding"), 3)
    assert best.rdd.getNumPartitions() == 9 and best.count() == 2500 * 3 * 3


def test_anchors_of_a_common_vector_go_in_pieces(spark):
    """Most anchors have one vector; owners are null at times, and anchors that find too little are told."""
    rng = np.random.default_rng(8)
    owner = lambda: None if rng.random() < 0.2 else int(rng.integers(3))
    asks = [(i, owner(), 7 if i % 3 else int(rng.integers(9)), int(rng.integers(2))) for i in range(400)]
    offers = [(int(rng.integers(2)), int(rng.integers(9)), 1000 + i, owner()) for i in range(60)]
    near = [(v, c, None if c == 8 else float("nan") if c == 4 else abs(v - c) / 10, n + 1) for v in range(9) for n, c in enumerate(sorted(range(9), key=lambda c: (c == 8, c == 4, abs(v - c), c))[:6])]
    frames = [spark.createDataFrame(rows, s) for rows, s in ((asks, "anchor_id long, owner long, vid long, gid long"), (near, "vid long, cvid long, distance double, place int"), (offers, "gid long, cvid long, candidate_id long, c_owner long"))]
    with mock.patch.object(lists, "PIECE", 50):
        got = {r.anchor_id: (r.owner, r.vid, r.gid, [(c.candidate_id, str(c.distance)) for c in r.found]) for r in lists.met_over_lists(*frames, 2, 6).collect()}
    rank = lambda d: 4.0 if d is None else 3.0 if d != d else d
    for a, o, v, g in asks:
        mine = {c: d for w, c, d, _ in near if w == v}
        last = max(rank(d) for d in mine.values())
        found = sorted((rank(mine[c]), i, p, str(mine[c])) for h, c, i, p in offers if h == g and c in mine and rank(mine[c]) < last)[:8]
        assert got.pop(a) == (o, v, g, [(i, d) for _, i, p, d in found if p != o][:2])
    assert not got
