"""Exact top-k search of binary codes by incremental multi-index hashing.

A vector's code is the signs of its numbers. Equal codes are one entry with the
``k + 1`` least ids, which is all a top-k can use, so copies cost nothing. Entries are dealt
to blocks; a block cuts codes into segments and sorts each segment's values. A block of
queries visits each block of entries: radius by radius, all segment values within
the radius are looked up, new entries verified, and a query is done when its kth distance is at most
what the radii searched so far guarantee: with ``m`` segments of which the first ``j`` have been
searched to radius ``r`` and the others to ``r - 1``, every code within ``m * r + j - 1`` has been seen.
Per query and block the k best come out, and their best over the blocks is the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from veritrace.llm.base import keep, table

SEGMENT_BITS, K = 16, 10
#: Distinct codes in a block of entries, and queries in a block of queries.
BLOCK, QUERY_BLOCK = 1 << 16, 1 << 10


def sign_codes(vectors: DataFrame) -> DataFrame:
    """(vec_id, code): one bit per number, 1 if above 0. Null vectors and ids have no code;
    a null or NaN number gives 0."""

    def signs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = [np.packbits(np.nan_to_num(np.array(v, dtype=np.float64), nan=0.0) > 0).tobytes() for v in batch["embedding"].to_pylist()]
            dims = [len(v) for v in batch["embedding"].to_pylist()]
            yield pa.RecordBatch.from_arrays([batch["vec_id"], pa.array(dims, pa.int32()), pa.array(codes, pa.binary())], names=["vec_id", "dim", "code"])

    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.filter("vec_id is not null and embedding is not null and size(embedding) > 0").mapInArrow(signs, "vec_id long, dim int, code binary")


class Block:
    """Distinct codes with an index on every segment."""

    def __init__(self, codes: np.ndarray, dim: int):
        self.codes = codes
        self.cuts = list(range(0, dim, SEGMENT_BITS)) + [dim]
        bits = np.unpackbits(codes, axis=1)[:, :dim]
        self.index = []
        for values in (self.values(bits, j) for j in range(self.segments)):
            order = np.argsort(values, kind="stable")
            self.index.append((order, np.searchsorted(values[order], np.arange((1 << SEGMENT_BITS) + 1))))

    @property
    def segments(self) -> int:
        return len(self.cuts) - 1

    def values(self, bits: np.ndarray, j: int) -> np.ndarray:
        part = bits[:, self.cuts[j] : self.cuts[j + 1]].astype(np.int64)
        return part @ (1 << np.arange(part.shape[1])[::-1])

    def masks(self, j: int, radius: int) -> np.ndarray:
        width = self.cuts[j + 1] - self.cuts[j]
        return np.array([sum(1 << b for b in c) for c in combinations(range(width), radius)], dtype=np.int64)

    def nearest(self, query: np.ndarray, bits: np.ndarray, k: int, sizes: np.ndarray, masks: dict) -> tuple[np.ndarray, np.ndarray]:
        """Entries and distances that hold the k nearest rows, ties whole."""
        own = [int(self.values(bits[None, :], j)[0]) for j in range(self.segments)]
        seen = np.zeros(len(self.codes), dtype=bool)
        found, dist = [], []
        for radius in range(SEGMENT_BITS + 1):
            for j, value in enumerate(own):
                if (j, radius) not in masks:
                    masks[j, radius] = self.masks(j, radius)
                order, starts = self.index[j]
                keys = value ^ masks[j, radius]
                a, b = starts[keys], starts[keys + 1]
                some = b > a
                a, n = a[some], (b - a)[some]
                spots = np.repeat(a - (np.cumsum(n) - n), n) + np.arange(n.sum())
                new = order[spots]
                new = new[~seen[new]]
                if len(new):
                    seen[new] = True
                    found.append(new)
                    dist.append(np.bitwise_count(self.codes[new] ^ query).sum(axis=1).astype(np.int64))
                covered = self.segments * radius + j
                if found:
                    all_d, all_n = np.concatenate(dist), sizes[np.concatenate(found)]
                    if all_n[all_d <= covered].sum() >= k:
                        return np.concatenate(found), all_d
        return (np.concatenate(found), np.concatenate(dist)) if found else (np.zeros(0, dtype=np.int64),) * 2


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, block: int = BLOCK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, distance): the k nearest other rows of each query.

    Rows are ordered by Hamming distance of their sign codes, then vec_id; the query's own id is left
    out. Only vectors of one dimension are compared. Rows that agree in id and
    code count once; an id with several codes is found by each, and searched for with the
    best of them. Null or empty vectors are neither found nor searched for. An
    empty table gives no rows.
    """
    codes = keep(sign_codes(vectors).distinct(), "codes")
    # k + 1 least ids of each code: the query's own id may be one of them.
    least = Window.partitionBy("dim", "code").orderBy("vec_id")
    ids = codes.withColumn("n", F.row_number().over(least)).filter(F.col("n") <= k + 1)
    entries = keep(ids.groupBy("dim", "code").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")), "entries")
    total = entries.count()
    blocks = max(1, -(-total // block))
    asked = keep(codes.join(queries.select("vec_id").distinct(), "vec_id"), "asked")
    n_asked = max(1, -(-asked.count() // query_block))
    packed_entries = entries.groupBy("dim", F.pmod(F.xxhash64("code"), F.lit(blocks)).alias("block")).agg(
        F.collect_list(F.struct("code", "ids")).alias("entries")
    )
    packed_queries = asked.groupBy("dim", F.pmod(F.xxhash64("vec_id", "code"), F.lit(n_asked)).alias("part")).agg(
        F.collect_list(F.struct("vec_id", "code")).alias("asked")
    ).withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    visits = packed_queries.join(packed_entries, ["dim", "block"]).select("dim", "asked", "entries")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for visit in range(batch.num_rows):
                dim, asked_, entries_ = (batch[c][visit].as_py() for c in ("dim", "asked", "entries"))
                codes_ = np.frombuffer(b"".join(e["code"] for e in entries_), dtype=np.uint8).reshape(len(entries_), -1)
                sizes = np.array([len(e["ids"]) for e in entries_], dtype=np.int64)
                own, masks = Block(codes_, dim), {}
                out = {"query_id": [], "vec_id": [], "distance": []}
                for q in asked_:
                    query = np.frombuffer(q["code"], dtype=np.uint8)
                    at, dist = own.nearest(query, np.unpackbits(query)[:dim], k + 1, sizes, masks)
                    if len(dist) > k + 1:
                        kth = np.partition(dist, k)[k]
                        at, dist = at[dist <= kth], dist[dist <= kth]
                    rows = sorted((int(d), i) for a, d in zip(at, dist) for i in entries_[a]["ids"] if i != q["vec_id"])[:k]
                    out["query_id"] += [q["vec_id"]] * len(rows)
                    out["vec_id"] += [i for _, i in rows]
                    out["distance"] += [d for d, _ in rows]
                yield pa.RecordBatch.from_pydict({n: pa.array(v, pa.int64()) for n, v in out.items()})

    found = visits.repartition(blocks * n_asked).mapInArrow(search, "query_id long, vec_id long, distance long")
    best = Window.partitionBy("query_id").orderBy("distance", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", F.col("distance").cast("int").alias("distance"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.filter("vec_id % 100 = 0"))


SQL = """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CASE WHEN x > 0 AND NOT isnan(x) THEN 1 ELSE 0 END) AS code FROM embeddings
), p AS (
    SELECT q.vec_id AS query_id, v.vec_id, list_sum(list_transform(list_zip(q.code, v.code), lambda z: abs(z[1] - z[2]))) AS distance
    FROM v q JOIN v ON q.vec_id % 100 = 0 AND q.vec_id <> v.vec_id AND len(q.code) = len(v.code)
)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, CAST(distance AS INT) AS distance
FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p) WHERE rank <= 10
"""
