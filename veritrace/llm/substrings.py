"""Repeated passages: words under windows that also start in an earlier document.

First pass: every task counts the hashes of its windows of ``WORDS`` words in a
count-min sketch; the sketches are merged. Second pass: windows whose estimate
is at least two, which misses none that repeats, are grouped exactly, by a
96-bit fingerprint of their words (two hashes of different seeds), to find the least
document of each. Within a task, a window keeps only the places in its least
document; its places in the task's later documents are already decided. A
window shared by a third of all documents thus costs one entry per task.

Entries travel packed by key bucket, answers packed by document bucket, and the
texts meet their answers in one more exchange, answers first, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, functions as F

from veritrace.llm import sketch, words
from veritrace.llm.base import id_or_null, identified, partitions, table

WORDS = 13
#: Counters per sketch row, as a power of two: 64 MB of bits reach an executor.
SKETCH_BITS = 28
#: Windows held by a task before it sends them on.
HELD = 1 << 20
PACKED = "bucket int, answer boolean, hi binary, lo binary, id binary, h binary, place binary"
_FIELDS = (("hi", np.uint64), ("lo", np.uint32), ("id", np.int64), ("h", np.int64), ("place", np.uint32))


def _pack(bucket: int, answer: bool, **arrays: np.ndarray) -> dict:
    squeeze = zstandard.ZstdCompressor(level=1).compress
    return {"bucket": bucket, "answer": answer} | {n: squeeze(np.ascontiguousarray(a, dtype=t).tobytes()) for n, t in _FIELDS if (a := arrays.get(n)) is not None}


def _unpack(row: dict, *names: str) -> list[np.ndarray]:
    open_ = zstandard.ZstdDecompressor().decompress
    return [np.frombuffer(open_(row[n]), dtype=t) for n, t in _FIELDS if n in names]


def _batch(rows: list[dict]) -> pa.RecordBatch:
    fields = [("bucket", pa.int32()), ("answer", pa.bool_())] + [(n, pa.binary()) for n, _ in _FIELDS]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))


def _answers(ids: np.ndarray, h: np.ndarray, place: np.ndarray, buckets: int) -> Iterator[dict]:
    """Places to remove, packed by the bucket of their document."""
    if not len(ids):
        return
    spot = _doc_bucket(ids, h, buckets)
    order = np.lexsort((place, h, ids, spot))
    spot = spot[order]
    for part in np.split(order, np.flatnonzero(np.diff(spot)) + 1):
        yield _pack(int(_doc_bucket(ids[part[:1]], h[part[:1]], buckets)[0]), True, id=ids[part], h=h[part], place=place[part])


def _doc_bucket(ids: np.ndarray, h: np.ndarray, buckets: int) -> np.ndarray:
    """As ``_spot``: copies of a text have different ids and so spread."""
    return np.mod(np.asarray(ids) ^ np.asarray(h), buckets)


def _spot(buckets: int):
    return F.pmod(F.col("_id").bitwiseXOR(F.col("_h")), F.lit(buckets)).cast("int").alias("bucket")


def window_hashes(k: int):
    """Hashes of all windows of the texts of record batches, for the sketch."""

    def hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
        first = words.Hasher(11)
        for batch in batches:
            for _, _, buf, offsets in words.pieces(batch["text"]):
                starts, ends, counts = words.spans(buf, offsets)
                at, _, _ = words.window_places(counts, k)
                yield words.join_hashes(first.words(buf, starts, ends), k)[at]

    return hashes


def _suspects(batches: Iterator[pa.RecordBatch], k: int, seen, buckets: int) -> Iterator[pa.RecordBatch]:
    first, second = words.Hasher(11), words.Hasher(12)
    held: list[tuple[np.ndarray, ...]] = []

    def flush() -> pa.RecordBatch:
        hi, lo, ids, h, place = (np.concatenate(c) for c in zip(*held))
        held.clear()
        order = np.lexsort((place, h, ids, lo, hi))
        hi, lo, ids, h, place = (c[order] for c in (hi, lo, ids, h, place))
        new = np.ones(len(hi), dtype=bool)
        new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        least = ids[new][np.cumsum(new) - 1]
        later = ids > least
        out = list(_answers(ids[later], h[later], place[later], buckets))
        own = ~later
        hi, lo, ids, h, place = (c[own] for c in (hi, lo, ids, h, place))
        # Sorted by hi, so buckets of its leading bits are runs.
        spot = ((hi >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        cuts = np.searchsorted(spot, np.arange(buckets + 1))
        for b in np.flatnonzero(np.diff(cuts)):
            s = slice(cuts[b], cuts[b + 1])
            out.append(_pack(int(b), False, hi=hi[s], lo=lo[s], id=ids[s], h=h[s], place=place[s]))
        return _batch(out)

    for batch in batches:
        key, text_h = batch["_id"].to_numpy(), batch["_h"].to_numpy()
        for row, _, buf, offsets in words.pieces(batch["text"]):
            starts, ends, counts = words.spans(buf, offsets)
            at, doc, place = words.window_places(counts, k)
            if not len(at):
                continue
            hi = words.join_hashes(first.words(buf, starts, ends), k)[at]
            often = np.flatnonzero(seen.value.level(hi))
            if not len(often):
                continue
            lo = words.join_hashes(second.words(buf, starts, ends), k)[at[often]].astype(np.uint32)
            doc = doc[often] + row
            held.append((hi[often], lo, key[doc], text_h[doc], place[often].astype(np.uint32)))
            if sum(len(c[0]) for c in held) >= HELD:
                yield flush()
    if held:
        yield flush()


def _decide(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """Exact grouping of one key bucket after the other; answers pass through."""
    at, held = None, []

    def finish() -> pa.RecordBatch:
        hi, lo, ids, h, place = (np.concatenate(c) for c in zip(*held))
        held.clear()
        order = np.lexsort((ids, lo, hi))
        hi, lo, ids, h, place = (c[order] for c in (hi, lo, ids, h, place))
        new = np.ones(len(hi), dtype=bool)
        new[1:] = (hi[1:] != hi[:-1]) | (lo[1:] != lo[:-1])
        later = ids > ids[new][np.cumsum(new) - 1]
        return _batch(list(_answers(ids[later], h[later], place[later], buckets)))

    for batch in batches:
        through = []
        for row in batch.to_pylist():
            if row["answer"]:
                through.append(row)
                continue
            if row["bucket"] != at and held:
                yield finish()
            at = row["bucket"]
            held.append(_unpack(row, "hi", "lo", "id", "h", "place"))
        if through:
            yield _batch(through)
    if held:
        yield finish()


def _remove(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """Applies the answers of a bucket, which come first, to its documents."""
    at, held, places = None, [], {}

    def listed() -> dict:
        ids, h, place = (np.concatenate(c) for c in zip(*held))
        order = np.lexsort((h, ids))
        ids, h, place = ids[order], h[order], place[order]
        cuts = np.flatnonzero(np.concatenate([[True], (ids[1:] != ids[:-1]) | (h[1:] != h[:-1]), [True]]))
        return {(int(ids[a]), int(h[a])): place[a:b] for a, b in zip(cuts[:-1], cuts[1:])}

    for batch in batches:
        out = {n: [] for n in ("_id", "_h", "n_words", "n_removed", "kept", "spans")}
        for row in batch.to_pylist():
            if row["bucket"] != at:
                at, held, places = row["bucket"], [], {}
            if row["answer"]:
                held.append(_unpack(row, "id", "h", "place"))
                continue
            if held:
                places, held = listed(), []
            tokens = (row["text"] or "").encode().split()
            drop = np.zeros(len(tokens) + 1, dtype=np.int64)
            starts = places.get((row["_id"], row["_h"]))
            if starts is not None:
                np.add.at(drop, starts, 1)
                np.add.at(drop, starts.astype(np.int64) + k, -1)
            gone = np.cumsum(drop)[:-1] > 0
            edges = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
            out["_id"].append(row["_id"])
            out["_h"].append(row["_h"])
            out["n_words"].append(len(tokens))
            out["n_removed"].append(int(gone.sum()))
            out["kept"].append(b" ".join(compress(tokens, ~gone)).decode())
            out["spans"].append([{"first": int(a), "end": int(b)} for a, b in zip(edges[::2], edges[1::2])])
        if out["_id"]:
            span = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_pydict({n: pa.array(v, span if n == "spans" else None) for n, v in out.items()})


def substring_dedup(docs: DataFrame, k: int = WORDS, bits: int = SKETCH_BITS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept (the words
    that stay, joined by one space) and spans (first, end) of removed words.

    A word goes if a window of ``k`` words over it also starts in a row with a
    smaller doc_id. Null ids count as larger than all others; rows of one id do
    not remove each other's words. Null texts have no words. An empty table
    gives no rows.
    """
    spark = docs.sparkSession
    buckets = partitions(spark)
    rows = identified(docs)
    texts = rows.select("text")
    seen = spark.sparkContext.broadcast(sketch.build(texts, window_hashes(k), bits, (2,)))
    suspects = rows.mapInArrow(lambda it: _suspects(it, k, seen, buckets), PACKED)
    # The sort keeps a bucket's entries together, so one bucket is held at a time.
    by_key = suspects.repartition(buckets, "bucket").sortWithinPartitions("bucket")
    answers = by_key.mapInArrow(lambda it: _decide(it, buckets), PACKED).select(
        "bucket", "answer", "id", "h", "place", *(F.lit(None).cast(t).alias(c) for c, t in (("_id", "long"), ("_h", "long"), ("text", "string")))
    )
    own = rows.select(
        _spot(buckets), F.lit(False).alias("answer"), *(F.lit(None).cast("binary").alias(c) for c in ("id", "h", "place")), "_id", "_h", "text"
    )
    met = answers.union(own).repartition(buckets, "bucket").sortWithinPartitions("bucket", F.desc("answer"))
    out = met.mapInArrow(
        lambda it: _remove(it, k),
        "_id long, _h long, n_words long, n_removed long, kept string, spans array<struct<first:long,end:long>>",
    )
    return out.withColumn("doc_id", id_or_null()).drop("_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


SQL = r"""
WITH w AS (
    SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), p AS (
    SELECT doc_id, unnest(range(1, len(ws) - 11)) AS i, ws FROM w
), k AS (
    SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS t FROM p
), m AS (
    SELECT doc_id, i, min(doc_id) OVER (PARTITION BY t) AS least FROM k
), gone AS (
    SELECT DISTINCT doc_id, i + j AS spot FROM m, range(0, 13) r(j) WHERE doc_id > least
), g AS (
    SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id
), kept AS (
    SELECT w.doc_id, string_agg(x.word, ' ' ORDER BY x.i) AS t
    FROM w, LATERAL (SELECT unnest(ws) AS word, generate_subscripts(ws, 1) AS i) x
    LEFT JOIN gone ON gone.doc_id = w.doc_id AND gone.spot = x.i WHERE gone.spot IS NULL GROUP BY w.doc_id
)
SELECT w.doc_id, len(ws) AS n_words, coalesce(g.n, 0) AS n_removed, sha256(coalesce(kept.t, '')) AS kept_sha256
FROM w LEFT JOIN g USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
