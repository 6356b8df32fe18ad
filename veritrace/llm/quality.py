"""Quality classifier by positive-unlabelled learning.

Trusted positives and unlabelled web text, each a bounded sample taken in hash
order, give a model by minimising the non-negative unbiased risk

    prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)])

with the logistic loss. No text is ever taken as a known negative. The class
prior is estimated from the two samples alone: for a set S of texts that a plain
positive-against-unlabelled model ranks high, P_u(S) / P_p(S) is an upper bound, and the
least bound over a grid of S is taken.

Features are shares of character classes, of word shapes and of repeated words and lines of
the whole text, with their squares. Scoring is one pass over the documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veritrace.llm import words
from veritrace.llm.base import table, text_or_empty

#: Rows in each of the two samples that the model is fitted on.
SAMPLE = 20_000
THRESHOLD = 0.3
STEPS, RATE, PENALTY = 600, 0.05, 1e-4

_CLASSES = [b"\n", b"0123456789", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b".", b",", b"!?", b"|", b"%$#&*", b"@:/\\", b"()[]{}<>=_", b"\"'-;+~^`"]
_CLASS = np.full(256, len(_CLASSES), dtype=np.int64)
for _i, _chars in enumerate(_CLASSES):
    _CLASS[list(_chars)] = _i
_CLASS[[9, 11, 12, 13, 32]] = len(_CLASSES) + 1
_NUMBER = len(_CLASSES) + 2
N_FEATURES = _NUMBER + 8


def _distinct(row: np.ndarray, h: np.ndarray, n: int) -> np.ndarray:
    """Distinct values of ``h`` per row."""
    order = np.lexsort((h, row))
    row, h = row[order], h[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return np.bincount(row[new], minlength=n)


def features(column: pa.Array) -> np.ndarray:
    """One row of features per text; empty and null texts give zeros."""
    out = np.zeros((len(column), N_FEATURES))
    hasher = words.Hasher(31)
    for a, b, buf, offsets in words.pieces(column):
        n, sizes = b - a, np.diff(offsets)
        kind = _CLASS[buf]
        row = np.repeat(np.arange(n), sizes)
        shares = np.bincount(row * _NUMBER + kind, minlength=n * _NUMBER).reshape(n, _NUMBER) / np.maximum(sizes, 1)[:, None]
        starts, ends, counts = words.spans(buf, offsets)
        some = np.maximum(counts, 1)
        word_row = np.repeat(np.arange(n), counts)
        h = hasher.words(buf, starts, ends)
        last, first = kind[ends - 1], kind[starts]
        pairs_at, pair_row, _ = words.window_places(counts, 3)
        lines = np.concatenate([[0], np.flatnonzero(buf == 10) + 1, offsets[:-1]]) if len(buf) else np.zeros(0, dtype=np.int64)
        lines = np.unique(lines[lines < len(buf)])
        line_ends = np.concatenate([lines[1:], [len(buf)]]).astype(np.int64)[: len(lines)]
        line_row = row[lines] if len(lines) else np.zeros(0, dtype=np.int64)
        line_count = np.bincount(line_row, minlength=n)
        line_h = hasher.words(buf, lines, line_ends)
        extra = [
            np.log1p(sizes) / 10,
            np.bincount(word_row, weights=ends - starts, minlength=n) / some / 10,
            _distinct(word_row, h, n) / some,
            _distinct(pair_row, words.join_hashes(h, 3)[pairs_at], n) / np.maximum(counts - 2, 1),
            np.bincount(word_row, weights=last >= 6, minlength=n) / some,
            np.bincount(word_row, weights=(first == 2) & (last != 3), minlength=n) / some,
            _distinct(line_row, line_h, n) / np.maximum(line_count, 1),
            np.log1p(counts / np.maximum(line_count, 1)) / 5,
        ]
        out[a:b] = np.column_stack([shares, *extra]) * (sizes > 0)[:, None]
    return out


def _expanded(x: np.ndarray, scale: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    z = np.clip((x - scale[0]) / scale[1], -8, 8)
    return np.column_stack([z, z * z / 4, np.ones(len(z))])


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _fit(p: np.ndarray, u: np.ndarray, prior: float | None) -> np.ndarray:
    """Weights by full-batch Adam. Without a prior, plain positive against unlabelled."""
    w, m, v = (np.zeros(p.shape[1]) for _ in range(3))
    for step in range(1, STEPS + 1):
        zp, zu = p @ w, u @ w
        if prior is None:
            grad = p.T @ (_sigmoid(zp) - 1) / len(p) + u.T @ _sigmoid(zu) / len(u)
        else:
            plus = p.T @ (_sigmoid(zp) - 1) / len(p)
            minus = u.T @ _sigmoid(zu) / len(u) - prior * (p.T @ _sigmoid(zp)) / len(p)
            risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
            # A negative estimate of the negative risk is over-fitting; step back from it.
            grad = prior * plus + minus if risk >= 0 else -minus
        grad = grad + PENALTY * w
        m, v = 0.9 * m + 0.1 * grad, 0.999 * v + 0.001 * grad * grad
        w = w - RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w


def estimate_prior(p: np.ndarray, u: np.ndarray) -> float:
    """Least upper bound P_u(S) / P_p(S) over sets of high plain score."""
    w = _fit(p, u, None)
    zp, zu = p @ w, u @ w
    cuts = np.quantile(zp, np.linspace(0.02, 0.7, 35))
    bounds = [((zu >= c).mean() + 1 / np.sqrt(len(u)) * 0.5) / max((zp >= c).mean(), 1e-9) for c in cuts]
    return float(np.clip(min(bounds), 0.01, 0.99))


def train(positives: np.ndarray, unlabelled: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray, float]:
    scale = (unlabelled.mean(axis=0), unlabelled.std(axis=0) + 1e-6)
    p, u = _expanded(positives, scale), _expanded(unlabelled, scale)
    prior = estimate_prior(p, u)
    return scale, _fit(p, u, prior), prior


def held_out() -> Column:
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 5 == 0


def _sample(docs: DataFrame, ids: DataFrame, n: int) -> np.ndarray:
    """Features of the ``n`` ids that come first in hash order."""
    chosen = ids.filter("doc_id is not null").filter(~held_out()).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(n)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array(list(features(batch["text"])), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch["doc_id"], x], names=["doc_id", "x"])

    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(rows, "doc_id long, x array<double>")
    got = sorted((r["doc_id"], tuple(r["x"])) for r in found.collect())
    return np.array([x for _, x in got[: 2 * n]]) if got else np.zeros((0, N_FEATURES))


def scorer(docs: DataFrame, positives: DataFrame, sample: int = SAMPLE):
    """Fits the model; gives a function from a text column to its score."""
    p, u = _sample(docs, positives.select("doc_id"), sample), _sample(docs, docs.select("doc_id"), sample)
    model = train(p, u) if len(p) and len(u) else None
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        known = shared.value
        if known is None:
            return pa.array(np.full(len(texts), 0.5))
        return pa.array(_sigmoid(_expanded(features(texts), known[0]) @ known[1]))

    return score


def quality_scores(docs: DataFrame, positives: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, held_out, score, predicted.

    ``positives`` has the doc_id of trusted good documents. Rows whose crc32 of
    the id modulo 5 is 0 are never trained on. Null and empty texts are scored like
    others, from zero features; a null id counts as not held out and is not
    trained on. Without any positives or documents to train on, every score is
    0.5. An empty table gives no rows.
    """
    score = scorer(docs, positives, sample)
    scored = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), score(text_or_empty()).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def positives(labels: DataFrame) -> DataFrame:
    return labels.filter("quality = 1").select("doc_id")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return quality_scores(docs, positives(labels))
