"""Language of texts, as a mixture of languages that each text may have.

Training counts hashed byte n-grams per language over all labelled texts. Letters are
lower-cased in A-Z, everything outside letters and bytes above 127 is one blank,
and a text has a blank before and after it. Smoothed shares of the counts are the n-gram
likelihoods ``p(g | language)``.

A text is a bag of n-grams drawn from a mixture of languages, whose proportions
expectation-maximisation estimates. The set of languages grows from the likeliest single one:
the language with the steepest gain joins, the proportions are estimated
anew, and it stays if the likelihood rises by more than the penalty for one more
language, ``log(n)/2`` as n-grams overlap ``GRAM`` times. The likelihood is
concave in the proportions, so where even the steepest gain cannot reach the penalty, no estimation is made.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veritrace.llm import words
from veritrace.llm.base import table

GRAM, BITS = 3, 16
SMOOTHING = 0.5
STEPS = 25
UNKNOWN = "und"
#: N-grams that estimation handles at once, times languages, about.
CHUNK = 1 << 22

_FOLD = np.full(256, 32, dtype=np.uint32)
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
_FOLD[128:] = np.arange(128, 256)


def grams(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and buckets of all n-grams that are not blank."""
    n = len(offsets) - 1
    row = np.repeat(np.arange(n), np.diff(offsets))
    padded = np.full(len(buf) + 2 * n, 32, dtype=np.uint32)
    padded[np.arange(len(buf)) + 2 * row + 1] = _FOLD[buf]
    owner = np.repeat(np.arange(n), np.diff(offsets) + 2)
    m = max(len(padded) - GRAM + 1, 0)
    key, blank = np.zeros(m, dtype=np.uint32), np.ones(m, dtype=bool)
    for i in range(GRAM):
        part = padded[i : i + m]
        key = key << np.uint32(8) | part
        blank &= part == 32
    use = ~blank & (owner[:m] == owner[GRAM - 1 :][:m])
    return owner[:m][use], ((key[use] * np.uint32(0x9E3779B1)) >> np.uint32(32 - BITS)).astype(np.int64)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        langs = batch["lang"].dictionary_encode()
        names, of = langs.dictionary.to_pylist(), langs.indices.to_numpy()
        for at, _, buf, offsets in words.pieces(batch["text"]):
            row, bucket = grams(buf, offsets)
            own = np.bincount((of[at + row] << BITS) + bucket, minlength=len(names) << BITS)
            for name, counts in zip(names, own.reshape(len(names), -1)):
                sums[name] = sums.get(name, 0) + counts
    for name, counts in sums.items():
        bucket = np.flatnonzero(counts)
        columns = [pa.array([name] * len(bucket), pa.string()), pa.array(bucket, pa.int32()), pa.array(counts[bucket], pa.int64())]
        yield pa.RecordBatch.from_arrays(columns, names=["lang", "bucket", "n"])


class Model:
    """N-gram likelihoods of the languages, by name."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.langs = sorted(counts)
        table = np.array([counts[name] for name in self.langs], dtype=np.float64).reshape(len(self.langs), 1 << BITS) + SMOOTHING
        self.likelihood = np.ascontiguousarray((table / table.sum(axis=1, keepdims=True)).T, dtype=np.float32)

    def mixtures(self, row: np.ndarray, bucket: np.ndarray, n: np.ndarray, rows: int) -> np.ndarray:
        """Proportions (rows, languages) of texts given as sorted rows, buckets and counts; zeros without n-grams."""
        k = len(self.langs)
        shares = np.zeros((rows, k))
        own, first = np.unique(row, return_index=True)
        if not len(own):
            return shares
        like = self.likelihood[bucket].astype(np.float64)
        total = np.add.reduceat(n, first).astype(np.float64)
        singles = np.add.reduceat(np.log(like) * n[:, None], first, axis=0)
        theta = np.zeros((len(own), k))
        theta[np.arange(len(own)), singles.argmax(axis=1)] = 1
        best = singles.max(axis=1)
        penalty = GRAM * np.log(np.maximum(total, 1)) / 2
        spans = np.diff(np.append(first, len(row)))
        open_ = np.arange(len(own))
        for _ in range(k - 1):
            if not len(open_):
                break
            picked, starts, at = _pick(first, spans, open_)
            weight, now = n[picked], like[picked]
            mixed = (now * theta[open_][at]).sum(axis=1)
            slope = np.add.reduceat(now * (weight / mixed)[:, None], starts, axis=0) / total[open_, None]
            slope[theta[open_] > 0] = -np.inf
            steepest = slope.argmax(axis=1)
            reach = total[open_] * (slope.max(axis=1) - 1)
            worth = np.flatnonzero(reach > penalty[open_])
            if not len(worth):
                break
            entrant, open_ = steepest[worth], open_[worth]
            picked, starts, at = _pick(first, spans, open_)
            weight, now = n[picked][:, None], like[picked]
            tried = theta[open_] * 0.9
            tried[np.arange(len(open_)), entrant] = 0.1
            for _ in range(STEPS):
                part = now * tried[at]
                part *= weight / part.sum(axis=1, keepdims=True)
                tried = np.add.reduceat(part, starts, axis=0) / total[open_, None]
            reached = np.add.reduceat(np.log((now * tried[at]).sum(axis=1)) * weight[:, 0], starts)
            better = reached - best[open_] > penalty[open_]
            open_, tried, reached = open_[better], tried[better], reached[better]
            theta[open_], best[open_] = tried, reached
        shares[own] = theta
        return shares


def _pick(first: np.ndarray, spans: np.ndarray, texts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of some texts, where each begins among them, and the text of each entry."""
    size = spans[texts]
    starts = np.cumsum(size) - size
    at = np.repeat(np.arange(len(texts)), size)
    return first[texts][at] + np.arange(size.sum()) - starts[at], starts, at


def _told(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    k = len(model.langs)
    kind = pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())]))
    for batch in batches:
        shares = np.zeros((batch.num_rows, k))
        for at, end, buf, offsets in words.pieces(batch["text"]) if k else ():
            row, bucket = grams(buf, offsets)
            key, n = np.unique((row << BITS) + bucket, return_counts=True)
            row = key >> BITS
            # Whole texts, as many as a chunk holds.
            limit = max(1, CHUNK // k)
            a = 0
            while a < len(key):
                b = len(key) if a + limit >= len(key) else int(np.searchsorted(row, row[a + limit]))
                b = b if b > a else int(np.searchsorted(row, row[a], side="right"))
                lo, hi = int(row[a]), int(row[b - 1]) + 1
                shares[at + lo : at + hi] = model.mixtures(row[a:b] - lo, key[a:b] & ((1 << BITS) - 1), n[a:b], hi - lo)
                a = b
        letters = pc.fill_null(pc.match_substring_regex(batch["text"], r"\p{L}"), False).to_numpy(zero_copy_only=False)
        known = letters & (shares.sum(axis=1) > 0) if k else np.zeros(batch.num_rows, dtype=bool)
        top = shares.argmax(axis=1) if k else np.zeros(batch.num_rows, dtype=np.int64)
        lang = [model.langs[i] if ok else UNKNOWN for i, ok in zip(top, known)]
        score = np.where(known, np.minimum(shares.max(axis=1, initial=0), 1), 0.0)
        sets = [[{"lang": model.langs[i], "share": float(s[i])} for i in np.argsort(-s, kind="stable") if s[i] > 0] if ok else [] for s, ok in zip(shares, known)]
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], batch["held_out"], pa.array(lang, pa.string()), pa.array(score), pa.array(sets, kind)],
            names=["doc_id", "held_out", "lang_pred", "score", "languages"],
        )


def held_out() -> Column:
    return F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")) % 4 == 2


def learn(labelled: DataFrame) -> Model:
    """Counts over all rows of ``labelled`` (text, lang); the driver gets one number per language and bucket."""
    rows = labelled.filter("lang is not null and text is not null").select("lang", "text")
    sums = rows.mapInArrow(_counted, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    per = sums.groupBy("lang").agg(F.collect_list("bucket").alias("bucket"), F.collect_list("n").alias("n"))
    counts = {}
    for r in per.collect():
        counts[r["lang"]] = np.zeros(1 << BITS, dtype=np.int64)
        counts[r["lang"]][r["bucket"]] = r["n"]
    return Model(counts)


def identify(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text, lang): doc_id, held_out, lang_pred, score and languages
    (lang, share; the selected set, greatest share first).

    Rows whose crc32 of the id modulo 4 is 2 are held out and not learned from, nor are rows without id,
    text or lang; a null id counts as not held out. ``lang_pred`` has the greatest share, equal ones in the order of their
    names, and ``score`` is that share. Texts that are null or have no letter, and all texts if nothing was learned, are ``und`` with
    score 0 and no languages. Texts are taken whole, in memory in proportion to them. Repeated rows are each told on their own. An
    empty table gives no rows; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs.filter(~held_out())))
    rows = docs.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(
        lambda it: _told(it, shared.value),
        "doc_id long, held_out boolean, lang_pred string, score double, languages array<struct<lang:string,share:double>>",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(table(spark, sf_dir, "documents"))
