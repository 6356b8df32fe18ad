"""Vector expressions on ``array<float>`` columns."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, functions as F, types as T

from veritrace.functions.text import NON_WS


def dot(a: Column, b: Column) -> Column:
    """Inner product accumulated in double precision."""
    return F.aggregate(
        F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")),
        F.lit(0.0).cast("double"),
        lambda acc, x: acc + x,
    )


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine_distance(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """``1 - cos(a, b)``; NULL if a side is NULL, NaN if a side is all zeros."""
    length = (norm(a) if norm_a is None else norm_a) * (norm(b) if norm_b is None else norm_b)
    return F.when(length == 0, F.lit(float("nan"))).otherwise(1 - dot(a, b) / F.nullif(length, F.lit(0.0)))


# A model takes texts and returns one row of floats per text.
Model = Callable[[pd.Series], np.ndarray]


def token_hashes(text: Column) -> Column:
    """Hashes of the lower-cased words and of neighbouring word pairs."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"{NON_WS}+"), 0)
    singles = F.transform(words, lambda w: F.xxhash64(w))
    pairs = F.zip_with(
        F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))),
        F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))),
        lambda a, b: F.xxhash64(a, b),
    )
    return F.concat(singles, pairs)


def embed_hash(text: Column, dim: int = 384) -> Column:
    """Default embedding: signed feature hashing, scaled to unit length.

    Hashing runs in the JVM; the scatter-add over an Arrow batch is one numpy
    call. A text without words embeds to the zero vector.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def scatter(hashes: pd.Series) -> pd.Series:
        lengths = hashes.map(len).to_numpy()
        out = np.zeros((len(hashes), dim))
        if lengths.sum():
            flat = np.concatenate(hashes.to_numpy()).astype(np.int64)
            rows = np.repeat(np.arange(len(hashes)), lengths)
            sign = np.where(flat < 0, -1.0, 1.0)
            np.add.at(out, (rows, np.abs(flat % dim)), sign)
        size = np.linalg.norm(out, axis=1, keepdims=True)
        out = np.divide(out, size, out=out, where=size > 0).astype(np.float32)
        return pd.Series(list(out))

    return scatter(token_hashes(text))


def embed_with(load_model: Callable[[], Model]) -> Callable[[Column], Column]:
    """Embedding by a plug-in model.

    ``load_model`` runs at most once per task and not at all for an empty
    partition. Rows are scaled to unit length.
    """

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = None
        for texts in batches:
            if len(texts) == 0:
                yield pd.Series([], dtype=object)
                continue
            model = model or load_model()
            vectors = np.asarray(model(texts), dtype=np.float64)
            size = np.linalg.norm(vectors, axis=1, keepdims=True)
            vectors = np.divide(vectors, size, out=vectors, where=size > 0)
            yield pd.Series(list(vectors.astype(np.float32)))

    # Non-deterministic, so the optimizer never runs the model twice per row.
    return run.asNondeterministic()


def hyperplane_buckets(vectors: np.ndarray, planes: np.ndarray, bits: int) -> np.ndarray:
    """Sign patterns of vectors, one per row, against fixed hyperplanes: one integer per
    run of ``bits`` planes."""
    sides = (vectors @ planes.T >= 0).reshape(len(vectors), -1, bits)
    return sides @ (1 << np.arange(bits - 1, -1, -1))


def random_planes(count: int, dim: int, seed: int = 7) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((count, dim))
