"""Trigram sets and their similarity, as used for fuzzy name matching."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def trigrams(text: Column) -> Column:
    """Distinct trigrams of the lower-cased alphanumeric words, each word
    padded with two blanks before and one after."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), 0)
    grams = F.transform(
        words,
        lambda w: F.transform(
            F.sequence(F.lit(1), F.length(w) + 1),
            lambda i: F.concat(F.lit("  "), w, F.lit(" ")).substr(i, F.lit(3)),
        ),
    )
    return F.array_distinct(F.flatten(grams))


def set_similarity(a: Column, b: Column) -> Column:
    """Shared elements over all elements; 0 for two empty sets."""
    shared = F.size(F.array_intersect(a, b))
    total = F.size(a) + F.size(b) - shared
    return F.when(total == 0, 0.0).otherwise(shared.cast("double") / total)


def similarity(a: Column, b: Column) -> Column:
    return set_similarity(trigrams(a), trigrams(b))
