"""Training corpus from documents: quality, exact and near duplicates, mixture, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the stage before
it kept. ``run`` writes each result to the shared folder and reads it back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from veritrace.llm import base, exact_dedup, jaccard, mixing, packing, quality

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Near copies share this many per cent of their shingles of so many words. Not those of op7's query.
SHINGLE, SIMILAR = 5, 80
#: The scored stage and the packing model have no equivalent in SQL.
ORACLE_SQL = None


def _keys() -> list[Column]:
    return [F.coalesce(F.col("doc_id"), F.lit(base.NO_ID)).alias("_id"), F.xxhash64(base.text_or_empty()).alias("_h")]


def _only(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows with these keys, one for each key."""
    found = docs.select(*COLUMNS, *_keys()).join(keys, ["_id", "_h"], "left_semi")
    first = F.row_number().over(Window.partitionBy("_id", "_h").orderBy("source", "lang"))
    return found.withColumn("_r", first).filter("_r = 1").select(*COLUMNS)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the classifier rejects."""
    base.ready(spark)
    score = quality.scorer(docs, quality.positives(base.table(spark, sf_dir, "labels")))
    scored = docs.select(*COLUMNS, score(base.text_or_empty()).alias("_score"))
    return scored.filter(F.col("_score") >= quality.THRESHOLD).select(*COLUMNS)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of equal texts."""
    base.ready(spark)
    told = exact_dedup.exact_dedup(docs)
    kept = told.filter("kept").select(F.coalesce("doc_id", F.lit(base.NO_ID)).alias("_id"), "_h")
    return _only(docs, kept)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each component of near copies, and all empty ones."""
    base.ready(spark)
    told = jaccard.jaccard_components(docs, k=SHINGLE, percent=SIMILAR).withColumn("_id", F.coalesce("doc_id", F.lit(base.NO_ID)))
    kept = told.filter("n_shingles = 0 or (_id = _c._id and _h = _c._h)").select("_id", "_h")
    return _only(docs, kept)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mixture takes them."""
    base.ready(spark)
    picks = mixing.mix(docs, mixing.sample_domain(), mixing.sample_weights())
    keys = picks.select(F.coalesce("doc_id", F.lit(base.NO_ID)).alias("_id"), "_h", "epoch").distinct()
    return docs.select(*COLUMNS, *_keys()).join(keys, ["_id", "_h"]).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of the mixture."""
    import public_tokenizers

    base.ready(spark)
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", without_copies),
    ("n-gram jaccard join", without_near_copies),
    ("mixing to target weights", mixture),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = base.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = base.keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
