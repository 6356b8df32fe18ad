"""Vector search over chunks and facts, and the evidence bundle of a question."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veritrace.functions import text as tx
from veritrace.functions.vectors import cosine_distance
from veritrace.operators.nearest import distance_order, nearest_to_questions
from veritrace.session import materialize

# Items retrieved per question.
CHUNKS_PER_QUESTION = 4
FACTS_PER_QUESTION = 8


def search(rows: DataFrame, vector: list[float], k: int, key: str) -> DataFrame:
    """One question: the ``k`` nearest rows, by top-k without a full sort."""
    probe = F.lit([float(x) for x in vector]).cast("array<float>")
    return (
        rows.withColumn("distance", cosine_distance(F.col("embedding"), probe))
        .orderBy(*distance_order(), key).limit(k)
    )


def search_chunks(chunks: DataFrame, vector: list[float], k: int = CHUNKS_PER_QUESTION) -> DataFrame:
    return search(chunks, vector, k, "chunk_id")


def search_facts(facts: DataFrame, vector: list[float], k: int = FACTS_PER_QUESTION) -> DataFrame:
    """Only active facts compete."""
    return search(facts.filter(F.col("status") == "active"), vector, k, "fact_id")


def _questions(questions: DataFrame) -> DataFrame:
    return questions.select(F.col("question_id").alias("anchor_id"), "embedding")


def _named(found: DataFrame, key: str) -> DataFrame:
    return found.select(
        F.col("anchor_id").alias("question_id"), F.col("candidate_id").alias(key), "distance", "rank"
    )


def search_chunks_batch(questions: DataFrame, chunks: DataFrame, k: int = CHUNKS_PER_QUESTION) -> DataFrame:
    """Many questions (question_id, embedding) at once."""
    found = nearest_to_questions(_questions(questions), chunks.select(F.col("chunk_id").alias("candidate_id"), "embedding"), k)
    return _named(found, "chunk_id")


def search_facts_batch(questions: DataFrame, facts: DataFrame, k: int = FACTS_PER_QUESTION) -> DataFrame:
    active = facts.filter(F.col("status") == "active")
    found = nearest_to_questions(_questions(questions), active.select(F.col("fact_id").alias("candidate_id"), "embedding"), k)
    return _named(found, "fact_id")


def valid_questions(questions: DataFrame) -> DataFrame:
    """Blank questions are rejected."""
    return questions.filter(~tx.is_blank(F.col("question")))


def evidence_bundle(
    questions: DataFrame, chunks: DataFrame, facts: DataFrame, views: DataFrame, relationships: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What an answer is built from: (facts, relationships, chunks), each one
    row per question and item.

    ``views`` is the fact view, keyed by fact_id. Kept as rows, not nested
    lists: one fact may have any number of relationships.
    """
    # Used twice, and dear.
    hits = materialize(search_facts_batch(questions, facts), "hits")
    fact_rows = hits.join(views, "fact_id")
    ends = relationships.withColumn("fact_id", F.explode(F.array("fact_a_id", "fact_b_id")))
    relation_rows = hits.select("question_id", "fact_id", "rank").join(ends, "fact_id")
    chunk_rows = search_chunks_batch(questions, chunks).join(
        chunks.select("chunk_id", tx.snippet(F.col("text")).alias("snippet")), "chunk_id"
    )
    return fact_rows, relation_rows, chunk_rows
