"""Projection of the fact tables as a property graph."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from veritrace.functions.labels import RELATIONSHIP_TYPES
from veritrace.session import materialize

# Relationship types that may become edge types.
EDGE_TYPES = [label for label in RELATIONSHIP_TYPES if label != "UNRELATED"]


def nodes(documents: DataFrame, facts: DataFrame, entities: DataFrame, evidence: DataFrame) -> DataFrame:
    """One row per node: label, node_id and the properties of its kind.

    Only entities that some fact is about become nodes. Input ids are unique
    except for evidence, where a repeated insert is merged.
    """
    def node(df: DataFrame, label: str, key: str, *props: str | Column) -> DataFrame:
        return df.select(F.lit(label).alias("label"), F.col(key).cast("string").alias("node_id"), *props)

    subjects = facts.select(F.col("subject_entity_id").alias("entity_id"))
    about = entities.join(subjects, "entity_id", "left_semi")
    parts = [
        node(documents, "Document", "document_id", "filename", "status"),
        node(
            facts, "Fact", "fact_id", "value_raw", "confidence",
            F.coalesce("time_value", F.lit("")).alias("time_value"), F.coalesce("scope", F.lit("")).alias("scope"),
        ),
        node(about, "Entity", "entity_id", F.col("canonical_name").alias("name")),
        node(evidence.dropDuplicates(["evidence_id"]), "Evidence", "evidence_id", "quote", "page_number"),
    ]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def ref(label: str, key: str) -> Column:
    return F.concat(F.lit(f"{label}:"), F.col(key).cast("string"))


def edges(
    documents: DataFrame, facts: DataFrame, entities: DataFrame, evidence: DataFrame, relationships: DataFrame,
    all_facts: DataFrame | None = None,
) -> DataFrame:
    """Distinct edges (edge_type, src, dst); see ``edge_rows``."""
    return edge_rows(documents, facts, entities, evidence, relationships, all_facts).distinct()


def edge_rows(
    documents: DataFrame, facts: DataFrame, entities: DataFrame, evidence: DataFrame, relationships: DataFrame,
    all_facts: DataFrame | None = None,
) -> DataFrame:
    """Edges (edge_type, src, dst) whose two ends exist, some maybe more than once. If ``facts`` are those of
    a batch, ``all_facts`` has those that its relationships may lead to."""
    doc_ids = documents.select("document_id")
    fact_ids = facts.select("fact_id")
    known = fact_ids if all_facts is None else all_facts.select("fact_id")
    subject_ids = entities.select(F.col("entity_id").alias("subject_entity_id"))

    def edge(df: DataFrame, kind: Column | str, src: Column, dst: Column) -> DataFrame:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return df.select(kind.alias("edge_type"), src.alias("src"), dst.alias("dst"))

    typed = (
        relationships.withColumn("kind", F.upper("relationship_type")).filter(F.col("kind").isin(EDGE_TYPES))
        .join(known.withColumnRenamed("fact_id", "fact_a_id"), "fact_a_id", "left_semi")
        .join(known.withColumnRenamed("fact_id", "fact_b_id"), "fact_b_id", "left_semi")
    )
    parts = [
        edge(facts.join(doc_ids, "document_id", "left_semi"), "FROM_DOCUMENT",
             ref("Fact", "fact_id"), ref("Document", "document_id")),
        edge(facts.join(subject_ids, "subject_entity_id", "left_semi"), "ABOUT",
             ref("Fact", "fact_id"), ref("Entity", "subject_entity_id")),
        edge(evidence.join(fact_ids, "fact_id", "left_semi"), "SUPPORTED_BY",
             ref("Fact", "fact_id"), ref("Evidence", "evidence_id")),
        edge(evidence.join(doc_ids, "document_id", "left_semi"), "FROM",
             ref("Evidence", "evidence_id"), ref("Document", "document_id")),
        edge(typed, F.col("kind"), ref("Fact", "fact_a_id"), ref("Fact", "fact_b_id")),
    ]
    return reduce(DataFrame.unionByName, parts)


def once(rows: DataFrame, key: str) -> DataFrame:
    """Distinct rows in the order of ``key``. One sort, which also serves a join by the key; as a grouping
    without values it would hold all rows of a task in two hash tables before that sort."""
    same = Window.partitionBy(key, *(c for c in rows.columns if c != key)).orderBy(key)
    return rows.withColumn("_n", F.row_number().over(same)).filter(F.col("_n") == 1).drop("_n")


def provenance_trace(facts: DataFrame, evidence: DataFrame, documents: DataFrame) -> DataFrame:
    """Claim, the quotes that support it, and the documents they stand in."""
    return (
        facts.select("fact_id", "value_raw")
        .join(evidence.select("fact_id", "evidence_id", "quote", "page_number", "document_id"), "fact_id")
        .join(documents.select("document_id", "filename"), "document_id")
    )


def neighbours(edge_rows: DataFrame, start: str, hops: int) -> DataFrame:
    """Nodes within ``hops`` undirected steps of ``start``, with the fewest
    steps that reach them. Each step reduces the frontier to distinct nodes and
    stores it, so that its size is known before it joins: a small one goes to
    the edges. They may repeat, as making them distinct would send them all."""
    pairs = edge_rows.select(F.array("src", "dst").alias("ends"))
    arrows = pairs.select(
        F.inline(F.array(
            F.struct(F.get("ends", 0).alias("node"), F.get("ends", 1).alias("other")),
            F.struct(F.get("ends", 1).alias("node"), F.get("ends", 0).alias("other")),
        ))
    )
    # The first step is a filter, which reaches the scans.
    step = arrows.filter(F.col("node") == start).select(F.col("other").alias("node")).distinct()
    found = [arrows.sparkSession.range(1).select(F.lit(start).alias("node"), F.lit(0).alias("hops"))]
    for depth in range(1, hops + 1):
        if depth < hops:
            step = materialize(step, "frontier")
        found.append(step.withColumn("hops", F.lit(depth)))
        if depth < hops:
            step = arrows.join(step, "node").select(F.col("other").alias("node")).distinct()
    return reduce(DataFrame.unionByName, found).groupBy("node").agg(F.min("hops").alias("hops"))
