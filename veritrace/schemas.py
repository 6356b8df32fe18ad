"""Table schemas. Ids are strings derived from natural keys (see ``ids``)."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

MONEY = T.StructType([
    T.StructField("amount", T.DecimalType(38, 6)),
    T.StructField("unit", T.StringType()),
    T.StructField("currency", T.StringType()),
])

DOCUMENTS = T.StructType([
    T.StructField("document_id", T.StringType(), False),
    T.StructField("filename", T.StringType(), False),
    T.StructField("sha256", T.StringType(), False),
    T.StructField("mime_type", T.StringType(), False),
    T.StructField("page_count", T.IntegerType()),
    T.StructField("status", T.StringType(), False),
    T.StructField("uploaded_at", T.TimestampType(), False),
    T.StructField("processed_at", T.TimestampType()),
])

# What of a document never changes, and each change of the rest.
DOCUMENT_ROWS = T.StructType([f for f in DOCUMENTS.fields if f.name in ("document_id", "filename", "sha256", "mime_type", "uploaded_at")])

DOCUMENT_CHANGES = T.StructType([
    T.StructField("document_id", T.StringType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("page_count", T.IntegerType()),
    T.StructField("at", T.TimestampType(), False),
])

PAGES = T.StructType([
    T.StructField("document_id", T.StringType(), False),
    T.StructField("page_number", T.IntegerType(), False),
    T.StructField("extraction_method", T.StringType(), False),
    T.StructField("text", T.StringType(), False),
    T.StructField("confidence", T.FloatType()),
])

CHUNKS = T.StructType([
    T.StructField("chunk_id", T.StringType(), False),
    T.StructField("document_id", T.StringType(), False),
    T.StructField("chunk_no", T.IntegerType(), False),
    T.StructField("page_start", T.IntegerType(), False),
    T.StructField("page_end", T.IntegerType(), False),
    T.StructField("text", T.StringType(), False),
    T.StructField("char_start", T.LongType(), False),
    T.StructField("char_end", T.LongType(), False),
    T.StructField("token_count", T.IntegerType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
])

PREDICATES = T.StructType([
    T.StructField("predicate_id", T.StringType(), False),
    T.StructField("canonical_name", T.StringType(), False),
    T.StructField("aliases", T.ArrayType(T.StringType()), False),
    T.StructField("value_type", T.StringType(), False),
    T.StructField("unit_class", T.StringType()),
])

ENTITIES = T.StructType([
    T.StructField("entity_id", T.StringType(), False),
    T.StructField("canonical_name", T.StringType(), False),
    T.StructField("entity_type", T.StringType(), False),
    T.StructField("normalized_key", T.StringType(), False),
])

ALIASES = T.StructType([
    T.StructField("entity_id", T.StringType(), False),
    T.StructField("alias_text", T.StringType(), False),
    T.StructField("confidence", T.FloatType(), False),
    T.StructField("source_chunk_id", T.StringType()),
])

# What an extraction provider must return, one row per proposed fact.
PROPOSED_FACT = T.StructType([
    T.StructField("subject", T.StringType()),
    T.StructField("subject_type", T.StringType()),
    T.StructField("predicate", T.StringType()),
    T.StructField("predicate_is_new", T.BooleanType()),
    T.StructField("value_raw", T.StringType()),
    T.StructField("time_type", T.StringType()),
    T.StructField("time_value", T.StringType()),
    T.StructField("scope", T.StringType()),
    T.StructField("confidence", T.FloatType()),
    T.StructField("quote", T.StringType()),
])

FACTS = T.StructType([
    T.StructField("fact_id", T.StringType(), False),
    T.StructField("document_id", T.StringType(), False),
    T.StructField("chunk_id", T.StringType()),
    T.StructField("subject_entity_id", T.StringType()),
    T.StructField("predicate_id", T.StringType()),
    T.StructField("value_raw", T.StringType(), False),
    T.StructField("value_normalized", MONEY),
    T.StructField("time_type", T.StringType()),
    T.StructField("time_value", T.StringType()),
    T.StructField("scope", T.StringType()),
    T.StructField("confidence", T.FloatType(), False),
    T.StructField("char_start", T.IntegerType()),
    T.StructField("char_end", T.IntegerType()),
    T.StructField("embedding", T.ArrayType(T.FloatType())),
    T.StructField("status", T.StringType(), False),
    T.StructField("created_at", T.TimestampType(), False),
])

EVIDENCE = T.StructType([
    T.StructField("evidence_id", T.StringType(), False),
    T.StructField("fact_id", T.StringType(), False),
    T.StructField("document_id", T.StringType(), False),
    T.StructField("page_number", T.IntegerType(), False),
    T.StructField("chunk_id", T.StringType()),
    T.StructField("quote", T.StringType(), False),
    T.StructField("char_start", T.IntegerType()),
    T.StructField("char_end", T.IntegerType()),
])

RELATIONSHIPS = T.StructType([
    T.StructField("fact_a_id", T.StringType(), False),
    T.StructField("fact_b_id", T.StringType(), False),
    T.StructField("relationship_type", T.StringType(), False),
    T.StructField("explanation", T.StringType(), False),
    T.StructField("confidence", T.FloatType(), False),
    T.StructField("created_at", T.TimestampType(), False),
])

JOB_EVENTS = T.StructType([
    T.StructField("document_id", T.StringType(), False),
    T.StructField("stage", T.StringType(), False),
    T.StructField("seq", T.LongType(), False),
    T.StructField("status", T.StringType(), False),
    T.StructField("error", T.StringType()),
    T.StructField("metrics", T.StringType()),
    T.StructField("at", T.TimestampType(), False),
])


# Nodes and edges of the graph as each batch projects them.
NODE_VERSIONS = T.StructType([
    T.StructField("batch", T.LongType(), False),
    T.StructField("label", T.StringType(), False),
    T.StructField("node_id", T.StringType(), False),
    T.StructField("filename", T.StringType()),
    T.StructField("status", T.StringType()),
    T.StructField("value_raw", T.StringType()),
    T.StructField("confidence", T.FloatType()),
    T.StructField("time_value", T.StringType()),
    T.StructField("scope", T.StringType()),
    T.StructField("name", T.StringType()),
    T.StructField("quote", T.StringType()),
    T.StructField("page_number", T.IntegerType()),
])

EDGE_VERSIONS = T.StructType([
    T.StructField("edge_type", T.StringType(), False),
    T.StructField("src", T.StringType(), False),
    T.StructField("dst", T.StringType(), False),
])


def natural_id(*parts: Column | str) -> Column:
    """A stable id from the natural key: the same row gets the same id on a
    retry or a replay, unlike a random uuid. Parts are length-prefixed so that
    ("ab", "c") and ("a", "bc") differ."""
    cols = [F.col(p) if isinstance(p, str) else p for p in parts]
    tagged = []
    for col in cols:
        text = F.coalesce(col.cast("string"), F.lit(""))
        tagged.append(F.concat(F.length(text).cast("string"), F.lit(":"), text))
    return F.sha2(F.concat_ws("|", *tagged), 256)
