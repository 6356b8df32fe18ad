"""Registered queries: the ingest stream over the sample documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from veritrace.plans.catalog import ORACLES, QUERIES
from veritrace.sources.store import Store
from veritrace.session import scratch_path
from veritrace.streaming.ingest import landing_stream, start_ingest


def stream_ingest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents through the stream; every distinct text once, with the
    chunks made of it."""
    schema = spark.read.parquet(f"{sf_dir}/documents.parquet").schema
    # The table is one file or a folder of them; a stream takes either by a pattern, which here fits one name.
    rows = landing_stream(spark, f"{sf_dir}/documents[.]parquet", schema, glob="*").select(
        F.format_string("%012d.txt", "doc_id").alias("filename"), "text"
    )
    root = scratch_path(spark, "stream")
    store = Store(spark, f"{root}/tables")
    start_ingest(rows, store, f"{root}/checkpoint", available_now=True).awaitTermination()
    chunks = store.read("chunks").groupBy("document_id").agg(
        F.count(F.lit(1)).alias("n_chunks"), F.sum(F.length("text")).alias("n_chars")
    )
    return store.read("documents").join(chunks, "document_id", "left").select(
        "filename", "sha256", "status", F.coalesce("n_chunks", F.lit(0)).alias("n_chunks"), "n_chars"
    )


QUERIES["stream_ingest"] = stream_ingest
# The sample texts have no blank lines, so each is one unit and one chunk.
ORACLES["stream_ingest"] = """
    SELECT lpad(CAST(min(doc_id) AS VARCHAR), 12, '0') || '.txt' AS filename, sha256(text) AS sha256, 'ready' AS status,
           CAST(1 AS BIGINT) AS n_chunks, CAST(len(text) AS BIGINT) AS n_chars
    FROM documents GROUP BY text"""
