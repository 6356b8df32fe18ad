"""Continuous ingest: each micro-batch of documents runs the batch flow."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from veritrace.operators.reasoning import RELATED, related_facts
from veritrace.plans.flows import Store, ingest_documents

ARRIVALS = T.StructType([T.StructField("filename", T.StringType()), T.StructField("text", T.StringType())])


def pair_arrivals(stored: DataFrame, arrived: DataFrame, k: int = RELATED) -> DataFrame:
    """Forward-only comparison: arriving facts look for partners among all
    facts; stored facts are not asked again until a recomputation."""
    return related_facts(stored.unionByName(arrived), anchors=arrived, k=k)


def start_ingest(arrivals: DataFrame, store: Store, checkpoint: str, available_now: bool = False, **providers):
    """Starts the streaming query over an ``arrivals`` stream (filename, text).

    Replays are harmless: ids come from content, and a batch that ran half way
    replaces what it stored.
    """
    def run(batch: DataFrame, batch_id: int) -> None:
        ingest_documents(store, batch, batch=batch_id, **providers)

    writer = arrivals.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    if available_now:
        writer = writer.trigger(availableNow=True)
    return writer.start()


def landing_stream(spark: SparkSession, path: str, schema: T.StructType = ARRIVALS, max_files: int = 1000, glob: str = "*.parquet") -> DataFrame:
    """Parquet files as they land in a folder."""
    return (
        spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).option("pathGlobFilter", glob).parquet(path)
    )
