"""Run log: append-only stage events and the state they add up to.

Parquet has no updates, so a start or finish of a stage is a new row and the
current state is the last event. All states come from grouped ``max``
aggregates, which combine before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The stages of a run, in order.
STAGES = ["extract_text", "chunk", "embed", "extract_facts", "reason_relationships"]


def stage_events(rows: DataFrame, stage: str, status: str, seq: Column, error: Column | None = None, metrics: Column | None = None) -> DataFrame:
    """Events of one stage for every document in ``rows``."""
    return rows.select(
        "document_id", F.lit(stage).alias("stage"), seq.cast("long").alias("seq"), F.lit(status).alias("status"),
        (F.lit(None) if error is None else error).cast("string").alias("error"),
        (F.lit(None) if metrics is None else F.to_json(metrics)).cast("string").alias("metrics"),
        F.current_timestamp().alias("at"),
    )


def job_state(events: DataFrame) -> DataFrame:
    """Last event of each (document, stage)."""
    last = F.max(F.struct("seq", "status", "error", "metrics"))
    return events.groupBy("document_id", "stage").agg(last.alias("e")).select("document_id", "stage", "e.*")


def fail_running(state: DataFrame, failures: DataFrame) -> DataFrame:
    """A stage still running for a failed document (document_id, failure) has
    failed, with the document's error."""
    left = state.join(failures.select("document_id", "failure"), "document_id", "left")
    stuck = (F.col("status") == "running") & F.col("failure").isNotNull()
    return left.select(
        "document_id", "stage", "seq",
        F.when(stuck, "failed").otherwise(F.col("status")).alias("status"),
        F.when(stuck, F.col("failure")).otherwise(F.col("error")).alias("error"),
    )


def document_status(changes: DataFrame) -> DataFrame:
    """State of each document after its status changes (document_id, seq,
    status, page_count, at): the last status, the last page count that was
    given, and the time of the last change to ready."""
    given = F.col("page_count").isNotNull()
    ready = F.col("status") == "ready"
    return changes.groupBy("document_id").agg(
        F.max(F.struct("seq", "status"))["status"].alias("status"),
        F.max(F.when(given, F.struct("seq", "page_count")))["page_count"].alias("page_count"),
        F.max(F.when(ready, F.struct("seq", "at")))["at"].alias("processed_at"),
    )
