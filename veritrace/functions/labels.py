"""Closed label sets and display values."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Relationship labels.
RELATIONSHIP_TYPES = [
    "CORROBORATES", "CONTRADICTS", "POTENTIAL_CONTRADICTION", "RECONCILES", "TEMPORAL_UPDATE",
    "UNIT_DIFFERENCE", "SCOPE_DIFFERENCE", "UNCERTAIN", "UNRELATED",
]
# Order of the groups in the conflict listing.
DISPLAY_ORDER = [
    "CONTRADICTS", "POTENTIAL_CONTRADICTION", "CORROBORATES", "RECONCILES",
    "SCOPE_DIFFERENCE", "UNIT_DIFFERENCE", "TEMPORAL_UPDATE", "UNCERTAIN",
]
# How document states are shown.
STATUS_LABELS = {"uploaded": "Queued", "processing": "Processing", "ready": "Ready", "failed": "Failed"}
SETTLED = ["ready", "failed"]


def guard_label(label: Column) -> Column:
    """Upper case; anything outside the label set is UNCERTAIN."""
    known = F.upper(label)
    return F.when(known.isin(RELATIONSHIP_TYPES), known).otherwise("UNCERTAIN")


def guard_confidence(confidence: Column, default: float = 0.5) -> Column:
    return F.coalesce(confidence, F.lit(default)).cast("float")


def display_rank(label: Column) -> Column:
    """Position in the listing, from 1; unknown labels come after the known."""
    position = F.array_position(F.lit(DISPLAY_ORDER), label)
    return F.when(position > 0, position).otherwise(len(DISPLAY_ORDER) + 1).cast("int")


def confidence_band(confidence: Column) -> Column:
    # The limits are compared as floats, as the values are.
    value = confidence.cast("float")
    return F.when(value >= F.lit(0.8).cast("float"), "high").when(value >= F.lit(0.6).cast("float"), "medium").otherwise("low")


def confidence_percent(confidence: Column) -> Column:
    """Halves round up."""
    return F.floor(confidence.cast("double") * 100 + 0.5).cast("int")


def status_label(status: Column) -> Column:
    """Unknown states are shown as they are."""
    labels = F.create_map(*[F.lit(x) for pair in STATUS_LABELS.items() for x in pair])
    return F.coalesce(F.try_element_at(labels, status), status)


def is_pending(status: Column) -> Column:
    return ~status.isin(SETTLED)
