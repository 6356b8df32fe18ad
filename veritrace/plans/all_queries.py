"""Imports every module that registers queries."""

from veritrace.plans import queries_facts, queries_ingest, queries_read, queries_stream  # noqa: F401
from veritrace.plans.catalog import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
