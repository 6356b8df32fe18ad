"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from veritrace.llm import chat, exact_dedup, hamming, jaccard, languages, mixing, packing, phrases, quality, runs, sharding, substrings, urls

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": exact_dedup.query,
    "op2_mixing": mixing.query,
    "op3_chat_formatting": chat.query,
    "op4_substring_dedup": substrings.query,
    "op5_packing": packing.query,
    "op6_quality": quality.query,
    "op7_jaccard": jaccard.query,
    "op8_hamming_topk": hamming.query,
    "op9_sharding": sharding.query,
    "op10_url_filter": urls.query,
    "op11_periodic_runs": runs.query,
    "op12_collocations": phrases.query,
    "op13_language_id": languages.query,
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": exact_dedup.SQL,
    "op2_mixing": mixing.SQL,
    "op3_chat_formatting": chat.SQL,
    "op4_substring_dedup": substrings.SQL,
    "op7_jaccard": jaccard.SQL,
    "op8_hamming_topk": hamming.SQL,
    "op10_url_filter": urls.SQL,
    "op11_periodic_runs": runs.SQL,
    "op12_collocations": phrases.SQL,
}
