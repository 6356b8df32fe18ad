"""veritrace: evidence-backed fact tables as Spark jobs.

Documents are fingerprinted, paged, chunked and embedded; facts are extracted,
grounded in their source text, resolved to entities and compared across
documents; the read side searches, lists, groups and projects the result.
Every stage is a function from DataFrames to DataFrames.
"""
