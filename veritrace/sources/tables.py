"""Reading files as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def scan_files(spark: SparkSession, path: str, glob: str = "*.pdf") -> DataFrame:
    """Files below ``path``: (filename, content, n_bytes, modified_at)."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
        .load(path)
        .selectExpr(
            "element_at(split(path, '/'), -1) AS filename", "content",
            "length AS n_bytes", "modificationTime AS modified_at",
        )
    )
