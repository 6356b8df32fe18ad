"""Helpers shared by the operators of this subpackage.

Row identity. Ids may be null or repeated, so rows are told apart by
``(_id, _h)``: the id, with null as the largest long, and a hash of the text.
Rows that agree in both have the same id and text and get the same result.
Input columns other than those named by an operator are never read, so their
names cannot clash with working columns.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from veritrace.session import materialize, prepare

NO_ID = (1 << 63) - 1
#: Rows per Arrow batch: bounds the memory of a Python worker on long texts.
BATCH_ROWS = 1024


def ready(spark: SparkSession) -> SparkSession:
    """Session settings that the operators rely on."""
    prepare(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ready(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_or_empty(col: str = "text") -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def identified(docs: DataFrame, *more: Column) -> DataFrame:
    """``_id``, ``_h`` and the text (null as empty) of every row."""
    text = text_or_empty()
    return docs.select(
        F.coalesce(F.col("doc_id"), F.lit(NO_ID)).alias("_id"), F.xxhash64(text).alias("_h"), text.alias("text"), *more
    )


def id_or_null(col: str = "_id") -> Column:
    """The id as it was given."""
    return F.when(F.col(col) != NO_ID, F.col(col))


def keep(df: DataFrame, label: str) -> DataFrame:
    """Writes to the shared folder and reads back, which cuts the lineage."""
    return materialize(df, label)


def number_within(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str, buckets: int = 256) -> DataFrame:
    """Adds ``name``: 0, 1, ... within each combination of ``keys``.

    A key may hold most rows: its rows are dealt to buckets by a hash of the
    order columns, numbered there, and shifted by the sizes of the buckets
    before. Rows that agree in all order columns are interchangeable. ``df`` is
    read twice, so it should be a stored table.
    """
    spot = F.pmod(F.xxhash64(*order), F.lit(buckets)).alias("_b")
    rows = df.withColumn("_b", spot)
    sizes = rows.groupBy(*keys, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_at"))
    inside = Window.partitionBy(*keys, "_b").orderBy(*order)
    numbered = rows.withColumn("_r", F.row_number().over(inside) - 1)
    return numbered.join(starts, [*keys, "_b"]).withColumn(name, F.col("_at") + F.col("_r")).drop("_b", "_at", "_r")
