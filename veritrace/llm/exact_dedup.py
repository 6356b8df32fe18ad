"""Exact duplicates by distributed MSD radix partitioning.

Texts are compared without the characters space and \\t \\n \\v \\f \\r. A group of
rows that agree so far is split by its next bytes (one digit), until a group
has one row or its texts end. Digits grow, so the rounds grow with the logarithm
of the longest text. Equality is decided by the bytes alone; no digest is used.

A group's id is the least doc_id and least text hash in it, which no group
apart from it shares. It is found by an aggregation that combines before the
shuffle, so copies that hold a third of all rows meet in no task; rows learn
their group by a join whose large keys adaptive execution splits. Only rows in
groups of two or more go on, carrying the rest of their text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veritrace.llm.base import id_or_null, identified, keep, table

#: Bytes of the first two digits, taken from the documents without moving the
#: rest of their text, and how much longer each later digit is than the last.
FIRST_DIGIT, SECOND_DIGIT, GROWTH = 64, 448, 4


def normalized(text: Column) -> Column:
    return F.encode(F.translate(text, " \t\n\x0b\x0c\r", ""), "UTF-8")


def _split(rows: DataFrame, *digit: str) -> DataFrame:
    """Groups of two or more rows that agree in ``digit``, with a group id."""
    # The least id and the least hash of a group: long buffers, so it is hashed and not sorted.
    found = rows.groupBy(*digit).agg(F.count(F.lit(1)).alias("_n"), F.struct(F.min("_id"), F.min("_h")).alias("_group"))
    return found.filter("_n > 1").drop("_n")


def equal_groups(docs: DataFrame) -> DataFrame:
    """(_id, _h, _group) of the rows whose normalised text occurs more than once."""
    base = identified(docs).withColumn("_t", normalized(F.col("text"))).drop("text")
    heads = base.select("_id", "_h", F.substring("_t", 1, FIRST_DIGIT).alias("_d"))
    active = heads.join(_split(heads, "_d"), "_d").select("_id", "_h", F.col("_group").alias("_g")).dropDuplicates(["_id", "_h"])

    digits = base.select("_id", "_h", F.substring("_t", FIRST_DIGIT + 1, SECOND_DIGIT).alias("_d"))
    second = keep(digits.join(active, ["_id", "_h"]), "radix")
    active = keep(second.join(_split(second, "_g", "_d"), ["_g", "_d"]).select("_id", "_h", "_d", "_group"), "radix")
    done = active.filter(F.octet_length("_d") < SECOND_DIGIT).select("_id", "_h", "_group")

    open_rows = active.filter(F.octet_length("_d") == SECOND_DIGIT).select("_id", "_h", "_group").dropDuplicates(["_id", "_h"])
    rest = F.substring("_t", FIRST_DIGIT + SECOND_DIGIT + 1, 1 << 30)
    rows = keep(base.join(open_rows, ["_id", "_h"]).select("_id", "_h", "_group", rest.alias("_rest")), "radix")
    width = (FIRST_DIGIT + SECOND_DIGIT) * GROWTH
    while not rows.isEmpty():
        cut = rows.select(
            "_id", "_h", F.col("_group").alias("_g"), F.substring("_rest", 1, width).alias("_d"),
            F.substring("_rest", width + 1, 1 << 30).alias("_rest"),
        )
        ended = F.octet_length("_d") < width
        split = keep(
            cut.join(_split(cut, "_g", "_d"), ["_g", "_d"]).select("_id", "_h", "_group", "_rest", ended.alias("_e")), "radix"
        )
        done = done.union(split.filter("_e").select("_id", "_h", "_group"))
        rows = split.filter("not _e").select("_id", "_h", "_group", "_rest")
        width *= GROWTH
    return done


def exact_dedup(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, keep_id, group_size,
    kept, text_sha256, and ``_h``, the hash of the text.

    Of equal texts, the row with the most code points in its original text
    stays, then the smallest doc_id (null after all others), then one of the
    rows that agree in both. Null and empty texts, and texts of white space
    only, are equal. An empty table gives no rows.
    """
    info = identified(docs).select(
        "_id", "_h", F.length("text").alias("_len"), F.sha2(normalized(F.col("text")), 256).alias("text_sha256"),
        F.monotonically_increasing_id().alias("_u"),
    )
    rows = keep(info.join(equal_groups(docs).dropDuplicates(["_id", "_h"]), ["_id", "_h"], "left"), "copies")
    best = F.min(F.struct((-F.col("_len")).alias("len"), "_id", "_u")).alias("_best")
    groups = rows.filter("_group is not null").groupBy("_group").agg(best, F.count(F.lit(1)).alias("group_size"))
    many = rows.join(groups, "_group").select(
        "_id", "_h", F.col("_best._id").alias("_keep"), "group_size", (F.col("_u") == F.col("_best._u")).alias("kept"), "text_sha256"
    )
    one = rows.filter("_group is null").select(
        "_id", "_h", F.col("_id").alias("_keep"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    return many.union(one).select(
        id_or_null().alias("doc_id"), id_or_null("_keep").alias("keep_id"), "group_size", "kept", "text_sha256", "_h"
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("_h")


SQL = r"""
WITH d AS (
    SELECT doc_id, length(coalesce(text, '')) AS n,
           regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t
    FROM documents
), g AS (
    SELECT *, first_value(doc_id) OVER (PARTITION BY t ORDER BY n DESC, doc_id) AS keep_id,
           count(*) OVER (PARTITION BY t) AS group_size
    FROM d
)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM g
"""
