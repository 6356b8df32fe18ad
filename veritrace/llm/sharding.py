"""Shards of near equal bytes by longest-processing-time scheduling.

Rows of equal text form a group that stays together. Groups go, largest first,
to the least loaded shard, which a heap gives. Groups are taken by size class:
the leading ``CLASS_BITS`` bits of their size in bytes, so sizes in a class differ by
less than one part in 2**(CLASS_BITS - 1) and small sizes not at all. The driver
sees one row per class (at most ``64 << CLASS_BITS``), whatever the input. A class
with many groups first fills the lower shards to a level in one step, with what
the heap would do one by one, and the heap deals the rest.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession, functions as F

from veritrace.llm.base import id_or_null, identified, keep, number_within, table

CLASS_BITS = 12


def deal(classes: list[tuple[int, int, int]], shards: int) -> list[tuple[int, list[int]]]:
    """(class, groups per shard) for (class, groups, bytes), by decreasing mean size."""
    load = [(0, i) for i in range(shards)]
    out = []
    for key, count, total in sorted(classes, key=lambda c: (-c[2] / c[1], c[0])):
        mean, given, left = total / count, [0] * shards, count
        if count > shards:
            # The highest level up to which whole groups of this size fit in the lower shards.
            low, high = min(load)[0], max(load)[0] + total
            for _ in range(80):
                level = (low + high) / 2
                fits = sum(max(0, int((level - at) // mean)) for at, _ in load)
                low, high = (level, high) if fits <= count - shards else (low, level)
            for n, (at, i) in enumerate(load):
                given[i] = max(0, int((low - at) // mean))
                load[n] = (at + given[i] * mean, i)
            left -= sum(given)
            heapq.heapify(load)
        for _ in range(left):
            at, i = load[0]
            heapq.heapreplace(load, (at + mean, i))
            given[i] += 1
        out.append((key, given))
    return out


def lpt_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, size, text_crc32, shard,
    slot (gapless from 0 in each shard).

    A row's size is the bytes of its text plus 1. Null texts are empty texts and
    go with them. One group larger than a fair share fills a shard alone. Rows
    that agree in id and text get neighbouring slots in any order. An empty
    table gives no rows; with fewer groups than shards some shards stay empty.
    """
    spark = docs.sparkSession
    data = F.encode(F.col("text"), "UTF-8")
    rows = keep(
        identified(docs).select(
            "_id", "_h", F.unhex(F.sha2(data, 256)).alias("_g"), (F.octet_length("text").cast("long") + 1).alias("size"),
            F.crc32(data).alias("text_crc32"),
        ),
        "sizes",
    )
    bits = F.length(F.bin("_bytes"))
    shift = F.greatest(F.lit(0), bits - CLASS_BITS).cast("int")
    groups = rows.groupBy("_g").agg(F.sum("size").alias("_bytes")).withColumn("_c", shift * F.lit(1 << CLASS_BITS) + F.expr(
        f"shiftright(_bytes, cast(greatest(0, length(bin(_bytes)) - {CLASS_BITS}) as int))"))
    groups = keep(groups, "groups")
    classes = groups.groupBy("_c").agg(F.count(F.lit(1)).alias("n"), F.sum("_bytes").alias("b")).collect()
    plan = []
    for key, given in deal([(r["_c"], r["n"], r["b"]) for r in classes], shards):
        at = 0
        for shard, n in enumerate(given):
            if n:
                plan.append((key, at, at + n, shard))
                at += n
    placed = spark.createDataFrame(plan, "_c long, _from long, _to long, shard int")
    ranked = number_within(groups, ["_c"], ["_g"], "_rank")
    # At most one row per class and shard: bounded, see above.
    homes = ranked.join(F.broadcast(placed), "_c").filter("_rank >= _from and _rank < _to").select("_g", "shard")
    housed = keep(rows.join(homes, "_g").drop("_g"), "shards")
    out = number_within(housed, ["shard"], ["_id", "_h"], "slot", buckets=1024)
    return out.select(id_or_null().alias("doc_id"), "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lpt_shards(table(spark, sf_dir, "documents"))
    return out.withColumn("law", F.lit("bytes")).withColumn("grown_shard", F.lit(None).cast("int"))
